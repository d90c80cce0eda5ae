"""A whole grid of experiments over one index, by one pass of retrieval.

Experiments that chunk, embed, retrieve and sample alike differ in how many chunks they take (``top_k``), from which score on (``similarity_threshold``) and how many tokens they
may use. These become columns: the chunks are scored once, at the largest k and the least threshold of all settings. As hits are ranked by score, a hit belongs to a
setting if its rank and its score do, and nothing is scored or ranked again. A hit is repeated for the settings that it belongs to, so contexts, answers and metrics are
those of (question, setting) groups, and the summaries are one aggregation by setting. With a record of calls equal prompts of several settings are asked once.

The settings are stated: at most ``MAX_SETTINGS`` travel with the plan. Settings that ask for the same thing are answered apart. Questions without a hit have empty
contexts, and null figures about them. A group that fails gives a row with its error for each of its experiments, and the other groups go on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import context as C
from lodestrata.operators import generate, prepare
from lodestrata.operators import retrieval as R
from lodestrata.operators.calls import Calls, Model, Record
from lodestrata.plans.config import Experiment
from lodestrata.plans.experiments import all_results, indexed, measured, question_vectors
from lodestrata.plans.summary import context_diagnostics, summarise
from lodestrata.sources.tables import scope

MAX_SETTINGS = 10_000


@dataclass(frozen=True)
class Setting:
    """What an experiment takes from a retrieval that it shares."""

    number: int
    k: int
    threshold: float | None
    budget: int
    with_context: bool = True


def settings_column(settings: list[Setting]) -> Column:
    """The settings as an array of (setting, k, threshold, budget, with_context)."""
    if not 0 < len(settings) <= MAX_SETTINGS:
        raise ValueError(f"a grid has 1 to {MAX_SETTINGS} settings")
    one = lambda s: F.struct(F.lit(s.number).alias("setting"), F.lit(s.k).alias("k"), F.lit(s.threshold).cast("double").alias("threshold"), F.lit(s.budget).alias("budget"), F.lit(s.with_context).alias("with_context"))
    return F.array(*map(one, settings))


def grid_hits(questions: DataFrame, chunks: DataFrame, settings: list[Setting], method: str = "vector-similarity", **how) -> DataFrame:
    """(q_id, setting, budget, chunk_seq, score, rank) of every setting, from one scoring of the chunks. ``how``: ``digits``, and for hybrid retrieval the weights."""
    grid, k = settings_column(settings), max(s.k for s in settings)
    if method == "vector-similarity":
        least = None if any(s.threshold is None for s in settings) else min(s.threshold for s in settings)
        hits = R.top_hits(questions, chunks, k, threshold=least, **how)
    else:
        hits = R.method(method)(questions, chunks, k, **how).withColumnRenamed("combined_score", "score")
    own = F.filter(grid, lambda s: (F.col("rank") <= s["k"]) & (s["threshold"].isNull() | (F.col("score") >= s["threshold"])))
    rows = hits.select("q_id", "chunk_seq", "score", "rank", F.explode(own).alias("s"))
    return rows.select("q_id", "s.setting", "s.budget", "chunk_seq", "score", "rank")


def grid_contexts(questions: DataFrame, chunks: DataFrame, settings: list[Setting], method: str = "vector-similarity", **how) -> DataFrame:
    """One row for each question and setting with its context (and what ``context.assemble`` says of it); texts are joined to the hits after the cut."""
    hits = grid_hits(questions, chunks, settings, method, **how)
    rows = hits.join(chunks.select("chunk_seq", "text"), "chunk_seq").withColumn("key", F.struct("q_id", "setting", "budget"))
    found = C.assemble(rows, F.col("key.budget"), question="key").withColumns({"q_id": F.col("key.q_id"), "setting": F.col("key.setting")}).drop("key")
    every = questions.select("q_id", "question", F.explode(settings_column(settings)).alias("s")).select("q_id", "question", "s.setting", "s.with_context")
    rows = every.join(found, ["q_id", "setting"], "left")
    return rows.withColumns({"context": F.coalesce("context", F.lit("")), "chunks": F.coalesce("chunks", F.array().cast("array<string>"))})


def grid_answers(questions: DataFrame, chunks: DataFrame, settings: list[Setting], make: Callable[[], Model] | None = None, *, method: str = "vector-similarity", record: Record | None = None, model: dict | None = None, calls: Calls | None = None, **how) -> DataFrame:
    """The contexts with prompt, actual, error and seconds. A setting without context asks the bare question."""
    rows = grid_contexts(questions, chunks, settings, method, **how)
    rows = rows.withColumn("prompt", C.prompt(F.when(F.col("with_context"), F.col("context")).otherwise(""), F.col("question")))
    return generate.answered(rows.drop("with_context"), make, record, model, calls)


def shared(e: Experiment) -> tuple:
    """What experiments must have in common to share an index, its hits and the model."""
    r = e.retrieval
    return (e.chunking, e.embedding, e.grouping, e.subset, e.llm, e.metrics, r.type, *(() if r.type == "vector-similarity" else (r.vector_weight, r.keyword_weight)))


def run_grid(docs: DataFrame, qa: DataFrame, experiments: Iterable[Experiment], make: Callable[[Experiment], Callable[[], Model] | None] | None = None, *, embedder: Callable[[Experiment], object] | None = None, cache=None, vectors: Record | None = None, record: Record | None = None, calls: Calls | None = None) -> DataFrame:
    """One summary row for each experiment (seq, name, status, error, metrics), in groups that share an index. ``make`` and ``embedder`` give the models of an experiment, of which
    the first of a group speaks for all."""
    spark, groups = docs.sparkSession, {}
    for seq, e in enumerate(experiments):
        groups.setdefault(shared(e), []).append((seq, e))
    out = None
    for own in groups.values():
        began, first = time.monotonic(), own[0][1]
        try:
            settings = [Setting(seq, e.retrieval.k, e.retrieval.similarity_threshold if e.retrieval.type == "vector-similarity" else None, e.max_context_length, e.include_context) for seq, e in own]
            with scope(spark):  # only the summaries stay: at most MAX_SETTINGS rows
                rows = evaluated(docs, qa, first, settings, make(first) if make else None, embedder(first) if embedder else None, cache, vectors, record, calls)
                found = summarise(rows, by=["setting"]).join(context_diagnostics(rows, by=["setting"]), "setting").withColumnRenamed("setting", "seq")
                kept, schema = found.collect(), found.schema
            names = spark.createDataFrame([(seq, e.name, "SUCCESS", None, time.monotonic() - began) for seq, e in own], "seq int, name string, status string, error string, total_evaluation_time double")
            part = spark.createDataFrame(kept, schema).join(F.broadcast(names), "seq")  # at most MAX_SETTINGS rows
        except Exception as error:  # noqa: BLE001 - isolation is the feature
            part = spark.createDataFrame([(seq, e.name, "FAILED", str(error)[:500]) for seq, e in own], "seq int, name string, status string, error string")
        out = part if out is None else all_results(out, part)
    return out


def evaluated(docs: DataFrame, qa: DataFrame, e: Experiment, settings: list[Setting], make, embedder, cache, vectors, record, calls) -> DataFrame:
    """Evaluated rows of one group, written once."""
    asked = prepare.seeded_sample(qa, e.subset) if e.subset else qa
    chunks = indexed(docs, e, embedder, cache, vectors)
    questions = question_vectors(asked.select(F.col("qa_seq").alias("q_id"), "question"), embedder, vectors)
    how = {} if e.retrieval.type != "hybrid" else {"weight": e.retrieval.vector_weight, "word_weight": e.retrieval.keyword_weight}
    rows = grid_answers(questions, chunks, settings, make, method=e.retrieval.type, record=record, calls=calls, **how)
    rows = rows.join(asked.select(F.col("qa_seq").alias("q_id"), F.col("ground_truth").alias("expected")), "q_id")
    return measured(rows.withColumn("query_time", F.col("seconds")), e.metrics)
