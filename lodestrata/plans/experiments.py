"""Evaluation runs, parameter grids and comparisons."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterable
from itertools import product

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import metrics as M
from lodestrata.functions import vectors as V
from lodestrata.operators import chunking, generate, prepare
from lodestrata.operators.calls import Calls, Record
from lodestrata.operators.models import embed, embedded
from lodestrata.plans.config import Experiment
from lodestrata.plans.summary import context_diagnostics, summarise
from lodestrata.sources import sinks
from lodestrata.sources.tables import materialise, scope


def chunk_documents(docs: DataFrame, e: Experiment) -> DataFrame:
    c = e.chunking
    if c.type == "semantic":
        return chunking.semantic(docs, c.min_chunk_size, c.max_chunk_size, c.separator)
    return chunking.chunker(c.type)(docs, c.chunk_size, c.chunk_overlap)


def indexed(docs: DataFrame, e: Experiment, embedder=None, cache=None, vectors: Record | None = None) -> DataFrame:
    """The index of an experiment; with a cache it is shared by all that chunk and embed alike, with a record of vectors the texts that are alike are."""
    c = e.chunking
    return generate.index(docs, lambda d: chunk_documents(d, e), embedder=embedder, cache=cache, config={**c.__dict__}, vectors=vectors)


def question_vectors(questions: DataFrame, embedder=None, vectors: Record | None = None) -> DataFrame:
    """Questions with q_vec. With a record a question that cannot be embedded has a null vector, and so no similar chunk; without one that raises."""
    if embedder is None:
        return questions.withColumn("q_vec", V.hashing_embedding(F.col("question")))
    if vectors is None:
        return questions.withColumn("q_vec", embed(F.col("question"), embedder))
    return embedded(questions, "question", embedder, vectors, name="q_vec").drop("q_vec_error")


def evaluate(docs: DataFrame, qa: DataFrame, e: Experiment, make: Callable | None = None, *, embedder=None, cache=None, vectors: Record | None = None, record: Record | None = None, calls: Calls | None = None) -> DataFrame:
    """Evaluated rows of one experiment, all questions in one plan, written once. docs (doc_seq, text), qa (qa_seq, question, ground_truth).
    ``make`` gives the language model, ``embedder`` is the embedding model of chunks and questions; without them the offline stand-ins answer."""
    asked = prepare.seeded_sample(qa, e.subset) if e.subset else qa
    chunks = indexed(docs, e, embedder, cache, vectors)
    questions = question_vectors(asked.select(F.col("qa_seq").alias("q_id"), "question"), embedder, vectors)
    r = e.retrieval
    how = {} if r.type != "hybrid" else {"weight": r.vector_weight, "word_weight": r.keyword_weight}
    answers = generate.answer(questions, chunks, k=r.k, threshold=r.similarity_threshold, budget=e.max_context_length, make=make, method=r.type, with_context=e.include_context, record=record, calls=calls, **how)
    rows = answers.join(asked.select(F.col("qa_seq").alias("q_id"), F.col("ground_truth").alias("expected")), "q_id")
    return measured(rows.withColumn("query_time", F.col("seconds")), e.metrics)


def measured(rows: DataFrame, families: Iterable[str]) -> DataFrame:
    """The rows with the metrics of the families, written once. Where that fails in a task, the rows are written and each family is tried by itself: one that fails is left out with a
    warning, and the others still are there."""
    spark, families = rows.sparkSession, list(families)
    try:
        return materialise(spark, M.evaluate(rows, families), "evaluated")
    except PySparkException:
        out = materialise(spark, rows, "answers")
        for name in (n for n in M.FAMILIES if n in families):
            try:
                out = materialise(spark, M.evaluate(out, [name]), "evaluated")
            except PySparkException as error:
                warnings.warn(f"metrics of the family {name} are left out: {str(error)[:500]}", stacklevel=2)
        return out


def pipeline_info(docs: DataFrame, e: Experiment, llm=None, embedder=None, chunks: DataFrame | None = None) -> dict:
    """What an experiment runs: models, chunking, retrieval, limits, and the documents it was given."""
    c, r = e.chunking, e.retrieval
    grouped = F.coalesce(F.bool_or("grouped"), F.lit(False)) if "grouped" in docs.columns else F.lit(False)
    seen = docs.agg(F.count("*").alias("n"), grouped.alias("grouped")).first()
    return {
        "llm": llm.info() if llm is not None else {"name": "extractive", "provider": "offline", "model": e.llm.model},
        "embedding": embedder.info() if embedder is not None else {"name": "hashing", "provider": "offline", "model": e.embedding.model},
        "chunking": {"name": f"{c.type}chunking", "strategy": "variable" if c.type == "semantic" else str(c.chunk_size), "chunk_size": None if c.type == "semantic" else str(c.chunk_size), "chunk_overlap": None if c.type == "semantic" else c.chunk_overlap, "separator": c.separator},
        "retrieval": {"name": r.type, "top_k": r.k, "similarity_threshold": r.similarity_threshold, "chunks_indexed": chunks.count() if chunks is not None else None},
        "pipeline": {"max_context_length": e.max_context_length, "include_context": e.include_context},
        "is_indexed": chunks is not None,
        "dataset": {"documents_processed": seen["n"], "grouping_applied": seen["grouped"]},
    }


def run(docs: DataFrame, qa: DataFrame, e: Experiment, make: Callable | None = None, *, llm=None, embedder=None, cache=None, folder: str | None = None, vectors: Record | None = None, record: Record | None = None, calls: Calls | None = None) -> DataFrame:
    """One summary row, with the experiment's name, status and wall time. With a ``folder``, details and the nested summary are written there."""
    with scope(docs.sparkSession):  # an index without a cache, hits and evaluated rows go with the run
        return _run(docs, qa, e, make, llm, embedder, cache, folder, vectors, record, calls)


def _run(docs, qa, e, make, llm, embedder, cache, folder, vectors, record, calls) -> DataFrame:
    began = time.monotonic()
    spark = docs.sparkSession
    rows = evaluate(docs, qa, e, make or (None if llm is None else lambda: llm), embedder=embedder, cache=cache, vectors=vectors, record=record, calls=calls)
    tables = summarise(rows), context_diagnostics(rows)
    flat, diagnostics = (t.first().asDict() for t in tables)
    took = time.monotonic() - began
    if folder:
        info = {k: v for k, v in M.evaluation_info(list(e.metrics)).items() if k != "metrics"}
        nested = {**flat, "pipeline_info": pipeline_info(docs, e, llm, embedder, indexed(docs, e, embedder, cache) if cache else None), "context_optimization": diagnostics, "evaluation_info": info, "total_evaluation_time": took, "random_seed": 42}
        sinks.write_results(rows, nested, folder, e.name)
    found = {**flat, **diagnostics}
    types = ", ".join(f"{c} {t}" for own in tables for c, t in own.dtypes)
    return spark.createDataFrame([(e.name, "SUCCESS", took, *found.values())], f"name string, status string, total_evaluation_time double, {types}")


def compare(docs: DataFrame, qa: DataFrame, experiments: Iterable[Experiment], make: Callable | None = None, clients: Callable[[Experiment], tuple] | None = None, **given) -> DataFrame:
    """Summaries of all experiments by name; one that fails becomes a row with its error and does not stop the others."""
    spark = docs.sparkSession
    out = None
    for k, e in enumerate(experiments):
        try:
            llm, embedder = clients(e) if clients else (None, None)
            row = run(docs, qa, e, make, llm=llm, embedder=embedder, **given)
        except Exception as error:  # noqa: BLE001 - isolation is the feature
            row = spark.createDataFrame([(e.name, "FAILED", str(error)[:500])], ["name", "status", "error"])
        row = row.withColumn("seq", F.lit(k))
        out = row if out is None else all_results(out, row)
    return out


def all_results(*tables: DataFrame) -> DataFrame:
    """Results that succeeded and results that failed as one table; what a table does not have is null."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def run_missing(docs: DataFrame, qa: DataFrame, experiments: Iterable[Experiment], folder: str, **given) -> list[str]:
    """Runs the experiments of a grid whose summary is not in ``folder`` yet, one index for all that chunk alike; returns the names of those that ran.
    One that fails does not stop the others."""
    spark = docs.sparkSession
    done = sinks.names_in(spark, folder)
    cache = sinks.TableCache(spark, f"{folder}/cache")
    ran = []
    for e in experiments:
        if not any(x.startswith(f"{e.name}_evaluation_summary_") for x in done):
            try:
                run(docs, qa, e, folder=folder, cache=cache, **given)
                ran.append(e.name)
            except Exception as error:  # noqa: BLE001 - isolation is the feature
                sinks.put_text(spark, f"{folder}/{e.name}_failed.txt", str(error))
    return ran


def overlap_of(size: int, share: float = 0.15) -> int:
    return max(0, min(size - 1, round(size * share)))


def run_name(base: str, kind: str, size: int | None, k: int, threshold: float, model: str, grouping: bool) -> str:
    """Every axis is part of the name, so no two runs of a grid share one."""
    return "_".join([base, kind, *([str(size)] if size else []), f"k{k}", f"s{round(100 * threshold):02d}", model, *(["grouped"] if grouping else [])])


def retrieval_grid(base: Experiment, kinds=("fixedsize", "recursive", "semantic"), sizes=(1200, 1800, 2000), ks=(3, 5, 7), thresholds=(0.0, 0.1), groupings=(True,)) -> list[Experiment]:
    out = []
    for kind, grouping, k, threshold in product(kinds, groupings, ks, thresholds):
        for size in (None,) if kind == "semantic" else sizes:
            own = base.chunking.__class__(type=kind, chunk_size=size or 1000, chunk_overlap=overlap_of(size) if size else 0, separator=base.chunking.separator)
            retrieval = base.retrieval.__class__(base.retrieval.type, k, threshold)
            out.append(base.with_(name=run_name(base.name, kind, size, k, threshold, base.embedding.abbr or "emb", grouping), chunking=own, retrieval=retrieval, grouping=grouping))
    return out


def llm_grid(base: Experiment, models: Iterable[str], temperatures: Iterable[float] | None = None) -> list[Experiment]:
    from dataclasses import replace

    out = []
    for model in models:
        for t in temperatures or (None,):
            llm = replace(base.llm, model=model, **({} if t is None else {"temperature": t}))
            name = f"{base.name}_{model.replace(':', '-').replace('/', '-')}" + ("" if t is None else f"_t{round(100 * t):02d}")
            out.append(base.with_(name=name, llm=llm))
    return out


def grid_frame(spark: SparkSession, kinds: list[str], sizes: list[int], ks: list[int], thresholds: list[float]) -> DataFrame:
    """The grid as a table: sizes only for the kinds that have one."""
    col = lambda v, n, t: spark.range(1).select(F.explode(F.array(*map(F.lit, v)).cast(f"array<{t}>")).alias(n))
    kind, size = col(kinds, "chunking_type", "string"), col(sizes, "chunk_size", "int")
    sized = kind.where("chunking_type <> 'semantic'").crossJoin(size).unionByName(kind.where("chunking_type = 'semantic'").withColumn("chunk_size", F.lit(None).cast("int")))
    return sized.crossJoin(col(ks, "top_k", "int")).crossJoin(col(thresholds, "similarity_threshold", "double")).withColumn("chunk_overlap", F.least(F.col("chunk_size") - 1, F.bround(F.col("chunk_size") * F.lit(0.15), 0).cast("int")))


def still_to_run(grid: DataFrame, done: DataFrame, name: str = "run_name") -> DataFrame:
    return grid.join(done.select(name).distinct(), name, "left_anti")
