"""Answer generation behind one protocol, and the question-to-answer plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators import context as C
from lodestrata.operators import retrieval as R
from lodestrata.operators.calls import Calls, Model, Record, called
from lodestrata.operators.models import settings_of

def generate(prompts: Column, make: Callable[[], Model], calls: Calls | None = None) -> Column:
    """struct(answer, error, seconds, tries). The client is made once in each task; every prompt is asked by itself, so one that fails is one error."""
    c = called(prompts, make, "string", calls=calls)
    return F.struct(c["value"].alias("answer"), c["error"].alias("error"), c["seconds"].alias("seconds"), c["tries"].alias("tries"))


def replies(rows: DataFrame, prompt: Column, make: Callable[[], Model], record: Record | None = None, settings: dict | None = None, calls: Calls | None = None) -> DataFrame:
    """``rows`` with ``reply``, a struct (answer, error, seconds, tries). With a ``record`` equal prompts are asked once, and not again by a later run with
    the same ``settings``, which default to the model's own."""
    if record is None:
        return rows.withColumn("reply", generate(prompt, make, calls))
    own = settings_of(make()) if settings is None else settings
    found = record.answer(rows.withColumn("_prompt", prompt), "_prompt", make, own, calls=calls).drop("_prompt")
    return found.withColumn("reply", F.struct(F.col("reply.value").alias("answer"), "reply.error", "reply.seconds", "reply.tries"))


def extractive(best_chunk: Column) -> Column:
    """Offline stand-in: the best chunk is the answer."""
    return F.struct(F.coalesce(best_chunk, F.lit("")).alias("answer"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("seconds"))


def answer(questions: DataFrame, chunks: DataFrame, *, k: int = 5, threshold: float = 0.0, budget: int = 4000, make: Callable[[], Model] | None = None, method: str = "vector-similarity", with_context: bool = True, record: Record | None = None, settings: dict | None = None, calls: Calls | None = None, **how) -> DataFrame:
    """All questions at once: retrieve, assemble the context, generate. questions (q_id, question, q_vec), chunks (chunk_seq, text, vec). ``how`` are the weights of
    hybrid retrieval. Without ``with_context`` the bare question is asked. With a ``record`` no prompt is asked twice."""
    hits = R.vector_top_k(questions, chunks, k, threshold) if method == "vector-similarity" else R.method(method)(questions, chunks, k, **how)
    contexts = C.assemble(hits, budget)
    rows = questions.select("q_id", "question").join(contexts, "q_id", "left")
    rows = rows.withColumns({"context": F.coalesce("context", F.lit("")), "chunks": F.coalesce("chunks", F.array().cast("array<string>"))})
    rows = rows.withColumn("prompt", C.prompt(F.col("context") if with_context else F.lit(""), F.col("question")))
    return answered(rows, make, record, settings, calls)


def answered(rows: DataFrame, make: Callable[[], Model] | None = None, record: Record | None = None, settings: dict | None = None, calls: Calls | None = None) -> DataFrame:
    """Rows of (prompt, chunks) with actual, error and seconds; without a model the best chunk is the answer."""
    rows = rows.withColumn("reply", extractive(F.get("chunks", F.lit(0)))) if make is None else replies(rows, F.col("prompt"), make, record, settings, calls)
    return rows.withColumns({"actual": F.col("reply.answer"), "error": F.col("reply.error"), "seconds": F.col("reply.seconds")}).drop("reply")


def index(docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], dim: int = 64, *, embedder=None, cache=None, config: dict | None = None, vectors: Record | None = None) -> DataFrame:
    """Chunks with running numbers and vectors: written once and read again, as every later step reads them more than once.

    ``embedder``: an embedding model, else the offline one of ``dim`` numbers. With a ``cache`` (``sinks.TableCache``) the table is kept under
    ``config``, the embedder's settings and a fingerprint of the documents, and found there the next time. With a record of ``vectors`` a text that any index
    held before is not embedded again. Without a vector for every chunk there is no index: that raises, and nothing is kept but the record.
    """
    from lodestrata.operators.chunking import with_global_ids
    from lodestrata.operators.models import HashingEmbedding, embed, embedded
    from lodestrata.sources.sinks import fingerprint
    from lodestrata.sources.tables import materialise

    model = HashingEmbedding(dim) if embedder is None else embedder

    def make() -> DataFrame:
        chunks = materialise(docs.sparkSession, chunk(docs), "chunks")
        rows = with_global_ids(chunks).select(F.col("chunk_no").alias("chunk_seq"), "chunk_id", "doc_seq", "text")
        if vectors is None:
            return rows.withColumn("vec", V.hashing_embedding(F.col("text"), dim) if embedder is None else embed(F.col("text"), embedder))
        rows = embedded(rows, "text", model, vectors)
        failed = F.concat(F.lit("no vector: "), F.col("vec_error"))
        return rows.withColumn("vec", F.when(F.col("vec_error").isNull(), F.col("vec")).otherwise(F.raise_error(failed).cast("array<double>"))).drop("vec_error")

    if cache is None:
        return materialise(docs.sparkSession, make(), "index")
    key = {**(config or {}), "embedder": settings_of(model), "documents": fingerprint(docs)}
    return cache.get("index", key, make)
