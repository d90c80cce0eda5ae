"""Streaming ingest: new document files change a versioned index, or are chunked and appended to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.chunking import fixed_size
from lodestrata.sources.versions import VersionedIndex


def index_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Reads files as they arrive, chunks them without state, and appends; what is there already is taken and then it stops. Each
    batch writes to a folder of its own number, so a batch that is repeated after a failure replaces itself."""
    make = chunk or (lambda d: fixed_size(d, seq="doc_id"))

    def add(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(index: VersionedIndex, source: str, checkpoint: str, name: str = "stream", *, files: int | None = None) -> StreamingQuery:
    """Takes change files (seq, doc_seq, text, deleted) into a versioned index as they arrive, each batch as one version; of the changes of a document in a batch the one
    with the largest ``seq`` counts. The version carries the batch's number under ``name``, so a batch that is repeated after a failure changes nothing."""

    def take(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("doc_seq").agg(F.max_by(F.struct("text", F.coalesce("deleted", F.lit(False)).alias("deleted")), "seq").alias("c"))
        last = last.select("doc_seq", "c.text", "c.deleted")
        index.write(last.where("not deleted").select("doc_seq", "text"), last.where("deleted").select("doc_seq"), stamps={name: number}, tries=5)

    stream = index.spark.readStream.schema("seq long, doc_seq long, text string, deleted boolean")
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    return stream.parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
