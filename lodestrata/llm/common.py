"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.tables import materialise, remove, shared_dir

__all__ = ["ascii_lower", "blocks", "documents", "free_name", "hold_memory", "id_bucket", "keep_rows", "materialise", "release", "remove", "sha256_hex", "shared_dir", "small_batches", "whole_rows"]

#: Code points that one vectorised block of texts holds at most (a single longer text forms its own block).
BLOCK_CHARS = 6_000_000
#: Rows of one Arrow transfer; with texts of a few KB a transfer stays at a few MB.
ARROW_ROWS = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_bucket(col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(col.cast("string")) % F.lit(n)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow transfer, so that a run of long texts stays small in the Python worker."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def release() -> None:
    """Give memory that a task has freed back to the system, as the worker lives on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def hold_memory() -> None:
    """Set the allocator's thresholds (glibc: M_MMAP_THRESHOLD, M_TRIM_THRESHOLD) to the largest that it comes to by itself: arrays of a few MB that
    are made anew at every step are otherwise given back and faulted in each time, in a young worker. ``release`` gives them back at the end."""
    if hasattr(_LIBC, "mallopt"):
        _LIBC.mallopt(-3, 32 << 20)
        _LIBC.mallopt(-1, 64 << 20)


_LIBC = ctypes.CDLL(None)


def blocks(batches: Iterable[pa.RecordBatch], max_chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str | None]]]:
    """(first column, second column) of whole rows, cut into blocks of bounded text."""
    ids: list = []
    texts: list[str | None] = []
    held = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(key)
            texts.append(text)
            held += len(text) if text else 0
            if held >= max_chars:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
    del ids, texts
    release()


def whole_rows(batches: Iterable[pa.RecordBatch], text: str, max_chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.Table, list[str | None]]]:
    """(rows with all their columns, their texts), cut into blocks of bounded text."""
    parts: list[pa.RecordBatch] = []
    texts: list[str | None] = []
    held = 0
    for batch in batches:
        own, start = batch.column(batch.schema.get_field_index(text)).to_pylist(), 0
        for k, value in enumerate(own, 1):
            held += len(value) if value else 0
            if held >= max_chars or k == len(own):
                parts.append(batch.slice(start, k - start))
                texts += own[start:k]
                start = k
            if held >= max_chars:
                yield pa.Table.from_batches(parts), texts
                parts, texts, held = [], [], 0
    if texts:
        yield pa.Table.from_batches(parts), texts
    del parts, texts
    release()


def keep_rows(docs: DataFrame, keep: Callable[[], Callable[[list[str | None]], list[bool]]], text: str = "text", max_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows whose text ``keep`` wants, with all their columns, in the same pass: nothing is shuffled or joined, so null ids, repeated ids
    and further columns need no rule. ``keep`` is called once in each task and gives the judge of a list of texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = keep()
        for rows, texts in whole_rows(batches, text, max_chars):
            yield from rows.filter(pa.array(judge(texts), pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores before it as it takes to be no column's name."""
    while wanted.lower() in {c.lower() for c in taken}:
        wanted = f"_{wanted}"
    return wanted


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only; other letters stay as they are."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
