"""Chunking: fixed size, by paragraphs, recursive; and ids that run over all documents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import strip

RECURSIVE_SEPARATORS = ("\n\n", "\n", ". ", " ")


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and the overlap smaller than it")


def fixed_size(docs: DataFrame, size: int = 1000, overlap: int = 200, *, seq: str = "doc_seq", text: str = "text") -> DataFrame:
    """(doc_seq, chunk_seq, text, start_pos, end_pos, overlap). A chunk starts at every multiple of size - overlap inside the text, so a
    last chunk may hold only what the one before it ends with; end_pos is not cut to the text."""
    check_sizes(size, overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap)))
    rows = docs.select(F.col(seq).alias("doc_seq"), F.col(text).alias("_t"), F.posexplode(starts).alias("chunk_seq", "start_pos"))
    return rows.select("doc_seq", "chunk_seq", F.substr("_t", F.col("start_pos") + 1, F.lit(size)).alias("text"), "start_pos", (F.col("start_pos") + size).alias("end_pos"), F.when(F.col("chunk_seq") == 0, 0).otherwise(overlap).alias("overlap"))


def fold_paragraphs(text: Column, low: int, high: int, separator: str) -> Column:
    """Array of (text, paragraphs): paragraphs are added while the sum stays within ``high``; what is shorter than ``low`` is dropped. ``paragraphs`` is
    the index of the paragraph at which the chunk was closed."""
    parts = F.filter(F.transform(F.split(text, "\\Q" + separator + "\\E", -1), strip), lambda p: p != "")
    out_type = "array<struct<text:string,paragraphs:int>>"
    start = F.struct(F.array().cast(out_type).alias("out"), F.lit("").alias("cur"), F.lit(0).alias("at"))

    def closed(state: Column) -> Column:
        return F.when(F.length(state["cur"]) >= low, F.concat(state["out"], F.array(F.struct(state["cur"].alias("text"), state["at"].alias("paragraphs"))))).otherwise(state["out"])

    def add(state: Column, part: Column) -> Column:
        full = (F.length(state["cur"]) + F.length(part) > high) & (state["cur"] != "")
        joined = F.when(full | (state["cur"] == ""), part).otherwise(F.concat(state["cur"], F.lit("\n\n"), part))
        return F.struct(F.when(full, closed(state)).otherwise(state["out"]).alias("out"), joined.alias("cur"), (state["at"] + 1).alias("at"))

    return F.aggregate(parts, start, add, closed)


def semantic(docs: DataFrame, low: int = 500, high: int = 1500, separator: str = "\n\n", *, seq: str = "doc_seq", text: str = "text") -> DataFrame:
    folded = docs.select(F.col(seq).alias("doc_seq"), F.posexplode(fold_paragraphs(F.col(text), low, high, separator)).alias("chunk_seq", "c"))
    return folded.select("doc_seq", "chunk_seq", "c.text", "c.paragraphs", F.length("c.text").alias("chunk_size"))


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = RECURSIVE_SEPARATORS) -> list[str]:
    """Cut at the first separator that the text holds; pieces are packed up to ``size``, a new chunk begins with the last
    ``overlap`` characters of the one before, and a piece that is itself too long is cut further if nothing waits before it."""
    if len(text) <= size:
        return [text]
    mark = next((s for s in separators if s in text), None)
    if mark is None:
        return [text[k : k + size] for k in range(0, len(text), size - overlap)]
    done: list[str] = []
    held = ""
    for piece in text.split(mark):
        longer = f"{held}{mark}{piece}" if held else piece
        if len(longer) <= size:
            held = longer
        elif held:
            done.append(held)
            held = f"{held[-overlap:]}{mark}{piece}" if 0 < overlap < len(held) else piece
        elif len(piece) > size:
            done += split_recursive(piece, size, overlap, separators)
        else:
            held = piece
    return [*done, held] if held else done


def recursive(docs: DataFrame, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = RECURSIVE_SEPARATORS, *, seq: str = "doc_seq", text: str = "text") -> DataFrame:
    """The depth of the recursion depends on the data, so this runs in Python on Arrow batches. Blank chunks are dropped, the others stripped; ``chunk_size`` is
    the length before that."""
    check_sizes(size, overlap)

    @F.pandas_udf("array<struct<text:string,size:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": c.strip(), "size": len(c)} for c in split_recursive(t, size, overlap, separators) if c.strip()] if t else [])

    rows = docs.select(F.col(seq).alias("doc_seq"), F.posexplode(cut(F.col(text))).alias("chunk_seq", "c"))
    return rows.select("doc_seq", "chunk_seq", "c.text", F.col("c.size").alias("chunk_size"))


def with_global_ids(chunks: DataFrame, prefix: str = "chunk_") -> DataFrame:
    """chunk_no over all documents: chunks of earlier documents plus the place in its own. Only one row for each document is
    summed in order: first within ranges of documents, then over the ranges."""
    sizes = chunks.groupBy("doc_seq").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("doc_seq") / 10_000))
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("m"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("range", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("earlier"))
    inner = Window.partitionBy("range").orderBy("doc_seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(before, "range").select("doc_seq", (F.col("earlier") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("first"))
    rows = chunks.join(offsets, "doc_seq").withColumn("chunk_no", F.col("first") + F.col("chunk_seq")).drop("first")
    return rows.withColumn("chunk_id", F.concat(F.lit(prefix), F.col("chunk_no").cast("string")))


class Chunker(Protocol):
    """Takes documents (doc_seq, text), a size and an overlap, and gives chunks (doc_seq, chunk_seq from 0, text, and what else it knows)."""

    def __call__(self, docs: DataFrame, size: int, overlap: int) -> DataFrame: ...


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"fixedsize": fixed_size, "fixed-size": fixed_size, "semantic": semantic, "recursive": recursive}


def register(kind: str, own: Chunker) -> None:
    """Make a chunker known under a name of its own, which settings can then give as their type."""
    if kind in CHUNKERS:
        raise ValueError(f"there is a chunking type {kind}")
    CHUNKERS[kind] = own


def chunker(kind: str) -> Callable[..., DataFrame]:
    if kind not in CHUNKERS:
        raise ValueError(f"unknown chunking type: {kind}")
    return CHUNKERS[kind]
