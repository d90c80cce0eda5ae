"""Resampling documents towards a target corpus by hashed word n-grams.

Texts are lower-cased (A-Z only) and cut into words; features are single words and pairs of neighbours, in buckets by CRC-32. The features of a task's rows are
found on the bytes of the Arrow buffer itself: a table of 256 entries says which bytes belong to words, differences of that give the
boundaries, and one table-driven CRC step at a time is taken for all words at once; a pair goes on from the state of its first word. From the counts of both
corpora each bucket has a gain, a document weighs the mean gain of its features, and Gumbel noise of a digest of its id makes the ``percent`` best scores a
sample without replacement.

A word beyond ``LONG`` bytes is finished by the library's CRC, one at a time. Blocks hold ``BLOCK`` bytes; a longer text is cut between words into parts of that size,
each of which begins with the last word of the one before it, so pairs are whole. Counts leave a task as one row for each bucket. The rank is taken among
documents of one score, of which there are a bounded number, after the counts of higher scores.

A null or empty text has no features and weighs 0. A null id enters the digest as empty text, and comes before all other ids in a tie. Rows that repeat an id and a
text have ranks of their own, one after the other. Further columns are not read; an empty table gives an empty one, and an empty target is
a target without counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise, release, small_batches
from lodestrata.llm.order import distinct_rows, running, spread

BUCKETS = 10_000
MAX_BUCKETS = 1_048_576
BLOCK = 3_000_000
LONG = 64
IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
WEIGHED_DDL = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"


def crc_table() -> np.ndarray:
    """State changes of the reflected CRC-32 by byte."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state.astype(np.uint32)


TABLE = crc_table()


def advance(state: np.ndarray, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The states after ``sizes`` bytes from ``begins`` on, a step for all words that still have one."""
    order = np.argsort(-np.minimum(sizes, LONG + 1).astype(np.int16), kind="stable")
    state, at = state[order], begins[order].copy()
    alive = len(order) - np.cumsum(np.bincount(np.minimum(sizes, LONG), minlength=LONG + 1))
    for step in range(LONG):
        n = int(alive[step])
        if not n:
            break
        state[:n] = TABLE[(state[:n] ^ data[at[:n]]) & 0xFF] ^ (state[:n] >> 8)
        at[:n] += 1
    out = np.empty_like(state)
    out[order] = state
    for k in np.flatnonzero(sizes > LONG).tolist():
        rest = data[begins[k] + LONG : begins[k] + sizes[k]].tobytes()
        out[k] = zlib.crc32(rest, int(~out[k])) ^ 0xFFFFFFFF
    return out


class Features:
    """The features of a run of texts: their buckets, and the text of each."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, repeated: np.ndarray, buckets: int):
        """``data`` are the texts' bytes end to end between ``edges``; of a text in ``repeated`` the first word was counted before."""
        inside = IS_WORD[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[edges] = True
        changed = inside[1:] != inside[:-1]
        begins = np.flatnonzero(inside & (np.concatenate([[True], changed]) | cut[:-1]))
        ends = np.flatnonzero(inside & (np.concatenate([changed, [True]]) | cut[1:])) + 1
        low, sizes = LOWER[data], ends - begins
        owner = np.searchsorted(edges, begins, side="right") - 1
        first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        one = advance(np.full(len(begins), 0xFFFFFFFF, np.uint32), low, begins, sizes)
        single = ~(first & repeated[owner])
        pair = np.flatnonzero(~first)
        spaced = one[pair - 1]
        spaced = TABLE[(spaced ^ 0x20) & 0xFF] ^ (spaced >> 8)
        two = advance(spaced, low, begins[pair], sizes[pair])
        self.words = np.bincount(owner[single], minlength=len(edges) - 1)
        self.bucket = ((~np.concatenate([one[single], two])) % np.uint32(buckets)).astype(np.int64)
        self.owner = np.concatenate([owner[single], owner[pair]])


def parts(size: int, data: np.ndarray, block: int) -> list[tuple[int, int, bool]]:
    """A text's bytes as parts (from, to, first word is a repeat) of about ``block``, cut after a word, from the begin of that word on."""
    out, at = [], 0
    while size - at > block:
        inside = IS_WORD[data[at : at + block]]
        gap = np.flatnonzero(~inside)
        stop = int(gap[-1]) + at if len(gap) else 0
        begin = stop
        while begin > at and not IS_WORD[data[begin - 1]]:
            begin -= 1
        end = begin
        while begin > at and IS_WORD[data[begin - 1]]:
            begin -= 1
        if begin <= at:  # one word, or none, fills the part: the part is made longer instead
            block *= 2
            continue
        out.append((at, end, bool(out)))
        at = begin
    return [*out, (at, size, bool(out))]


def features(batches: Iterator[pa.RecordBatch], buckets: int, block: int = BLOCK) -> Iterator[tuple[pa.Array, Features, np.ndarray]]:
    """(ids, features, row of each text) in blocks. The last column of a batch holds the texts. A row's parts follow one another in one block or several; its id
    is given with each."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        bounds = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        begins, ends = bounds[:-1], bounds[1:].copy()
        if texts.null_count:
            empty = np.asarray(texts.is_null())
            ends[empty] = begins[empty]
        cuts, total = [], 0
        for row, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            for a, b, again in parts(end - begin, data[begin:end], block) if end - begin > block else [(0, end - begin, False)]:
                cuts.append((row, begin + a, begin + b, again))
                total += b - a
                if total >= block:
                    yield from one_block(batch, data, cuts, buckets)
                    cuts, total = [], 0
        if cuts:
            yield from one_block(batch, data, cuts, buckets)
    release()


def one_block(batch: pa.RecordBatch, data: np.ndarray, cuts: list, buckets: int) -> Iterator[tuple[pa.Array, Features, np.ndarray]]:
    rows, begins, ends, again = (np.array(x) for x in zip(*cuts, strict=True))
    edges = np.concatenate([[0], np.cumsum(ends - begins)])
    own = data[begins[0] : ends[-1]] if (begins[1:] == ends[:-1]).all() else np.concatenate([data[a:b] for a, b in zip(begins, ends, strict=True)])
    yield batch.column(0), Features(own, edges, again, buckets), rows


def bucket_counts(docs: DataFrame, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for _, found, _ in features(batches, buckets):
            counts += np.bincount(found.bucket, minlength=buckets)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(counts[own], pa.int64())], ["bucket", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():  # at most ``buckets`` rows
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's smoothed shares in target and source."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + n)) / (float(s + 1) * float(t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row. ``gain`` has an entry for each bucket and travels with the plan."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros((3, batch.num_rows), np.int64)
            for _, found, rows in features(iter([batch]), len(gain)):
                n = len(rows)
                own = np.bincount(found.owner, weights=gain[found.bucket], minlength=n).astype(np.int64)  # whole numbers below 2^53: exact
                for k, part in enumerate((found.words, np.bincount(found.owner, minlength=n), own)):
                    np.add.at(total[k], rows, part)
            mean = np.where(total[1] > 0, total[2] // np.maximum(total[1], 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total[0]), pa.array(total[1]), pa.array(mean)], schema=WEIGHED)

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, WEIGHED_DDL)


def noise(doc: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, *, buckets: int = BUCKETS, seed: int = 7, doc: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; the rank of rows that are not drawn is null."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MAX_BUCKETS}")
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    weighed = weigh(docs, gain, doc=doc, text=text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = materialise(spark, weighed.withColumn("able", F.col("n_words") >= min_words).drop("n_words"), "importance")
    draw = rows.where("able").count() * percent // 100
    able = distinct_rows(rows.where("able")).withColumn("_below", -F.col("score"))
    able = spread(running(able, [], "_below", [F.col("doc_id").asc_nulls_first(), "n_features", "weight"], "copies", "_ahead"))
    place = F.col("_ahead") + F.col("copy") + 1
    drawn = able.withColumn("rank", F.when(place <= draw, place))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(out).unionByName(rows.where("not able").withColumn("rank", F.lit(None).cast("long")).select(out))
