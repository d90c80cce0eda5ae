"""Benchmark decontamination with an FM-index per training shard.

A shard is a block of documents of one partition. Its text is a string over word numbers: words that no test
phrase holds cannot be part of a hit and only separate, so the shard's string is made of the stretches between
them that are long enough for a phrase, each ended by the separator 0. The suffixes are sorted by prefix
doubling, and the Burrows-Wheeler transform is kept as a wavelet tree of bit vectors with running ranks.
All windows of the test phrases run through backward search at once, one word per step; a window whose range
becomes empty drops out. The positions of a range come from the sampled suffix positions, reached by walking the
last-to-first mapping, and the hit spans of a document are merged.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``width`` consecutive words of
an item; an item of fewer words, but not none, is one window. Null and empty texts have no words and no hits.
A null ``doc_id`` is an ordinary row. Repeated documents each get their row; repeated items, and items sharing a
window, are each counted. The text of an item with a null id makes hit words like any other, but has no name to list among a document's items.
Without items every document is clean. Only the id and text columns are read, so
further columns of any name do no harm.

The test phrases are broadcast in blocks of at most ``max_words`` words, one pass over the documents for
each block, so what is broadcast is bounded however large the test set grows. For several blocks the documents are written
once with a row number, by which the blocks' hits are merged, so each row keeps its own result here too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import ascii_lower, blocks, free_name, keep_rows, materialise, small_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same words before lower-casing.
CASED = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WIDTH = 13
MAX_WORDS = 4_000_000
SAMPLE = 8
CACHE = 1_000_000
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64())))])
OUT_DDL = "doc_id bigint, n_words bigint, items array<string>, spans array<array<bigint>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text)) if text else []


class WaveletTree:
    """Ranks over a string of numbers: one stably partitioned bit vector per binary digit, highest digit first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        row = symbols
        for level in range(bits - 1, -1, -1):
            bit = (row >> level) & 1
            ones = np.zeros(len(row) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(row) - int(ones[-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the position ``upto``; ``start`` is the symbol's first place in the last level."""
        at = upto
        for k in range(self.bits):
            ones, bit = self.ones[k], (symbol >> (self.bits - 1 - k)) & 1
            before = ones[at]
            at = np.where(bit == 1, self.zeros[k] + before, at - before)
        return at - start[symbol]

    def starts(self, n_symbols: int) -> np.ndarray:
        """Where each symbol's run begins in the last level: the place that position 0 reaches for it."""
        symbol, at = np.arange(n_symbols), np.zeros(n_symbols, np.int64)
        for k in range(self.bits):
            before = self.ones[k][at]
            at = np.where((symbol >> (self.bits - 1 - k)) & 1 == 1, self.zeros[k] + before, at - before)
        return at


class FMIndex:
    """Self-index of one shard's string; ``text`` ends with a symbol 0 and uses 1..n_symbols-1 elsewhere, 0 as separator."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        self.n = len(text)
        suffixes = sort_suffixes(text)
        before = text[suffixes - 1]
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.tree = WaveletTree(before, self.bits)
        self.runs = self.tree.starts(n_symbols)
        self.first = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols), out=self.first[1:])
        self.before = before
        kept = (suffixes % sample == 0) | (before == 0)  # a walk never passes a separator, whose order is that of the text
        self.marks = np.zeros(self.n + 1, np.int64)
        np.cumsum(kept, out=self.marks[1:])
        self.samples = suffixes[kept]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, row, self.runs)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns (left-aligned rows of ``patterns``), empty where low == high."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.flatnonzero(lengths > 0)
        high[lengths == 0] = 0
        done = np.zeros(len(patterns), np.int64)
        while len(alive):
            symbol = patterns[alive, lengths[alive] - 1 - done[alive]]
            low[alive], high[alive] = self.step(symbol, low[alive]), self.step(symbol, high[alive])
            done[alive] += 1
            alive = alive[(low[alive] < high[alive]) & (done[alive] < lengths[alive])]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back until a sampled position is met."""
        where, walked, left = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            hit = self.marks[rows[left] + 1] > self.marks[rows[left]]
            done = left[hit]
            where[done] = self.samples[self.marks[rows[done]]] + walked[done]
            left = left[~hit]
            rows[left] = self.step(self.before[rows[left]], rows[left])
            walked[left] += 1
        return where


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """Start positions of the sorted suffixes, by prefix doubling; a separator counts as smaller than all else and, at
    equal prefixes, the earlier one as the smaller, so every comparison ends at a separator."""
    n = len(text)
    stops = np.cumsum(text == 0)
    rank = np.where(text == 0, stops - 1, text.astype(np.int64) + stops[-1])
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    rank = np.empty(n, np.int64)
    heads = np.concatenate([[True], key[1:] != key[:-1]])
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    step = 1
    tied = _tied(heads)
    while len(tied):
        at = order[tied]
        key = rank[at] * n + rank[(at + step) % n]
        by = np.argsort(key, kind="stable")
        order[tied] = at[by]
        key = key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        heads[tied] = fresh | heads[tied]
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        tied = _tied(heads)
        step *= 2
    return order


def _tied(heads: np.ndarray) -> np.ndarray:
    """Places of the order that share their rank with a neighbour."""
    alone = heads & np.concatenate([heads[1:], [True]])
    return np.flatnonzero(~alone)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Union of half-open spans, sorted."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


class Numbers(dict):
    """Number of each word as it is written, looked up in lower case; 0 for a word that no phrase holds."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __reduce__(self):
        return Numbers, (self.number,)

    def __missing__(self, word: str) -> int:
        found = self.number.get(ascii_lower(word), 0)
        self[word] = found
        return found


class Phrases:
    """Windows of test phrases over their own word numbers (from 1)."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.number: dict[str, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                named = found.setdefault(tuple(ids[k : k + width]), set())
                if item is not None:
                    named.add(item)
        self.items = [sorted(v) for v in found.values()]
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), width), np.int64)
        for row, w in enumerate(found):
            self.patterns[row, : len(w)] = w
        self.seen = Numbers(self.number)
        self.shortest = int(self.lengths.min()) if found else 0


def scan_shard(ids: list, texts: list[str | None], phrases: Phrases) -> pa.RecordBatch:
    """Hits of all phrases in one shard, merged by document."""
    number = phrases.seen.__getitem__
    counts, parts = [], []
    for text in texts:
        words = CASED.findall(text) if text else []
        counts.append(len(words))
        parts.append(np.fromiter(map(number, words), np.int64, len(words)))
    if len(phrases.seen) > CACHE:
        phrases.seen.clear()
    n_words = np.array(counts, np.int64)
    base = np.concatenate([[0], np.cumsum(n_words)])
    items: list[list[str]] = [[] for _ in ids]
    spans: list[list[list[int]]] = [[] for _ in ids]
    if phrases.shortest and base[-1]:
        flat = np.concatenate(parts)
        edges = np.zeros(len(flat) + 1, bool)
        edges[base] = True
        known = flat > 0
        opens = known & (edges[:-1] | ~np.concatenate([[False], known[:-1]]))
        closes = known & (edges[1:] | ~np.concatenate([known[1:], [False]]))
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long = ends - starts >= phrases.shortest
        starts, ends = starts[long], ends[long]
        if len(starts):
            size = ends - starts + 1
            at = np.concatenate([[0], np.cumsum(size)])
            shift = np.repeat(starts - at[:-1], size)
            source = np.arange(at[-1]) + shift
            text = np.where(np.isin(np.arange(at[-1]), at[1:] - 1, assume_unique=True), 0, flat[np.minimum(source, len(flat) - 1)])
            index = FMIndex(text, len(phrases.number) + 1)
            low, high = index.search(phrases.patterns, phrases.lengths)
            hit = np.flatnonzero(high > low)
            times = high[hit] - low[hit]
            window = np.repeat(hit, times)
            rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[hit], times)
            place = source[index.locate(rows)]
            doc = np.searchsorted(base, place, side="right") - 1
            order = np.argsort(doc, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
                d = int(doc[part[0]])
                begin = place[part] - base[d]
                spans[d] = merge_spans(begin, begin + phrases.lengths[window[part]])
                items[d] = sorted({x for w in np.unique(window[part]).tolist() for x in phrases.items[w]})
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(items, OUT.field("items").type), pa.array(spans, OUT.field("spans").type)], schema=OUT)


def phrase_blocks(benchmark: DataFrame, item: str, text: str, max_words: int) -> list[DataFrame]:
    """The test phrases in blocks of about ``max_words`` words; one block unless the set is large."""
    held = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"), F.coalesce(F.length(text), F.lit(0)).alias("chars"))
    total = held.agg(F.sum("chars")).first()[0] or 0
    n = max(1, -(-total // (2 * max_words)))
    return [held.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).drop("chars") for k in range(n)]


def collect_phrases(part: DataFrame, width: int) -> Phrases:
    """bounded: a block holds about ``max_words`` words."""
    return Phrases([(r["item"], r["text"]) for r in part.collect()], width)


def find_hits(docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, items (sorted ids of the items that occur) and spans (merged [begin, end) word spans)."""
    spark = docs.sparkSession
    small_batches(spark)
    held = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = phrase_blocks(benchmark, item, item_text, max_words)
    several = len(parts) > 1
    if several:
        # the row number must be the same in every pass, so the rows are written once
        held = materialise(spark, held.withColumn("row", F.monotonically_increasing_id()), "documents").select(F.struct("row", "doc_id").alias("key"), "text")
    found = []
    for part in parts:
        phrases = spark.sparkContext.broadcast(collect_phrases(part, width))

        def scan(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for ids, texts in blocks(batches):
                if several:
                    hits = scan_shard([k["doc_id"] for k in ids], texts, phrases.value)
                    yield pa.RecordBatch.from_arrays([pa.array([k["row"] for k in ids], pa.int64()), *hits.columns], ["row", *hits.schema.names])
                else:
                    yield scan_shard(ids, texts, phrases.value)

        hits = held.mapInArrow(scan, f"row bigint, {OUT_DDL}" if several else OUT_DDL)
        if not several:
            return hits
        # one block of phrases at a time: its hits are written, then it is dropped
        found.append(materialise(spark, hits.where(F.size("items") + F.size("spans") > 0 if found else F.lit(True)), "hits"))
        phrases.destroy()
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    joined = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), spans.alias("spans"))
    return joined.drop("row").withColumn("spans", union_spans(F.col("spans")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows that are not contaminated, with all their columns. One block of phrases is judged in the pass that reads the rows; for several the
    rows are written with a number, by which the contaminated ones leave."""
    spark = docs.sparkSession
    parts = phrase_blocks(benchmark, item, item_text, max_words)
    if len(parts) == 1:
        phrases = spark.sparkContext.broadcast(collect_phrases(parts[0], width))

        def start():
            def judge(texts: list[str | None]) -> list[bool]:
                found = scan_shard([None] * len(texts), texts, phrases.value)
                hits = [sum(b - a for a, b in spans) for spans in found.column("spans").to_pylist()]
                return [not contaminated(n, hit) for n, hit in zip(found.column("n_words").to_pylist(), hits, strict=True)]

            return judge

        return keep_rows(docs, start, text)
    row = free_name(docs.columns, "row")
    numbered = materialise(spark, docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = report(find_hits(numbered, benchmark, doc=row, text=text, item=item, item_text=item_text, width=width, max_words=max_words))
    return numbered.join(found.where("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def contaminated(n_words: int, n_hit: int) -> bool:
    """Hit words are at least one in twenty."""
    return n_hit > 0 and 20 * n_hit >= n_words


def union_spans(spans):
    """Union of sorted [begin, end) spans, as a column expression."""
    start = F.array().cast("array<array<bigint>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.get(span, 0) <= F.get(last, 1))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.get(last, 0), F.greatest(F.get(last, 1), F.get(span, 1)))))).otherwise(F.concat(done, F.array(span)))

    return F.when(F.size(spans) == 0, start).otherwise(F.aggregate(spans, start, add))


def report(hits: DataFrame) -> DataFrame:
    """The counts and the verdict of each document: hit words are at least one in twenty."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + F.get(s, 1) - F.get(s, 0))
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, str | None]], width: int = WIDTH) -> tuple[int, int, list[str]]:
    """Words, hit words and occurring items by plain scanning; for tests."""
    words = words_of(text)
    hit, found = set(), set()
    for item, body in items:
        own = words_of(body)
        for k in range(max(1, len(own) - width + 1) if own else 0):
            window = own[k : k + width]
            for p in range(len(words) - len(window) + 1):
                if words[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
