"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

A document is a weighted set of shingles of five words (lower-cased, letters and digits only); the weight is how often a shingle
occurs. ProbMinHash: every shingle is a Poisson process whose rate is its weight; its arrivals fall on random registers, and a
register keeps the shingle that arrives first. Two documents agree in a register with the chance of their probability Jaccard similarity.
Arrivals are drawn in rounds for all shingles of a document together; a shingle stops once its next arrival is later than the latest register.
A document with repeated shingles has a second signature, with all weights 1, so that plain Jaccard similarity finds candidates as well.

1. Documents with equal word sequences collapse to the one with the smallest id.
2. Every band of ``ROWS`` registers is a bucket. In each bucket the row with the least hash leads. A document is compared by its
   signatures with the leaders of its buckets, and by its text with the one that agrees most: at most one pair for each document.
3. Verified links are contracted to classes by minimum labels. Buckets whose rows are of one class are done.
4. In each bucket left over, every row outside the bucket's largest class is compared with every row of another class, by signature, then,
   best first, by text; a verified link merges classes at once, so no more links than rows come back. A bucket of more than ``CELL_ROWS`` rows or
   ``CELL_BYTES`` of shingles is cut in parts by a hash of the id: a part of the rows outside the largest class and a part of all rows are a
   cell, so no bucket is dropped or capped, no task holds more than two parts, and a large class costs one copy of its rows for each part of the
   others. A pair that shares several buckets is compared in the one of the least number. The links are contracted once more.

Similarity is the larger of the probability Jaccard of the weighted and the Jaccard of the plain shingle sets; 0.8 links. At 0.8, a pair shares no bucket with
a chance of (1 - 0.8**5)**24, below 0.0001.

A text of fewer words than a shingle is one shingle of all its words; null texts, and texts without a word, are in no class but their own. Null
ids are left out: a class needs an id. Rows that repeat an id are one document, with one of its texts. Only the id and text columns are read.
``keep_firsts`` goes by rows instead, so null and repeated ids are ordinary there, and all columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import blocks, free_name, materialise, small_batches

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Share of equal registers from which texts are compared: 0.8 less four standard errors of 120 registers.
HOPEFUL = 0.65
#: Rows, and bytes of packed shingles, of one part of a bucket, give or take the hash's spread.
CELL_ROWS, CELL_BYTES = 256, 32_000_000
#: Ids (8 bytes each) that are broadcast at most, to fetch the texts to compare without a shuffle of all texts.
MAX_IDS = 4_000_000
CACHE = 400_000
WORD = re.compile(r"[^\W_]+")
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # fixed values: SplitMix64


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x + C1
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


def word_hashes(text: str | None, hashes: Hashes) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles, in order."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = mix(out ^ words[k : k + n])
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first in each register, for each (shingles, weights); rows of empty sets stay 0."""
    n_docs = len(sets)
    best = np.full(n_docs * registers, np.inf)
    who = np.zeros(n_docs * registers, np.uint64)
    sizes = np.array([len(s) for s, _ in sets], np.int64)
    item = np.concatenate([s for s, _ in sets]) if n_docs else np.zeros(0, np.uint64)
    rate = np.concatenate([w for _, w in sets]).astype(float) if n_docs else np.zeros(0)
    doc = np.repeat(np.arange(n_docs), sizes)
    time = np.zeros(len(item))
    turn = 0
    while len(item):
        draw = mix(item + np.uint64(turn * int(C1) % 2**64))
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        cell = doc * registers + ((mix(draw) >> np.uint64(33)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, cell, time)
        won = best[cell] == time
        who[cell[won]] = item[won]
        latest = best.reshape(n_docs, registers).max(axis=1)
        live = time < latest[doc]
        item, rate, doc, time = item[live], rate[live], doc[live], time[live]
        turn += 1
    return who.reshape(n_docs, registers)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The larger of probability Jaccard and plain Jaccard of two sorted sets with weights."""
    if not len(a) or not len(b):
        return 0.0
    common, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(a) + len(b) - len(common))
    x, y = wa[at].astype(float), wb[bt].astype(float)
    if (x == 1).all() and (y == 1).all() and wa.max() == 1 and wb.max() == 1:
        return plain
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # sum over d of 1 / sum over e of max(a_e / a_d, b_e / b_d): for each d, the e with larger a/b ratio give a_e / a_d, the others b_e / b_d
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
    below = np.concatenate([[0], np.cumsum(y)])
    cut = np.searchsorted(ratio, ratio, side="left")
    total = (above[cut] + only_a) / x + (below[cut] + only_b) / y
    return max(plain, float((1 / total).sum()))


SIGNED = "doc_id bigint, copy string, bands array<bigint>, sig binary, plain binary"


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the word sequence (null without words), the buckets of all bands, and one byte of every register of the
    signature, and of the plain one where weights differ.

    Bytes of unequal registers agree once in 256 times, so their share of agreement is never below that of the registers.
    """
    salts = mix(np.arange(BANDS, dtype=np.uint64))

    def banded(rows: np.ndarray) -> np.ndarray:
        buckets = np.tile(salts, (len(rows), 1))
        for k in range(ROWS):
            buckets = mix(buckets ^ rows.reshape(len(rows), BANDS, ROWS)[:, :, k])
        return buckets.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for ids, texts in blocks(batches, 3_000_000):
            words = [word_hashes(t, hashes) for t in texts]
            sets = [np.unique(shingles(w), return_counts=True) for w in words]
            twice = [k for k, (_, n) in enumerate(sets) if len(n) and n.max() > 1]
            rows, flat = signatures(sets), signatures([(sets[k][0], np.ones(len(sets[k][0]))) for k in twice])
            own, more = banded(rows), dict(zip(twice, banded(flat), strict=True))
            buckets = [np.unique(np.concatenate([own[k], more[k]])) if k in more else own[k] for k in range(len(ids))]
            edges = np.concatenate([[0], np.cumsum([len(x) for x in buckets])])
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(buckets)))
            copies = [xxhash.xxh128_hexdigest(w.tobytes()) if len(w) else None for w in words]
            tops = [(r >> np.uint64(56)).astype(np.uint8) for r in (rows, flat)]
            plain = dict(zip(twice, (r.tobytes() for r in tops[1]), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.string()), lists, pa.array([r.tobytes() for r in tops[0]], pa.binary()), pa.array([plain.get(k) for k in range(len(ids))], pa.binary())], ["doc_id", "copy", "bands", "sig", "plain"])

    return docs.mapInArrow(run, SIGNED)


def pack(items: np.ndarray, weights: np.ndarray) -> tuple[bytes, bytes | None]:
    """Six bytes of each sorted shingle; the weights only where one is above 1."""
    return np.ascontiguousarray(items.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes(), weights.astype(np.int32).tobytes() if (weights > 1).any() else None


def unpack(items: bytes, weights: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(items, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(np.uint64).reshape(-1), np.ones(len(raw), np.int32) if weights is None else np.frombuffer(weights, np.int32)


SHINGLED = "doc_id bigint, copy string, items binary, weights binary"


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id with its sorted shingles and their weights, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for ids, texts in blocks(batches, 1_500_000):
            words = [word_hashes(t, hashes) for t in texts]
            packed = [pack(*np.unique(shingles(w), return_counts=True)) for w in words]
            copies = [xxhash.xxh128_hexdigest(w.tobytes()) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies), pa.array([x for x, _ in packed], pa.binary()), pa.array([w for _, w in packed], pa.binary())], ["doc_id", "copy", "items", "weights"])

    rows = docs.mapInArrow(run, SHINGLED)
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("items", "weights"), "copy").alias("s")).select("doc_id", "s.items", "s.weights")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    one, two = (sets.select(F.col("doc_id").alias(x), F.col("items").alias(f"i{x}"), F.col("weights").alias(f"w{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ia, wa, ib, wb = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            kept = [similarity(*unpack(p, q), *unpack(r, s)) >= least for p, q, r, s in zip(ia, wa, ib, wb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ia", "wa", "ib", "wb")
    return both.mapInArrow(run, "a bigint, b bigint")


def cell_links(bucket: int, ids: list[int], sides: list[str], minor: np.ndarray, roots: list[int], bands: list[np.ndarray], sigs: np.ndarray, plains: np.ndarray, sets: list[tuple[bytes, bytes | None]], least: float) -> list[tuple[int, int]]:
    """Places of the linked rows of one cell that merge its classes: rows outside the largest class (sides l and b) against rows of other
    classes (sides r and b) whose least common bucket is this one, until their classes are merged."""
    _, group = np.unique(np.asarray(roots), return_inverse=True)
    ids, sides = np.asarray(ids), np.asarray(sides)
    right = np.flatnonzero(sides != "l")
    width = max(map(len, bands))
    table = np.stack([np.pad(b, (0, width - len(b)), mode="edge") for b in bands])
    found = []
    for x in np.flatnonzero((sides != "r") & minor).tolist():
        # of two rows outside the largest class, the one with the smaller id is on the left
        y = right[(group[right] != group[x]) & (~minor[right] | (ids[right] > ids[x]))]
        agree = np.maximum((sigs[y] == sigs[x]).mean(axis=1), (plains[y] == plains[x]).mean(axis=1))
        y, agree = y[agree >= HOPEFUL], agree[agree >= HOPEFUL]
        if len(y):
            common = np.where(np.isin(table[y], bands[x]), table[y], np.iinfo(np.int64).max).min(axis=1) == bucket
            found.append((agree[common], np.full(common.sum(), x), y[common]))
    if not found:
        return []
    agree, left, right = (np.concatenate(v) for v in zip(*found, strict=True))
    links, open_sets = [], {}
    for k in np.argsort(-agree, kind="stable"):
        x, y = int(left[k]), int(right[k])
        if group[x] != group[y]:
            for z in (x, y):
                if z not in open_sets:
                    open_sets[z] = unpack(*sets[z])
            if similarity(*open_sets[x], *open_sets[y]) >= least:
                links.append((x, y))
                group[group == group[y]] = group[x]
    return links


def cells(spark: SparkSession, members: DataFrame, rows: DataFrame, sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the classes of the buckets that hold more than one; see step 4 of the module's text."""
    named = members.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")).join(sets.select("doc_id", F.length("items").alias("size")), "doc_id")
    held = named.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    spans = held.groupBy("bucket").agg(F.max(F.struct("n", "root", "bytes")).alias("top"), F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("classes > 1")
    parts = lambda n, size: F.greatest(F.ceil(n / CELL_ROWS), F.ceil(size / CELL_BYTES), F.lit(1)).cast("int")
    spans = spans.select("bucket", F.col("top.root").alias("major"), parts(F.col("n"), F.col("bytes")).alias("n_parts"), parts(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("m_parts"))
    # written, so that the join below reads two plain shuffles, whose skewed partitions the engine can split
    placed = named.join(materialise(spark, spans, "open-buckets"), "bucket").withColumn("minor", F.col("root") != F.col("major"))
    part = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col(n)).cast("int")
    cell = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    right = F.transform(upto("m_parts"), lambda i: cell("r", i, part("n_parts")))
    left = F.transform(upto("n_parts"), lambda j: cell("l", part("m_parts"), j))
    places = F.when(F.col("n_parts") == 1, F.array(cell("b", F.lit(0), F.lit(0)))).when(F.col("minor"), F.concat(left, right)).otherwise(right)
    placed = placed.select("bucket", "doc_id", "root", "minor", F.explode(places).alias("c")).select("bucket", "doc_id", "root", "minor", "c.side", "c.i", "c.j")
    full = placed.join(rows.select("doc_id", "bands", "sig", "plain"), "doc_id").join(sets, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_pylist()
        ids, sides, minor = column("doc_id"), column("side"), np.array(column("minor"), bool)
        links = []
        if minor.any() and len({s for s in sides}) + (sides[0] == "b") > 1:
            sigs = column("sig")
            both = [np.frombuffer(b"".join(x), np.uint8).reshape(-1, REGISTERS) for x in (sigs, [p or s for p, s in zip(column("plain"), sigs, strict=True)])]
            bands = [np.array(b, np.int64) for b in column("bands")]
            links = cell_links(table.column("bucket")[0].as_py(), ids, sides, minor, column("root"), bands, *both, list(zip(column("items"), column("weights"), strict=True)), least)
        return pa.table({"a": pa.array([ids[x] for x, _ in links], pa.int64()), "b": pa.array([ids[y] for _, y in links], pa.int64())})

    return full.groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(doc_id, root): the smallest id of each document's component, by rounds of neighbour minima with pointer jumping."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialise(spark, edges, "links")
    labels = materialise(spark, edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), F.col("root").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        lower = labels.join(near, "a").select("a", F.least("root", "other").alias("root"), F.col("root").alias("old"))
        jump = lower.join(labels.select(F.col("a").alias("root"), F.col("root").alias("far")), "root", "left")
        after = materialise(spark, jump.select("a", F.least("root", F.coalesce("far", "root")).alias("root"), "old"), "labels")
        labels = after.select("a", "root")
        if after.where("root <> old").limit(1).count() == 0:
            return labels.withColumnRenamed("a", "doc_id")


def hopeful(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, equal): the pairs of documents of which enough registers are equal, in either signature, and how many are."""
    one, two = (rows.select(F.col("doc_id").alias(x), F.col("sig").alias(f"s{x}"), F.col("plain").alias(f"p{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda values: np.frombuffer(b"".join(values), np.uint8).reshape(-1, REGISTERS)
        for batch in batches:
            sa, pa_, sb, pb = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            equal = (table(sa) == table(sb)).sum(axis=1)
            plain = [k for k, (x, y) in enumerate(zip(pa_, pb, strict=True)) if x or y]
            if plain:
                equal[plain] = np.maximum(equal[plain], (table([pa_[k] or sa[k] for k in plain]) == table([pb[k] or sb[k] for k in plain])).sum(axis=1))
            kept = pa.array(equal >= HOPEFUL * REGISTERS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal, pa.int32())], ["a", "b", "equal"]).filter(kept)

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "pa", "sb", "pb").mapInArrow(run, "a bigint, b bigint, equal int")


def classes(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id, the smallest id of its class, for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    held = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    signed = materialise(spark, sign(held), "signatures")
    # a repeated id keeps one text
    own = signed.groupBy("doc_id").agg(F.min("copy").alias("copy"))
    firsts = own.where("copy is not null").groupBy("copy").agg(F.min("doc_id").alias("first"))
    own, firsts = materialise(spark, own, "texts"), materialise(spark, firsts, "copies")
    kept = firsts.select(F.col("first").alias("doc_id"), "copy")
    rows = signed.join(kept, ["doc_id", "copy"]).dropDuplicates(["doc_id"]).select("doc_id", "bands", "sig", "plain")
    rows = materialise(spark, rows, "rows")
    buckets = rows.select("doc_id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("doc_id", F.xxhash64("doc_id")).alias("leader")).where("n > 1").drop("n")
    # written, so that the join below reads two plain shuffles, whose skewed partitions the engine can split
    shared = materialise(spark, shared, "leaders")
    # rows of buckets that hold more than one text, with the bucket's leader
    members = materialise(spark, buckets.join(shared, "bucket"), "buckets")
    wanted = materialise(spark, members.select("doc_id").distinct(), "wanted")
    # up to a checked number of ids goes to the texts; beyond it the texts come to the ids
    few = wanted.count() <= MAX_IDS
    sets = materialise(spark, shingled(held.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")), "shingles")
    pairs = members.where("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct()
    best = hopeful(pairs, rows).groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b"))
    links = materialise(spark, verified(best, sets, least), "verified")
    roots = components(spark, links)
    more = materialise(spark, cells(spark, members.select("bucket", "doc_id"), rows, sets, roots, least), "links")
    if more.limit(1).count():
        roots = components(spark, links.unionByName(more))
    out = own.join(firsts.select("copy", "first"), "copy", "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"))
    return out.join(roots.select(F.col("doc_id").alias("first"), "root"), "first", "left").select("doc_id", F.coalesce("root", "first").alias("class_id"))


def keep_firsts(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Of each class of near-duplicate rows the one with the smallest id, with all its columns; null ids come after all others."""
    spark = docs.sparkSession
    row = free_name(docs.columns, "row")
    numbered = materialise(spark, docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = materialise(spark, classes(numbered, doc=row, text=text, least=least).select(F.col("doc_id").alias(row), "class_id"), "classes")
    ids = found.join(numbered.select(row, F.col(doc).alias("_id")), row)
    first = ids.groupBy("class_id").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col(row))).alias("first")).select(F.col(f"first.{row}").alias(row))
    gone = materialise(spark, found.select(row).join(first, row, "left_anti"), "gone")
    few = gone.count() <= MAX_IDS
    return numbered.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*(f"`{c}`" for c in docs.columns))
