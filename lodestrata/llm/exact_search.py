"""Exact top-k inner-product search with KD-trees.

Vectors become integers, ``floor(scale * x)`` of every component. A shard (a block of candidates of one partition) is a KD-tree: splits at
the median of the widest dimension, with tight bounding boxes. A block of queries descends best first: the node whose box
promises most is opened next, for those queries whose bound on that box still reaches their k-th score; at a leaf, scores come from one
matrix product. The k-th scores start from a pilot block of candidates and are carried from shard to shard of a task, so later shards open less.
Bounds only ever discard scores below the k-th, so results are exact, ties included (to the smaller id).

Queries travel in blocks of about ``block`` rows at most, one pass over the candidates for each. With several blocks, one is collected, searched and
its results written before the next, so what the driver and a task hold is bounded by a block however many queries there are.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id; vectors of
different lengths are not compared. Repeated rows count each time as candidates. Query rows that are equal in id and vector are one query; rows that share an id and differ in their vectors are each asked,
and their answers stand under the same query_id. A row with the query's own id is never its candidate. Where a component is beyond
2**20 in size after scaling, all rows of the shard are compared, in whole numbers of any size; a score beyond 64 bits is held at the largest or smallest
that a long can hold. An empty table, or one without queries, gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise

K = 5
SCALE = 256.0
LEAF = 256
SHARD = 16_384
BLOCK = 8_192
PILOT = 4_096
#: Scores are held to SCORES at most; LOW is below all of them.
SCORES = (1 << 63) - 2
LOW = -SCORES - 1
#: Components up to this size give exact sums in floating point.
EXACT = 1 << 20


def integers(ids: list, vectors: list, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and integer vectors of the rows that take part."""
    found: dict[int, tuple[list, list]] = {}
    for key, v in zip(ids, vectors, strict=True):
        if key is not None and v is not None and len(v) and None not in v:
            row = np.floor(np.asarray(v, np.float64) * scale)
            if np.isfinite(row).all():
                own = found.setdefault(len(row), ([], []))
                own[0].append(key)
                own[1].append(row)
    return {n: (np.array(a, np.int64), np.array(b)) for n, (a, b) in found.items()}


def large(rows: np.ndarray) -> bool:
    return np.abs(rows).max(initial=0) > EXACT or rows.shape[1] >= 4096


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: in floating point while every sum stays below 2**53, else in Python's integers."""
    if not (large(a) or large(b)):
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -SCORES, SCORES).astype(np.int64)


class Tree:
    """KD-tree in arrays: for each node its rows (a range of the permutation), box, and children (-1: a leaf)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.low, self.high, self.span, self.kids = [], [], [], []
        todo = [(0, len(ids), None)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.span)
            if parent is not None:
                self.kids[parent].append(node)
            part = rows[order[a:b]]
            low, high = part.min(axis=0), part.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.span.append((a, b))
            self.kids.append([])
            wide = int((high - low).argmax())
            if b - a > leaf and high[wide] > low[wide]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, wide], mid)]
                todo += [(a, a + mid, node), (a + mid, b, node)]
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high = np.array(self.low), np.array(self.high)


class Best:
    """The k best (score, id) of each query so far, and the score that a candidate must reach."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.rows, self.k = ids, rows, k
        self.floor = np.full(len(ids), LOW) if floor is None else floor.copy()
        self.score = np.full((len(ids), k), LOW)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.plus, self.minus, self.large = np.maximum(rows, 0), np.minimum(rows, 0), large(rows)

    def offer(self, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores of candidate rows for some of the queries."""
        score = product(self.rows[queries], rows)
        score[self.ids[queries][:, None] == ids[None, :]] = LOW
        use = np.flatnonzero((score.max(axis=1) >= self.floor[queries]) & (score.max(axis=1) > LOW))
        if not len(use):
            return
        q, score = queries[use], score[use]
        if score.shape[1] > 4 * self.k:
            # all that reach the k-th largest may be among the best: ties are settled below, by id
            limit = np.partition(score, -self.k, axis=1)[:, -self.k]
            wide = (score >= limit[:, None]).sum(axis=1).max()
            take = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, : self.k] if wide > self.k else np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
            score, own = np.take_along_axis(score, take, 1), ids[take]
        else:
            own = np.broadcast_to(ids, score.shape)
        score = np.concatenate([self.score[q], score], axis=1)
        own = np.concatenate([self.found[q], np.where(score[:, self.k :] > LOW, own, np.iinfo(np.int64).max)], axis=1)
        take = np.lexsort((own, -score), axis=1)[:, : self.k]
        self.score[q], self.found[q] = np.take_along_axis(score, take, 1), np.take_along_axis(own, take, 1)
        self.floor[q] = np.maximum(self.floor[q], self.score[q, -1])

    def search(self, tree: Tree) -> None:
        """Best-first descent of all queries together."""
        bound = lambda node, q: self.plus[q] @ tree.high[node] + self.minus[q] @ tree.low[node]
        everyone = np.arange(len(self.ids))
        if self.large or large(tree.rows):
            # bounds would be rounded
            for a in range(0, len(tree.ids), LEAF):
                self.offer(everyone, tree.ids[a : a + LEAF], tree.rows[a : a + LEAF])
            return
        first = bound(0, everyone)
        heap = [(-float(first.max(initial=-np.inf)), 0, everyone, first)]
        while heap:
            _, node, q, value = heapq.heappop(heap)
            open_ = value >= self.floor[q]
            q, value = q[open_], value[open_]
            if not len(q):
                continue
            if not tree.kids[node]:
                a, b = tree.span[node]
                self.offer(q, tree.ids[a:b], tree.rows[a:b])
                continue
            for kid in tree.kids[node]:
                reach = bound(kid, q)
                open_ = reach >= self.floor[q]
                if open_.any():
                    heapq.heappush(heap, (-float(reach[open_].max()), kid, q[open_], reach[open_]))


def top_k(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query. ``is_query`` is over the column vec_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id is not null and vector is not null")
    queries = rows.where(is_query).distinct()
    total = queries.count()
    n = max(1, -(-2 * total // block)) if total > block else 1
    pilot = rows.limit(PILOT).collect()
    pilot = {size: Tree(*own) for size, own in integers([r[0] for r in pilot], [r[1] for r in pilot], scale).items()}
    found, before = [], 0
    for part in range(n):
        own = queries.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)) == part).collect()  # bounded: about half a block
        ids = np.array([r[0] for r in own], np.int64)
        # by length: the numbers of the queries, their ids and vectors
        asked = {size: (place + before, ids[place], q) for size, (place, q) in integers(range(len(own)), [r[1] for r in own], scale).items()}
        before += len(own)
        floors = {}
        for size, (_, own_ids, q) in asked.items():
            start = Best(own_ids, q, k)
            if size in pilot:
                start.search(pilot[size])
            floors[size] = start.floor
        shared = spark.sparkContext.broadcast((asked, floors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, floors = shared.value
            best = {size: Best(ids, q, k, floors[size]) for size, (_, ids, q) in asked.items()}
            for ids, vectors in shards(batches):
                for size, (own, rows) in integers(ids, vectors, scale).items():
                    if size in best:
                        best[size].search(Tree(own, rows))
            for size, b in best.items():
                q, at = np.nonzero((b.score > LOW) & (b.score >= b.floor[:, None]))
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(asked[size][0][q]), pa.array(b.ids[q]), pa.array(b.found[q, at]), pa.array(b.score[q, at])], ["query", "query_id", "vec_id", "score"])

        hits = rows.mapInArrow(run, "query bigint, query_id bigint, vec_id bigint, score bigint")
        if n > 1:
            hits = materialise(spark, best_of(hits, k), "hits")
            shared.destroy()
        found.append(hits)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return best_of(out, k).select("query_id", "rank", "vec_id", "score")


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def shards(batches: Iterator[pa.RecordBatch], size: int = SHARD) -> Iterator[tuple[list, list]]:
    ids: list = []
    vectors: list = []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        vectors += batch.column(1).to_pylist()
        if len(ids) >= size:
            yield ids, vectors
            ids, vectors = [], []
    if ids:
        yield ids, vectors
