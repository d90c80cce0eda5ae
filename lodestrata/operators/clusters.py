"""An index of vectors in clusters that a search reads only in part, with exact results.

Rows are scaled to length 1 and dealt to the nearest of a number of centres, which are fitted on a bounded sample (every row is indexed). Each cluster is written as a partition of its own, with
its centre c and radius r, the largest distance of a row from it. For a question q of length 1 no row of the cluster scores more than q·c + r. A search first reads, for each question, the
clusters of the highest bounds until they hold k rows; that gives the k-th score so far, and then only clusters whose bound reaches it for some question are read, and compared with those questions
alone. Bounds only discard what lies below the k-th score, so the hits are those of a full pass, ties included.

Rows without a vector, or with one of zeros or of another length than most of the sample, have a cluster of their own and score 0, as in a full pass. Questions without a vector score 0
everywhere. Chunk numbers are unique. An empty table has no clusters and gives no hits. Clusters that hold many rows have several files, so no task reads one whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.retrieval import CELLS, DIGITS, HITS, Asked, Kept, best, unit
from lodestrata.sources.tables import materialise

SAMPLE = 20_000
#: Numbers of the sample, of all centres, and of one table of bounds.
SAMPLE_NUMBERS, BOUNDS = 16_000_000, 8_000_000
MOST_CLUSTERS = 4_096
#: Rows of a file of a cluster.
FILE_ROWS = 200_000
#: What rounding may add to a score.
SLACK = 1e-9
#: The cluster of rows without direction.
NONE = -1


def fit(rows: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``n`` clusters of unit rows, from the first ones on, moved to the mean of what is nearest; a centre that has lost its rows goes."""
    centres = np.unique(rows[:n], axis=0)
    for _ in range(rounds):
        near = nearest(rows, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, CELLS // max(1, len(centres)))
    return np.concatenate([np.argmax(rows[a : a + step] @ centres.T - half, axis=1) for a in range(0, len(rows), step)]) if len(rows) else np.zeros(0, np.int64)


class ClusterIndex:
    """``build`` writes an index under a folder; an object reads it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.rows = spark.read.schema("chunk_seq bigint, vec array<double>, file int, cluster int").parquet(f"{self.folder}/rows")
        # a row for each cluster: bounded by MOST_CLUSTERS
        found = sorted(spark.read.parquet(f"{self.folder}/clusters").collect())
        self.numbers = np.array([r["cluster"] for r in found], np.int64)
        self.sizes = np.array([r["n"] for r in found], np.int64)
        self.radius = np.array([r["radius"] for r in found], float)
        dims = max((len(r["centre"]) for r in found), default=0)
        self.centres = np.array([r["centre"] if r["cluster"] != NONE else [0.0] * dims for r in found], float).reshape(len(found), dims)

    @classmethod
    def build(cls, chunks: DataFrame, folder: str, clusters: int | None = None, *, sample: int = SAMPLE) -> ClusterIndex:
        """chunks (chunk_seq, vec). By default as many clusters as the square root of the rows, at most ``MOST_CLUSTERS``."""
        spark, folder = chunks.sparkSession, folder.rstrip("/")
        rows = chunks.select(F.col("chunk_seq").cast("long").alias("chunk_seq"), F.col("vec").cast("array<double>").alias("vec"))
        total, widest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
        most = max(1, min(sample, SAMPLE_NUMBERS // max(1, widest)))
        taken = rows.where("vec is not null").orderBy(F.xxhash64("chunk_seq"), "chunk_seq").limit(most).select("vec").collect()  # bounded: most rows, SAMPLE_NUMBERS numbers
        lengths = [len(r["vec"]) for r in taken]
        dims = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
        known = unit([r["vec"] for r in taken if len(r["vec"]) == dims], dims) if dims else np.zeros((0, 0))
        known = known[np.abs(known).max(axis=1, initial=0) > 0]
        n = min(clusters or int(total**0.5), MOST_CLUSTERS, max(1, SAMPLE_NUMBERS // max(1, dims)))
        shared = spark.sparkContext.broadcast(fit(known, max(1, n)) if len(known) else np.zeros((0, dims)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in batches:
                own = unit(batch.column("vec").to_pylist(), dims)
                cluster = np.where(np.abs(own).max(axis=1, initial=0) > 0, nearest(own, centres) if len(centres) else NONE, NONE)
                away = np.zeros(len(own))
                some = cluster != NONE
                away[some] = np.sqrt(((own[some] - centres[cluster[some]]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("chunk_seq"), batch.column("vec"), pa.array(cluster, pa.int32()), pa.array(away)], ["chunk_seq", "vec", "cluster", "away"])

        dealt = materialise(spark, rows.mapInArrow(deal, "chunk_seq bigint, vec array<double>, cluster int, away double"), "dealt")
        found = dealt.groupBy("cluster").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        sizes = materialise(spark, found, "clusters")
        centres = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(shared.value)] + [(NONE, [0.0] * dims)], "cluster int, centre array<double>")  # at most MOST_CLUSTERS rows
        sizes.join(F.broadcast(centres), "cluster").write.mode("overwrite").parquet(f"{folder}/clusters")
        # at most MOST_CLUSTERS rows are broadcast; a large cluster goes to several files by the chunks' hashes
        files = dealt.join(F.broadcast(sizes.select("cluster", F.ceil(F.col("n") / FILE_ROWS).alias("files"))), "cluster").withColumn("file", F.pmod(F.xxhash64("chunk_seq"), F.col("files")).cast("int"))
        files.select("chunk_seq", "vec", "file", "cluster").repartition("cluster", "file").sortWithinPartitions("cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{folder}/rows")
        return cls(spark, folder)

    def top_hits(self, questions: DataFrame, k: int, *, threshold: float | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(q_id, chunk_seq, score, rank) as ``retrieval.top_hits`` gives them over all chunks; and (q_id, clusters_read, clusters) of each question."""
        asked = questions.select("q_id", "q_vec")
        kind = asked.schema["q_id"].dataType.simpleString()
        block = max(1, BOUNDS // max(1, len(self.numbers), self.centres.shape[1]))
        total = asked.count()
        n = max(1, -(-2 * total // block)) if total > block else 1
        hits, reads = None, []
        for part in range(n):
            own = (asked.where(F.pmod(F.xxhash64("q_id"), F.lit(n)) == part) if n > 1 else asked).collect()  # bounded: about half a block
            found, read = self._block([r["q_id"] for r in own], [r["q_vec"] for r in own], k, threshold, digits, kind)
            hits = found if hits is None else hits.unionByName(found)
            reads.append(read)
        out = reads[0]
        for more in reads[1:]:
            out = out.unionByName(more)
        return hits, out

    def _block(self, ids: list, vectors: list, k: int, threshold: float | None, digits: int | None, kind: str) -> tuple[DataFrame, DataFrame]:
        dims, spark = self.centres.shape[1], self.spark
        exact = [v if v is not None and len(v) == dims else None for v in vectors]
        asked = Asked(ids, [*exact, [1.0] * max(1, dims)], None)  # the last one settles the length
        asked.vectors = asked.vectors[:-1].reshape(len(ids), max(1, dims))
        slack = SLACK + 10.0 ** -(DIGITS if digits is None else digits)
        bound = asked.vectors @ self.centres.T + self.radius + slack if len(self.numbers) and dims else np.zeros((len(ids), len(self.numbers)))
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        least = -np.inf if threshold is None else threshold
        first &= bound >= least
        hits = materialise(spark, self._scored(asked, first, k, least, digits, kind), "hits")
        floor = np.full(len(ids), least)
        place = {q: i for i, q in enumerate(ids)}
        for r in hits.where(F.col("rank") == k).select("q_id", "score").collect():  # a row for each question of the block
            floor[place[r["q_id"]]] = max(least, r["score"])
        second = (bound >= floor[:, None]) & ~first
        more = self._scored(asked, second, k, least, digits, kind)
        out = materialise(spark, best(hits.drop("rank").unionByName(more.drop("rank")), k), "hits")
        read = spark.createDataFrame([(q, int(a), len(self.numbers)) for q, a in zip(ids, (first | second).sum(axis=1), strict=True)], f"q_id {kind}, clusters_read int, clusters int")
        return out, read

    def _scored(self, asked: Asked, wanted: np.ndarray, k: int, least: float, digits: int | None, kind: str) -> DataFrame:
        """The hits of the wanted (question, cluster) pairs; only files of clusters that some question wants are read."""
        own = np.flatnonzero(wanted.any(axis=0))
        rows = self.rows.where(F.col("cluster").isin([int(x) for x in self.numbers[own]])).select("cluster", "chunk_seq", "vec")
        shared = self.spark.sparkContext.broadcast((asked, {int(self.numbers[c]): np.flatnonzero(wanted[:, c]) for c in own}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, by_cluster = shared.value
            kept = Kept(len(block.ids), k)
            for whole in batches:
                clusters = whole.column("cluster").to_numpy()
                for c in np.unique(clusters).tolist():
                    asking = by_cluster[c]
                    part = whole.filter(pa.array(clusters == c))
                    step = max(1, CELLS // max(1, len(asking)))
                    for at in range(0, part.num_rows, step):
                        batch = part.slice(at, step)
                        found = np.round(block.vectors[asking] @ unit(batch.column("vec").to_pylist(), block.vectors.shape[1]).T, DIGITS if digits is None else digits)
                        found[~(found >= least)] = -np.inf
                        seq = batch.column("chunk_seq").to_numpy()
                        q, j = np.nonzero((found >= kept.score[asking, -1][:, None]) & (found > -np.inf))
                        kept.offer_pairs(asking[q], seq[j], found[q, j])
            q, at = np.nonzero(kept.score > -np.inf)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array([block.ids[x] for x in q.tolist()]), pa.array(kept.chunk[q, at]), pa.array(kept.score[q, at])], ["q_id", "chunk_seq", "score"])

        return best(rows.mapInArrow(run, HITS.format(kind)), k)
