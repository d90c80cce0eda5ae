"""The clustered index against full passes: pruning, ties, rows without direction, several blocks and files."""

import random

import numpy as np
import pytest

from lodestrata.operators import clusters
from lodestrata.operators import retrieval as R
from lodestrata.operators.clusters import ClusterIndex


def frames(spark, vectors, asked):
    c = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "chunk_seq long, vec array<double>").repartition(4, "chunk_seq")
    return spark.createDataFrame([(k, v) for k, v in enumerate(asked)], "q_id long, q_vec array<double>"), c


def grouped(rng, groups=12, each=60, dims=6):
    out = []
    for _ in range(groups):
        middle = [rng.uniform(-1, 1) for _ in range(dims)]
        out += [[m + rng.gauss(0, 0.03) for m in middle] for _ in range(each)]
    return out


def same(a, b):
    return sorted((r["q_id"], r["rank"], r["chunk_seq"], r["score"]) for r in a.collect()) == sorted((r["q_id"], r["rank"], r["chunk_seq"], r["score"]) for r in b.collect())


def test_grouped_vectors_are_read_in_part(spark, tmp_path):
    rng = random.Random(2)
    vectors = grouped(rng)
    q, c = frames(spark, vectors, [vectors[k] for k in range(0, 720, 90)])
    index = ClusterIndex.build(c, str(tmp_path), 12)
    hits, reads = index.top_hits(q, 5)
    assert same(hits, R.top_hits(q, c, 5, threshold=None))
    shares = [r["clusters_read"] / r["clusters"] for r in reads.collect()]
    assert len(shares) == 8 and max(shares) < 0.7 and sum(shares) / 8 < 0.4
    # files of clusters that no question wants are not listed
    wanted = np.zeros((1, len(index.numbers)), bool)
    wanted[0, 0] = True
    rows = index.rows.where(f"cluster in ({index.numbers[0]})")
    assert rows.count() == index.sizes[0] and "PartitionFilters: [isnotnull(cluster" in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("k", "threshold"), [(1, None), (7, 0.5), (2000, None), (3, 2.0)])
def test_equal_to_a_full_pass(spark, tmp_path, monkeypatch, k, threshold):
    rng = random.Random(k)
    vectors = [[float(rng.randint(-1, 1)) for _ in range(3)] for _ in range(300)] + [None, [0.0] * 3, [1.0, 2.0], [], [1e9, 1e9, 0.0], [1e-9, 0.0, 0.0]]
    asked = [[1.0, 0.0, 0.0], [1.0, 1.0, 1.0], None, [0.0, 0.0, 0.0], [1.0], [-1.0, 2.0, 0.5], vectors[0]]
    q, c = frames(spark, vectors, asked)
    monkeypatch.setattr(clusters, "FILE_ROWS", 20)
    index = ClusterIndex.build(c, str(tmp_path), 9, sample=100)
    want = R.top_hits(q, c, k, threshold=threshold, digits=9)
    assert index.sizes.sum() == len(vectors) and same(index.top_hits(q, k, threshold=threshold, digits=9)[0], want)
    monkeypatch.setattr(clusters, "BOUNDS", 30)  # several blocks of questions
    hits, reads = index.top_hits(q, k, threshold=threshold, digits=9)
    assert same(hits, want) and reads.count() == len(asked)


def test_empty_tables(spark, tmp_path):
    q, c = frames(spark, [[1.0, 0.0]], [[1.0, 0.0]])
    index = ClusterIndex.build(c.where("chunk_seq > 5"), f"{tmp_path}/a")
    assert index.top_hits(q, 3)[0].count() == 0
    assert ClusterIndex.build(c, f"{tmp_path}/b").top_hits(q.where("q_id > 5"), 3)[0].count() == 0
    nothing = ClusterIndex.build(frames(spark, [None, [0.0, 0.0]], [])[1], f"{tmp_path}/c")
    assert nothing.sizes.tolist() == [2] and nothing.top_hits(q, 3)[0].count() == 2


def test_bounds_hold():
    rng = np.random.default_rng(1)
    rows = R.unit(rng.normal(size=(400, 5)).tolist())
    centres = clusters.fit(rows, 20)
    near = clusters.nearest(rows, centres)
    away = np.sqrt(((rows - centres[near]) ** 2).sum(axis=1))
    assert (near == np.argmin(((rows[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)).all()
    asked = R.unit(rng.normal(size=(30, 5)).tolist())
    for c in range(len(centres)):
        own = near == c
        if own.any():
            assert (asked @ rows[own].T <= (asked @ centres[c])[:, None] + away[own].max() + 1e-12).all()
