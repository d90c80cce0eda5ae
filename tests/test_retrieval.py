"""Keyword and hybrid retrieval by the inverted index, against plain sets: common tokens, ties, several blocks, empty and null texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import retrieval as R


def texts(rng, n, vocabulary):
    out = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 25))) for _ in range(n)]
    return [*out, "", None, "the", "THE the", out[0], out[1]]


def brute(questions, chunks, k, digits=12):
    sets = lambda t: set((t or "").lower().split())
    held, want = [sets(t) for t in chunks], {}
    for q, text in enumerate(questions):
        own = sets(text)
        scored = [(round(len(own & c) / len(own | c), digits), j) for j, c in enumerate(held) if own & c]
        want[q] = [(j, s) for s, j in sorted(scored, key=lambda x: (-x[0], -x[1]))[:k]]
    return want


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = ["the", "of", "and"] * 20 + [f"w{k}" for k in range(150)]
    return texts(rng, 60, vocabulary), texts(rng, 400, vocabulary)


def frames(spark, corpus):
    q = spark.createDataFrame(list(enumerate(corpus[0])), "q_id long, question string")
    return q, spark.createDataFrame(list(enumerate(corpus[1])), "chunk_seq long, text string").repartition(5, "chunk_seq")


@pytest.mark.parametrize("k", [1, 5, 500])
def test_keyword_scores(spark, corpus, k):
    q, c = frames(spark, corpus)
    want, got = brute(*corpus, k), {}
    for r in R.keyword_top_k(q, c, k).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append((r["chunk_seq"], r["keyword_score"]))
    assert {q: [(j, pytest.approx(s, abs=1e-11)) for j, s in w] for q, w in want.items() if w} == got


def test_several_blocks_and_rounding(spark, corpus, monkeypatch):
    q, c = frames(spark, corpus)
    plain = sorted(map(tuple, R.keyword_top_k(q, c, 4, 2).collect()))
    monkeypatch.setattr(R, "TOKEN_BYTES", 3_000)
    assert sorted(map(tuple, R.keyword_top_k(q, c, 4, 2).collect())) == plain
    want = brute(*corpus, 4, 2)
    assert plain == sorted((q, j, s, n) for q, w in want.items() for n, (j, s) in enumerate(w, 1))


def test_candidates_are_pruned(corpus, monkeypatch):
    """A question whose common tokens cannot reach its floor is scored only where a rarer token is shared; no pair above the floor is lost, whatever is common."""
    sets = [[(t or "").lower().split() for t in side] for side in corpus]
    chunks = pa.array([list(dict.fromkeys(x)) for x in sets[1]] + [None], pa.list_(pa.string()))
    often = {t: sum(t in c for c in sets[1]) for own in sets[0] for t in own}
    for common in (1, 3, 64):
        monkeypatch.setattr(R, "COMMON", common)
        index = R.TokenSets(sets[0], often)
        dense = index.all_pairs(chunks)
        exact = np.array([[len(set(a) & set(b)) / max(1, len(set(a) | set(b))) for b in [*sets[1], []]] for a in sets[0]])
        assert np.allclose(dense, exact)
        for floor in (0.0, 0.2, 0.5):
            question, chunk, score = index.candidates(chunks, np.full(len(sets[0]), floor))
            found = set(zip(question.tolist(), chunk.tolist(), strict=True))
            assert found >= set(zip(*map(np.ndarray.tolist, np.nonzero((exact > 0) & (exact >= floor))), strict=True)) and np.allclose(score, exact[question, chunk])
        if common == 3:
            assert len(found) < 0.8 * (exact > 0).sum()


def test_postings_in_slices(corpus, monkeypatch):
    sets = [list(dict.fromkeys((t or "").lower().split())) for t in corpus[0]]
    chunks = pa.array(sets, pa.list_(pa.string()))
    whole = R.TokenSets(sets, {}).all_pairs(chunks)
    monkeypatch.setattr(R, "CELLS", 3)
    assert np.array_equal(R.TokenSets(sets, {}).all_pairs(chunks), whole)


def test_hybrid_parts(spark, corpus):
    q, c = frames(spark, corpus)
    q = q.withColumn("q_vec", F.array(F.lit(1.0), F.col("q_id") % 3.0))
    c = c.withColumn("vec", F.when(F.col("chunk_seq") % 11 != 0, F.array(F.col("chunk_seq") % 5.0, F.lit(1.0))))
    for given in ({}, {"weight": 1.0, "word_weight": 0.5}, {"weight": 0.2, "word_weight": 0.0}):
        a, b = given.get("weight", 0.7), given.get("word_weight", 1 - given.get("weight", 0.7))
        rows = R.hybrid_top_k(q, c, 5, **given).collect()
        assert len(rows) == 5 * len(corpus[0])
        words = {(i, j): s for i, w in brute(*corpus, 10_000).items() for j, s in w}
        for r in rows:
            assert r["combined_score"] == pytest.approx(a * r["vector_score"] + b * r["keyword_score"], abs=1e-9)
            assert r["keyword_score"] == pytest.approx(words.get((r["q_id"], r["chunk_seq"]), 0.0)) and r["text"] == corpus[1][r["chunk_seq"]]


def test_texts_are_cut_once(spark, corpus, monkeypatch):
    q, c = frames(spark, corpus)
    cuts = []
    plain = R.with_tokens
    monkeypatch.setattr(R, "with_tokens", lambda *a: cuts.append(1) or plain(*a))
    monkeypatch.setattr(R, "TOKEN_BYTES", 2_000)
    hits = R.keyword_top_k(q, c, 3)
    assert cuts == [1] and "text" not in hits._jdf.queryExecution().optimizedPlan().toString()
