"""Toxicity with a linear-chain conditional random field over words.

Only documents are labelled, so the words are labelled first: a word is a toxic mark where it stands in a toxic document and is
strongly tied to toxic documents over the training rows, itself or by one of its n-grams; if no word is, the ``FEW`` most strongly tied
words are. A two-state chain (outside, toxic) is then trained on those labels, over all words of the training rows: each
word's potential is the sum of its own weight (of a word of at least ``COMMON`` training rows) and the mean of its character n-grams' weights, and the transitions are
learned with them, by gradient ascent on forward-backward marginals. A document's score is a logistic function of the
expected number of toxic words, its share of the words and the chance of at least one; offending spans are the words
whose marginal is at least ``SPAN``.

Words are runs of ``\\w``; a run of more than ``PIECE`` characters (scripts without spaces) is cut into pieces that overlap by the longest
n-gram, each a word of the chain, so all of it is scored.

The classifier is fitted in one task, on a documented sample: at most ``max_rows`` labelled rows of each class (the ones whose ids hash
lowest), and of those as many as ``max_chars`` characters of a class hold. Everything is scored.

Null and empty texts have no words and get the score that the logistic function gives to none. A null label, an unlabelled document
and a null id are never learned from. If an id has several labels, each counts; without both classes among the training rows
all scores are 0. Very long texts are one chain. Only the named columns are read.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import blocks, small_batches

WORD = re.compile(r"\w+")
MAX_ROWS = 2_500
MAX_CHARS = 24_000_000
#: Characters of a word; longer runs are cut into pieces.
PIECE = 16
#: Training rows that a word must stand in to have a weight of its own.
COMMON = 3
#: Words that count as marks if none passes.
FEW = 20
#: Lengths of the character n-grams inside words, and their hash buckets.
GRAMS = (3, 4, 5, 6)
BUCKETS = 131_072
EPOCHS = 40
RATE = 0.5
SPAN = 0.5
#: Log odds ratio from which a word counts as a toxic mark: words of copied documents stay below it.
TIED = 3.5
CACHE = 400_000
STEP = 128
ZEROS = [0.0] * 1_000
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
OUT_DDL = "doc_id bigint, score double, starts array<bigint>, ends array<bigint>"


def cuts(length: int) -> range:
    """Where the pieces of a run of ``length`` characters begin: every n-gram lies inside one."""
    step = PIECE - max(GRAMS) + 1
    return range(0, max(1, length - max(GRAMS) + 1), step) if length > PIECE else range(1)


def words_of(text: str) -> list[str]:
    """Words of a lower-cased text, long runs in pieces."""
    words = WORD.findall(text)
    if words and max(map(len, words)) > PIECE:
        return [w[k : k + PIECE] if len(w) > PIECE else w for w in words for k in cuts(len(w))]
    return words


def places_of(text: str) -> list[tuple[int, int]]:
    """Begin and end of every one of ``words_of(text)``."""
    return [(m.start() + k, min(m.end(), m.start() + k + PIECE)) for m in WORD.finditer(text) for k in cuts(m.end() - m.start())]


def gram_texts(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[k : k + n] for n in GRAMS for k in range(max(1, len(padded) - n + 1))]


def word_grams(word: str) -> list[int]:
    """Buckets of the word's n-grams, with both ends marked."""
    return [xxhash.xxh32_intdigest(g) % BUCKETS for g in gram_texts(word)]


def marginals(odds: np.ndarray, fresh: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Chance of the toxic state at every word. ``odds``: exp of each word's potential; ``fresh``: whether a chain begins there.

    All chains stand end to end and are cut into blocks of ``STEP`` words, which advance together: first the product of each
    block's 2x2 matrices, then the states at the block edges, then the words inside.
    """
    n = len(odds)
    if not n:
        return np.zeros(0)
    rows = -(-n // STEP)
    e = np.ones(rows * STEP)
    e[:n] = odds
    f = np.ones(rows * STEP, bool)
    f[:n] = fresh
    e, f = e.reshape(rows, STEP).T, f.reshape(rows, STEP).T
    m = np.empty((STEP, 4, rows))
    for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        m[:, k] = np.where(f, start[j], move[i, j]) * (e if j else 1.0)
    p = np.repeat(np.array([[1.0], [0.0], [0.0], [1.0]]), rows, axis=1)
    for a, b, c, d in m:
        p = np.stack([p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d])
        p /= p.sum(axis=0)
    alpha, beta = np.empty((rows, 2)), np.empty((rows, 2))
    x0, x1 = 0.5, 0.5
    flat = p.T.tolist()
    for k, (a, b, c, d) in enumerate(flat):
        alpha[k] = x0, x1
        x0, x1 = x0 * a + x1 * c, x0 * b + x1 * d
        x0, x1 = x0 / (x0 + x1), x1 / (x0 + x1)
    x0, x1 = 0.5, 0.5
    for k in range(rows - 1, -1, -1):
        a, b, c, d = flat[k]
        beta[k] = x0, x1
        x0, x1 = a * x0 + b * x1, c * x0 + d * x1
        x0, x1 = x0 / (x0 + x1), x1 / (x0 + x1)
    a0, a1 = alpha.T
    kept = np.empty((STEP, 2, rows))
    for k, (a, b, c, d) in enumerate(m):
        a0, a1 = a0 * a + a1 * c, a0 * b + a1 * d
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        kept[k] = a0, a1
    b0, b1 = beta.T
    out = np.empty((STEP, rows))
    for k in range(STEP - 1, -1, -1):
        t0, t1 = kept[k, 0] * b0, kept[k, 1] * b1
        out[k] = t1 / (t0 + t1)
        a, b, c, d = m[k]
        b0, b1 = a * b0 + b * b1, c * b0 + d * b1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    return out.T.reshape(-1)[:n]


def doc_features(p: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Per document: 1, chance of any toxic word, log of 1 + expected toxic words, and their share of the words."""
    n = np.diff(edges)
    sums = np.diff(np.concatenate([[0], np.cumsum(p)])[edges])
    none = np.diff(np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])[edges])
    return np.stack([np.ones(len(n)), 1 - np.exp(none), np.log1p(np.maximum(sums, 0)), np.sqrt(np.maximum(sums, 0) / np.maximum(n, 1))], axis=1)


class Model:
    """Weights of words and n-grams, bias, transitions, and of the document's logistic function (None: nothing was learned)."""

    def __init__(self, words: dict[str, float], grams: dict[str, float], bias: float, start: np.ndarray, move: np.ndarray, logistic: np.ndarray | None):
        self.words, self.grams, self.bias, self.start, self.move, self.logistic = words, grams, bias, start, move, logistic

    def potential(self, word: str) -> float:
        own = gram_texts(word)
        inner = sum(map(self.grams.get, own, ZEROS)) / len(own) ** 0.5
        return math.exp(min(30.0, max(-30.0, self.bias + self.words.get(word, 0.0) + inner)))


class Odds(dict):
    """exp of the potential of each word seen lately."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        value = self[word] = self.model.potential(word)
        return value


def association(held: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How surely (in standard errors) and how strongly (log odds ratio) each feature is tied to toxic documents."""
    rate = (held + 0.5) / (size[:, None] + 1)
    odds = np.log(rate[1] / (1 - rate[1])) - np.log(rate[0] / (1 - rate[0]))
    return odds / np.sqrt((1 / (held + 0.5) + 1 / (size[:, None] - held + 0.5)).sum(axis=0)), odds


def learn(texts: list[str], labels: np.ndarray) -> Model:
    """Label words, train the chain on all of them, then the document's logistic function."""
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t.lower())), np.int64) for t in texts]
    n_words = len(number)
    empty = Model({}, {}, -8.0, np.ones(2), np.ones((2, 2)), None)
    if not n_words or labels.min() == labels.max():
        return empty
    size = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    names = list(number)
    grams = [word_grams(x) for x in names]
    first = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    flat = np.fromiter((g for row in grams for g in row), np.int64, int(first[-1]))
    held, gram_held = np.zeros((2, n_words)), np.zeros((2, BUCKETS))
    for row, label in zip(docs, labels, strict=True):
        own = np.unique(row)
        held[int(label), own] += 1
        n = first[own + 1] - first[own]
        at = np.arange(n.sum()) + np.repeat(first[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        gram_held[int(label), np.unique(flat[at])] += 1
    tie, odds = association(held, size)
    gram_tie, gram_odds = association(gram_held, size)
    strong = (gram_tie > 4) & (gram_odds > TIED)
    mark = (tie > 2.5) & (odds > TIED)
    mark |= np.add.reduceat(strong[flat], first[:-1]) > 0
    if not mark.any():
        mark[np.argsort(-tie)[:FEW]] = True
    ids = np.concatenate(docs)
    edges = np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)
    goal = (mark[ids] & (np.repeat(labels, np.diff(edges)) == 1)).astype(float)
    fresh = chain_starts(edges)
    used, ids = np.unique(ids, return_inverse=True)
    grams = [grams[k] for k in used.tolist()]
    gram_word = np.repeat(np.arange(len(used)), [len(g) for g in grams])
    gram = np.concatenate([np.array(g) for g in grams])
    share = 1 / np.sqrt(np.array([len(g) for g in grams], float))
    times = np.bincount(ids, minlength=len(used)).astype(float)
    # a word of few rows has no weight of its own: its n-grams must tell
    common = held.sum(axis=0)[used] >= COMMON
    w, tri, bias = np.zeros(len(used)), np.zeros(BUCKETS), -3.0
    start, move = np.zeros(2), np.zeros((2, 2))
    for epoch in range(EPOCHS):
        pot = bias + w + np.bincount(gram_word, weights=tri[gram], minlength=len(used)) * share
        p = marginals(np.exp(np.clip(pot[ids], -30, 30)), fresh, np.exp(start), np.exp(move))
        error = goal - p
        step = RATE * 4 / (1 + epoch / 20)
        by_word = np.bincount(ids, weights=error, minlength=len(used))
        w += common * step * (by_word - 0.05 * w) / np.sqrt(times + 1)
        by_gram = np.bincount(gram, weights=(by_word * share)[gram_word], minlength=BUCKETS)
        weight = np.bincount(gram, weights=(times * share)[gram_word], minlength=BUCKETS)
        tri += step * 0.5 * (by_gram - 0.02 * tri) / (weight + 2)
        bias += step * 4 * error.mean()
        before = np.concatenate([[0], p[:-1]])
        was = np.concatenate([[0], goal[:-1]])
        inner = ~fresh
        for i in (0, 1):
            seen = np.where(inner, was if i else 1 - was, 0)
            meant = np.where(inner, before if i else 1 - before, 0)
            move[i, 1] += step * ((seen * goal).sum() - (meant * p).sum()) / (seen.sum() + 50)
        start[1] += step * error[fresh].mean()
    keep = np.flatnonzero(np.abs(w) > 0.05)
    heavy = set(np.flatnonzero(np.abs(tri) > 0.3).tolist())
    texts_of = {g: tri[b] for k in used.tolist() for g in gram_texts(names[k]) if (b := xxhash.xxh32_intdigest(g) % BUCKETS) in heavy}
    model = Model({names[used[k]]: float(w[k]) for k in keep.tolist()}, {g: float(x) for g, x in texts_of.items()}, bias, np.exp(start), np.exp(move), None)
    odds_of = Odds(model)
    table = np.fromiter((odds_of[x] for x in names), float, n_words)
    x = doc_features(marginals(table[np.concatenate(docs).astype(np.int64)], chain_starts(edges), model.start, model.move), edges)
    theta = np.zeros(x.shape[1])
    weight = np.where(labels == 1, 0.5 / size[1], 0.5 / size[0]) * len(labels)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.eye(len(theta))
        theta += np.linalg.solve(hess, x.T @ (weight * (labels - q)) - theta)
    model.logistic = theta
    return model


def chain_starts(edges: np.ndarray) -> np.ndarray:
    fresh = np.zeros(int(edges[-1]), bool)
    fresh[edges[:-1][np.diff(edges) > 0]] = True
    return fresh


def score_block(texts: list[str | None], known: Odds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, marginals of all words, and the edges of the documents."""
    cut = [words_of(t.lower()) if t else [] for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(w) for w in cut])]).astype(np.int64)
    odds = np.fromiter((o for words in cut for o in map(known.__getitem__, words)), float, int(edges[-1]))
    model = known.model
    if model.logistic is None:
        return np.zeros(len(texts)), np.zeros(len(odds)), edges
    p = marginals(odds, chain_starts(edges), model.start, model.move)
    return 1 / (1 + np.exp(-np.clip(doc_features(p, edges) @ model.logistic, -30, 30))), p, edges


def fit(docs: DataFrame, labels: DataFrame, trains: Column, *, doc: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on the rows for which ``trains`` (over the column doc_id) holds, at most ``max_rows`` and about ``max_chars`` characters of each class."""
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.select(F.col(doc).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(trains).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = own.where("y = 1").orderBy(*order).limit(max_rows).unionByName(own.where("y = 0").orderBy(*order).limit(max_rows))
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    # bounded: 2 * max_rows ids; rows are taken in the order of their ids' hashes until their characters are enough
    rows = rows.join(F.broadcast(sample), "doc_id")
    sized = rows.select("y", "doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("t"))
    upto = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "t").rowsBetween(Window.unboundedPreceding, -1)
    taken = sized.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("before") < max_chars).select("y", "doc_id", "t").distinct()
    rows = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(taken), ["y", "doc_id", "t"]).select("y", "text", "doc_id").repartition(1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, y, t) for b in batches for y, t, i in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        model = learn([t for *_, t in rows], np.array([y for _, y, _ in rows], float)) if rows else learn([], np.zeros(1))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.__dict__)], pa.binary())], ["model"])

    found = rows.mapInArrow(train, "model binary").first()
    return Model(**pickle.loads(found["model"])) if found else learn([], np.zeros(1))


def score(docs: DataFrame, model: Model, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, and starts and ends of the offending words (code points of the text as it is, half-open)."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Odds(held.value)
        for ids, texts in blocks(batches, 4_000_000):
            if len(known) > CACHE:
                known = Odds(held.value)
            scores, p, edges = score_block(texts, known)
            starts: list[list[int]] = [[] for _ in ids]
            ends: list[list[int]] = [[] for _ in ids]
            hot = np.flatnonzero(p >= SPAN)
            for d in np.unique(np.searchsorted(edges, hot, side="right") - 1).tolist():
                chosen = set((hot[(hot >= edges[d]) & (hot < edges[d + 1])] - edges[d]).tolist())
                low = texts[d].lower()
                # a few letters are longer in lower case
                origin = None if len(low) == len(texts[d]) else [at for at, c in enumerate(texts[d]) for _ in c.lower()]
                for k, (a, b) in enumerate(places_of(low)):
                    if k in chosen:
                        starts[d].append(origin[a] if origin else a)
                        ends[d].append(origin[b - 1] + 1 if origin else b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores), pa.array(starts, OUT.field(2).type), pa.array(ends, OUT.field(3).type)], schema=OUT)

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, OUT_DDL)
