"""Retrieval for whole batches of questions: cosine, keyword and hybrid top-k.

The questions are the stated side. They are collected and broadcast in blocks of at most ``BLOCK`` questions (and ``TOKEN_BYTES`` of tokens), one pass over the chunks for each; with
several blocks a block's hits are written before the next is collected, so neither driver nor executors hold more than one. A pass reads (chunk_seq,
vector, tokens) in Arrow batches, scores a batch by matrix products, and keeps the k best of every question: what leaves a task is at most
k rows for each question, ids and scores only. Texts are joined to those that survive. Ties go to the later chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import vectors as V
from lodestrata.sources.tables import materialise

BLOCK = 4_096
#: Bytes of the tokens of a block, which has a vocabulary of its own; tokens that are bits.
TOKEN_BYTES = 32_000_000
COMMON = 64
#: Scores are compared after rounding to so many digits, so equal vectors tie whatever the order of their sums.
DIGITS = 12
#: Numbers of one score matrix.
CELLS = 4_000_000
HITS = "q_id {0}, chunk_seq bigint, score double"


def best(scored: DataFrame, k: int, score: str = "score", question: str = "q_id", chunk: str = "chunk_seq") -> DataFrame:
    """The k best chunks of each question as (…, rank)."""
    order = Window.partitionBy(question).orderBy(F.desc(score), F.desc(chunk))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Asked:
    """One block of questions: unit vectors, and token sets as an inverted index."""

    def __init__(self, ids: list, vectors: list | None, tokens: TokenSets | None):
        self.ids, self.tokens = ids, tokens
        self.vectors = None if vectors is None else unit(vectors)

    def cosine(self, vectors: list) -> np.ndarray:
        """Question by chunk; 0 where a vector is null, 0 or of another length."""
        rows = unit(vectors, self.vectors.shape[1])
        return self.vectors @ rows.T


class TokenSets:
    """The token sets of a block of questions as an inverted index over their own vocabulary, the commonest tokens of the chunks first.

    The first ``COMMON`` tokens are bits of one number for each set, so what two sets share of them is a bit count; the others have postings of the
    questions that hold them. A question is open while the common tokens alone could still reach its k-th score; of the others only chunks that share a
    posting are scored: the others hold at most the common tokens of the question, and the score is at most their share of its size.
    """

    def __init__(self, sets: list[list[str] | None], often: dict[str, int]):
        held = [sorted(set(own or ())) for own in sets]
        words = sorted(set().union(*held), key=lambda t: (-often.get(t, 0), t))
        number = {t: k for k, t in enumerate(words)}
        self.vocabulary = pa.array(words, pa.string())
        self.sizes = np.array([len(own) for own in held], np.int64)
        question = np.repeat(np.arange(len(held)), self.sizes)
        token = np.array([number[t] for own in held for t in own], np.int64)
        self.masks = np.zeros(len(held), np.uint64)
        first = token < COMMON
        np.bitwise_or.at(self.masks, question[first], np.uint64(1) << token[first].astype(np.uint64))
        self.bound = np.divide(np.bitwise_count(self.masks), self.sizes, out=np.zeros(len(held)), where=self.sizes > 0)
        order = np.argsort(token[~first], kind="stable")
        self.postings = question[~first][order]
        self.heads = np.searchsorted(token[~first][order], np.arange(len(words) + 1))

    def shared(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk the size of its set and its common tokens; and by question and chunk, how many of the other tokens they share."""
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        chunk = np.repeat(np.arange(len(sizes)), sizes)[found >= 0]
        token = found[found >= 0].astype(np.int64)
        masks, first = np.zeros(len(sizes), np.uint64), token < COMMON
        np.bitwise_or.at(masks, chunk[first], np.uint64(1) << token[first].astype(np.uint64))
        chunk, token = chunk[~first], token[~first]
        counts = np.zeros(len(self.sizes) * len(sizes), np.int32)
        n = self.heads[token + 1] - self.heads[token]
        upto = np.cumsum(n)
        at = 0
        while at < len(token):  # a bounded number of postings at once
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, side="right")))
            own = n[at:end]
            place = np.arange(own.sum()) + np.repeat(self.heads[token[at:end]] - np.cumsum(own) + own, own)
            key = self.postings[place] * len(sizes) + np.repeat(chunk[at:end], own)
            counts += np.bincount(key, minlength=len(counts)).astype(np.int32)
            at = end
        return sizes, masks, counts.reshape(len(self.sizes), len(sizes))

    def jaccard(self, question: np.ndarray, chunk: np.ndarray, shared: tuple) -> np.ndarray:
        sizes, masks, counts = shared
        both = counts[question, chunk] + np.bitwise_count(self.masks[question] & masks[chunk])
        return np.divide(both, self.sizes[question] + sizes[chunk] - both, out=np.zeros(len(both)), where=both > 0)

    def all_pairs(self, tokens: pa.ListArray) -> np.ndarray:
        """Question by chunk; 0 where either set is empty."""
        shared = self.shared(tokens)
        question, chunk = np.indices(shared[2].shape).reshape(2, -1)
        return self.jaccard(question, chunk, shared).reshape(shared[2].shape)

    def candidates(self, tokens: pa.ListArray, floor: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, chunk, score) of the pairs that share a token and may reach the question's ``floor`` less ``slack``, which is what rounding may add."""
        shared = self.shared(tokens)
        look = shared[2] > 0
        look |= (self.bound >= floor - slack)[:, None] & (self.masks > 0)[:, None] & (shared[1] > 0)[None, :]
        question, chunk = np.nonzero(look)
        score = self.jaccard(question, chunk, shared)
        return question[score > 0], chunk[score > 0], score[score > 0]


def unit(vectors: list, size: int | None = None) -> np.ndarray:
    """Rows of length 1; null vectors, and those that are not of ``size`` (of the first one's), are 0."""
    size = next((len(v) for v in vectors if v is not None), 0) if size is None else size
    rows = np.array([v if v is not None and len(v) == size else [0.0] * size for v in vectors], float).reshape(len(vectors), size)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return np.divide(rows, norms[:, None], out=np.zeros_like(rows), where=norms[:, None] > 0)


class Kept:
    """The k best (score, chunk) of each question so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.chunk = k, np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)

    def offer(self, score: np.ndarray, chunks: np.ndarray) -> None:
        """Scores of a batch; what may not be kept is minus infinity."""
        use = np.flatnonzero((score.max(axis=1, initial=-np.inf) >= self.score[:, -1]) & (score.max(axis=1, initial=-np.inf) > -np.inf))
        if not len(use):
            return
        score = np.concatenate([self.score[use], score[use]], axis=1)
        own = np.concatenate([self.chunk[use], np.broadcast_to(chunks, (len(use), len(chunks)))], axis=1)
        if score.shape[1] > 4 * self.k:
            # what lies below the k-th cannot be kept; of what remains the sort settles ties
            floor = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            wide = int((score >= floor).sum(axis=1).max())
            take = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
            score, own = np.take_along_axis(score, take, 1), np.take_along_axis(own, take, 1)
        take = np.lexsort((-own, -score), axis=1)[:, : self.k]
        self.score[use], self.chunk[use] = np.take_along_axis(score, take, 1), np.take_along_axis(own, take, 1)

    def offer_pairs(self, question: np.ndarray, chunks: np.ndarray, score: np.ndarray) -> None:
        """The same for single pairs."""
        good = score >= self.score[question, -1]
        question, chunks, score = question[good], chunks[good], score[good]
        use = np.unique(question)
        held = np.repeat(use, self.k)
        question, chunks, score = np.concatenate([held, question]), np.concatenate([self.chunk[use].ravel(), chunks]), np.concatenate([self.score[use].ravel(), score])
        order = np.lexsort((-chunks, -score, question))
        question = question[order]
        place = np.arange(len(question)) - np.searchsorted(question, question)
        keep = place < self.k
        self.score[question[keep], place[keep]], self.chunk[question[keep], place[keep]] = score[order][keep], chunks[order][keep]


def top_hits(questions: DataFrame, chunks: DataFrame, k: int, *, weight: float | None = 1.0, word_weight: float | None = None, threshold: float | None = None, digits: int | None = None, block: int = BLOCK) -> DataFrame:
    """(q_id, chunk_seq, score, rank): the k best chunks of each question. questions (q_id, q_vec, qt), chunks (chunk_seq, vec, ct).

    ``weight`` is that of the cosine, ``word_weight`` (by default what is left to 1) that of the keyword overlap: with a ``weight`` of 1 alone tokens are not read; with None vectors are not, and pairs that share no
    token have no score. Scores below ``threshold`` are left out before ranking, which gives the same rows.
    """
    spark = questions.sparkSession
    by_vector, by_token = weight is not None, weight != 1.0 or bool(word_weight)
    word_weight = 1 - (weight or 0) if word_weight is None else word_weight
    asked = questions.select("q_id", *(["q_vec"] if by_vector else []), *(["qt"] if by_token else []))
    held = F.aggregate("qt", F.lit(0).cast("long"), lambda s, t: s + 8 + F.octet_length(t)) if by_token else F.lit(0)
    total, size = asked.agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    n = max(-(-2 * total // block) if total > block else 1, -(-2 * size // TOKEN_BYTES) if size > TOKEN_BYTES else 1)
    read = chunks.select(F.col("chunk_seq").cast("long").alias("chunk_seq"), *(["vec"] if by_vector else []), *(["ct"] if by_token else []))
    kind = asked.schema["q_id"].dataType.simpleString()
    found = []
    for part in range(n):
        own = (asked.where(F.pmod(F.xxhash64("q_id"), F.lit(n)) == part) if n > 1 else asked).collect()  # bounded: about half a block
        names = asked.columns
        tokens = TokenSets([r["qt"] for r in own], frequencies(read, {t for r in own for t in r["qt"] or ()})) if by_token else None
        shared = spark.sparkContext.broadcast(Asked([r["q_id"] for r in own], [r["q_vec"] for r in own] if "q_vec" in names else None, tokens))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            kept = Kept(len(block.ids), k)
            step = max(1, CELLS // max(1, len(block.ids)))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    seq, least = batch.column("chunk_seq").to_numpy(), -np.inf if threshold is None else threshold
                    if not by_vector:
                        question, place, score = block.tokens.candidates(batch.column("ct"), np.maximum(kept.score[:, -1], least), 10.0 ** -(DIGITS if digits is None else digits))
                        score = np.round(score, DIGITS if digits is None else digits)
                        good = score >= least
                        kept.offer_pairs(question[good], seq[place[good]], score[good])
                        continue
                    score = block.cosine(batch.column("vec").to_pylist())
                    if by_token:
                        score = weight * score + word_weight * block.tokens.all_pairs(batch.column("ct"))
                    score = np.round(score, DIGITS if digits is None else digits)
                    score[~(score >= least)] = -np.inf
                    kept.offer(score, seq)
            q, at = np.nonzero(kept.score > -np.inf)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array([block.ids[x] for x in q.tolist()]), pa.array(kept.chunk[q, at]), pa.array(kept.score[q, at])], ["q_id", "chunk_seq", "score"])

        hits = best(read.mapInArrow(run, HITS.format(kind)), k)
        if n > 1:
            hits = materialise(spark, hits, "hits")
            shared.destroy()
        found.append(hits)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_texts(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The hits with all columns of their question and chunk, but for the vectors and token sets."""
    return hits.join(chunks.drop("vec", "ct"), "chunk_seq").join(questions.drop("q_vec", "qt"), "q_id")


def vector_top_k(questions: DataFrame, chunks: DataFrame, k: int = 5, threshold: float | None = 0.0, digits: int | None = None) -> DataFrame:
    """questions (q_id, q_vec) against chunks (chunk_seq, vec), by cosine."""
    return with_texts(top_hits(questions, chunks, k, threshold=threshold, digits=digits), questions, chunks)


def frequencies(chunks: DataFrame, words: set[str]) -> dict[str, int]:
    """In how many chunks each of a block's tokens stands."""
    if not words:
        return {}
    shared = chunks.sparkSession.sparkContext.broadcast(pa.array(sorted(words), pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            found = pc.drop_null(pc.index_in(batch.column("ct").flatten(), value_set=shared.value)).to_numpy()
            counts += np.bincount(found, minlength=len(counts))
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(counts[own], pa.int64())], ["token", "n"])

    totals = chunks.select("ct").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()  # a row for each of the block's tokens
    return {shared.value[r["token"]].as_py(): r["n"] for r in totals}


def with_tokens(questions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and chunks with their token sets. Those of the chunks, and their vectors if they have some, are written: every block of questions, and the count before
    it, reads them, and no text is cut twice."""
    held = chunks.select("chunk_seq", T.ws_set(F.col("text")).alias("ct"), *(["vec"] if "vec" in chunks.columns else []))
    return questions.withColumn("qt", T.ws_set(F.col("question"))), materialise(chunks.sparkSession, held, "tokens")


def keyword_top_k(questions: DataFrame, chunks: DataFrame, k: int = 5, digits: int | None = None) -> DataFrame:
    """(q_id, chunk_seq, keyword_score, rank) by the Jaccard similarity of white-space tokens, among the pairs that share one."""
    return top_hits(*with_tokens(questions.drop("q_vec"), chunks.drop("vec")), k, weight=None, digits=digits).withColumnRenamed("score", "keyword_score")


def hybrid_top_k(questions: DataFrame, chunks: DataFrame, k: int = 5, weight: float = 0.7, digits: int | None = None, *, word_weight: float | None = None) -> DataFrame:
    """weight x cosine + word_weight (1 - weight by default) x keyword; questions (q_id, question, q_vec), chunks (chunk_seq, text, vec). Hits have both parts as vector_score and keyword_score."""
    q, c = with_tokens(questions, chunks)
    hits = top_hits(q, c, k, weight=weight, word_weight=1 - weight if word_weight is None else word_weight, digits=digits).withColumnRenamed("score", "combined_score")
    parts = hits.join(c, "chunk_seq").join(q.select("q_id", "q_vec", "qt"), "q_id")
    parts = parts.withColumns({"vector_score": F.coalesce(V.cosine(F.col("q_vec"), F.col("vec")), F.lit(0.0)), "keyword_score": F.coalesce(T.jaccard(F.col("qt"), F.col("ct")), F.lit(0.0))})
    return with_texts(parts.drop("vec", "ct", "q_vec", "qt"), questions, chunks)


def random_chunks(questions: DataFrame, chunks: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Seeded stand-in for a failed retrieval: the same k chunks for every question, with score 0."""
    few = chunks.orderBy(F.xxhash64("chunk_seq", F.lit(seed)), "chunk_seq").limit(k)
    return questions.crossJoin(F.broadcast(few)).withColumn("score", F.lit(0.0))  # bounded: k rows


def index_info(chunks: DataFrame, k: int, threshold: float) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks_indexed"), F.max(F.size("vec")).alias("embedding_dims")).withColumns({"top_k": F.lit(k), "similarity_threshold": F.lit(threshold)})


class Retriever(Protocol):
    """Takes questions (q_id, question, q_vec), chunks (chunk_seq, text, vec) and k, and gives the columns of both but for the vectors, with score and rank (from 1) in each question."""

    def __call__(self, questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame: ...


METHODS = {"vector-similarity": vector_top_k, "hybrid": hybrid_top_k}


def register(kind: str, own: Retriever) -> None:
    """Make a retrieval known under a name of its own, which settings can then give as their type."""
    if kind in METHODS:
        raise ValueError(f"there is a retrieval type {kind}")
    METHODS[kind] = own


def method(kind: str):
    if kind not in METHODS:
        raise ValueError(f"unknown retrieval type: {kind}")
    return METHODS[kind]


def query_vectors(questions: DataFrame, dim: int, embed: Column | None = None) -> DataFrame:
    """q_vec from the model's column, or from the question's digest."""
    return questions.withColumn("q_vec", V.md5_vector(F.col("question"), dim) if embed is None else embed)
