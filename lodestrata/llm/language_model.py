"""Scores of whole documents under a gated recurrent language model and a smoothed unigram base.

Tokens: a text is lower-cased (A-Z), cut into words of ``[^\\x20\\x09-\\x0D]+``, and closed by one end token.

Counts: every training document is counted; tokens are carried as 64-bit hashes (of a billion distinct tokens, two share a hash with a chance of 3 %). The most frequent tokens, at most
``HEAD``, travel to the workers as two sorted arrays; the counts of all others are joined to the documents that hold them.

Network: the ``CLASSES * CLASSES - 2`` most frequent words have an input vector and an output word; the rest is one unknown word whose
probability is shared out by the base. One GRU layer; the output is factored into classes of ``CLASSES`` words of neighbouring
frequency. Documents stand end to end in parallel streams that advance together, with the state carried from window to window and reset where a
document begins, so a score is the whole document's log-likelihood. Training is truncated backpropagation over windows:
the training documents are dealt over ``SHARE`` rounds, whole, so that each is learned from at least once. In each round every partition trains
on its own documents of the round from the same weights, and the weights are averaged, by the words seen, in a tree of sums. What is gathered grows with the partitions, so with the corpus.

Null and empty texts are one end token. Null ids are never training rows and are not held out; repeated rows count
and are scored each time. With no training row N and V are 0: the base is then log10 of 0.1 / 0.1 for every token, which is 0, and so is the
network's part. Very long texts take a stream of their own. Only the id and text columns are read. ``encode`` writes the documents as numbers once, so that training
and scoring read those instead of the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import hold_memory, id_bucket, materialise, release, small_batches

HEAD = 1 << 20
CLASSES = 64
HIDDEN = 24
STREAMS = 256
WINDOW = 32
ROUNDS = 2
#: Rounds over which the training documents are dealt; further rounds see them again.
SHARE = 2
LEARN_RATE = 0.003
#: Steps over which the rate of a partition's training rises.
WARM = 50
END = b" end"
#: Partial sums of weights that one task adds up.
FAN = 16
#: Words whose probabilities are taken together in scoring.
SETTLE = 32_768
LN10 = float(np.log(10))


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know A-Z and the six ASCII white spaces only, as the token rule asks. ``cut`` does the same for many texts."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_of(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


END_HASH = hash_of(END)


def hashes_of(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64).view(np.int64)


def text_blocks(batches: Iterable[pa.RecordBatch], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The rows (doc_id, text) again, in pieces of bounded text (a single longer text is a piece of its own)."""
    hold_memory()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end
    release()


def cut(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens of some texts, the last of them the end, then all tokens as places in that list, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    at, sizes = coded.indices.to_numpy(), parts.value_lengths().to_numpy().astype(np.int64)
    if b"" in words:
        # white space before the first word and after the last is cut off as an empty one, and so is an empty text
        real, edges = at != words.index(b""), np.cumsum(sizes) - sizes
        sizes = np.add.reduceat(real, edges, dtype=np.int64)
        at = at[real]
    sizes += 1
    tokens = np.full(len(at) + len(sizes), len(words), np.int32)
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(sizes) - 1] = False
    tokens[inside] = at
    return [*words, END], tokens, sizes


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, n) of all tokens of ``docs`` (doc_id, text): summed in each block, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            distinct, tokens, _ = cut(block.column(1))
            n = np.bincount(tokens, minlength=len(distinct))
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(hashes_of(distinct)[seen]), pa.array(n[seen])], ["h", "n"])

    return docs.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Head tokens (sorted hashes with their counts), corpus totals and the network's words."""

    def __init__(self, h: np.ndarray, n: np.ndarray, total: int, distinct: int):
        order = np.argsort(h)
        self.h, self.n = h[order], n[order]
        self.total, self.distinct = total, distinct
        self.mass = total + 0.1 * (distinct + 1)
        best = np.lexsort((self.h, -self.n))
        best = best[self.h[best] != END_HASH][: CLASSES * CLASSES - 2]
        #: network word of each head token: 0 unknown, 1 end, then by frequency
        self.word = np.zeros(len(self.h), np.int32)
        self.word[best] = np.arange(2, len(best) + 2)
        self.word[self.h == END_HASH] = 1
        self.freq = np.zeros(CLASSES * CLASSES)
        np.add.at(self.freq, self.word[self.word > 0], self.n[self.word > 0])
        known = self.freq[1:].sum() + 0.1 * (self.word > 0).sum()
        self.unknown_mass = max(1e-12, 1 - known / self.mass) if self.mass else 1.0
        self.freq[0] = max(1.0, total - self.freq[1:].sum())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the head, -1 if it is not there."""
        if not len(self.h):
            return np.full(len(h), -1)
        order = np.argsort(h)
        at = np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(self.h, h[order]), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


class Network:
    """The weights, by name, and the words they were trained on. The gates stand in the order update, reset, candidate."""

    SHAPES = {"E": (CLASSES * CLASSES, HIDDEN), "Wx": (HIDDEN, 3 * HIDDEN), "Wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "Wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "Wo": (CLASSES, HIDDEN, CLASSES), "bo": (CLASSES, CLASSES)}

    def __init__(self, flat: np.ndarray):
        self.flat, self.seen, at = flat, 0, 0
        self.w: dict[str, np.ndarray] = {}
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            self.w[name] = flat[at : at + size].reshape(shape)
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    @classmethod
    def fresh(cls, freq: np.ndarray, seed: int = 11) -> Network:
        """Small random weights; output biases are the words' log frequencies, so that training starts from the unigram."""
        rng = np.random.default_rng(seed)
        net = cls((rng.normal(size=cls.size()) * 0.1).astype(np.float32))
        f = freq.reshape(CLASSES, CLASSES) + 0.5
        net.w["b"][:] = 0
        net.w["Wc"][:] *= 0.1
        net.w["Wo"][:] *= 0.1
        net.w["bc"][:] = np.log(f.sum(axis=1) / f.sum())
        net.w["bo"][:] = np.log(f / f.sum(axis=1, keepdims=True))
        return net

    def gates(self, name: str) -> np.ndarray:
        """A weight matrix of all gates, gate first."""
        return np.ascontiguousarray(self.w[name].reshape(-1, 3, HIDDEN).swapaxes(0, 1))

    def inputs(self, words: np.ndarray | slice = np.s_[:]) -> np.ndarray:
        """What the words add to the gates, [gate, word, unit]; negative where the logistic function will be taken."""
        found = np.matmul(self.w["E"][words], self.gates("Wx"))
        found += self.w["b"].reshape(3, 1, HIDDEN)
        np.negative(found[:2], out=found[:2])
        return found

    @np.errstate(over="ignore")
    def forward(self, x: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool = False, inputs: np.ndarray | None = None):
        """States after each step of a window, and the last; with ``keep`` the gates and the inner products of all steps as well.
        ``x``: input words, ``first``: where a document begins, both [steps, streams]."""
        kind, (steps, width) = self.flat.dtype, x.shape
        if inputs is None:
            words, x = np.unique(x, return_inverse=True)
            inputs = self.inputs(words)
        xw = np.take(inputs, x.reshape(steps, width), axis=1)
        wh = self.gates("Wh")
        np.negative(wh[:2], out=wh[:2])
        out = np.empty((steps, width, HIDDEN), kind)
        gates, inner = np.empty((2, steps if keep else 1, 3, width, HIDDEN), kind)
        begins, stays = first.any(axis=1).tolist(), (~first)[:, :, None]
        h = h.astype(kind)
        for t in range(steps):
            g, hw = gates[t if keep else 0], inner[t if keep else 0]
            if begins[t]:
                h = h * stays[t]
            np.matmul(h, wh, out=hw)
            zr, c = g[:2], g[2]
            np.add(xw[:2, t], hw[:2], out=zr)
            # the logistic function is 1 / (1 + exp(-x)), and tanh(x) is 1 - 2 / (1 + exp(2 x)): exp takes half of the library's tanh
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[1], hw[2], out=c)
            c += xw[2, t]
            c *= 2
            np.exp(c, out=c)
            c += 1
            np.divide(-2, c, out=c)
            c += 1
            new = np.subtract(h, c, out=out[t])
            new *= zr[0]
            new += c
            h = new
        return out, h, (gates, inner)

    def log_probs(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probability of the words ``y`` [n] after ``states`` [n, HIDDEN]."""
        top = Output(self)
        order, c, k, edges = by_class(y)
        rows = with_one(states, order)
        back = np.empty(len(y), self.flat.dtype)
        back[order] = top.chosen(rows @ top.classes, c) + top.chosen(top.inner(rows, edges), k)
        return back

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the mean log-probability over a window (truncated: nothing flows into what came before), and the last state."""
        w, n, kind = self.w, HIDDEN, self.flat.dtype
        # the words of the window, and where each cell's stands among them
        x_shape = x.shape
        held = np.bincount(x.reshape(-1), minlength=CLASSES * CLASSES)
        words = np.flatnonzero(held)
        held[words] = np.arange(len(words))
        x = held[x.reshape(-1)]
        states, last, (gates, inner) = self.forward(x.reshape(x_shape), first, h, keep=True, inputs=self.inputs(words))
        grad = Network(np.zeros_like(self.flat))
        g = grad.w
        on = np.flatnonzero(live.reshape(-1))
        scale = 1 / max(1, len(on))
        top = Output(self)
        order, c, k, edges = by_class(y.reshape(-1)[on])
        rows = with_one(states.reshape(-1, n), on[order])
        d = top.surprise(rows @ top.classes, c, scale)
        found = rows.T @ d
        g["Wc"][:], g["bc"][:] = found[:-1], found[-1]
        rows_back = d @ top.classes_back
        d = top.surprise(top.inner(rows, edges), k, scale)
        found, more = np.zeros_like(top.words), np.empty_like(rows_back)
        for own, a, b in edges:
            np.matmul(rows[a:b].T, d[a:b], out=found[own])
            np.matmul(d[a:b], top.words_back[own], out=more[a:b])
        rows_back += more
        g["Wo"][:], g["bo"][:] = found[:, :-1], found[:, -1]
        back = np.zeros((states.shape[0] * states.shape[1], n), kind)
        back[on[order]] = rows_back
        back = back.reshape(states.shape)
        was = np.concatenate([h.astype(kind)[None], states[:-1]])
        was[first] = 0
        z, r, cand = gates.swapaxes(0, 1)
        # the gradient at candidate, update, reset and at the candidate's inner product, all as multiples of that at the state
        times = np.empty((4, *states.shape), kind)
        of_c, of_z, of_r, of_inner = times
        rest = 1 - z
        np.multiply(cand, cand, out=of_c)
        np.subtract(1, of_c, out=of_c)
        of_c *= rest
        np.subtract(was, cand, out=of_z)
        of_z *= z
        of_z *= rest
        np.multiply(of_c, r, out=of_inner)
        np.subtract(1, r, out=of_r)
        of_r *= inner[:, 2]
        of_r *= of_inner
        wh = np.ascontiguousarray(self.gates("Wh").swapaxes(1, 2))
        dh, flow = np.zeros(states.shape[1:], kind), np.empty((3, *states.shape[1:]), kind)
        begins, stays = first.any(axis=1).tolist(), (~first)[:, :, None]
        for t in range(len(first) - 1, -1, -1):
            dh += back[t]
            own = np.multiply(dh, times[:, t], out=times[:, t])
            np.matmul(own[1:], wh, out=flow)
            dh *= z[t]
            dh += flow[0]
            dh += flow[1]
            dh += flow[2]
            if begins[t]:
                dh *= stays[t]
        flat = times.reshape(4, -1, n)
        g["Wh"][:] = np.matmul(was.reshape(-1, n).T, flat[1:]).swapaxes(0, 1).reshape(n, 3 * n)
        # input gradients are summed by word before anything is multiplied
        cell = np.take(np.arange(len(words) * n).reshape(-1, n), x, axis=0).reshape(-1)
        known, wx, dx, de = w["E"][words], self.gates("Wx"), [], 0
        for plane, gate in ((1, 0), (2, 1), (0, 2)):
            sums = np.bincount(cell, weights=flat[plane].reshape(-1), minlength=len(words) * n).astype(kind).reshape(-1, n)
            dx.append(known.T @ sums)
            de = de + sums @ wx[gate].T
            g["b"][gate * n : (gate + 1) * n] = sums.sum(axis=0)
        g["Wx"][:] = np.concatenate(dx, axis=1)
        g["E"][words] = de
        return grad.flat, last


class Output:
    """Output weights of the classes and of the words in each class, with the bias as a last row."""

    def __init__(self, net: Network):
        w = net.w
        self.classes = np.concatenate([w["Wc"], w["bc"][None]])
        self.words = np.concatenate([w["Wo"], w["bo"][:, None]], axis=1)
        self.classes_back = np.ascontiguousarray(w["Wc"].T)
        self.words_back = np.ascontiguousarray(w["Wo"].swapaxes(1, 2))
        # states lie between -1 and 1, so no output is larger than this
        self.small = max(np.abs(self.classes).sum(axis=0).max(), np.abs(self.words).sum(axis=1).max()) < 60
        self.ones = np.ones(CLASSES, net.flat.dtype)

    def inner(self, rows: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
        """Outputs of the words of each row's class."""
        out = np.empty((len(rows), CLASSES), rows.dtype)
        for own, a, b in edges:
            np.matmul(rows[a:b], self.words[own], out=out[a:b])
        return out

    def exponents(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
        """exp of the rows, in place, less their largest value if any may be large; the sums of the rows, and what was taken off."""
        largest = 0.0
        if not self.small:
            largest = s.max(axis=1)
            s -= largest[:, None]
        e = np.exp(s, out=s)
        return e, e @ self.ones, largest

    def chosen(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log of the softmax of each row at one place."""
        own = s.reshape(-1)[np.arange(len(at)) * CLASSES + at]
        _, total, largest = self.exponents(s)
        return own - largest - np.log(total)

    def surprise(self, s: np.ndarray, at: np.ndarray, scale: float) -> np.ndarray:
        """Gradient of the log-softmax at one place of each row, times ``scale``."""
        e, total, _ = self.exponents(s)
        e *= (-scale / total)[:, None]
        e.reshape(-1)[np.arange(len(at)) * CLASSES + at] += scale
        return e


def by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The order that sorts words by class, their classes and places in the class in that order, and (class, from, to) of every class."""
    c, k = np.divmod(y, CLASSES)
    order = np.argsort(c.astype(np.uint8), kind="stable")
    c, k = c[order], k[order]
    at = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    return order, c, k, [(own, a, b) for own, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]


def with_one(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rows of ``states`` in an order, with a last column of ones, for the bias."""
    rows = np.empty((len(order), states.shape[1] + 1), states.dtype)
    rows[:, :-1] = np.take(states, order, axis=0)
    rows[:, -1] = 1
    return rows


def streams(sizes: np.ndarray, width: int) -> list[list[int]]:
    """Documents dealt to at most ``width`` streams of like length: longest first, each to the shortest stream; streams from long to short."""
    from heapq import heapify, heappop, heappush

    held = [(0, k, []) for k in range(min(width, len(sizes)))]
    heapify(held)
    for d in np.argsort(-sizes, kind="stable").tolist():
        n, k, docs = heappop(held)
        docs.append(d)
        heappush(held, (n + int(sizes[d]), k, docs))
    return [docs for _, _, docs in sorted(held, key=lambda x: (-x[0], x[1]))]


def windows(words: list[np.ndarray], width: int, steps: int):
    """Windows over the streams: input words, target words, where documents begin, what is live, document of each cell. The
    input before a document's first word is the end token. Streams that have ended are left out of later windows."""
    sizes = np.array([len(x) for x in words])
    dealt = streams(sizes, width)
    lengths = [int(sizes[s].sum()) for s in dealt]
    longest = lengths[0] if lengths else 0
    target = np.zeros((longest, len(dealt)), np.int32)
    doc = np.full((longest, len(dealt)), -1, np.int32)
    first = np.zeros((longest, len(dealt)), bool)
    for k, s in enumerate(dealt):
        if s:
            target[: lengths[k], k] = np.concatenate([words[d] for d in s])
            doc[: lengths[k], k] = np.repeat(s, sizes[s])
            first[np.concatenate([[0], np.cumsum(sizes[s])[:-1]]), k] = True
    source = np.concatenate([np.ones((1, len(dealt)), np.int32), target[:-1]]) if longest else target
    source = np.where(first, 1, source)
    for t in range(0, longest, steps):
        n = sum(length > t for length in lengths)
        cut = np.s_[t : t + steps, :n]
        yield source[cut], target[cut], first[cut], doc[cut] >= 0, doc[cut]


def train_partition(net: Network, shards: Iterator[list[np.ndarray]]) -> tuple[np.ndarray, int]:
    """Weights after one pass (Adam over the windows of each shard), and the words seen."""
    net = Network(net.flat.copy())
    m, v, t, seen = np.zeros_like(net.flat), np.zeros_like(net.flat), 0, 0
    step = np.empty_like(net.flat)
    for words in shards:
        h = np.zeros((min(STREAMS, len(words)), HIDDEN), np.float32)
        for x, y, first, live, _ in windows(words, STREAMS, WINDOW):
            g, h = net.gradient(x, first, y, live, h[: x.shape[1]])
            t += 1
            # the moments are kept ten and a thousand times as large, which saves two passes
            m *= 0.9
            m += g
            v *= 0.999
            g *= g
            v += g
            np.sqrt(v, out=step)
            spread = np.sqrt(0.001 / (1 - 0.999**t))
            step += 1e-7 / spread
            np.divide(m, step, out=step)
            step *= 0.1 * LEARN_RATE * min(1, t / WARM) / (1 - 0.9**t) / spread
            net.flat += step
            seen += int(live.sum())
    return net.flat, seen


def score_shard(net: Network, words: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document's network words."""
    total = np.zeros(len(words))
    h = np.zeros((min(STREAMS, len(words)), HIDDEN), np.float32)
    inputs, held, n = net.inputs(), [], 0

    def settle() -> None:
        states, y, doc = (np.concatenate(v) for v in zip(*held, strict=True))
        total[:] += np.bincount(doc, weights=net.log_probs(states, y), minlength=len(words))

    for x, y, first, live, doc in windows(words, STREAMS, WINDOW):
        states, h, _ = net.forward(x, first, h[: x.shape[1]], inputs=inputs)
        on = live.reshape(-1)
        held.append((states.reshape(-1, HIDDEN)[on], y.reshape(-1)[on], doc.reshape(-1)[on]))
        n += len(held[-1][1])
        if n >= SETTLE:
            settle()
            held, n = [], 0
    if held:
        settle()
    return total / LN10


def words_in(packed: Iterable[bytes]) -> list[np.ndarray]:
    """Network words of the documents of an encoded table."""
    return [np.frombuffer(p, np.int16).astype(np.int32) for p in packed]


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Every document (doc_id, text) in numbers, written once: row, doc_id, words (the network's, two bytes each), n_tokens, n_head (tokens in the
    head), base (their log10 probability), unknown (what of it the network does not know), and the hashes of the other tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        value = np.log10((own.n + 0.1) / own.mass) if own.mass else np.zeros(0)
        spread = np.log10(own.unknown_mass)
        for block in text_blocks(batches):
            distinct, tokens, sizes = cut(block.column(1))
            # looked up once for each distinct token of the block
            h = hashes_of(distinct)
            place = own.find(h)
            head, place = place >= 0, np.maximum(place, 0)
            word = np.where(head, own.word[place], 0).astype(np.int16) if len(value) else np.zeros(len(h), np.int16)
            base = np.where(head, value[place], 0.0) if len(value) else np.zeros(len(h))
            rest = np.where(word == 0, base - spread, 0.0) if own.total else np.zeros(len(h))
            edges = np.concatenate([[0], np.cumsum(sizes)])
            by_doc = np.repeat(np.arange(len(sizes)), sizes)
            add = lambda x, by_doc=by_doc, at=tokens, n=len(sizes): np.bincount(by_doc, weights=x[at], minlength=n)
            tail = np.flatnonzero(~head[tokens])
            tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(tail, edges), pa.int32()), pa.array(h[tokens[tail]], pa.int64()))
            packed = word[tokens].tobytes()
            parts = [packed[2 * a : 2 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(parts, pa.binary()), pa.array(sizes), pa.array(add(head).astype(np.int64)), pa.array(add(base)), pa.array(add(rest)), tails], ["doc_id", "words", "n_tokens", "n_head", "base", "unknown", "tail"])

    rows = docs.mapInArrow(run, "doc_id bigint, words binary, n_tokens bigint, n_head bigint, base double, unknown double, tail array<bigint>")
    return materialise(spark, rows.withColumn("row", F.monotonically_increasing_id()), "encoded")


def word_blocks(batches: Iterable[pa.RecordBatch], column: int, most: int = 1_200_000) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """(batches, network words of their rows) in blocks of bounded words; a batch is not cut."""
    hold_memory()
    held: list[pa.RecordBatch] = []
    words: list[np.ndarray] = []
    n = 0
    for batch in batches:
        held.append(batch)
        own = words_in(batch.column(column).to_pylist())
        words += own
        n += sum(map(len, own))
        if n >= most:
            yield held, words
            held, words, n = [], [], 0
    if held:
        yield held, words
    del held, words
    release()


def averaged(rows: DataFrame, parts: int) -> DataFrame:
    """Sum of the (weights, n) rows of ``parts`` partitions, in as many steps of ``FAN`` to one as it takes; each task holds one running sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0.0
        for batch in batches:
            for w, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                row = np.frombuffer(w.as_buffer(), np.float64)
                total = row.copy() if total is None else total + row
                count += n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([count])], ["w", "n"])

    while parts > 1:
        parts = -(-parts // FAN)
        rows = rows.repartition(parts).mapInArrow(add, "w binary, n double")
    return rows


def train(encoded: DataFrame, freq: np.ndarray, rounds: int = ROUNDS, share: int = SHARE) -> Network:
    """``encoded``: the training rows of an encoded table. No fewer than ``share`` rounds, so no document is left out."""
    spark = encoded.sparkSession
    net = Network.fresh(freq)
    turn = F.floor(F.crc32(F.col("doc_id").cast("string")) / 10) % share
    for k in range(max(rounds, share)):
        start = spark.sparkContext.broadcast(net.flat)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            flat, n = train_partition(Network(start.value), (words for _, words in word_blocks(batches, 0)))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([(flat.astype(np.float64) * n).tobytes()], pa.binary()), pa.array([float(n)])], ["w", "n"])

        own = encoded.where(turn == k % share).select("words")
        found = averaged(own.mapInArrow(run, "w binary, n double"), own.rdd.getNumPartitions()).first()
        if found:
            seen = net.seen + int(found["n"])
            net = Network((np.frombuffer(found["w"], np.float64) / found["n"]).astype(np.float32))
            net.seen = seen
    return net


def count(docs: DataFrame, head: int = HEAD) -> tuple[DataFrame, Vocabulary]:
    """Counts of all tokens (h, n) of the training rows ``docs`` (doc_id, text), and the vocabulary."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = materialise(spark, count_tokens(docs), "token-counts")
    size = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(size.alias("level")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # at most 8 rows for each doubling of n
    total, distinct = sum(r["n"] for r in levels), sum(r["v"] for r in levels)
    cut, held = None, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["v"]
        if held > head:
            break
        cut = r["level"]
    # bounded: at most ``head`` rows
    top = counts.where(size >= cut).toArrow() if cut is not None else pa.table({"h": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    return counts, Vocabulary(top["h"].to_numpy(), top["n"].to_numpy(), total, distinct)


def fit(docs: DataFrame, *, head: int = HEAD, rounds: int = ROUNDS, share: int = SHARE) -> tuple[DataFrame, Vocabulary, Network]:
    """Counts of all tokens (h, n), the vocabulary and the network, from the training rows ``docs`` (doc_id, text)."""
    counts, vocabulary = count(docs, head)
    return counts, vocabulary, train(encode(docs, vocabulary), vocabulary.freq, rounds, share)


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, net: Network, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    return score_encoded(encode(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")), vocabulary), counts, vocabulary, net)


def score_encoded(encoded: DataFrame, counts: DataFrame, vocabulary: Vocabulary, net: Network) -> DataFrame:
    """The same from an encoded table."""
    weights, learned = encoded.sparkSession.sparkContext.broadcast(net.flat), bool(vocabulary.total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(weights.value)
        for held, words in word_blocks(batches, 0):
            found, at = score_shard(model, words) if learned else np.zeros(len(words)), 0
            for batch in held:
                own = found[at : at + batch.num_rows]
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own)], [*batch.schema.names[1:], "network"])

    names = ["row", "doc_id", "n_tokens", "n_head", "base", "unknown"]
    rows = encoded.select("words", *names).mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, n_head bigint, base double, unknown double, network double")
    mass, spread = float(vocabulary.mass or 0.1), float(np.log10(vocabulary.unknown_mass)) if learned else 0.0
    if learned:
        tokens = encoded.select("row", F.explode("tail").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k"))
        tokens = tokens.join(counts, "h", "left")
        c = F.coalesce("n", F.lit(0))
        tails = tokens.groupBy("row").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10((c + 0.1) / F.lit(mass))).alias("more"), F.sum("k").alias("more_tokens"))
        rows = rows.join(tails, "row", "left")
    else:
        rows = rows.withColumns({"more_known": F.lit(0), "more": F.lit(0.0), "more_tokens": F.lit(0)})
    more = F.coalesce("more", F.lit(0.0))
    return rows.select(
        "doc_id", "n_tokens", (F.col("n_head") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("network") + F.col("unknown") + more - F.coalesce("more_tokens", F.lit(0)) * F.lit(spread)).alias("score"),
    )


def training_rows(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Rows whose crc32 remainder is known and not 0."""
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where(id_bucket("doc_id", folds) != 0)

