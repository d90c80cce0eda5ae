"""Language identification of mixed-language text.

Script ranges narrow the candidates of a word: a word is only compared for the languages whose training words use the script that
most of its letters are in (all languages if none does; of equally frequent scripts, the first in the word). For those, the word's score is the sum of the
log-probabilities of its character trigrams. A Viterbi pass over the words, with a penalty for every switch,
labels spans of text; the language that holds the most letters is the document's.

The model is a count of trigrams (in ``BUCKETS`` hash buckets) for each language over at most ``MAX_ROWS`` labelled rows; what
reaches the driver is at most languages x ``BUCKETS`` numbers.

Null text, empty text and text without any letter give ``und`` with score 0 and no spans; without a single
learned language every document is ``und``. Null ids are ordinary rows; repeated rows count and are answered
each time. Ties go to the language that sorts first. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import blocks, keep_rows, small_batches

BUCKETS = 32_768
#: Labelled rows that the classifier is fitted on at most, give or take the hash's spread.
MAX_ROWS = 20_000
#: Log-probability that one change of language costs.
SWITCH = 12.0
SMOOTH = 0.5
#: Words and letters that a word's score looks at; longer runs of letters are scored as pieces of this many.
PIECE = 40
CACHE = 400_000
#: Characters of the texts whose words are looked up together.
TOGETHER = 1_000_000
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))  # odd multipliers of the trigram hash
WORD = re.compile(r"[^\W\d_]+")
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])
OUT_DDL = "doc_id bigint, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"
#: First and last code point of the scripts, from the Unicode block table.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("ipa", 0x0250, 0x02FF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF),
)
_STARTS = np.array([a for _, a, _ in SCRIPTS])


@functools.cache
def script_of(char: str) -> str:
    code = ord(char)
    k = int(np.searchsorted(_STARTS, code, side="right")) - 1
    return SCRIPTS[k][0] if k >= 0 and code <= SCRIPTS[k][2] else "other"


def word_script(word: str) -> str:
    """The script of most letters of a word; the first of equals."""
    if word.isascii():
        return "latin"
    low, high = ord(min(word)), ord(max(word))
    for script, first, last in SCRIPTS:
        # all letters in one range
        if first <= low and high <= last:
            return script
    return Counter(script_of(c) for c in word if c.isalpha()).most_common(1)[0][0]


def trigrams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all words, with both ends marked, and where each word's begin: a word of n letters has n."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = np.frombuffer("".join(f"^{p}$" for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x = (codes[:-2] * M1 ^ codes[1:-1] * M2 ^ codes[2:] * M3) * M1
    ends = np.cumsum(sizes + 2)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return ((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[inside[:-2]], np.cumsum(sizes) - sizes


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[k : k + PIECE] for k in range(0, len(word), PIECE)]


def count_features(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, feature, n): trigram buckets, and scripts as features below 0."""
    small_batches(docs.sparkSession)
    names = sorted({s for s, _, _ in SCRIPTS} | {"other"})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        scripts: Counter = Counter()

        def flush(words: dict[str, Counter]) -> None:
            for tongue, seen in words.items():
                total = totals.setdefault(tongue, np.zeros(BUCKETS, np.int64))
                lettered = [(word, n) for word, n in seen.items() if any(map(str.isalpha, word))]
                for word, n in lettered:
                    scripts[tongue, word_script(word)] += n
                if lettered:
                    parts = [(part, n) for word, n in lettered for part in pieces(word)]
                    found, _ = trigrams([part for part, _ in parts])
                    np.add.at(total, found, np.repeat([n for _, n in parts], [len(part) for part, _ in parts]))

        words: dict[str, Counter] = {}
        held = 0
        for tongues, texts in blocks(batches):
            for tongue, body in zip(tongues, texts, strict=True):
                seen = words.setdefault(tongue, Counter())
                before = len(seen)
                seen.update(WORD.findall(body.lower()))
                held += len(seen) - before
            if held > CACHE:
                flush(words)
                words, held = {}, 0
        flush(words)
        for tongue, total in totals.items():
            at = np.flatnonzero(total)
            more = [(-1 - names.index(s), n) for (t, s), n in scripts.items() if t == tongue]
            yield pa.RecordBatch.from_arrays([pa.array([tongue] * (len(at) + len(more))), pa.array([*at.tolist(), *(f for f, _ in more)], pa.int32()), pa.array([*total[at].tolist(), *(n for _, n in more)], pa.int64())], ["lang", "feature", "n"])

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(count, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities (language x bucket), and for each script the languages that it leaves as candidates."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        self.langs = sorted({c[0] for c in counts})
        self.table = np.full((len(self.langs), BUCKETS), SMOOTH, np.float64)
        names = sorted({s for s, _, _ in SCRIPTS} | {"other"})
        uses = {s: np.zeros(len(self.langs)) for s in names}
        row = {x: k for k, x in enumerate(self.langs)}
        for tongue, feature, n in counts:
            if feature < 0:
                uses[names[-1 - feature]][row[tongue]] += n
            else:
                self.table[row[tongue], feature] += n
        self.table = np.log(self.table / self.table.sum(axis=1, keepdims=True))
        self.by_bucket = np.ascontiguousarray(self.table.T)
        words = sum(uses.values()) if self.langs else np.zeros(0)
        self.allowed, self.scripts = {}, {s: k for k, s in enumerate(uses)}
        for script, n in uses.items():
            share = n / np.maximum(words, 1)
            self.allowed[script] = share >= 0.001 if (share >= 0.001).any() else np.ones(len(self.langs), bool)
        self.by_script = np.array([self.allowed[s] for s in self.scripts])

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its log-probability in each language, less that in the best."""
        parts = [pieces(w) for w in words]
        found, starts = trigrams([p for ps in parts for p in ps])
        first = np.cumsum([0, *map(len, parts[:-1])])
        total = np.add.reduceat(self.by_bucket[found], starts[first], axis=0)
        allowed = self.by_script[[self.scripts[word_script(w)] for w in words]]
        total = np.where(allowed, total, total.min(axis=1, keepdims=True) - SWITCH)
        return total - total.max(axis=1, keepdims=True)


class Words(dict):
    """Number of each word seen lately, with its row of scores; a word without a letter has the number 0."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((1024, len(model.langs)))
        self.used = 1

    def learn(self, words: list[str]) -> None:
        """Score the words not seen yet, all at once."""
        fresh = []
        for word in [w for w in set(words) if w not in self]:
            if any(map(str.isalpha, word)):
                fresh.append(word)
            else:
                self[word] = 0
        if fresh:
            while self.used + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(fresh)] = self.model.scores(fresh)
            self.update(zip(fresh, range(self.used, self.used + len(fresh)), strict=True))
            self.used += len(fresh)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word. If no stretch favours another language by more than half the penalty, no switch can pay and the best
    single language is the answer; otherwise the full recursion runs. While one language leads by more than the penalty, every path goes through it, and
    the words that it is the best for (no other as good) change nothing of that: such a run is one step."""
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    floor = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    gain[1:] -= floor[:-1]
    if gain.max() <= switch / 2:
        return np.full(len(scores), best)
    tongues, n = scores.shape[1], len(scores)
    leader = np.where((scores == scores.max(axis=1, keepdims=True)).sum(axis=1) == 1, scores.argmax(axis=1), -1)
    edges = np.append(np.flatnonzero(np.diff(leader)) + 1, n)
    run_end = edges[np.searchsorted(edges, np.arange(n), side="right")].tolist()
    value, back, rows, t, leader, through = [0.0] * tongues, [], scores.tolist(), 0, leader.tolist(), [[k] * tongues for k in range(tongues)]
    while t < n:
        top = max(value)
        source = value.index(top)
        least = top - switch
        if leader[t] == source:
            value[source] = -math.inf
            if max(value) < least:
                end = run_end[t]
                back += [through[source]] * (end - t)
                value = [-math.inf] * tongues
                value[source] = top + sum([row[source] for row in rows[t:end]])
                t = end
                continue
            value[source] = top
        back.append([k if v >= least else source for k, v in enumerate(value)])
        value = [(v if v >= least else least) + s for v, s in zip(value, rows[t], strict=True)]
        t += 1
    path = np.empty(n, np.int64)
    at = value.index(max(value))
    for t in range(n - 1, -1, -1):
        path[t] = at
        at = back[t][at]
    return path


def certainty(scores: np.ndarray, own: int) -> float:
    """How surely words are in their language: a logistic function of its lead over the next."""
    total = scores.sum(axis=0)
    rest = np.delete(total, own)
    lead = total[own] - rest.max() if len(rest) else math.inf
    return 1 / (1 + math.exp(-min(max(lead, -50.0), 50.0)))


def label(text: str | None, known: Words) -> tuple[str, float, list[dict]]:
    """Language, score and spans of one text."""
    lang, score, _, spans = assess(text, known)
    return lang, score, spans


def assess(text: str | None, known: Words) -> tuple[str, float, float, list[dict]]:
    """Language, score, share of the letters that are surely in any language, and spans of one text."""
    return next(assess_all([text], known))


def assess_all(texts: list[str | None], known: Words) -> Iterator[tuple[str, float, float, list[dict]]]:
    """The same of many texts, taken together up to ``TOGETHER`` characters; a longer text is taken alone."""
    own: list[str | None] = []
    held = 0
    for text in texts:
        n = len(text) if text else 0
        if own and held + n > TOGETHER:
            yield from assess_together(own, known)
            own, held = [], 0
        own.append(text)
        held += n
    if own:
        yield from assess_together(own, known)


def assess_together(texts: list[str | None], known: Words) -> list[tuple[str, float, float, list[dict]]]:
    model = known.model
    out = [("und", 0.0, 0.0, [])] * len(texts)
    if not model.langs:
        return out
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    flat = list(chain.from_iterable(words))
    known.learn(flat)
    every = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    letters = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum([len(x) for x in words]).tolist()
    for k, (text, own, end) in enumerate(zip(texts, words, ends, strict=True)):
        cut = np.s_[end - len(own) : end]
        kept = every[cut] > 0
        if kept.any():
            scores = known.rows[every[cut][kept]]
            out[k] = verdict(model, text, len(own), kept, letters[cut][kept], scores, viterbi(scores))
    return out


def verdict(model: Model, text: str, n_words: int, kept: np.ndarray, letters: np.ndarray, scores: np.ndarray, path: np.ndarray) -> tuple[str, float, float, list[dict]]:
    """``assess`` from the best language of each word that has a letter (``kept`` of the words)."""
    held = np.bincount(path, weights=letters, minlength=len(model.langs))
    best = int(held.argmax())
    shares = {k: float(held[k] / held.sum()) * certainty(scores[path == k], k) for k in np.flatnonzero(held).tolist()}
    score, sure = shares[best], min(1.0, sum(shares.values()))
    if (path == path[0]).all():
        return model.langs[best], score, sure, [{"start": 0, "end": len(text), "lang": model.langs[best]}]
    changes = np.flatnonzero(np.diff(path)) + 1
    # lower-casing changes the length of a few letters: the places come from the text as it is
    places = [m.start() for m in WORD.finditer(text)]
    if len(places) != n_words:
        places = [m.start() for m in WORD.finditer(text.lower())]
    places = np.array(places)[kept]
    starts = [0, *places[changes].tolist()]
    ends = [*starts[1:], len(text)]
    tongues = [model.langs[path[k]] for k in (0, *changes.tolist())]
    return model.langs[best], score, sure, [{"start": s, "end": e, "lang": x} for s, e, x in zip(starts, ends, tongues, strict=True)]


def fit(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Learn from the rows with a text and a language; beyond ``max_rows`` of them, from about that many, chosen by a hash of the id."""
    n = docs.where(F.col(lang).isNotNull()).count()
    if n > max_rows:
        docs = docs.where(F.pmod(F.xxhash64(doc), F.lit(1_000_003)) < int(1_000_003 * max_rows / n))
    return Model([tuple(r) for r in count_features(docs, text, lang).toLocalIterator()])


def identify(docs: DataFrame, model: Model, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: share of letters in that language, times how surely it beats the next) and spans."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(held.value)
        for ids, texts in blocks(batches):
            if len(known) > CACHE:
                known = Words(held.value)
            out = [(lang, score, spans) for lang, score, _, spans in assess_all(texts, known)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], OUT.field("spans").type)], schema=OUT)

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, OUT_DDL)


def keep_identified(docs: DataFrame, model: Model, least: float, *, text: str = "text") -> DataFrame:
    """The rows of which at least the share ``least`` of the letters is surely in some learned language, be it one or several; with all columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known = [Words(held.value)]

        def judge(texts: list[str | None]) -> list[bool]:
            if len(known[0]) > CACHE:
                known[0] = Words(held.value)
            return [found[0] != "und" and found[2] >= least for found in assess_all(texts, known[0])]

        return judge

    return keep_rows(docs, start, text)


def training_rows(docs: DataFrame, remainder: Column) -> DataFrame:
    """Rows whose remainder is known and not 0."""
    return docs.where(remainder != 0)
