"""Alignment of two tokenizers' tokens by an event sweep, and how often their ids stand together in the corpus.

Every token ends at a byte of its text. The end events of tokenizer A (byte-level, over a space and the text) and of B (pieces, which puts that space itself)
are one table, dealt by document and sorted by offset within partitions. A machine reads the sorted stream: it holds the tokens since the last offset at which
both tokenizers end, and closes a group there. In a group every event links the A token and the B token that cover the bytes before it, so
the links are the overlapping pairs, each once. An event is a token id of two bytes; as an id tells its token's length, a row packs up to ``WINDOW`` consecutive events of
one side with the offset where they begin, and the machine works on the rows of many documents at once.

The machine gives a document's digest and its distinct linked pairs with their numbers. Documents are numbered into chunks of at most ``CHUNK`` pairs and rows. A
chunk's distinct pairs are counted over documents, summed over the corpus, and joined back to the chunks that hold them, so what is shuffled by
pair is a fraction of the links, a frequent pair has one row for each chunk, and no table of all pairs is ever in one place.

Tokens come from words: neither tokenizer joins a single space between other characters to what precedes it, so a text is cut there and words are remembered with
their tokens of both sides. With a model of pieces that may join them, whole texts are tokenized. Special tokens' strings are ordinary text.

A null or empty text, and one whose tokens' bytes are not its own on either side (such as texts with U+2581), has no tokens: zeros and an empty digest.
Null ids, repeated ids and repeated rows are ordinary: every row is a document of its own. Further columns are not read. Of a very long text the machine holds its distinct
pairs, and tokens only since the last common end; the tokenizers hold the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import pieces
from lodestrata.llm.common import blocks, materialise, release, small_batches
from lodestrata.llm.token_counts import PATTERN, byte_letters

#: Events of one row; tokens that the machine works on at once; pairs and documents of a chunk; remembered words.
WINDOW = 16_384
ROUND = 1_500_000
CHUNK = 1_000_000
CHUNK_ROWS = 10_000
CACHE = 400_000
#: Ids have two bytes.
IDS = 65_536
CUT = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile(r"\s\s|^\s|\s$")
EVENTS = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("side", pa.int8()), ("doc_id", pa.int64()), ("ids", pa.binary())])
EVENTS_DDL = "row bigint, at bigint, side tinyint, doc_id bigint, ids binary"
SWEPT = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()),
])
SWEPT_DDL = "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
ALIGNED = [("doc_id", "bigint"), ("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("n_best", "bigint"), ("count_sum", "bigint"), ("groups_sha256", "string")]


class Words:
    """Ids of both tokenizers for words with one space before them, remembered in pools."""

    def __init__(self, path_a: str, path_b: str, cache: int = CACHE):
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)["model"]
        back = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        special = [t for t in spec["vocab"] if any(c not in back for c in t)]
        vocabulary = {b"".join(map(back.__getitem__, t)): k for t, k in spec["vocab"].items() if t not in special}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["merges"]]
        if any(spec["vocab"][m] != 256 + k for k, m in enumerate(merged)):
            raise ValueError("the ids of the vocabulary must follow its merges")
        ranks = {t: k for t, k in vocabulary.items() if len(t) == 1 or k < 256 + len(merged)}
        self.bytes_a = {k: t for t, k in ranks.items()}
        self.a = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        own = pieces.encoder(path_b)
        self.by_word, self.b, self.b_whole = own.by_word, own.inner, own.model
        size = own.model.get_piece_size()
        piece = lambda k: bytes([int(own.model.id_to_piece(k)[3:-1], 16)]) if own.model.is_byte(k) else own.model.id_to_piece(k).replace(pieces.MARK, " ").encode()
        self.bytes_b = dict(enumerate(map(piece, range(size))))
        if max(max(self.bytes_a), size - 1) >= IDS:
            raise ValueError(f"vocabularies of more than {IDS} ids")
        self.sizes = tuple(lengths(b) for b in (self.bytes_a, self.bytes_b))
        self.cache = cache
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.wrong: set[int] = set()
        self.pools = [Pool(), Pool()]

    def learn(self, words: list[str]) -> None:
        spaced = [" " + w for w in words]
        a = list(map(self.a.encode_ordinary, spaced))
        b = self.b.encode(spaced, num_threads=1) if self.by_word else self.b_whole.encode(words, num_threads=1)
        for word, text, own_a, own_b in zip(words, spaced, a, b, strict=True):
            number = self.number[word] = len(self.number)
            data = text.encode("utf-8", "surrogatepass")
            if b"".join(map(self.bytes_a.__getitem__, own_a)) != data or b"".join(map(self.bytes_b.__getitem__, own_b)) != data:
                self.wrong.add(number)
        self.pools[0].add(a)
        self.pools[1].add(b)

    def cut(self, text: str) -> list[str]:
        if not self.by_word:
            return [text]
        return CUT.split(text) if ODD_SPACE.search(text) else text.split(" ")

    def tokens(self, texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[bool]]:
        """(ids, edges of texts) of both sides, and which texts have tokens."""
        cut = [self.cut(t) if t else [] for t in texts]
        fresh = set().union(*cut).difference(self.number)
        if fresh and len(self.number) + len(fresh) > self.cache:
            self.forget()
            fresh = set().union(*cut)
        if fresh:
            self.learn(sorted(fresh))
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64)
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        good = [bool(t) for t in texts]
        if self.wrong:
            bad = np.isin(number, np.fromiter(self.wrong, np.int64, len(self.wrong)))
            for k in np.unique(np.searchsorted(edges, np.flatnonzero(bad), side="right") - 1).tolist():
                good[k] = False
        return [pool.take(number, edges) for pool in self.pools], good


class Pool:
    """Lists of ids end to end."""

    def __init__(self):
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.uint16), np.zeros(1, np.int64), 0

    def add(self, rows: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        need = self.used + int(sizes.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(need, np.uint16)])
        self.ids[self.used : need] = np.fromiter(chain.from_iterable(rows), np.uint16, need - self.used)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes)])
        self.used = need

    def take(self, number: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.starts[number + 1] - self.starts[number]
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(total[-1]) + np.repeat(self.starts[number] - total[:-1], size)
        return self.ids[at], total[edges]


def lengths(tokens: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(IDS, np.int64)
    out[list(tokens)] = list(map(len, tokens.values()))
    return out


_WORDS: dict[tuple[str, str], Words] = {}


def tokenizers(path_a: str, path_b: str) -> Words:
    """One pair for each worker process, kept between tasks."""
    if (path_a, path_b) not in _WORDS:
        _WORDS[path_a, path_b] = Words(path_a, path_b)
    return _WORDS[path_a, path_b]


def end_events(docs: DataFrame, path_a: str, path_b: str, *, doc: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The end events of both tokenizers in one table (row, at, side, doc_id, ids): ``ids`` are consecutive tokens of one side, the first of which begins at byte ``at``.
    A document without tokens has one row without ids."""
    small_batches(docs.sparkSession)
    codec = lambda: pa.Codec("zstd", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pack = tokenizers(path_a, path_b), codec()
        keyed = (pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(1)], ["row", "doc_id"]), b.column(2)], ["key", "text"]) for b in batches)
        for keys, texts in blocks(keyed, 1_500_000):
            sides, good = own.tokens(texts)
            ends = [np.concatenate([[0], np.cumsum(own.sizes[s][ids])]) for s, (ids, _) in enumerate(sides)]
            out: list[list] = [[], [], [], [], []]
            for k, key in enumerate(keys):
                for side, (ids, edges) in enumerate(sides if good[k] else ()):
                    first, last = int(edges[k]), int(edges[k + 1])
                    for at in range(first, last, window):
                        part = ids[at : min(at + window, last)].tobytes()
                        for column, value in zip(out, (key["row"], int(ends[side][at] - ends[side][first]), side, key["doc_id"], len(part).to_bytes(4, "little") + pack.compress(part, asbytes=True)), strict=True):
                            column.append(value)
                if not good[k]:
                    for column, value in zip(out, (key["row"], 0, 0, key["doc_id"], None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, EVENTS.types, strict=True)], schema=EVENTS)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, EVENTS_DDL)


class Document:
    """What the machine holds of a document between rounds: sums, the tokens after the last common end, and its pairs so far."""

    def __init__(self, row: int, doc_id: int | None):
        self.row, self.doc_id = row, doc_id
        self.n = np.zeros(4, np.int64)
        self.digest = hashlib.sha256()
        self.wait: tuple[list, list] = ([], [])
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add_pairs(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.pairs.append((pairs, times))
        self.held += len(pairs)
        if len(self.pairs) > 1 and self.held > 2 * len(self.pairs[0][0]):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) > 1:
            pairs, times = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
            found, place = np.unique(pairs, return_inverse=True)
            self.pairs = [(found, np.bincount(place, weights=times, minlength=len(found)).astype(np.int64))]
            self.held = len(found)
        return self.pairs[0] if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Machine:
    """Streams the sorted events of a partition; documents are finished in the order in which they come."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.sizes, self.open, self.tokens = sizes, [], 0
        numbers = list(map(str, range(IDS)))
        self.written = [*numbers, *(f",{x}" for x in numbers), *(f";{x}" for x in numbers), *(f"|{x}" for x in numbers)]
        self.unpack = pa.Codec("zstd")

    def read(self, row: int, side: int, doc_id: int | None, packed: bytes | None) -> Iterator[Document]:
        if not self.open or self.open[-1].row != row:
            if self.tokens >= ROUND or len(self.open) >= CHUNK_ROWS:
                yield from self.step(last=True)
            self.open.append(Document(row, doc_id))
        if packed is not None:
            ids = np.frombuffer(self.unpack.decompress(packed[4:], int.from_bytes(packed[:4], "little"), asbytes=True), np.uint16)
            self.open[-1].wait[side].append(ids)
            self.tokens += len(ids)
            if self.tokens >= 2 * ROUND:
                yield from self.step(last=False)

    def step(self, last: bool) -> Iterator[Document]:
        """Closes the groups of all open documents; those that are whole are given out. With ``last`` the last one is whole too, else its tokens after the last
        common end wait."""
        docs = self.open
        sides = [[np.concatenate(d.wait[s]) if d.wait[s] else np.zeros(0, np.uint16) for d in docs] for s in (0, 1)]
        edges = [np.concatenate([[0], np.cumsum([len(x) for x in own])]) for own in sides]
        a, b = (np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64) for own in sides)
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        cover = np.searchsorted(end_b, end_a)  # the B token that covers the byte before an A token's end
        both = np.zeros(len(a), bool)
        inner = cover < len(end_b)
        both[inner] = end_b[cover[inner]] == end_a[inner]
        stops = np.flatnonzero(both)
        stop = (int(stops[-1]) + 1, int(cover[stops[-1]]) + 1) if len(stops) else (0, 0)
        rest = [own[-1][max(0, stop[s] - int(edges[s][-2])) :] if docs else None for s, own in enumerate(sides)]
        for s in (0, 1):
            edges[s][-1] = max(min(stop[s], int(edges[s][-1])), int(edges[s][-2])) if len(edges[s]) > 1 else 0
        a, b, both, cover, end_a, end_b = a[: stop[0]], b[: stop[1]], both[: stop[0]], cover[: stop[0]], end_a[: stop[0]], end_b[: stop[1]]
        if len(a):
            self.close(docs, a, b, both, cover, end_a, end_b, edges)
        self.tokens = 0
        if last:
            self.open = []
            yield from docs
        else:
            held = docs[-1]
            held.wait = ([rest[0]], [rest[1]])
            self.open = [held]
            self.tokens = 0 if len(a) else -ROUND  # a group that does not end: gather more before trying again
            yield from docs[:-1]

    def close(self, docs: list[Document], a, b, both, cover, end_a, end_b, edges) -> None:
        both_b = np.zeros(len(b), bool)
        both_b[cover[both]] = True
        # links: every A end with the B token there, and every B end that is no A end with the A token there
        only_b = np.flatnonzero(~both_b)
        over = np.searchsorted(end_a, end_b[only_b])
        of_a = np.repeat(np.arange(len(docs)), np.diff(edges[0]))
        key = np.concatenate([of_a << 32 | a << 16 | b[cover], of_a[over] << 32 | a[over] << 16 | b[only_b]])
        key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times, pair = np.diff(np.append(new, len(key))), key[new]
        cut = np.searchsorted(pair, np.arange(len(docs) + 1) << 32)
        pair &= 0xFFFFFFFF
        # the written groups: all A tokens of a group, then its B tokens
        group_a, group_b = np.cumsum(both) - both, np.cumsum(both_b) - both_b
        last_a, last_b = np.flatnonzero(both), np.flatnonzero(both_b)
        place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
        place_b = np.arange(len(b)) + (last_a + 1)[group_b]
        head_a, head_b = np.concatenate([[True], both[:-1]]), np.concatenate([[True], both_b[:-1]])
        sign = np.where(head_a, 2, 1)
        for k, d in enumerate(docs):
            if edges[0][k] < edges[0][k + 1] and not d.n[0]:
                sign[edges[0][k]] = 0
        code = np.empty(len(a) + len(b), np.int64)
        code[place_a], code[place_b] = a + sign * IDS, b + np.where(head_b, 3, 1) * IDS
        groups = np.concatenate([[0], np.cumsum(both)])
        listed, written = code.tolist(), self.written.__getitem__
        for k, d in enumerate(docs):
            (a0, a1), (b0, b1) = ((int(e[k]), int(e[k + 1])) for e in edges)
            if a1 > a0:
                n_groups = int(groups[a1] - groups[a0])
                d.n += (a1 - a0, b1 - b0, n_groups, a1 - a0 + b1 - b0 - n_groups)
                d.digest.update("".join(map(written, listed[a0 + b0 : a1 + b1])).encode())
                d.add_pairs(pair[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]])


def sweep(events: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The machine over events that are sorted by (row, at, side) within partitions: one row for each document, with its chunk, its distinct pairs (differences of A id x 65,536 + B id) and
    their numbers as packed 32-bit numbers."""
    small_batches(events.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(tokenizers(path_a, path_b).sizes)
        chunk, held, rows = TaskContext.get().partitionId() << 32, 0, 0

        def table(docs: Iterable[Document]) -> pa.RecordBatch:
            nonlocal chunk, held, rows
            out: list[list] = [[] for _ in SWEPT]
            for d in docs:
                pairs, times = d.merge()
                if rows and (held + len(pairs) > CHUNK or rows >= CHUNK_ROWS):
                    chunk, held, rows = chunk + 1, 0, 0
                held, rows = held + len(pairs), rows + 1
                text = d.digest.hexdigest() if d.n[0] else ""
                for column, value in zip(out, (chunk, d.doc_id, *d.n.tolist(), text, np.diff(pairs, prepend=0).astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, SWEPT.types, strict=True)], schema=SWEPT)

        for batch in batches:
            done: list[Document] = []
            for row, side, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("row", "side", "doc_id", "ids")), strict=True):
                done += machine.read(row, side, doc_id, ids)
            if done:
                yield table(done)
        if machine.open:
            yield table(machine.step(last=True))
        release()

    return events.mapInArrow(run, SWEPT_DDL)


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, numbers, row of each) of documents of one chunk."""
    packed, times = rows.column("pairs").to_pylist(), rows.column("times").to_pylist()
    sizes = np.array([len(x) // 4 for x in packed], np.int64)
    steps = np.frombuffer(b"".join(packed), np.uint32).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(steps)])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    pairs = total[1:] - np.repeat(total[edges[:-1]], sizes)
    return pairs, np.frombuffer(b"".join(times), np.uint32).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def chunk_pairs(swept: DataFrame) -> DataFrame:
    """(chunk, pair, n): in how many documents of a chunk a pair stands."""
    schema = pa.schema([("chunk", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            rows = pa.Table.from_batches([batch])
            for chunk in np.unique(chunks).tolist():
                pairs, n = np.unique(unpacked(rows.filter(pa.array(chunks == chunk)))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), pa.array(pairs), pa.array(n)], schema=schema)

    # a chunk lies in one file, but in several batches
    return swept.select("chunk", "pairs", "times").mapInArrow(run, "chunk bigint, pair bigint, n bigint").groupBy("chunk", "pair").agg(F.sum("n").alias("n"))


def pair_counts(by_chunk: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents a pair stands, and whether no pair of the same A id stands in more."""
    counts = by_chunk.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 16))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def weighed(found: pa.Table, rows: pa.Table) -> pa.Table:
    """The documents of a chunk with n_best and count_sum, from the chunk's pairs with their counts."""
    order = np.argsort(found.column("pair").to_numpy())
    keys, counts, best = (found.column(c).to_numpy()[order] for c in ("pair", "count", "best"))
    pairs, times, owner = unpacked(rows)
    place = np.searchsorted(keys, pairs)
    sums = []
    for value in (best[place].astype(np.int64), counts[place]) if len(keys) else (pairs, pairs):
        total = np.concatenate([[0], np.cumsum(times * value)])
        edges = np.searchsorted(owner, np.arange(rows.num_rows + 1))
        sums.append(pa.array(np.diff(total[edges])))
    out = {c: rows.column(c) for c, _ in ALIGNED if c in rows.column_names} | {"n_best": sums[0], "count_sum": sums[1]}
    return pa.table({c: out[c] for c, _ in ALIGNED})


def align(docs: DataFrame, path_a: str, path_b: str, *, doc: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair stands in as many documents as any of its A id), count_sum (of the
    numbers of documents of all links' pairs) and groups_sha256 of ``a1,a2|b1;a3|b2``."""
    spark = docs.sparkSession
    events = end_events(docs, path_a, path_b, doc=doc, text=text, window=window)
    swept = sweep(events.repartition("row").sortWithinPartitions("row", "at", "side"), path_a, path_b)
    swept = materialise(spark, swept, "swept")
    by_chunk = materialise(spark, chunk_pairs(swept), "chunk-pairs")
    known = by_chunk.select("chunk", "pair").join(pair_counts(by_chunk), "pair")
    ddl = ", ".join(f"{c} {t}" for c, t in ALIGNED)
    # a chunk is bounded: CHUNK pairs, or one document, and CHUNK_ROWS documents
    return known.groupBy("chunk").cogroup(swept.drop("n").groupBy("chunk")).applyInArrow(weighed, ddl)


def counted_pairs(docs: DataFrame, path_a: str, path_b: str, **columns) -> DataFrame:
    """(a, b, count, best) over the corpus: which B ids an A id is linked with, in how many documents."""
    events = end_events(docs, path_a, path_b, **columns)
    swept = sweep(events.repartition("row").sortWithinPartitions("row", "at", "side"), path_a, path_b)
    rows = pair_counts(chunk_pairs(swept))
    return rows.select(F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(F.lit(IDS - 1)).alias("b"), "count", "best")
