"""SentencePiece encoding and decoding that keeps the place of every piece in the source.

Normalisation walks through the text and takes, at every position, the longest prefix that the model's compiled
character map holds (a double-array trie with its replacement strings), or else one character; each
normalised character records the source bytes it came from. Spaces become the escape mark and the dummy prefix is
put in front as the model says. The pieces of the normalised text are then projected through that record to byte spans
of the source; a piece that only holds the dummy prefix has an empty span.

Segmentation is the library's own. Where no piece of the vocabulary joins a mark or line break to what precedes it, the
normalised text may be cut there without changing a single piece, so words are encoded once and remembered; with any
other vocabulary whole texts are given to the library.

Null text counts as empty; an empty text has no ids and decodes to the empty text. Very long texts are handled word by
word. Null ids, repeated rows and empty tables are ordinary. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import blocks, sha256_hex, small_batches

MARK = "▁"
CACHE = 400_000
WORDS = re.compile(" +[^ \n]*|\n[^ \n]*")
OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("decoded", pa.string())])
OUT_DDL = "doc_id bigint, ids array<int>, begins array<int>, ends array<int>, decoded string"
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64()), ("n_covered", pa.int64()), ("spans_sha256", pa.string())])
DIGEST_DDL = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint, n_covered bigint, spans_sha256 string"


class CharMap:
    """The compiled character map: 4 bytes of trie size, the trie's units, then replacement strings that end in NUL."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``data`` holds at ``at``, with its replacement."""
        if not self.units:
            return None
        node, found = 0, None
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                where = self.units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.texts[where : self.texts.index(b"\0", where)])
        return found


def normalise(text: str, charmap: CharMap, *, dummy_prefix: bool, drop_extra_spaces: bool) -> tuple[str, np.ndarray]:
    """Normalised text, and for each of its characters (and its end) the source byte where it begins."""
    if not text:
        return "", np.zeros(1, np.int64)
    if not charmap.units and not drop_extra_spaces:
        out = text.replace(" ", MARK)
        if text.isascii():
            places = np.arange(len(text) + 1)
        else:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            places = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
        return (MARK + out, np.concatenate([[0], places])) if dummy_prefix else (out, places)
    data = text.encode("utf-8", "surrogatepass")
    chars: list[str] = []
    places: list[int] = []
    at = 0
    while at < len(data):
        hit = charmap.longest(data, at)
        if hit:
            size, new = hit[0], hit[1].decode("utf-8", "replace")
        else:
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            new = data[at : at + size].decode("utf-8", "replace")
        for c in new:
            if c == " " and drop_extra_spaces and (not chars or chars[-1] == MARK):
                continue
            chars.append(MARK if c == " " else c)
            places.append(at)
        at += size
    end = len(data)
    while drop_extra_spaces and chars and chars[-1] == MARK:
        chars.pop()
        end = places.pop()
    if not chars:
        return "", np.zeros(1, np.int64)
    if dummy_prefix:
        chars.insert(0, MARK)
        places.insert(0, places[0])
    return "".join(chars), np.array([*places, end])


class Encoded:
    """The pieces of a block of texts, end to end: ``edges`` has the first piece of each text and the end of the last."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, edges: np.ndarray, decoded: list[str], joined: list[str]):
        self.ids, self.begins, self.ends, self.edges, self.decoded, self.joined = ids, begins, ends, edges, decoded, joined


class Encoder:
    """Encodes normalised texts word by word, remembering the words; ``path`` is the model file."""

    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            spec = proto.ModelProto.FromString(file.read())
        rules = spec.normalizer_spec
        self.charmap = CharMap(rules.precompiled_charsmap)
        self.dummy, self.drop, self.cache = rules.add_dummy_prefix, rules.remove_extra_whitespaces, cache
        joined = any(MARK in p.piece.lstrip(MARK) or ("\n" in p.piece and len(p.piece) > 1) for p in spec.pieces)
        self.by_word = not joined and not self.charmap.units and not self.drop and self.dummy and rules.escape_whitespaces and spec.trainer_spec.byte_fallback and not spec.trainer_spec.treat_whitespace_as_suffix and all(p.type != 4 for p in spec.pieces)
        spec.normalizer_spec.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.lengths = np.array([1 if p.type == 6 else len(p.piece) for p in spec.pieces], np.int64)
        self.is_byte = np.array([p.type == 6 for p in spec.pieces], bool)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.joined: list[str] = []
        self.odd: dict[int, str] = {}
        self.pool, self.covers, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int16), 0
        self.starts = np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        """The words of a text as keys: a word is its leading spaces and what follows, or a line break and what follows. One leading
        space is left out of the key; a key that begins with a space has all of them."""
        if "  " not in text and MARK not in text and not text.startswith(" "):
            return text.replace("\n", " \n").split(" ") if text else []
        return [w[1:] if w[0] == " " and w[1:2] != " " else w for w in WORDS.findall(" " + text.replace(MARK, " "))]

    def learn(self, keys: list[str]) -> None:
        """Encode words not seen before, all at once, and remember ids, the characters of each piece, and odd decodings."""
        surfaces = [k if k[:1] in (" ", "\n") else " " + k for k in keys]
        found = self.inner.encode(surfaces, num_threads=1)
        row = np.fromiter(chain.from_iterable(found), np.int32)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        covers = self.lengths[row]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(self.is_byte[row]), side="right")).tolist():
            part = slice(int(ends[k - 1]) if k else 0, int(ends[k]))
            covers[part] = byte_sizes(self.is_byte[row[part]], covers[part], surfaces[k])
        for key, surface, ids, decoded in zip(keys, surfaces, found, self.model.decode(found), strict=True):
            number = self.number[key] = len(self.number)
            self.joined.append(",".join(map(str, ids)))
            if decoded != (surface[1:] if surface[0] == " " else surface):
                self.odd[number] = (" " if surface[0] == " " else "") + decoded
        need = self.used + len(row)
        if need > len(self.pool):
            self.pool, self.covers = (np.concatenate([x[: self.used], np.zeros(need, x.dtype)]) for x in (self.pool, self.covers))
        self.pool[self.used : need], self.covers[self.used : need] = row, np.minimum(covers, 32767)
        self.starts = np.concatenate([self.starts, self.used + ends])
        self.used = need

    def encode(self, texts: list[str | None], spans: bool = True) -> Encoded:
        held = [t or "" for t in texts]
        if not self.by_word:
            return self.whole(held)
        cut = [self.words(t) for t in held]
        fresh = set().union(*cut).difference(self.number)
        if fresh and len(self.number) + len(fresh) > self.cache:
            self.forget()
            fresh = set().union(*cut)
        if fresh:
            self.learn(sorted(fresh))
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        size = self.starts[number + 1] - self.starts[number]
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(total[-1]) + np.repeat(self.starts[number] - total[:-1], size)
        word_edges = np.concatenate([[0], np.cumsum(n)])
        edges = total[word_edges]
        joined, odd = self.joined, self.odd
        listed, cuts = number.tolist(), word_edges.tolist()
        strings = [",".join([joined[k] for k in listed[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        decoded = [t.replace(MARK, " ") for t in held]
        if odd:
            for k, row in enumerate(listed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)):
                if not odd.keys().isdisjoint(row):
                    decoded[k] = "".join([odd.get(x, s) for x, s in zip(row, (w if w[:1] in (" ", "\n") else " " + w for w in cut[k]), strict=True)])[1:]
        begins = ends = np.zeros(0, np.int64)
        if spans:
            places = [normalise(t, self.charmap, dummy_prefix=self.dummy, drop_extra_spaces=self.drop)[1] for t in held]
            shift = np.concatenate([[0], np.cumsum([len(p) for p in places])])
            covered = np.concatenate([[0], np.cumsum(self.covers[at], dtype=np.int64)])
            own = np.repeat(shift[:-1] - covered[edges[:-1]], np.diff(edges))
            flat = np.concatenate(places) if places else np.zeros(1, np.int64)
            begins, ends = flat[covered[:-1] + own], flat[covered[1:] + own]
        return Encoded(self.pool[at], begins, ends, edges, decoded, strings)

    def whole(self, texts: list[str]) -> Encoded:
        """Any other model: the library encodes the texts, and the pieces are projected through the normalisation."""
        ids, begins, ends, decoded, edges = [], [], [], [], [0]
        for text in texts:
            got = self.model.encode(text)
            normal, places = normalise(text, self.charmap, dummy_prefix=self.dummy, drop_extra_spaces=self.drop)
            sizes = self.lengths[np.array(got, np.int64)] if got else np.zeros(0, np.int64)
            if got and self.is_byte[got].any():
                sizes = byte_sizes(self.is_byte[got], sizes, normal)
            upto = np.minimum(np.cumsum(sizes), len(places) - 1)
            ids += got
            ends += places[upto].tolist()
            begins += places[np.concatenate([[0], upto[:-1]])].tolist() if got else []
            decoded.append(self.model.decode(got))
            edges.append(len(ids))
        return Encoded(np.array(ids, np.int32), np.array(begins, np.int64), np.array(ends, np.int64), np.array(edges), decoded, [",".join(map(str, ids[a:b])) for a, b in zip(edges, edges[1:], strict=False)])


def byte_sizes(is_byte: np.ndarray, sizes: np.ndarray, word: str) -> np.ndarray:
    """Characters that each piece covers, where the bytes of one character are pieces of their own: the last byte has it."""
    out, at, k = sizes.copy(), 0, 0
    while k < len(out):
        if is_byte[k]:
            n = len(word[at].encode("utf-8", "surrogatepass"))
            out[k : k + n] = 0
            out[k + n - 1] = 1
            at, k = at + 1, k + n
        else:
            at, k = at + int(out[k]), k + 1
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process: its remembered words serve later tasks as well."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encode(docs: DataFrame, path: str, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, begins and ends (source bytes of each piece), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in blocks(batches, 1_500_000):
            out = encoder(path).encode(texts)
            cut = pa.array(out.edges, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (out.ids, out.begins, out.ends)), pa.array(out.decoded, pa.string())], schema=OUT)

    return _rows(docs, doc, text).mapInArrow(run, OUT_DDL)


def encode_digests(docs: DataFrame, path: str, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The same encoding with digests in place of the lists, taken where the pieces are made: n_tokens, ids_sha256, decoded_sha256,
    n_bytes of the source, n_covered, those that the spans of the pieces cover, and spans_sha256, of begin and end of every piece as 32-bit numbers, the low byte first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in blocks(batches, 1_500_000):
            out = encoder(path).encode(texts)
            covered = np.concatenate([[0], np.cumsum(out.ends - out.begins)])[out.edges]
            spans, cuts = np.stack([out.begins, out.ends], axis=1).astype("<i4"), out.edges.tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array(np.diff(out.edges), pa.int64()), pa.array([sha256_hex(x) for x in out.joined]),
                pa.array([sha256_hex(x) for x in out.decoded]), pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()), pa.array(np.diff(covered), pa.int64()),
                pa.array([hashlib.sha256(spans[a:b].tobytes()).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)], pa.string()),
            ], schema=DIGEST)

    return _rows(docs, doc, text).mapInArrow(run, DIGEST_DDL)
