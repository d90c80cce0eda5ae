"""Secret scans: known shapes, and strings that a tiktoken vocabulary cannot shorten.

Base kinds are found by pattern, leftmost and without overlap for each kind: ``assign`` (a credential's name, a separator and a value
of 12 or more characters), ``access`` (AKIA keys of 18 or more) and ``hex`` (16 or more lower-case hexadecimal digits).
The token-efficiency test then looks at every run of ``[A-Za-z0-9+/_=-]`` of ``MIN_RUN`` characters or more:
prose compresses to three or more characters a token, random strings do not. A run with fewer than ``RATIO`` characters a token is reported as
``random``, unless it is a known digest (hexadecimal, of a common digest's length) or identifier (a UUID, or a number with separators), or lies inside a base span. A run of
letters, or of words and numbers joined by ``-``, ``_``, ``/``, ``+`` or ``=``, is judged by its words: each of ``MIN_WORD`` letters or more by itself, against ``WORD_RATIO``; one that fails
makes the run random.

Null text counts as empty: no spans. Very long texts are scanned whole. Null ids, repeated rows and empty tables are ordinary;
only the id and text columns are read. Spans are half-open, in code points.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import blocks, sha256_hex, small_batches

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")
KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
RATIO = 2.2
#: Of words of letters alone: random ones of 20 letters have 1.1 to 2.0 characters a token, the longest words of prose 2.2 and more.
MIN_WORD, WORD_RATIO = 16, 2.0
#: Hexadecimal lengths of md5, sha1, sha224, sha256, sha384 and sha512.
DIGESTS = {32, 40, 56, 64, 96, 128}
HEX_RUN = re.compile(r"[0-9a-fA-F]+")
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+")
JOINED = re.compile(r"[-_/=+]*(?:[A-Za-z]+|[0-9]+)(?:[-_/=+]+(?:[A-Za-z]+|[0-9]+))*[-_/=+]*")
WORD = re.compile(f"[A-Za-z]{{{MIN_WORD},}}")
_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_RUN = bytes(120 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-") else 32 for b in range(256))
OUT = pa.schema([("doc_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
OUT_DDL = "doc_id bigint, kinds array<string>, starts array<bigint>, ends array<bigint>"


def tiktoken_counter(path: str, pattern: str):
    """Tokens of a string under the vocabulary at ``path``."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda s: len(own.encode_ordinary(s))


def runs(image: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of the byte x of at least ``least``."""
    need = b"x" * least
    at = image.find(need)
    while at >= 0:
        end = image.find(b" ", at)
        end = len(image) if end < 0 else end
        yield at, end
        at = image.find(need, end)


def base_spans(text: str, image: bytes) -> list[tuple[int, int, str]]:
    """Spans of the base kinds. ``image`` has one Latin-1 byte per code point."""
    found = []
    if HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(a, b, "hex") for a, b in runs(image.translate(_HEX), 16)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def looks_random(word: str, tokens) -> bool:
    """The token-efficiency test, after the exclusions."""
    if HEX_RUN.fullmatch(word) and len(word) in DIGESTS or IDENTIFIER.fullmatch(word):
        return False
    if JOINED.fullmatch(word):
        return any(len(part) < WORD_RATIO * tokens(part) for part in WORD.findall(word))
    return len(word) < RATIO * tokens(word)


def scan(text: str | None, tokens) -> list[tuple[int, int, str]]:
    """All spans of one text: (start, end, kind), by start, then kind."""
    if not text:
        return []
    # one byte per code point; what Latin-1 lacks becomes a question mark, which no kind holds
    image = text.encode("latin-1", "replace")
    found = base_spans(text, image)
    covered = [(a, b) for a, b, _ in found]
    for a, b in runs(image.translate(_RUN), MIN_RUN):
        if not any(x <= a and b <= y for x, y in covered) and looks_random(text[a:b], tokens):
            found.append((a, b, "random"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_TOKENS: dict[tuple[str, str], object] = {}


def counter(path: str, pattern: str):
    """The token counter of a vocabulary, built once in each worker."""
    if (path, pattern) not in _TOKENS:
        _TOKENS[path, pattern] = tiktoken_counter(path, pattern)
    return _TOKENS[path, pattern]


def find_secrets(docs: DataFrame, path: str, pattern: str, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kinds, starts, ends."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path, pattern)
        for ids, texts in blocks(batches):
            found = [scan(t, tokens) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([[s[k] for s in spans] for spans in found], OUT.field(at + 1).type) for at, k in enumerate((2, 0, 1)))], schema=OUT)

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, OUT_DDL)


def mask(text, kinds, starts, ends):
    """Column: the text with every span replaced by its kind in brackets; of overlapping spans the earlier wins."""
    spans = F.arrays_zip(kinds.alias("k"), starts.alias("s"), ends.alias("e"))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(
        spans,
        empty,
        lambda a, s: F.struct(
            F.when(s["s"] >= a["at"], F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["s"] - a["at"]).cast("int")), F.lit("["), F.upper(s["k"]), F.lit("]"))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["e"]).alias("at"),
        ),
    )
    return F.when(F.size(kinds) > 0, F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int")))).otherwise(text)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the earlier wins, and what of the later lies beyond it goes as well."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, path: str, pattern: str, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows with all columns; secrets are masked in the text of their own row, and ``length``, where there is such a column, follows."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at, n_at = names.index(text), names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path, pattern)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = {k: spans for k, t in enumerate(texts) if (spans := scan(t, tokens))}
            if found:
                columns = list(batch.columns)
                for k, spans in found.items():
                    texts[k] = masked(texts[k], spans)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if n_at is not None:
                    sizes = columns[n_at].to_pylist()
                    for k in found:
                        sizes[k] = len(texts[k])
                    columns[n_at] = pa.array(sizes, batch.schema.field(n_at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return sha256_hex(joined(spans))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
