"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A text is cut where a special token stands and into the pre-tokens of the vocabulary's pattern. The bytes of a pre-token
are the initial symbols of a linked list; adjacent pairs that the merge table holds wait in a heap by rank, and the
pair of lowest rank, leftmost among equals, is merged until none is left. The count is the number of initial symbols
minus the merges. Counts of short pre-tokens are remembered.

Null text counts as empty: 0 bytes, 0 tokens. Very long pre-tokens cost n log n. Null ids, repeated rows and empty tables
are ordinary; only the id and text columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import blocks, small_batches

#: Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000
KEEP = 64
#: So low that no sum of counts brings it back to 0.
UNSAFE = -(1 << 60)
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
OUT_DDL = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabulary files write for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Tokens(dict):
    """Tokens of each pre-token; a missing one is merged."""

    def __init__(self, merges: list):
        super().__init__()
        back = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        number = {bytes([b]): b for b in range(256)}
        #: by left symbol, by right symbol: the rank of the pair; and what the merge of each rank makes
        self.ranks: list[dict[int, int]] = [{} for _ in range(256)]
        self.product: list[int] = []
        for rank, merge in enumerate(merges):
            left, right = (b"".join(back[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            new = number.setdefault(left + right, len(number))
            if new == len(self.ranks):
                self.ranks.append({})
            self.product.append(new)
            self.ranks[number[left]].setdefault(number[right], rank)
        self.ranks.append({})  # the symbol -1 of places that are merged away

    def merged(self, data: bytes) -> int:
        """Symbols that are left of ``data``. A heap entry is rank and place; it is stale if the pair at the place has another rank."""
        ranks, product = self.ranks, self.product
        left = n = len(data)
        symbol = [*data, -1]
        heap = []
        for k in range(n - 1):
            rank = ranks[symbol[k]].get(symbol[k + 1])
            if rank is not None:
                heap.append(rank * n + k)
        heapify(heap)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        while heap:
            rank, k = divmod(heappop(heap), n)
            nxt = after[k]
            if ranks[symbol[k]].get(symbol[nxt]) != rank:
                continue
            own = symbol[k] = product[rank]
            symbol[nxt] = -1
            left -= 1
            follow = after[k] = after[nxt]
            before[follow] = k
            own = ranks[own]
            rank = own.get(symbol[follow])
            if rank is not None:
                heappush(heap, rank * n + k)
            lead = before[k]
            if lead >= 0:
                rank = ranks[symbol[lead]].get(symbol[k])
                if rank is not None:
                    heappush(heap, rank * n + lead)
        return left

    def __missing__(self, token: str) -> int:
        n = self.merged(token.encode("utf-8", "surrogatepass"))
        if len(token) <= KEEP:
            if len(self) >= CACHE:
                self.clear()
            self[token] = n
        return n


class Counter(dict):
    """Tokens of each word with one space before it. Between a character that is no white space and such a word the pattern always
    cuts; a word that is empty or has white space at an end is ``UNSAFE``, and a text with one is matched as a whole."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokens = Tokens(spec["model"]["merges"])
        self.special_words = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.special_words))) if self.special_words else None
        self.find = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> int:
        n = UNSAFE if not word or word[0].isspace() or word[-1].isspace() else self.plain(" " + word)
        if len(word) <= KEEP:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n

    def plain(self, text: str) -> int:
        return sum(map(self.tokens.__getitem__, self.find(text)))

    def ordinary(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        first, _, rest = text.partition(" ")
        if not rest or not first or first[-1].isspace():
            return self.plain(text)
        n = sum(map(self.__getitem__, rest.split(" ")))
        return self.plain(first) + n if n >= 0 else self.plain(text)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special_words):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.ordinary(p) for p in parts if p)
        return self.ordinary(text)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each worker process, kept between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()), pa.array([own.count(t) for t in texts], pa.int64())], schema=OUT)

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, OUT_DDL)
