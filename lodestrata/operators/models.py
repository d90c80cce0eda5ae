"""Language and embedding models behind two protocols, with clients for HTTP services and factories by type.

A client is made once in each Python worker, from a plain record that travels with the plan. Keys come from the environment of the worker, or from
the record; they are never part of a table. ``post`` may be replaced, which the tests do. Request bodies, default names of models and the keys of ``info`` are fixed
values: the interfaces of public services, and names that summaries must have.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, is_dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import vectors as V
from lodestrata.operators.calls import Calls, Record, outcomes

Post = Callable[[str, dict, dict, float], dict]
SYSTEM = "Answer from the given context. Say so if the context does not hold the answer."


class Llm(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def environment(path: str | None = None) -> dict[str, str]:
    """The process's variables over those of a file of NAME=value lines; quotes around values go, comments and blank lines are skipped."""
    found: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            for line in map(str.strip, file):
                name, mark, value = line.removeprefix("export ").partition("=")
                if mark and not line.startswith("#"):
                    found[name.strip()] = value.strip().strip("\"'")
    return found | dict(os.environ)


def post_json(url: str, body: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def status(url: str, timeout: float) -> int:
    with urllib.request.urlopen(url, timeout=timeout) as reply:
        return reply.status


def bearer(key: str | None) -> dict:
    key = key or os.environ.get("OPENAI_API_KEY")
    return {"Authorization": f"Bearer {key}"} if key else {}


@dataclass(frozen=True)
class ChatService:
    """A chat-completions service. With ``schema`` it is asked for JSON of that shape."""

    model: str = "gpt-4o-mini"
    temperature: float = 0.1
    max_tokens: int = 1000
    endpoint: str = "https://api.openai.com/v1"
    api_key: str | None = None
    timeout: float = 60.0
    system: str = SYSTEM
    schema: dict | None = None
    post: Post = post_json

    def __call__(self, prompts: list[str]) -> list[str]:
        shape = {"response_format": {"type": "json_schema", "json_schema": {"name": "answer", "schema": self.schema, "strict": True}}} if self.schema else {}
        out = []
        for prompt in prompts:
            body = {"model": self.model, "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens, **shape}
            out.append(self.post(f"{self.endpoint}/chat/completions", body, bearer(self.api_key), self.timeout)["choices"][0]["message"]["content"].strip())
        return out

    def info(self) -> dict:
        return {"name": f"openai-{self.model}", "provider": "openai", "model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens}


@dataclass(frozen=True)
class LocalService:
    """A local generate service."""

    model: str = "llama3:8b"
    temperature: float = 0.1
    max_tokens: int = 1000
    endpoint: str = "http://localhost:11434"
    timeout: float = 60.0
    post: Post = post_json

    def __call__(self, prompts: list[str]) -> list[str]:
        options = {"temperature": self.temperature, "num_predict": self.max_tokens}
        ask = lambda p: self.post(f"{self.endpoint}/api/generate", {"model": self.model, "prompt": p, "stream": False, "options": options}, {}, self.timeout)
        return [ask(p).get("response", "").strip() for p in prompts]

    def reachable(self, get: Callable[[str, float], int] | None = None) -> bool:
        """Whether the service answers; a call that it does not answer is that call's own error."""
        try:
            return (get or status)(f"{self.endpoint}/api/tags", 5.0) == 200
        except OSError:
            return False

    def info(self) -> dict:
        return {"name": self.model, "provider": "local", "endpoint": self.endpoint, "temperature": self.temperature, "max_tokens": self.max_tokens}


@dataclass(frozen=True)
class EmbeddingService:
    """An embeddings service; a request holds at most ``batch`` texts."""

    model: str = "text-embedding-ada-002"
    dimensions: int = 1536
    batch: int = 100
    endpoint: str = "https://api.openai.com/v1"
    api_key: str | None = None
    timeout: float = 60.0
    post: Post = post_json

    def __call__(self, texts: list[str]) -> list[list[float]]:
        found = self.post(f"{self.endpoint}/embeddings", {"input": texts, "model": self.model}, bearer(self.api_key), self.timeout)["data"]
        return [row["embedding"] for row in sorted(found, key=lambda row: row.get("index", 0))]

    def info(self) -> dict:
        return {"name": f"openai-{self.model}", "provider": "openai", "model": self.model, "dimensions": self.dimensions}


@dataclass(frozen=True)
class LocalEmbedding:
    """A sentence-transformers model, loaded in the worker; raises there if the library is missing."""

    model: str = "all-MiniLM-L6-v2"
    dimensions: int = 384
    device: str = "cpu"
    batch: int = 32

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if self not in _LOADED:
            from sentence_transformers import SentenceTransformer

            _LOADED[self] = SentenceTransformer(self.model, device=self.device)
        return np.asarray(_LOADED[self].encode(texts, batch_size=self.batch)).tolist()

    def info(self) -> dict:
        return {"name": f"sentence-transformers-{self.model}", "provider": "sentence-transformers", "model": self.model, "device": self.device, "dimensions": self.dimensions}


_LOADED: dict = {}


@dataclass(frozen=True)
class HashingEmbedding:
    """Deterministic stand-in for a model: word counts by hash bucket, to unit length."""

    dimensions: int = 64
    batch: int = 1024

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [V.hashed(t, self.dimensions) for t in texts]

    def info(self) -> dict:
        return {"name": "hashing", "provider": "offline", "model": "hashing", "dimensions": self.dimensions}


#: The lengths of published models' vectors.
DIMENSIONS = {"text-embedding-ada-002": 1536, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "all-MiniLM-L6-v2": 384, "all-mpnet-base-v2": 768}
LLMS = {"openai": ChatService, "local": LocalService}
EMBEDDERS = {"openai": EmbeddingService, "sentence-transformers": LocalEmbedding, "hashing": HashingEmbedding}


def made(kinds: dict, kind: str, settings: dict):
    if kind not in kinds:
        raise ValueError(f"unknown type: {kind}")
    named = {"model": settings["model_name"]} if settings.get("model_name") else {}
    named |= {"batch": settings["batch_size"]} if settings.get("batch_size") else {}
    return kinds[kind](**{k: v for k, v in (settings | named).items() if k in kinds[kind].__dataclass_fields__ and v is not None})


def llm(settings: dict):
    """A language model from its settings; their ``type`` names the kind."""
    return made(LLMS, settings.get("type", "openai"), settings)


def embedder(settings: dict):
    """An embedding model from its settings. On a GPU the batch is 128 unless given."""
    if settings.get("device") == "cuda":
        settings = {"batch": 128} | settings
    name = settings.get("model_name") or settings.get("model")
    if name in DIMENSIONS and not settings.get("dimensions"):
        settings = settings | {"dimensions": DIMENSIONS[name]}
    return made(EMBEDDERS, settings.get("type", "openai"), settings)


def settings_of(model) -> dict:
    """What a client's answers depend on, for tables and cache keys: its kind and settings without the key and how it is called."""
    return {"client": type(model).__name__, **{k: v for k, v in asdict(model).items() if k not in ("api_key", "post", "timeout", "batch", "device")}} if is_dataclass(model) else {"client": getattr(model, "__name__", type(model).__name__)}


def embed(c: Column, model: Embedder, compat: bool = False, calls: Calls | None = None) -> Column:
    """Vectors of a text column, in the order of the rows, ``model.batch`` texts a call; null counts as empty. A text that fails by itself raises, so no table
    is written with a vector that is none; ``compat`` gives zero vectors instead, as published."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for o in outcomes(vectors_of(model), [t or "" for t in texts], model.batch, calls):
                if o.error is not None and not compat:
                    raise RuntimeError(f"no vector: {o.error}")
                out.append([0.0] * model.dimensions if o.error is not None else o.value)
            yield pd.Series(out, dtype=object)

    return run(c)


def vectors_of(model: Embedder) -> Callable[[list[str]], list[list[float]]]:
    """The model with every vector as floats; a vector of another length than a known model's, or than the others of its call, or with a number that is none, raises."""

    def call(texts: list[str]) -> list[list[float]]:
        found = [list(map(float, v)) for v in model(texts)]
        size = DIMENSIONS.get(getattr(model, "model", "")) or len(found[0])
        for v in found:
            if len(v) != size or not np.isfinite(v).all():
                raise ValueError(f"a vector of {len(v)} numbers, not {size} finite ones")
        return found

    return call


def embedded(rows: DataFrame, column: str, model: Embedder, record: Record, calls: Calls | None = None, name: str = "vec") -> DataFrame:
    """``rows`` with ``name`` and ``<name>_error`` from a record of vectors: only texts that no row and no earlier run had are embedded. A text that fails has a null
    vector and an error, and is tried again by the next run."""
    filled = rows.withColumn("_text", F.coalesce(column, F.lit("")))
    found = record.answer(filled, "_text", lambda: vectors_of(model), settings_of(model), name="_v", size=model.batch, calls=calls)
    return found.withColumns({name: F.col("_v.value"), f"{name}_error": F.col("_v.error")}).drop("_v", "_text")
