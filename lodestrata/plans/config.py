"""Configuration as frozen records, validated on construction."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from pathlib import PurePath

from lodestrata.operators.chunking import CHUNKERS, check_sizes
from lodestrata.operators.retrieval import METHODS


@dataclass(frozen=True)
class Chunking:
    type: str = "fixedsize"
    chunk_size: int | None = 1000
    chunk_overlap: int | None = 200
    separator: str = "\n\n"
    min_chunk_size: int = 500
    max_chunk_size: int = 1500

    def __post_init__(self):
        if self.type not in CHUNKERS:
            raise ValueError(f"unknown chunking type: {self.type}")
        if self.type != "semantic":
            check_sizes(self.chunk_size or 0, self.chunk_overlap or 0)


@dataclass(frozen=True)
class Retrieval:
    type: str = "vector-similarity"
    top_k: int = 5
    similarity_threshold: float = 0.0
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    compat_top_k5: bool = False

    def __post_init__(self):
        if self.type not in METHODS:
            raise ValueError(f"unknown retrieval type: {self.type}")
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")
        if min(self.vector_weight, self.keyword_weight) < 0:
            raise ValueError("weights must not be negative")

    @property
    def k(self) -> int:
        return 5 if self.compat_top_k5 else self.top_k


@dataclass(frozen=True)
class Model:
    """A language or embedding model. What is None is left to the client's default."""

    type: str
    model: str
    temperature: float = 0.1
    max_tokens: int = 1000
    abbr: str | None = None
    endpoint: str | None = None
    api_type: str | None = None
    api_key: str | None = None
    timeout: float | None = None
    device: str | None = None
    batch_size: int | None = None
    dimensions: int | None = None

    def __post_init__(self):
        if self.api_type not in (None, "ollama"):
            raise ValueError(f"unknown kind of local service: {self.api_type}")
        if (self.batch_size is not None and self.batch_size < 1) or (self.timeout is not None and self.timeout <= 0):
            raise ValueError("batch_size and timeout must be positive")


@dataclass(frozen=True)
class Experiment:
    name: str = "baseline"
    llm: Model = field(default_factory=lambda: Model("openai", "stub"))
    embedding: Model = field(default_factory=lambda: Model("openai", "hashing"))
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    metrics: tuple[str, ...] = ("overlap", "timing", "grounding")
    grouping: bool = False
    subset: int | None = None
    include_context: bool = True
    max_context_length: int = 4000
    dataset: str | None = None
    save_qa_pairs: bool = False

    def __post_init__(self):
        if self.llm.type not in ("openai", "local") or self.embedding.type not in ("openai", "sentence-transformers"):
            raise ValueError("unknown provider type")

    def with_(self, **changes) -> Experiment:
        return replace(self, **changes)


#: Names of the metric families in settings files.
FAMILY_NAMES = {"precision-recall": "overlap", "ragas": "grounding"}


#: The fields of each section of a settings file. Another field is refused by name: it would be read and do nothing.
SECTIONS = {
    "llm": {"type", "model", "model_name", "temperature", "max_tokens", "abbr", "endpoint", "api_type", "api_key", "timeout"},
    "embedding": {"type", "model", "model_name", "abbr", "endpoint", "api_key", "timeout", "device", "batch_size", "dimensions"},
    "chunking": set(Chunking.__dataclass_fields__), "retrieval": set(Retrieval.__dataclass_fields__), "evaluation": {"enabled_metrics"},
    "dataset": {"path", "evaluation_subset_size", "save_qa_pairs", "grouping"}, "pipeline": {"include_context", "max_context_length"},
}


def section(raw: dict, name: str) -> dict:
    """One section, its values of the form ${NAME} taken from the environment."""
    found = raw.get(name) or {}
    if unknown := set(found) - SECTIONS[name]:
        raise ValueError(f"unknown settings in {name}: {', '.join(sorted(unknown))}")
    take = lambda v: os.environ.get(v[2:-1]) if isinstance(v, str) and re.fullmatch(r"\$\{\w+\}", v) else v
    return {k: take(v) for k, v in found.items()}


def from_dict(raw: dict, name: str = "baseline") -> Experiment:
    """From the nested mapping of a settings file. Sections and fields that nothing uses, unknown types and sizes that cannot work raise."""
    if unknown := set(raw) - set(SECTIONS):
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    of = {s: section(raw, s) for s in SECTIONS}

    def model(kind: str) -> Model:
        own = dict(of[kind])
        named = own.pop("model", None), own.pop("model_name", None)
        return Model(own.pop("type", "openai"), named[0] or named[1] or "unknown", **{k: v for k, v in own.items() if v is not None})

    pipeline, dataset, named = of["pipeline"], of["dataset"], of["evaluation"].get("enabled_metrics")
    grouping = dataset.get("grouping") or {}
    if set(grouping) - {"enabled"}:
        raise ValueError(f"unknown settings in grouping: {', '.join(sorted(set(grouping) - {'enabled'}))}")
    return Experiment(
        name, model("llm"), model("embedding"), Chunking(**of["chunking"]), Retrieval(**of["retrieval"]), **({} if named is None else {"metrics": tuple(FAMILY_NAMES.get(n, n) for n in named)}),
        grouping=grouping.get("enabled", False), subset=dataset.get("evaluation_subset_size"), include_context=pipeline.get("include_context", True), max_context_length=pipeline.get("max_context_length", 4000),
        dataset=dataset.get("path"), save_qa_pairs=dataset.get("save_qa_pairs", False),
    )


def load(path: str) -> Experiment:
    """A settings file, YAML where a parser is installed, else JSON; the experiment is named after it."""
    with open(path, encoding="utf-8") as file:
        body = file.read()
    try:
        import yaml

        raw = yaml.safe_load(body)
    except ImportError:
        import json

        raw = json.loads(body)
    return from_dict(raw, PurePath(path).stem)
