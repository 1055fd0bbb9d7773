"""Providers by category and name, made once per configuration, and the protocols that they follow."""

import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Texts to a matrix, a row each, in their order."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def __call__(self, found: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame: ...


class Retriever(Protocol):
    """query_id, rank, doc_id, score of queries (query_id, text, v)."""

    def __call__(self, queries: DataFrame, k: int) -> DataFrame: ...


class ContextBuilder(Protocol):
    def __call__(self, df: DataFrame, limit: int) -> DataFrame: ...


class GraphStore(Protocol):
    """A graph as two tables."""

    nodes: DataFrame
    edges: DataFrame


CATEGORIES = ("embedding", "llm", "rerank", "vectorstore")
_FACTORIES: dict[tuple[str, str], Callable] = {}
_MADE: dict[str, object] = {}


def register(category: str, name: str):
    if category not in CATEGORIES:
        raise ValueError(f"no category {category}; there are {', '.join(CATEGORIES)}")

    def add(factory):
        _FACTORIES[category, name] = factory
        return factory

    return add


def available(category: str) -> list[str]:
    return sorted(n for c, n in _FACTORIES if c == category)


def key(category: str, name: str, config: dict) -> str:
    """Of a provider's configuration, whatever the order of its settings."""
    return f"{category}:{name}:{hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:8]}"


def key_column(settings: Column) -> Column:
    """The same kind of key for a struct whose fields are in order: the first 8 digits of its JSON's md5."""
    return F.substring(F.md5(F.to_json(settings)), 1, 8)


def get(category: str, name: str, **config):
    """The provider of that name and configuration; an unknown name is an error that lists the known ones."""
    if (category, name) not in _FACTORIES:
        raise ValueError(f"no {category} provider {name}; there are {', '.join(available(category)) or 'none'}")
    at = key(category, name, config)
    if at not in _MADE:
        _MADE[at] = _FACTORIES[category, name](**config)
    return _MADE[at]


@lru_cache(1 << 16)
def _hashed(word: str) -> int:
    """The first two bytes of a word's md5; frequent words are looked up."""
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16)


@register("embedding", "hash")
def hashing(dim: int = 64) -> Embedder:
    """Counts of words by a hash of each, to length 1; no model is needed."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            row += np.bincount(np.array([_hashed(w) % dim for w in re.findall(r"\w{2,}", text.lower())], int), minlength=dim)
        return out / np.maximum(np.sqrt((out**2).sum(axis=1)), 1e-300)[:, None]

    return embed


def embed(texts: DataFrame, embedder: Embedder, id_col: str = "doc_id", batch: int = 32, guard: bool = False) -> DataFrame:
    """id, v of texts (id, text), batch by batch in their order; a null text counts as empty.

    With guard there is a column failure: where a batch fails its texts are asked one by one, and one that fails again has
    no vector and the error's text.
    """
    import pandas as pd

    def call(held: list[str]) -> tuple[list, list]:
        try:
            return list(embedder(held)), [None] * len(held)
        except Exception as e:  # noqa: BLE001 - any failure of a model's own code
            if not guard:
                raise
            if len(held) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
            parts = [call([t]) for t in held]
            return [v for p in parts for v in p[0]], [f for p in parts for f in p[1]]

    def run(frames):
        for b in frames:
            for at in range(0, len(b), batch):
                part = b[at : at + batch]
                v, failure = call([t or "" for t in part["text"]])
                yield pd.DataFrame({id_col: part[id_col], "v": pd.Series(v, part.index, dtype=object)} | ({"failure": pd.Series(failure, part.index, dtype=object)} if guard else {}))

    schema = f"{id_col} {texts.schema[id_col].dataType.simpleString()}, v array<double>{', failure string' * guard}"
    return texts.select(id_col, "text").mapInPandas(run, schema)


def reorder(answers: Column) -> Column:
    """Vectors of an answer's structs (index, v), by index."""
    return F.transform(F.array_sort(answers), lambda x: x["v"])
