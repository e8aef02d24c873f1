"""Ports: models and tools that a user plugs in, run in Arrow batches with their answers checked."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T


class Embedder(Protocol):
    """What turns texts into vectors; it travels to the tasks by pickling."""

    model_id: str
    dimensions: int

    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Signed feature hashing by BLAKE2b-16, scaled to length 1."""

    def __init__(self, dimensions: int = 256) -> None:
        self.model_id, self.dimensions = f"feature-hash-{dimensions}", dimensions

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for token in T.TOKENS.findall(t):
                for w in T.word_features(token):
                    d = hashlib.blake2b(w.encode(), digest_size=16).digest()
                    v[int.from_bytes(d[:8], "big") % self.dimensions] += 1.0 if d[8] & 1 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


def embed(df: DataFrame, key: str, text: Column, embedder: Embedder, batch: int = 64) -> DataFrame:
    """(key, embedding, embedding_model, embedding_dimensions) of all texts; a null text counts as empty.

    The model is asked for ``batch`` texts at once; an answer with another count, another length or a number that
    isn't finite is an error.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                got = embedder.embed_texts(part["text"].tolist())
                if len(got) != len(part) or any(len(v) != embedder.dimensions or not all(map(math.isfinite, v)) for v in got):
                    raise ValueError(f"{embedder.model_id} gave vectors of the wrong number, length or kind")
                yield pd.DataFrame({key: part[key], "embedding": got, "embedding_model": embedder.model_id, "embedding_dimensions": embedder.dimensions})

    return df.select(key, F.coalesce(text, F.lit("")).alias("text")).mapInPandas(run, f"{key} {kind}, embedding array<float>, embedding_model string, embedding_dimensions int")


def extract(df: DataFrame, key: str, text: Column, extractor: Callable[[str], list[dict[str, object]]], schema: str) -> DataFrame:
    """(key, position, the columns of ``schema``): what an extractor draws from each text, in order; other entries of its answers are left out."""
    kind = df.schema[key].dataType.simpleString()
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *(x.get(c) for c in columns)) for k, t in zip(pdf[key], pdf["text"]) if isinstance(t, str) for i, x in enumerate(extractor(t))]
            yield pd.DataFrame(rows, columns=[key, "position", *columns])

    return df.select(key, text.alias("text")).mapInPandas(run, f"{key} {kind}, position int, {schema}")


class Registry:
    """Tools by name with the names of their arguments, called only through an allow list."""

    def __init__(self) -> None:
        self.tools: dict[str, tuple[Callable[..., object], frozenset[str], frozenset[str]]] = {}

    def register(self, name: str, call: Callable[..., object], required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> None:
        """Enter a tool; a name that is taken is an error."""
        if name in self.tools:
            raise ValueError(f"the name {name} is taken")
        self.tools[name] = (call, frozenset(required), frozenset(optional))

    def dispatch(self, name: str, arguments: str, allowed: frozenset[str]) -> tuple[str, object]:
        """(verdict, answer) of one call whose arguments are a JSON object."""
        if name not in self.tools:
            return "unknown", None
        if name not in allowed:
            return "denied", None
        call, required, optional = self.tools[name]
        try:
            given = json.loads(arguments)
        except ValueError:
            return "invalid", None
        if not isinstance(given, dict) or not required <= given.keys() or not given.keys() <= required | optional:
            return "invalid", None
        try:
            return "done", call(**given)
        except Exception as e:  # a tool's failure is its answer
            return "failed", str(e)

    def run(self, calls: DataFrame, key: str, name: str, arguments: str, allowed: tuple[str, ...]) -> DataFrame:
        """(key, verdict, answer as JSON) of a table of calls, in the tasks."""
        kind = calls.schema[key].dataType.simpleString()

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = [self.dispatch(n, a, frozenset(allowed)) if isinstance(n, str) and isinstance(a, str) else ("invalid", None) for n, a in zip(pdf["n"], pdf["a"])]
                yield pd.DataFrame({key: pdf[key], "verdict": [v for v, _ in got], "answer": [None if x is None else json.dumps(x, ensure_ascii=False) for _, x in got]})

        return calls.select(key, F.col(name).alias("n"), F.col(arguments).alias("a")).mapInPandas(each, f"{key} {kind}, verdict string, answer string")


def check_search(query: str, top_k: int, mode: str, modes: tuple[str, ...] = ("lexical", "dense", "hybrid")) -> None:
    """Arguments of a search are judged before a plan is made."""
    if not 1 <= len(query.strip()) or len(query) > 2_000:
        raise ValueError("a query has 1 to 2,000 characters")
    if not 1 <= top_k <= 20:
        raise ValueError("top_k is 1 to 20")
    if mode not in modes:
        raise ValueError(f"mode is one of {', '.join(modes)}")
