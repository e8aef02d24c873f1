"""Vector expressions and signed feature hashing."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; 0 if one vector has no length, null if the dimensions differ."""
    lengths = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(lengths == 0, F.lit(0.0).cast("double")).otherwise(dot(a, b) / lengths)


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a vector without length stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def feature_hash(df: DataFrame, key: str, words: Column, dimensions: int = 256) -> DataFrame:
    """(key, embedding): signed feature hashing of an array of features by BLAKE2b-16, scaled to length 1.

    In Arrow batches; there is no native BLAKE2b. No features give the zero vector.
    """

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[int, float]] = {}
        for pdf in batches:
            out = []
            for row in pdf["words"]:
                v = [0.0] * dimensions
                for w in row if row is not None else ():
                    if w not in seen:
                        d = hashlib.blake2b(w.encode(), digest_size=16).digest()
                        if len(seen) > 200_000:
                            seen.clear()
                        seen[w] = (int.from_bytes(d[:8], "big") % dimensions, 1.0 if d[8] & 1 else -1.0)
                    at, sign = seen[w]
                    v[at] += sign
                length = math.sqrt(sum(x * x for x in v))
                out.append([x / length for x in v] if length else v)
            yield pd.DataFrame({key: pdf[key], "embedding": out})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, words.alias("words")).mapInPandas(embed, f"{key} {kind}, embedding array<double>")


def literal(a: Column) -> Column:
    """A vector as a text in brackets, its numbers with 12 significant digits; null stays null."""

    @F.pandas_udf("string")
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else "[" + ",".join("%.12g" % x for x in v) + "]" for v in vectors], dtype=object)

    return run(F.transform(a, lambda x: x.cast("double")))


def place_and_sign(word: str, dimensions: int) -> tuple[int, int]:
    """A feature's place by the first digits of its MD5 and its sign by the eighth."""
    digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:7], 16) % dimensions, 1 if int(digest[7], 16) % 2 else -1
