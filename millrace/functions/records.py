"""Rules of the record table as columns, and JSON values by their structure."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stale(scope: Column, revision: Column, current: Column) -> Column:
    """Whether a record holds for one revision only, and not for the current one."""
    return F.coalesce((scope == "revision") & ~revision.eqNullSafe(current), F.lit(False))


def eligible(now: Column, current: Column, types: tuple[str, ...] = (), claims: tuple[str, ...] = (), least_importance: float = 0.0, allow_stale: bool = False) -> Column:
    """The predicate of every search among records: active, of an allowed type and claim, important enough, not expired, and not stale unless allowed.

    One condition over the columns of the record table, so a scan takes it in; empty tuples allow all.
    A null in a column that a rule reads leaves the record out, but for the time of expiry.
    """
    rule = (F.col("status") == "active") & (F.col("importance") >= least_importance) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    if types:
        rule &= F.col("memory_type").isin(*types)
    if claims:
        rule &= F.col("claim_status").isin(*claims)
    if not allow_stale:
        rule &= (F.col("scope") == "project") | (F.col("repo_revision") == current)
    return rule


def priority(importance: Column, rank: Column, is_stale: Column) -> Column:
    """The priority of a record in a context: 80 times its importance less its rank within 10 and 89, 30 less if stale."""
    return F.greatest(F.lit(10), F.least(F.lit(89), F.bround(80 * importance).cast("int") - rank)) - F.when(is_stale, 30).otherwise(0)


def _over_json(change: Callable[[object], object]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(change(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return run


def without_key(text: Column, key: str) -> Column:
    """A JSON text without the entries of that name at any depth; null where it isn't JSON."""

    def strip(x: object) -> object:
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if k != key}
        return [strip(v) for v in x] if isinstance(x, list) else x

    return _over_json(strip)(text)


# The entries of a JSON schema that describe and don't constrain.
ANNOTATIONS = ["title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$comment"]


def schema_structure(text: Column) -> Column:
    """A JSON schema without its annotations; a property that has the name of one stays, as do the values of enum and const."""

    def strip(x: object, names: bool = False) -> object:
        if isinstance(x, dict):
            return {k: v if k in ("enum", "const") and not names else strip(v, not names and k in ("properties", "patternProperties", "$defs", "definitions")) for k, v in x.items() if names or k not in ANNOTATIONS}
        return [strip(v) for v in x] if isinstance(x, list) else x

    return _over_json(strip)(text)


def json_depth(text: Column) -> Column:
    """Levels of objects and arrays: 0 for a single value, null where the text isn't JSON."""

    def depth(t: str | None) -> int | None:
        try:
            level = [json.loads(t)] if t is not None else None
        except (ValueError, RecursionError):
            return None
        n = 0
        while level is not None and (level := [x for x in level if isinstance(x, (dict, list))]):
            n += 1
            level = [v for x in level for v in (x.values() if isinstance(x, dict) else x)]
        return None if level is None else n

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([depth(t) for t in texts], dtype="Int32")

    return run(text)
