"""Maintenance of keyed tables: differences between revisions, upserts, deletes, latest views, caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import materialise


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; ranks are cut in each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): added, deleted, changed or unchanged, by a null-safe comparison of the value."""
    o = old.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    n = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return o.join(n, keys, "full_outer").select(*keys, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """All rows by key, the new ones first (``replace``) or the old ones first (insert or ignore)."""
    first, second = (new, old) if replace else (old, new)
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key isn't in ``gone``."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def through_cache(requests: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, the cache with the misses): distinct keys are looked up, only misses are computed, requests keep their rows.

    ``compute`` takes distinct rows of the requests and gives (key, value); the cache has the same columns.
    """
    misses = requests.dropDuplicates([key]).join(cache, key, "left_anti")
    filled = cache.unionByName(compute(misses).select(*cache.columns))
    return requests.join(filled, key, "left"), filled


def ordered_hash(df: DataFrame, by: list[str], entry: Column) -> DataFrame:
    """(by, entries, digest): the SHA-256 of the sorted entries of each group, joined by line feeds.

    The entries of one group meet in one task, as the hash is defined over all of them in order.
    """
    return df.groupBy(*by).agg(F.count(entry).alias("entries"), F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "\n"), 256).alias("digest"))


def bounded(df: DataFrame, most: int) -> DataFrame:
    """The table as it is; more rows than ``most`` are an error. One row beyond is looked for, no more."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"there are more than {most} rows")
    return df


def first_rows(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows in order with ``limit_reached``: whether there are more. Each task hands on ``most`` + 1 rows."""
    taken = df.orderBy(*order).limit(most + 1)
    place = taken.withColumn("r", F.row_number().over(Window.orderBy(*order)))
    return place.withColumn("limit_reached", F.max("r").over(Window.partitionBy()) > most).where(F.col("r") <= most).drop("r")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their number from 0 in order: sorted by range, numbered within partitions, with offsets of the partitions before."""
    parts = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(name, within).join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def listing(files: DataFrame, by: str, path: str, size: str, max_depth: int, max_results: int, glob: str | None = None) -> DataFrame:
    """(by, entry, is_folder, size, limit_reached): folders and files of each group to a depth, by path, cut at ``max_results``.

    A folder lies at the depth of its segments, a file at that of its folder. ``glob`` is matched against the whole
    path or the name.
    """
    if not 0 <= max_depth <= 20 or not 1 <= max_results <= 5_000:
        raise ValueError("max_depth must be 0 to 20 and max_results 1 to 5,000")
    s = files.select(by, F.col(path).alias("entry"), F.col(size).alias("size"), F.split(path, "/").alias("s"))
    deep = F.least(F.lit(max_depth), F.size("s") - 1)
    folders = s.where(deep > 0).select(by, F.explode(F.transform(F.sequence(F.lit(1), deep), lambda k: F.array_join(F.slice("s", F.lit(1), k), "/"))).alias("entry")).distinct()
    entries = folders.select(by, "entry", F.lit(True).alias("is_folder"), F.lit(None).cast("bigint").alias("size")).unionByName(s.where(F.size("s") - 1 <= max_depth).select(by, "entry", F.lit(False).alias("is_folder"), "size"))
    if glob is not None:
        entries = entries.where(T.glob_match(F.col("entry"), glob))
    # One row beyond the limit tells that there are more; the window hands on no more than that of each task.
    taken = entries.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("entry"))).where(F.col("r") <= max_results + 1)
    return taken.withColumn("limit_reached", F.max("r").over(Window.partitionBy(by)) > max_results).where(F.col("r") <= max_results).drop("r")
