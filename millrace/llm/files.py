"""Pairs of rows that meet in inverted files, for files of any length.

Rows come as postings (key, cid, payload). Those with one key form a file; a task reads whole files in the
order of their keys. Rows of a file longer than a block are handed on and meet in tasks of two blocks each,
so no file is truncated and no task holds more than two blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

#: Marks of rows whose file was not cut, and of rows that meet the rows of their own block.
NOT_CUT, WITHIN = -2, -1


def may_meet(side: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows a and b of one key are compared here: those of one block meet in a task of their own."""
    return (side[a] < 0) | (side[a] != side[b])


def pairs_in_files(postings: DataFrame, payload: str, compare: Callable[[pd.DataFrame], Iterator[np.ndarray]], block: int = 4096, batch: int = 20_000) -> DataFrame:
    """Distinct pairs (a, b), a < b, that ``compare`` finds among the rows with one key.

    ``postings`` has key bigint, cid bigint and the columns of ``payload`` (a schema without nulls). ``compare``
    gets rows sorted by key, with ``side``, and yields arrays of pairs (smaller cid, larger cid).
    """
    columns = [x.split()[0] for x in payload.split(", ")]
    schema = f"a bigint, b bigint, key bigint, {payload}"

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        held, passing = 0, None

        def met(done: pd.DataFrame) -> Iterator[pd.DataFrame]:
            got = list(compare(done))
            if got:
                u = np.unique(np.concatenate(got), axis=0)
                yield pd.DataFrame({"a": u[:, 0], "b": u[:, 1], "key": 0, **dict.fromkeys(columns, 0)})

        def handed_on(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"a": rows["cid"], "b": None, "key": rows["key"], **{c: rows[c] for c in columns}}).astype({"b": "Int64"})

        for pdf in itertools.chain(batches, [None]):
            if pdf is not None and len(pdf):
                if passing is not None:
                    cut = int(np.searchsorted(pdf["key"].to_numpy(), passing, side="right"))
                    if cut:
                        yield handed_on(pdf.iloc[:cut])
                    if cut == len(pdf):
                        continue
                    pdf, passing = pdf.iloc[cut:], None
                rest.append(pdf)
                held += len(pdf)
                if held < batch:
                    continue
            if not rest:
                continue
            whole = pd.concat(rest, ignore_index=True)
            keys = whole["key"].to_numpy()
            cut = len(whole) if pdf is None else int(np.searchsorted(keys, keys[-1]))
            done, open_file = whole.iloc[:cut], whole.iloc[cut:]
            if len(done) and done["side"].iat[0] == NOT_CUT:
                at, first, size = np.unique(done["key"].to_numpy(), return_index=True, return_counts=True)
                if (size > block).any():
                    long = np.repeat(size > block, size)
                    yield handed_on(done[long])
                    done = done[~long]
            if len(done) > 1:
                yield from met(done)
            if len(open_file) > block and open_file["side"].iat[0] == NOT_CUT:
                passing = open_file["key"].iat[0]
                yield handed_on(open_file)
                open_file = open_file.iloc[:0]
            rest, held = ([open_file], len(open_file)) if len(open_file) else ([], 0)

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInPandas(meet, schema)

    first = materialise(in_order(postings.select("key", "cid", *columns, F.lit(NOT_CUT).alias("side"))))
    found = first.where("b is not null").select("a", "b")
    long = first.where("b is null")
    if not long.isEmpty():
        # Blocks by hash of the class; each row visits the tasks of all pairs of blocks with its own block.
        blocks = long.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        marked = long.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("a"), "blocks").cast("int"))
        tasks = marked.select("key", F.col("a").alias("cid"), *columns, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        # Rows within one block meet once, in the task (own, own); elsewhere only rows of different sides meet.
        tasks = tasks.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "cid", *columns, F.when(F.col("own") == F.col("other"), F.lit(WITHIN)).otherwise(F.col("own")).alias("side"))
        found = found.unionByName(in_order(tasks).select("a", "b"))
    return found.distinct()
