"""Streaming jobs: file streams over tables, deduplication, keyed state, windows, an incremental index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import tables
from ..runtime import child, file_system, new_folder, read_document, write_document


def table_stream(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A file stream over a table that is a Parquet file or a folder of them; its schema is read, not inferred from rows."""
    whole = spark.read.parquet(f"{base}/{name}.parquet")
    reader = spark.readStream.schema(whole.schema)
    if any(f.rstrip("/").endswith(f"/{name}.parquet") for f in whole.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(base)
    return reader.parquet(f"{base}/{name}.parquet")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", folder: str | None = None) -> None:
    """Hand all available micro-batches to a function, then stop; what was done is noted in the folder."""
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder or new_folder(stream.sparkSession, "stream")}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives over all available input. In complete mode the last micro-batch is the result.

    Each micro-batch overwrites its own folder, so a batch that is run again after a failure leaves no rows twice.
    """
    spark, out = stream.sparkSession, new_folder(stream.sparkSession, "stream")
    done: list[str] = []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch-{n}")
        if f"{out}/batch-{n}" not in done:
            done.append(f"{out}/batch-{n}")

    run_batches(stream, write, mode)
    paths = done[-1:] if mode == "complete" else done
    return spark.read.parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def first_deliveries(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once, as long as deliveries come within the given time of each other."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def hourly(events: DataFrame, time: str, late: str) -> DataFrame:
    """Counts and sums by hour and event type."""
    w = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", "1 hour").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def newest_by_key(records: DataFrame, keys: list[str], time: str, id_col: str) -> DataFrame:
    """(keys, seen, newest): per key the number of records and the newest by time and id, as state that lives across micro-batches."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, at, newest = state.get if state.exists else (0, -(2**63), "")
        for pdf in pdfs:
            seen += len(pdf)
            for t, i in zip(pdf["_t"], pdf[id_col]):
                if (t, i) > (at, newest):
                    at, newest = int(t), i
        state.update((seen, at, newest))
        yield pd.DataFrame([(*key, seen, newest)], columns=[*keys, "seen", "newest"])

    kinds = ", ".join(f"{k} {records.schema[k].dataType.simpleString()}" for k in keys)
    folded = records.select(*keys, id_col, F.unix_micros(F.col(time).cast("timestamp")).alias("_t")).groupBy(*keys).applyInPandasWithState(fold, f"{kinds}, seen bigint, newest string", "seen bigint, at bigint, newest string", "update", GroupStateTimeout.NoTimeout)
    return tables.latest(run_to_table(folded, "update"), keys, [F.desc("seen")])


def key_actions(records: DataFrame, keys: list[str], time: str, id_col: str, content: str, sure: Column) -> DataFrame:
    """(keys, id, action): what each record does to the state of its key, in the order of time and id.

    The first record of a key creates it; one with the content that the key holds is a duplicate; another one
    supersedes it if it is ``sure``, else it is pending. The state is the digest of the content, so it stays
    small; it lives across micro-batches, records of which arrive in order.
    """

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["_t", id_col])
        actions = []
        for digest, is_sure in zip(rows["_d"], rows["_s"]):
            action = "create" if held is None else "duplicate" if digest == held else "supersede" if is_sure else "pending"
            if action in ("create", "supersede"):
                held = digest
            actions.append(action)
        state.update((held,))
        yield pd.DataFrame({**dict(zip(keys, key)), id_col: rows[id_col].to_numpy(), "action": actions})

    kinds = ", ".join(f"{k} {records.schema[k].dataType.simpleString()}" for k in [*keys, id_col])
    rows = records.select(*keys, id_col, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.sha2(F.coalesce(content, F.lit("")), 256).alias("_d"), sure.alias("_s"))
    return run_to_table(rows.groupBy(*keys).applyInPandasWithState(fold, f"{kinds}, action string", "held string", "append", GroupStateTimeout.NoTimeout))


def write_once(stream: DataFrame, key: str, folder: str | None = None) -> DataFrame:
    """The rows of a stream, each key once, however often rows are delivered or batches are run again.

    A batch is written over its own folder, without the keys of the batches before it. With a ``folder`` of its own a
    job that is started again goes on where it stopped.
    """
    spark, out = stream.sparkSession, folder or new_folder(stream.sparkSession, "stream")

    def write(batch: DataFrame, n: int) -> None:
        rows = batch.dropDuplicates([key])
        before = _numbered(spark, out, "batch-", n)
        if before:
            rows = rows.join(spark.read.parquet(*before).select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{out}/batch-{n}")

    run_batches(stream, write, folder=out)
    done = _numbered(spark, out, "batch-")
    return spark.read.parquet(*done) if done else spark.createDataFrame([], stream.schema)


def _numbered(spark: SparkSession, folder: str, prefix: str, below: int | None = None) -> list[str]:
    """The whole results of that prefix in the folder, by number."""
    fs, path = file_system(spark, folder)
    found = []
    for x in fs.listStatus(path) if fs.exists(path) else []:
        name = x.getPath().getName()
        number = name.removeprefix(prefix).removesuffix(".json")
        if name.startswith(prefix) and number.isdigit() and (x.isFile() or fs.exists(child(spark, x.getPath(), "_SUCCESS"))):
            found.append((int(number), x.getPath().toString()))
    return [p for k, p in sorted(found) if below is None or k < below]


def incremental_index(changes: DataFrame, keys: list[str], order: list[str], folder: str | None = None, buckets: int = 32) -> DataFrame:
    """The newest row of each key after all micro-batches.

    Rows lie in buckets by their key. A micro-batch merges its rows into the buckets that it touches and then
    writes a manifest with the place of every bucket, whole or not at all; readers only see manifests, and a
    batch that is run again writes the same. With a ``folder`` of its own the index outlives the job: a job that
    is started again goes on with its last manifest.
    """
    spark, out = changes.sparkSession, folder or new_folder(changes.sparkSession, "stream")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def newest(below: int | None = None) -> dict[str, str]:
        manifests = _numbered(spark, out, "manifest-", below)
        return read_document(spark, manifests[-1]) if manifests else {}

    def merge(batch: DataFrame, n: int) -> None:
        held = newest(n)
        batch = batch.withColumn("_bucket", bucket)
        touched = sorted(str(r[0]) for r in batch.select("_bucket").distinct().collect())
        before = [held[b] for b in touched if b in held]
        rows = batch.unionByName(spark.read.parquet(*before).withColumn("_bucket", bucket)) if before else batch
        tables.latest(rows, keys, [F.desc(c) for c in order]).write.mode("overwrite").partitionBy("_bucket").parquet(f"{out}/version-{n}")
        write_document(spark, held | {b: f"{out}/version-{n}/_bucket={b}" for b in touched}, f"{out}/manifest-{n}.json")

    run_batches(changes, merge, folder=out)
    held = newest()
    return spark.read.parquet(*held.values()) if held else spark.createDataFrame([], changes.schema)


def guard_revision(spark: SparkSession, folder: str, project: str, revision: str) -> None:
    """Let a job go on in a folder only for the project and revision for which it was begun; anything else is an error."""
    path, own = f"{folder}/guard.json", {"project": project, "revision": revision}
    begun = read_document(spark, path)
    if begun is None:
        write_document(spark, own, path)
    elif begun != own:
        raise ValueError(f"{folder} was begun for {begun}, not for {own}")


def reduced_states(events: DataFrame, by: list[str], order: list[str], appended: dict[str, Column], replaced: dict[str, Column]) -> DataFrame:
    """(by, events, the columns): the state of each run after all its events in order.

    ``appended`` values are gathered in order, nulls left out; of ``replaced`` ones the last that isn't null stays.
    """
    place = F.struct(*order)
    grow = [F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(place.alias("at"), c.alias("v"))))), lambda x: x["v"]).alias(n) for n, c in appended.items()]
    last = [F.max_by(c, F.when(c.isNotNull(), place)).alias(n) for n, c in replaced.items()]
    return events.groupBy(*by).agg(F.count("*").alias("events"), *grow, *last)
