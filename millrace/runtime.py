"""Session-level helpers shared by all operators."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table of that name below base (a file or a folder of Parquet parts)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local session without one (tests) gets a folder of its own, a cluster without one is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "millrace-checkpoints"))


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; losing an executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application, unless their PYTHONPATH has it."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_millrace_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="millrace-")  # on the driver only; Spark hands the file to the executors
    with zipfile.ZipFile(os.path.join(folder, "millrace.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(os.path.join(folder, "millrace.zip"))
    sc._millrace_shipped = True


def ship_file(spark: SparkSession, path: str) -> str:
    """Hand a file of the driver to all executors, once per application; the name under which :func:`shipped_path` finds it there."""
    sc = spark.sparkContext
    held = sc.__dict__.setdefault("_millrace_files", set())
    if path not in held:
        sc.addFile(path)
        held.add(path)
    return os.path.basename(path)


def shipped_path(name: str) -> str:
    """Where a shipped file lies on the machine of a task."""
    return SparkFiles.get(name)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than cores, for expressions that cost more than moving a small input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path in it, both as Java objects: whatever the cluster's Hadoop knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def child(spark: SparkSession, path, name: str):
    """The Java path of an entry of a folder."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name)


def read_document(spark: SparkSession, path: str, default: object = None) -> object:
    """A JSON document of the driver's size (a registry, a manifest); ``default`` if there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return default
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_document(spark: SparkSession, value: object, path: str) -> None:
    """Replace a JSON document in one step: written beside it, then renamed over it, so readers see the old one or the new one."""
    jvm = spark.sparkContext._jvm
    fs, p = file_system(spark, path)
    fresh = child(spark, p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(json.dumps(value, ensure_ascii=False, sort_keys=True).encode())
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fs.makeQualified(fresh), fs.makeQualified(p), over)
