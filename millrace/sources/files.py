"""Sources and sinks: file trees, JSON lines with validation, reports, pages, relational stores."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import file_system

# What a scan takes in and which folders it passes over.
EXTENSIONS = ("py", "md", "txt", "toml", "yaml", "yml", "json")
IGNORED = (".git", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "node_modules", "venv")


def scan_tree(spark: SparkSession, root: str, max_bytes: int = 512_000, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, content, bytes, verdict): text files below the root by relative path.

    verdict is ``kept`` or why a file is left out (extension, size, encoding); files in ignored folders give no
    row at all. Names and sizes are judged before any content is read: the content column of what is left
    out is null.
    """
    either_case = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in extensions)
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    relative = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    inside = F.split(F.substring(relative, len(base) + 1, 1_000_000), "/")
    outside = ~F.exists(F.slice(inside, F.lit(1), F.size(inside) - 1), lambda s: s.isin(*IGNORED))
    named = lambda df: df.where(outside).withColumn("path", F.array_join(inside, "/"))
    # The length is pushed down and the glob filters the listing, so only files that may be kept are opened.
    wanted = named(source.option("pathGlobFilter", f"*.{{{either_case}}}").load(root).where(F.col("length") <= max_bytes))
    plain = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(plain), F.regexp_replace(plain, "^\ufeff", ""))
    kept = wanted.select("path", text.alias("content"), F.col("length").alias("bytes"), F.when(text.isNull(), "encoding").otherwise("kept").alias("verdict"))
    listed = named(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length"))
    early = F.when(~F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions), "extension").when(F.col("length") > max_bytes, "size")
    left_out = listed.select("path", F.lit(None).cast("string").alias("content"), F.col("length").alias("bytes"), early.alias("verdict")).where("verdict is not null")
    return kept.unionByName(left_out)


def read_cases(spark: SparkSession, path: str, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, violations(line, problem)) of JSON lines: broken lines, unknown fields, missing and repeated keys.

    Blank lines are skipped. A file set without a good row gives the one violation ``no cases``.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    known = [f.name for f in schema.fields]
    parsed = lines.withColumn("row", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    names = F.json_object_keys("value")
    # Lines without a key are no group; they are spread by their text.
    rows = parsed.withColumn("n", F.count("*").over(Window.partitionBy(F.col(f"row.{key}"), F.when(F.col(f"row.{key}").isNull(), F.xxhash64("value")))))
    problem = (
        F.when(F.col("row._bad").isNotNull() | names.isNull(), "broken line")
        .when(F.size(F.array_except(names, F.array(*map(F.lit, known)))) > 0, "unknown field")
        .when(F.col(f"row.{key}").isNull(), "missing key")
        .when(F.col("n") > 1, "repeated key")
    )
    judged = rows.select("value", "row", problem.alias("problem"))
    good = judged.where("problem is null").select(*(F.col(f"row.{c}").alias(c) for c in known))
    bad = judged.where("problem is not null").select(F.col("value").alias("line"), "problem")
    none = good.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("line"), F.lit("no cases").alias("problem"))
    return good, bad.unionByName(none)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines, whole or not at all: written beside the target, which is moved aside and deleted only when the new report is in its place.

    A crash between the two moves leaves the old report under ``path.old``, where :func:`read_report` finds it.
    """
    spark = df.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}"
    df.write.json(fresh)
    files, target = file_system(spark, path)
    source, aside = (file_system(spark, x)[1] for x in (fresh, f"{path}.old"))
    if files.exists(target):
        files.delete(aside, True)
        if not files.rename(target, aside):
            raise OSError(f"{path} can't be moved")
    if not files.rename(source, target):
        if files.exists(aside):
            files.rename(aside, target)
        raise OSError(f"{fresh} can't be moved to {path}")
    files.delete(aside, True)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The last whole report of that path."""
    files, target = file_system(spark, path)
    return spark.read.json(path if files.exists(target) else f"{path}.old")


def _open(path: str):
    """A file and its bytes, from a local path or a URI of any file system that pyarrow knows."""
    files, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files, inner


class PagedSource(DataSource):
    """A source that is read in pages, JSON lines of a file or a folder of ``options['path']``.

    A page has a token, the token of the next page if there is one, and items. The driver follows the tokens and
    notes places only; it guards against cycles, pages that come twice and more pages than ``max_pages``. Tasks
    read the items, ``pages_per_task`` pages each. Register with ``spark.dataSource.register``.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, position int, item string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _Pages(InputPartition):
    def __init__(self, places: list[tuple[int, str, int]]) -> None:
        self.places = places


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most, self.at_once = options["path"], int(options.get("max_pages", "1000")), int(options.get("pages_per_task", "1"))

    def partitions(self) -> list[_Pages]:
        """The pages in the order of their tokens."""
        files, inner = _open(self.path)
        info = files.get_file_info(inner)
        names = [inner] if info.is_file else sorted(x.path for x in files.get_file_info(fs.FileSelector(inner)) if x.is_file and not x.base_name.startswith(("_", ".")))
        places: dict[str, tuple[str, int, str | None]] = {}
        for name in names:
            with files.open_input_stream(name) as f:
                at = 0
                for line in io.BufferedReader(f):
                    if line.strip():
                        page = json.loads(line)
                        if page["token"] in places:
                            raise ValueError(f"the page {page['token']!r} comes twice")
                        places[page["token"]] = (name, at, page.get("next"))
                    at += len(line)
        out, token, seen = [], "", set()
        while token is not None:
            if token in seen or token not in places:
                raise ValueError(f"the pages lead to {token!r} " + ("again" if token in seen else "which isn't there"))
            if len(out) == self.most:
                raise ValueError(f"there are more than {self.most} pages")
            seen.add(token)
            name, at, token = places[token]
            out.append((len(out), name, at))
        return [_Pages(out[i : i + self.at_once]) for i in range(0, len(out), self.at_once)]

    def read(self, part: _Pages) -> Iterator[tuple[int, int, str]]:
        """The items of some pages."""
        files, _ = _open(self.path)
        for number, name, at in part.places:
            with files.open_input_file(name) as f:
                f.seek(at)
                for k, item in enumerate(json.loads(io.BufferedReader(f).readline())["items"]):
                    yield number, k, item


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a relational store in ranges of a numeric key, one query for each; the driver class must be on the class path."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def count_or_zero(spark: SparkSession, table: str) -> int:
    """The rows of a catalog table, 0 if there is none of that name."""
    return spark.table(table).count() if spark.catalog.tableExists(table) else 0
