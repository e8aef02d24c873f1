"""SQLite tables as source and sink, for stores on a file system that all executors share."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

KINDS = {"INT": "bigint", "CHAR": "string", "CLOB": "string", "TEXT": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _columns(path: str, table: str) -> list[tuple[str, str]]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        found = db.execute(f"pragma table_info({_quoted(table)})").fetchall()
    if not found:
        raise ValueError(f"{path} has no table {table}")
    return [(name, next((k for mark, k in KINDS.items() if mark in kind.upper()), "string")) for _, name, kind, *_ in found]


class SqliteSource(DataSource):
    """``options``: path, table, partitions (8). Types follow the declared affinities. Register with ``spark.dataSource.register``.

    Reading cuts the table into ranges of row ids, a connection for each task. Writing appends or overwrites: each
    task fills a table of its own, and one transaction at the end moves all rows, so a failed job leaves no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return ", ".join(f"`{c}` {k}" for c, k in _columns(self.options["path"], self.options["table"]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, [f.name for f in schema.fields])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.path, self.table, self.parts, self.columns = options["path"], options["table"], int(options.get("partitions", "8")), columns

    def partitions(self) -> list[_Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"select {', '.join(map(_quoted, self.columns))} from {_quoted(self.table)} where rowid >= ? and rowid < ?", (part.low, part.high))


class _Staged(WriterCommitMessage):
    def __init__(self, table: str) -> None:
        self.table = table


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool) -> None:
        self.path, self.table, self.overwrite, self.job = options["path"], options["table"], overwrite, uuid.uuid4().hex
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        self.columns = [f.name for f in schema.fields]
        self.declared = ", ".join(f"{_quoted(f.name)} {kinds.get(f.dataType.simpleString(), 'TEXT')}" for f in schema.fields)

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path, timeout=300, isolation_level=None)

    def write(self, rows: Iterator[Row]) -> _Staged:
        """Rows of one task into a table of its own."""
        staged = f"_staged_{self.job}_{uuid.uuid4().hex}"
        db = self._connect()
        try:
            db.execute("begin immediate")
            db.execute(f"create table {_quoted(staged)} ({self.declared})")
            db.executemany(f"insert into {_quoted(staged)} values ({', '.join('?' * len(self.columns))})", (tuple(r) for r in rows))
            db.execute("commit")
        finally:
            db.close()
        return _Staged(staged)

    def _left(self, db: sqlite3.Connection) -> list[str]:
        return [x for (x,) in db.execute("select name from sqlite_master where type = 'table' and name like ?", (f"_staged_{self.job}_%",))]

    def commit(self, messages: list[_Staged | None]) -> None:
        """Move the rows of the tasks that count; drop what attempts that don't count left."""
        db = self._connect()
        try:
            db.execute("begin immediate")
            if self.overwrite:
                db.execute(f"drop table if exists {_quoted(self.table)}")
            db.execute(f"create table if not exists {_quoted(self.table)} ({self.declared})")
            names = ", ".join(map(_quoted, self.columns))
            for m in messages:
                if m is not None:
                    db.execute(f"insert into {_quoted(self.table)} ({names}) select {names} from {_quoted(m.table)}")
            for x in self._left(db):
                db.execute(f"drop table {_quoted(x)}")
            db.execute("commit")
        finally:
            db.close()

    def abort(self, messages: list[_Staged | None]) -> None:
        """Nothing of the job stays."""
        db = self._connect()
        try:
            for x in self._left(db):
                db.execute(f"drop table {_quoted(x)}")
        finally:
            db.close()


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of an SQLite file."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", str(partitions)).load()


def write_sqlite(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Rows into a table of an SQLite file, all or none."""
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("sqlite").option("path", path).option("table", table).mode(mode).save()
