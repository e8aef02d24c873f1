"""Splitting oversized items at natural boundaries, by ranges.

An item is cut into ranges. Tasks find boundaries in single ranges, looking a halo into the next one; the
small boundary tables are stitched per item, lengths are prefix-summed, pieces are chosen by offset and
then emitted from the ranges they touch. No task needs a whole item but for the table of its boundaries,
which holds at most one entry per cell of ``limit // 16`` characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from the strongest kind to the weakest; a cut comes after the match. The end of a range needs the halo.
KINDS = [
    re.compile(r"\n(?:[ \t\r]*\n)+|\n(?=(?:async def|def|class|export|function|@\w|#{1,6} |\[\w))"),
    re.compile(r"\n"),
    re.compile(r"[.!?;]['\")\]]*\s+|[。！？；]"),
    re.compile(r"\s+|[,，、:：}\])]"),
]
HALO = 256


def text_ranges(df: DataFrame, id_col: str, text_col: str, limit: int, range_chars: int) -> DataFrame:
    """(id, r, body, ahead): the ranges of every text longer than the limit.

    Their length is a multiple of the cells of the boundary tables, so the cuts don't depend on it. Each text is
    read through once and its ranges leave one after the other.
    """
    cell = max(1, limit // 16)
    range_chars = max(1, range_chars // cell) * cell
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null").where(F.length("text") > limit)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for i, text in zip(pdf["id"], pdf["text"]):
                for r, at in enumerate(range(0, len(text), range_chars)):
                    end = at + range_chars
                    rows.append((i, r, text[at:end], text[end : end + HALO]))
                    held += range_chars
                    if held > 16_000_000:
                        yield pd.DataFrame(rows, columns=["id", "r", "body", "ahead"])
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=["id", "r", "body", "ahead"])

    return src.mapInPandas(cut, "id string, r int, body string, ahead string")


def read_range(path: str, at: int, size: int) -> bytes:
    """Bytes of a file from the offset on; the path is a local one or a URI of any file system that pyarrow knows (hdfs, s3, gs, file)."""
    files, inner = fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)
    with files.open_input_file(inner) as f:
        return f.read_at(size, at) if at < f.size() else b""


def file_ranges(files: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """(id, r, body, ahead) of UTF-8 files (id, path, bytes) on a file system that all executors reach, by byte ranges.

    A character belongs to the range in which its first byte lies; wrong bytes are replaced. Each task
    reads its range and a halo, never the whole file.
    """
    parts = files.select("id", "path", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("bytes") / range_bytes).cast("int") - 1))).alias("r"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def skip(raw: bytes) -> int:
            return next((k for k in range(min(4, len(raw))) if raw[k] & 0xC0 != 0x80), min(4, len(raw)))

        for pdf in batches:
            for i, path, r in zip(pdf["id"], pdf["path"], pdf["r"]):
                raw = read_range(path, r * range_bytes, range_bytes + 4 * HALO)
                own, more = raw[:range_bytes], raw[range_bytes:]
                own = own[skip(own) if r else 0 :] + more[: skip(more)]
                more = more[skip(more) :]
                yield pd.DataFrame({"id": [i], "r": [r], "body": [own.decode("utf-8", "replace")], "ahead": [more.decode("utf-8", "ignore")[:HALO]]})

    return parts.repartition(F.col("id"), F.col("r")).mapInPandas(read, "id string, r int, body string, ahead string")


def range_boundaries(body: str, ahead: str, cell: int) -> tuple[list[int], list[int]]:
    """Cut offsets in (0, len(body)] and their strengths (3 the strongest), the best of each cell, a later one if equal."""
    text, best = body + ahead, {}
    for kind, pattern in enumerate(KINDS):
        strength = len(KINDS) - 1 - kind
        for m in pattern.finditer(text):
            at = m.end()
            if at > len(body):
                break
            if at and at < len(text) + (not ahead):
                c = (at - 1) // cell
                if c not in best or (strength, at) > best[c]:
                    best[c] = (strength, at)
    order = [best[c] for c in sorted(best)]
    return [p for _, p in order], [s for s, _ in order]


def choose_pieces(total: int, pos: np.ndarray, strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (begin, end) of at most ``limit``; a cut takes the strongest boundary of the piece's second half, of equals the last."""
    pieces, begin = [], 0
    while total - begin > limit:
        lo = np.searchsorted(pos, begin + max(limit // 2, overlap), side="right")
        hi = np.searchsorted(pos, begin + limit, side="right")
        end = begin + limit
        if hi > lo:
            s = strength[lo:hi]
            end = int(pos[lo + len(s) - 1 - int(np.argmax(s[::-1]))])
        pieces.append((begin, end))
        begin = end - overlap
    pieces.append((begin, total))
    return pieces


def split_ranges(ranges: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(id, piece, pieces, begin, end, first_line, last_line, text) from ranges (id, r, body, ahead).

    begin is included, end isn't; both count code points. Lines count from 1 by line feeds. Consecutive
    pieces share exactly ``overlap`` characters, so the first piece and the others without their first
    ``overlap`` characters give the item back.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("overlap must be between 0 and half the limit")
    cell = max(1, limit // 16)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [range_boundaries(b, a or "", cell) for b, a in zip(pdf["body"], pdf["ahead"])]
            yield pd.DataFrame({"id": pdf["id"], "r": pdf["r"], "chars": pdf["body"].str.len(), "feeds": pdf["body"].str.count("\n"), "pos": [p for p, _ in got], "strength": [s for _, s in got]})

    tables = ranges.mapInPandas(find, "id string, r int, chars int, feeds int, pos array<int>, strength array<int>")
    items = tables.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("r", "chars", "feeds", "pos", "strength"))).alias("t"))

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, table in zip(pdf["id"], pdf["t"]):
                chars = np.array([x["chars"] for x in table], dtype=np.int64)
                start = np.append(0, np.cumsum(chars))
                lines = np.append(0, np.cumsum([x["feeds"] for x in table]))
                pos = np.concatenate([np.asarray(x["pos"], dtype=np.int64) + start[k] for k, x in enumerate(table)])
                strength = np.concatenate([np.asarray(x["strength"], dtype=np.int64) for x in table])
                pieces = choose_pieces(int(start[-1]), pos, strength, limit, overlap)
                for n, (b, e) in enumerate(pieces):
                    for k in range(int(np.searchsorted(start, b, side="right")) - 1, int(np.searchsorted(start, e, side="left"))):
                        out.append((i, int(table[k]["r"]), n, len(pieces), b, e, int(max(b, start[k]) - start[k]), int(min(e, start[k + 1]) - start[k]), int(lines[k])))
            yield pd.DataFrame(out, columns=["id", "r", "piece", "pieces", "begin", "end", "lo", "hi", "lines"])

    slices = items.mapInPandas(stitch, "id string, r int, piece int, pieces int, begin bigint, end bigint, lo int, hi int, lines bigint")
    parts = slices.join(ranges.select("id", "r", "body"), ["id", "r"])
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    parts = parts.select("id", "r", "piece", "pieces", "begin", "end", F.expr("substring(body, lo + 1, hi - lo)").alias("part"), (F.col("lines") + feeds(F.expr("substring(body, 1, lo)")) + 1).alias("first"), (F.col("lines") + feeds(F.expr("substring(body, 1, hi - 1)")) + 1).alias("last"))
    whole = parts.groupBy("id", "piece", "pieces", "begin", "end").agg(F.min("first").alias("first_line"), F.max("last").alias("last_line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "part"))), lambda x: x["part"]), "").alias("text"))
    return whole.select("id", "piece", "pieces", "begin", "end", "first_line", "last_line", "text")


def split_items(df: DataFrame, id_col: str, text_col: str, line_col: str | None = None, limit: int = 4000, overlap: int = 200, range_chars: int = 262_144) -> DataFrame:
    """Pieces of every text longer than ``limit`` code points: (id, piece, pieces, begin, end, start_line, end_line, text).

    Shorter and null texts and null ids give no rows; ids should be unique. ``line_col`` holds the line of the
    file at which the text begins (null counts as 1).
    """
    pieces = split_ranges(text_ranges(df, id_col, text_col, limit, range_chars), limit, overlap)
    if line_col is None:
        return pieces.withColumnsRenamed({"first_line": "start_line", "last_line": "end_line"})
    base = df.where(F.length(text_col) > limit).select(F.col(id_col).cast("string").alias("id"), (F.coalesce(F.col(line_col), F.lit(1)) - 1).alias("base"))
    out = pieces.join(base, "id")
    return out.select("id", "piece", "pieces", "begin", "end", (F.col("base") + F.col("first_line")).alias("start_line"), (F.col("base") + F.col("last_line")).alias("end_line"), "text")
