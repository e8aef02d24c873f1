"""Structure-aware chunking of source files: line budgets, Python symbols, Markdown sections, symbol listings."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_SCHEMA = "kind string, language string, start_line int, end_line int, content string, content_hash string, symbol string, heading_path array<string>"
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")


def line_spans(lengths: list[int], first: int, last: int, budget: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans (begin, end) of lines [first, last): as many as the budget holds, one at least; the next span goes back by the overlap.

    By prefix sums and binary search; each span begins after the one before it.
    """
    total = np.append(0, np.cumsum(lengths))
    begin = first
    while begin < last:
        end = min(last, max(begin + 1, int(np.searchsorted(total, total[begin] + budget, side="right")) - 1))
        yield begin, end
        if end >= last:
            return
        begin = max(begin + 1, end - overlap)


def split_lines(text: str) -> list[str]:
    """Lines with their line feeds; a last empty line doesn't count."""
    return text.splitlines(keepends=True)


def python_sections(text: str) -> list[tuple[int, int, str | None]] | None:
    """(first line, last line, symbol) of the top-level functions and classes and of what lies between; None if there are none or the text doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        return None
    symbols = [n for n in body if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))]
    if not symbols:
        return None
    out, at = [], 1
    for n in symbols:
        begin = min([n.lineno, *(d.lineno for d in n.decorator_list)])
        if at < begin:
            out.append((at, begin - 1, None))
        out.append((begin, n.end_lineno, n.name))
        at = n.end_lineno + 1
    lines = len(text.splitlines())
    return out + ([(at, lines, None)] if at <= lines else [])


def markdown_sections(text: str) -> list[tuple[int, int, list[str]]]:
    """(first line, last line, headings above and with it) of each section; the part before the first heading has none."""
    lines, out, stack, begin = text.splitlines(), [], [], 1
    path: list[str] = []
    for number, line in enumerate(lines, 1):
        if m := HEADING.match(line):
            if number > begin:
                out.append((begin, number - 1, path))
            stack = [*stack[: len(m[1]) - 1], m[2].strip()]
            path, begin = list(stack), number
    return [*out, (begin, len(lines), path)] if lines else []


def chunk_file(path: str, text: str, budget: int, overlap: int) -> Iterator[tuple]:
    """The chunks of one file in the order of CHUNK_SCHEMA; blank ones are left out."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    lines = split_lines(text)
    parts: list[tuple[int, int, str, str, str | None, list[str]]]
    if suffix == "py":
        found = python_sections(text)
        parts = [(a, b, "python_symbol" if s else "python_module", "python", s, []) for a, b, s in found] if found else [(1, len(lines), "text", "python", None, [])]
    elif suffix == "md":
        sections = markdown_sections(text)
        titled = any(p for _, _, p in sections)
        parts = [(a, b, "markdown_section" if titled else "text", "markdown", None, p) for a, b, p in sections]
    else:
        parts = [(1, len(lines), "text", suffix or "text", None, [])]
    lengths = [len(x) for x in lines]
    for first, last, kind, language, symbol, headings in parts:
        for a, b in line_spans(lengths, first - 1, min(last, len(lines)), budget, overlap):
            content = "".join(lines[a:b]).strip()
            if content:
                yield kind, language, a + 1, b, content, hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest(), symbol, headings


def map_files(df: DataFrame, keys: list[str], path: Column, text: Column, schema: str, explain: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    """One file to many rows in Arrow batches; null paths count as empty, null texts give no rows."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*key, *row) for *key, p, t in pdf.itertuples(index=False, name=None) if t is not None for row in explain(p or "", t)]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return df.select(*keys, path.alias("_path"), text.alias("_text")).mapInPandas(run, f"{kinds}, {schema}")


def chunk_files(df: DataFrame, keys: list[str], path: str = "path", text: str = "content", budget: int = 4000, overlap: int = 3) -> DataFrame:
    """The chunks of every file: its keys and CHUNK_SCHEMA. Empty and blank files give none."""
    return map_files(df, keys, F.col(path), F.col(text), CHUNK_SCHEMA, lambda p, t: chunk_file(p, t, budget, overlap))


def chunk_lines(df: DataFrame, keys: list[str], text: str, budget: int = 4000, overlap: int = 3) -> DataFrame:
    """(keys, start_line, end_line, content): chunks by lines alone, split at line feeds only."""

    def run(_: str, t: str) -> Iterator[tuple]:
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        for a, b in line_spans([len(x) for x in lines], 0, len(lines), budget, overlap):
            content = "".join(lines[a:b]).strip(" \t\r\n")
            if content:
                yield a + 1, b, content

    return map_files(df, keys, F.lit(""), F.col(text), "start_line int, end_line int, content string", run)


def inspect_python(_: str, text: str) -> Iterator[tuple]:
    """Imports and qualified definitions of one file: (entry, name, line, end_line, signature, decorators, doc)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, prefix = todo.pop()
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Import):
                yield from (("import", a.name, n.lineno, n.end_lineno, None, [], None) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                source = "." * n.level + (n.module or "")
                yield from (("import", f"{source}.{a.name}".lstrip(".") if not n.level else f"{source}:{a.name}", n.lineno, n.end_lineno, None, [], None) for a in n.names)
            elif isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{prefix}{n.name}"
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                signature = ", ".join(map(ast.unparse, n.bases)) if kind == "class" else ast.unparse(n.args)
                doc = (ast.get_docstring(n) or "").split("\n")[0] or None
                yield kind, name, n.lineno, n.end_lineno, f"({signature})", [ast.unparse(d) for d in n.decorator_list], doc
                todo.append((n, name + "."))
            else:
                todo.append((n, prefix))


PYTHON_SCHEMA = "entry string, name string, line int, end_line int, signature string, decorators array<string>, doc string"
