"""Generated, minified or vendored source files and data saved as code.

Declared repositories: their attribute files mark generated and vendored paths; patterns are resolved by
directory, deeper files and later lines first. Undeclared paths are judged by equivalent patterns: signs mined
from the marked files of declared repositories, public directory and file name conventions, notices in the
comments of a file, and the shape of the content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

# Public conventions for vendored directories and for the names of tool output.
VENDOR_DIRS = re.compile(r"(?i)(?:^|/)(?:vendor|third[_-]?party|node_modules|bower_components|site-packages|dist-packages|\.?venv|virtualenv|_vendor|godeps|carthage|pods|\.yarn|jspm_packages)/|^(?:externals?|extern|deps)/")
GENERATED_NAMES = re.compile(r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pdm\.lock|uv\.lock|cargo\.lock|go\.sum|composer\.lock|gemfile\.lock|pipfile\.lock|[^/]*(?:_pb2(?:_grpc)?\.pyi?|\.pb\.go|\.pb\.cc|\.pb\.h|_parsetab\.py|parsetab\.py|lextab\.py|\.lock\.json|\.resolved\.json|\.min\.(?:js|css|mjs)|\.bundle\.js|[-.]lock\.ya?ml|\.map|\.g\.(?:dart|py|js)|\.generated\.\w+|_generated\.\w+|\.designer\.cs))$")
GENERATED_NOTICE = re.compile(r"(?i)@generated\b|(?:^\W*|[.!;:)—–-]\W*|\bgenerated\b.*)\bdo not (?:edit|modify|change)\b|\bauto[- ]?generated\b|\b(?:automatically|machine)[- ](?:created|generated|written|produced|output)\b|\bmachine output\b|\b(?:file|code|module) (?:was |is )?generated (?:by|from|with|using)\b|^\W*(?:generated|produced|emitted|compiled|created) (?:by|from|with|using)\b|\bchanges (?:\w+ ){0,3}(?:lost|overwritten)\b|\bregenerate (?:with|by|using)\b|\bedit the \w+ instead\b|自动生成|请勿(?:手工|手动)?(?:修改|编辑)|automatisch (?:erzeugt|generiert)|nicht (?:von Hand )?(?:bearbeiten|ändern)")
VENDOR_NOTICE = re.compile(r"(?i)^\W*(?:vendored\b|upstream:|(?:copied|taken|imported|synced|downloaded|mirrored) (?:verbatim )?from (?:https?://|\w+ v?\d)|keep in sync with upstream|author: \w+ maintainers|redistribution (?:and use )?permitted)|\blocal changes are not allowed\b|\blicense\.\w+\b")
VERSION_NOTICE = re.compile(r"^\W*([A-Za-z][\w.-]+) v?\d+\.\d+(?:\.\d+)?\W*$")
# What says of the file around it that it was generated, wherever it stands; other notices may speak of the next lines.
FILE_NOTICE = re.compile(r"(?i)^\W*@generated\b|^\W*(?:code )?(?:auto[- ]?)?generated (?:by|from|with|using)\b.*\bdo not (?:edit|modify|change)\b|^\W*this (?:file|module) (?:was|is|has been) (?:(?:auto|automatically|machine)[- ]?)?(?:generated|created|produced|written) (?:by|from|with|using)\b|此文件由.*自动生成|diese datei wurde automatisch (?:erzeugt|generiert)")
PROSE = (".md", ".rst", ".txt", ".adoc")
# String literals and comments by the family of the language; a match with a group c is a comment.
_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
_LONG = r"(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z))"
_HEREDOC = r"<<[-~]?(?P<q>[\"']?)(?P<tag>[A-Za-z_]\w*)(?P=q)[^\n]*\n.*?(?:^[ \t]*(?P=tag)\b|\Z)"
LEXERS = {
    "hash": re.compile(rf"{_LONG}|{_STRINGS}|(?P<c>#[^\n]*)", re.S),
    "shell": re.compile(rf"{_HEREDOC}|{_STRINGS}|(?P<c>#[^\n]*)", re.S | re.M),
    "slash": re.compile(rf"{_STRINGS}|`(?:\\.|[^`\\])*(?:`|\Z)|(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))", re.S),
    "dash": re.compile(rf"{_STRINGS}|(?P<c>--[^\n]*|/\*.*?(?:\*/|\Z))", re.S),
    "sign": re.compile(rf"{_STRINGS}|(?P<c>[;%#][^\n]*)", re.S),
    "markup": re.compile(r"(?P<c><!--.*?(?:-->|\Z))", re.S),
}
FAMILIES = {
    **dict.fromkeys(("py", "pyi", "pyx", "yaml", "yml", "toml", "cfg", "env", "r", "jl", "mk", "makefile", "cmake", "bzl", "tf", "ex", "exs", "graphql"), "hash"), **dict.fromkeys(("sh", "bash", "zsh", "rb", "pl", "pm", "ps1", "dockerfile"), "shell"),
    **dict.fromkeys(("sql", "lua", "hs", "elm", "adb", "ads"), "dash"), **dict.fromkeys(("ini", "lisp", "el", "clj", "scm", "asm", "s", "tex", "erl", "hrl"), "sign"), **dict.fromkeys(("html", "htm", "xml", "svg", "vue", "xhtml"), "markup"),
}
COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|\"\"\"|'''|<!--|--|;|%)")


def head_notices(content: str) -> list[str]:
    """The comment lines (or the docstring) with which a file begins, before any code."""
    out, quote = [], ""
    for line in content.lstrip("\ufeff").split("\n"):
        s = line.strip()
        if quote:
            out.append(s)
            if quote in s:
                quote = ""
        elif not s or s.startswith("#!"):
            continue
        elif COMMENT.match(line) or s.startswith('"//"') or s.startswith(('"_comment"', '"__generated__"')):
            out.append(s)
            for q in ('"""', "'''"):
                if s.startswith(q) and q not in s[3:]:
                    quote = q
            if s.startswith("/*") and "*/" not in s:
                quote = "*/"
        elif s in ("{", "["):
            continue
        else:
            break
    return out


def later_notices(path: str, content: str) -> tuple[list[str], list[str]]:
    """The lines of the comments with which a file ends, and those of all its comments.

    A comment counts if it begins its line, unindented, and outside string literals, which tools that write such
    files hold.
    """
    family = FAMILIES.get(path.lower().rsplit("/", 1)[-1].rsplit(".", 1)[-1], "slash")
    found = [m.span("c") for m in LEXERS[family].finditer(content) if m["c"] is not None and (m.start() == 0 or content[m.start() - 1] == "\n")]
    foot, end = len(found), len(content)
    while foot and not content[found[foot - 1][1] : end].strip():
        foot -= 1
        end = found[foot][0]
    lines = [[x.strip() for x in content[a:b].split("\n")] for a, b in found]
    return [x for c in lines[foot:] for x in c], [x for c in lines for x in c]


def shape(content: str) -> str | None:
    """minified or data by the look of the text, generated by the sameness of its lines; None for the rest."""
    n = len(content)
    if n < 200:
        return None
    lines = [x for x in content.split("\n") if x.strip()]
    long = sum(len(x) for x in lines if len(x) > 400)
    if long > 0.6 * n:
        body = "".join(x for x in lines if len(x) > 400)
        digits = sum(map(body.count, "0123456789"))
        if digits > 0.4 * len(body) or len(re.findall(r"[A-Za-z0-9+/]{120,}", body)) and max(map(len, re.findall(r"[A-Za-z0-9+/=]+", body))) > 0.5 * len(body):
            return "data"
        if len(re.findall(r"[;{}()=,]", body)) > 0.12 * len(body) and body.count(" ") < 0.08 * len(body):
            return "minified"
    blob = sum(len(x) for x in lines if re.fullmatch(r"\s*[\"'`]?[A-Za-z0-9+/=\\]{48,}[\"'`]?[\s,+)\]};]*", x) and re.search(r"\d", x) and re.search(r"[A-Z]", x))
    if blob > 0.6 * n:
        return "data"
    rows = sum(len(x) for x in lines if re.fullmatch(r"[\s\[\](){},;:+.\-0-9xXa-fA-FeE\"']*", x) and sum(c.isdigit() for c in x) >= 0.35 * len(x.strip()))
    if rows > 0.7 * n:
        return "data"
    code = [x.strip() for x in lines if not re.match(r"\s*(?:#|//|\"\"\"|[<=>]{7})", x)]
    if len(code) >= 6 and len(lines) - len(code) <= 2 + 0.04 * len(lines) and sum(1 for x in code if re.search(r"[(){}=;]", x)) >= 0.6 * len(code):
        forms = Counter(re.sub(r"[A-Za-z_]\w*", "a", re.sub(r"\d+(?:\.\d+)?", "9", re.sub(r"'[^'\n]*'|\"[^\"\n]*\"", "s", x))) for x in code)
        notes = sum(1 for x in code if re.search(r"\s(?:#|//)\s", x))
        same = forms.most_common(1)[0][1] / len(code)
        numbered = sum(1 for x in code if re.search(r"\d", x)) >= 0.5 * len(code)
        if not notes and numbered and (len(forms) <= 4 and same >= 0.4 or len(code) >= 12 and sum(c for _, c in forms.most_common(6)) >= 0.92 * len(code)):
            return "generated"
    return None


def judge(path: str | None, content: str | None) -> tuple[str, str] | None:
    """(kind, reason) of a file not written by hand, None for a hand-written one."""
    path, content = path or "", content or ""
    if VENDOR_DIRS.search(path):
        return "vendored", "directory"
    if GENERATED_NAMES.search(path):
        return ("minified" if re.search(r"(?i)\.(?:min|bundle)\.\w+$", path) else "generated"), "name"
    if path.lower().endswith(PROSE):
        return None
    head = head_notices(content)
    for line in head:
        if len(line) <= 240:
            if GENERATED_NOTICE.search(line):
                return "generated", "notice"
            if VENDOR_NOTICE.search(line):
                return "vendored", "notice"
    if head and (m := VERSION_NOTICE.match(head[0])) and not m[1].lower().startswith(("python", "version", "step", "part", "section")):
        return "vendored", "notice"
    foot, every = later_notices(path, content)
    if any(len(x) <= 240 and GENERATED_NOTICE.search(x) for x in foot) or any(len(x) <= 240 and FILE_NOTICE.search(x) for x in every):
        return "generated", "notice"
    if any(len(x) <= 240 and VENDOR_NOTICE.search(x) for x in foot):
        return "vendored", "notice"
    if path.lower().endswith((".json", ".yaml", ".yml", ".toml", ".env", ".ini", ".cfg")):
        if len(re.findall(r'"integrity"|"resolved"|\bintegrity:|^checksum = ', content, re.M)) >= 3:
            return "generated", "shape"
        return None
    kind = shape(content)
    return (kind, "shape") if kind else None


def attribute_rules(text: str | None) -> list[tuple[str, bool, bool | None]]:
    """(pattern, generated or vendored, value) for each mark of an attribute file, in order; other lines are ignored.

    A value of None takes earlier marks back: the attribute is unspecified again.
    """
    out = []
    for line in (text or "").splitlines():
        line = line.strip()
        if not line or line.startswith(("#", "[")):
            continue
        m = re.match(r'"((?:[^"\\]|\\.)*)"|(\S+)', line)
        pattern = m[1].replace('\\"', '"') if m[1] is not None else m[2]
        for word in line[m.end() :].split():
            if n := re.fullmatch(r"([-!]?)linguist-(generated|vendored)(?:=(\S+))?", word):
                value = None if n[1] == "!" else n[1] != "-" and (n[3] or "true").lower() not in ("false", "0", "unset")
                out.append((pattern, n[2] == "generated", value))
    return out


def glob_regex(pattern: str, folder: str) -> str:
    """An attribute pattern of the file in ``folder`` as a regular expression over whole paths."""
    anchored = "/" in pattern.rstrip("/")[0:] if not pattern.startswith("/") else True
    body, out, i = pattern.lstrip("/"), "", 0
    if body.endswith("/"):
        body += "**"
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            j = body.index("]", i + 2)
            out, i = out + "[" + body[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]", j + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    prefix = re.escape(folder + "/") if folder else ""
    return prefix + ("" if anchored else "(?:[^/]+/)*") + out


def compiled_rules(files: list[tuple[str, str]]) -> list[tuple[re.Pattern, bool, bool | None]]:
    """The marks of all attribute files (folder, text) of a project, those that win last."""
    return [(re.compile(glob_regex(pattern, folder)), generated, value) for folder, text in sorted(files, key=lambda x: (len(x[0]), x)) for pattern, generated, value in attribute_rules(text)]


def declared(path: str, rules: list[tuple[re.Pattern, bool, bool | None]]) -> dict[bool, bool]:
    """What compiled rules say of a path: whether it is generated (True) and vendored (False), where they say so.

    The deepest file and its last matching line win, for each mark by itself.
    """
    found: dict[bool, bool | None] = {}
    for pattern, generated, value in rules:
        if pattern.fullmatch(path):
            found[generated] = value
    return {k: v for k, v in found.items() if v is not None}


def signs(path: str, text: str | None) -> set[str]:
    """What a file shows of its origin: its folders, beginnings and ends of its name, runs of four words of its first and last comments."""
    *folders, name = path.lower().split("/")
    out = {f"folder {x}" for x in folders if x}
    out |= {f"end {name[m.start() :]}" for m in re.finditer(r"[._-]", name) if m.start()} | {f"name {name}"}
    if m := re.match(r"([^\W_]{2,}[._-]).*?(\.\w+)$", name):
        out.add(f"begin {m[1]}*{m[2]}")
    for line in head_notices(text or "") + later_notices(path, text or "")[0]:
        words = re.findall(r"@?[^\W\d]+", line.lower())
        out |= {f"note {' '.join(words[i : i + 4])}" for i in range(len(words) - 3)}
    return out


def mine_signs(labelled: DataFrame, least_files: int = 3, least_projects: int = 2, least_share: float = 0.95) -> DataFrame:
    """(sign, generated, files): signs of which nearly all files of declared projects bear one mark.

    ``labelled`` has (project, generated, vendored, signs), one row for each file of a declared project; both
    marks false is a hand-written file. A sign counts if ``least_files`` files in ``least_projects`` projects
    have it with the mark and they are ``least_share`` of all files with it. Counts are added up by project
    first, so one large project is no hot group.
    """
    each = labelled.select("project", "generated", "vendored", F.explode("signs").alias("sign"))
    marked = lambda c: F.sum(F.col(c).cast("bigint"))
    by_project = each.groupBy("sign", "project").agg(F.count("*").alias("n"), marked("generated").alias("g"), marked("vendored").alias("v"))
    some = lambda c: F.sum((F.col(c) > 0).cast("bigint"))
    total = by_project.groupBy("sign").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("v").alias("v"), some("g").alias("pg"), some("v").alias("pv"))
    kind = lambda generated, files, projects: F.struct(F.lit(generated).alias("generated"), F.col(files).alias("files"), F.col(projects).alias("projects"))
    kinds = total.select("sign", "n", F.inline(F.array(kind(True, "g", "pg"), kind(False, "v", "pv"))))
    return kinds.where((F.col("files") >= least_files) & (F.col("projects") >= least_projects) & (F.col("files") >= least_share * F.col("n"))).select("sign", "generated", "files")


def not_handwritten(df: DataFrame, id_col: str, project_col: str, path_col: str, text_col: str, most_signs: int = 100_000) -> DataFrame:
    """(id, kind, reason): the files that are generated, minified, vendored or data saved as code.

    An attribute file is a row of the same project whose file name is ``.gitattributes``; what it declares
    comes first (kind ``declared``), also for the worse: a path marked as not generated is none, one marked as not
    vendored likewise. From the declared projects the signs of such files are mined (:func:`mine_signs`) and all
    of them applied to all files about which nothing is declared, beside public conventions: up to ``most_signs``
    are sent to every task, more meet the files by a join, with the same rows. Attribute files themselves count as
    hand-written. Null paths and texts are judged by what is left; null ids give no rows; repeated rows repeat; an
    empty table gives no rows.
    """
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(project_col).cast("string").alias("project"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    marks = src.where("path = '.gitattributes' or path like '%/.gitattributes'").select("project", F.regexp_replace("path", "/?\\.gitattributes$", "").alias("folder"), F.coalesce("text", F.lit("")).alias("marks"))
    per_project = marks.where(F.col("project").isNotNull()).distinct().groupBy("project").agg(F.collect_list(F.struct("folder", "marks")).alias("files"))
    if marks.isEmpty():
        return src.select("id", "path", "text").mapInPandas(lambda batches: _scan(batches, None, {}), "id bigint, kind string, reason string")
    joined = src.join(F.broadcast(per_project) if _small(per_project) else per_project, "project", "left").select("id", "project", "path", "text", "files")

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Rules()
        for pdf in batches:
            rows = []
            for project, path, text, files in zip(pdf["project"], pdf["path"], pdf["text"], pdf["files"]):
                if path and path.rsplit("/", 1)[-1] != ".gitattributes":
                    said = declared(path, known.of(project, files))
                    rows.append((project, said.get(True, False), said.get(False, False), sorted(signs(path, text))))
            yield pd.DataFrame(rows, columns=["project", "generated", "vendored", "signs"])

    labelled = joined.where("files is not null").mapInPandas(label, "project string, generated boolean, vendored boolean, signs array<string>")
    mined = materialise(mine_signs(labelled))
    if mined.count() > most_signs:
        return _joined_with_signs(joined, mined)
    by_sign = mined.groupBy("sign").agg(F.max("generated").alias("generated"), F.max(~F.col("generated")).alias("vendored"))
    share = df.sparkSession.sparkContext.broadcast({r.sign: (r.generated, r.vendored) for r in by_sign.collect()})
    return joined.mapInPandas(lambda batches: _scan(batches, _Rules(), share.value), "id bigint, kind string, reason string")


def _joined_with_signs(joined: DataFrame, mined: DataFrame) -> DataFrame:
    """The rows of :func:`not_handwritten` where the mined signs are too many for a task: each sign of a file that nothing else decides meets them by a join."""
    scanned = joined.mapInPandas(lambda batches: _scan(batches, _Rules(), None), "id bigint, kind string, reason string, generated boolean, vendored boolean, signs array<string>")
    scanned = materialise(scanned.withColumn("row", F.monotonically_increasing_id()))
    each = scanned.where("signs is not null").select("row", "id", "generated", "vendored", F.explode("signs").alias("sign"))
    met = each.join(mined.select("sign", F.col("generated").alias("as_generated")), "sign").where("if(as_generated, generated, vendored)")
    found = met.groupBy("row", "id").agg(F.max("as_generated").alias("as_generated"))
    return scanned.where("kind is not null").select("id", "kind", "reason").unionByName(found.select("id", F.expr("if(as_generated, 'generated', 'vendored')").alias("kind"), F.lit("mined").alias("reason")))


class _Rules:
    """The compiled rules of the projects that a task meets."""

    def __init__(self) -> None:
        self.held: dict[str, list] = {}

    def of(self, project: str | None, files: list | None) -> list:
        if files is None:
            return []
        if project not in self.held:
            if len(self.held) > 1000:
                self.held.clear()
            self.held[project] = compiled_rules([(f["folder"], f["marks"]) for f in files])
        return self.held[project]


def _scan(batches: Iterator[pd.DataFrame], known: _Rules | None, mined: dict[str, tuple[bool, bool]] | None) -> Iterator[pd.DataFrame]:
    """(id, kind, reason) by ``mined`` signs, (generated, vendored) each.

    If they are None, the files of which only signs can tell follow with a null kind, the kinds that they may be
    and their signs.
    """
    for pdf in batches:
        rows, undecided = [], []
        for k, (i, path, text) in enumerate(zip(pdf["id"], pdf["path"], pdf["text"])):
            if path and path.rsplit("/", 1)[-1] == ".gitattributes":
                continue
            said = declared(path, known.of(pdf["project"].iat[k], pdf["files"].iat[k])) if path and known else {}
            if any(said.values()):
                rows.append((i, "declared", "attributes"))
                continue
            got = judge(path, text)
            if not got and path and (mined or mined is None):
                may = said.get(True) is None, said.get(False) is None
                if mined is None:
                    if any(may):
                        undecided.append((i, None, None, *may, sorted(signs(path, text))))
                    continue
                kinds = [mined[x] for x in signs(path, text) if x in mined]
                got = next(((kind, "mined") for k, kind in enumerate(("generated", "vendored")) if may[k] and any(x[k] for x in kinds)), None)
            # A mark that denies one kind leaves the other.
            if got and said.get(got[0] != "vendored") is None:
                rows.append((i, *got))
        if mined is None:
            yield pd.DataFrame([(*r, None, None, None) for r in rows] + undecided, columns=["id", "kind", "reason", "generated", "vendored", "signs"])
        else:
            yield pd.DataFrame(rows, columns=["id", "kind", "reason"])


def _small(files: DataFrame, limit: int = 4 << 20) -> bool:
    """Whether all attribute files together are small enough to be sent to every task."""
    size = files.select(F.sum(F.aggregate("files", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(F.length(x["marks"]), F.lit(0)) + F.length(x["folder"])))).first()[0]
    return (size or 0) <= limit
