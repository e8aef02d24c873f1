"""Source files that do not parse: derivative parsing of token streams, by the extension of the path."""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammars
from .derivatives import Grammar

try:  # only used to confirm what the derivatives find
    import yaml
except ImportError:
    yaml = None

Line = tuple[str, ...]
#: One physical or logical line: its tokens and the number of the line on which it begins.
Lines = Iterator[tuple[Line, int]]

PY_KEYWORDS = {k: k for k in "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _".split()} | dict.fromkeys(("None", "True", "False"), "const")
PY_OPERATORS = {o: "op=" for o in "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()} | dict.fromkeys((">", "<=", ">=", "<"), "<") | dict.fromkeys(("!=", "=="), "==") | dict.fromkeys(("//", "%", ">>", "<<", "&", "^", "/"), "/") | {"-": "+"}
PY_TOKEN = re.compile(
    r"(?P<space>[ \t\f]+|\\\r?\n)|(?P<comment>#[^\n]*)|(?P<nl>\r?\n|\r)"
    r"|(?P<string>(?:[fF][rR]?|[rR][fF])(?:\"(?!\"\")(?:[^\"\\\n{}]|\\.|\{\{|\}\}|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*\"|'(?!'')(?:[^'\\\n{}]|\\.|\{\{|\}\}|\{(?:[^{}\n]|\{[^{}\n]*\})*\})*')"
    r"|(?:[rRbBfFuU]|[rR][bBfF]|[bBfF][rR])?(?:'''(?:[^\\']|\\.|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'(?!'')(?:[^'\\\n]|\\.)*'|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|''(?!')|\"\"(?!\")))"
    r"|(?P<open>(?:[rRbBfFuU]|[rR][bBfF]|[bBfF][rR])?(?:'''|\"\"\"))"
    r"|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)(?!\w))"
    r"|(?P<name>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=])|(?P<bad>.)",
    re.S,
)


def python_lines(text: str) -> Lines:
    """Logical lines; I and D are changes of the indentation, BAD what no token begins with, OPEN a string without an end."""
    out: list[str] = []
    indents, depth, fresh, begin, number = [0], 0, True, 1, 1
    column = alternative = 0
    levels = [(0, 0)]
    for m in PY_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "space":
            if fresh and not out:
                for c in m[0]:
                    column = (column // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else column + 1
                    alternative += c != "\f"
            if m[0][0] == "\\":
                number += 1
            continue
        if kind == "comment":
            continue
        if kind == "nl":
            number += 1
            if depth == 0:
                if out:
                    out.append("NL")
                    yield tuple(out), begin
                    out = []
                fresh, column, alternative = True, 0, 0
            continue
        if fresh:
            fresh, begin = False, number
            if depth == 0:
                if column > indents[-1]:
                    if alternative <= levels[-1][1]:
                        out.append("BAD")
                    indents.append(column)
                    levels.append((column, alternative))
                    out.append("I")
                else:
                    while column < indents[-1]:
                        indents.pop()
                        levels.pop()
                        out.append("D")
                    if column != indents[-1] or alternative != levels[-1][1]:
                        out.append("BAD")
        if kind == "name":
            out.append(PY_KEYWORDS.get(m[0], "n"))
        elif kind == "op":
            o = m[0]
            if o in "([{":
                depth += 1
            elif o in ")]}":
                depth = max(0, depth - 1)
            out.append(PY_OPERATORS.get(o, o))
        elif kind == "string":
            out.append("s")
            number += m[0].count("\n")
        elif kind == "number":
            out.append("0" if not re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", m[0]) else "BAD")
        elif kind == "open":
            out.append("OPEN")
            break
        else:
            out.append("BAD")
    if depth or out and out[-1] == "OPEN":
        yield tuple(out), begin
        return
    if out:
        yield (*out, "NL"), begin
    if len(indents) > 1:
        yield ("D",) * (len(indents) - 1), number


JSON_TOKEN = re.compile(r'(?P<space>[ \t\r]+)|(?P<nl>\n)|(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<n>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.]))|(?P<w>(?:true|false|null)(?!\w))|(?P<op>[{}\[\],:])|(?P<open>"[^"\n]*\Z)|(?P<bad>.)', re.S)


def json_lines(text: str) -> Lines:
    """Physical lines."""
    out: list[str] = []
    number = 1
    for m in JSON_TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "nl":
            if out:
                yield tuple(out), number
                out = []
            number += 1
        elif kind != "space":
            out.append(m[0] if kind == "op" else "0" if kind == "n" else kind if kind in "sw" else "OPEN" if kind == "open" else "BAD")
    if out:
        yield tuple(out), number


_TOML_TIME = r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?"
TOML_TOKEN = re.compile(
    r"(?P<space>[ \t]+)|(?P<comment>#[^\n]*)|(?P<nl>\r?\n)"
    r"|(?P<S>\"\"\"(?:[^\\\"]|\\.|\"{1,2}(?!\"))*\"{3,5}|'''(?:[^']|'{1,2}(?!'))*'{3,5})"
    r"|(?P<s>\"(?!\"\")(?:[^\"\\\n]|\\(?:[btnfre\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|'(?!'')[^'\n]*'|\"\"(?!\")|''(?!'))"
    r"|(?P<open>\"\"\"|'''|\"[^\"\n]*\Z|'[^'\n]*\Z)"
    r"|(?P<n>(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[Tt ]" + _TOML_TIME + r"(?:[Zz]|[+-][0-9]{2}:[0-9]{2})?)?|" + _TOML_TIME + r"|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?[0-9])*)(?:\.[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?|true|false)(?![\w.-]))"
    r"|(?P<k>[A-Za-z0-9_-]+)|(?P<op>[\[\]{},=.])|(?P<bad>.)",
    re.S,
)


def toml_lines(text: str) -> Lines:
    """Physical lines; what is a key is decided by the place."""
    out: list[str] = []
    number, depth, value, skip = 1, [], False, 0
    pos = 0
    while pos < len(text):
        m = TOML_TOKEN.match(text, pos)
        kind, pos = m.lastgroup, m.end()
        if kind in ("space", "comment"):
            continue
        if kind == "nl":
            if "{" in depth:
                out.append("BAD")
            if out or depth:
                yield (*out, "NL"), number
                out = []
            number += 1
            if not depth:
                value = False
            continue
        if kind == "op":
            o = m[0]
            if not value and not depth and o in "[]" and text[pos : pos + 1] == o and (not out or o == "]"):
                o, pos = o * 2, pos + 1
            elif value and o in "[{":
                depth.append(o)
                value = o == "["
            elif o in "]}" and depth:
                depth.pop()
                value = True
            elif o == "=":
                value = True
            elif o == "," and depth:
                value = depth[-1] == "["
            out.append(o)
        elif kind in ("n", "k") and not value:
            k = re.compile(r"[A-Za-z0-9_-]+").match(text, m.start())
            out.append("k" if k else "BAD")
            pos = k.end() if k else pos
        elif kind in ("s", "S"):
            out.append(kind)
            number += m[0].count("\n")
        else:
            out.append("0" if kind == "n" else "OPEN" if kind == "open" else "BAD")
            if kind == "open":
                break
    if out and out[-1] == "OPEN" or depth:
        yield tuple(out), number
    elif out:
        yield (*out, "NL"), number


YAML_QUOTED = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", re.S)
YAML_KEY = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s]))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*?[ \t]*:(?=[ \t\r\n]|$)|(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\n]|'')*')[ \t]*:(?=[ \t\r\n]|$)|\?(?=[ \t]|$)|\*[\w-]+[ \t]+:(?=\s|$)|:(?=\s|$)", re.M)
YAML_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^:#\n\r]|:(?=\S)|(?<=\S)#)*")
YAML_FLOW_PLAIN = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s,\[\]{}]))(?:[^:#\n\r,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#)*")


def yaml_lines(text: str) -> Lines:
    """Lines of the block structure: K a key with its colon, I and D changes of the indentation, flow collections in full."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    indents = [-1]
    k, out = 0, []
    text = "\n".join(lines)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)

    def dedent(column: int) -> None:
        while indents[-1] > column:
            indents.pop()
            out.append("D")

    while k < len(lines):
        line = lines[k]
        body = line.lstrip(" ")
        if not body.strip() or body.lstrip("\t").startswith("#"):
            k += 1
            continue
        begin, column = k + 1, len(line) - len(body)
        if line.startswith(("---", "...")) and (len(line) == 3 or line[3].isspace()):
            while indents[-1] > -1:
                indents.pop()
                out.append("D")
            if out and out[-1] == "D":
                out.pop()  # the level of the document itself has no I
            out.append(line[:3])
            yield tuple(out), begin
            out = []
            rest = line[3:].strip()
            if rest and not rest.startswith("#"):
                lines[k] = "   " + line[3:]
                text = "\n".join(lines)
                continue
            k += 1
            continue
        if column == 0 and line.startswith("%") and indents == [-1]:
            k += 1
            continue
        if body.startswith("\t"):
            yield (*out, "BAD"), begin
            return
        if column < indents[-1]:
            dedent(column)
            if column != indents[-1]:
                out.append("BAD")
        elif column > indents[-1]:
            if indents[-1] >= 0:
                out.append("I")
            indents.append(column)
        pos = starts[k] + column
        end = starts[k + 1] - 1
        while True:
            if text.startswith("- ", pos) or text.startswith("-\n", pos) or text[pos : pos + 1] == "-" and pos + 1 == len(text):
                out.append("-")
                nxt = pos + 1
                while nxt < end and text[nxt] == " ":
                    nxt += 1
                if nxt < end and text[nxt] != "#" and (text.startswith(("- ", "-\n"), nxt) or YAML_KEY.match(text, nxt, end)):
                    indents.append(nxt - starts[k])
                    out.append("I")
                    pos = nxt
                    continue
                pos = nxt
                break
            break
        inline = False
        while True:
            while pos < len(text) and text[pos] in " \t":
                pos += 1
            if pos >= end or text[pos] == "#":
                break
            m = YAML_KEY.match(text, pos, end)
            if m and not inline:
                out.append("K")
                pos, inline = m.end(), True
                continue
            c = text[pos]
            if c in "&!":
                m = re.compile(r"[&!][^\s,\[\]{}]*").match(text, pos)
                out.append("p")
                pos = m.end()
            elif c == "*":
                out.append("*")
                pos = re.compile(r"\*[^\s,\[\]{}]*").match(text, pos).end()
            elif c in "|>":
                m = re.compile(r"[|>][-+0-9]*[ \t]*(?:#[^\n]*)?(?=\n|\Z)").match(text, pos)
                out.append("|" if m else "BAD")
                parent = indents[-1]
                k += 1
                while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip(" ")) > (parent if out[0] != "|" else -1)):
                    k += 1
                k -= 1
                pos = end = starts[k + 1] - 1
            elif c in "'\"":
                m = YAML_QUOTED.match(text, pos)
                if not m:
                    yield (*out, "OPEN"), begin
                    return
                out.append("q")
                pos = m.end()
                while starts[k + 1] <= pos:
                    k += 1
                end = starts[k + 1] - 1
            elif c in "[{":
                depth = 0
                while pos < len(text):
                    c = text[pos]
                    if c in " \t\n":
                        pos += 1
                    elif c == "#" and text[pos - 1] in " \t\n":
                        pos = text.find("\n", pos) if "\n" in text[pos:] else len(text)
                    elif c in "[{":
                        depth += 1
                        out.append(c)
                        pos += 1
                    elif c in "]}":
                        depth -= 1
                        out.append(c)
                        pos += 1
                        if depth == 0:
                            break
                    elif c == ",":
                        out.append(c)
                        pos += 1
                    elif c == ":" and (text[pos + 1 : pos + 2] in " \n\t,]}" or out[-1] == "q"):
                        out.append(c)
                        pos += 1
                    elif c in "&!":
                        out.append("p")
                        pos = re.compile(r"[&!][^\s,\[\]{}]*").match(text, pos).end()
                    elif c == "*":
                        out.append("*")
                        pos = re.compile(r"\*[^\s,\[\]{}]*").match(text, pos).end()
                    elif c in "'\"":
                        m = YAML_QUOTED.match(text, pos)
                        if not m:
                            yield (*out, "OPEN"), begin
                            return
                        out.append("q")
                        pos = m.end()
                    else:
                        m = YAML_FLOW_PLAIN.match(text, pos)
                        if not m:
                            out.append("BAD")
                            pos += 1
                        else:
                            if out[-1] != "v":
                                out.append("v")
                            pos = m.end()
                if depth:
                    yield tuple(out), begin
                    return
                while starts[k + 1] <= pos:
                    k += 1
                end = starts[k + 1] - 1
            else:
                m = YAML_PLAIN.match(text, pos, end)
                out.append("v" if m else "BAD")
                if m and text[m.end() : m.end() + 1] == ":" and not text[m.end() + 1 : m.end() + 2].strip():
                    out.append("BAD")
                pos = m.end() if m else end
                if pos < end and text[pos] not in " \t#":
                    pos = end
        out.append("NL")
        yield tuple(out), begin
        out = []
        k += 1
    while len(indents) > 2:
        indents.pop()
        out.append("D")
    if out:
        yield tuple(out), len(lines)


JS_WORDS = dict.fromkeys("import export default function class extends const let var if else for while do return break continue throw try catch finally switch case debugger new in this super yield await with of get set static async from as".split())
JS_WORDS = {w: w for w in JS_WORDS} | dict.fromkeys(("typeof", "void", "delete"), "typeof") | {"instanceof": "bin"} | dict.fromkeys(("true", "false", "null"), "const_value") | {"enum": "kw"}
JS_TOKEN = re.compile(
    r"(?P<space>[ \t\f\v\u00a0\ufeff]+)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<nl>\r?\n|\r|\u2028|\u2029)"
    r"|(?P<s>\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\n]|\\(?:\r\n|.))*')"
    r"|(?P<n>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:(?:0|[1-9][0-9_]*)(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)n?(?![\w$]))"
    r"|(?P<name>(?:[^\W\d]|[$_])(?:\w|\$)*)|(?P<private>#(?:[^\W\d]|[$_])(?:\w|\$)*)|(?P<tick>`)"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~?:;,.<>=(){}\[\]@])|(?P<bad>.)",
    re.S,
)
JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
JS_OPERATORS = {o: "op=" for o in "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split()} | {o: "bin" for o in "== != === !== < > <= >= && || ?? & | ^ << >> >>> % **".split()} | {"-": "+", "~": "!", "--": "++"}
JS_ENDS = frozenset(["n", "0", "s", "re", ")", "]", "}", "T", "}T", "this", "super", "const_value", "of", "get", "set", "static", "async", "from", "as", "#", "++"])


def js_lines(text: str) -> Lines:
    """Physical lines; S is a semicolon in the head of a loop, B the brace of a function after an arrow."""
    out: list[str] = []
    number, pos, last, before = 1, 0, "", ""
    nest: list[str] = []
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else len(text)
    while pos < len(text):
        m = JS_TOKEN.match(text, pos)
        kind, word, pos = m.lastgroup, m[0], m.end()
        if kind == "space":
            continue
        if kind in ("comment", "nl"):
            feeds = word.count("\n") + (word in "\r\u2028\u2029")
            if feeds:
                yield tuple(out), number
                out = []
                number += feeds
            continue
        if kind == "op":
            if word in ("/", "/=") and last not in JS_ENDS:
                r = JS_REGEX.match(text, m.start())
                token, pos = ("re", r.end()) if r else ("BAD", pos)
            elif word == "}" and nest and nest[-1] == "T":
                t = JS_TEMPLATE.match(text, pos)
                if not t:
                    token, pos = "OPEN", len(text)
                else:
                    number += t[0].count("\n")
                    pos = t.end()
                    token = "}T" if t[1] == "`" else "}T{"
                    if token == "}T":
                        nest.pop()
            else:
                token = JS_OPERATORS.get(word, word)
                if word == "(":
                    nest.append("for" if last == "for" or last == "await" and before == "for" else "(")
                elif word in "[{":
                    if word == "{" and last == "=>":
                        token = "B"
                    nest.append(word)
                elif word in ")]}" and nest:
                    nest.pop()
                elif word == ";" and nest and nest[-1] == "for":
                    token = "S"
                elif word == "@":
                    token = "BAD"
        elif kind == "name":
            token = "n" if last in (".", "?.") else JS_WORDS.get(word, "n")
        elif kind == "tick":
            t = JS_TEMPLATE.match(text, pos)
            if not t:
                token, pos = "OPEN", len(text)
            else:
                number += t[0].count("\n")
                pos = t.end()
                token = "T" if t[1] == "`" else "T{"
                if token == "T{":
                    nest.append("T")
        else:
            token = {"s": "s", "n": "0", "private": "#"}.get(kind, "BAD")
            if kind == "s":
                number += word.count("\n")
        out.append(token)
        before, last = last, token
        if token == "OPEN":
            break
    if out:
        yield tuple(out), number



def _follow(grammar: Grammar, lines: Lines) -> tuple[bool, int | None, bool]:
    state, number = grammar.initial, 1
    for line, number in lines:
        state, at = grammar.derive_line(state, line)
        if at >= 0:
            return False, number, line[at] == "OPEN"
    return (True, None, False) if grammar.complete(state) else (False, number, True)


def _follow_js(grammar: Grammar, lines: Lines) -> tuple[bool, int | None, bool]:
    """As _follow, with automatic semicolons: where a token can't follow after a line end or is a closing brace, and after some words."""
    state, number, fresh, last = grammar.initial, 1, False, ""
    for line, number in lines:
        if not line:
            fresh = True
            continue
        key = (state, ("js", last if fresh else "", *line))
        got = grammar.line_memo.get(key)
        if got is None:
            now, at, prev, new_line = state, -1, last, fresh
            for k, token in enumerate(line):
                to = grammar.empty
                if new_line and (prev in ("return", "break", "continue", "throw", "yield") or token == "++"):
                    now = next((x for x in [grammar.derive(now, ";")] if x != grammar.empty), now)
                to = grammar.derive(now, token)
                if to == grammar.empty and (new_line or token == "}"):
                    to = grammar.derive(grammar.derive(now, ";"), token)
                if to == grammar.empty:
                    at = k
                    break
                now, prev, new_line = to, token, False
            got = grammar.line_memo[key] = (now, at)
        state, at = got
        if at >= 0:
            return False, number, line[at] == "OPEN"
        last, fresh = line[-1], True
    return (True, None, False) if grammar.complete(state) or grammar.complete(grammar.derive(state, ";")) else (False, number, True)


def _exact_python(text: str) -> bool | None:
    try:
        ast.parse(text.removeprefix("\ufeff"))
        return True
    except (RecursionError, MemoryError):
        return None
    except (SyntaxError, ValueError):
        return False


def _refuse(_: str) -> None:
    raise ValueError("not a strict number")


def _exact_json(text: str) -> bool | None:
    try:
        json.loads(text, parse_constant=_refuse)
        return True
    except RecursionError:
        return None
    except ValueError:
        return False


def _exact_toml(text: str) -> bool | None:
    try:
        tomllib.loads(text)
        return True
    except RecursionError:
        return None
    except ValueError:
        return False


def _exact_yaml(text: str) -> bool | None:
    if yaml is None:
        return None
    try:
        for _ in yaml.compose_all(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            pass
        return True
    except RecursionError:
        return None
    except (yaml.YAMLError, ValueError):
        return False


#: By extension: grammar, start rule, tokens, what follows the tokens, exact check.
LANGUAGES: dict[str, tuple[str, str, Callable, Callable, Callable | None]] = {
    "py": (grammars.PYTHON, "file", python_lines, _follow, _exact_python),
    "json": (grammars.JSON, "text", json_lines, _follow, _exact_json),
    "toml": (grammars.TOML, "text", toml_lines, _follow, _exact_toml),
    "yaml": (grammars.YAML, "text", yaml_lines, _follow, _exact_yaml),
    "yml": (grammars.YAML, "text", yaml_lines, _follow, _exact_yaml),
    "js": (grammars.JS, "module", js_lines, _follow_js, None),
}


class Checker:
    """Grammars of all languages with their memoised derivatives, made once per task."""

    def __init__(self) -> None:
        built: dict[str, Grammar] = {}
        self.grammars = {ext: built.setdefault(rules, Grammar(rules, start)) for ext, (rules, start, *_) in LANGUAGES.items()}

    def derive(self, ext: str, text: str) -> tuple[bool, int | None, bool]:
        """(parses, line of the failing token, breaks off) by the derivatives alone."""
        grammar = self.grammars[ext]
        grammar.bound_memory()
        return LANGUAGES[ext][3](grammar, LANGUAGES[ext][2](text))

    def check(self, ext: str, text: str) -> tuple[bool, int | None, bool]:
        """As derive, confirmed by the exact check of the language if there is one."""
        ok, line, cut = self.derive(ext, text)
        exact = LANGUAGES[ext][4]
        sure = exact(text) if exact else None
        if sure is None or sure == ok:
            return ok, line, cut
        return (True, None, False) if sure else (False, None, False)


def extension(path: str | None) -> str:
    """The lower-case extension of the file name, empty if there is none."""
    name = (path or "").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def syntax_flags(df: DataFrame, id_col: str, path_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, the columns to keep, extension, checked, valid, fail_line, truncated) for every row.

    Rows with another extension or a null text have ``checked`` false and a null verdict. fail_line is the
    line (from 1) of the token whose derivative is empty; it is null where only the exact check fails.
    ``truncated``: the text ends while something must still follow. An empty text is a valid file but for
    JSON. Null ids are kept.
    """
    src = df.select(F.col(id_col).cast("bigint").alias("id"), *keep, F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    kept = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        checker = Checker()
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for pdf in batches:
                rows = []
                for path, text in zip(pdf["path"], pdf["text"]):
                    ext = extension(path)
                    if ext in LANGUAGES and text is not None:
                        ok, line, cut = checker.check(ext, text)
                        rows.append((ext, True, ok, line, cut))
                    else:
                        rows.append((ext, False, None, None, None))
                out = pd.DataFrame(rows, columns=["extension", "checked", "valid", "fail_line", "truncated"], index=pdf.index)
                out["fail_line"] = out["fail_line"].astype("Int64")
                yield pd.concat([pdf[["id", *keep]], out], axis=1)

    return src.mapInPandas(run, "id bigint, " + (kept + ", " if keep else "") + "extension string, checked boolean, valid boolean, fail_line bigint, truncated boolean")


def syntax_rates(flags: DataFrame, *by: str) -> DataFrame:
    """For each group of checked rows: (the columns, files, broken, truncated, broken_rate)."""
    checked = flags.where("checked")
    return checked.groupBy(*by).agg(F.count("*").alias("files"), F.sum((~F.col("valid")).cast("bigint")).alias("broken"), F.sum(F.col("truncated").cast("bigint")).alias("truncated"), F.avg((~F.col("valid")).cast("double")).alias("broken_rate"))
