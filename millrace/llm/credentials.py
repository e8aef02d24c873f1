"""Credentials embedded in source code and configuration: find them and redact them.

Literals near assignment contexts are segmented into dictionary words by Viterbi. What the words leave
unexplained decides: a long residual is a secret, under a name that speaks of a credential a short one
suffices; known hash formats, ids, public keys, placeholders and references are excluded.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_file, shipped_path

DICTIONARY = "/opt/tokenizers/word_bpe_49k.json"

# What names, placeholders and public token formats look like.
SECRET_NAMES = {"password", "passwd", "pwd", "pass", "pw", "passphrase", "passcode", "secret", "token", "apikey", "cred", "creds", "credential", "credentials", "authkey", "accesskey", "secretkey"}
HASH_NAMES = {"sha", "sha1", "sha256", "sha512", "md5", "hash", "checksum", "digest", "etag", "revision", "rev", "commit", "integrity", "fingerprint", "uuid", "guid", "id", "public", "pub", "build"}
PLACEHOLDER = re.compile(r"(?i)^(?:<.*>|\{\{.*\}\}|\$\{?.*|%[({].*|\[.*\]|(?:env|vault|file|ssm|secret|ref|aws-sm|gcp-sm|keyring|op):.*|[*x.•#-]{3,}|.*\.\.\.|(?:your|my|the|some|an?)[-_ ].*|.*(?:change[-_ ]?me|placeholder|redacted|example|dummy|sample[-_]?(?:key|token|secret|password)|insert[-_ ]|replace[-_ ]|fill[-_ ]?in|not[-_]?set|todo|goes[-_ ]here).*|none|null|nil|true|false|undefined|test|secret|password|token|n/?a)$")
TOKENS = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{20,}|xox[abprs]-[A-Za-z0-9-]{16,}|npm_[A-Za-z0-9]{20,}|AIza[\w-]{30,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9-]{20,}|hf_[A-Za-z0-9]{20,}|pypi-[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"
)
TOKEN_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "npm_", "AIza", "sk_", "sk-", "rk_", "pk_", "hf_", "pypi-", "SG.", "eyJ")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:[^-]|-(?!----BEGIN )){40,}?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
ACCOUNT_URL = re.compile(r"://[^\s/:@\"'`<>]*:([^\s/@\"'`]{3,})@")
LITERAL = re.compile(r"([\"'`])([^\s\"'`]{6,})\1")
SPACED = re.compile(r"[=:,>(]\s*[bBrRuU]?([\"'`])([^\s\"'`]+(?: [^\s\"'`]+)+)\1")
NAME_AT_END = re.compile(r"[A-Za-z_][\w.-]*\Z")
BARE = re.compile(r"(?m)^[ \t]*(?:[-*#+]|//|export|set|ENV)*[ \t]*([A-Za-z_][\w.-]*)[ \t]*[:=][ \t]*`?([^\s\"'`#;{(\[][^\s\"'`]{5,})`?[ \t]*(?:#.*)?\r?$")
FLAG = re.compile(r"--?([A-Za-z][\w-]*)[= ]([^\s\"'`,;)<$]{6,})")
HEADER = re.compile(r"(?i)\b((?:proxy-)?authorization|x-[a-z0-9-]+|cookie|api-key)\s*[\"'`]?\s*[:,=]\s*[\"'`]?\s*(?:(?:bearer|basic|token|apikey|digest)\s+)?([^\s\"'`,;]{8,})")
BEARER = re.compile(r"(?i)\bbearer\s+([A-Za-z0-9._~+/=-]{16,})")
FIELD = re.compile(r"(?i)(?:^|[;\s\"'`?&])(password|pwd|passwd|secret|token|accountkey|sharedaccesskey|apikey|api_key|access_token)\s*=\s*([^;\s\"'`&]{4,})")
NOTE = re.compile(r"([A-Za-z][\w.@-]{1,40})`?[ \t]+(/|with|:|pw|pass|password|passwd)[ \t]+`?([^\s`\"']{6,})")
NOTE_WORDS = re.compile(r"(?i)\b(?:log ?in|sign in|credentials?|account|user(?:name)?|use|password|pass|pw|access|staging|prod\w*)\b")
SHORT_FLAG = re.compile(r"(?<=\s)-p([A-Za-z0-9][^\s\"'`]{7,})")
BASIC = re.compile(r"\b[Bb]asic[ \t]+([A-Za-z0-9+/]{8,}={0,2})")
SAID = re.compile(r"(?i)\b(?:password|passwd|pwd|passphrase|token|secret|api key)(?!\w)(?:[ \t]+(?:is|was|for[ \t]+[\w.-]+(?:[ \t]+is)?))?[ \t]*[:=]?[ \t]*[\"'`]?([^\s\"'`,;<>(){}]{8,})")
NOTE_SIGNS = (" / ", " with ", " : ", " pw ", " pass")
FIELD_WORDS = ("password", "pwd", "passwd", "secret", "token", "accountkey", "accesskey", "apikey", "api_key")
SAID_WORDS = ("password", "passwd", "pwd", "passphrase", "token", "secret", "api key")
JOIN = re.compile(r"([\"'])[ \t]*(?:\+|\\|\.)?[ \t]*(?:\r?\n[ \t]*)?(?:\+[ \t]*)?[bru]?\1(?=[^\"'\n])")
HASHES = re.compile(r"(?i)^(?:(?:sha\d*|md5|git)[:-].*|[0-9a-f]{16,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|urn:.*|data:.*|ssh-(?:rsa|dss|ed25519).*|ecdsa-.*|v?\d+(?:\.\d+)+.*)$")
# How encoded files begin: images, fonts, archives, documents, certificates and public keys, serialised objects.
BLOB_STARTS = re.compile(r"^(?:iVBORw0KGgo|R0lGOD|/9j/|Qk[01]|UklGR|AAABAA|PHN2Zy|PD94bWw|d09G[Rj]|T1RUTw|AAEAAA|H4sI|UEsDB|QlpoO|N3q8rycc|/Td6WFo|KLUv|eJ[wxyz]|eNo|JVBERi|f0VMR|AGFzbQ|TVqQ|SUQz|T2dnUw|MII|LS0tLS1CRUdJTiB(?:DRVJU|QVUJMSUM)|eyJ2ZXJzaW9u|gASV|gAN)")
SPLIT_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Words(dict):
    """Costs of dictionary words, and the length of the longest one."""

    longest = 0


@functools.lru_cache(maxsize=4)
def dictionary(path: str) -> Words:
    """Costs of the whole words of a public vocabulary: the negative log of a Zipf share by rank."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [w[:-4] for w, _ in sorted(vocab.items(), key=lambda x: x[1]) if w.endswith("</w>") and w[:-4].isalpha() and w[:-4].isascii() and len(w) > 6]
    out = Words({w: math.log(r + 12) for r, w in reversed(list(enumerate(words)))})
    out.longest = max(map(len, words), default=0)
    return out


def segmented(run: str, words: Words, letter: float = 4.2) -> tuple[int, int]:
    """(letters left over, words) of the cheapest segmentation of a run of letters, by Viterbi.

    A word of 3 letters or more costs its dictionary cost, a letter alone ``letter``. A word is written in one
    case: lower, upper or with a capital in front.
    """
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for j in range(1, len(run) + 1):
        cost, left, n = best[j - 1]
        cost, left = cost + letter, left + 1
        for i in range(max(0, j - words.longest), j - 2):
            w = run[i:j]
            if (w.islower() or w.isupper() or w[1:].islower()) and (c := words.get(w.lower())) is not None and best[i][0] + c < cost:
                cost, left, n = best[i][0] + c, best[i][1], best[i][2] + 1
        best.append((cost, left, n))
    return best[-1][1:]


def unexplained(literal: str, words: Words) -> int:
    """Characters of the literal that the cheapest segmentation into dictionary words leaves over; plain separators are free, digits and other signs stay over."""
    over = 0
    for run in re.findall(r"[A-Za-z]+|[^A-Za-z]", literal):
        over += segmented(run, words)[0] if run.isalpha() and run.isascii() else run not in "-_./: ,"
    return over


def is_passphrase(value: str, words: Words) -> bool:
    """Whether a value under a name that says credential is one made of words: three or more run together in one case, or signs in groups that words don't explain."""
    if PLACEHOLDER.match(value) or HASHES.match(value):
        return False
    if " " in value:
        left, shown = unexplained(value, words), len(value.replace(" ", ""))
        return bool(re.search(r"\d", value) and re.search(r"[a-z]", value) and re.search(r"[A-Z]", value)) and left >= max(8, 0.7 * shown)
    return len(value) >= 16 and value.isascii() and value.isalpha() and (value.islower() or value.isupper()) and (got := segmented(value, words))[0] == 0 and got[1] >= 3


def name_before(head: str) -> tuple[str, str]:
    """The name to which a literal after this text is given, and the sign between them; empty if there is none."""
    whole, head = head, head.rstrip(" \t\r\n(")
    if head[-1:].isalpha():
        head = head.rstrip("bBrRuUfF").rstrip(" \t(")
    sign, rest = head[-1:], head[:-1].rstrip(" \t=:")
    if sign not in (":", "=", ",", ">") or head[-2:] in ("==", "!=", ">=", "<=") or sign == ">" and head[-2:] != "=>":
        return "", ""
    if sign == "," and ("(" not in head or "\n" in whole.rpartition("(")[2]):  # a pair of arguments only
        return "", ""
    if sign == "=" and ":" in rest:  # name: type = literal
        before, _, kind = rest.rpartition(":")
        if re.fullmatch(r"\s*[A-Za-z_][\w\[\], |]*", kind):
            rest = before
    m = NAME_AT_END.search(rest.rstrip("\"'`])"))
    return (m[0], sign) if m else ("", "")


def head_of(text: str, end: int) -> str:
    """What stands before a literal, as far back as the name it is given to may begin."""
    width = 80
    while width < end:
        head = text[end - width : end].rstrip(" \t\r\n(")
        if head[-1:].isalpha():
            head = head.rstrip("bBrRuUfF").rstrip(" \t(")
        rest = head[:-1].rstrip(" \t=:")
        if rest and re.search(r"[^\w.\[\], |:\s\"'`)-]|\n" if head[-1] == "=" else r"[^\w.\[\] |:\s\"'`)-]|\n", rest):
            break
        width *= 2
    return text[max(0, end - width) : end]


def name_speaks(name: str) -> int:
    """2: the name says credential, 0: it says hash, id or public; 1: it says nothing."""
    parts = [p.lower() for p in SPLIT_NAME.findall(name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return 1
    if "".join(parts) in SECRET_NAMES or parts[-1] in SECRET_NAMES:
        return 2
    if parts[-1] == "key":
        return 0 if {"public", "pub"} & set(parts) else 2 if len(parts) > 1 else 1
    if parts[-1] == "keys" or {"env", "file", "path", "name", "label", "hint", "prompt"} & {parts[-1]}:
        return 1
    return 0 if parts[-1] in HASH_NAMES or {"public", "sha"} & set(parts) else 1


def is_blob(value: str) -> bool:
    """Whether a value without a telling name is data: an encoded file, or signs that repeat as random ones don't."""
    if BLOB_STARTS.match(value):
        return True
    if len(value) <= 64:
        return False
    parts = [value[i : i + 4] for i in range(len(value) - 3)]
    return bool(re.search(r"[^A-Za-z0-9+/=_.~-]", value)) or len(set(parts)) < 0.9 * len(parts)


def is_secret(value: str, speaks: int, words: Words) -> bool:
    """Whether a literal under a name (see :func:`name_speaks`) is a credential by itself."""
    value = value.strip()
    if len(value) < 6 or PLACEHOLDER.match(value) or (m := ACCOUNT_URL.search(value)):
        return bool(len(value) >= 6 and not PLACEHOLDER.match(value) and m and not PLACEHOLDER.match(m[1]))
    if TOKENS.match(value):
        return True
    if speaks == 0 or "://" in value or value.startswith(("./", "~/", "ssh-", "data:", "-----")) or re.search(r"\s", value) or re.fullmatch(r"[A-Za-z_][\w.]*\(.*|[\d.,]+|[A-Z][A-Z0-9_]*", value) and not re.search(r"\d.*[A-Z].*\d", value):
        return False
    left = unexplained(value, words)
    if value.startswith("/") and left < 0.6 * len(value):
        return False
    if speaks == 2:
        return left >= 3 and len(value) >= 6
    return not HASHES.match(value) and 12 <= len(value) and not is_blob(value) and left >= 10 and left >= 0.6 * len(value) and bool(re.search(r"\d", value) and re.search(r"[a-z]", value) and re.search(r"[A-Z]", value))


def account_in_base64(value: str) -> bool:
    """Whether the value is the base64 of a user and a password."""
    try:
        user, sign, word = base64.b64decode(value + "=" * (-len(value) % 4)).decode("ascii").partition(":")
    except ValueError:
        return False
    return bool(sign and user and word.isprintable() and not PLACEHOLDER.match(word))


def said_secret(v: str, words: Words) -> bool:
    """Whether a word in prose is a credential: letters and digits, no path, call, hash or identifier."""
    if not (re.search(r"[A-Za-z]", v) and re.search(r"\d", v)) or re.search(r"[/(\[]", v) or HASHES.match(v) or v.count("_") > 1:
        return False
    return is_secret(v, 2, words)


def find_credentials(content: str, words: Words, code: bool = False) -> list[tuple[int, int]]:
    """Spans (begin, end) of credential values, sorted, not overlapping; a value in several literals is one span.

    In ``code`` a value without quotes is an expression, not a literal, and neighbouring literals are one value.
    """
    cuts: list[tuple[int, int]] = []  # (offset in the joined text, characters left out before it)
    pieces, last, gone, size = [], 0, 0, 0
    for m in JOIN.finditer(content) if code else ():
        pieces.append(content[last : m.start()])
        size += m.start() - last
        gone += m.end() - m.start()
        cuts.append((size, gone))
        last = m.end()
    text = "".join(pieces) + content[last:] if cuts else content
    spans: list[tuple[int, int]] = []

    def add(begin: int, end: int) -> None:
        spans.append((begin, end))

    def in_rows(begin: int, end: int) -> bool:
        # Data saved as code are wrapped into rows of one width.
        at = [begin, *(size for size, _ in cuts if begin < size < end)]
        return len(at) > 3 and len({b - a for a, b in zip(at, at[1:])}) == 1

    low = text.lower()
    for m in PRIVATE_KEY.finditer(text) if "PRIVATE KEY" in text else ():
        # A key without its end is cut off; a mention of the first line in a long text is not a key.
        whole = m.end() > m.end(1) or len(m[1]) <= 20000 or re.fullmatch(r"[A-Za-z0-9+/=\s\\\"'`,:>|#*.-]+", m[1])
        if whole and len(re.sub(r"\\n|[^A-Za-z0-9+/=]", "", m[1])) >= 40:
            add(m.start(), m.end())
    for m in ACCOUNT_URL.finditer(text) if "://" in text else ():
        if not PLACEHOLDER.match(m[1]) and not re.match(r"[A-Za-z]+\(|\{", m[1]):
            add(m.start(1), m.end(1))
    for m in TOKENS.finditer(text) if any(x in text for x in TOKEN_STARTS) else ():
        add(m.start(), m.end())
    for m in LITERAL.finditer(text):
        name, sign = name_before(head_of(text, m.start()))
        speaks = name_speaks(name) if name else 0
        if speaks == 2 and is_passphrase(m[2], words):
            add(m.start(2), m.end(2))
        elif speaks and (speaks == 2 or sign != ",") and is_secret(m[2], speaks, words) and not (speaks == 1 and len(m[2]) > 64 and in_rows(m.start(2), m.end(2))):
            add(m.start(2), m.end(2))
    for m in SPACED.finditer(text):
        if re.search(r"\d", m[2]) and (name := name_before(head_of(text, m.start(1)))[0]) and name_speaks(name) == 2 and is_passphrase(m[2], words):
            add(m.start(2), m.end(2))
    for m in BARE.finditer(text) if not code else ():
        speaks = name_speaks(m[1])
        if is_secret(m[2], speaks, words) and (speaks == 2 or "(" not in m[2]) and not re.match(r"[\w.]+[(\[]", m[2]):
            add(m.start(2), m.end(2))
    for m in FLAG.finditer(text) if "-" in text else ():
        if name_speaks(m[1]) == 2 and is_secret(m[2], 2, words):
            add(m.start(2), m.end(2))
    for m in HEADER.finditer(text) if any(x in low for x in ("authorization", "x-", "cookie", "api-key")) else ():
        if is_secret(m[2], 2, words):
            add(m.start(2), m.end(2))
    for m in BEARER.finditer(text) if "bearer" in low else ():
        if is_secret(m[1], 2, words):
            add(m.start(1), m.end(1))
    for m in FIELD.finditer(text) if any(x in low for x in FIELD_WORDS) else ():
        if is_secret(m[2], 2, words) and not re.match(r"[\w.]+[(\[]|[a-z_][\w.]*$", m[2]):
            add(m.start(2), m.end(2))
    m = NOTE.search(text) if any(x in text for x in NOTE_SIGNS) else None
    while m:
        v = m[3].rstrip(".,")
        if said_secret(v, words) and (m[2].startswith("p") or NOTE_WORDS.search(text, text.rfind("\n", 0, m.start()) + 1, m.end(1))):
            add(m.start(3), m.start(3) + len(v))
        m = NOTE.search(text, m.start(3))
    for m in SHORT_FLAG.finditer(text) if " -p" in text else ():
        if is_secret(m[1], 2, words) and re.search(r"\d", m[1]) and "=" not in m[1]:
            add(m.start(1), m.end(1))
    for m in BASIC.finditer(text) if "asic " in text else ():
        if account_in_base64(m[1]):
            add(m.start(1), m.end(1))
    for m in SAID.finditer(text) if any(x in low for x in SAID_WORDS) else ():
        v = m[1].rstrip(".,")
        if said_secret(v, words):
            add(m.start(1), m.start(1) + len(v))

    def origin(at: int, side: str) -> int:
        shift = 0
        for size, gone in cuts:
            if size < at or size == at and side == "begin":
                shift = gone
            else:
                break
        return at + shift

    out: list[tuple[int, int]] = []
    for b, e in sorted((origin(b, "begin"), origin(e, "end")) for b, e in spans):
        if out and b < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def is_code(path: str | None) -> bool:
    """Whether values in files of that name are literals of a programming language."""
    return isinstance(path, str) and path.lower().endswith((".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".c", ".cc", ".cpp", ".h"))


def credentials(df: DataFrame, id_col: str, text_col: str, path_col: str, dictionary_path: str = DICTIONARY) -> DataFrame:
    """(id, line_no, begin, end): one row per credential; lines count from 1 by line feeds, offsets count code points.

    A value over several lines counts at its first. Null texts and null ids give no rows; repeated rows
    give repeated findings; texts of any length are read whole.
    """

    name = ship_file(df.sparkSession, dictionary_path)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = dictionary(shipped_path(name))
        for pdf in batches:
            rows = [(i, t.count("\n", 0, b) + 1, b, e) for i, t, p in zip(pdf["id"], pdf["text"], pdf["path"]) for b, e in find_credentials(t, words, is_code(p))]
            yield pd.DataFrame(rows, columns=["id", "line_no", "begin", "end"])

    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path")).where("id is not null and text is not null")
    return src.mapInPandas(scan, "id bigint, line_no bigint, begin bigint, end bigint")


def redact_credentials(df: DataFrame, text_col: str, path_col: str, out_col: str = "redacted", mark: str = "REDACTED", dictionary_path: str = DICTIONARY) -> DataFrame:
    """The table with ``out_col``: the text with each credential value replaced by ``mark``, otherwise unchanged; null stays null.

    Quotes, line ends inside a value and everything around it stay, so the code keeps its lines and its syntax.
    """

    name = ship_file(df.sparkSession, dictionary_path)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, paths: pd.Series) -> pd.Series:
        words = dictionary(shipped_path(name))

        def one(t: str | None, p: str | None) -> str | None:
            if t is None:
                return None
            for b, e in reversed(find_credentials(t, words, is_code(p))):
                # Gaps between the literals of one value stay as they are.
                part, at, done = t[b:e], 0, []
                for m in JOIN.finditer(part):
                    done += [mark, m[0]]
                    at = m.end()
                body = part[at:]
                if "\n" in body and not done:
                    body = re.sub(r"[^\r\n]+", mark, body)
                else:
                    body = mark
                t = t[:b] + "".join(done) + body + t[e:]
            return t

        return pd.Series([one(t, p) for t, p in zip(texts, paths)])

    return df.withColumn(out_col, clean(F.col(text_col), F.col(path_col).cast("string")))
