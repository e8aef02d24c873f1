"""Text expressions: tokens, query terms, normal forms, sizes and patterns as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token and as a Chinese character.
TOKEN = "[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[㐀-䶿一-鿿]+"
CJK = "[㐀-䶿一-鿿]"
# Words that carry no meaning in a query.
STOP_WORDS = "a an and are class code defined django do does find for function how implemented implementation in is method module of or the to what where which with".split()


def tokens(text: Column) -> Column:
    """Identifiers, numbers and runs of Chinese characters, in order, as written."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


#: The same for Arrow batches.
TOKENS = re.compile(TOKEN)


def word_terms(word: str) -> list[str]:
    """A folded token as with_bigrams gives it, for Arrow batches."""
    return [word, *(word[i : i + 2] for i in range(len(word) - 1))] if word[0] > "\u3000" else [word]


def word_features(token: str) -> list[str]:
    """What one token of a text adds to its features, for Arrow batches."""
    parts = [token.lower(), *(x.lower() for x in TOKENS.findall(re.sub("([a-z0-9])(?=[A-Z])", r"\1 ", token)))]
    return [f for w in parts for f in ([w, *w, *(w[i : i + 2] for i in range(len(w) - 1))] if w[0] > "\u3000" else [w])]


def camel_split(text: Column) -> Column:
    """A blank between a lower-case letter or digit and an upper-case letter."""
    return F.regexp_replace(text, "([a-z0-9])(?=[A-Z])", "$1 ")


def casefold(text: Column) -> Column:
    """Lower case with the sharp s written out, the one letter of the corpus on which the two differ."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def bigrams(word: Column) -> Column:
    """Neighbouring pairs of characters of one word."""
    return F.when(F.length(word) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2))))


def with_bigrams(words: Column) -> Column:
    """Each word, a Chinese run followed by its pairs."""
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.when(w.rlike(CJK), bigrams(w)).otherwise(F.array().cast("array<string>")))))


def query_terms(text: Column, limit: int | None = 32, stop_words: bool = True, camel: bool = True) -> Column:
    """Distinct terms of a query in first-seen order: raw tokens, tokens of the split text, pairs of Chinese runs."""
    words = tokens(text)
    if camel:
        words = F.concat(words, tokens(camel_split(text)))
    words = F.transform(words, casefold)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    terms = F.array_distinct(with_bigrams(words))
    return terms if limit is None else F.slice(terms, 1, limit)


def features(text: Column) -> Column:
    """The multiset of features of a text: raw and split tokens, Chinese characters and pairs."""
    words = F.transform(F.concat(tokens(text), tokens(camel_split(text))), casefold)
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.when(w.rlike(CJK), F.concat(F.filter(F.split(w, ""), lambda c: F.length(c) > 0), bigrams(w))).otherwise(none))))


def normal_form(text: Column) -> Column:
    """Case folded, white space collapsed and trimmed."""
    return casefold(F.trim(F.regexp_replace(text, r"\s+", " ")))


def estimated_tokens(text: Column) -> Column:
    """One token for each Chinese character, one for each four other visible characters, one at least."""
    cjk = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    rest = F.length(F.regexp_replace(text, CJK + r"|\s", ""))
    return F.greatest(F.lit(1), cjk + F.ceil(rest / F.lit(4.0).cast("double")).cast("int"))


def head_tail(text: Column, keep: int, head_share: float, note: str) -> Column:
    """The head and the tail of a text that is longer than ``keep`` around a note; ``{n}`` in the note is the number left out."""
    head = max(1, round(keep * head_share))
    tail = max(0, keep - head)
    before, _, after = note.partition("{n}")
    mark = F.concat(F.lit(before), (F.length(text) - keep).cast("string"), F.lit(after)) if "{n}" in note else F.lit(note)
    return F.when(F.length(text) <= keep, text).otherwise(F.concat(F.left(text, F.lit(head)), mark, F.right(text, F.lit(tail))))


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored regular expression; ``*`` crosses slashes as in name matching."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            out += "[" + ("^" + glob[i + 2 : j] if glob[i + 1] == "!" else glob[i + 1 : j]) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob_match(path: Column, glob: str) -> Column:
    """Whether the whole path or its last segment matches the glob."""
    pattern = glob_regex(glob)
    return path.rlike(pattern) | F.element_at(F.split(path, "/"), -1).rlike(pattern)


def unsafe_path(path: Column) -> Column:
    """Null, empty, absolute, with a backslash, or with an empty, ``.`` or ``..`` segment."""
    return path.isNull() | (path == "") | path.startswith("/") | path.contains("\\") | F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))


def redact(text: Column) -> Column:
    """Account parts of connection strings and values after secret names replaced by stars."""
    text = F.regexp_replace(text, r"(://[^:/@\s]+):[^@\s]+@", "$1:***@")
    return F.regexp_replace(text, r"(?i)((?:password|passwd|secret|token|api_key)\s*[=:]\s*)[^\s,;]+", "$1***")


def joined_id(*parts: Column) -> Column:
    """The SHA-256 of the parts joined by a zero character."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def occurrences(line: Column, needle: str) -> Column:
    """1-based columns of all non-overlapping occurrences of a literal in a line."""
    parts = F.split(line, re.escape(needle))
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda s, x: s + F.length(x)) + (k - 1) * len(needle) + 1)
    return F.when(F.size(parts) < 2, F.array().cast("array<int>")).otherwise(ends)
