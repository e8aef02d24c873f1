"""Scalar functions over whole tables: text, hashes, numbers, JSON and time."""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import read_table
from .registry import query
from .retrieval import _BIG, _CJK, _TOK, _words


def _documents(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "documents")


@query(f"select doc_id, len(regexp_extract_all(text, '{_TOK}'))::int as tokens, sha256(array_to_string(regexp_extract_all(text, '{_TOK}'), ' ')) as digest from documents")
def f01_tokens(spark: SparkSession, base: str) -> DataFrame:
    """Tokens of every document, counted and hashed."""
    t = T.tokens(F.col("text"))
    return _documents(spark, base).select("doc_id", F.size(t).alias("tokens"), F.sha2(F.array_join(t, " "), 256).alias("digest"))


@query("select distinct symbol, regexp_replace(symbol, '([a-z0-9])([A-Z])', '\\1 \\2', 'g') as split from rag_chunks where symbol is not null")
def f02_camel_split(spark: SparkSession, base: str) -> DataFrame:
    """Symbols with blanks between their camel humps."""
    return read_table(spark, base, "rag_chunks").where("symbol is not null").select("symbol", T.camel_split(F.col("symbol")).alias("split")).distinct()


@query(f"select memory_id, list_slice(list_transform(list_sort(list_transform(list_distinct(ws), lambda x: {{'p': list_position(ws, x), 'x': x}})), lambda s: s.x), 1, 32) as terms from (select memory_id, flatten(list_transform({_words('content', False)}, lambda w: list_concat([w], {_BIG}))) as ws from memories)")
def f04_memory_terms(spark: SparkSession, base: str) -> DataFrame:
    """Query terms without stop words and camel humps."""
    return read_table(spark, base, "memories").select("memory_id", T.query_terms(F.col("content"), stop_words=False, camel=False).alias("terms"))


@query(f"select memory_id, w as run, {_BIG} as pairs from (select distinct memory_id, unnest(regexp_extract_all(content, '{_CJK}+')) as w from memories)")
def f05_bigrams(spark: SparkSession, base: str) -> DataFrame:
    """Runs of Chinese characters with their pairs."""
    runs = read_table(spark, base, "memories").select("memory_id", F.explode(F.regexp_extract_all("content", F.lit(T.CJK + "+"), F.lit(0))).alias("run")).distinct()
    return runs.select("memory_id", "run", T.bigrams(F.col("run")).alias("pairs"))


@query("select memory_id, replace(lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))), 'ß', 'ss') as form from memories")
def f06_normal_form(spark: SparkSession, base: str) -> DataFrame:
    """Case folded contents with single blanks."""
    return read_table(spark, base, "memories").select("memory_id", T.normal_form(F.col("content")).alias("form"))


@query()
def f06_nfkc(spark: SparkSession, base: str) -> DataFrame:
    """The exact normal form: NFKC and full case folding, in Arrow batches."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))

    return read_table(spark, base, "memories").select("memory_id", fold("content").alias("form"))


@query("select doc_id, sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) as key from documents")
def f07_packet_key(spark: SparkSession, base: str) -> DataFrame:
    """The hash of the normal form of every document."""
    return _documents(spark, base).select("doc_id", F.sha2(T.normal_form(F.col("text")), 256).alias("key"))


@query("select lang, count(*)::bigint as documents, count(*) filter (contains(text, 'ß'))::bigint as with_sharp_s, sum(len(replace(lower(text), 'ß', 'ss')) - len(text))::bigint as growth from documents group by lang")
def f08_casefold(spark: SparkSession, base: str) -> DataFrame:
    """Where case folding differs from lower case."""
    return _documents(spark, base).groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.contains("text", F.lit("ß"))).alias("with_sharp_s"), F.sum(F.length(T.casefold(F.col("text"))) - F.length("text")).alias("growth"))


@query(f"select doc_id, greatest(1, len(regexp_extract_all(text, '{_CJK}')) + ceil(len(regexp_replace(text, '{_CJK}|\\s', '', 'g')) / 4.0)::int)::int as tokens from documents")
def f09_token_estimate(spark: SparkSession, base: str) -> DataFrame:
    """Estimated tokens of every document."""
    return _documents(spark, base).select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("select doc_id, case when len(text) <= 300 then text else left(text, 150) || chr(10) || '[cut]' || chr(10) || right(text, 150) end as text from documents")
def f10_head_tail(spark: SparkSession, base: str) -> DataFrame:
    """Documents cut to their first and last 150 characters."""
    return _documents(spark, base).select("doc_id", T.head_tail(F.col("text"), 300, 0.5, "\n[cut]\n").alias("text"))


@query("select doc_id, case when len(text) <= 500 then text else left(text, 350) || chr(10) || '[' || (len(text) - 500) || ' characters left out]' || chr(10) || right(text, 150) end as text from documents")
def f11_extract(spark: SparkSession, base: str) -> DataFrame:
    """Documents cut to seven parts of head and three of tail, with the count of what is left out."""
    return _documents(spark, base).select("doc_id", T.head_tail(F.col("text"), 500, 0.7, "\n[{n} characters left out]\n").alias("text"))


@query("with t as (select doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) as n from documents) select doc_id, contains(n, 'according to the trace') or contains(n, 'on a clean checkout') as has_phrase, contains(replace(n, ' ', ''), 'rootcause') as has_joined from t")
def f15_contains_any(spark: SparkSession, base: str) -> DataFrame:
    """Phrases looked up in texts with white space collapsed and removed."""
    n = F.lower(F.regexp_replace("text", r"\s+", " "))
    phrases = F.array(F.lit("according to the trace"), F.lit("on a clean checkout"))
    return _documents(spark, base).select("doc_id", F.exists(phrases, lambda p: F.contains(n, p)).alias("has_phrase"), F.contains(F.replace(n, F.lit(" "), F.lit("")), F.lit("rootcause")).alias("has_joined"))


# What a log says of the kind of a failure, in the order in which the kinds are tried.
LOG_RULES = {
    "environment_failure": ["ModuleNotFoundError", "No module named", "PermissionError", "permission denied", "connection refused", "could not connect", "No such file or directory", "is not recognized as an internal or external command"],
    "collection_failure": ["ERROR collecting", r"Interrupted: \d+ error during collection", "ImportError while importing test module", "SyntaxError", "fixture .+ not found"],
    "assertion_failure": ["AssertionError", r"E\s+assert\s", "FAILED .+::", "DID NOT RAISE"],
}
_TIMED_OUT, _PASSED, _FAILED = "tim(ed|e) ?out", r"\d+ passed|passed in", r"\d+ (failed|errors?)\b"
_CASCADE_SQL = " ".join(f"when regexp_matches(text, '(?i){'|'.join(p)}') then '{k}'" for k, p in LOG_RULES.items())


@query(f"select doc_id, case when regexp_matches(text, '(?i){_TIMED_OUT}') then 'tool_failure' when regexp_matches(text, '(?i){_PASSED}') and not regexp_matches(text, '(?i){_FAILED}') then 'passed' {_CASCADE_SQL} else 'unknown_failure' end as category from documents")
def f18_log_cascade(spark: SparkSession, base: str) -> DataFrame:
    """Documents by the first rule of a cascade that matches: time-out, success, environment, collection, assertion."""
    says = lambda p: F.col("text").rlike("(?i)" + p)
    rule = F.when(says(_TIMED_OUT), "tool_failure").when(says(_PASSED) & ~says(_FAILED), "passed")
    for kind, patterns in LOG_RULES.items():
        rule = rule.when(says("|".join(patterns)), kind)
    rule = rule.otherwise("unknown_failure")
    return _documents(spark, base).select("doc_id", rule.alias("category"))


@query("select draft_id, regexp_replace(regexp_replace(content, '(://[^:/@\\s]+):[^@\\s]+@', '\\1:***@', 'g'), '((?i:password|passwd|secret|token|api_key)\\s*[=:]\\s*)[^\\s,;]+', '\\1***', 'g') as content from chunk_drafts")
def f19_redaction(spark: SparkSession, base: str) -> DataFrame:
    """Drafts with account parts and plain assignments of secrets starred out (the simple rule)."""
    return read_table(spark, base, "chunk_drafts").select("draft_id", T.redact(F.col("content")).alias("content"))


@query("select item_id, replace(replace(to_json({'difficulty': difficulty, 'query': query, 'suite': suite}), '<', '\\u003c'), '>', '\\u003e') as rendered from eval_cases where difficulty is not null")
def f20_escaped_json(spark: SparkSession, base: str) -> DataFrame:
    """Cases as JSON with the angle brackets escaped."""
    j = F.to_json(F.struct("difficulty", "query", "suite"))
    return read_table(spark, base, "eval_cases").where("difficulty is not null").select("item_id", F.replace(F.replace(j, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")).alias("rendered"))


@query("select doc_id, len(string_split(text, chr(10)))::int as lines, list_max(list_transform(string_split(text, chr(10)), lambda l: len(l)))::int as longest from documents")
def f21_lines(spark: SparkSession, base: str) -> DataFrame:
    """Lines of every document and the length of the longest."""
    lines = F.split("text", "\n")
    return _documents(spark, base).select("doc_id", F.size(lines).alias("lines"), F.array_max(F.transform(lines, F.length)).alias("longest"))


@query("select distinct 'mcp__' || replace(project_id, '-', '_') || '__' || suite as name, len('mcp__' || replace(project_id, '-', '_') || '__' || suite) <= 64 as fits from projects cross join (select distinct suite from eval_cases)")
def f22_mangled_names(spark: SparkSession, base: str) -> DataFrame:
    """Names made of two parts, and whether they fit; both tables are fixed and small."""
    s = read_table(spark, base, "eval_cases").select("suite").distinct()
    name = F.concat(F.lit("mcp__"), F.replace("project_id", F.lit("-"), F.lit("_")), F.lit("__"), F.col("suite"))
    return read_table(spark, base, "projects").crossJoin(F.broadcast(s)).select(name.alias("name"), (F.length(name) <= 64).alias("fits")).distinct()


@query("select memory_id, regexp_full_match(memory_id, 'mem-[0-9a-f]{12}') as good_id, coalesce(regexp_full_match(memory_key, '[a-z]+/[a-z]+[.][a-z]+:[0-9a-f]+'), false) as good_key from memories")
def f23_id_patterns(spark: SparkSession, base: str) -> DataFrame:
    """Whether ids and keys have their form."""
    return read_table(spark, base, "memories").select("memory_id", F.col("memory_id").rlike("^mem-[0-9a-f]{12}$").alias("good_id"), F.coalesce(F.col("memory_key").rlike("^[a-z]+/[a-z]+[.][a-z]+:[0-9a-f]+$"), F.lit(False)).alias("good_key"))


@query("select draft_id, sha256(content) as hash, sha256(content) = content_hash as fresh from chunk_drafts")
def f30_content_hash(spark: SparkSession, base: str) -> DataFrame:
    """The hash of each draft, and whether the stored one still holds."""
    h = F.sha2("content", 256)
    return read_table(spark, base, "chunk_drafts").select("draft_id", h.alias("hash"), (h == F.col("content_hash")).alias("fresh"))


@query("select chunk_id, sha256(concat_ws(chr(0), project_id, path, start_line::varchar, end_line::varchar, content_hash)) as stable_id from rag_chunks")
def f31_composite_id(spark: SparkSession, base: str) -> DataFrame:
    """A stable id from place and content."""
    return read_table(spark, base, "rag_chunks").select("chunk_id", T.joined_id(F.col("project_id"), F.col("path"), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("content_hash")).alias("stable_id"))


@query(f"select w, count(*)::bigint as n from (select unnest(flatten(list_transform({_words('query', True)}, lambda w: list_concat([w], case when regexp_matches(w, '{_CJK}') then list_concat(string_split(w, ''), {_BIG}) else [] end)))) as w from eval_cases) group by w")
def f33_features(spark: SparkSession, base: str) -> DataFrame:
    """The multiset of features of all queries."""
    return read_table(spark, base, "eval_cases").select(F.explode(T.features(F.col("query"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("select attempt::int as attempt, least(30.0, 0.5 * pow(2, attempt))::double as delay from range(0, 9) t(attempt)")
def f37_backoff(spark: SparkSession, base: str) -> DataFrame:
    """Delays that double up to a bound."""
    return spark.range(9).select(F.col("id").cast("int").alias("attempt"), F.least(F.lit(30.0).cast("double"), F.lit(0.5).cast("double") * F.pow(F.lit(2.0), F.col("id"))).alias("delay"))


@query("select memory_id, sha256(to_json({'memory_type': memory_type, 'scope': scope, 'status': status})) as digest, strlen(to_json({'memory_type': memory_type, 'scope': scope, 'status': status}))::int as size from memories")
def f38_canonical_json(spark: SparkSession, base: str) -> DataFrame:
    """The hash and the byte size of JSON with sorted keys."""
    j = F.to_json(F.struct("memory_type", "scope", "status"))
    return read_table(spark, base, "memories").select("memory_id", F.sha2(j, 256).alias("digest"), F.octet_length(j).alias("size"))


@query("select memory_id, len(from_json(evidence_json, '[\"VARCHAR\"]'))::int as evidence, len(from_json(tags_json, '[\"VARCHAR\"]'))::int as tags from memories")
def f40_json_arrays(spark: SparkSession, base: str) -> DataFrame:
    """Lengths of the arrays that are stored as JSON."""
    size = lambda c: F.size(F.from_json(c, "array<string>"))
    return read_table(spark, base, "memories").select("memory_id", size("evidence_json").alias("evidence"), size("tags_json").alias("tags"))


@query("with recursive j as (select candidate_id, candidate_json::json as v from (select distinct candidate_id, candidate_json from memory_curation_decisions)), k as (select candidate_id, v, unnest(json_keys(v)) as key from j), a as (select candidate_id, key as path, json_extract(v, '$.' || key) as v from k union all select a.candidate_id, a.path || '.' || t.key, json_extract(a.v, '$.' || t.key) from a, lateral (select unnest(json_keys(a.v)) as key) t where json_type(a.v) = 'OBJECT') select path, count(*)::bigint as n from a group by path")
def f41_json_paths(spark: SparkSession, base: str) -> DataFrame:
    """All paths of nested JSON objects with their counts, however deep."""
    d = read_table(spark, base, "memory_curation_decisions").select("candidate_id", "candidate_json").distinct()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter[str] = Counter()
            for text in pdf["candidate_json"].dropna():
                try:
                    rest = [("", json.loads(text, object_pairs_hook=tuple))]
                except ValueError:
                    continue
                while rest:
                    before, value = rest.pop()
                    if isinstance(value, tuple):  # an object; arrays are lists
                        inner = [(before + key, v) for key, v in value]
                        found.update(path for path, _ in inner)
                        rest += [(path + ".", v) for path, v in inner]
            yield pd.DataFrame({"path": list(found.keys()), "n": list(found.values())})

    return d.mapInPandas(walk, "path string, n bigint").groupBy("path").agg(F.sum("n").alias("n"))


@query("select memory_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' as iso, epoch_us(created_at)::bigint as micros from memories")
def f42_iso_times(spark: SparkSession, base: str) -> DataFrame:
    """Times as ISO text and as microseconds."""
    return read_table(spark, base, "memories").select("memory_id", F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("micros"))


@query("select doc_id, coalesce(epoch_us(created_at), 0)::bigint as micros from documents")
def f44_epoch(spark: SparkSession, base: str) -> DataFrame:
    """Microseconds since 1970, 0 for no time."""
    return _documents(spark, base).select("doc_id", F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0).cast("bigint")).alias("micros"))


@query("select doc_id, regexp_matches(text, '(^|[^0-9.])(0|[1-9][0-9]*)[.](0|[1-9][0-9]*)[.](0|[1-9][0-9]*)([^0-9.]|$)') as has_version from documents")
def f46_semver(spark: SparkSession, base: str) -> DataFrame:
    """Documents that name a version of three numbers."""
    return _documents(spark, base).select("doc_id", F.col("text").rlike("(^|[^0-9.])(0|[1-9][0-9]*)[.](0|[1-9][0-9]*)[.](0|[1-9][0-9]*)([^0-9.]|$)").alias("has_version"))
