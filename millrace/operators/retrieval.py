"""Lexical, dense and fused ranking of chunks for batches of queries, and retrieval metrics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..runtime import materialise

K1, B = 1.2, 0.75


#: Up to so many distinct terms of a query set go to every task; beyond, rows meet them by a join.
SENT_TERMS = 200_000


class _Counter:
    """Counts the weighted terms of rows; a task keeps the terms of the tokens that it has seen."""

    def __init__(self, weights: list[float], keep: Callable[[str], object]) -> None:
        self.weights, self.keep, self.seen = weights, keep, {}

    def count(self, texts: list[str]) -> tuple[int, dict[object, float]]:
        """(tokens of all fields, weight of each term that is kept)."""
        length, found = 0, {}
        for weight, text in zip(self.weights, texts):
            for word, n in Counter(T.TOKENS.findall(text)).items():
                got = self.seen.get(word)
                if got is None:
                    if len(self.seen) > 500_000:
                        self.seen.clear()
                    terms = T.word_terms(word.lower())
                    got = self.seen[word] = (len(terms), [k for k in map(self.keep, terms) if k is not None])
                length += n * got[0]
                for t in got[1]:
                    found[t] = found.get(t, 0.0) + n * weight
        return length, found


def _kinds(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _texts(fields: dict[str, tuple[Column, float]]) -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(f"text{k}") for k, (c, _) in enumerate(fields.values())]


def postings(chunks: DataFrame, key: str, fields: dict[str, tuple[Column, float]], group: str | None = None) -> DataFrame:
    """(key, the group if there is one, term, f, length): the weighted frequency of each term in each row and the row's token count over all fields.

    Counted within the row, in Arrow batches, without a shuffle. Each row also has an entry with a null term, so
    that totals over all rows come from the same pass.
    """
    weights = [w for _, w in fields.values()]
    kept = [key, group] if group else [key]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _Counter(weights, lambda t: t)
        for pdf in batches:
            at, terms, fs, lengths = [], [], [], []
            for row, texts in enumerate(zip(*(pdf[f"text{k}"].tolist() for k in range(len(weights))))):
                length, found = counter.count(texts)
                terms += [None, *found]
                fs += [0.0, *found.values()]
                at += [row] * (len(found) + 1)
                lengths.append(length)
            at = np.array(at, dtype=np.int64)
            yield pd.DataFrame({**{c: pdf[c].to_numpy()[at] for c in kept}, "term": terms, "f": fs, "length": np.array(lengths, dtype=np.int64)[at]})

    return chunks.select(*kept, *_texts(fields)).mapInPandas(count, f"{_kinds(chunks, *kept)}, term string, f double, length bigint")


def bm25_ranked(chunks: DataFrame, key: str, fields: dict[str, tuple[Column, float]], terms: DataFrame, query_key: str, pool: int, group: str | None = None, block: int = 8192) -> DataFrame:
    """(query key, key, score, rank): the best ``pool`` rows of each query by BM25 with weighted term frequencies, rounded to 6 digits, equal scores by key.

    ``terms`` has (query key, term), and ``group`` if only rows of the query's group are searched. The terms of the
    queries are numbered if they are few enough to be sent to every task (SENT_TERMS); one pass then counts
    them in all rows, another scores the rows for a block of queries, and a task carries the best of each query.
    More terms meet the rows by joins.
    """
    spark, kept = chunks.sparkSession, [key, group] if group else [key]
    wanted = sorted(r.term for r in terms.select("term").distinct().limit(SENT_TERMS + 1).collect())
    if len(wanted) > SENT_TERMS:
        return ranked(_bm25_joined(chunks, key, fields, terms, query_key, group), query_key, key, pool)
    weights, share = [w for _, w in fields.values()], spark.sparkContext.broadcast({t: i for i, t in enumerate(wanted)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _Counter(weights, share.value.get)
        for pdf in batches:
            rows = [counter.count(texts) for texts in zip(*(pdf[f"text{k}"].tolist() for k in range(len(weights))))]
            yield pdf[kept].assign(length=[n for n, _ in rows], terms=[list(x) for _, x in rows], fs=[list(x.values()) for _, x in rows])

    counted = materialise(chunks.select(*kept, *_texts(fields)).mapInPandas(count, f"{_kinds(chunks, *kept)}, length bigint, terms array<int>, fs array<double>"))
    total = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    n, avgdl = total.n, total.length / max(1, total.n) or 1.0
    df = np.zeros(len(wanted))
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term that was sent
        df[r.t] = r["count"]
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    number = {t: i for i, t in enumerate(wanted)}
    kinds = f"{_kinds(terms, query_key)}, {_kinds(chunks, key)}, score double"

    def run(held: list) -> DataFrame:
        # A term is asked by the queries of a group: one key for both.
        groups = {g: i for i, g in enumerate(sorted({r[1] for r in held}))} if group else {None: 0}
        asked = np.array([number[t] * len(groups) + groups[r[1] if group else None] for r in held for t in r.terms], dtype=np.int64)
        who = np.repeat(np.arange(len(held)), [len(r.terms) for r in held])
        order = np.argsort(asked, kind="stable")
        keys, start = np.unique(asked[order], return_index=True)
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in held]), groups, keys, start, np.diff(np.append(start, len(asked))), who[order], idf))

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, groups, keys, start, many, asking, weight = sent.value

            def scores() -> Scores:
                for pdf in batches:
                    sizes = np.array([len(x) for x in pdf["terms"]])
                    if not sizes.sum():
                        continue
                    row, t, f = np.repeat(np.arange(len(pdf)), sizes), np.concatenate(pdf["terms"].to_numpy()), np.concatenate(pdf["fs"].to_numpy())
                    code = np.array([groups.get(g, -1) for g in pdf[group]]) if group else np.zeros(len(pdf), dtype=np.int64)
                    key_of = t.astype(np.int64) * len(groups) + code[row]
                    at = np.minimum(np.searchsorted(keys, key_of), len(keys) - 1)
                    met = (keys[at] == key_of) & (code[row] >= 0)
                    row, t, f, at = row[met], t[met], f[met], at[met]
                    part = weight[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * pdf["length"].to_numpy()[row] / avgdl))
                    # Rows are taken together as long as their scores and what adds up to them stay within a fixed memory.
                    cost = np.bincount(row, weights=many[at], minlength=len(pdf)) + len(ids)
                    bounds = np.flatnonzero(np.diff(np.cumsum(cost) // 4_000_000)) + 1
                    for lo, hi in zip(np.append(0, bounds), np.append(bounds, len(pdf))):
                        own = slice(*np.searchsorted(row, (lo, hi)))
                        count = many[at[own]]
                        each = np.repeat(start[at[own]] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                        cell = np.repeat((row[own] - lo) * len(ids), count) + asking[each]
                        sums = np.bincount(cell, weights=np.repeat(part[own], count), minlength=(hi - lo) * len(ids)).reshape(hi - lo, len(ids))
                        yield pdf[key].to_numpy()[lo:hi], np.where(sums > 0, np.round(sums, 6), -1.0)

            yield from _best(ids, scores(), query_key, key, pool)

        return counted.mapInPandas(task, kinds)

    columns = [query_key, group] if group else [query_key]
    out, held = spark.createDataFrame([], kinds), []
    for r in terms.groupBy(*columns).agg(F.collect_set("term").alias("terms")).toLocalIterator():
        if len(held) == block:
            out, held = out.unionByName(run(held)), []
        held.append(r)
    return ranked(out.unionByName(run(held)) if held else out, query_key, key, pool)


def _bm25_joined(chunks: DataFrame, key: str, fields: dict[str, tuple[Column, float]], terms: DataFrame, query_key: str, group: str | None) -> DataFrame:
    """(query key, key, score) of all rows that share a term with the query, by joins."""
    posted = materialise(postings(chunks, key, fields, group))
    total = posted.where("term is null").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    n, avgdl = total.n, total.length / max(1, total.n) or 1.0
    held = posted.join(terms.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    on = ["term", group] if group else ["term"]
    asked = terms.distinct().join(df, "term").select(query_key, *on, idf.alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.lit(avgdl)))
    return held.join(asked, on).groupBy(query_key, key).agg(F.round(F.sum(part), 6).alias("score"))


def ranked(scores: DataFrame, query_key: str, key: str, pool: int) -> DataFrame:
    """The best ``pool`` rows of each query with rank; equal scores by key."""
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), F.col(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool)


def hashed_vectors(df: DataFrame, key: str, text: Column, dimensions: int, group: str | None = None) -> DataFrame:
    """(key, the group if there is one, vec): the hashed features of a text scaled to length 1, in Arrow batches within the row; rows whose features cancel out are left out."""
    kept = [key, group] if group else [key]

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[tuple[int, int]]] = {}
        for pdf in batches:
            m = np.zeros((len(pdf), dimensions))
            for row, x in zip(m, pdf["text"]):
                sums: dict[int, int] = {}
                for word, n in Counter(T.TOKENS.findall(x)).items():
                    got = seen.get(word)
                    if got is None:
                        if len(seen) > 500_000:
                            seen.clear()
                        got = seen[word] = [V.place_and_sign(w, dimensions) for w in T.word_features(word)]
                    for at, sign in got:
                        sums[at] = sums.get(at, 0) + sign * n
                row[list(sums)] = list(sums.values())
            length = np.sqrt((m * m).sum(axis=1))
            good = length > 0
            yield pd.DataFrame({**{c: pdf[c].to_numpy()[good] for c in kept}, "vec": list(m[good] / length[good, None])})

    return df.select(*kept, F.coalesce(text, F.lit("")).alias("text")).mapInPandas(embed, f"{_kinds(df, *kept)}, vec array<double>")


Scores = Iterator[tuple[np.ndarray, np.ndarray]]


def dense_map(queries: DataFrame, query_key: str, rows: DataFrame, key: str, schema: str, fold: Callable[[np.ndarray, Scores], Iterator[pd.DataFrame]], group: str | None = None, block: int = 8192) -> DataFrame:
    """Every query against all rows as products of matrices: each task calls fold(query ids, pairs of row ids and scores rounded to 6 digits).

    The query set goes to the tasks in blocks of fixed size, one pass over the rows for each block, so what
    is sent at once is bounded however many queries there are. Rows are written once if there are more blocks.
    With ``group`` pairs of different groups have the score -1.
    """
    spark = rows.sparkSession
    columns = [key, "vec", group] if group else [key, "vec"]

    def run(held: list) -> DataFrame:
        share = spark.sparkContext.broadcast((np.array([r[0] for r in held]), np.array([r[1] for r in held], dtype=np.float64), np.array([r[2] for r in held]) if group else None))

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix, groups = share.value

            def scores() -> Scores:
                for pdf in batches:
                    for s in range(0, len(pdf), 2000):
                        part = pdf.iloc[s : s + 2000]
                        dots = np.round(np.array(part["vec"].tolist(), dtype=np.float64) @ matrix.T, 6)
                        if group:
                            dots[part[group].to_numpy()[:, None] != groups] = -1
                        yield part[key].to_numpy(), dots

            yield from fold(ids, scores())

        return rows.select(*columns).mapInPandas(task, schema)

    out, held, written = spark.createDataFrame([], schema), [], False
    for r in queries.select(query_key, *columns[1:]).toLocalIterator():
        if len(held) == block:
            if not written:
                rows, written = materialise(rows), True
            out, held = out.unionByName(run(held)), []
        held.append(tuple(r))
    return out.unionByName(run(held)) if held else out


def dense_ranked(queries: DataFrame, query_key: str, rows: DataFrame, key: str, pool: int, group: str | None = None) -> DataFrame:
    """(query key, key, score, rank): the best ``pool`` rows of each query by cosine of unit vectors, positive ones only, equal scores by key.

    A task carries the best rows of each query through all its rows and gives ``pool`` of each at the end.
    """
    positive = lambda ids, scores: _best(ids, ((keys, np.where(part > 0, part, -1.0)) for keys, part in scores), query_key, key, pool)
    kinds = f"{_kinds(queries, query_key)}, {_kinds(rows, key)}, score double"
    return ranked(dense_map(queries, query_key, rows, key, kinds, positive, group), query_key, key, pool)


def _best(ids: np.ndarray, scores: Scores, query_key: str, key: str, pool: int) -> Iterator[pd.DataFrame]:
    """The best ``pool`` rows of each query among all rows of a task, equal scores by key; negative scores don't count."""
    bar = np.zeros(len(ids))
    q, k, x, held = [], [], [], 0

    def prune() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        qs, ks, xs = np.concatenate(q), np.concatenate(k), np.concatenate(x)
        order = np.lexsort((ks, -xs, qs))
        qs, ks, xs = qs[order], ks[order], xs[order]
        place = np.arange(len(qs)) - np.searchsorted(qs, qs)
        last = place == pool - 1
        bar[qs[last]] = xs[last]
        keep = place < pool
        return qs[keep], ks[keep], xs[keep]

    for keys, part in scores:
        i, j = np.nonzero(part >= bar)
        q.append(j), k.append(keys[i]), x.append(part[i, j])
        held += len(j)
        if held > 4 * pool * len(ids):
            qs, ks, xs = prune()
            q, k, x, held = [qs], [ks], [xs], len(qs)
    if held:
        qs, ks, xs = prune()
        yield pd.DataFrame({query_key: ids[qs], key: ks, "score": xs})


def sign_ranked(queries: DataFrame, query_key: str, rows: DataFrame, key: str, pool: int, candidates: int) -> DataFrame:
    """As dense_ranked, approximately: the ``candidates`` rows whose signs agree most with the query's are ranked by their cosine.

    Signs take a byte for each number, and only candidates are looked up again.
    """
    signs = lambda df, k: df.select(k, F.transform("vec", F.signum).alias("vec"))
    near = dense_ranked(signs(queries, query_key), query_key, signs(rows, key), key, candidates).select(query_key, key)
    both = near.join(queries.select(query_key, F.col("vec").alias("qv")), query_key).join(rows.select(key, "vec"), key)
    return ranked(both.select(query_key, key, F.round(V.dot(F.col("qv"), F.col("vec")), 6).alias("score")).where("score > 0"), query_key, key, pool)


def dense_pairs(queries: DataFrame, query_key: str, rows: DataFrame, key: str) -> DataFrame:
    """(query key, key, score): the cosine of every query with every row, for few queries whose whole product is wanted."""

    def every(ids: np.ndarray, scores: Scores) -> Iterator[pd.DataFrame]:
        for keys, part in scores:
            yield pd.DataFrame({query_key: np.tile(ids, len(keys)), key: np.repeat(keys, len(ids)), "score": part.ravel()})

    return dense_map(queries, query_key, rows, key, f"{_kinds(queries, query_key)}, {_kinds(rows, key)}, score double", every)


def dense_positive(queries: DataFrame, query_key: str, rows: DataFrame, key: str) -> DataFrame:
    """(query key, positive): how many rows have a positive cosine to each query that has any."""
    kinds = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, n bigint"

    def count(ids: np.ndarray, scores: Scores) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({query_key: ids, "n": sum(((part > 0).sum(axis=0) for _, part in scores), np.zeros(len(ids), dtype=np.int64))})

    return dense_map(queries, query_key, rows, key, kinds, count).groupBy(query_key).agg(F.sum("n").alias("positive")).where("positive > 0")


def runs_held(docs: DataFrame, key: str, text: Column, runs: DataFrame, width: int) -> DataFrame:
    """(key, the other columns of ``runs``), distinct: which rows hold which run of ``width`` consecutive lower-case ASCII words.

    ``runs`` has a column run, words joined by blanks. Few runs (SENT_TERMS) go to every task, which then gives
    only those it meets; more are joined.
    """
    kind = docs.schema[key].dataType.simpleString()
    wanted = [r.run for r in runs.select("run").distinct().limit(SENT_TERMS + 1).collect()]
    share = docs.sparkSession.sparkContext.broadcast(frozenset(wanted) if len(wanted) <= SENT_TERMS else None)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = share.value
        starts = None if only is None else {x.split(" ", 1)[0] for x in only}
        for pdf in batches:
            rows = []
            for i, x in zip(pdf[key], pdf["text"]):
                words = re.findall("[a-z0-9]+", x.lower())
                met = {" ".join(words[s : s + width]) for s in range(len(words) - width + 1) if starts is None or words[s] in starts}
                rows += [(i, r) for r in met if only is None or r in only]
            yield pd.DataFrame(rows, columns=[key, "run"])

    met = docs.select(key, F.coalesce(text, F.lit("")).alias("text")).mapInPandas(find, f"{key} {kind}, run string")
    return met.join(runs, "run").drop("run").distinct()


def fuse(lexical: DataFrame, dense: DataFrame, query_key: str, key: str, top_k: int, k: int = 60, lexical_weight: float = 1.0, dense_weight: float = 1.0) -> DataFrame:
    """Reciprocal-rank fusion: (query key, key, lexical_rank, dense_rank, score, rank); a rank is null where the other ranker found the row."""
    lex = lexical.select(query_key, key, F.col("rank").alias("lexical_rank"))
    den = dense.select(query_key, key, F.col("rank").alias("dense_rank"))
    part = lambda w, r: F.coalesce(F.lit(w).cast("double") / (k + F.col(r)), F.lit(0.0).cast("double"))
    both = lex.join(den, [query_key, key], "full_outer").withColumn("score", F.round(part(lexical_weight, "lexical_rank") + part(dense_weight, "dense_rank"), 6))
    return ranked(both, query_key, key, top_k)


def retrieval_metrics(ranking: DataFrame, qrels: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """Per query with relevant rows: (query key, relevant, hits, recall, reciprocal_rank, hit, ndcg) at k."""
    rel = qrels.select(query_key, key).distinct()
    total = rel.groupBy(query_key).agg(F.count("*").alias("relevant"))
    found = ranking.where(F.col("rank") <= k).join(rel, [query_key, key]).groupBy(query_key).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0).cast("double"), lambda s, r: s + 1 / F.log2(r + 1.0))
    zero = F.lit(0.0).cast("double")
    out = total.join(found, query_key, "left")
    return out.select(query_key, "relevant", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(F.col("hits") / F.col("relevant"), zero).alias("recall"), F.coalesce(1 / F.col("first"), zero).alias("reciprocal_rank"), F.when(F.col("hits") > 0, 1).otherwise(0).alias("hit"), F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"))


def running_counts(counts: DataFrame, value: str, *by: str) -> DataFrame:
    """``counts`` (the groups, value, count) with ``upto``, the rows of the group up to that value, and ``n``, all its rows.

    Sorted by range; each partition adds up its counts, and the sums of the partitions before are added as
    offsets, so no group needs a task of its own.
    """
    ordered = materialise(counts.repartitionByRange(*by, value).sortWithinPartitions(*by, value).withColumn("part", F.spark_partition_id()))
    # One row for each group and partition that holds it.
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    sums = ordered.groupBy(*by, "part").agg(F.sum("count").alias("s"))
    offsets = sums.select(*by, "part", (F.sum("s").over(whole.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(whole).alias("n"))
    within = F.sum("count").over(Window.partitionBy("part", *by).orderBy(value))
    # Null groups are groups too.
    same = F.lit(True)
    for c in ("part", *by):
        same &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = ordered.withColumn("within", within).alias("l").join(offsets.alias("r"), same)
    return both.select(*(F.col(f"l.{c}") for c in by), F.col(f"l.{value}"), F.col("l.count"), (F.col("r.before") + F.col("l.within")).alias("upto"), F.col("r.n"))


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Percentiles by nearest rank, the element at ``round_half_even((n - 1) * p)`` in order, for each group; nulls are left out.

    Ranks come from the counts of distinct values, so a group's rows are summed before they are sorted.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).count()
    pick = lambda p: F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * F.lit(p).cast("double")), F.col(value)))
    return running_counts(counts, value, *by).groupBy(*by).agg(*(pick(p).alias(name) for name, p in shares.items()), F.max("n").alias("samples"))
