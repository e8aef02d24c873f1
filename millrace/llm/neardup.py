"""Near-duplicate records with small edits, by Bayesian candidate pruning.

Words are lower-cased maximal runs of letters and digits. The agreement of two contents is the number of
common words, counted with repetition and in any order, divided by the word count of the longer one.

Candidates come from an exact (lossless) prefix index over word occurrences, rarest first. Each posting
carries 256 one-bit MinHash values of the content. A pair's values are compared 32 at a time, and it is
dropped as soon as the posterior probability of reaching the threshold falls below ``tolerance``. The
pairs that are left are verified exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .files import may_meet, pairs_in_files

WORD = r"[\p{L}\p{N}]+"
STEP, BITS = 32, 256
#: The one-bit values of a content, 64 in each column.
SIGNATURE = [f"s{i}" for i in range(BITS // 64)]


def _posterior(m: int, n: int, jaccard: float) -> float:
    """P(similarity >= jaccard | m of n one-bit values agree), uniform prior over [0, 1]."""

    def upper(x: float) -> float:  # P(Beta(m + 1, n - m + 1) > x)
        return sum(math.comb(n + 1, i) * x**i * (1 - x) ** (n + 1 - i) for i in range(m + 1))

    return upper((1 + jaccard) / 2) / max(upper(0.5), 1e-300)


def least_matches(jaccard: float, tolerance: float) -> list[int]:
    """For 32, 64, ... compared values the least number of agreements with which a pair stays."""
    return [next(m for m in range(n + 1) if m == n or _posterior(m, n, jaccard) >= tolerance) for n in range(STEP, BITS + 1, STEP)]


def content_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, words, cid): the sorted words and the class of contents with the same words; rows without words or id are left out, repeated rows repeat."""
    words = F.array_sort(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0)))
    out = df.select(F.col(id_col).cast("string").alias("id"), words.alias("words")).where("id is not null and size(words) > 0")
    return out.select("id", F.size("words").alias("n"), "words", F.xxhash64(F.array_join("words", " ")).alias("cid"))


def near_duplicate_classes(words: DataFrame, threshold: float = 0.8, tolerance: float = 1e-4, frequent: int = 32768, rare: int = 128, short: int = 200, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(links, members): links(a, b, agreement) between classes of equal words, members(id, cid).

    ``frequent`` bounds the table of the most frequent words that every task gets; all other words count
    as equally rare. The table steers speed only: the prefix index is lossless whatever it holds. Two
    contents that agree share at least two words of their prefixes, which are longer by one word than needed
    for one. Words with up to ``rare`` occurrences are posted by themselves, the others of a content of up
    to ``short`` words in pairs; longer contents post all prefix words by themselves. Inverted files longer
    than ``block`` are cut into block pairs, none is truncated.
    """
    spark = words.sparkSession
    members = words.select("id", "cid").distinct()
    classes = materialise(words.select("cid", "n", "words").dropDuplicates(["cid"]))
    top = classes.select(F.explode("words").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(frequent).collect()
    order = spark.sparkContext.broadcast({r.w: (i + 1, r["count"] > rare) for i, r in enumerate(reversed(top))})
    rng = np.random.default_rng(20240521)
    mul = rng.integers(1, 2**63, BITS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, BITS, dtype=np.uint64)
    jaccard = threshold / (2 - threshold)
    least = lambda n: math.ceil(threshold * n - 1e-9)

    def keys_of(toks: list[tuple[int, bool, int]]) -> Iterator[int]:
        n = len(toks)
        base = n - least(n) + 1
        prefix = sorted(toks)[: base + 1]
        for k, (_, common, h) in enumerate(prefix):
            # One shared word may be all if this content or one that agrees with it is that short.
            if not common or k < base and (n > short * threshold or least(least(n)) < 2):
                yield h | 1
        if n <= short:
            pre = np.array([h for _, common, h in prefix if common], dtype=np.uint64)
            i, j = np.triu_indices(len(pre), 1)
            lo, hi = np.minimum(pre[i], pre[j]), np.maximum(pre[i], pre[j])
            yield from (int(x) for x in (lo * np.uint64(0x9E3779B97F4A7C15) ^ hi) & ~np.uint64(1))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = order.value
        for pdf in batches:
            if not len(pdf):
                continue
            hashes, starts, postings = [], [], []
            for ws in pdf["words"]:
                starts.append(len(hashes))
                toks, last, seen = [], None, 0
                for w in ws:
                    seen = seen + 1 if w == last else 0
                    last = w
                    toks.append((*rank.get(w, (0, False)), xxhash.xxh64_intdigest(w, seed=seen)))
                hashes.extend(h for _, _, h in toks)
                postings.append(list(keys_of(toks)))
            h = np.array(hashes, dtype=np.uint64)
            sig = np.zeros((len(pdf), BITS), dtype=np.uint8)
            for b in range(BITS):
                x = h * mul[b] + add[b]
                x ^= x >> np.uint64(29)
                sig[:, b] = (np.minimum.reduceat(x * np.uint64(0xBF58476D1CE4E5B9), starts) >> np.uint64(37)) & np.uint64(1)
            packed = np.packbits(sig, axis=1).view(np.int64)
            cnt = np.array([len(p) for p in postings])
            keys = np.fromiter(itertools.chain.from_iterable(postings), dtype=np.uint64, count=int(cnt.sum())).view(np.int64)
            cids, ns = pdf["cid"].to_numpy(), pdf["n"].to_numpy()
            at = np.repeat(np.arange(len(pdf)), cnt)
            for s in range(0, len(at), 200_000):
                a = at[s : s + 200_000]
                yield pd.DataFrame({"key": keys[s : s + 200_000], "cid": cids[a], "n": ns[a], **{c: packed[a, i] for i, c in enumerate(SIGNATURE)}})

    payload = "n int, " + ", ".join(f"{c} bigint" for c in SIGNATURE)
    need = least_matches(jaccard, tolerance)
    postings = classes.mapInPandas(post, f"key bigint, cid bigint, {payload}")
    pairs = pairs_in_files(postings, payload, lambda rows: _pairs(rows, threshold, need), block, 50_000)
    wa, wb = classes.select(F.col("cid").alias("a"), F.col("words").alias("wa")), classes.select(F.col("cid").alias("b"), F.col("words").alias("wb"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for pdf in batches:
            keep, agree = [], []
            for i, (x, y) in enumerate(zip(pdf["wa"], pdf["wb"])):
                common = sum((Counter(x.tolist()) & Counter(y.tolist())).values())
                if common >= threshold * max(len(x), len(y)) - 1e-9:
                    keep.append(i)
                    agree.append(common / max(len(x), len(y)))
            out = pdf.iloc[keep][["a", "b"]].copy()
            out["agreement"] = agree
            yield out

    links = pairs.join(wa, "a").join(wb, "b").select("a", "b", "wa", "wb").mapInPandas(verify, "a bigint, b bigint, agreement double")
    return links, members


def _pairs(done: pd.DataFrame, threshold: float, need: list[int]) -> Iterator[np.ndarray]:
    """Pairs of rows with equal keys (sorted) that survive the length bound and the Bayesian pruning."""
    keys, cids, ns, side = (done[c].to_numpy() for c in ("key", "cid", "n", "side"))
    sig = np.stack([done[c].to_numpy() for c in SIGNATURE], axis=1).view(np.uint32)
    alive, d = np.arange(len(done) - 1), 1
    while len(alive):
        alive = alive[alive + d < len(done)]
        alive = alive[keys[alive] == keys[alive + d]]
        for s in range(0, len(alive), 500_000):
            a = alive[s : s + 500_000]
            b = a + d
            ok = (cids[a] != cids[b]) & may_meet(side, a, b) & (np.minimum(ns[a], ns[b]) >= threshold * np.maximum(ns[a], ns[b]) - 1e-9)
            a, b = a[ok], b[ok]
            agree = np.zeros(len(a), dtype=np.int64)
            for part, least in enumerate(need):
                agree += STEP - np.bitwise_count(sig[a, part] ^ sig[b, part])
                ok = agree >= least
                a, b, agree = a[ok], b[ok], agree[ok]
            if len(a):
                yield np.stack([np.minimum(cids[a], cids[b]), np.maximum(cids[a], cids[b])], axis=1)
        d += 1


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows whose words agree by at least the threshold.

    Null ids and texts without words take no part; a repeated row counts once; an empty table gives no
    pairs. Copies are searched as one class; here, where the result is defined by pairs, classes are
    expanded by joins on the class.
    """
    words = materialise(content_words(df, id_col, text_col))
    links, members = near_duplicate_classes(words, threshold)
    ma, mb = members.select(F.col("id").alias("x"), F.col("cid").alias("a")), members.select(F.col("id").alias("y"), F.col("cid").alias("b"))
    same = ma.join(mb, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    other = links.join(ma, "a").join(mb, "b").select("x", "y")
    return same.unionByName(other).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, links, group_id): one row per document, its class of copies, the number of other classes it links to, and the connected group."""
    from ..operators.graph import connected_components

    words = materialise(content_words(df, id_col, text_col))
    links, members = near_duplicate_classes(words, threshold)
    links = materialise(links)
    degree = links.select(F.col("a").alias("cid")).union(links.select("b")).groupBy("cid").agg(F.count("*").alias("links"))
    groups = connected_components(links.select("a", "b")).withColumnRenamed("node", "cid")
    return members.join(degree, "cid", "left").join(groups, "cid", "left").select("id", F.col("cid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("group_id"))
