"""Most similar vectors for every vector, by a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in inverted files keyed by sets
of ``key_pivots`` of its ``posted`` nearest pivots, so vectors meet only if several of their nearest pivots
agree. Within a file pairs are ranked by the footrule distance of their pivot orders; pairs within
``max_footrule`` are reranked by the exact cosine. This finds near vectors; ``nearest_vectors`` compares all.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise, shuffle_width
from .files import may_meet, pairs_in_files

PREFIX = 24
#: The prefix of a pivot order, four 16-bit numbers in each column.
PACKED = [f"p{i}" for i in range(PREFIX // 4)]
_P = ", ".join(f"{p} bigint" for p in PACKED)
#: Pivots that are drawn: as many as keep the mean inverted file at FILE rows, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS, FILE = 1024, 16384, 0.375


def unit_vectors(df: DataFrame, id_col: str, model_col: str, vector: Column, dim: int = 64) -> DataFrame:
    """(id, model, vec) with vec scaled to length 1.

    Null ids, null models, null vectors, vectors without exactly ``dim`` finite numbers and all-zero
    vectors take no part. ``vector`` may be an array of numbers or a JSON array in a string.
    """
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(model_col).cast("string").alias("model"), vector.alias("raw"))
    src = src.where("id is not null and model is not null and raw is not null")

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, rows = [], []
            for i, raw in enumerate(pdf["raw"]):
                if isinstance(raw, str):
                    try:
                        raw = json.loads(raw)
                    except ValueError:
                        continue
                    if not isinstance(raw, list) or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in raw):
                        continue
                if len(raw) == dim:
                    keep.append(i)
                    rows.append(raw)
            if not rows:
                continue
            m = np.array(rows, dtype=np.float64)
            top = np.abs(m).max(axis=1, keepdims=True)
            good = np.isfinite(top[:, 0]) & (top[:, 0] > 0)
            m = m[good] / top[good]
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            out = pdf.iloc[np.array(keep)[good]][["id", "model"]].copy()
            out["vec"] = list(m.astype(np.float32))
            yield out

    return src.mapInPandas(scale, "id string, model string, vec array<float>")


def _footrule_pairs(keys: np.ndarray, cids: np.ndarray, perms: np.ndarray, side: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Pairs (smaller, larger class) with equal keys whose footrule distance is within the limit; rows are sorted by key."""
    i = np.arange(PREFIX)
    gain = (np.abs(i[:, None] - i[None, :]) - (PREFIX - i)[:, None] - (PREFIX - i)[None, :]).astype(np.float32).ravel()
    n, d = len(keys), 1
    alive = np.arange(n - 1)
    while True:
        alive = alive[alive + d < n]
        alive = alive[keys[alive] == keys[alive + d]]
        if not len(alive):
            return
        for s in range(0, len(alive), 10_000):
            a = alive[s : s + 10_000]
            b = a + d
            ok = (cids[a] != cids[b]) & may_meet(side, a, b)
            a, b = a[ok], b[ok]
            same = (perms[a][:, :, None] == perms[b][:, None, :]).reshape(len(a), PREFIX * PREFIX)
            near = PREFIX * (PREFIX + 1) + same.astype(np.float32) @ gain <= limit
            a, b = a[near], b[near]
            if len(a):
                yield np.stack([np.minimum(cids[a], cids[b]), np.maximum(cids[a], cids[b])], axis=1)
        d += 1


def pivots_for(n: int, keys: int) -> int:
    """How many pivots n vectors get that are posted under so many pairs of pivots each.

    The number of possible files grows with the square of the pivots, so pivots grow with the root of n and
    the mean file would keep its length if they were equally long; work then grows as n to 1.5 at most, until MOST_PIVOTS is reached.
    """
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, 256 * math.ceil(math.sqrt(2 * keys * n / FILE) / 256)))


def similar_pairs(vectors: DataFrame, k: int = 5, min_cos: float = 0.0, pivots: int | None = None, posted: int = 6, key_pivots: int = 2, max_footrule: int = 300, block: int = 4096, exact: bool = False) -> DataFrame:
    """The k most similar vectors of the same model for every vector: (id, other, cosine, rank).

    ``vectors`` comes from :func:`unit_vectors`. Vectors that agree to 4 decimals in each number form one
    class with a cosine of 1 (the true one is above 1 - 1e-6), searched once and expanded at the end; among
    equal cosines the smaller id ranks first. The pivot set is a bounded sample (by hash of the id), of
    ``pivots`` vectors or, without a number, as :func:`pivots_for` says; every vector is indexed. An inverted
    file longer than ``block`` is cut into block pairs, each a task of bounded size, so no file is truncated.
    Repeated ids count once. An empty input gives an empty result. The index is made for near vectors (the
    README gives its recall); with ``exact`` all vectors of a model are compared and only those of a cosine
    of ``min_cos`` or more are kept.
    """
    if exact:
        return nearest_vectors(vectors, k).where(F.col("cosine") >= min_cos)
    rows, classes = _classes(vectors)
    pivots = pivots or pivots_for(classes.count(), math.comb(posted, key_pivots))
    chosen = classes.select("vec", F.xxhash64("cid").alias("h")).orderBy("h").limit(pivots).collect()
    if len(chosen) < key_pivots:
        pairs = classes.select(F.col("cid").alias("a"), "model").join(classes.select(F.col("cid").alias("b"), "model"), "model").where("a < b").select("a", "b")
    else:
        pairs = _candidates(classes, np.array([r.vec for r in chosen], dtype=np.float32), min(posted, len(chosen)), key_pivots, max_footrule, block)
    # One pass over the vectors serves both ends of the pairs.
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("cid")).join(classes.select("cid", "vec"), "cid")
    met = ends.groupBy("a", "b").agg(F.collect_list("vec").alias("v")).where(F.size("v") == 2)
    dot = F.aggregate(F.zip_with(F.col("v")[0], F.col("v")[1], lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
    scored = met.select("a", "b", dot.alias("cosine")).where(F.col("cosine") >= min_cos)
    both = scored.select("a", "b", "cosine").union(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    # The k nearest classes hold the k nearest vectors; of each class its k + 1 smallest ids are enough.
    nearest = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("r") <= k).drop("r")
    return _expand(rows, classes, nearest, k)


def nearest_vectors(vectors: DataFrame, k: int = 5, block: int = 16384) -> DataFrame:
    """The k most similar vectors of the same model for every vector, exactly and whatever the cosine: (id, other, cosine, rank).

    As :func:`similar_pairs` without its index and its floor, cosines rounded to 6 digits before they are ranked: all classes of a model are compared, in tasks of
    two blocks of about ``block`` classes each. Work grows with the square of the largest model, memory of a
    task does not. A vector has fewer than k rows only if its model has no more vectors.
    """
    spark = vectors.sparkSession
    rows, classes = _classes(vectors)
    blocks = classes.groupBy("model").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    pairs = blocks.select(F.sum(F.col("blocks").cast("bigint") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    width = max(shuffle_width(spark), min(int(pairs), 64 * spark.sparkContext.defaultParallelism))
    marked = classes.join(blocks, "model").withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    tasks = marked.select("model", "cid", "id", "vec", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("model", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "cid", "id", "vec", "own")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        # In the order of ids, so that of equal cosines the smaller id comes first.
        pdf = pdf.sort_values("id", ignore_index=True)
        v, cids, ids = np.array(pdf["vec"].tolist(), dtype=np.float32), pdf["cid"].to_numpy(), pdf["id"].to_numpy()
        low = np.flatnonzero(pdf["own"] == pdf["lo"])
        high = np.flatnonzero(pdf["own"] == pdf["hi"])
        out = []
        for x, y in [(low, high)] if pdf["lo"].iat[0] == pdf["hi"].iat[0] else [(low, high), (high, low)]:
            for a, b, cosine in _exact_nearest(v, x, y, k):
                out.append(pd.DataFrame({"a": cids[a], "b": cids[b], "id": ids[b], "cosine": cosine}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": [], "b": [], "id": [], "cosine": []})

    met = tasks.repartition(width, "model", "lo", "hi").groupBy("model", "lo", "hi").applyInPandas(meet, "a bigint, b bigint, id string, cosine double")
    nearest = met.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "id"))).where(F.col("r") <= k)
    return _expand(rows, classes, nearest.select("a", "b", "cosine"), k)


def _exact_nearest(v: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, cosine): for each of the rows x of v the k most similar other rows among y; earlier rows first."""
    vy = np.ascontiguousarray(v[y].T)
    groups = len(y) // 64
    for s in range(0, len(x), 512):
        part = x[s : s + 512]
        cosines = v[part] @ vy
        cosines[part[:, None] == y[None, :]] = -np.inf
        # The k-th of the groups' maxima is at most the k-th cosine; single precision is off by less than 1e-5.
        if groups > k:
            top = cosines[:, : groups * 64].reshape(len(part), 64, groups).max(axis=1)
            least = np.partition(top, groups - k, axis=1)[:, groups - k]
        elif len(y) > k:
            least = np.partition(cosines, len(y) - k, axis=1)[:, len(y) - k]
        else:
            least = np.full(len(part), -np.inf, dtype=np.float32)
        r, c = np.nonzero(cosines >= (least - np.float32(1e-5))[:, None])
        a, b = part[r], y[c]
        a, b = a[a != b], b[a != b]
        exact = np.empty(len(a))
        for i in range(0, len(a), 100_000):
            exact[i : i + 100_000] = np.einsum("ij,ij->i", v[a[i : i + 100_000]].astype(np.float64), v[b[i : i + 100_000]].astype(np.float64))
        exact = np.round(exact, 6)
        order = np.lexsort((b, -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        yield a[keep], b[keep], exact[keep]


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their class (cid), and (cid, id, model, vec, n) for each class of equal vectors."""
    rows = vectors.withColumn("cid", F.xxhash64("model", F.transform("vec", lambda x: F.round(x, 4) + F.lit(0.0).cast("float"))))
    classes = rows.groupBy("cid").agg(F.min_by(F.struct("id", "model", "vec"), "id").alias("r"), F.count("*").alias("n"))
    return rows, materialise(classes.select("cid", "r.id", "r.model", "r.vec", "n"))


def _expand(rows: DataFrame, classes: DataFrame, nearest: DataFrame, k: int) -> DataFrame:
    """(id, other, cosine, rank) of the vectors, from (a, b, cosine) of the k nearest classes of each class."""
    # Most classes have one row; only rows of the others are read again.
    single = classes.where("n = 1").select("cid", "id")
    copies = rows.select("cid", "id").join(classes.where("n > 1").select("cid"), "cid", "left_semi").distinct()
    heads = copies.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("r") <= k + 1)
    members = heads.groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("ids")).unionByName(single.select("cid", F.array("id").alias("ids")))
    own = members.select(F.col("cid").alias("a"), F.lit(1.0).cast("double").alias("cosine"), "ids").where(F.size("ids") > 1)
    near = nearest.join(members.withColumnRenamed("cid", "b"), "b").select("a", "cosine", "ids")
    lists = own.unionByName(near).groupBy("a").agg(F.collect_list(F.struct("cosine", "ids")).alias("lists"))
    seen = single.unionByName(copies).select(F.col("cid").alias("a"), "id").join(lists, "a")
    flat = F.flatten(F.transform("lists", lambda p: F.transform(p["ids"], lambda i: F.struct((-p["cosine"]).alias("d"), i.alias("other")))))
    top = F.slice(F.array_sort(F.filter(flat, lambda x: x["other"] != F.col("id"))), 1, k)
    out = seen.select("id", F.posexplode(top).alias("pos", "x"))
    return out.select("id", F.col("x.other").alias("other"), (-F.col("x.d")).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def _candidates(classes: DataFrame, pivot: np.ndarray, posted: int, key_pivots: int, max_footrule: int, block: int) -> DataFrame:
    """Distinct pairs of classes that meet in an inverted file and whose pivot orders are near each other."""
    combos = np.array(list(itertools.combinations(range(posted), key_pivots)))
    share = classes.sparkSession.sparkContext.broadcast(pivot)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = share.value
        width = min(PREFIX, len(p))
        step = max(1, 8_000_000 // len(p))
        for pdf in (x.iloc[i : i + step] for x in batches for i in range(0, len(x), step)):
            v = np.array(pdf["vec"].tolist(), dtype=np.float32).reshape(len(pdf), p.shape[1])
            s = v @ p.T
            part = np.argpartition(-s, width - 1, axis=1)[:, :width]
            order = np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, axis=1), axis=1, kind="stable"), axis=1)
            perm = np.full((len(v), PREFIX), len(p), dtype=np.uint16)
            perm[:, :width] = order
            near = np.sort(order[:, :posted], axis=1).astype(np.int64)
            key = np.zeros((len(v), len(combos)), dtype=np.int64)
            for c in range(key_pivots):
                key = key * len(p) + near[:, combos[:, c]]
            packed = np.repeat(perm.view(np.int64), len(combos), axis=0)
            yield pd.DataFrame({"cid": np.repeat(pdf["cid"].to_numpy(), len(combos)), "model": np.repeat(pdf["model"].to_numpy(), len(combos)), "pk": key.ravel(), **{p: packed[:, i] for i, p in enumerate(PACKED)}})

    def compare(rows: pd.DataFrame) -> Iterator[np.ndarray]:
        perms = np.ascontiguousarray(rows[PACKED].to_numpy()).view(np.uint16)
        return _footrule_pairs(rows["key"].to_numpy(), rows["cid"].to_numpy(), perms, rows["side"].to_numpy(), max_footrule)

    postings = classes.mapInPandas(post, f"cid bigint, model string, pk bigint, {_P}").select(F.xxhash64("model", "pk").alias("key"), "cid", *PACKED)
    return pairs_in_files(postings, _P, compare, block)
