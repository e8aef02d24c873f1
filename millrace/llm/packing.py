"""Filling fixed-capacity containers with documents, by hierarchical residual packing.

Every partition fits its items best-fit-decreasing and emits the bins that are nearly full. Underfull
bins become the items of the next round, which has fewer partitions, down to one: a tree of merges.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, ship_file, shipped_path

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public splitting pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) by a byte-level BPE rank file of the driver; a null text has 0 tokens, null ids are left out."""
    name = ship_file(df.sparkSession, tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(shipped_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "tokens": [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["text"]]})

    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return src.mapInPandas(count, "id bigint, tokens bigint")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: lists of indexes, one for each bin. Ties go to the earlier index and the older bin."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            room, b = capacity - sizes[i], len(bins) - 1
        else:
            room, b = free.pop(at)
            bins[b].append(i)
            room -= sizes[i]
        if room > 0:
            bisect.insort(free, (room, b))
    return bins


def pack(sizes: DataFrame, capacity: int = 4096, full: float = 0.98, rows_per_task: int = 20_000, leaves: int = 4, fan_in: int = 4) -> DataFrame:
    """(container, id, part, parts, tokens): every item of ``sizes`` (id, tokens) in one container of the capacity.

    Only an item longer than the capacity is split: into full containers of its own and a remainder that
    is packed like an item. Items of 0 or null tokens take no room and share container ``empty``.
    Repeated ids are kept as separate rows. An empty table gives no containers. The first round has a task
    for each ``rows_per_task`` items, ``leaves`` at least; bins filled to ``full`` are emitted by the task
    that made them, the others are the items of the next round with as many tasks divided by ``fan_in``, down to
    one. Where more bins than one task takes can't be filled, the tree ends when a round merges
    less than one in a hundred.
    The result depends on the items alone, not on their order or on the run.
    """
    items = sizes.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("tokens"))
    # Equal rows are counted, then numbered, so that each piece has a name of its own.
    counted = items.groupBy("id", "tokens").agg(F.count("*").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    each = counted.select("id", "tokens", parts.alias("parts"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    cut = each.select("id", "copy", "parts", "tokens", F.explode(F.sequence(F.lit(1), "parts")).alias("part"))
    cut = materialise(cut.select("id", "copy", "part", "parts", F.when(F.col("part") < F.col("parts"), capacity).otherwise(F.col("tokens") - capacity * (F.col("parts") - 1)).cast("bigint").alias("tokens")))
    done = cut.where("tokens = 0").select(F.lit("empty").alias("container"), "id", "part", "parts", "tokens")
    # Rows of one id may have different lengths, hence parts in the name.
    whole = cut.where(F.col("tokens") == capacity).select(F.concat_ws("-", F.concat(F.lit("w"), "id"), "part", "parts", "copy").alias("container"), "id", "part", "parts", "tokens")
    open_bins = cut.where((F.col("tokens") > 0) & (F.col("tokens") < capacity)).select("tokens", F.array(F.struct("id", "copy", "part", "parts", "tokens")).alias("items"))
    schema = "done boolean, tokens bigint, items array<struct<id:bigint,copy:bigint,part:int,parts:int,tokens:bigint>>"
    left = cut.count()
    tasks = max(leaves, -(-left // rows_per_task))
    closed, step = [], 0
    while True:
        last = tasks == 1

        def fit(batches: Iterator[pd.DataFrame], last: bool = last) -> Iterator[pd.DataFrame]:
            rows = [pdf for pdf in batches if len(pdf)]
            if not rows:
                return
            pdf = pd.concat(rows, ignore_index=True)
            sizes, held = pdf["tokens"].tolist(), pdf["items"].tolist()
            out = []
            for b in best_fit(sizes, capacity):
                load = sum(sizes[i] for i in b)
                out.append((last or load >= full * capacity, load, [x for i in b for x in held[i]]))
                if len(out) == 5000:
                    yield pd.DataFrame(out, columns=["done", "tokens", "items"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["done", "tokens", "items"])

        spread = open_bins.repartition(tasks, F.xxhash64(F.col("items")[0], F.lit(step))).sortWithinPartitions(F.desc("tokens"), F.col("items")[0])
        fitted = materialise(spread.mapInPandas(fit, schema))
        closed.append(fitted.where("done"))
        if last:
            break
        open_bins = fitted.where("not done").select("tokens", "items")
        before, left, step = left, open_bins.count(), step + 1
        fewer = max(1, tasks // fan_in, -(-left // rows_per_task))
        if fewer >= tasks and left > 0.99 * before:
            closed.append(open_bins.select(F.lit(True).alias("done"), "tokens", "items"))
            break
        tasks = min(fewer, tasks)
    bins = closed[0]
    for x in closed[1:]:
        bins = bins.unionByName(x)
    rows = bins.select(F.concat(F.lit("b"), F.sha2(F.to_json("items"), 256)).alias("container"), F.explode("items").alias("x"))
    return rows.select("container", "x.id", "x.part", "x.parts", "x.tokens").unionByName(done).unionByName(whole)
