"""Selection of context packets under a token budget, with compression of what doesn't fit."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_CJK = re.compile(T.CJK)


def count_tokens(text: str) -> int:
    """The estimate of :func:`functions.text.estimated_tokens` for one string."""
    cjk = len(_CJK.findall(text))
    return max(1, cjk + -(-(len("".join(text.split())) - cjk) // 4))


def keep_head_and_tail(content: str, budget: int, least: int = 8) -> str | None:
    """The longest extract, seven parts head and three tail around a note, that the budget holds; None below the least budget."""
    if budget < least:
        return None

    def extract(n: int) -> str:
        head = max(1, round(n * 0.7))
        tail = max(0, n - head)
        return f"{content[:head]}\n[{len(content) - head - tail} characters left out]\n{content[len(content) - tail:] if tail else ''}"

    lo, hi = 0, len(content) - 1  # lo fits (or is 0), hi + 1 does not
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if count_tokens(extract(mid)) <= budget else (lo, mid - 1)
    best = extract(lo) if lo else None
    return best if best and count_tokens(best) < count_tokens(content) else None


def best_of_duplicates(packets: DataFrame, group: str) -> DataFrame:
    """One packet for each content of a group: mandatory ones first, then priority, then the newer, then the earlier position."""
    key = F.coalesce("dedupe_key", F.sha2(T.normal_form(F.col("content")), 256))
    w = Window.partitionBy(group, "_key").orderBy(F.desc("mandatory"), F.desc("priority"), F.desc(F.coalesce("created_at", F.lit(0).cast("timestamp"))), "position")
    return packets.withColumn("_key", key).withColumn("duplicate", F.row_number().over(w) > 1).drop("_key")


def pack_context(packets: DataFrame, group: str, budget: int) -> DataFrame:
    """(group, packet_id, included, reason, tokens, digest): what each group's context takes in.

    packets: group, packet_id, content, priority, mandatory, source_rank, created_at, position, dedupe_key. Each
    group is one request with a bounded number of packets. Mandatory packets come first; a group whose
    mandatory packets alone exceed the budget includes none and says ``mandatory_over_budget``. Others
    follow by priority; one that doesn't fit is compressed if what is left allows it.
    """
    marked = best_of_duplicates(packets, group)
    kind = packets.schema[group].dataType.simpleString()

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        created = pdf["created_at"].fillna(pd.Timestamp(0))
        pdf = pdf.assign(_t=-created.astype("int64"), _p=-pdf["priority"], _m=~pdf["mandatory"])
        # Mandatory packets by source and priority, the others by priority, source, age and id.
        must = pdf[pdf["mandatory"]].sort_values(["source_rank", "_p", "position"])
        may = pdf[~pdf["mandatory"]].sort_values(["_p", "source_rank", "_t", "packet_id"])
        left, out = budget, []
        over = sum(count_tokens(c) for c, d in zip(must["content"], must["duplicate"]) if not d) > budget
        for i, content, dup, must_have in pd.concat([must, may])[["packet_id", "content", "duplicate", "mandatory"]].itertuples(index=False, name=None):
            n, digest = count_tokens(content), None
            if dup:
                reason = "duplicate"
            elif over:
                reason = "mandatory_over_budget"
            elif n <= left:
                reason, digest = "included", content
            elif not must_have and (short := keep_head_and_tail(content, left)) is not None:
                reason, n, digest = "compressed", count_tokens(short), short
            else:
                reason = "budget_exceeded"
            if digest is not None:
                left -= n
            out.append((pdf[group].iat[0], i, digest is not None, reason, n, hashlib.sha256(digest.encode()).hexdigest() if digest is not None else None))
        return pd.DataFrame(out, columns=[group, "packet_id", "included", "reason", "tokens", "digest"])

    return marked.groupBy(group).applyInPandas(select, f"`{group}` {kind}, packet_id string, included boolean, reason string, tokens int, digest string")
