"""Per-document text quality statistics and outlier scores from exact per-language ranks.

Ranks come from a range-partitioned sort of the distinct values with their counts: running sums within the
partitions plus the offsets of the partitions before. Tail probabilities of the statistics are combined
into one outlier score, and into a lean towards junk, which decides where the share of running sentences
is near the bar.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise

# The common words of the languages at hand.
COMMON = frozenset(
    "the a an of in on at to and or but nor so yet for with without by from as is are was were be been being am do does did has have had this that these those it its every each our your their his her my we you they he she i not no never always often sometimes usually rarely once more than then when while although because unless until after before during according instead outside next together only just also if into over under between about against even still already "
    "der die das den dem des ein eine einen einem einer eines und oder aber nicht nie nur noch mit ohne von vom zu zum zur im in am an auf aus bei beim für gegen über unter nach vor ist sind war waren wird werden hat haben dieser diese dieses diesen diesem jeder jede jedes jeden jedem dass weil sobald damit obwohl wenn als wie so auch immer fast mehr trotz"
    .split()
)
# Common words of further languages; a paragraph is measured by the list that fits it best.
FURTHER = [
    frozenset(x.split())
    for x in (
        "le la les un une des du de et ou mais donc ne pas plus que qui où dans sur sous avec sans pour par est sont était être a ont avait ce cette ces son sa ses leur il elle ils elles nous vous je on au aux comme si quand",
        "el la los las un una unos de del y o pero no que quien en con sin por para es son era ser está están fue ha han se su sus lo le les como más muy ya cuando donde este esta estos al yo nos si porque",
        "il lo la i gli le un una di del della dei e o ma non che chi in con senza per da dal è sono era essere ha hanno si suo sua loro come più molto già quando dove questo questa questi al alla nel nella se perché",
        "o a os as um uma de do da dos das e ou mas não que quem em no na nos nas com sem por para é são era ser está foi tem têm se seu sua como mais muito já quando onde este esta isso ao à pelo pela porque",
        "de het een en of maar niet dat die dit deze in op met zonder voor door van is zijn was waren wordt worden heeft hebben er hij zij ze wij we ik je als dan ook nog al naar bij uit om te aan over waar wanneer omdat",
        "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только её мне было вот от меня ещё нет о из ему когда даже ну ли если или быть был была были это для при мы они",
        "i w we z ze na do że nie się jest są był była było a ale o od po za jak to ten ta te tego który która które przez przy dla czy oraz już tylko gdy kiedy jego jej ich być lub",
    )
]
KANA_HANGUL = re.compile(r"[\u3040-\u30ff\uac00-\ud7af]")
ANY_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SENTENCE_END = re.compile(r"[^\W\d_)\"»”’][)\"»”’]*[.!?…。！？؟।]")
WORD = re.compile(r"[^\W\d_][\w'’-]*|\d[\w.,]*")
CJK = re.compile(r"[\u3400-\u9fff\uf900-\ufaff]")
END = ".!?;:…。！？；：\"'”’)）»"
CLOSES = re.compile(r"[.!?…。！？;；:](?:[\"'”’)）»]*)$")
BULLET = re.compile(r"^\s*(?:[-*+•·–▪◦‣]|\(?\d{1,3}[.)]|[a-zA-Z][.)]|\[[ xX]?\])\s+(?:\[[ xX]?\]\s+)?")
LOWER_WORD = re.compile(r"[a-zäöüß]+(?:['’][a-z]+)?")
CJK_MARK = re.compile(r"[。！？；，、,!?;]")
CJK_COMMON = re.compile(r"[的是不了在我有和这个们中]")
QUOTE = re.compile(r"^(?:[>#]+\s*)+")
HEADING = re.compile(r"^(?:#{1,6} |[=-]{3,}$)")
LETTERS = str.maketrans("", "", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ`_./()")
SPEAKER = re.compile(r"^\s*(?:[A-Z][\w .-]{0,30}|[\u4e00-\u9fff]{1,8})[:：]\s+")
STATISTICS = ("words", "mean_word_len", "symbol_ratio", "digit_ratio", "upper_ratio", "punct_lines", "common_share", "mean_line_len", "repeated_lines", "running_share")
#: The side on which a statistic speaks of junk: 1 its high tail, -1 its low tail.
JUNK_SIDE = {"symbol_ratio": 1, "digit_ratio": 1, "upper_ratio": 1, "punct_lines": -1, "common_share": -1, "repeated_lines": 1, "running_share": -1}


def _visible(s: str) -> int:
    return len("".join(s.split()))


def _looks_like_row(line: str) -> bool:
    """A line that is a row of a table, a list entry, a setting, a listing or a link bar, whatever its words."""
    s = line.strip()
    if "\t" in s or s.count("|") >= 2 or re.search(r"\S(?: {2,}|　)\S.*", s) and not re.search(r"[.!?] {2}\S", s):
        return True
    if s.count(",") >= 3 and not re.search(r", ", s) or s.count(";") >= 3 and "; " not in s:
        return True
    if re.match(r"^[\w.\[\]\"'-]+\s*(?:=|:=|=>|->)\s*\S", s) or re.match(r"^(?:[<{}\[\]()@$>]|</|//|/\*|#include|def |class |import |from \w+ import|function |return\b|if \(|for \(|\w+\([^)]*\)[;{]?$)", s):
        return True
    return bool(re.match(r"^\d{4}-\d\d-\d\d[T ]|^\[?\d\d:\d\d|^(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b", s))


def _is_running(text: str, shown: int, bullet: bool) -> bool:
    """Whether a paragraph (or an entry of a list) with so many visible characters is made of sentences."""
    cjk = 0 if text.isascii() else len(CJK.findall(text))
    if not text.isascii() and (kana := len(KANA_HANGUL.findall(text))):
        return cjk + kana >= max(12 if bullet else 8, 0.3 * shown) and bool(CJK_MARK.search(text) or SENTENCE_END.search(text))
    if cjk >= 0.3 * shown:
        return cjk >= 8 and bool(CJK_MARK.search(text)) and (not bullet or cjk >= 12 and bool(CLOSES.search(text.rstrip())))
    words = LOWER_WORD.findall(text.lower())
    common = [w for w in words if w in COMMON]
    if len(words) < 4 or len(common) < max(1, 0.14 * len(words)) or len(set(common)) < min(2, len(words) // 6 + 1):
        return _is_running_elsewhere(text, shown, bullet)
    rest = len("".join(text.translate(LETTERS).split())) if text.isascii() else sum(not (c.isalpha() or c.isspace() or c in "`_./()") for c in text)
    return rest <= 0.3 * shown and (not bullet or len(words) >= 7 and len(common) >= 2)


def _is_running_elsewhere(text: str, shown: int, bullet: bool) -> bool:
    """As above for other languages: by their common words; without a list for them, by letters and ends of sentences."""
    words = ANY_WORD.findall(text.lower())
    if len(words) < (10 if bullet else 6) or sum(map(len, words)) < 0.7 * shown:
        return False
    for known in FURTHER:
        common = [w for w in words if w in known]
        if len(common) >= 0.2 * len(words) and len(set(common)) >= 3:
            return True
    foreign = sum(not (c.isascii() or c in "äöüÄÖÜß") for w in words for c in w)
    if text.isascii() or foreign < 0.05 * shown or CJK.search(text):
        return False
    # Sentences end in a word, and most words repeat in no fixed row: capitals are few, short words are some.
    names = sum(w[0].isupper() for w in ANY_WORD.findall(text))
    return bool(SENTENCE_END.search(text)) and names <= 0.5 * len(words) and sum(len(w) <= 4 for w in words) >= 0.15 * len(words)


def running_parts(text: str) -> tuple[int, int]:
    """(characters in running sentences, all characters), white space left out."""
    running = 0
    para: list[str] = []

    def flush() -> int:
        if not para:
            return 0
        joined = " ".join(para)
        para.clear()
        shown = _visible(joined)
        return shown if shown and _is_running(joined, shown, False) else 0

    fence = False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = line.strip()
        if s.startswith((">", "#")):
            # Quoted or commented text counts as what it holds; a short line after # is a heading.
            inner = QUOTE.sub("", s)
            if s[0] == ">" or sum(w in COMMON for w in inner.lower().split()) >= 1 and inner.count(" ") >= 3 or len(para) and para[-1][0] == "\x00":
                s = line = "\x00" + inner if inner else ""
        if s.startswith(("```", "~~~")):
            running += flush()
            fence = not fence
        elif not s:
            running += flush()
        elif fence:
            continue
        elif m := BULLET.match(line):
            running += flush()
            entry = line[m.end() :]
            shown = _visible(s)
            if not _looks_like_row(entry) and _is_running(entry, shown, True):
                running += shown
        elif HEADING.match(s) or _looks_like_row(s):
            running += flush()
        else:
            if SPEAKER.match(line):
                running += flush()
            para.append(s)
    running += flush()
    return running, _visible(text)


#: Bits of a character: 1 letter or digit, 2 digit, 4 upper case, 8 white space, 16 Chinese character.
_BITS = np.array([c.isalnum() + 2 * c.isdigit() + 4 * c.isupper() + 8 * c.isspace() + 16 * bool(CJK.match(c)) for c in map(chr, range(0x10000))], dtype=np.uint8)


def text_statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of one text in the order of STATISTICS; an empty or null text has 0 everywhere."""
    text = text or ""
    lines = [x for x in (x.strip() for x in text.splitlines()) if x]
    if not lines:
        return (0.0,) * len(STATISTICS)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(_BITS[np.minimum(points, 0xFFFF)], minlength=32)
    having = lambda bit: int(kinds[(np.arange(32) & bit) > 0].sum())
    alnum, digit, upper, space, cjk = map(having, (1, 2, 4, 8, 16))
    shown = len(text) - space
    words = WORD.findall(text)
    letters = sum(map(len, words))
    if cjk < 0.3 * shown:
        common = sum(w in COMMON for w in LOWER_WORD.findall(text.lower())) / max(1, len(words))
    else:
        common = len(CJK_COMMON.findall(text)) / cjk
    running, total = running_parts(text)
    return (
        float(len(words)),
        letters / max(1, len(words)),
        1 - alnum / shown,
        digit / shown,
        upper / shown,
        sum(x[-1] in END for x in lines) / len(lines),
        common,
        sum(map(len, lines)) / len(lines),
        1 - len(set(lines)) / len(lines),
        running / max(1, total),
    )


def quality_statistics(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, the STATISTICS): one row per row of the table; a null language counts as ``und``, null ids are left out.

    Texts are read whole. Equal rows give equal rows.
    """

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = np.array([text_statistics(t) for t in pdf["text"]], dtype=np.float64).reshape(len(pdf), len(STATISTICS))
            yield pd.DataFrame({"id": pdf["id"], "lang": pdf["lang"], **{s: values[:, k] for k, s in enumerate(STATISTICS)}})

    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return src.mapInPandas(compute, "id bigint, lang string, " + ", ".join(f"{s} double" for s in STATISTICS))


def value_tails(stats: DataFrame) -> DataFrame:
    """(lang, stat, value, low, high, tail): the empirical probabilities of a value as low, as high and as far out as each distinct one of each statistic and language.

    Exact: distinct values with counts are sorted by range; each partition adds up its counts, and the sums
    of the partitions before are added as offsets. Equal values share one rank, however many there are.
    """
    long = _long(stats, "lang")
    counts = long.groupBy("stat", "lang", "value").count()
    ordered = materialise(counts.repartitionByRange("stat", "lang", "value").sortWithinPartitions("stat", "lang", "value").withColumn("part", F.spark_partition_id()))
    totals = ordered.groupBy("stat", "lang", "part").agg(F.sum("count").alias("n"))
    w = Window.partitionBy("stat", "lang")
    offsets = totals.select("stat", "lang", "part", (F.sum("n").over(w.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("all"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carried = None, 0
        for pdf in batches:
            pdf = pdf.copy()
            # Sums within the groups of the batch; the first group goes on from the batch before.
            group = (pdf["stat"] != pdf["stat"].shift()) | (pdf["lang"] != pdf["lang"].shift())
            local = pdf["count"].groupby(group.cumsum()).cumsum()
            if len(pdf) and (pdf["stat"].iat[0], pdf["lang"].iat[0]) == last:
                local = local + np.where(group.cumsum() == 1, carried, 0)
            pdf["upto"] = local
            if len(pdf):
                last, carried = (pdf["stat"].iat[-1], pdf["lang"].iat[-1]), int(local.iat[-1])
            yield pdf

    summed = ordered.mapInPandas(add_up, "stat string, lang string, value double, count bigint, part int, upto bigint")
    both = summed.join(offsets, ["stat", "lang", "part"])
    low, high = (F.col("before") + F.col("upto")) / F.col("all"), (F.col("all") - F.col("before") - F.col("upto") + F.col("count")) / F.col("all")
    tail = F.least(F.lit(1.0), 2 * F.least(low, high))
    return both.select("lang", "stat", "value", low.alias("low"), high.alias("high"), tail.alias("tail"))


def _long(stats: DataFrame, *keep: str) -> DataFrame:
    """(the columns to keep, stat, value): a row for each statistic."""
    return stats.select(*keep, F.explode(F.map_from_arrays(F.array(*(F.lit(s) for s in STATISTICS)), F.array(*(F.round(F.col(s), 12) for s in STATISTICS)))).alias("stat", "value"))


def outlier_scores(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """quality_statistics with ``outlier_score`` and ``junk_lean``.

    The score is the mean over the statistics of -ln(two-sided tail probability): how unusual a text is for its
    language. The lean is the mean over JUNK_SIDE of ln(tail towards prose / tail towards junk): on which side it
    is unusual. An empty table gives no rows; within a language of one row every tail is 1, score and lean are 0.
    """
    stats = materialise(quality_statistics(df, id_col, text_col, lang_col).withColumn("row", F.monotonically_increasing_id()))
    tails = value_tails(stats)
    side = F.create_map(*(F.lit(x) for s in JUNK_SIDE.items() for x in s))[F.col("stat")]
    lean = F.coalesce(side * (F.log("low") - F.log("high")), F.lit(0.0))
    parts = _long(stats, "row", "lang").join(tails, ["lang", "stat", "value"])
    scores = parts.groupBy("row").agg((F.sum(-F.log("tail")) / len(STATISTICS)).alias("outlier_score"), (F.sum(lean) / len(JUNK_SIDE)).alias("junk_lean"))
    return stats.join(scores, "row").drop("row")


def unnatural(scores: DataFrame, share: float = 0.5, doubt: float = 0.1) -> DataFrame:
    """The rows of :func:`outlier_scores` of texts less than ``share`` of which stands in running sentences.

    Where running_share is off the bar by ``doubt`` or more, it decides. Nearer to the bar the lean decides: a
    text is found if its lean is nearer to the mean lean of the certain junk than to that of the certain prose of
    its language, the means being taken over all rows. A language without both has no such means; there
    running_share decides throughout.
    """
    scores = materialise(scores)
    far = F.col("running_share") - share
    means = scores.groupBy("lang").agg(F.avg(F.when(far <= -doubt, F.col("junk_lean"))).alias("junk"), F.avg(F.when(far >= doubt, F.col("junk_lean"))).alias("prose"))
    nearer = (F.col("junk_lean") - (F.col("junk") + F.col("prose")) / 2) * (F.col("junk") - F.col("prose")) > 0
    found = F.when(F.abs(far) >= doubt, far < 0).otherwise(F.coalesce(nearer, far < 0))
    return scores.join(means, "lang").where(found).drop("junk", "prose")
