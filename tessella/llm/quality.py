"""Quality rules whose thresholds adapt to each language and source.

Every document gets the base figures and four ratios. Mergeable quantile sketches of each ratio (logarithmic histograms with a bounded relative error, Masson et al., "DDSketch", 2019) are
summed by language and source, and the documents are joined with the fences of their group. The upper fence is the quantile TAIL and SPREAD times its distance from the median, so up to a fifth of a group may be junk and not move it; "letters" has
a lower fence too, as far below the quantile 1 - TAIL. To both comes what chance alone does to a document of n words, lines or letters: SAMPLING standard deviations of its ratio, which shrink with the root of n.

A ratio that hardly varies in its group, as one that is zero in four of five documents, has a distance of LEAST, below which the ratio tells nothing about a text of usual length. A group of less than LEAST_DOCS documents uses the merged sketch of its language, and a
language of less that of the corpus. Sketches are exact sums, so reruns agree.

Defined results: a null text has no words and fails; null languages and sources are groups of their own; repeated rows get equal results; an empty table gives
an empty table; other columns stay as they are and do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_or_not, stored

#: Ratio -> the least distance of its quantiles; only "letters" (code points in a word) has a lower fence as well.
LEAST = {"symbols": 0.02, "repeated_lines": 0.05, "capitals": 0.002, "letters": 0.05}
TAIL, SPREAD, SAMPLING, GAMMA, LEAST_DOCS = 0.8, 5.0, 3.0, 1.02, 50
#: Ratio -> the figure that it is a share of.
WHOLE = {"symbols": "n_words", "repeated_lines": "n_lines", "capitals": "word_chars", "letters": "n_words"}
_CAPITALS = regex.compile(r"\p{Lu}+")
SYMBOLS = "#*$%&|<>"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of so many words that occur twice or more, the first ones included."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often, covered, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered, upto = covered + i + width - max(i, upto), i + width
    return covered


def figures(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() knows just the six white-space characters of ASCII
    lines = [x for x in raw.split(b"\n") if x.strip()]
    word_chars = len(text) - (len(raw) - sum(map(len, words)))
    capitals = sum(map(len, _CAPITALS.findall(text)))
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), capitals, len(lines)


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in FIGURES]))
def _figures(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        yield pd.DataFrame([figures(t) for t in texts], columns=list(FIGURES), dtype="int64")


def _whole(name: str, q: str) -> Column:
    return F.greatest(F.col(f"{q}.{WHOLE[name]}"), F.lit(1))


def _ratios(q: str) -> dict[str, Column]:
    part = {"symbols": "n_symbols", "repeated_lines": "n_dup_lines", "capitals": "n_capitals", "letters": "word_chars"}
    return {name: F.col(f"{q}.{figure}") / _whole(name, q) for name, figure in part.items()}


def base_failed(q: str) -> Column:
    return (F.col(f"{q}.n_words") < 10) | (100 * F.col(f"{q}.n_repeat_words") > 20 * F.col(f"{q}.n_words"))


def sketches(measured: DataFrame, q: str = "q") -> DataFrame:
    """(lang, source, ratio, cell, n): the sketch of each ratio over the documents that the base rules keep."""
    cell = lambda x: F.when(x > 0, F.ceil(F.log(x) / F.log(F.lit(GAMMA)))).otherwise(F.lit(-(1 << 30))).cast("int")
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("ratio"), cell(x).alias("cell")) for name, x in _ratios(q).items()])).alias("x")
    return measured.where(~base_failed(q)).select("lang", "source", pairs).groupBy("lang", "source", "x.ratio", "x.cell").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """Merge sketches by these columns: documents, and low, median and high quantile of each ratio."""
    group = Window.partitionBy(*by, "ratio")
    merged = sketch.groupBy(*by, "ratio", "cell").agg(F.sum("n").alias("n"))
    merged = merged.withColumn("upto", F.sum("n").over(group.orderBy("cell"))).withColumn("docs", F.sum("n").over(group))
    value = F.when(F.col("cell") == -(1 << 30), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("cell")) / (GAMMA + 1))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("docs"), F.struct("cell", value.alias("v"))))["v"]
    return merged.groupBy(*by, "ratio").agg(F.struct(F.max("docs").alias("docs"), at(1 - TAIL).alias("low"), at(0.5).alias("mid"), at(TAIL).alias("high")).alias(prefix))


def fences(sketch: DataFrame) -> DataFrame:
    """(g_lang, g_source, low, high, chance): maps from ratio to the bounds of a group, and to what a document of one word, line or letter may be beyond them."""
    own = _quantiles(sketch, ["lang", "source"], "own")
    lang = _quantiles(sketch, ["lang"], "of_lang").select(F.col("lang").alias("l"), F.col("ratio").alias("r"), "of_lang")
    whole = _quantiles(sketch, [], "of_all").select(F.col("ratio").alias("r2"), "of_all")
    rows = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("r"))).join(F.broadcast(whole), F.col("ratio") == F.col("r2"))
    rows = rows.withColumn("s", F.when(F.col("own.docs") >= LEAST_DOCS, F.col("own")).when(F.col("of_lang.docs") >= LEAST_DOCS, F.col("of_lang")).otherwise(F.col("of_all")))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in LEAST.items() for x in kv]), F.col("ratio"))
    letters = F.col("ratio") == "letters"
    high = F.col("s.high") + SPREAD * F.greatest(F.col("s.high") - F.col("s.mid"), least)
    low = F.when(letters, F.col("s.low") - SPREAD * F.greatest(F.col("s.mid") - F.col("s.low"), least)).otherwise(F.lit(float("-inf")))
    # The deviation of one word, line or letter: that of a rare event, or of a word's length, about half of the mean.
    chance = SAMPLING * F.when(letters, F.col("s.mid") / 2).otherwise(F.sqrt(F.greatest("s.high", least)))
    pairs = lambda x: F.map_from_entries(F.collect_list(F.struct("ratio", x)))  # noqa: E731  four entries
    rows = rows.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "ratio", low.alias("lo"), high.alias("hi"), chance.alias("by"))
    return rows.groupBy("g_lang", "g_source").agg(pairs(F.col("lo")).alias("low"), pairs(F.col("hi")).alias("high"), pairs(F.col("by")).alias("chance"))


def _judged(measured: DataFrame, bounds: DataFrame, q: str = "q") -> DataFrame:
    """measured with `failed` (the base rules) and `good` (the verdict)."""
    rows = measured.join(small_or_not(bounds), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    inside = F.lit(True)
    for name, x in _ratios(q).items():
        beyond = F.col("chance")[name] / F.sqrt(_whole(name, q))
        inside = inside & F.coalesce(x.between(F.col("low")[name] - beyond, F.col("high")[name] + beyond), F.lit(True))
    return rows.withColumn("failed", base_failed(q)).withColumn("good", ~F.col("failed") & inside)


def judge_quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row of docs."""
    measured = stored(docs.select("doc_id", "lang", "source", _figures(F.coalesce("text", F.lit(""))).alias("q")), "quality")
    rows = _judged(measured, stored(fences(sketches(measured)), "fences"))
    return rows.select("doc_id", *[f"q.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("failed").alias("base_failed"), F.col("good").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs.

    The texts are measured twice, once for the sketches and once for the filter, so that they are neither shuffled nor stored.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Marked so that no filter is pushed below it with copies of it.
    once = _figures.asNondeterministic()
    measured = docs.select(row, "lang", "source", once(F.coalesce("text", F.lit(""))).alias("q"))
    bounds = stored(fences(sketches(measured.select("lang", "source", "q"))), "fences")
    return _judged(measured, bounds).where("good").select("row.*")
