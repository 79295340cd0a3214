"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Sizes are summed by source and hash bucket; the budget of a source falls into one bucket of a cumulative sum over at most
1,024 buckets; only that bucket is split by the next ten hash bits, and so on, which nests thresholds until one cell of 40 bits is left.
The documents are then filtered by comparing their hash with their source's threshold: they are never sorted.

Defined results: a null text has size 0; a null source is a source of its own, last in order; repeated rows (equal
doc_id, source and text) share a hash and are taken together; an empty table gives an empty table; columns beside
doc_id, text and source do not matter and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, small_or_not, stored

BITS, LEVELS, ROUNDS, SEED = 10, 4, 3, 20_177


def _hash(text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("source"), text)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size): the whole is shared by weight, no target above cap times its source.

    Water filling: in order of cap * size / weight, the first source that the level of the rest doesn't lift over its cap sets the level.
    One row for each source goes through the windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank)).withColumn("full", cap * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("w").over(after)
    bound = F.col("full") / F.col("w")
    per = per.withColumn("here", F.when(level <= bound, F.struct(bound.alias("bound"), level.alias("level")))).withColumn("level", F.min("here").over(everything)["level"])
    return per.select("source", "source_size", F.coalesce(F.least(F.col("full"), F.col("w") * F.col("level")), F.col("full")).alias("target"))


def _refined(slim: DataFrame, need: DataFrame) -> DataFrame:
    """(s, threshold, left, edge): for each row (source, rest) of need the 40-bit threshold below which the rows of slim (source, size, h) sum to at most rest, what they leave of it, and the size of the cell at the threshold."""
    state = need.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix")).where("rest > 0")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level - 1)
        inside = slim.join(small_or_not(state), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        histogram = inside.groupBy("s", "prefix", F.shiftright("h", shift).alias("cell")).agg(F.sum("size").alias("in_cell"), F.first("rest").alias("rest"))
        order = Window.partitionBy("s").orderBy("cell")
        sums = histogram.withColumn("upto", F.sum("in_cell").over(order))
        # The boundary cell is the first whose sum is over the budget; where there is none, all rows are below the threshold.
        over = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("cell", (F.col("rest") - F.col("upto") + F.col("in_cell")).alias("left"), "in_cell")))
        found = sums.groupBy(F.col("s").alias("f")).agg(over.alias("b"), F.max("upto").alias("all"), F.max("cell").alias("last"))
        joined = state.join(found, F.col("s").eqNullSafe(F.col("f")), "left")
        cell = F.coalesce("b.cell", F.col("last") + 1, F.shiftleft("prefix", BITS))
        state = stored(joined.select("s", F.coalesce("b.left", F.col("rest") - F.coalesce("all", F.lit(0))).alias("rest"), cell.alias("prefix"), F.col("b.in_cell").alias("edge")), "mix-level")
    return state.select("s", F.col("prefix").alias("threshold"), F.col("rest").alias("left"), "edge")


def thresholds(slim: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target, copies, rests, cuts) from (source, size, h): see extra().

    A budget is met up to the size of the document at its threshold. What is left goes to another round over the documents that are not
    taken and fit into it four times, with other hash bits, so that the remainder shrinks from round to round. If at last more is left than
    half of what lies at the first threshold, that is taken too.
    """
    per = source_targets(slim, weights, cap)
    size, target = F.col("source_size"), F.col("target")
    copies = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    none = F.array().cast
    per = per.withColumn("copies", copies).withColumn("rest", target - F.col("copies") * size).withColumn("rests", none("array<double>")).withColumn("cuts", none("array<bigint>")).withColumn("edge", F.lit(None).cast("long"))
    state = stored(per, "mix-targets")
    for number in range(ROUNDS):
        rows = slim
        if number:
            sources = small_or_not(state.select(F.col("source").alias("s"), "rests", "cuts", (F.col("rest") / 4).alias("fits")))
            rows = slim.join(sources, F.col("source").eqNullSafe(F.col("s"))).where(~extra() & (F.col("size") <= F.col("fits"))).select("source", "size", "h")
        found = _refined(rows.withColumn("h", _round_hash(number)), state.select("source", "rest")).withColumnRenamed("s", "f").withColumnRenamed("edge", "at_cut")
        joined = state.join(found, F.col("source").eqNullSafe(F.col("f")), "left")
        fits = F.col("rest") / 4 if number else F.lit(float("inf"))
        state = stored(joined.select("source", "source_size", "target", "copies", F.coalesce("left", "rest").alias("rest"), F.concat("rests", F.array(fits)).alias("rests"), F.concat("cuts", F.array(F.coalesce("threshold", F.lit(0)))).alias("cuts"), F.coalesce("edge", F.lit(None) if number else F.col("at_cut")).alias("edge")), "mix-round")
    cuts = F.transform("cuts", lambda cut, i: F.when((i == 0) & (F.col("edge") < 2 * F.col("rest")), cut + 1).otherwise(cut))
    return state.select("source", "source_size", "target", "copies", "rests", cuts.alias("cuts"))


def _round_hash(number) -> Column:
    return F.shiftrightunsigned(F.xxhash64("h", F.lit(number)), 64 - BITS * LEVELS)


def extra() -> Column:
    """Whether a row (size, h) with its source's rests and cuts is taken once more: in some round it fits and its hash is below the threshold."""
    rounds = F.zip_with("rests", "cuts", lambda rest, cut: F.struct(rest.alias("rest"), cut.alias("cut")))
    return F.exists(F.transform(rounds, lambda x, i: (F.col("size") <= x["rest"]) & (F.shiftrightunsigned(F.xxhash64("h", i), 64 - BITS * LEVELS) < x["cut"])), lambda x: x)


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with h, size and source, joined with their source's row of cuts; n: how often each is taken."""
    cuts = small_or_not(cuts).withColumnRenamed("source", "s")
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("n", F.col("copies") + F.when(extra(), 1).otherwise(0))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs (doc_id, text, source)."""
    slim = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash(F.col("text")).alias("h")), "mix-sizes")
    return _taken(slim, thresholds(slim, weights, cap)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The rows of docs, each as often as the mixture takes it, with the columns of docs."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, "source", word_count(F.col("text")).alias("size"), _hash(F.col("text")).alias("h"))
    cuts = thresholds(stored(rows.select("source", "size", "h"), "mix-sizes"), weights, cap)
    return _taken(rows, cuts).where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).select("row.*")
