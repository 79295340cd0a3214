"""Change sets on features: remove, add or replace, update, in this order; and the tiles that they touch.

Tables are keyed by id (canonical JSON, so 1 and "1" differ). Rows that change move to the end in the order of the change set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import TileOptions
from ..storage import small_or_not, stored


def last_per_id(changes: DataFrame, order: str = "seq") -> DataFrame:
    """The last change for each id wins: all its rows, if several have the same order."""
    rank = F.rank().over(Window.partitionBy("id").orderBy(F.col(order).desc()))
    return changes.withColumn("rank", rank).where("rank = 1").drop("rank")


def apply_changes(source: DataFrame, remove: DataFrame | None = None, add: DataFrame | None = None, update: DataFrame | None = None, remove_all: bool = False, repeated: bool = True, last: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, affected): tables with the columns of source.

    remove: id. add: features; where ids aren't repeated, all rows of an id are one feature. update: features with seq, whose values, where not null, replace those of all features of that id; ids that are not there are ignored.
    """
    # One number that all others follow: by default the last of source.
    if last is None:
        last = (source.agg(F.max("seq")).first()[0] or 0) if add is not None or update is not None else 0
    affected = source if remove_all else source.limit(0)
    source = source.limit(0) if remove_all else source
    add = last_per_id(add) if add is not None and repeated else add
    gone = remove.select("id") if remove is not None else None
    if add is not None:
        gone = add.select("id") if gone is None else gone.union(add.select("id"))
    if gone is not None:
        gone = small_or_not(gone.where("id is not null").distinct())
        affected = affected.unionByName(source.join(gone, "id", "left_semi"))
        source = source.join(gone, "id", "left_anti")
    if add is not None:
        added = add.withColumn("seq", F.lit(last + 1) + F.col("seq"))
        source, affected = source.unionByName(added), affected.unionByName(added)
    if update is not None:
        patch = small_or_not(last_per_id(update.where("id is not null")))
        values = [c for c in source.columns if c not in ("id", "seq") and c in patch.columns]
        old = source.join(patch.select("id"), "id", "left_semi")
        last += 1 + (add.agg(F.max("seq")).first()[0] or 0) if add is not None else 0
        renamed = patch.select("id", F.col("seq").alias("u_seq"), *[F.col(c).alias(f"u_{c}") for c in values])
        new = old.join(renamed, "id").select("id", (F.lit(last + 1) + F.col("u_seq")).alias("seq"), *[F.coalesce(f"u_{c}", c).alias(c) if c in values else F.col(c) for c in source.columns if c not in ("id", "seq")])
        source = source.join(patch.select("id"), "id", "left_anti").unionByName(new)
        affected = affected.unionByName(old).unionByName(new)
    return source, affected


def update_properties(tags: Column, remove: Column, additions: Column, remove_all: Column) -> Column:
    """Map columns: without the removed keys, with the additions over them; removing all ignores additions."""
    kept = F.map_filter(tags, lambda k, v: ~F.array_contains(remove, k) & ~F.map_contains_key(additions, k))
    return F.when(remove_all, F.map_filter(tags, lambda k, v: F.lit(False))).otherwise(F.map_concat(kept, additions))


def keep_where(source: DataFrame, affected: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(source, affected) without features whose id has a row that isn't good; rows without id stay."""
    bad = small_or_not(source.where(F.col("id").isNotNull() & ~good).select("id").distinct())
    return source.join(bad, "id", "left_anti"), affected.unionByName(source.join(bad, "id", "left_semi"))


def _reached(lo: str, hi: str, margin: float) -> tuple[Column, Column]:
    """First and last tile of one axis, at zoom z, whose buffered half-open span an extent reaches: (t - margin) <= hi and lo < (t + 1 + margin), as these are rounded."""
    low, high = F.col(lo) * F.pow(F.lit(2.0), "z"), F.col(hi) * F.pow(F.lit(2.0), "z")
    first, last = F.floor(low - margin), F.floor(high + margin)
    first = F.when(first + margin > low, first - 1).when(first + 1 + margin > low, first).otherwise(first + 1)
    last = F.when(last + 1 - margin <= high, last + 1).when(last - margin <= high, last).otherwise(last - 1)
    return F.greatest(F.lit(0).cast("long"), first), F.least(F.pow(F.lit(2.0), "z").cast("long") - 1, last)


def invalidated_tiles(tiles: DataFrame, affected: DataFrame, options: TileOptions = TileOptions()) -> DataFrame:
    """The tiles (z, x, y) whose buffered box a feature of affected reaches.

    Bounds become the range of tiles that they reach at each zoom in use; equal ranges are one, with map-side sums, so that many features in few tiles are few rows. Each range is
    spread over its cells for an equi-join that never gathers them on the driver: tiles where these are few; ranges over many tiles of a zoom stop at the coarsest zoom where they
    cover at most 64 and are joined by their ancestors there.
    """
    m = options.margin
    zooms = tiles.select("z").distinct()
    levels = F.explode(F.sequence(F.lit(0), F.lit(24))).alias("z")
    every = affected.select("min_x", "min_y", "max_x", "max_y", levels).join(F.broadcast(zooms), "z", "left_semi")
    (x0, x1), (y0, y1) = _reached("min_x", "max_x", m), _reached("min_y", "max_y", m)
    every = every.select("z", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")).where("x0 <= x1 and y0 <= y1").distinct()
    every = stored(every.withColumn("up", F.greatest(F.lit(0), F.ceil(F.log2((F.greatest(F.expr("x1 - x0"), F.expr("y1 - y0")) + 1) / 8))).cast("int")), "ranges")
    cell = lambda c: F.explode(F.sequence(F.expr(f"shiftright({c}0, up)"), F.expr(f"shiftright({c}1, up)")))
    cells = every.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    ups = every.select(F.col("z").alias("uz"), F.col("up").alias("u")).distinct()
    keyed = tiles.join(F.broadcast(ups), F.col("z") == F.col("uz")).withColumn("tx", F.expr("shiftright(cast(x as bigint), u)")).withColumn("ty", F.expr("shiftright(cast(y as bigint), u)"))
    hit = (keyed["z"] == cells["z"]) & (keyed["u"] == cells["up"]) & (keyed["tx"] == cells["cx"]) & (keyed["ty"] == cells["cy"])
    hit = hit & keyed["x"].between(cells["x0"], cells["x1"]) & keyed["y"].between(cells["y0"], cells["y1"])
    return keyed.join(cells.hint("merge"), hit, "left_semi").select("z", "x", "y").distinct()
