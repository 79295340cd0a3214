"""The tile pyramid: features to tile features, counters, tiles that exist, single tiles.

Everything about one feature is narrow; only counters shuffle, with map-side sums. Tile features stay rows, as zoom 0 holds every feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import Shape, bands_of, clip, point_quadtree, quadtree, quantised, tile_lines, world_copies
from ..functions.projection import project_x, project_y, quantise, tiles_of
from ..options import TileOptions
from ..sources.geojson import ARROW, FEATURES, row_shape, shape_row, to_geojson
from ..storage import BROADCAST_ROWS, partitions, small_or_not, stored
from .changes import apply_changes, invalidated_tiles, keep_where, last_per_id, update_properties
from .clusters import dense_index

_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
_TILE = pa.schema([("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("seq", pa.int64()), ("part", pa.int32()), ("type", pa.int32()), ("id", pa.string()), ("tags", pa.string()), ("clip_start", pa.float64()), ("clip_end", pa.float64()), ("geometry", _RINGS), ("points", pa.int64()), ("simplified", pa.int64()), *((k, pa.float64()) for k in ("min_x", "min_y", "max_x", "max_y"))])
#: Rows that a task holds before it gives them out.
FLUSH = 2000
TILE_FEATURES = "z int, x int, y int, seq long, part int, type int, id string, tags string, clip_start double, clip_end double, geometry array<array<struct<x:int,y:int>>>, points long, simplified long, min_x double, min_y double, max_x double, max_y double"


def wrap(features: DataFrame, options: TileOptions = TileOptions()) -> DataFrame:
    """Features with their copies from neighbouring worlds. If no feature reaches an edge band, all stay as they are, unclipped. Single points are copied by column expressions."""
    margin, metrics = options.margin, options.line_metrics
    features = stored(features, "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ARROW.append(pa.field("world", pa.int32()))
        for batch in batches:
            rows = [{**r, "world": k, **shape_row(s)} for r in batch.to_pylist() for k, s in world_copies(row_shape(r), margin, metrics)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    worlds = F.array(*[F.struct(F.lit(k).alias("world"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(by).alias("by")) for k, lo, hi, by in bands_of(margin)])
    points = features.where("kind = 'Point'").withColumn("b", F.explode(F.filter(worlds, lambda w: (F.col("min_x") >= w["lo"]) & (F.col("min_x") < w["hi"]))))
    moved = F.transform("paths", lambda p: p.withField("xyz", F.transform(p["xyz"], lambda v, i: F.when(i % 3 == 0, v + F.col("b.by")).otherwise(v))))
    at = {"paths": F.when(F.col("b.by") == 0, F.col("paths")).otherwise(moved), "min_x": F.col("min_x") + F.col("b.by"), "max_x": F.col("max_x") + F.col("b.by")}
    points = points.select(*[at.get(c, F.col(c)).alias(c) for c in features.columns], "b.world")
    others = features.where("kind <> 'Point'").mapInArrow(run, f"{FEATURES}, world int")
    copies = stored(points.select(*others.columns).unionByName(others), "worlds")
    if copies.where("world <> 1").isEmpty():
        return features
    # Left copies come first, then the centre, then right copies, each in source order.
    return copies.withColumn("seq", F.col("world").cast("long") * F.lit(1 << 61) + F.col("seq")).drop("world")


def _row(shape: Shape, z: int, x: int, y: int, options: TileOptions) -> dict:
    start = stop = None
    if shape.is_point:
        points = shape.paths[0].points
        geometry, count, kept, kind = [points], len(points), len(points), 1
    else:
        geometry, count, kept = tile_lines(shape, options.tolerance_at(z))
        kind = 3 if shape.is_ring else 2
        if options.line_metrics and shape.kind == "LineString":
            p = shape.paths[0]
            start, stop = (p.start / p.size, p.stop / p.size) if p.size else (None, None)
    lines = [[{"x": a, "y": b} for a, b in quantised(line, z, x, y, options.extent)] for line in geometry]
    bounds = dict(zip(("min_x", "min_y", "max_x", "max_y"), shape.bounds(), strict=True))
    return {"z": z, "x": x, "y": y, "type": kind, "clip_start": start, "clip_end": stop, "geometry": lines, "points": count, "simplified": kept, **bounds}


def _point_rows(rows: list[tuple], extent: int) -> pa.RecordBatch:
    """Tile rows of single points (z, x, y, seq, id, tags, px, py), column by column."""
    z, x, y, seq, ids, tags, px, py = map(list, zip(*rows, strict=True))
    n, scale, ones = len(z), np.exp2(np.array(z)), pa.array(np.ones(len(z), dtype="int64"))
    at = [pa.array(np.floor(extent * (np.array(v) * scale - np.array(t)) + 0.5).astype("int32")) for v, t in ((px, x), (py, y))]
    steps = pa.array(np.arange(n + 1, dtype="int32"))
    geometry = pa.ListArray.from_arrays(steps, pa.ListArray.from_arrays(steps, pa.StructArray.from_arrays(at, names=["x", "y"])))
    none, bounds = pa.nulls(n, pa.float64()), [pa.array(px, pa.float64()), pa.array(py, pa.float64())]
    columns = [*(pa.array(v, pa.int32()) for v in (z, x, y)), pa.array(seq, pa.int64()), pa.array(np.zeros(n, dtype="int32")), pa.array(np.ones(n, dtype="int32")), pa.array(ids, pa.string()), pa.array(tags, pa.string()), none, none, geometry.cast(_RINGS), ones, ones, *bounds, *bounds]
    return pa.RecordBatch.from_arrays(columns, schema=_TILE)


def _tile_rows(features: DataFrame, options: TileOptions, last: int, wanted=None, levels: frozenset[int] | None = None) -> DataFrame:
    """Tile features by the quadtree of each feature, given out in batches of FLUSH rows, however many a single feature makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        points: list[tuple] = []
        for batch in batches:
            lone = pc.equal(batch.column("kind"), "Point")
            for r in zip(*(batch.filter(lone).column(c).to_pylist() for c in ("seq", "id", "tags", "min_x", "min_y")), strict=True):
                points += [(*t, *r) for t in point_quadtree(r[3], r[4], options.margin, last, wanted) if levels is None or t[0] in levels]
                if len(points) >= FLUSH:
                    yield _point_rows(points, options.extent)
                    points = []
            for r in batch.filter(pc.invert(lone)).to_pylist():
                for z, x, y, held in quadtree([row_shape(r)], options.margin, options.line_metrics, last, wanted):
                    if levels is None or z in levels:
                        rows += [{"seq": r["seq"], "part": k, "id": r["id"], "tags": r["tags"], **_row(s, z, x, y, options)} for k, s in enumerate(held)]
                    if len(rows) >= FLUSH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_TILE)
                        rows = []
        if points:
            yield _point_rows(points, options.extent)
        yield pa.RecordBatch.from_pylist(rows, schema=_TILE)

    return features.mapInArrow(run, TILE_FEATURES)


def _last_zoom(options: TileOptions, max_zoom: int | None) -> int:
    return min(options.max_zoom, options.index_max_zoom if max_zoom is None else max_zoom)


def tile_features(features: DataFrame, options: TileOptions = TileOptions(), max_zoom: int | None = None, only: frozenset | None = None) -> DataFrame:
    """A row for each feature and tile that holds something of it, down to max_zoom; with `only`, a set of tiles (z, x, y) with their ancestors, in these alone.

    A row whose geometry is empty was simplified away: it counts in the tile but isn't a feature of it.
    """
    return _tile_rows(features, options, _last_zoom(options, max_zoom), None if only is None else lambda z, x, y: (z, x, y) in only)


def drill_down(features: DataFrame, target: tuple[int, int, int], options: TileOptions = TileOptions()) -> DataFrame:
    """Rows of a target tile and of its parent, by the way from the root to it: subtrees off the way are not cut, and features that don't reach it or its parent are not read."""
    tz, tx, ty = target
    z, x, y = (tz - 1, tx >> 1, ty >> 1) if tz else target  # the parent decides whether the tile is there
    scale, m = float(1 << z), options.margin
    near = (F.col("max_x") >= (x - m) / scale) & (F.col("min_x") <= (x + 1 + m) / scale) & (F.col("max_y") >= (y - m) / scale) & (F.col("min_y") <= (y + 1 + m) / scale)
    wanted = lambda z, x, y: (tx >> (tz - z), ty >> (tz - z)) == (x, y)
    return _tile_rows(features.where(near) if z else features, options, min(options.max_zoom, tz), wanted, frozenset((z, tz)))


def point_features(points: DataFrame, options: TileOptions = TileOptions(), max_zoom: int | None = None) -> DataFrame:
    """tile_features() of features that are single points, by column expressions alone. The root holds all of them, wherever they are."""
    rows = points.withColumn("px", F.col("paths")[0]["xyz"][0]).withColumn("py", F.col("paths")[0]["xyz"][1])
    m, out = options.margin, None
    for z in range(_last_zoom(options, max_zoom) + 1):
        every = F.array(F.lit(0))
        one = rows.withColumn("z", F.lit(z)).withColumn("x", F.explode(tiles_of(F.col("px"), z, m) if z else every)).withColumn("y", F.explode(tiles_of(F.col("py"), z, m) if z else every))
        out = one if out is None else out.unionByName(one)
    return _point_tiles(out, options)


def _point_tiles(out: DataFrame, options: TileOptions) -> DataFrame:
    """Rows of TILE_FEATURES of single points (px, py), each with its tile."""
    n = options.extent
    vertex = F.struct(quantise(F.col("px"), F.col("z"), F.col("x"), n).alias("x"), quantise(F.col("py"), F.col("z"), F.col("y"), n).alias("y"))
    none, one = F.lit(None).cast("double"), F.lit(1).cast("long")
    return out.select("z", "x", "y", "seq", F.lit(0).alias("part"), F.lit(1).alias("type"), "id", "tags", none.alias("clip_start"), none.alias("clip_end"), F.array(F.array(vertex)).alias("geometry"), one.alias("points"), one.alias("simplified"), "min_x", "min_y", "max_x", "max_y")


def single_tile(features: DataFrame, z: int, x: int, y: int, options: TileOptions = TileOptions()) -> DataFrame:
    """One tile without a pyramid: wrapped and clipped only on demand, though always clipped where line metrics are on. Never null."""
    rows = wrap(features, options) if options.wrap else features
    margin, scale, clipped = options.margin, float(1 << z) if z >= 0 else 2.0**z, options.clip or options.line_metrics

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                held = [row_shape(r)]
                if clipped:
                    held = [s for h in held for s in clip(h, (x - margin) / scale, (x + 1 + margin) / scale, 0, options.line_metrics)]
                    held = [s for h in held for s in clip(h, (y - margin) / scale, (y + 1 + margin) / scale, 1, options.line_metrics)]
                out += [{"seq": r["seq"], "part": k, "id": r["id"], "tags": r["tags"], **_row(s, z, x, y, options)} for k, s in enumerate(held)]
            yield pa.RecordBatch.from_pylist(out, schema=_TILE)

    # Single points are in the tile or not, by column expressions alone.
    points, within = rows.where("kind = 'Point'"), lambda c, t: (F.col(c) >= (t - margin) / scale) & (F.col(c) < (t + 1 + margin) / scale)
    points = (points.where(within("min_x", x) & within("min_y", y)) if clipped else points).select("*", *[F.lit(v).alias(c) for c, v in (("z", z), ("x", x), ("y", y))])
    others = rows.where("kind <> 'Point'").mapInArrow(run, TILE_FEATURES).where(F.size("geometry") > 0)
    return _point_tiles(points.withColumn("px", F.col("min_x")).withColumn("py", F.col("min_y")), options).unionByName(others)


def point_tile_features(points: DataFrame, options: TileOptions, zooms: list[int]) -> DataFrame:
    """Quantised tile features of lone points (id, lon, lat) by column expressions alone."""
    rows = points.withColumn("px", project_x(F.col("lon"))).withColumn("py", project_y(F.col("lat")))
    levels = [rows.withColumn("z", F.lit(z)).withColumn("x", F.explode(tiles_of(F.col("px"), z, options.margin))).withColumn("y", F.explode(tiles_of(F.col("py"), z, options.margin))) for z in zooms]
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.withColumn("tx", quantise(F.col("px"), F.col("z"), F.col("x"), options.extent)).withColumn("ty", quantise(F.col("py"), F.col("z"), F.col("y"), options.extent))


def tile_counters(rows: DataFrame) -> DataFrame:
    """Bounds and counters of each tile that holds something; num_features counts features before simplification."""
    sums = [F.count("*").alias("num_features"), F.sum("points").alias("num_points"), F.sum("simplified").alias("num_simplified"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")]
    return rows.groupBy("z", "x", "y").agg(*sums)


def eager_tiles(counters: DataFrame, options: TileOptions = TileOptions()) -> DataFrame:
    """The tiles of counters that an eager index makes: those whose ancestors all have more than index_max_points points. counters are read twice."""
    key = ["z", "x", "y"]
    above = "explode(transform(sequence(1, z), k -> struct(cast(z - k as int) as oz, cast(shiftright(x, k) as int) as ox, cast(shiftright(y, k) as int) as oy))) as o"
    open_ = counters.where(F.col("num_points") > options.index_max_points).select(*[F.col(c).cast("int").alias(f"o{c}") for c in key])
    below = counters.where(F.col("z").between(1, options.index_max_zoom)).selectExpr(*key, above).select(*key, "o.*")
    full = below.join(open_, ["oz", "ox", "oy"]).groupBy(*key).agg(F.count("*").alias("ancestors")).where("ancestors = z").select(*key)
    return counters.join(counters.where("z = 0").select(*key).unionByName(full), key, "left_semi")


def existing_tiles(counters: DataFrame, max_zoom: int) -> DataFrame:
    """z, x, y, empty: the root, and all four children of each tile that holds something, down to max_zoom. Other tiles are null."""
    full = counters.where("num_features > 0").select("z", "x", "y")
    child = F.explode(F.array(*[F.struct((F.col("z") + 1).alias("z"), (2 * F.col("x") + i).alias("x"), (2 * F.col("y") + j).alias("y")) for i in (0, 1) for j in (0, 1)])).alias("c")
    made = full.where("z = 0").unionByName(full.where(F.col("z") < max_zoom).select(child).select("c.*"))
    return made.join(full.withColumn("held", F.lit(True)), ["z", "x", "y"], "left").select("z", "x", "y", F.col("held").isNull().alias("empty"))


def _renumbered(features: DataFrame) -> DataFrame:
    """features with seq from 0 on, in the same order, so that later rows can follow."""
    rows = dense_index(features, "seq")
    return rows.select(*[(F.col("idx") if c == "seq" else F.col(c)).alias(c) for c in features.columns])


#: Columns of a change of properties, with JSON texts as new values.
PATCH = {"remove_all_properties": "boolean", "remove_properties": "array<string>", "set_properties": "map<string,string>"}


def patched_tags(tags: Column) -> Column:
    """tags (JSON) with the changes of the columns of PATCH; as they are where there is none."""
    every, gone, new = F.coalesce("remove_all_properties", F.lit(False)), F.coalesce("remove_properties", F.array().cast("array<string>")), F.coalesce("set_properties", F.create_map().cast("map<string,string>"))
    held = F.from_json(F.coalesce(tags, F.lit("{}")), "map<string,variant>")
    changed = F.to_json(update_properties(held, gone, F.transform_values(new, lambda _, v: F.parse_json(v)), every))
    return F.when(every | (F.size(gone) > 0) | (F.size(new) > 0), changed).otherwise(tags)


def feature_json(rows: DataFrame, prefix: str = "") -> DataFrame:
    """(z, x, y, seq, part, value): tile features in JSON form: type, geometry (points of a point feature, lines or rings of others), tags and id.

    A line with metrics has the part of it that its slice covers as tags <prefix>clip_start and <prefix>clip_end.
    """
    vertex = lambda v: F.concat(F.lit("["), v["x"].cast("string"), F.lit(","), v["y"].cast("string"), F.lit("]"))
    lines = F.transform("geometry", lambda line: F.concat(F.lit("["), F.array_join(F.transform(line, vertex), ","), F.lit("]")))
    geometry = F.when(F.col("type") == 1, lines[0]).otherwise(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")))
    own = F.from_json(F.coalesce("tags", F.lit("{}")), "map<string,variant>")
    number = lambda c: F.parse_json(F.col(c).cast("string"))
    measured = update_properties(own, F.array().cast("array<string>"), F.create_map(F.lit(f"{prefix}clip_start"), number("clip_start"), F.lit(f"{prefix}clip_end"), number("clip_end")), F.lit(False))
    tags = F.when(F.col("clip_start").isNull(), F.coalesce("tags", F.lit("null"))).otherwise(F.to_json(measured))
    key = F.when(F.col("id").isNotNull(), F.concat(F.lit(',"id":'), "id")).otherwise(F.lit(""))
    value = F.concat(F.lit('{"type":'), F.col("type").cast("string"), F.lit(',"geometry":'), geometry, F.lit(',"tags":'), tags, key, F.lit("}"))
    return rows.where(F.size("geometry") > 0).select("z", "x", "y", "seq", "part", value.alias("value"))


def write_tiles(rows: DataFrame, folder: str) -> None:
    """Tile features as JSON lines under z=<zoom>/, those of a tile together and in order. A tile is many rows, so that none has to be held whole."""
    parts = partitions(rows.sparkSession, rows)
    feature_json(rows).repartitionByRange(parts, "z", "x", "y", "seq", "part").sortWithinPartitions("z", "x", "y", "seq", "part").write.partitionBy("z").json(folder)


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """(z, x, y, seq, part, value) as write_tiles() wrote it."""
    return spark.read.schema("x int, y int, seq long, part int, value string, z int").json(folder).select("z", "x", "y", "seq", "part", "value")


class TileEngine:
    """A pyramid over features: tiles on request, the eager index, and updates."""

    def __init__(self, features: DataFrame, options: TileOptions = TileOptions()):
        self.options = options
        self.source = stored(wrap(features, options), "source")

    def tiles(self, max_zoom: int | None = None) -> DataFrame:
        """Tile features of all tiles down to max_zoom: of single points by column expressions, of others by their quadtrees."""
        points, others = self.source.where("kind = 'Point'"), self.source.where("kind <> 'Point'")
        return point_features(points, self.options, max_zoom).unionByName(tile_features(others, self.options, max_zoom))

    def tile_coords(self) -> DataFrame:
        """The tiles of the eager index."""
        return eager_tiles(stored(tile_counters(self.tiles()), "counters"), self.options).select("z", "x", "y")

    def get_tile(self, z: int, x: int, y: int) -> DataFrame | None:
        """The features of a tile in order; None where the tile doesn't exist. x wraps around the world."""
        z, x, y = int(z), int(x), int(y)
        if not 0 <= z <= min(24, self.options.max_zoom):
            return None
        x %= 1 << z
        if not 0 <= y < 1 << z:
            return None
        rows = stored(drill_down(self.source, (z, x, y), self.options), "tile")
        if rows.where(F.col("z") == max(0, z - 1)).isEmpty():
            return None
        return rows.where((F.col("z") == z) & (F.size("geometry") > 0)).orderBy("seq", "part")

    def reindexed(self, tiles: DataFrame, affected: DataFrame, max_zoom: int | None = None) -> DataFrame:
        """The rows of tiles() of this engine from those of the engine before an update: rows of tiles that no affected feature reaches stay, the others are made anew.

        Features descend into the tiles that are made anew alone, where these can be broadcast.
        """
        last = _last_zoom(self.options, max_zoom)
        reached = invalidated_tiles(tiles.select("z", "x", "y").distinct(), affected, self.options)
        reached = stored(reached.unionByName(tile_features(affected, self.options, last).select("z", "x", "y")).distinct(), "reached")
        few = reached.limit(BROADCAST_ROWS + 1).collect()
        only = frozenset(map(tuple, few)) if len(few) <= BROADCAST_ROWS else None
        key = ["z", "x", "y"]
        mark = small_or_not(reached)
        others = tile_features(self.source.where("kind <> 'Point'"), self.options, last, only)
        made = point_features(self.source.where("kind = 'Point'"), self.options, last).unionByName(others)
        return tiles.join(mark, key, "left_anti").unionByName(made.join(mark, key, "left_semi").select(*tiles.columns))

    def get_data(self) -> DataFrame:
        """seq, value: the features as GeoJSON, world copies among them."""
        self._updateable()
        return to_geojson(self.source)

    def update_data(self, remove: DataFrame | None = None, add: DataFrame | None = None, update: DataFrame | None = None, remove_all: bool = False, good: Column | None = None) -> tuple[TileEngine, DataFrame]:
        """(engine over the changed features, affected features): remove all, remove, add or replace, update, then the filter `good`.

        remove: id. add: read_features(..., numbered=True). update: features, the last of each id, for ids that are there; where kind is null only tags change, in all
        copies, and where tags is null they stay. It may have the columns of PATCH beside: keys of the tags that go, keys with new values (JSON), and whether all go, which
        also drops what would be added. What is rewritten moves to the end, new geometries first. This engine stays as it is.
        """
        self._updateable()
        order = lambda df: "feature" if "feature" in df.columns else "seq"
        source = _renumbered(self.source)
        columns = source.columns
        fresh = lambda df: _renumbered(wrap(df.select(*columns), self.options))
        added = fresh(last_per_id(add, order(add))) if add is not None else None
        source, affected = apply_changes(source, remove, added, remove_all=remove_all, repeated=False)
        if update is not None:
            source = stored(source, "changed")
            for name, kind in PATCH.items():
                update = update if name in update.columns else update.withColumn(name, F.lit(None).cast(kind))
            patch = stored(last_per_id(update.where("id is not null"), order(update)).select(*columns, *PATCH), "patch")
            old = source.join(small_or_not(patch.select("id").distinct()), "id", "left_semi").select(*columns)
            first = old.groupBy("id").agg(F.min_by("tags", "seq").alias("own"))
            moved = fresh(patch.where("kind is not null").join(first, "id").withColumn("tags", patched_tags(F.coalesce("tags", "own"))))
            tags = patch.where("kind is null").select("id", F.col("tags").alias("new"), *PATCH)
            tagged = old.join(tags, "id").withColumn("tags", patched_tags(F.coalesce("new", "tags"))).select(*columns)
            new = moved.withColumn("at", F.lit(0)).unionByName(tagged.withColumn("at", F.lit(1)))
            new = dense_index(new, "at", "seq").drop("at", "seq").withColumnRenamed("idx", "seq").select(*columns)
            after = F.lit((source.agg(F.max("seq")).first()[0] or 0) + 1)
            new = stored(new.withColumn("seq", after + F.col("seq")), "rewritten")
            source = source.join(small_or_not(patch.select("id").distinct()), "id", "left_anti").unionByName(new)
            affected = affected.unionByName(old).unionByName(new)
        if good is not None:
            source, affected = keep_where(source, affected, good)
        engine = object.__new__(TileEngine)
        engine.options, engine.source = self.options, stored(source.select(*columns), "source")
        return engine, affected

    def _updateable(self) -> None:
        if not self.options.updateable:
            raise ValueError("the option updateable has to be on")
