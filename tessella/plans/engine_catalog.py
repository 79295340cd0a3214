"""Queries of the tile engine, of features that are not points, and of updates, each through its operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Shape, clip
from ..operators import tiles as T
from ..options import TileOptions
from ..sources.geojson import read_features, row_shape, to_geojson
from ..storage import shared_dir, stored
from . import fixtures as X
from .catalog import _BUFFERED, _CLIP, _SEGMENTS, OPTIONS, _box_features, _texts, _track_features, query
from .fixtures import PX, PY, SQL_BOXES, SQL_POINTS, SQL_PROJECTED, SQL_TRACKS

#: pw: the projected events with their copies from neighbouring worlds.
WORLDS = f"{SQL_PROJECTED}, pw AS (SELECT id, lon, lat, event_type, value, px, py FROM pp UNION ALL SELECT id, lon + 360, lat, event_type, value, px + 1, py FROM pp WHERE px < 0.015625 UNION ALL SELECT id, lon - 360, lat, event_type, value, px - 1, py FROM pp WHERE px >= 0.984375)"
_IN_TILES = _BUFFERED.replace("FROM pp p", "FROM pw p")
_AT = "floor(4096 * (px * pow(2, z) - x) + 0.5)::INT AS tx, floor(4096 * (py * pow(2, z) - y) + 0.5)::INT AS ty"
UPDATEABLE = TileOptions(updateable=True)


def _events(spark, sf_dir) -> DataFrame:
    """Events as GeoJSON texts with two properties."""
    rows = X.points(spark, sf_dir)
    point = F.struct(F.lit("Feature").alias("type"), "id", F.struct("event_type", "value").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    return rows.select("id", "lon", "lat", F.to_json(point).alias("value"))


def _engine(spark, sf_dir, options: TileOptions = OPTIONS) -> T.TileEngine:
    return T.TileEngine(read_features(_events(spark, sf_dir), options), options)


def _shapes(features: DataFrame, work: Callable[[Shape], list[tuple]], fields: list[tuple[str, str]]) -> DataFrame:
    """id and the given fields of the rows that a function makes of each shape."""
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([("id", pa.int64()), *((n, kinds[k]) for n, k in fields)])

    def run(batches):
        for batch in batches:
            rows = [(int(r["id"]), *found) for r in batch.to_pylist() for found in work(row_shape(r))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return features.mapInArrow(run, ", ".join(["id long", *(f"{n} {k}" for n, k in fields)]))


@query(f"WITH {WORLDS}, b AS ({_IN_TILES.format(zooms='[0, 1, 2, 3]')}) SELECT z, x, y, count(*) AS num_features, count(*) AS num_points, count(*) AS num_simplified, round(min(px), 9) AS min_x, round(min(py), 9) AS min_y, round(max(px), 9) AS max_x, round(max(py), 9) AS max_y FROM b GROUP BY ALL")
def tile_counters(spark, sf_dir):
    rows = T.tile_counters(_engine(spark, sf_dir).tiles(3))
    return rows.select("z", "x", "y", "num_features", "num_points", "num_simplified", *[F.round(c, 9).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query(f"WITH {WORLDS}, b AS ({_IN_TILES.format(zooms='[0, 1, 2, 3]')}) SELECT z, x, y, id, {_AT} FROM b")
def tile_quadtree_points(spark, sf_dir):
    """Points by the quadtree of each feature, as the engine cuts features that are not points."""
    rows = T.tile_features(_engine(spark, sf_dir).source, OPTIONS, 3)
    return rows.select("z", "x", "y", F.col("id").cast("long").alias("id"), F.col("geometry")[0][0]["x"].alias("tx"), F.col("geometry")[0][0]["y"].alias("ty"))


@query(f"WITH {_SEGMENTS} SELECT count(DISTINCT id) AS num_features, count(*) AS num_points, count(*) AS num_simplified, round(min(px), 9) AS min_x, round(max(py), 9) AS max_y FROM sg")
def line_counters(spark, sf_dir):
    options = TileOptions(tolerance=0)
    rows = T.tile_counters(T.TileEngine(_track_features(spark, sf_dir, options), options).tiles(0))
    return rows.select("num_features", F.col("num_points").cast("long").alias("num_points"), F.col("num_simplified").cast("long").alias("num_simplified"), F.round("min_x", 9).alias("min_x"), F.round("max_y", 9).alias("max_y"))


@query(f"WITH {WORLDS}, b AS ({_IN_TILES.format(zooms='[3]')}) SELECT id, {_AT} FROM b WHERE x = 2 AND y = 3")
def tile_request(spark, sf_dir):
    rows = _engine(spark, sf_dir).get_tile(3, 2, 3)
    return rows.select(F.col("id").cast("long").alias("id"), F.col("geometry")[0][0]["x"].alias("tx"), F.col("geometry")[0][0]["y"].alias("ty"))


@query(f"WITH {WORLDS}, b AS ({_IN_TILES.format(zooms='[0, 2]')}), a AS (SELECT * FROM (VALUES ('0/0/0', 0, 0, 0), ('2/5/1', 2, 1, 1), ('2/-3/1', 2, 1, 1), ('2/1/4', 2, 1, 4), ('-1/0/0', -1, 0, 0), ('15/0/0', 15, 0, 0), ('25/0/0', 25, 0, 0)) AS t(asked, z, x, y)) SELECT asked, CASE WHEN count(id) > 0 THEN count(id) END AS features FROM a LEFT JOIN b USING (z, x, y) GROUP BY 1")
def tile_request_guard(spark, sf_dir):
    """x turns around the world; zooms and rows that are not there give no tile."""
    engine, rows = _engine(spark, sf_dir), []
    for asked in ("0/0/0", "2/5/1", "2/-3/1", "2/1/4", "-1/0/0", "15/0/0", "25/0/0"):
        tile = engine.get_tile(*map(int, asked.split("/")))
        rows.append((asked, None if tile is None else tile.count()))
    return spark.createDataFrame(rows, "asked string, features long")


_PYRAMID = f"WITH {WORLDS}, b AS ({_IN_TILES.format(zooms='[0, 1, 2, 3, 4, 5]')}), c AS (SELECT z, x, y, count(*) AS num_points FROM b GROUP BY ALL)"
_EAGER = ", ".join(f"e{z} AS (SELECT c.* FROM c JOIN e{z - 1} p ON c.z = {z} AND c.x // 2 = p.x AND c.y // 2 = p.y WHERE p.num_points > 150)" for z in range(1, 6))


@query(f"{_PYRAMID}, e0 AS (SELECT * FROM c WHERE z = 0), {_EAGER} " + " UNION ALL ".join(f"SELECT z, x, y FROM e{z}" for z in range(6)))
def tile_inventory(spark, sf_dir):
    """The tiles that an index makes when it is built."""
    return _engine(spark, sf_dir, TileOptions(index_max_points=150)).tile_coords().select("z", "x", "y")


@query(f"WITH {WORLDS}, b AS ({_IN_TILES.format(zooms='[0, 1, 2, 3]')}) SELECT z, x, y, id, {_AT}, event_type FROM b")
def tile_sink(spark, sf_dir):
    """Tiles written in JSON form and read back."""
    folder = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    T.write_tiles(_engine(spark, sf_dir).tiles(3), folder)
    at = lambda path, kind: F.get_json_object("value", path).cast(kind)
    return T.read_tiles(spark, folder).select("z", "x", "y", at("$.id", "long").alias("id"), at("$.geometry[0][0]", "int").alias("tx"), at("$.geometry[0][1]", "int").alias("ty"), at("$.tags.event_type", "string").alias("event_type"))


@query(f"WITH {WORLDS}, b AS ({_IN_TILES.format(zooms='[3]')}) SELECT id, true AS clipped, {_AT} FROM b WHERE x = 4 AND y = 3 UNION ALL SELECT id, false, floor(4096 * (px * 8 - 4) + 0.5)::INT, floor(4096 * (py * 8 - 3) + 0.5)::INT FROM pp")
def tile_one_shot_points(spark, sf_dir):
    """One tile without an index: clipped and wrapped, and with all features as they are."""
    features = stored(read_features(_events(spark, sf_dir), OPTIONS), "features")
    out = None
    for clipped in (True, False):
        rows = T.single_tile(features, 3, 4, 3, TileOptions(clip=clipped, wrap=clipped))
        rows = rows.select(F.col("id").cast("long").alias("id"), F.lit(clipped).alias("clipped"), F.col("geometry")[0][0]["x"].alias("tx"), F.col("geometry")[0][0]["y"].alias("ty"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT z::INT AS z, CASE WHEN z = 14 THEN 0 ELSE round(3e9 / (pow(2, z) * 4096), 6) END AS tolerance, round(1e18 * pow(3 / (pow(2, 14) * 4096), 2), 3) AS base FROM range(15) AS t(z)")
def tile_tolerances(spark, sf_dir):
    rows = [(z, 1e9 * OPTIONS.tolerance_at(z), 1e18 * OPTIONS.base_tolerance) for z in range(15)]
    return spark.createDataFrame(rows, "z int, tolerance double, base double").select("z", F.round("tolerance", 6).alias("tolerance"), F.round("base", 3).alias("base"))


@query(f"""WITH {SQL_POINTS}, w AS (SELECT id, CASE id % 10 WHEN 0 THEN lon + 360 WHEN 1 THEN lon - 360 ELSE lon END AS lon, lat FROM gp), p AS (SELECT id, {PX} AS px FROM w),
c AS (SELECT id, 0 AS world, px + 1 AS px FROM p WHERE px >= -1.015625 AND px < 0.015625 UNION ALL SELECT id, 1, px FROM p WHERE px >= -0.015625 AND px < 1.015625 UNION ALL SELECT id, 2, px - 1 FROM p WHERE px >= 0.984375 AND px < 2.015625)
SELECT id, world, round(px, 9) AS x FROM c""")
def wrap_points(spark, sf_dir):
    turn = F.when(F.col("id") % 10 == 0, 360.0).when(F.col("id") % 10 == 1, -360.0).otherwise(0.0)
    rows = _texts(X.points(spark, sf_dir).withColumn("lon", F.col("lon") + turn), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    wrapped = T.wrap(read_features(rows, OPTIONS), OPTIONS)
    return wrapped.select(F.col("id").cast("long").alias("id"), F.shiftright("seq", 61).cast("int").alias("world"), F.round("min_x", 9).alias("x"))


@query(f"WITH {_SEGMENTS} SELECT id, CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS world, count(*)::INT AS vertices, round(min(px), 9) AS min_x, round(max(px), 9) AS max_x, round(min(py), 9) AS min_y FROM sg GROUP BY id")
def wrap_lines(spark, sf_dir):
    """Lines of neighbouring worlds, moved to the centre vertex by vertex."""
    turn = F.when(F.col("id") % 3 == 0, 360.0).when(F.col("id") % 3 == 1, -360.0).otherwise(0.0)
    line = F.struct(F.lit("LineString").alias("type"), F.transform("pts", lambda p: F.array(p["lon"] + turn, p["lat"])).alias("coordinates"))
    wrapped = T.wrap(read_features(_texts(X.tracks(spark, sf_dir), line), OPTIONS), OPTIONS)
    vertices = (F.size(F.col("paths")[0]["xyz"]) / 3).cast("int")
    return wrapped.select(F.col("id").cast("long").alias("id"), F.shiftright("seq", 61).cast("int").alias("world"), vertices.alias("vertices"), *[F.round(c, 9).alias(c) for c in ("min_x", "max_x", "min_y")])


def _user_features(spark, sf_dir) -> DataFrame:
    rows = X.points(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.collect_list(F.array("lon", "lat")).alias("c"))
    return read_features(_texts(rows, F.struct(F.lit("MultiPoint").alias("type"), F.col("c").alias("coordinates"))), OPTIONS)


@query(f"""WITH {SQL_PROJECTED}, u AS (SELECT user_id AS id, min(px) AS lo, max(px) AS hi, count(*) FILTER (WHERE px >= 0.25 AND px <= 0.3) AS n FROM pp GROUP BY 1)
SELECT id, n::INT AS points, CASE WHEN n = 1 AND NOT (lo >= 0.25 AND hi < 0.3) THEN 'Point' ELSE 'MultiPoint' END AS kind FROM u WHERE n > 0 AND lo < 0.3 AND hi >= 0.25""")
def multipoint_clip(spark, sf_dir):
    work = lambda shape: [(len(s.paths[0].points), s.kind) for s in clip(shape, 0.25, 0.3, 0)]
    return _shapes(_user_features(spark, sf_dir), work, [("points", "int"), ("kind", "string")])


@query(f"WITH {SQL_PROJECTED} SELECT user_id AS id, count(*)::INT AS points, round(min(px), 9) AS min_x, round(min(py), 9) AS min_y, round(max(px), 9) AS max_x, round(max(py), 9) AS max_y FROM pp GROUP BY 1")
def multipoint_features(spark, sf_dir):
    rows = _user_features(spark, sf_dir)
    return rows.select(F.col("id").cast("long").alias("id"), (F.size(F.col("paths")[0]["xyz"]) / 3).cast("int").alias("points"), *[F.round(c, 9).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query(f"WITH {_SEGMENTS} SELECT id, count(*)::INT AS vertices, round(coalesce(sum(sqrt((px - ox) * (px - ox) + (py - oy) * (py - oy))), 0), 9) AS length FROM sg GROUP BY id")
def line_length(spark, sf_dir):
    own = F.col("paths")[0]
    return _track_features(spark, sf_dir).select(F.col("id").cast("long").alias("id"), (F.size(own["xyz"]) / 3).cast("int").alias("vertices"), F.round(own["size"], 9).alias("length"))


@query(f"WITH {SQL_BOXES}, q AS (SELECT id, {PX.replace('lon', 'west')} AS x0, {PX.replace('lon', 'east')} AS x1, {PY.replace('lat', 'north')} AS y0, {PY.replace('lat', 'south')} AS y1 FROM bb) SELECT id, round((x1 - x0) * (y1 - y0), 12) AS area FROM q")
def ring_area(spark, sf_dir):
    return _box_features(spark, sf_dir).select(F.col("id").cast("long").alias("id"), F.round(F.col("paths")[0]["size"], 12).alias("area"))


@query(f"WITH {_SEGMENTS} SELECT id, round(min(px), 9) AS min_x, round(min(py), 9) AS min_y, round(max(px), 9) AS max_x, round(max(py), 9) AS max_y FROM sg GROUP BY id")
def feature_bbox(spark, sf_dir):
    return _track_features(spark, sf_dir).select(F.col("id").cast("long").alias("id"), *[F.round(c, 9).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query(f"WITH {SQL_BOXES}, q AS (SELECT id, {PX.replace('lon', 'west')} AS lo, {PX.replace('lon', 'east')} AS hi FROM bb) SELECT id, CASE WHEN lo >= 0.25 AND hi < 0.5 THEN 'accept' WHEN hi < 0.25 OR lo >= 0.5 THEN 'reject' ELSE 'clip' END AS verdict FROM q")
def bbox_accept_reject(spark, sf_dir):
    """What the clipper does with each box: hand it on, drop it, or cut it."""

    def work(shape: Shape) -> list[tuple]:
        found = clip(shape, 0.25, 0.5, 0)
        return [("reject" if not found else "accept" if found[0] is shape else "clip",)]

    return _shapes(_box_features(spark, sf_dir), work, [("verdict", "string")])


@query("SELECT o_custkey AS id, count(*)::INT AS vertices FROM orders GROUP BY o_custkey, o_orderstatus")
def multiline_explode(spark, sf_dir):
    """A line of several parts is a feature for each part where lines are measured."""
    o = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus", F.array(F.col("o_custkey") % 90, F.col("o_orderkey") % 80).alias("c"))
    lines = o.groupBy("id", "o_orderstatus").agg(F.collect_list("c").alias("l")).groupBy("id").agg(F.collect_list("l").alias("m"))
    rows = read_features(_texts(lines, F.struct(F.lit("MultiLineString").alias("type"), F.col("m").alias("coordinates"))), TileOptions(line_metrics=True))
    return rows.select(F.col("id").cast("long").alias("id"), (F.size(F.col("paths")[0]["xyz"]) / 3).cast("int").alias("vertices"))


#: Lines of one vertex have no segment for the SQL above; they are in the band or not.
_ONES = "o1 AS (SELECT id, min(px) AS px FROM tp GROUP BY id HAVING count(*) = 1), l1 AS (SELECT id, 1 AS slices, 1::BIGINT AS vertices FROM o1 WHERE px >= 0.4 AND px < 0.6)"


@query(f"{_CLIP}, {_ONES}, b AS (SELECT id, min(px) >= 0.4 AND max(px) < 0.6 AS whole FROM tp GROUP BY id), r AS (SELECT id, count(*)::INT AS slices, sum(vertices)::BIGINT AS vertices FROM g GROUP BY id UNION ALL SELECT * FROM l1) SELECT id, slices, vertices, CASE WHEN whole OR slices > 1 THEN 'MultiLineString' ELSE 'LineString' END AS kind FROM r JOIN b USING (id)")
def multiline_clip(spark, sf_dir):
    line = F.struct(F.lit("MultiLineString").alias("type"), F.array(F.transform("pts", lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates"))
    rows = read_features(_texts(X.tracks(spark, sf_dir), line), OPTIONS)
    work = lambda shape: [(len(s.paths), sum(len(p.points) for p in s.paths), s.kind) for s in clip(shape, 0.4, 0.6, 0, closed=True)]
    return _shapes(rows, work, [("slices", "int"), ("vertices", "int"), ("kind", "string")]).withColumn("vertices", F.col("vertices").cast("long"))


def _banded(lo: str, hi: str) -> str:
    """_CLIP of lines along one latitude, for another band."""
    return _CLIP.replace(PY, "0.25::DOUBLE").replace("0.4", lo).replace("0.6", hi)


_PARTS = "SELECT id, {x} AS x, (row_number() OVER (PARTITION BY id ORDER BY slice) - 1)::INT AS part, round(coalesce(st, 0) / size, 6) AS clip_start, round(coalesce(en, size) / size, 6) AS clip_end FROM g JOIN z USING (id) WHERE size > 0"


@query(f"SELECT * FROM ({_banded('-0.0078125', '0.5078125')} {_PARTS.format(x=0)}) UNION ALL SELECT * FROM ({_banded('0.4921875', '1.0078125')} {_PARTS.format(x=1)})")
def line_metrics_tags(spark, sf_dir):
    """Where each slice of a line begins and ends on it, as tags of the tile features of zoom 1."""
    options = TileOptions(line_metrics=True)
    line = F.struct(F.lit("LineString").alias("type"), F.transform("pts", lambda p: F.array(p["lon"], F.lit(10.0))).alias("coordinates"))
    rows = T.tile_features(read_features(_texts(X.tracks(spark, sf_dir), line), options), TileOptions(line_metrics=True, tolerance=0), 1)
    found = T.feature_json(rows.where("z = 1 and clip_start is not null"))
    at = lambda path, kind: F.get_json_object("value", path).cast(kind)
    return found.select(at("$.id", "long").alias("id"), "x", "part", F.round(at("$.tags.clip_start", "double"), 6).alias("clip_start"), F.round(at("$.tags.clip_end", "double"), 6).alias("clip_end"))


@query(f"""WITH {_SEGMENTS}, t AS (SELECT id, max(px) FILTER (WHERE k = 1) AS ax, max(py) FILTER (WHERE k = 1) AS ay, max(px) FILTER (WHERE k = 2) AS qx, max(py) FILTER (WHERE k = 2) AS qy, max(px) FILTER (WHERE k = 3) AS bx, max(py) FILTER (WHERE k = 3) AS by_ FROM sg WHERE k <= 3 GROUP BY id HAVING count(*) = 3),
s AS (SELECT *, bx - ax AS dx, by_ - ay AS dy FROM t), u AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE least(1, greatest(0, ((qx - ax) * dx + (qy - ay) * dy) / (dx * dx + dy * dy))) END AS w FROM s),
d AS (SELECT id, pow(qx - ax - dx * w, 2) + pow(qy - ay - dy * w, 2) AS d FROM u)
SELECT id, CASE WHEN d > pow(3 / (pow(2, 14) * 4096), 2) THEN round(d * 1e9, 3) ELSE 0 END AS middle, d > pow(3 / (pow(2, 5) * 4096), 2) AS kept_at_5 FROM d""")
def line_importance_of_three(spark, sf_dir):
    """The importance of the middle one of the first three vertices of each line, and whether zoom 5 keeps it."""
    line = F.struct(F.lit("LineString").alias("type"), F.transform(F.slice("pts", 1, 3), lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    rows = read_features(_texts(X.tracks(spark, sf_dir).where("size(pts) >= 3"), line), OPTIONS)
    middle = F.col("paths")[0]["xyz"][5]
    return rows.select(F.col("id").cast("long").alias("id"), F.round(middle * 1e9, 3).alias("middle"), (middle > OPTIONS.tolerance_at(5) ** 2).alias("kept_at_5"))


@query(f"WITH {SQL_BOXES} SELECT id::BIGINT AS id, k::INT AS k, 5 AS vertices, k <> 1 AS clockwise FROM bb, range(3) AS t(k)")
def multipolygon_tile(spark, sf_dir):
    """Two polygons, the first with a hole: outer rings run clockwise, the hole the other way."""

    def ring(by: float, grow: float):
        x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
        w, h = (F.col("east") - F.col("west")) / 2 * grow, (F.col("north") - F.col("south")) / 2 * grow
        y = y + F.when(y > 0, -by).otherwise(by)
        return F.array(*[F.array(x + i * w, y + j * h) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])

    polygons = F.array(F.array(ring(0.0, 1.0), ring(0.0, 0.5)), F.array(ring(2.0, 1.0)))
    rows = read_features(_texts(X.boxes(spark, sf_dir), F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates"))), OPTIONS)
    rows = T.single_tile(rows, 0, 0, 0, TileOptions(tolerance=0, extent=1 << 24)).select(F.col("id").cast("long").alias("id"), F.posexplode("geometry").alias("k", "r"))
    number = lambda v: v.cast("double")
    turn = F.aggregate(F.zip_with(F.slice("r", 1, 4), F.slice("r", 2, 4), lambda a, b: number(a["x"]) * number(b["y"]) - number(b["x"]) * number(a["y"])), F.lit(0.0), lambda s, v: s + v)
    return rows.select("id", "k", F.size("r").alias("vertices"), (turn > 0).alias("clockwise"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS id, n_name AS name FROM nation")
def feature_generated_ids(spark, sf_dir):
    """Features of one collection, numbered by their place in it."""
    n = X.table(spark, sf_dir, "nation")
    feature = F.struct("n_nationkey", F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("n_nationkey").cast("double"), F.lit(1.0)).alias("coordinates")).alias("geometry"))
    one = n.agg(F.array_sort(F.collect_list(feature)).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    return read_features(one, TileOptions(generate_id=True)).select(F.col("id").cast("long").alias("id"), F.get_json_object("tags", "$.name").alias("name"))


@query(f"WITH {SQL_TRACKS} SELECT id, (k - 1)::INT AS k, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM tr")
def geojson_lines(spark, sf_dir):
    rows = to_geojson(_track_features(spark, sf_dir))
    at = F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<array<double>>")
    rows = rows.select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.posexplode(at).alias("k", "c"))
    place = lambda k: F.round(F.col("c")[k], 6) + F.lit(0.0)
    return rows.select("id", "k", place(0).alias("lon"), place(1).alias("lat"))


def _data(engine: T.TileEngine) -> DataFrame:
    """The features of an engine, from its own export, without copies from other worlds."""
    at = lambda path, kind: F.get_json_object("value", path).cast(kind)
    rows = engine.get_data().select(at("$.id", "long").alias("id"), at("$.geometry.coordinates[0]", "double").alias("lon"), at("$.properties.event_type", "string").alias("event_type"), at("$.properties.value", "double").alias("value"))
    return rows.where("lon >= -180 and lon < 180").withColumn("lon", F.round("lon", 6) + F.lit(0.0))


def _no_geometry(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Update rows that leave the geometry as it is."""
    for name, kind in like.dtypes:
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    return rows


@query(f"WITH {SQL_POINTS} SELECT id, round(lon, 6) + 0.0 AS lon, CASE id % 10 WHEN 2 THEN 'patched' WHEN 3 THEN NULL ELSE event_type END AS event_type, CASE WHEN id % 10 IN (2, 3) THEN NULL ELSE value END AS value FROM gp")
def engine_patch_properties(spark, sf_dir):
    """One property set and another removed, and all removed, in the features and their copies."""
    engine = _engine(spark, sf_dir, UPDATEABLE)
    ids = X.points(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"))
    patch = ids.where("seq % 10 = 2").withColumn("set_properties", F.create_map(F.lit("event_type"), F.lit('"patched"'))).withColumn("remove_properties", F.array(F.lit("value"))).withColumn("remove_all_properties", F.lit(False))
    clear = ids.where("seq % 10 = 3").withColumn("set_properties", F.create_map(F.lit("event_type"), F.lit('"lost"'))).withColumn("remove_properties", F.array(F.lit("value"))).withColumn("remove_all_properties", F.lit(True))
    new, _ = engine.update_data(update=_no_geometry(patch.unionByName(clear), engine.source))
    return _data(new)


@query(f"WITH {SQL_POINTS} SELECT id, CASE WHEN id % 10 = 3 THEN 0.5 ELSE round(lon, 6) + 0.0 END AS lon, event_type, value FROM gp")
def engine_update_geometry(spark, sf_dir):
    engine = _engine(spark, sf_dir, UPDATEABLE)
    moved = _texts(X.points(spark, sf_dir).where("id % 10 = 3"), F.struct(F.lit("Point").alias("type"), F.array(F.lit(0.5), F.col("lat")).alias("coordinates")))
    new, _ = engine.update_data(update=read_features(moved, UPDATEABLE))
    return _data(new)


@query(f"WITH {WORLDS}, a AS (SELECT id + 1000000000 AS id FROM gp WHERE id % 10 = 1) SELECT id, round(lon, 6) + 0.0 AS lon FROM pw UNION ALL SELECT id, 179.9 FROM a UNION ALL SELECT id, -180.1 FROM a")
def engine_add_wrapped(spark, sf_dir):
    """Added features get their copies from other worlds too."""
    engine = _engine(spark, sf_dir, UPDATEABLE)
    new = X.points(spark, sf_dir).where("id % 10 = 1").withColumn("id", F.col("id") + 1_000_000_000)
    add = read_features(_texts(new, F.struct(F.lit("Point").alias("type"), F.array(F.lit(179.9), F.col("lat")).alias("coordinates"))), UPDATEABLE, numbered=True)
    changed, _ = engine.update_data(add=add)
    at = lambda path, kind: F.get_json_object("value", path).cast(kind)
    return changed.get_data().select(at("$.id", "long").alias("id"), (F.round(at("$.geometry.coordinates[0]", "double"), 6) + F.lit(0.0)).alias("lon"))


@query(f"WITH {SQL_POINTS} SELECT id, round(lon, 6) + 0.0 AS lon, event_type, value FROM gp WHERE id % 4 <> 0 AND lat >= 0")
def engine_remove_and_filter(spark, sf_dir):
    engine = _engine(spark, sf_dir, UPDATEABLE)
    gone = X.points(spark, sf_dir).where("id % 4 = 0").select(F.col("id").cast("string").alias("id"))
    new, _ = engine.update_data(remove=gone, good=F.col("min_y") <= 0.5)
    return _data(new)


@query(f"WITH {WORLDS}, b AS ({_IN_TILES.format(zooms='[0, 1, 2, 3, 4]')}) SELECT z, x, y, count(*) AS num_points, sum(id)::BIGINT AS ids FROM b WHERE id % 10 <> 0 GROUP BY ALL")
def engine_reindex(spark, sf_dir):
    """Tiles that the change reaches are made anew, the others stay."""
    engine = _engine(spark, sf_dir, UPDATEABLE)
    old = stored(engine.tiles(4), "tiles")
    gone = X.points(spark, sf_dir).where("id % 10 = 0").select(F.col("id").cast("string").alias("id"))
    new, affected = engine.update_data(remove=gone)
    rows = new.reindexed(old, stored(affected.select(*engine.source.columns), "affected"), 4)
    return rows.groupBy("z", "x", "y").agg(F.count("*").alias("num_points"), F.sum(F.col("id").cast("long")).alias("ids"))


@query(f"WITH {SQL_TRACKS}, q AS (SELECT id, {PX} AS px, {PY} AS py FROM tr WHERE id % 2 = 1) SELECT count(DISTINCT id) AS features, count(*) AS points FROM q")
def engine_reindex_lines(spark, sf_dir):
    """The root tile after half of the lines are removed."""
    options = TileOptions(updateable=True, tolerance=0)
    engine = T.TileEngine(_track_features(spark, sf_dir, options), options)
    old = stored(engine.tiles(2), "tiles")
    gone = X.tracks(spark, sf_dir).where("id % 2 = 0").select(F.col("id").cast("string").alias("id"))
    new, affected = engine.update_data(remove=gone)
    rows = new.reindexed(old, stored(affected.select(*engine.source.columns), "affected"), 2).where("z = 0")
    return rows.agg(F.count("*").alias("features"), F.sum("points").alias("points"))
