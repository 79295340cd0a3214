"""Queries of the cluster operators whose SQL knows every node.

Events are snapped to a grid of ten degrees. From zoom 3 on the radius is less than half the grid's spacing, so the points of one place are one cluster at zoom 16, its origin is the first of them, and nothing
changes on the way to zoom 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters as K
from ..operators.facade import MapIndex
from ..options import ClusterOptions, TileOptions
from ..sources.geojson import read_features
from ..storage import stored
from . import fixtures as X
from .catalog import built_once, query
from .fixtures import PX, PY, SQL_POINTS

GRID = ClusterOptions(min_zoom=3)
SMALL = ClusterOptions(min_zoom=3, min_points=5)

SNAPPED = f"""{SQL_POINTS}, sn AS (SELECT id, floor(lon / 10) * 10 + 5 AS lon, floor(lat / 10) * 10 + 5 AS lat, value FROM gp), sp AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS idx, {PX} AS px, {PY} AS py FROM sn),
pl AS (SELECT lon, lat, px, py, min(idx) AS origin, count(*) AS n, sum(value) AS total FROM sp GROUP BY ALL), np AS (SELECT count(*) AS total_points FROM sp)"""
#: The nodes from zoom 3 to 16, and those of zoom 17, where clusters need so many points.
_NODES = """, nd AS (SELECT origin, 0 AS place, lon, lat, px, py, n, total, CASE WHEN n > 1 THEN origin * 32 + 17 + total_points ELSE origin END AS id, CASE WHEN n = 1 THEN origin END AS point FROM pl, np WHERE n = 1 OR n >= {least}
UNION ALL SELECT origin, row_number() OVER (PARTITION BY origin ORDER BY idx) - 1, sp.lon, sp.lat, sp.px, sp.py, 1, sp.value, idx, idx FROM sp JOIN pl ON sp.lon = pl.lon AND sp.lat = pl.lat WHERE n > 1 AND n < {least}),
nn AS (SELECT row_number() OVER (ORDER BY origin, place) - 1 AS idx, * FROM nd),
al AS (SELECT z::INT AS z, nn.idx, id, NULL AS parent_id, n AS num_points, point, total, lon, lat, px, py FROM nn, (SELECT unnest(range(3, 17)) AS z)
UNION ALL SELECT 17, sp.idx, sp.idx, CASE WHEN n > 1 AND n >= {least} THEN origin * 32 + 17 + total_points END, 1, sp.idx, sp.value, sp.lon, sp.lat, sp.px, sp.py FROM sp JOIN pl ON sp.lon = pl.lon AND sp.lat = pl.lat, np)"""
GRID_NODES, SMALL_NODES = SNAPPED + _NODES.format(least=2), SNAPPED + _NODES.format(least=5)
_SHOWN = "z, idx, id::BIGINT AS id, parent_id::BIGINT AS parent_id, num_points, point, round(total, 4) AS total, round(px::FLOAT::DOUBLE, 7) AS x, round(py::FLOAT::DOUBLE, 7) AS y"
_SHORT = "CASE WHEN {n} >= 10000 THEN floor({n} / 1000.0 + 0.5)::BIGINT || 'k' WHEN {n} >= 1000 THEN CASE WHEN floor({n} / 100.0 + 0.5) % 10 = 0 THEN (floor({n} / 100.0 + 0.5) / 10)::BIGINT::VARCHAR ELSE floor(floor({n} / 100.0 + 0.5) / 10)::BIGINT || '.' || (floor({n} / 100.0 + 0.5) % 10)::BIGINT END || 'k' ELSE {n}::VARCHAR END"
_TOP = "top AS (SELECT id, num_points FROM al WHERE z = 3 ORDER BY num_points DESC, idx LIMIT 1)"


def snapped(spark, sf_dir) -> DataFrame:
    down = lambda c: F.floor(F.col(c) / 10) * 10.0 + 5.0
    return X.points(spark, sf_dir).select("id", down("lon").alias("lon"), down("lat").alias("lat"), "value")


def _index(spark, sf_dir, options=GRID) -> K.ClusterIndex:
    return K.ClusterIndex(K.load_points(snapped(spark, sf_dir), "id"), options, "value")


@built_once
def _grid(spark, sf_dir) -> K.ClusterIndex:
    return _index(spark, sf_dir)


def _nodes(index: K.ClusterIndex) -> DataFrame:
    return index.nodes.select("z", "idx", "id", "parent_id", "num_points", "point", F.round("total", 4).alias("total"), F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


@query(f"WITH {GRID_NODES} SELECT {_SHOWN} FROM al")
def cluster_grid_nodes(spark, sf_dir):
    return _nodes(_index(spark, sf_dir))


@query(f"WITH {GRID_NODES} SELECT {_SHOWN} FROM al WHERE z >= 12")
def cluster_grid_blocks(spark, sf_dir):
    """The levels from zoom 12 on, each cut in blocks."""
    points = stored(K.load_points(snapped(spark, sf_dir), "id"), "points")
    nodes = K.build_clusters(points, ClusterOptions(min_zoom=12), "value", one_task=0)
    return nodes.select("z", "idx", "id", "parent_id", "num_points", "point", F.round("total", 4).alias("total"), F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


@query(f"WITH {SMALL_NODES} SELECT {_SHOWN} FROM al")
def cluster_undersized(spark, sf_dir):
    """Places with less than five points stay single, in the order in which they were visited."""
    return _nodes(_index(spark, sf_dir, SMALL))


@query(f"WITH {SQL_POINTS} SELECT row_number() OVER (ORDER BY id) - 1 AS idx, {PX}::FLOAT::DOUBLE AS x, {PY}::FLOAT::DOUBLE AS y FROM gp")
def cluster_float_points(spark, sf_dir):
    return K.load_points(X.points(spark, sf_dir), "id").select("idx", "x", "y")


@query(f"WITH {SQL_POINTS}, p AS (SELECT row_number() OVER (ORDER BY id) - 1 AS idx, lon, lat, {PX} AS px, {PY} AS py FROM gp) SELECT idx, floor(512 * (px * 64 - 20) + 0.5)::INT AS tx, floor(512 * (py * 64 - 30) + 0.5)::INT AS ty FROM p WHERE px::FLOAT BETWEEN (20 - 1e-9::DOUBLE / 512) / 64 AND (21 + 1e-9::DOUBLE / 512) / 64 AND py::FLOAT BETWEEN (30 - 1e-9::DOUBLE / 512) / 64 AND (31 + 1e-9::DOUBLE / 512) / 64")
def cluster_tile_of_singles(spark, sf_dir):
    """No radius, no clusters: single points are where their own coordinates put them, in full precision."""
    index = K.ClusterIndex(K.load_points(X.points(spark, sf_dir), "id"), ClusterOptions(min_zoom=6, max_zoom=6, radius=1e-9, min_points=1 << 40))
    return index.get_tile(6, 20, 30).select("idx", "tx", "ty")


_TILE_AT = "0.078125"  # radius by extent


@query(f"""WITH {GRID_NODES}, c AS (SELECT 0 AS copy, 0 AS tile, -{_TILE_AT} / 16 AS lo, (1 + {_TILE_AT}) / 16 AS hi UNION ALL SELECT 1, 16, 1 - {_TILE_AT} / 16, 1.0)
SELECT copy, idx, num_points, floor(512 * (px * 16 - tile) + 0.5)::INT AS tx, floor(512 * (py * 16 - 7) + 0.5)::INT AS ty, CASE WHEN num_points > 1 THEN id::VARCHAR END AS feature_id FROM al, c WHERE z = 4 AND px::FLOAT BETWEEN lo AND hi AND py::FLOAT BETWEEN (7 - {_TILE_AT}) / 16 AND (8 + {_TILE_AT}) / 16""")
def cluster_grid_tile(spark, sf_dir):
    """A tile at the edge of the world, with copies from the other side."""
    return _grid(spark, sf_dir).get_tile(4, 0, 7).select("copy", "idx", "num_points", "tx", "ty", "feature_id")


@query(f"WITH {GRID_NODES} SELECT point, id::VARCHAR AS feature_id FROM al WHERE z = 17 AND px::FLOAT BETWEEN (7 - {_TILE_AT}) / 16 AND (8 + {_TILE_AT}) / 16 AND py::FLOAT BETWEEN (7 - {_TILE_AT}) / 16 AND (8 + {_TILE_AT}) / 16")
def cluster_generated_ids(spark, sf_dir):
    """Single points with generated ids, in a tile of the level of all points."""
    index = _index(spark, sf_dir, ClusterOptions(min_zoom=17, max_zoom=17, min_points=1 << 40, generate_id=True))
    return index.get_tile(4, 7, 7).select("point", "feature_id")


@query(f"WITH {GRID_NODES} SELECT idx, id::BIGINT AS id, num_points, lon, lat, num_points > 1 AS cluster, {_SHORT.format(n='num_points')} AS short FROM (SELECT * FROM al WHERE z = 5 AND (lon >= 150 OR lon <= -150) AND lat BETWEEN -40 AND 40)")
def cluster_grid_bbox(spark, sf_dir):
    rows = _grid(spark, sf_dir).get_clusters((150.0, -40.0, 210.0, 40.0), 5)
    return rows.select("idx", "id", "num_points", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), "cluster", F.col("point_count_abbreviated").alias("short"))


@query(f"WITH {GRID_NODES}, {_TOP} SELECT al.idx, al.id::BIGINT AS id, lon, lat, false AS cluster FROM al, top WHERE z = 17 AND parent_id = top.id")
def cluster_grid_children(spark, sf_dir):
    index = _grid(spark, sf_dir)
    top = index.nodes.where("z = 3").orderBy(F.col("num_points").desc(), "idx").first()
    return index.children(top.id).select("idx", "id", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), "cluster")


@query(f"WITH {GRID_NODES}, {_TOP} SELECT al.idx AS point, lon, lat FROM al, top WHERE z = 17 AND parent_id = top.id ORDER BY al.idx LIMIT 3 OFFSET 2")
def cluster_grid_leaves(spark, sf_dir):
    """A page of the leaves: limit and offset are the operator's."""
    index = _grid(spark, sf_dir)
    top = index.nodes.where("z = 3").orderBy(F.col("num_points").desc(), "idx").first()
    return index.leaves(top.id, 3, 2).select("point", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))


@query(f"WITH {GRID_NODES}, {_TOP} SELECT 17 AS zoom, id::BIGINT AS id FROM top")
def cluster_grid_expansion(spark, sf_dir):
    index = _grid(spark, sf_dir)
    top = index.nodes.where("z = 3").orderBy(F.col("num_points").desc(), "idx").first()
    return spark.createDataFrame([(index.expansion_zoom(top.id), top.id)], "zoom int, id long")


@query(f"WITH {GRID_NODES} SELECT idx, CASE WHEN num_points > 1 THEN id::BIGINT END AS id, CASE WHEN num_points > 1 THEN num_points END AS point_count, CASE WHEN num_points > 1 THEN {_SHORT.format(n='num_points')} END AS short, num_points > 1 AS cluster, lon, lat FROM al WHERE z = 3")
def cluster_grid_geojson(spark, sf_dir):
    rows = K.cluster_geojson(_grid(spark, sf_dir).get_clusters((-180.0, -90.0, 180.0, 90.0), 3))
    at = lambda path, kind: F.get_json_object("value", path).cast(kind)
    place = lambda k: F.round(at(f"$.geometry.coordinates[{k}]", "double"), 4)
    return rows.select("idx", at("$.id", "long").alias("id"), at("$.properties.point_count", "long").alias("point_count"), at("$.properties.point_count_abbreviated", "string").alias("short"), F.coalesce(at("$.properties.cluster", "boolean"), F.lit(False)).alias("cluster"), place(0).alias("lon"), place(1).alias("lat"))


@query(f"WITH {GRID_NODES}, a AS (SELECT * FROM (VALUES ('-1', 3), ('4.9', 4), ('16', 16), ('99', 17)) AS t(asked, z)) SELECT asked, count(*) AS nodes FROM a JOIN al USING (z) GROUP BY 1")
def cluster_zoom_clamp(spark, sf_dir):
    index = _grid(spark, sf_dir)
    out = None
    for asked in ("-1", "4.9", "16", "99"):
        one = index.get_clusters((-180.0, -90.0, 180.0, 90.0), float(asked)).agg(F.count("*").alias("nodes")).select(F.lit(asked).alias("asked"), "nodes")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {GRID_NODES} SELECT z, idx, num_points, CASE WHEN num_points = 1 THEN value END AS least, CASE WHEN num_points = 1 THEN 1 ELSE num_points END AS n FROM al LEFT JOIN (SELECT idx AS p, value FROM sp) ON point = p WHERE z = 3 AND num_points = 1 UNION ALL SELECT z, a.idx, num_points, lo, num_points FROM al a JOIN (SELECT lon, lat, min(value) AS lo FROM sp GROUP BY ALL) USING (lon, lat) WHERE z = 3 AND num_points > 1")
def cluster_records(spark, sf_dir):
    """Clusters that accumulate a record of two fields."""
    record = F.struct(F.lit(1).cast("long").alias("n"), F.col("value").cast("double").alias("least"))
    points = K.load_points(snapped(spark, sf_dir).withColumn("record", record), "id")
    fold = lambda a, b: {"n": a["n"] + b["n"], "least": min(a["least"], b["least"])}
    nodes = K.ClusterIndex(points, GRID, "record", fold).nodes.where("z = 3")
    return nodes.select("z", "idx", "num_points", "total.least", "total.n")


def _mixed(spark, sf_dir, options=TileOptions()) -> DataFrame:
    """Snapped events as points with their value, and the tracks of customers."""
    point = F.struct(F.lit("Feature").alias("type"), "id", F.struct("value").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    line = F.struct(F.lit("Feature").alias("type"), "id", F.struct(F.lit("LineString").alias("type"), F.transform("pts", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")).alias("geometry"))
    texts = snapped(spark, sf_dir).orderBy("id").select(F.to_json(point).alias("value")).unionByName(X.tracks(spark, sf_dir).select(F.to_json(line).alias("value")))
    return read_features(texts, options)


@query(f"WITH {SNAPPED} SELECT id, round(px, 9) AS px, round(py, 9) AS py FROM sp")
def cluster_source_filter(spark, sf_dir):
    """Only single points of a table of features are clustered."""
    rows = K.feature_points(_mixed(spark, sf_dir))
    return rows.select(F.col("feature_id").cast("long").alias("id"), F.round("px", 9).alias("px"), F.round("py", 9).alias("py"))


_WORLDS = "(SELECT * FROM sp UNION ALL SELECT id, lon + 360, lat, value, idx, px + 1, py FROM sp WHERE px < 0.015625 UNION ALL SELECT id, lon - 360, lat, value, idx, px - 1, py FROM sp WHERE px >= 0.984375)"


@built_once
def _facade(spark, sf_dir) -> MapIndex:
    return MapIndex(_mixed(spark, sf_dir), TileOptions(updateable=True), cluster=True, clusters=GRID, value=F.get_json_object("tags", "$.value").cast("double"))


@query(f"WITH {SNAPPED} SELECT count(*) AS points, round(sum(value), 2) AS total FROM {_WORLDS}")
def cluster_facade_duplicates(spark, sf_dir):
    """Copies of points in the edge bands of the world are clustered with the others."""
    return _facade(spark, sf_dir).index.nodes.where("z = 3").agg(F.sum("num_points").alias("points"), F.round(F.sum("total"), 2).alias("total"))


@query(f"WITH {SNAPPED} SELECT round(lon, 4) AS lon, round(lat, 4) AS lat, count(*) AS n, round(sum(value), 2) AS total FROM {_WORLDS} GROUP BY ALL")
def cluster_facade_nodes(spark, sf_dir):
    facade = _facade(spark, sf_dir)
    rows = K.cluster_columns(facade.index.nodes.where("z = 3"), facade.index.points)
    return rows.select(F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), F.col("num_points").alias("n"), F.round("total", 2).alias("total"))


@query(f"WITH {SNAPPED}, p AS (SELECT lon, lat, count(*) AS n FROM {_WORLDS} GROUP BY ALL), t AS (SELECT n FROM p ORDER BY n DESC LIMIT 1) SELECT true AS clustered, n AS children, n AS leaves, true AS plain FROM t")
def cluster_facade_navigators(spark, sf_dir):
    """Children and leaves of the largest cluster, and None from all of them once clustering is off."""
    facade = _facade(spark, sf_dir)
    top = facade.index.nodes.where("z = 3").orderBy(F.col("num_points").desc(), "idx").first()
    off = facade.update_cluster_options(False)
    plain = off.expansion_zoom(top.id) is None and off.children(top.id) is None and off.leaves(top.id) is None and off.get_clusters((-180, -90, 180, 90), 3) is None
    row = (facade.expansion_zoom(top.id) == 17, facade.children(top.id).count(), facade.leaves(top.id, 1 << 30).count(), plain)
    return spark.createDataFrame([row], "clustered boolean, children long, leaves long, plain boolean")


@query(f"WITH {SNAPPED}, w AS {_WORLDS} SELECT false AS clustered, count(*) AS n FROM w WHERE px >= -0.015625 AND px < 1.015625 UNION ALL SELECT true, count(*) FROM (SELECT lon, lat FROM w GROUP BY ALL)")
def cluster_facade_toggle(spark, sf_dir):
    """Points of the root tile without clustering, and nodes of zoom 3 after clustering is on again."""
    off = _facade(spark, sf_dir).update_cluster_options(False)
    on = off.update_cluster_options(True, GRID)
    plain = off.get_tile(0, 0, 0).where("type = 1").agg(F.count("*").alias("n")).select(F.lit(False).alias("clustered"), "n")
    return plain.unionByName(on.index.nodes.where("z = 3").agg(F.count("*").alias("n")).select(F.lit(True).alias("clustered"), "n"))


@query(f"WITH {SNAPPED}, w AS {_WORLDS} SELECT round(lon, 4) AS lon, round(lat, 4) AS lat, count(*) AS n FROM w WHERE id % 3 <> 0 GROUP BY ALL")
def cluster_facade_update(spark, sf_dir):
    """Clusters after features are removed."""
    gone = snapped(spark, sf_dir).where("id % 3 = 0").select(F.col("id").cast("string").alias("id"))
    new = _facade(spark, sf_dir).update_data(remove=gone)
    rows = K.cluster_columns(new.index.nodes.where("z = 3"), new.index.points)
    return rows.select(F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), F.col("num_points").alias("n"))
