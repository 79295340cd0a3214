import json

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import kernels as G
from tessella.operators import changes as C
from tessella.operators import clusters as K
from tessella.operators import tiles as T
from tessella.options import ClusterOptions, TileOptions
from tessella.sources.geojson import features_of, read_features, to_geojson

#: A staircase over two bands: the walked distance at each corner is written beside it.
STAIRS = [(2, 1), (12, 1), (12, 4), (3, 4), (3, 9), (18, 9), (18, 10), (6, 10)]  # 0, 10, 13, 22, 27, 42, 43, 55


def _features(spark, *texts, options=TileOptions()):
    return read_features(spark.createDataFrame([(json.dumps(t),) for t in texts], "value string"), options)


def _line(*coordinates):
    return {"type": "LineString", "coordinates": [list(c) for c in coordinates]}


def test_clip_keeps_track_of_the_line():
    slices = G.clip_path(G.Path([(x, y, 0) for x, y in STAIRS], 55, 0, 55), 5, 15, 0, False, True)
    # In at x = 5 after 3, out at x = 5 after 20; in after 29, out at x = 15 after 39; in at x = 15 after 46, to the end.
    assert [(p.start, p.stop) for p in slices] == [(3, 20), (29, 39), (46, 55)]


def test_touching_a_bound_is_not_crossing_it():
    shape = G.Shape("LineString", [G.Path([(0.5, 0, 1), (0.5, 1, 1)])])
    assert G.clip(shape, 0.25, 0.5, 0) == [] and G.clip(shape, 0.5, 0.75, 0) == [shape]


def test_importance_survives_degenerate_lines():
    assert G.importance([(0, 0), (1, 1)] * 700, 1e-9)[0] == 1.0
    assert G.importance([(0, 0), (5, 1), (10, 0)], 0.5) == [1.0, 1.0, 1.0]
    assert G.importance([(0, 0), (5, 0.1), (10, 0)], 0.5) == [1.0, 0.0, 1.0]


def test_collections_nest_to_a_limit():
    def nested(depth):
        g = {"type": "Point", "coordinates": [1, 2]}
        for _ in range(depth):
            g = {"type": "GeometryCollection", "geometries": [g]}
        return g

    from tessella.sources import geojson

    assert len(list(geojson.shapes_of(nested(3), TileOptions()))) == 1
    assert list(features_of({"type": "FeatureCollection", "features": [{"geometry": None}, {"geometry": {"type": "Point", "coordinates": []}}]}, TileOptions())) == []
    with pytest.raises(ValueError):
        list(features_of({"type": "Pologon"}, TileOptions()))


def test_coordinates_have_to_be_finite(spark):
    for bad in ([float("nan"), 1], [1, float("inf")]):
        with pytest.raises(ValueError):
            list(features_of({"type": "LineString", "coordinates": [[0, 0], bad]}, TileOptions()))
    rows = [(1.0, 2.0, 0), (float("nan"), 1.0, 1), (1.0, float("-inf"), 2), (None, 1.0, 3)]
    assert K.load_points(spark.createDataFrame(rows, "lon double, lat double, k int"), "k").count() == 1


def test_options_are_checked():
    for bad in ({"max_zoom": 25}, {"promote_id": "a", "generate_id": True}):
        with pytest.raises(ValueError):
            TileOptions(**bad)


def test_unbuffered_edge_line_belongs_to_the_right_tile(spark):
    """A line on the bound x = 0.625 of the tiles 4 and 5 at zoom 3, from row 2 to row 5."""
    engine = T.TileEngine(_features(spark, _line((45, 60), (45, -60))), TileOptions(buffer=0))
    assert engine.get_tile(3, 4, 3).count() == 0 and engine.get_tile(3, 3, 3) is None
    assert [[tuple(p) for p in line] for line in engine.get_tile(3, 5, 3).first().geometry] == [[(0, 0), (0, 4096)]]
    assert engine.get_tile(-1, 0, 0) is None and engine.get_tile(25, 0, 0) is None


def test_wrap_makes_copies_in_order(spark):
    rows = T.wrap(_features(spark, _line((-200, 0), (-170, 0)), _line((0, 0), (1, 1)))).orderBy("seq").collect()
    assert len(rows) == 3 and rows[0].min_x == pytest.approx(1 - 20 / 360 + 0.0, abs=1e-9)
    assert T.wrap(_features(spark, _line((0, 0), (1, 1)))).count() == 1


def test_single_tile_without_clip_passes_everything(spark):
    rows = T.single_tile(_features(spark, _line((-200, 0), (200, 0))), 0, 0, 0).collect()
    assert [tuple(p) for p in rows[0].geometry[0]] == [(-228, 2048), (4324, 2048)]


def test_round_trip_of_all_types(spark):
    kinds = {"Point": [1, 2], "MultiPoint": [[1, 2], [3, 4]], "LineString": [[1, 2], [3, 4]], "MultiLineString": [[[1, 2], [3, 4]], [[5, 6], [7, 8]]], "Polygon": [[[0, 0], [1, 0], [1, 1], [0, 0]]], "MultiPolygon": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}
    rows = to_geojson(_features(spark, *[{"type": "Feature", "id": "x" if k == "Point" else 0, "properties": {"k": k}, "geometry": {"type": k, "coordinates": c}} for k, c in kinds.items()])).collect()
    for row in map(lambda r: json.loads(r.value), rows):
        flat = lambda c: [v for x in c for v in flat(x)] if isinstance(c, list) else [round(c, 8)]  # noqa: B023, E731
        kind = row["geometry"]["type"]
        assert flat(row["geometry"]["coordinates"]) == flat(kinds[kind]) and row["properties"] == {"k": kind} and row["id"] == ("x" if kind == "Point" else 0)


@pytest.mark.parametrize("side", [256, 2])
def test_clusters_are_the_same_by_blocks_and_in_one_task(spark, monkeypatch, side):
    monkeypatch.setattr(K, "SIDE", side)
    points = spark.range(400).select(((F.col("id") * 7919) % 360 - 180.0).alias("lon"), ((F.col("id") * 104729) % 170 - 85.0).alias("lat"), F.col("id").alias("k"))
    loaded = K.load_points(points, "k").drop("k")
    options = ClusterOptions(max_zoom=3)
    for k in (options, ClusterOptions(max_zoom=3, min_points=4)):
        one, split = ({(r.z, r.idx): r for r in K.build_clusters(loaded, k, one_task=n).collect()} for n in (10_000, 0))
        assert one.keys() == split.keys()
        for key, r in one.items():
            assert (r.id, r.parent_id, r.num_points, r.point, r.total) == (split[key].id, split[key].parent_id, split[key].num_points, split[key].point, split[key].total)
            assert (r.x, r.y) == pytest.approx((split[key].x, split[key].y), abs=1e-12)
    nodes = K.build_clusters(loaded, options)
    assert {r["n"] for r in nodes.groupBy("z").agg(F.sum("num_points").alias("n")).collect()} == {400}
    top = nodes.where("z = 0 and num_points > 1").orderBy("idx").first()
    assert K.leaves(nodes, top.id, 400, 1000).count() == top.num_points
    with pytest.raises(ValueError):
        K.children(nodes, 1 << 40, 400)
    folded = [sorted(map(tuple, K.build_clusters(loaded.withColumn("name", F.format_string("%03d", "idx")), ClusterOptions(min_zoom=1, max_zoom=2), "name", one_task=n, fold=lambda a, b: f"{a},{b}").select("z", "idx", "total").collect())) for n in (10_000, 0)]
    assert folded[0] == folded[1]


def test_unclustered_points_keep_full_precision():
    one = pd.DataFrame({"idx": [0], "x": [0.25], "y": [0.25], "id": [0], "num_points": [1], "point": [0], "total": [1.0]})
    made, parents = K.greedy(one, 0.1, 3, 1, 2)
    assert made[0][0] == 0.25 and parents == {}


def test_boxes_over_the_date_line():
    assert K.bbox_ranges(170, -10, 200, 95) == [(170, -10, 180.0, 90.0), (-180.0, -10, -160, 90.0)]
    assert K.bbox_ranges(-300, 0, 300, 1) == [(-180.0, 0, 180.0, 1)]


def test_changes_in_order(spark):
    source = spark.createDataFrame([("1", 0, "a"), ('"1"', 1, "b"), (None, 2, "c")], "id string, seq long, tags string")
    add = spark.createDataFrame([("1", 0, "new"), ("2", 1, "two")], source.schema)
    update = spark.createDataFrame([("2", 0, "patched"), ("9", 1, "none")], source.schema)
    new, affected = C.apply_changes(source, add=add, update=update, remove=spark.createDataFrame([("3",)], "id string"))
    assert sorted((r.id or "", r.tags) for r in new.collect()) == [("", "c"), ('"1"', "b"), ("1", "new"), ("2", "patched")]
    assert affected.count() == 5


def test_change_log_stream(spark, tmp_path):
    """Batches that come again are skipped, rows of a batch count in their order, and only touched buckets are written."""
    from tessella.streaming import change_log as S

    folder, columns = f"{tmp_path}/v", "id string, seq long, tags string"
    S.start(spark.createDataFrame([(str(k), k, "a") for k in range(40)] + [(None, 99, "z")], columns), folder, 8)
    log = lambda *rows: spark.createDataFrame(rows, f"op string, {columns}")
    shown = lambda: {r.id: r.tags for r in S.version(spark, folder, S.latest(spark, folder)).collect()}
    for _ in range(2):
        S.apply_batch(folder)(log(("add", "x", 0, "b"), ("remove", "x", 1, None), ("remove", "1", 2, None), ("add", "1", 3, "new"), ("update", "1", 4, "newer"), ("update", "2", 5, "c")), 0)
    want = {str(k): "a" for k in range(40)} | {None: "z", "1": "newer", "2": "c"}
    assert shown() == want and S.latest(spark, folder) == 1
    held = S._manifest(spark, folder, 1)
    assert {v for v in held.values()} == {0, 1} and sum(v == 1 for v in held.values()) <= 3
    S.apply_batch(folder)(log(("add", "y", 0, "lost"), ("remove_all", None, 1, None), ("add", "w", 2, "only")), 1)
    assert shown() == {"w": "only"} and S.version(spark, folder, 1).count() == 41
    S.expire(spark, folder, 1)
    assert shown() == {"w": "only"} and S._versions(spark, folder) == [2]


def test_change_log_as_a_stream(spark, tmp_path):
    from tessella.streaming import change_log as S

    S.start(spark.createDataFrame([("1", 0, "a")], "id string, seq long, tags string"), f"{tmp_path}/v", 4)
    spark.createDataFrame([("add", "2", 0, "b")], "op string, id string, seq long, tags string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("op string, id string, seq long, tags string").parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(S.apply_batch(f"{tmp_path}/v")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert S.version(spark, f"{tmp_path}/v", S.latest(spark, f"{tmp_path}/v")).count() == 2


def test_numbers_of_features_hold_in_late_partitions(spark):
    class Texts:
        """Stands for a table, and gives the function that would run in its tasks."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

    geometry = json.dumps({"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [k, 1]} for k in range(3)]})
    batch = pa.RecordBatch.from_pydict({"at": [(5000 << 33) + 7, (5000 << 33) + 8], "text": [geometry] * 2})
    found = [r for b in read_features(Texts(), numbered=True).run(iter([batch])) for r in b.to_pylist()]
    assert [r["seq"] - (5000 << 33) for r in found] == [0, 1, 2, 3, 4, 5] and [r["feature"] - (5000 << 33) for r in found] == [0, 0, 0, 3, 3, 3]


def test_engine_updates(spark):
    point = lambda i, lon, **p: {"type": "Feature", "id": i, "properties": p, "geometry": {"type": "Point", "coordinates": [lon, 10]}}
    two = {"type": "Feature", "id": 9, "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "Point", "coordinates": [2, 2]}]}}
    options = TileOptions(updateable=True)
    engine = T.TileEngine(_features(spark, point(1, 5, a=1), point(2, 6, a=2), point(3, 179.9, a=3)), options)
    shown = lambda e: [(json.loads(r.value)["id"], round(json.loads(r.value)["geometry"]["coordinates"][0], 6), json.loads(r.value)["properties"]) for r in e.get_data().orderBy("seq").collect()]
    assert shown(engine) == [(1, 5, {"a": 1}), (2, 6, {"a": 2}), (3, 179.9, {"a": 3}), (3, -180.1, {"a": 3})]
    add = read_features(spark.createDataFrame([(json.dumps(f),) for f in (point(9, 50), two)], "value string").coalesce(1), options, numbered=True)
    update = _features(spark, point(3, 7)).withColumn("tags", F.lit(None).cast("string"))
    new, affected = engine.update_data(spark.createDataFrame([("1",)], "id string"), add, update)
    assert shown(new) == [(2, 6, {"a": 2}), (9, 1, {}), (9, 2, {}), (3, 7, {"a": 3})] and affected.count() == 6
    last, _ = new.update_data(good=F.col("id") != "9")
    assert [x[0] for x in shown(last)] == [2, 3] and len(shown(engine)) == 4
    with pytest.raises(ValueError):
        T.TileEngine(engine.source).update_data(remove_all=True)


def test_clusters_fold_any_way(spark):
    points = spark.range(60).select((F.col("id") % 3 * 0.001).alias("lon"), F.lit(1.0).alias("lat"), F.col("id").alias("k"), F.format_string("%02d", "id").alias("name"))
    nodes = K.build_clusters(K.load_points(points, "k"), ClusterOptions(max_zoom=1), "name", fold=max)
    assert [r.total for r in nodes.where("z = 0").collect()] == ["59"]
    joined = K.build_clusters(K.load_points(points, "k"), ClusterOptions(max_zoom=0), "name", fold=lambda a, b: f"{a},{b}")
    assert joined.where("z = 0").first().total == ",".join(f"{k:02d}" for k in range(60))


def test_invalidated_tiles_of_all_features(spark):
    """Each tile of the index against each event, track and box of the whole table."""
    import numpy as np

    from tessella.plans import catalog

    folder = "/root/testdata/sf0.001"
    points = catalog._projected(spark, folder).select("px", "py", "px", "py").toPandas().to_numpy()
    boxes = [rows.select("min_x", "min_y", "max_x", "max_y").toPandas().to_numpy() for rows in (catalog._track_features(spark, folder), catalog._box_features(spark, folder))]
    x0, y0, x1, y1 = np.concatenate([points, *boxes]).T
    m, want = catalog.OPTIONS.margin, set()
    for z in range(catalog.OPTIONS.index_max_zoom + 1):
        n = 1 << z
        for x in range(n):
            for y in range(n):
                if ((x0 < (x + 1 + m) / n) & (x1 >= (x - m) / n) & (y0 < (y + 1 + m) / n) & (y1 >= (y - m) / n)).any():
                    want.add((z, x, y))
    got = [(r.z, r.x, r.y) for r in catalog.queries()["diff_invalidated_tiles_all"](spark, folder).collect()]
    assert set(got) == want and len(got) == len(want) and {z for z, _, _ in got} == set(range(6))
    # Boxes wide enough for the join by ancestors.
    rng = np.random.default_rng(3)
    tiles = spark.createDataFrame([(5, x, y) for x in range(32) for y in range(32)], "z int, x int, y int")
    low, size = rng.uniform(0, 0.5, (3, 2)), rng.uniform(0.3, 0.5, (3, 2)) * [[1, 0.01], [0.01, 1], [0.9, 0.9]]
    wide = np.concatenate([low, low + size], axis=1)
    rows = spark.createDataFrame(wide.tolist(), "min_x double, min_y double, max_x double, max_y double")
    want = {(x, y) for x in range(32) for y in range(32) for a, b, c, d in wide if a < (x + 1 + m) / 32 and c >= (x - m) / 32 and b < (y + 1 + m) / 32 and d >= (y - m) / 32}
    assert {(r.x, r.y) for r in C.invalidated_tiles(tiles, rows, catalog.OPTIONS).collect()} == want


def test_cluster_queries_have_all_levels(spark):
    from tessella.plans import catalog

    rows = catalog.queries()["cluster_nodes"](spark, "/root/testdata/sf0.001").select("z").distinct().collect()
    assert {r.z for r in rows} == set(range(18))


def _brute_levels(points, options):
    """(z, place) -> (x, y, id, points, parent) of every level, by looking at all nodes for each origin. points: (x, y) in order."""
    import numpy as np

    nodes, out = [[float(np.float32(x)), float(np.float32(y)), k, 1, None] for k, (x, y) in enumerate(points)], {}
    for z in range(options.max_zoom, options.min_zoom - 1, -1):
        near = np.array([[float(np.float32(n[0])), float(np.float32(n[1]))] for n in nodes])
        taken, new, reach = np.zeros(len(nodes), bool), [], options.radius / (options.extent * 2**z)
        for k, n in enumerate(nodes):
            if taken[k]:
                continue
            taken[k] = True
            others = np.flatnonzero(~taken & ((near[:, 0] - n[0]) ** 2 + (near[:, 1] - n[1]) ** 2 <= reach * reach)).tolist()
            taken[others] = True
            group = [n, *(nodes[j] for j in others)]
            count = sum(m[3] for m in group)
            if others and count >= options.min_points:
                name = k * 32 + z + 1 + len(points)
                for m in group:
                    m[4] = name
                new.append([sum(m[0] * m[3] for m in group) / count, sum(m[1] * m[3] for m in group) / count, name, count, None])
            else:
                new += [[*m[:4], None] for m in group]
        out |= {(z + 1, k): tuple(n) for k, n in enumerate(nodes)}
        nodes = new
    return out | {(options.min_zoom, k): tuple(n) for k, n in enumerate(nodes)}


@pytest.mark.parametrize("options", [ClusterOptions(), ClusterOptions(min_zoom=2, max_zoom=9, min_points=4, radius=75, extent=256)])
def test_all_levels_against_brute_force(spark, options):
    """Every node of every level over the events; then a tile, a box and a page of leaves from these nodes."""
    from tessella.plans import fixtures as X

    rows = X.points(spark, "/root/testdata/sf0.001").orderBy("id").collect()
    places = [G.project(r.lon, r.lat) for r in rows]
    want = _brute_levels(places, options)
    index = K.ClusterIndex(K.load_points(X.points(spark, "/root/testdata/sf0.001"), "id"), options)
    got = {(r.z, r.idx): r for r in index.nodes.collect()}
    assert got.keys() == want.keys()
    for key, (x, y, name, count, parent) in want.items():
        r = got[key]
        assert (r.id, r.num_points, r.parent_id) == (name, count, parent) and r.x == pytest.approx(x, abs=1e-12) and r.y == pytest.approx(y, abs=1e-12)

    z, x, y, p = 3, 0, 4, options.radius / options.extent
    tile = set()
    for (level, k), n in want.items():
        if level == z:
            px, py = places[n[2]] if n[3] == 1 else n[:2]
            for tx, lo, hi in ((x, (x - p) / 8, (x + 1 + p) / 8), (8, 1 - p / 8, 1.0)):
                if lo <= float(pd.Series([n[0]], dtype="float32")[0]) <= hi and (y - p) / 8 <= float(pd.Series([n[1]], dtype="float32")[0]) <= (y + 1 + p) / 8:
                    tile.add((k, int((options.extent * (px * 8 - tx) + 0.5) // 1), int((options.extent * (py * 8 - y) + 0.5) // 1)))
    assert {(r.idx, r.tx, r.ty) for r in index.get_tile(z, x, y).collect()} == tile and tile

    def below(name):
        for (_, _), n in sorted(((k, n) for k, n in want.items() if n[4] == name)):
            yield from [n[2]] if n[3] == 1 else below(n[2])

    top = max((n for (level, _), n in want.items() if level == options.min_zoom), key=lambda n: n[3])
    assert [r.point for r in index.leaves(top[2], 1000).collect()] == list(below(top[2]))
    assert [r.point for r in index.leaves(top[2], 4, 3).collect()] == list(below(top[2]))[3:7]
    assert [r.idx for r in index.children(top[2]).collect()] == sorted(k for (_, k), n in want.items() if n[4] == top[2])


def test_importance_against_recursion():
    """The farthest vertex between two kept ones, the nearest to the middle among equals, down to the tolerance."""
    import random

    def walk(points, first, last, tolerance, out):
        far = [(G.squared_distance(points[i], points[first], points[last]), i) for i in range(first + 1, last)]
        best = max((d for d, _ in far), default=0)
        if best > tolerance:
            i = min((i for d, i in far if d == best), key=lambda i: (abs(2 * i - first - last), i))
            out[i] = best
            walk(points, first, i, tolerance, out)
            walk(points, i, last, tolerance, out)

    rng = random.Random(4)
    for n in (2, 3, 10, 60):
        points = [(rng.random(), rng.random()) for _ in range(n)]
        out = [1.0] + [0.0] * (n - 2) + [1.0]
        walk(points, 0, n - 1, 0.01, out)
        assert G.importance(points, 0.01) == out


def test_one_shot_lines_against_brute_force(spark):
    """Whole lines in a tile: the vertices of the tracks that the band's edges leave, in order, without simplification."""
    from tessella.plans import catalog

    features = catalog._track_features(spark, "/root/testdata/sf0.001", TileOptions(tolerance=0))
    z, x, y, m = 3, 4, 3, 64 / 4096
    inside = {}
    for r in features.collect():
        xyz = r.paths[0].xyz
        held = [(a, b) for a, b in zip(xyz[::3], xyz[1::3], strict=True)]
        if all((x - m) / 8 <= a < (x + 1 + m) / 8 and (y - m) / 8 <= b < (y + 1 + m) / 8 for a, b in held):
            inside[r.id] = [[int((4096 * (a * 8 - x) + 0.5) // 1), int((4096 * (b * 8 - y) + 0.5) // 1)] for a, b in held]
    rows = {r.id: [list(v) for v in r.geometry[0]] for r in T.single_tile(features, z, x, y, TileOptions(clip=True, tolerance=0)).collect()}
    assert inside and {k: rows[k] for k in inside} == inside


def test_a_wide_feature_is_given_out_in_parts(spark):
    """The rows of one feature that covers the world leave a task in batches of FLUSH."""
    world = {"type": "Polygon", "coordinates": [[[-180, -85], [180, -85], [180, 85], [-180, 85], [-180, -85]]]}
    rows = T.tile_features(_features(spark, world), TileOptions(), 6)
    assert rows.groupBy("z").count().orderBy("z").collect() == [(z, 4**z) for z in range(7)]


def test_records_and_generated_ids(spark):
    points = spark.range(30).select((F.col("id") % 3 * 40.0).alias("lon"), F.lit(1.0).alias("lat"), F.col("id").alias("k"), F.struct(F.lit(1).cast("long").alias("n"), F.col("id").cast("double").alias("most")).alias("record"))
    loaded = K.load_points(points, "k")
    fold = lambda a, b: {"n": a["n"] + b["n"], "most": max(a["most"], b["most"])}
    index = K.ClusterIndex(loaded, ClusterOptions(min_zoom=3, max_zoom=4, generate_id=True), "record", fold)
    rows = K.cluster_columns(index.nodes.where("z = 3"), index.points).orderBy("idx").collect()
    assert [(r.total.n, r.total.most, json.loads(r.tags)["most"]) for r in rows] == [(10, 27.0, 27.0), (10, 28.0, 28.0), (10, 29.0, 29.0)]
    assert {r.feature_id for r in index.get_tile(5, 16, 15).where("num_points = 1").collect()} == {str(k) for k in range(0, 30, 3)}


def test_tile_json(spark):
    line = {"type": "Feature", "id": "l", "properties": {"n": 1.5, "s": 'a"b'}, "geometry": _line((0, 0), (30, 10), (60, 0))}
    options = TileOptions(line_metrics=True)
    rows = T.feature_json(T.TileEngine(_features(spark, line, options=options), options).tiles(0), "my_").collect()
    assert [json.loads(r.value) for r in rows] == [{"type": 2, "geometry": [[[2048, 2048], [2389, 1934], [2731, 2048]]], "tags": {"n": 1.5, "s": 'a"b', "my_clip_start": 0, "my_clip_end": 1}, "id": "l"}]


@pytest.mark.parametrize("reach", [40 / 512 / 2**24, 1e-9 / 512 / 64])
def test_blocks_of_a_tiny_radius_are_few_for_each_node(spark, reach):
    """However small the radius, a node is in its own block and at most in those beside it, and blocks share groups."""
    nodes = spark.range(2000).selectExpr("id AS idx", "CAST(CAST((id * 7919 % 2003) / 2003 AS FLOAT) AS DOUBLE) AS x", "CAST(CAST((id * 104729 % 1999) / 1999 AS FLOAT) AS DOUBLE) AS y")
    rows = K._in_blocks(nodes, reach, 3)
    assert rows.where("own").count() == 2000 and rows.count() < 2200
    assert {r[0] for r in rows.select("group").distinct().collect()} <= {0, 1, 2}
    assert K.assigned(nodes, reach) is None  # nobody is near another


def test_places_of_a_tiny_radius_go_with_their_first_node(spark):
    nodes = spark.range(600).selectExpr("id AS idx", "CAST(CAST((id % 7) / 9 AS FLOAT) AS DOUBLE) AS x", "CAST(CAST((id % 7) / 11 AS FLOAT) AS DOUBLE) AS y")
    assert {(r.idx, r.origin) for r in K.assigned(nodes, 1e-9 / 512 / 64).collect()} == {(k, k % 7) for k in range(600)}


def test_levels_that_stay_are_the_next_ones(spark):
    """Points of one lattice, clustered by blocks at no zoom but the last: the levels between are equal, and the result is that of one task."""
    points = K.load_points(spark.range(400).selectExpr("id", "(id % 20) * 10.0D - 95 AS lon", "floor(id / 20) * 4.0D - 40 AS lat", "1.0D AS value"), "id")
    at = ClusterOptions(min_zoom=2, max_zoom=4)
    one, split = ({(r.z, r.idx): (r.id, r.parent_id, r.num_points, r.point, r.total) for r in K.build_clusters(points, at, "value", one_task=n).collect()} for n in (1000, 0))
    assert one == split and len({k for k in one if k[0] == 3}) == 400 > len({k for k in one if k[0] == 2})


def test_lines_that_touch_the_upper_bound():
    """A closed band keeps the vertex at its upper bound, a half-open one does not; a lone vertex is as in a half-open one."""
    beyond = G.Shape("LineString", [G.Path([(0.7, 0, 1), (0.6, 1, 1), (0.8, 2, 1)], 3.0, 0.0, 3.0)])
    for metrics in (False, True):
        assert G.clip(beyond, 0.4, 0.6, 0, metrics) == []
        assert [len(p.points) for s in G.clip(beyond, 0.4, 0.6, 0, metrics, closed=True) for p in s.paths] == [2]
    lone = G.Shape("LineString", [G.Path([(0.6, 0, 1)])])
    assert G.clip(lone, 0.4, 0.6, 0, True, closed=True) == []


@pytest.mark.parametrize("name", ["line_axis_clip", "line_metrics", "multiline_clip"])
def test_clipped_lines_that_touch_a_bound(spark, tmp_path, name):
    """A customer one of whose orders lies at 36 degrees, the upper bound, and the others beyond it."""
    from oracle import connect, differences

    from tessella.plans import catalog

    con = connect("/root/nowhere")
    orders = [(848962, "1995-05-03"), (819476, "1995-07-14"), (873420, "1996-08-25"), (760035, "1996-09-02")]  # the third is at 36 degrees
    rows = ", ".join(f"({k}::BIGINT, 77942::BIGINT, 'O', 1.0::DOUBLE, TIMESTAMP '{day}', '1')" for k, day in orders)
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    frame = catalog.queries()[name](spark, str(tmp_path))
    assert frame.count() == 1 and differences(frame, connect(str(tmp_path)), catalog.oracle_sql()[name]) == ""


def test_ranges_of_reached_tiles_are_few(spark, monkeypatch):
    """Many points in few tiles are few rows before they meet the tiles, and these are the tiles of brute force."""
    seen = []
    keep = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    points = spark.range(5000).selectExpr("0.3D + id * 1e-6D AS min_x", "0.6D AS min_y", "0.3D + id * 1e-6D AS max_x", "0.6D AS max_y")
    tiles = spark.range(64).selectExpr("3 AS z", "CAST(id % 8 AS INT) AS x", "CAST(floor(id / 8) AS INT) AS y")
    assert [(r.z, r.x, r.y) for r in C.invalidated_tiles(tiles, points).collect()] == [(3, 2, 4)]
    assert [df.count() for df in seen] == [1]


def test_single_points_take_the_short_way():
    """The quadtree of a single point, and its rows from GeoJSON, are those of any shape."""
    from tessella.operators.tiles import _TILE, _point_rows, _row
    from tessella.sources.geojson import point_of, points_batch, shape_row

    options = TileOptions()
    for lon, lat in ((0.0, 0.0), (-180.0, 85.0), (179.99, -60.0), (45.0, 66.51326044311186), (90.001, -0.001)):
        data = {"type": "Feature", "id": "a", "properties": {"k": [1, "ä"]}, "geometry": {"type": "Point", "coordinates": [lon, lat]}}
        [(_, key, tags, shape)] = features_of(data, options)
        point = point_of(data, options)
        row = {"seq": 7, "id": key, "tags": tags, **shape_row(shape), "feature": 7}
        assert points_batch([7], *([v] for v in point)).to_pylist() == [row]
        held = [(z, x, y, s) for z, x, y, [s] in G.quadtree([shape], options.margin, False, 4)]
        assert set(G.point_quadtree(*point[2:], options.margin, 4)) == {t[:3] for t in held}
        want = pa.RecordBatch.from_pylist([{"seq": 7, "part": 0, "id": key, "tags": tags, **_row(s, z, x, y, options)} for z, x, y, s in held], schema=_TILE)
        assert _point_rows([(z, x, y, 7, key, tags, *point[2:]) for z, x, y, _ in held], options.extent).to_pylist() == want.to_pylist()
