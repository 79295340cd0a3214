"""Hierarchical greedy clustering of points, level by level, and navigation.

At one zoom the origins of clusters are those nodes, in array order, that no earlier origin is near; an origin takes all nodes near it that no earlier one took. Neighbours are visited in array order, bounds are inclusive.
A level of up to ONE_TASK nodes is one task. A larger one is cut in square blocks of SIDE times the radius, each with the nodes of its neighbours that are near its edge. Blocks are dealt to as many groups as
hold GROUP nodes each, since there are as many blocks as nodes where the radius is small. A group decides in order what it can: a node waits while an earlier one near it is undecided; what waits for another
group is decided in the next round. So a task is bounded by a group and a block, whatever hangs together. A level in which nobody is near another is the next one as it is.

nodes: z, idx (place in the level), x, y, id (cluster id, or the point's index), parent_id, num_points, point (source row of a single point, else null), total (the mapped values, folded: by default their sum).
x and y are 32-bit floats of single points, as the search sees them; what is shown of a single point comes from its own row: px and py in full, id and tags.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projection import abbreviated, origin_index, origin_zoom, project_x, project_y, unproject_x, unproject_y
from ..options import ClusterOptions
from ..storage import drop_stored, partitions, small_or_not, stored

#: Levels of at most so many nodes are one task. Both ways give the same nodes, but for the last digit of a mean.
ONE_TASK, SIDE = 200_000, 256
#: Nodes of a group of blocks, about, and the least radius that counts for the side of a block: far below it the margin of single precision would span many blocks.
GROUP, LEAST_REACH = 20_000, 1e-6


def dense_index(df: DataFrame, *order) -> DataFrame:
    """df with idx, from 0 in this order: sorted by ranges, so that no single task holds the table."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "indexed")
    counts = dict(ranged.groupBy("p").count().collect())  # a row for each partition
    starts = dict(zip(sorted(counts), np.cumsum([0, *(counts[p] for p in sorted(counts))])[:-1].tolist(), strict=True))
    if not starts:
        return ranged.withColumn("idx", F.lit(0).cast("long")).drop("p", "at")
    return ranged.withColumn("idx", F.col("at") + F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in starts.items() for v in kv]), F.col("p").cast("long"))).drop("p", "at")


def load_points(points: DataFrame, *order) -> DataFrame:
    """Level max_zoom + 1 from (lon, lat, value) in this order: px, py, and x, y as 32-bit floats; rows without finite coordinates go."""
    rows = dense_index(points.where("abs(lon) < double('infinity') and abs(lat) < double('infinity')"), *order)
    return _rounded(rows.select("*", project_x(F.col("lon")).alias("px"), project_y(F.col("lat")).alias("py")))


def feature_points(features: DataFrame) -> DataFrame:
    """The same from features (sources.geojson): their single points, world copies among them, with id and tags, in order of seq."""
    at = lambda k: F.col("paths")[0]["xyz"][k]
    rows = features.where("kind = 'Point'").select("seq", "id", "tags", at(0).alias("px"), at(1).alias("py"))
    return _rounded(dense_index(rows, "seq").withColumnRenamed("id", "feature_id"))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[F.col(f"p{c}").cast("float").cast("double").alias(c) for c in "xy"])


def near_pairs(level: DataFrame, reach: float) -> DataFrame:
    """(a, b): idx of a node and of another within reach, by a join of grid cells with their neighbours."""
    cell = lambda c: F.floor(c / reach).cast("long")
    left = level.select(F.col("idx").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    around = F.explode(F.array(*[F.struct((cell(F.col("x")) + i).alias("cx"), (cell(F.col("y")) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")
    right = level.select(F.col("idx").alias("b"), F.col("x").cast("float").cast("double").alias("bx"), F.col("y").cast("float").cast("double").alias("by"), around).select("b", "bx", "by", "c.*")
    pairs = left.join(right, ["cx", "cy"]).where("a <> b")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return pairs.where(dx * dx + dy * dy <= reach * reach).select("a", "b")


def _around(x: np.ndarray, y: np.ndarray, fx: np.ndarray, fy: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lo, hi): targets sorted by grid cell, and for each origin three ranges of that order that hold all targets within reach."""
    key = lambda cx, cy: (cx + (1 << 30)) * (1 << 32) + (cy + (1 << 30))
    cell = lambda v: np.floor(v / max(reach, 1e-8)).astype(np.int64)  # noqa: E731  larger cells hold all within reach too, and their numbers fit the key
    keys = key(cell(fx), cell(fy))
    order = np.argsort(keys, kind="stable")
    keys, cx, cy = keys[order], cell(x), cell(y)
    lo = np.stack([np.searchsorted(keys, key(cx + i, cy - 1), "left") for i in (-1, 0, 1)])
    hi = np.stack([np.searchsorted(keys, key(cx + i, cy + 1), "right") for i in (-1, 0, 1)])
    return order, lo, hi


def greedy(nodes: pd.DataFrame, reach: float, zoom: int, points: int, min_points: int, fold: Callable = operator.add) -> tuple[list[tuple], dict[int, int]]:
    """Of one component, sorted by idx: nodes of the next level in order, as (x, y, id, num_points, point, total, origin, place), and the id of the cluster that each absorbed idx got."""
    idx, x, y, num = (nodes[c].to_numpy() for c in ("idx", "x", "y", "num_points"))
    ids, point, total = nodes["id"].tolist(), nodes["point"].tolist(), nodes["total"].tolist()
    fx, fy = (v.astype(np.float32).astype(np.float64) for v in (x, y))
    order, lo, hi = _around(x, y, fx, fy, reach)
    crowded = (hi - lo).sum(axis=0) > 1
    seen = np.zeros(len(idx), dtype=bool)
    out, parents = [], {}

    def same(k: int, origin: int, place: int) -> tuple:
        return (x[k], y[k], ids[k], num[k], None if num[k] > 1 else point[k], total[k], idx[origin], place)

    for i in range(len(idx)):
        if seen[i]:
            continue
        seen[i] = True
        if not crowded[i]:  # nobody is near
            out.append(same(i, i, 0))
            continue
        near = np.concatenate([order[lo[k, i] : hi[k, i]] for k in range(3)])
        near = near[~seen[near]]
        near = np.sort(near[(fx[near] - x[i]) ** 2 + (fy[near] - y[i]) ** 2 <= reach * reach])
        group = [i, *near.tolist()]
        seen[near] = True
        weight = [int(n) for n in num[group]]
        if len(group) > 1 and sum(weight) >= min_points:
            key = (int(idx[i]) << 5) + zoom + 1 + points
            parents |= dict.fromkeys(idx[group].tolist(), key)
            mean = lambda v: sum(a * n for a, n in zip(v[group].tolist(), weight, strict=True)) / sum(weight)  # noqa: B023, E731
            out.append((mean(x), mean(y), key, sum(weight), None, reduce(fold, (total[k] for k in group)), idx[i], 0))
        else:
            out += [same(k, i, place) for place, k in enumerate(group)]
    return out, parents


_MADE = ("x", "y", "id", "num_points", "point", "total", "origin", "place")


def _component_kernel(reach: float, zoom: int, points: int, min_points: int, fold: Callable):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made, parents = greedy(pdf.sort_values("idx"), reach, zoom, points, min_points, fold)
        rows = [(*m, None, k) for k, m in enumerate(made)] + [(None,) * 6 + (origin, None, parent, None) for origin, parent in parents.items()]
        frame = pd.DataFrame(rows, columns=[*_MADE, "parent", "idx"], dtype=object)
        return frame.astype({"x": "float64", "y": "float64"} | {k: "Int64" for k in ("id", "num_points", "point", "origin", "place", "parent", "idx")})

    return run


UNDECIDED, ORIGIN, TAKEN = 0, 1, 2


def decide(x: np.ndarray, y: np.ndarray, state: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
    """state of a block's nodes, in array order, with the undecided ones of its own decided where no undecided earlier node is near."""
    fx, fy = (v.astype(np.float32).astype(np.float64) for v in (x, y))
    order, lo, hi = _around(fx, fy, x, y, reach)  # of a target the origins around it
    crowded, state = (hi - lo).sum(axis=0) > 1, state.copy()
    state[own & (state == UNDECIDED) & ~crowded] = ORIGIN
    for i in np.flatnonzero(own & (state == UNDECIDED)):
        near = np.concatenate([order[lo[k, i] : hi[k, i]] for k in range(3)])
        near = near[near < i]
        near = state[near[(fx[i] - x[near]) ** 2 + (fy[i] - y[near]) ** 2 <= reach * reach]]
        state[i] = TAKEN if (near == ORIGIN).any() else UNDECIDED if (near == UNDECIDED).any() else ORIGIN
    return state


def owners(idx: np.ndarray, x: np.ndarray, y: np.ndarray, state: np.ndarray, reach: float) -> np.ndarray:
    """Of each taken node the idx of the first origin near it, of others their own."""
    fx, fy = (v.astype(np.float32).astype(np.float64) for v in (x, y))
    order, lo, hi = _around(fx, fy, x, y, reach)
    out = idx.copy()
    for i in np.flatnonzero(state == TAKEN):
        near = np.concatenate([order[lo[k, i] : hi[k, i]] for k in range(3)])
        near = near[(near < i) & (state[near] == ORIGIN)]
        near = near[(fx[i] - x[near]) ** 2 + (fy[i] - y[near]) ** 2 <= reach * reach]
        out[i] = idx[near.min()] if len(near) else -1
    return out


def _in_blocks(nodes: DataFrame, reach: float, groups: int) -> DataFrame:
    """nodes in the group of their own block (own) and in those of the blocks whose edge they are near; there may be several of these in a group."""
    side, m = SIDE * max(reach, LEAST_REACH), 1.01 * reach + 1e-6
    span = lambda c: F.sequence(F.floor((F.col(c) - m) / side), F.floor((F.col(c) + m) / side))
    rows = nodes.withColumn("bx", F.explode(span("x"))).withColumn("by", F.explode(span("y")))
    rows = rows.withColumn("own", (F.col("bx") == F.floor(F.col("x") / side)) & (F.col("by") == F.floor(F.col("y") / side)))
    return rows.withColumn("group", F.pmod(F.hash("bx", "by"), F.lit(groups))).drop("bx", "by")


def _once(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a group in array order, each once."""
    return pdf.sort_values(["idx", "own"]).drop_duplicates("idx", keep="last")


def assigned(level: DataFrame, reach: float) -> DataFrame | None:
    """(idx, origin) of each node of a level, block by block; None where each node is its own origin. Nodes of one place go with the first of them, if that place is near itself in single precision."""
    off = lambda c: F.col(c) - F.col(c).cast("float").cast("double")
    alone = F.when(off("x") * off("x") + off("y") * off("y") <= reach * reach, F.lit(-1).cast("long")).otherwise(F.col("idx"))
    level = level.select("idx", "x", "y", alone.alias("alone"))
    state = stored(level.groupBy("x", "y", "alone").agg(F.min("idx").alias("idx")).select("idx", "x", "y", "alone", F.lit(UNDECIDED).alias("state")), "state")
    places = state.count()
    groups = max(partitions(level.sparkSession), -(-places // GROUP))

    def round_(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _once(pdf)
        new = decide(*(pdf[c].to_numpy() for c in ("x", "y", "state", "own")), reach)
        return pdf.assign(state=new)[pdf["own"]][["idx", "x", "y", "alone", "state"]]

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _once(pdf)
        origin = owners(*(pdf[c].to_numpy() for c in ("idx", "x", "y", "state")), reach)
        return pdf.assign(origin=origin)[pdf["own"]][["x", "y", "alone", "origin"]]

    left = places
    while left:
        new = stored(_in_blocks(state, reach, groups).groupBy("group").applyInPandas(round_, "idx long, x double, y double, alone long, state int"), "state")
        drop_stored(state)
        state, found = new, {r.state: r.n for r in new.groupBy("state").agg(F.count("*").alias("n")).collect()}
        left = found.get(UNDECIDED, 0)
    if places and not found.get(TAKEN) and places == level.count():
        drop_stored(state)
        return None
    owned = stored(_in_blocks(state, reach, groups).groupBy("group").applyInPandas(last, "x double, y double, alone long, origin long"), "owned")
    drop_stored(state)
    return level.join(owned, ["x", "y", "alone"]).select("idx", "origin")


def _next_level(level: DataFrame, reach: float, z: int, points: int, options: ClusterOptions, fold: Callable | None, kind: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes with origin and place, (o, parent)) of a level that is larger than one task; None where it stays as it is."""
    origins = assigned(level, reach)
    if origins is None:
        return None
    rows = stored(level.join(origins.withColumnRenamed("idx", "i"), F.col("idx") == F.col("i")).drop("i"), "assigned")
    exact = lambda c: F.sum((F.col(c) * F.col("num_points")).cast("decimal(38,18)"))  # noqa: E731  the same whatever the order
    sums = rows.groupBy("origin").agg(F.count("*").alias("members"), F.sum("num_points").alias("n"), exact("x").alias("sx"), exact("y").alias("sy"), *([] if fold else [F.sum("total").alias("t")]))
    sums = stored(sums.where((F.col("members") > 1) & (F.col("n") >= options.min_points)).withColumnRenamed("origin", "g"), "clusters")
    mean = lambda c: (F.col(c).cast("double") / F.col("n")).alias(c[1])
    name = (F.shiftleft("g", 5) + F.lit(z + 1 + points)).alias("id")
    if fold:
        folded = lambda pdf: pd.DataFrame({"h": pdf["origin"].iloc[:1], "t": pd.Series([reduce(fold, pdf.sort_values("idx")["total"].tolist())], dtype=object, index=pdf.index[:1])})
        totals = rows.join(sums.select("g"), F.col("origin") == F.col("g"), "left_semi").groupBy("origin").applyInPandas(folded, f"h long, t {kind}")
        sums = stored(sums.join(totals, F.col("g") == F.col("h")), "folded")
    none = F.lit(None).cast("long")
    made = sums.select(mean("sx"), mean("sy"), name, F.col("n").alias("num_points"), none.alias("point"), F.col("t").alias("total"), F.col("g").alias("origin"), F.lit(0).cast("long").alias("place"))
    # Groups too small for a cluster have fewer than min_points nodes, so their window is bounded.
    small = rows.join(sums.select("g"), F.col("origin") == F.col("g"), "left_anti")
    small = small.withColumn("place", F.row_number().over(Window.partitionBy("origin").orderBy("idx")).cast("long") - 1)
    parents = rows.select("idx", "origin").join(sums.select("g", name), F.col("origin") == F.col("g")).select(F.col("idx").alias("o"), F.col("id").alias("parent"))
    return made.unionByName(small.select(*made.columns)), parents


def build_clusters(points: DataFrame, options: ClusterOptions = ClusterOptions(), value: str | None = None, one_task: int = ONE_TASK, fold: Callable | None = None) -> DataFrame:
    """nodes of all levels from load_points() rows; `total` sums the column `value`, or counts points.

    fold(accumulated, next) -> accumulated replaces the sum: it starts from the value of a cluster's origin and takes its neighbours in array order; the column keeps its type: a number, a text, or a
    struct, which comes as a dict and is a record of several accumulators.
    """
    total = points.count()
    kind = points.schema[value].dataType.simpleString() if fold and value else "double"
    none = F.lit(None).cast("long")
    level = points.select("idx", "x", "y", F.col("idx").alias("id"), F.lit(1).cast("long").alias("num_points"), F.col("idx").alias("point"), (F.col(value).cast(kind) if value else F.lit(1.0)).alias("total"))
    level, levels, few = stored(level, "level"), [], False
    columns = ["idx", "x", "y", "id", "num_points", "point", "total"]
    for z in range(options.max_zoom, options.min_zoom - 1, -1):
        reach = options.reach(z)
        few = few or level.limit(one_task + 1).count() <= one_task  # levels never grow
        if few:
            kernel = _component_kernel(reach, z, total, options.min_points, fold or operator.add)
            made = stored(level.withColumn("task", F.lit(0)).groupBy("task").applyInPandas(kernel, f"x double, y double, id long, num_points long, point long, total {kind}, origin long, place long, parent long, idx long"), "made")
            parents, new = made.where("parent is not null").select(F.col("origin").alias("o"), "parent"), made.where("parent is null").select(*columns)
        else:
            made = _next_level(level, reach, z, total, options, fold, kind)
            if made is None:
                levels.append(level.select(F.lit(z + 1).alias("z"), "idx", "x", "y", "id", none.alias("parent_id"), "num_points", "point", "total"))
                continue
            new, parents = made
            parents, new = stored(parents, "parents"), stored(dense_index(new, "origin", "place").select(*columns), "level")
        levels.append(level.join(small_or_not(parents), F.col("idx") == F.col("o"), "left").select(F.lit(z + 1).alias("z"), "idx", "x", "y", "id", F.col("parent").alias("parent_id"), "num_points", "point", "total"))
        level = new
    out = level.select(F.lit(options.min_zoom).alias("z"), "idx", "x", "y", "id", none.alias("parent_id"), "num_points", "point", "total")
    for one in reversed(levels):
        out = out.unionByName(one)
    return out


def shown(nodes: DataFrame, points: DataFrame, generate_id: bool = False) -> DataFrame:
    """nodes with px, py, feature_id and tags: of clusters their mean, id and properties; of single points all that their rows in points have (feature_id and tags: JSON, where there are any).

    With generate_id a single point's id is its index.
    """
    own = points.select(F.col("idx").alias("q"), F.col("px").alias("own_x"), F.col("py").alias("own_y"), *[(F.col(c) if c in points.columns else F.lit(None)).cast("string").alias(f"own_{c}") for c in ("feature_id", "tags")])
    is_cluster, total = F.col("num_points") > 1, dict(nodes.dtypes)["total"]
    properties = F.struct(F.lit(True).alias("cluster"), F.col("id").alias("cluster_id"), F.col("num_points").alias("point_count"), abbreviated(F.col("num_points")).alias("point_count_abbreviated"))
    tags = F.to_json(properties)
    if total.startswith("struct"):  # a record's fields are properties of their own
        tags = F.concat(F.expr("left(to_json(total), length(to_json(total)) - 1)"), F.lit(","), F.substring(tags, 2, 1 << 20))
    rows = nodes.join(own, F.col("point") == F.col("q"), "left")
    number = F.col("id").cast("string")
    return rows.select(
        *nodes.columns,
        F.coalesce("own_x", "x").alias("px"),
        F.coalesce("own_y", "y").alias("py"),
        F.when(is_cluster | F.lit(generate_id), number).otherwise(F.col("own_feature_id")).alias("feature_id"),
        F.when(is_cluster, tags).otherwise(F.col("own_tags")).alias("tags"),
    )


def cluster_columns(nodes: DataFrame, points: DataFrame, generate_id: bool = False) -> DataFrame:
    """Nodes as map features: position in degrees, and the properties of clusters."""
    is_cluster = F.col("num_points") > 1
    rows = shown(nodes, points, generate_id)
    return rows.select("z", "idx", "id", unproject_x(F.col("px")).alias("lon"), unproject_y(F.col("py")).alias("lat"), is_cluster.alias("cluster"), F.when(is_cluster, F.col("id")).alias("cluster_id"), "num_points", abbreviated(F.col("num_points")).alias("point_count_abbreviated"), "point", "total", "feature_id", "tags")


def cluster_geojson(columns: DataFrame) -> DataFrame:
    """(z, idx, value): rows of cluster_columns as GeoJSON features."""
    text = lambda c: F.coalesce(c, F.lit("null"))
    own = F.when(F.col("feature_id").isNotNull(), F.concat(F.lit('"id":'), "feature_id", F.lit(","))).otherwise(F.lit(""))
    at = F.to_json(F.array("lon", "lat"))
    return columns.select("z", "idx", F.concat(F.lit('{"type":"Feature",'), own, F.lit('"properties":'), text(F.col("tags")), F.lit(',"geometry":{"type":"Point","coordinates":'), at, F.lit("}}")).alias("value"))


def bbox_ranges(west: float, south: float, east: float, north: float) -> list[tuple[float, float, float, float]]:
    """Longitude ranges of a box: one, or two where it crosses the date line; latitudes clamped."""
    lo, hi = max(-90.0, min(90.0, south)), max(-90.0, min(90.0, north))
    turn = lambda v: v - 360 * floor((v + 180) / 360)
    w, e = turn(west), 180.0 if east == 180 else turn(east)
    if east - west >= 360:
        return [(-180.0, lo, 180.0, hi)]
    return [(w, lo, 180.0, hi), (-180.0, lo, e, hi)] if w > e else [(w, lo, e, hi)]


def get_clusters(nodes: DataFrame, points: DataFrame, bbox: tuple[float, float, float, float], zoom: float, options: ClusterOptions = ClusterOptions()) -> DataFrame:
    rows = nodes.where(F.col("z") == options.clamp(zoom))
    inside = F.lit(False)
    for w, s, e, n in bbox_ranges(*bbox):
        x = F.col("x").cast("float").cast("double").between(project_x(F.lit(w)), project_x(F.lit(e)))
        inside = inside | (x & F.col("y").cast("float").cast("double").between(project_y(F.lit(n)), project_y(F.lit(s))))
    return cluster_columns(rows.where(inside), points, options.generate_id)


def cluster_tile(nodes: DataFrame, points: DataFrame, z: int, x: int, y: int, options: ClusterOptions = ClusterOptions()) -> DataFrame:
    """copy, idx, id, num_points, point, tx, ty, feature_id, tags of the nodes in a tile with its margin; at the edges of the world copies from the other side come too."""
    level, scale, p = nodes.where(F.col("z") == options.clamp(z)), 2.0**z, options.radius / options.extent
    top, bottom = (y - p) / scale, (y + 1 + p) / scale
    ranges = [((x - p) / scale, (x + 1 + p) / scale, x)]
    ranges += [(1 - p / scale, 1.0, 1 << z)] if x == 0 else []
    ranges += [(0.0, p / scale, -1)] if x == (1 << z) - 1 else []
    single = lambda c: F.col(c).cast("float").cast("double")
    copies = F.filter(F.array(*[F.struct(F.lit(k).alias("copy"), F.lit(float(at)).alias("at"), single("x").between(lo, hi).alias("inside")) for k, (lo, hi, at) in enumerate(ranges)]), lambda c: c["inside"])
    rows = level.where(single("y").between(top, bottom)).withColumn("c", F.explode(copies)).select("*", "c.copy", "c.at").drop("c")
    unit = lambda v, t: F.floor(F.lit(float(options.extent)) * (F.col(v) * scale - t) + 0.5).cast("int")
    return shown(rows, points, options.generate_id).select("copy", "idx", "id", "num_points", "point", unit("px", F.col("at")).alias("tx"), unit("py", F.lit(float(y))).alias("ty"), "feature_id", "tags")


def expansion_zoom(cluster: int, points: int) -> int:
    return (cluster - points) % 32


def children(nodes: DataFrame, cluster: int, points: int) -> DataFrame:
    """The nodes one level below a cluster, in order. points: how many there are. Raises ValueError if there are none."""
    found = nodes.where((F.col("z") == expansion_zoom(cluster, points)) & (F.col("parent_id") == cluster))
    if found.isEmpty():
        raise ValueError("no cluster with the specified id")
    return found.orderBy("idx")


def leaves(nodes: DataFrame, cluster: int, points: int, limit: int | None = 10, offset: int = 0) -> DataFrame:
    """Single points below a cluster, depth first; a limit of 0 or None is 10."""
    level = children(nodes, cluster, points).select("id", "num_points", "point", "x", "y", F.array("idx").alias("path"))
    done = level.where("num_points = 1")
    open_ = level.where("num_points > 1")
    while not open_.isEmpty():
        below = nodes.select(F.col("id").alias("i"), F.col("parent_id").alias("p"), F.col("z").alias("zz"), F.col("num_points").alias("n"), F.col("point").alias("q"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("idx").alias("at"))
        found = open_.join(below, (F.col("id") == F.col("p")) & (F.col("zz") == origin_zoom(F.col("id"), F.lit(points)))).select(F.col("i").alias("id"), F.col("n").alias("num_points"), F.col("q").alias("point"), F.col("u").alias("x"), F.col("v").alias("y"), F.concat("path", F.array("at")).alias("path"))
        found = stored(found, "leaves")
        done, open_ = done.unionByName(found.where("num_points = 1")), found.where("num_points > 1")
    return done.orderBy("path").offset(offset).limit(limit or 10)


class ClusterIndex:
    """Clusters over loaded points (load_points or feature_points), and all that can be asked of them."""

    def __init__(self, points: DataFrame, options: ClusterOptions = ClusterOptions(), value: str | None = None, fold: Callable | None = None):
        self.options, self.points = options, stored(points, "points")
        self.count = self.points.count()
        self.nodes = stored(build_clusters(self.points, options, value, fold=fold), "nodes")

    def get_tile(self, z: int, x: int, y: int) -> DataFrame:
        return cluster_tile(self.nodes, self.points, z, x, y, self.options)

    def get_clusters(self, bbox: tuple[float, float, float, float], zoom: float) -> DataFrame:
        return get_clusters(self.nodes, self.points, bbox, zoom, self.options)

    def expansion_zoom(self, cluster: int) -> int:
        return expansion_zoom(cluster, self.count)

    def children(self, cluster: int) -> DataFrame:
        return cluster_columns(children(self.nodes, cluster, self.count), self.points, self.options.generate_id).orderBy("idx")

    def leaves(self, cluster: int, limit: int | None = 10, offset: int = 0) -> DataFrame:
        """point, path, lon, lat, feature_id, tags of the single points, in order of their paths."""
        rows = leaves(self.nodes, cluster, self.count, limit, offset)
        own = self.points.select(F.col("idx").alias("q"), unproject_x(F.col("px")).alias("lon"), unproject_y(F.col("py")).alias("lat"), *[(F.col(c) if c in self.points.columns else F.lit(None).cast("string")).alias(c) for c in ("feature_id", "tags")])
        return rows.join(own, F.col("point") == F.col("q")).select("point", "path", "lon", "lat", "feature_id", "tags").orderBy("path")


__all__ = ["ClusterIndex", "cluster_geojson", "feature_points", "greedy", "shown", "build_clusters", "children", "cluster_columns", "cluster_tile", "dense_index", "expansion_zoom", "get_clusters", "leaves", "load_points", "near_pairs", "origin_index"]
