"""GeoJSON texts to features and back.

features: seq long, id string (canonical JSON: 1 and "1" differ), tags string (JSON) and the geometry: kind string, paths array of (xyz, size, start, stop, polygon), and
the bounds min_x, min_y, max_x, max_y, in the unit square of the map.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Path, Shape, path, project, unproject
from ..options import TileOptions

PATHS = "array<struct<xyz:array<double>,size:double,start:double,stop:double,polygon:int>>"
GEOMETRY = f"kind string, paths {PATHS}, min_x double, min_y double, max_x double, max_y double"
FEATURES = f"seq long, id string, tags string, {GEOMETRY}"
_ARROW_PATHS = pa.list_(pa.struct([("xyz", pa.list_(pa.float64())), ("size", pa.float64()), ("start", pa.float64()), ("stop", pa.float64()), ("polygon", pa.int32())]))
ARROW = pa.schema([("seq", pa.int64()), ("id", pa.string()), ("tags", pa.string()), ("kind", pa.string()), ("paths", _ARROW_PATHS), *((x, pa.float64()) for x in ("min_x", "min_y", "max_x", "max_y"))])
DEPTH = 1024


def canonical(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def shape_row(shape: Shape) -> dict:
    bounds = dict(zip(("min_x", "min_y", "max_x", "max_y"), shape.bounds(), strict=True))
    return {"kind": shape.kind, "paths": [{"xyz": [c for v in p.points for c in v], "size": p.size, "start": p.start, "stop": p.stop, "polygon": p.polygon} for p in shape.paths], **bounds}


def row_shape(row: dict) -> Shape:
    triples = lambda c: list(zip(c[::3], c[1::3], c[2::3], strict=True))
    return Shape(row["kind"], [Path(triples(p["xyz"]), p["size"], p["start"], p["stop"], p["polygon"]) for p in row["paths"]])


def shapes_of(geometry: dict | None, options: TileOptions, depth: int = 0) -> Iterator[Shape]:
    """Shapes of a geometry: none without coordinates, several of a collection or of a line with metrics."""
    if depth > DEPTH:
        raise ValueError("geometry collections are nested too deeply")
    if geometry is None:
        return
    kind, c = geometry["type"], geometry.get("coordinates")
    if kind == "GeometryCollection":
        for g in geometry["geometries"]:
            yield from shapes_of(g, options, depth + 1)
        return
    if kind not in ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"):
        raise ValueError("input data is not a valid GeoJSON object")
    if not c:
        return
    tolerance = options.base_tolerance
    if kind in ("Point", "MultiPoint"):
        yield Shape(kind, [Path([(*project(p[0], p[1]), 0.0) for p in ([c] if kind == "Point" else c)])])
    elif kind == "LineString":
        yield Shape(kind, [path(c, tolerance, False)])
    elif kind == "MultiLineString":
        lines = [path(x, tolerance, False) for x in c]
        yield from [Shape("LineString", [x]) for x in lines] if options.line_metrics else [Shape(kind, lines)]
    else:
        yield Shape(kind, [path(ring, tolerance, True, k) for k, rings in enumerate([c] if kind == "Polygon" else c) for ring in rings])


def features_of(data: dict, options: TileOptions) -> Iterator[tuple[int, str | None, str | None, Shape]]:
    """(id, tags, shape) of each feature of a GeoJSON object."""
    rows = data["features"] if data["type"] == "FeatureCollection" else [data if data["type"] == "Feature" else {"type": "Feature", "geometry": data}]
    for index, feature in enumerate(rows):
        tags = feature.get("properties")
        key = (tags or {}).get(options.promote_id) if options.promote_id else index if options.generate_id else feature.get("id")
        for shape in shapes_of(feature.get("geometry"), options):
            yield index, canonical(key), canonical(tags), shape


def point_of(data: dict, options: TileOptions) -> tuple[str | None, str | None, float, float] | None:
    """(id, tags, x, y) of a GeoJSON feature that is a single point, as features_of() gives it; None for all else."""
    geometry = data.get("geometry") if data["type"] == "Feature" else None
    c = geometry.get("coordinates") if geometry and geometry["type"] == "Point" else None
    if not c:
        return None
    tags = data.get("properties")
    key = (tags or {}).get(options.promote_id) if options.promote_id else 0 if options.generate_id else data.get("id")
    return canonical(key), canonical(tags), *project(c[0], c[1])


def points_batch(seq: list, ids: list, tags: list, xs: list, ys: list) -> pa.RecordBatch:
    """Rows of FEATURES, with feature, of single points, column by column."""
    n, x, y, none = len(seq), np.array(xs, dtype="float64"), np.array(ys, dtype="float64"), pa.array(np.zeros(len(seq)))
    xyz = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3, dtype="int32")), pa.array(np.stack([x, y, np.zeros(n)], axis=1).ravel()))
    fields = list(_ARROW_PATHS.value_type)
    paths = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32")), pa.StructArray.from_arrays([xyz, none, none, none, pa.array(np.zeros(n, dtype="int32"))], fields=fields))
    x, y, number = pa.array(x), pa.array(y), pa.array(seq, pa.int64())
    schema = ARROW.append(pa.field("feature", pa.int64()))
    return pa.RecordBatch.from_arrays([number, pa.array(ids, pa.string()), pa.array(tags, pa.string()), pa.array(["Point"] * n, pa.string()), paths.cast(_ARROW_PATHS), x, y, x, y, number], schema=schema)


def read_features(texts: DataFrame, options: TileOptions = TileOptions(), column: str = "value", numbered: bool = False) -> DataFrame:
    """features of a table of GeoJSON texts: whole collections, or one feature in each row. seq orders features by row, then place.

    With numbered, a column feature holds the seq of the first row that the same GeoJSON feature made. seq leaves 33 bits for the features of a partition and 28 for partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, seq = ARROW.append(pa.field("feature", pa.int64())), None
        for batch in batches:
            rows, points = [], []
            for at, text in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seq = at >> 33 << 33 if seq is None else seq  # the first number of the partition
                if text and text.strip():
                    data, last, feature = json.loads(text), None, None
                    if point := point_of(data, options):
                        points.append((seq, *point))
                        seq += 1
                        continue
                    for index, i, t, s in features_of(data, options):
                        last, feature = index, seq if index != last else feature
                        rows.append({"seq": seq, "id": i, "tags": t, **shape_row(s), "feature": feature})
                        seq += 1
            if points:
                yield points_batch(*map(list, zip(*points, strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = texts.select(F.monotonically_increasing_id().alias("at"), F.col(column).alias("text"))
    found = rows.mapInArrow(run, f"{FEATURES}, feature long")
    return found if numbered else found.drop("feature")


def _degrees(shape: Shape) -> list:
    lines = [[list(unproject(x, y)) for x, y, _ in p.points] for p in shape.paths]
    if shape.kind in ("Point", "LineString"):
        return lines[0][0] if shape.kind == "Point" else lines[0]
    if shape.kind == "MultiPoint":
        return lines[0]
    if shape.kind in ("MultiLineString", "Polygon"):
        return lines
    polygons: dict[int, list] = {}
    for p, line in zip(shape.paths, lines, strict=True):
        polygons.setdefault(p.polygon, []).append(line)
    return list(polygons.values())


def to_geojson(features: DataFrame) -> DataFrame:
    """seq, value: each feature as a GeoJSON feature; world copies come as features of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                shape = row_shape(r)
                own = {} if r["id"] is None else {"id": json.loads(r["id"])}
                rows.append({"seq": r["seq"], "value": canonical({"type": "Feature", **own, "properties": None if r["tags"] is None else json.loads(r["tags"]), "geometry": {"type": shape.kind, "coordinates": _degrees(shape)}})})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("seq", pa.int64()), ("value", pa.string())]))

    return features.mapInArrow(run, "seq long, value string")
