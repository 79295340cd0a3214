"""Geometry of single features: measures, importance, clipping, world copies, tile geometry. No Spark here.

A path is (points, size, start, stop, polygon): points are (x, y, importance); polygon numbers the polygon of a ring, whose first ring is
the outer one. A shape is (kind, paths); points of Point and MultiPoint are one path.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import atan, exp, floor, hypot, isfinite, log, pi, sin
from typing import NamedTuple

Vertex = tuple[float, float, float]


class Path(NamedTuple):
    points: list[Vertex]
    size: float = 0.0
    start: float = 0.0
    stop: float = 0.0
    polygon: int = 0


class Shape(NamedTuple):
    kind: str
    paths: list[Path]

    @property
    def is_point(self) -> bool:
        return self.kind in ("Point", "MultiPoint")

    @property
    def is_ring(self) -> bool:
        return self.kind in ("Polygon", "MultiPolygon")

    def bounds(self) -> tuple[float, float, float, float]:
        """Of polygons the outer rings alone count."""
        seen, points = set(), []
        for p in self.paths:
            if not self.is_ring or p.polygon not in seen:
                points += p.points
            seen.add(p.polygon)
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        return (min(xs), min(ys), max(xs), max(ys)) if points else (2.0, 1.0, -1.0, 0.0)


def project(lon: float, lat: float) -> tuple[float, float]:
    if not (isfinite(lon) and isfinite(lat)):
        raise ValueError("coordinates have to be finite")
    s = sin(lat * pi / 180)
    y = 0.0 if s >= 1 else 1.0 if s <= -1 else min(1.0, max(0.0, 0.5 - 0.25 * log((1 + s) / (1 - s)) / pi))
    return lon / 360 + 0.5, y


def unproject(x: float, y: float) -> tuple[float, float]:
    return (x - 0.5) * 360, 360 * atan(exp((180 - y * 360) * pi / 180)) / pi - 90


def squared_distance(p, a, b) -> float:
    """From a point to a segment."""
    x, y, dx, dy = a[0], a[1], b[0] - a[0], b[1] - a[1]
    if dx or dy:
        t = ((p[0] - x) * dx + (p[1] - y) * dy) / (dx * dx + dy * dy)
        x, y = (b[0], b[1]) if t > 1 else (x + dx * t, y + dy * t) if t > 0 else (x, y)
    return (p[0] - x) ** 2 + (p[1] - y) ** 2


def importance(points: list[tuple[float, float]], tolerance: float) -> list[float]:
    """Squared distance at which each vertex matters, 0 where it never does; both ends are 1. Ties go to the vertex nearest the middle."""
    out = [0.0] * len(points)
    spans = [(0, len(points) - 1)] if tolerance > 0 else []
    while spans:
        first, last = spans.pop()
        best, pick, gap = tolerance, None, 3 * (last - first)
        middle = 3 * first + (gap >> 1)  # in slots of three numbers, so that it may lie between vertices
        for i in range(first + 1, last):
            d = squared_distance(points[i], points[first], points[last])
            if d > best:
                best, pick = d, i
            elif d == best and abs(3 * i - middle) < gap:
                pick, gap = i, abs(3 * i - middle)
        if pick is not None and best > tolerance:
            out[pick] = best
            spans += [(a, b) for a, b in ((first, pick), (pick, last)) if b - a > 1]
    if out:
        out[0] = out[-1] = 1.0
    return out


def path(coordinates: list, tolerance: float, ring: bool, polygon: int = 0) -> Path:
    """A line or ring from degrees, with its length or area and the importance of its vertices."""
    xy = [project(c[0], c[1]) for c in coordinates]
    pairs = list(zip(xy, xy[1:], strict=False))
    size = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs)) / 2 if ring else sum(hypot(b[0] - a[0], b[1] - a[1]) for a, b in pairs)
    return Path([(x, y, z) for (x, y), z in zip(xy, importance(xy, tolerance), strict=True)], size, 0.0, size, polygon)


def _cut(p: Vertex, q: Vertex, axis: int, bound: float) -> tuple[Vertex, float]:
    t = (bound - p[axis]) / (q[axis] - p[axis])
    other = p[1 - axis] + (q[1 - axis] - p[1 - axis]) * t
    return ((bound, other, 1.0) if axis == 0 else (other, bound, 1.0)), t


def clip_path(line: Path, lo: float, hi: float, axis: int, ring: bool, metrics: bool) -> list[Path]:
    """The slices of a line inside a closed band, or the ring cut to it. Touching a bound is not crossing it; sizes stay those of the whole."""
    out, points, at, start = [], [], line.start, line.start
    for p, q in zip(line.points, line.points[1:], strict=False):
        a, b, gone = p[axis], q[axis], None
        length = hypot(q[0] - p[0], q[1] - p[1]) if metrics else 0.0
        entered = lo if a < lo < b else hi if a > hi > b else None
        if entered is not None:
            v, t = _cut(p, q, axis, entered)
            points.append(v)
            if metrics:
                start = at + length * t
        elif lo <= a <= hi:
            points.append(p)
        if b < lo <= a:
            gone = lo
        elif b > hi >= a:
            gone = hi
        if gone is not None:
            v, t = _cut(p, q, axis, gone)
            points.append(v)
            if not ring:
                out.append(Path(points, line.size, start, at + length * t if metrics else line.stop, line.polygon))
                points, start = [], line.start
        at += length
    if line.points and lo <= line.points[-1][axis] <= hi:
        points.append(line.points[-1])
    if ring and len(points) > 1 and points[0][:2] != points[-1][:2]:
        points.append(points[0])
    return out + [Path(points, line.size, start, line.stop, line.polygon)] if points else out


def clip(shape: Shape, lo: float, hi: float, axis: int, metrics: bool = False, closed: bool = False) -> list[Shape]:
    """What a shape leaves in a band: nothing, one shape, or with metrics a shape for each slice of a line.

    What lies beyond hi and at most touches it is left out, as tiles are half open; with closed, lines of several vertices keep what touches it.
    """
    bounds = shape.bounds()
    least, most = bounds[axis], bounds[axis + 2]
    if least >= lo and most < hi:
        return [shape]
    touches = closed and least == hi and not shape.is_point and not shape.is_ring and any(len(p.points) > 1 for p in shape.paths)
    if most < lo or (least >= hi and not touches):
        return []
    if shape.is_point:
        kept = [p for p in shape.paths[0].points if lo <= p[axis] <= hi]
        return [Shape("Point" if len(kept) == 1 else "MultiPoint", [Path(kept)])] if kept else []
    tracked = metrics and shape.kind == "LineString"
    kept = [c for p in shape.paths for c in clip_path(p, lo, hi, axis, shape.is_ring, tracked)]
    if not kept:
        return []
    if shape.is_ring:
        return [Shape(shape.kind, kept)]
    if tracked:
        return [Shape("LineString", [p]) for p in kept]
    return [Shape("LineString" if len(kept) == 1 else "MultiLineString", kept)]


def shifted(shape: Shape, by: float) -> Shape:
    return Shape(shape.kind, [p._replace(points=[(x + by, y, z) for x, y, z in p.points]) for p in shape.paths])


def bands_of(margin: float) -> tuple[tuple[int, float, float, float], ...]:
    """(order, from, to, shift to the centre) of the left world (0), the centre (1) and the right one (2), each with its margins."""
    return (0, -1 - margin, margin, 1.0), (1, -margin, 1 + margin, 0.0), (2, 1 - margin, 2 + margin, -1.0)


def world_copies(shape: Shape, margin: float, metrics: bool) -> list[tuple[int, Shape]]:
    """(order, copy): what lies in each band, moved to the centre."""
    return [(k, shifted(s, by) if by else s) for k, lo, hi, by in bands_of(margin) for s in clip(shape, lo, hi, 0, metrics)]


def tile_lines(shape: Shape, tolerance: float) -> tuple[list[list[Vertex]], int, int]:
    """(lines, vertices, vertices kept): without what is too small or too unimportant; rings rewound."""
    out, seen, count, kept = [], set(), 0, 0
    limit = tolerance * tolerance
    for p in shape.paths:
        outer = p.polygon not in seen
        seen.add(p.polygon)
        count += len(p.points)
        if tolerance > 0 and p.size < (limit if shape.is_ring else tolerance):
            continue
        line = [v for v in p.points if tolerance == 0 or v[2] > limit]
        kept += len(line)
        if shape.is_ring:
            area = sum((v[0] - u[0]) * (v[1] + u[1]) for u, v in zip(line[-1:] + line[:-1], line, strict=True))
            if (area > 0) == outer:
                line = line[::-1]
        out.append(line)
    return out, count, kept


def quantised(points: list[Vertex], z: int, x: int, y: int, extent: int) -> list[list[int]]:
    scale = 1 << z
    return [[floor(extent * (p[0] * scale - x) + 0.5), floor(extent * (p[1] * scale - y) + 0.5)] for p in points]


def quadtree(shapes: list[Shape], margin: float, metrics: bool, max_zoom: int, wanted=None) -> Iterator[tuple[int, int, int, list[Shape]]]:
    """(z, x, y, shapes) of each tile that holds something of a feature, from the whole world to max_zoom. wanted(z, x, y) prunes subtrees."""
    half = margin / 2
    stack = [(0, 0, 0, shapes)]
    while stack:
        z, x, y, held = stack.pop()
        if not held or (wanted and not wanted(z, x, y)):
            continue
        yield z, x, y, held
        if z == max_zoom:
            continue
        scale = float(1 << z)
        for i, (xl, xh) in enumerate(((-half, 0.5 + half), (0.5 - half, 1 + half))):
            part = [s for h in held for s in clip(h, (x + xl) / scale, (x + xh) / scale, 0, metrics)]
            for j, (yl, yh) in enumerate(((-half, 0.5 + half), (0.5 - half, 1 + half))) if part else ():
                stack.append((z + 1, 2 * x + i, 2 * y + j, [s for h in part for s in clip(h, (y + yl) / scale, (y + yh) / scale, 1, metrics)]))


def point_quadtree(px: float, py: float, margin: float, max_zoom: int, wanted=None) -> Iterator[tuple[int, int, int]]:
    """(z, x, y) of quadtree() for a single point, which is in a band or not, so that there is nothing to cut."""
    half = margin / 2
    bands = ((0, -half, 0.5 + half), (1, 0.5 - half, 1 + half))
    stack = [(0, 0, 0)]
    while stack:
        z, x, y = stack.pop()
        if wanted and not wanted(z, x, y):
            continue
        yield z, x, y
        if z == max_zoom:
            continue
        scale = float(1 << z)
        for i, lo, hi in bands:
            if (x + lo) / scale <= px < (x + hi) / scale:
                stack += [(z + 1, 2 * x + i, 2 * y + j) for j, low, high in bands if (y + low) / scale <= py < (y + high) / scale]
