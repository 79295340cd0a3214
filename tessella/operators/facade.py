"""One index over a table of features, tiled or clustered, with the calls of either; what the other kind would answer is None."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..options import ClusterOptions, TileOptions
from .clusters import ClusterIndex, feature_points
from .tiles import TileEngine


class MapIndex:
    """features: sources.geojson. With cluster, the single points among them, and among their copies from other worlds, are clustered.

    value: what clusters accumulate, a column over id and tags (JSON) of the points; fold: how, by default as a sum.
    """

    def __init__(self, features: DataFrame, options: TileOptions = TileOptions(), cluster: bool = False, clusters: ClusterOptions = ClusterOptions(), value: Column | None = None, fold: Callable | None = None):
        self._made(TileEngine(features, options), cluster, clusters, value, fold)

    def _made(self, engine: TileEngine, cluster: bool, clusters: ClusterOptions, value: Column | None, fold: Callable | None) -> None:
        self.engine, self.value, self.fold, self.index = engine, value, fold, None
        if cluster:
            points = feature_points(engine.source)
            self.index = ClusterIndex(points if value is None else points.withColumn("value", value), clusters, None if value is None else "value", fold)

    def get_tile(self, z: int, x: int, y: int) -> DataFrame | None:
        """The features of a tile; None where there is none."""
        if not 0 <= int(z) <= 24:
            return None
        return self.index.get_tile(int(z), int(x), int(y)) if self.index else self.engine.get_tile(z, x, y)

    def get_data(self) -> DataFrame:
        return self.engine.get_data()

    def update_data(self, *args, **changes) -> MapIndex:
        """An index over the changed features (TileEngine.update_data); this one, where nothing changes. Clusters are built anew."""
        engine, affected = self.engine.update_data(*args, **changes)
        if affected.isEmpty():
            return self
        new = object.__new__(MapIndex)
        new._made(engine, self.index is not None, self.index.options if self.index else ClusterOptions(), self.value, self.fold)
        return new

    def update_cluster_options(self, cluster: bool, clusters: ClusterOptions = ClusterOptions()) -> MapIndex:
        """An index over the same features, clustered with these options or not clustered."""
        new = object.__new__(MapIndex)
        new._made(self.engine, cluster, clusters, self.value, self.fold)
        return new

    def get_clusters(self, bbox: tuple[float, float, float, float], zoom: float) -> DataFrame | None:
        return self.index.get_clusters(bbox, zoom) if self.index else None

    def expansion_zoom(self, cluster: int) -> int | None:
        return self.index.expansion_zoom(cluster) if self.index else None

    def children(self, cluster: int) -> DataFrame | None:
        return self.index.children(cluster) if self.index else None

    def leaves(self, cluster: int, limit: int | None = 10, offset: int = 0) -> DataFrame | None:
        return self.index.leaves(cluster, limit, offset) if self.index else None
