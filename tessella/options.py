"""Options of tiling and clustering, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TileOptions:
    max_zoom: int = 14
    index_max_zoom: int = 5
    index_max_points: int = 100_000
    tolerance: float = 3
    extent: int = 4096
    buffer: float = 64
    line_metrics: bool = False
    promote_id: str | None = None
    generate_id: bool = False
    updateable: bool = False
    wrap: bool = False  # the last two are for single_tile()
    clip: bool = False

    def __post_init__(self):
        if not 0 <= self.max_zoom <= 24:
            raise ValueError("max_zoom should be in the 0-24 range")
        if self.promote_id and self.generate_id:
            raise ValueError("promote_id and generate_id cannot be used together")

    @property
    def margin(self) -> float:
        """The buffer in tiles."""
        return self.buffer / self.extent

    def tolerance_at(self, z: int) -> float:
        return 0.0 if z == self.max_zoom else self.tolerance / ((1 << z) * self.extent)

    @property
    def base_tolerance(self) -> float:
        """Squared tolerance of the importance that is stored with each vertex."""
        return (self.tolerance / ((1 << self.max_zoom) * self.extent)) ** 2


@dataclass(frozen=True)
class ClusterOptions:
    min_zoom: int = 0
    max_zoom: int = 16
    min_points: int = 2
    radius: float = 40
    extent: int = 512
    generate_id: bool = False

    def __post_init__(self):
        if not 0 <= self.min_zoom <= self.max_zoom <= 30:
            raise ValueError("zooms should be in order, in the 0-30 range")

    def reach(self, z: int) -> float:
        return self.radius / (self.extent * 2.0**z)

    def clamp(self, z: float) -> int:
        return max(self.min_zoom, min(int(z // 1), self.max_zoom + 1))
