"""The engine's parameters: the grid, the load controller, the window and the query."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: fixed values: the universes (x_min, y_min, x_max, y_max) in planar metres
ATHENS = (450000.0, 4175000.0, 500000.0, 4225000.0)
ROME = (1757000.0, 4608800.0, 1822000.0, 4673800.0)
SCHEMES = {0: "none", 1: "first", 2: "smallest_ids", 3: "random", 4: "random_dynamic", 5: "semantic", 6: "tuples"}


@dataclass(frozen=True)
class EngineConfig:
    """In the order of the command line."""

    mode: str = "VALID"
    real: bool = False
    objects: int = 0
    object_file: str = ""
    queries: int = 0
    query_file: str = ""
    active_file: str = ""
    rate: int = 1
    start_time: int = 0
    gran_x: int = 50
    gran_y: int = 50
    peak_load: float = 1.0
    capacity_percent: float = 100.0
    scheme: int = 0
    band_percent: float = 5.0
    prediction: int = 1
    loads: int = 5
    global_window: bool = True
    range: int = 86400
    slide: int = 21600
    period: int = 21600
    query_type: int = 1
    op: int = 2
    first_criterion: int = 0

    def __post_init__(self) -> None:
        if self.scheme not in SCHEMES:
            raise ValueError(f"scheme {self.scheme}")
        if self.prediction not in (1, 2):
            raise ValueError(f"prediction {self.prediction}: 1 is regression, 2 the last load")
        if self.query_type not in (1, 2) or self.op not in (1, 2):
            raise ValueError("query_type and op are 1 or 2")
        if self.period <= 0 or self.range <= 0 or self.slide <= 0:
            raise ValueError("period, range and slide are positive")

    @classmethod
    def parse(cls, args: list[str]) -> EngineConfig:
        """From positional arguments; each is read as its default's type."""
        if len(args) != len(fields(cls)):
            raise ValueError(f"{len(fields(cls))} arguments are needed, {len(args)} given")
        kinds = {"int": int, "float": float, "str": str, "bool": lambda v: v not in ("0", "false", "False")}
        return cls(**{f.name: kinds[f.type](v) for f, v in zip(fields(cls), args, strict=True)})

    @property
    def universe(self) -> tuple[float, float, float, float]:
        return ROME if self.real else ATHENS

    @property
    def capacity(self) -> float:
        return self.capacity_percent / 100 * self.peak_load

    @property
    def band(self) -> float:
        return self.band_percent / 100 * self.peak_load
