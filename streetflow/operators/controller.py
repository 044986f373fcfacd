"""The load controller: a fold over the series of loads, on the driver, one row per cycle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression(loads: DataFrame, x: str = "t", y: str = "load") -> DataFrame:
    """One row: slope and intercept; null for fewer than two points."""
    return loads.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def predictions(loads: DataFrame, period: int, cycles: int) -> DataFrame:
    """Next cycle's load at each cycle, by regression over the last `cycles` loads; null where there are fewer than two."""
    w = Window.orderBy("t").rangeBetween(-(cycles - 1) * period, 0)
    slope, intercept = F.regr_slope("load", "t").over(w), F.regr_intercept("load", "t").over(w)
    return loads.select("t", "load", (slope * (F.col("t") + period) + intercept).alias("predicted"))


def fit(xs: list[float], ys: list[float]) -> tuple[float, float] | None:
    """Slope and intercept, None where they aren't defined."""
    n = len(xs)
    mx, my = sum(xs) / n, sum(ys) / n
    var = sum((x - mx) ** 2 for x in xs)
    if n < 2 or not var:
        return None
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / var
    return slope, my - slope * mx


def rounded(x: float) -> int:
    """To the nearest whole number, halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


@dataclass
class Controller:
    """How many trajectories stay. After each cycle `step` takes the load and the number of trajectories and returns n, or None while
    no shedding is on. `select(n)` is called when n changes and returns -1 if it kept all; then shedding ends once the load and its
    prediction are both below the band."""

    capacity: float
    band: float
    period: int
    loads: int = 5
    prediction: int = 1
    formula: str = "logarithmic"
    select: Callable[[int], int] = lambda n: 1
    active: bool = False
    n: int | None = None
    history: list[tuple[float, float]] = field(default_factory=list)
    ahead: float | None = None
    delta: int = 0
    turn: str = ""

    def predict(self, t: float) -> float | None:
        if self.prediction == 2:
            return self.history[-1][1]
        line = fit([p[0] for p in self.history], [p[1] for p in self.history])
        return None if line is None else line[0] * (t + self.period) + line[1]

    def less(self, ahead: float, load: float) -> int:
        gap = abs(ahead - self.capacity)
        if self.formula == "band":
            return rounded((self.capacity + self.band - ahead) / load * self.n)
        share = max(1.0, 100 * gap / self.capacity)
        return -rounded(math.log2(share + 1) * gap * self.n / share)

    def more(self, ahead: float, load: float) -> int:
        if self.formula == "band":
            return rounded((self.capacity - self.band - ahead) / load * self.n)
        return rounded(abs(ahead - self.capacity) / self.capacity * self.n)

    def state(self) -> dict:
        """What a later run needs to go on."""
        return {"active": self.active, "n": self.n, "history": self.history}

    def resume(self, state: dict) -> None:
        self.active, self.n, self.history = state["active"], state["n"], [tuple(p) for p in state["history"]]

    def step(self, t: float, load: float, trajectories: int) -> int | None:
        self.history = [p for p in self.history if p[0] > t - self.loads * self.period] + [(t, load)]
        ahead = self.ahead = self.predict(t)
        self.delta, self.turn, said = 0, "", 1
        if ahead is None:
            return self.n if self.active else None
        if ahead > self.capacity + self.band:
            if not self.active:
                self.active, self.n = True, trajectories
            self.delta, self.turn = self.less(ahead, load), "over"
            self.n = max(0, self.n + self.delta)
            said = self.select(self.n)
        elif ahead < self.capacity - self.band and self.active:
            self.delta, self.turn = self.more(ahead, load), "under"
            self.n = min(trajectories, self.n + self.delta)
            said = self.select(self.n)
            said = -1 if self.n >= trajectories else said
        if self.active and said == -1 and load < self.capacity - self.band and ahead < self.capacity - self.band:
            self.active, self.n = False, None
        return self.n if self.active else None


def run(series: Iterable[tuple[float, float, int]], controller: Controller) -> list[tuple[float, int | None]]:
    return [(t, controller.step(t, load, trajectories)) for t, load, trajectories in series]


def capped(active: int, expected: int, percent: float) -> int | None:
    """The oldest model: capacity is a share of the expected objects, and n is the capacity whenever more are active."""
    most = int(expected * percent / 100)
    return most if active > most else None


def capped_series(active: Column, expected: int, percent: float) -> Column:
    """The same for a column."""
    most = int(expected * percent / 100)
    return F.when(active > most, F.lit(most))
