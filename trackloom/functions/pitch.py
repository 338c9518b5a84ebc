"""Column expressions on pitch coordinates (105 x 68 m)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, WIDTH, FINAL_THIRD = 105.0, 68.0, 70.0


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(x: str | Column, y: str | Column, tol: float = 2.0) -> tuple[Column, Column]:
    """Points up to ``tol`` outside go onto the line, farther ones lose both coordinates."""
    x, y = _c(x), _c(y)
    ok = x.between(-tol, LENGTH + tol) & y.between(-tol, WIDTH + tol)
    return F.when(ok, F.least(F.greatest(x, F.lit(0.0)), F.lit(LENGTH))), F.when(ok, F.least(F.greatest(y, F.lit(0.0)), F.lit(WIDTH)))


def advance(x: str | Column, direction: str | Column) -> Column:
    """Distance from the own goal line; null without a direction."""
    return F.when(_c(direction) > 0, _c(x)).when(_c(direction).isNotNull(), LENGTH - _c(x))


def across(y: str | Column, direction: str | Column) -> Column:
    return F.when(_c(direction) > 0, _c(y)).when(_c(direction).isNotNull(), WIDTH - _c(y))


def distance(x0: str | Column, y0: str | Column, x1: str | Column, y1: str | Column) -> Column:
    dx, dy = _c(x1) - _c(x0), _c(y1) - _c(y0)
    return F.sqrt(dx * dx + dy * dy)


def lane(y: str | Column, *, clip: bool = False) -> Column:
    """Lane 0..4 of equal width, the last one closed; outside is null, or an edge lane with ``clip``."""
    y = _c(y)
    i = F.least(F.floor(y / (WIDTH / 5)), F.lit(4)).cast("int")
    return F.greatest(i, F.lit(0)) if clip else F.when(y.between(0, WIDTH), i)


def third(ax: str | Column) -> Column:
    return F.greatest(F.least(F.floor(_c(ax) / LENGTH * 3), F.lit(2)), F.lit(0)).cast("int")


def threat(ax: str | Column, y: str | Column) -> Column:
    """Falls off exponentially with the distance to the goal's centre."""
    return F.exp(-distance(ax, y, F.lit(LENGTH), F.lit(WIDTH / 2)) / 18)


def cell(x: str | Column, y: str | Column, nx: int, ny: int) -> Column:
    ix = F.greatest(F.least(F.floor(_c(x) / LENGTH * nx), F.lit(nx - 1)), F.lit(0))
    iy = F.greatest(F.least(F.floor(_c(y) / WIDTH * ny), F.lit(ny - 1)), F.lit(0))
    return (ix * ny + iy).cast("long")


def project(h: list[float], x: str | Column, y: str | Column) -> tuple[Column, Column]:
    """Through a 3 x 3 homography, row by row."""
    x, y = _c(x), _c(y)
    w = x * h[6] + y * h[7] + h[8]
    return (x * h[0] + y * h[1] + h[2]) / w, (x * h[3] + y * h[4] + h[5]) / w
