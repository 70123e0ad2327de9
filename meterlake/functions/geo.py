"""Plane coordinates to latitude and longitude, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from math import radians, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Projection:
    """A UTM zone on an ellipsoid, with the shift of its datum to WGS 84 in metres."""

    semi_major: float
    inverse_flattening: float
    zone: int
    south: bool
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)


#: Fixed values, from the public registry of coordinate systems: SAD69 / UTM zone 22S and SIRGAS 2000 / UTM zone 22S.
SRID = {
    29192: Projection(6378160.0, 298.25, 22, True, (-67.35, 3.88, -38.22)),
    31982: Projection(6378137.0, 298.257222101, 22, True),
}
_WGS84 = (6378137.0, 1 / 298.257223563)


def _steps(p: Projection) -> dict[str, Callable[[Mapping[str, Column]], Column]]:
    """Named steps from ``x`` and ``y`` to ``lat`` and ``lon``, each from the values before it."""
    a, f = p.semi_major, 1 / p.inverse_flattening
    e2 = f * (2 - f)
    ep2, n = e2 / (1 - e2), f / (2 - f)
    k0, lon0 = 0.9996, radians(6 * p.zone - 183)
    power = lambda c, k: F.pow(c, F.lit(k))
    steps = {
        "east": lambda v: v["x"].cast("double") - 500000.0,
        "north": lambda v: v["y"].cast("double") - (10000000.0 if p.south else 0.0),
        "mu": lambda v: v["north"] / (k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)),
        "foot": lambda v: (
            v["mu"]
            + (3 * n / 2 - 27 * n**3 / 32) * F.sin(2 * v["mu"])
            + (21 * n**2 / 16 - 55 * n**4 / 32) * F.sin(4 * v["mu"])
            + (151 * n**3 / 96) * F.sin(6 * v["mu"])
            + (1097 * n**4 / 512) * F.sin(8 * v["mu"])
        ),
        "c": lambda v: ep2 * F.cos(v["foot"]) * F.cos(v["foot"]),
        "t": lambda v: F.tan(v["foot"]) * F.tan(v["foot"]),
        "w": lambda v: 1 - e2 * F.sin(v["foot"]) * F.sin(v["foot"]),
        "radius": lambda v: a / F.sqrt(v["w"]),
        "d": lambda v: v["east"] / (v["radius"] * k0),
        "phi": lambda v: v["foot"] - (v["radius"] * F.tan(v["foot"]) / (a * (1 - e2) / (v["w"] * F.sqrt(v["w"])))) * (
            v["d"] * v["d"] / 2
            - (5 + 3 * v["t"] + 10 * v["c"] - 4 * v["c"] * v["c"] - 9 * ep2) * power(v["d"], 4) / 24
            + (61 + 90 * v["t"] + 298 * v["c"] + 45 * v["t"] * v["t"] - 252 * ep2 - 3 * v["c"] * v["c"]) * power(v["d"], 6) / 720
        ),
        "lam": lambda v: lon0 + (
            v["d"]
            - (1 + 2 * v["t"] + v["c"]) * power(v["d"], 3) / 6
            + (5 - 2 * v["c"] + 28 * v["t"] - 3 * v["c"] * v["c"] + 8 * ep2 + 24 * v["t"] * v["t"]) * power(v["d"], 5) / 120
        ) / F.cos(v["foot"]),
    }
    if p.shift == (0.0, 0.0, 0.0):
        return steps | {"lat": lambda v: F.degrees(v["phi"]), "lon": lambda v: F.degrees(v["lam"])}
    wa, wf = _WGS84
    we2 = wf * (2 - wf)
    wb = wa * sqrt(1 - we2)
    return steps | {
        "bend": lambda v: a / F.sqrt(1 - e2 * F.sin(v["phi"]) * F.sin(v["phi"])),
        "gx": lambda v: v["bend"] * F.cos(v["phi"]) * F.cos(v["lam"]) + p.shift[0],
        "gy": lambda v: v["bend"] * F.cos(v["phi"]) * F.sin(v["lam"]) + p.shift[1],
        "gz": lambda v: v["bend"] * (1 - e2) * F.sin(v["phi"]) + p.shift[2],
        "flat": lambda v: F.sqrt(v["gx"] * v["gx"] + v["gy"] * v["gy"]),
        "angle": lambda v: F.atan2(v["gz"] * wa, v["flat"] * wb),
        "lat": lambda v: F.degrees(
            F.atan2(v["gz"] + we2 / (1 - we2) * wb * power(F.sin(v["angle"]), 3), v["flat"] - we2 * wa * power(F.cos(v["angle"]), 3))
        ),
        "lon": lambda v: F.degrees(F.atan2(v["gy"], v["gx"])),
    }


def to_wgs84(x: Column, y: Column, srid: int = 29192) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees of easting ``x`` and northing ``y``, as expressions; ``reproject`` plans faster."""
    values = {"x": x, "y": y}
    for name, step in _steps(SRID[srid]).items():
        values[name] = step(values)
    return values["lat"], values["lon"]


def reproject(df: DataFrame, x: str, y: str, lat: str, lon: str, srid: int = 29192) -> DataFrame:
    """``df`` with latitude and longitude of columns ``x`` and ``y``. Steps are columns of their own, so none is computed or planned twice."""
    values, out = {"x": F.col(x), "y": F.col(y)}, df
    for name, step in _steps(SRID[srid]).items():
        out = out.withColumn(f"__{name}", step(values))
        values[name] = F.col(f"__{name}")
    return out.withColumns({lat: F.col("__lat"), lon: F.col("__lon")}).drop(*(f"__{n}" for n in values if n not in ("x", "y")))
