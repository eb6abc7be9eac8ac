"""Geography: points are structs of latitude and longitude in thousandths of a second of arc."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The radius in metres, and the meridian's, the normal's and the eccentricity's constants of WGS 84.
RADIUS, MERIDIAN, NORMAL, ECCENTRICITY = 6357303, 6335439, 6378137, 0.006694
_RADIAN = math.pi / (180 * 60 * 60 * 1000)
_HALF = 180 * 60 * 60 * 1000


def point(lat_ms: Column, lon_ms: Column) -> Column:
    return F.struct(lat_ms.cast("int").alias("lat_ms"), lon_ms.cast("int").alias("lon_ms"))


def parse(said: str) -> tuple[int, int]:
    """'lat x lon' or 'lat,lon', in milliseconds of arc, or in degrees where there is a dot."""
    a, b = said.replace("x", ",").split(",")
    return tuple(round(float(v) * 3600000) if "." in v else int(v) for v in (a, b))


def at(said: str) -> Column:
    lat, lon = parse(said)
    return point(F.lit(lat), F.lit(lon))


def place(p) -> Column:
    """A point: a struct as it is, or text, be it a literal or a column of texts."""
    if isinstance(p, str):
        return at(p)
    return p


def from_text(x: Column) -> Column:
    """A column of 'lat x lon' texts as points; null where a text isn't one."""
    part = F.split(F.replace(x, F.lit("x"), F.lit(",")), ",")
    one = lambda k: F.when(F.contains(F.get(part, F.lit(k)), F.lit(".")), F.round(F.get(part, F.lit(k)).try_cast("double") * 3600000)).otherwise(F.get(part, F.lit(k)).try_cast("double"))
    return F.when(F.size(part) == 2, point(one(0), one(1)))


def distance(p: Column, q: Column, how: str = "rectangle") -> Column:
    """Metres, on a rectangle, a sphere or an ellipsoid."""
    p, q = place(p), place(q)
    la, lb = p["lat_ms"] * _RADIAN, q["lat_ms"] * _RADIAN
    apart = q["lon_ms"].cast("long") - p["lon_ms"]
    lo, lq = F.lit(0.0), F.when(apart > _HALF, apart - 2 * _HALF).when(apart < -_HALF, apart + 2 * _HALF).otherwise(apart) * _RADIAN  # the short way, over the date line too
    if how in ("rectangle", "rect"):
        x = (lq - lo) * F.cos((la + lb) / 2)
        return F.sqrt(x * x + (lb - la) * (lb - la)) * RADIUS
    if how in ("sphere", "sphr"):
        x, y = F.sin(F.abs(lq - lo) / 2), F.sin(F.abs(lb - la) / 2)
        return F.asin(F.least(F.lit(1.0), F.sqrt(y * y + F.cos(la) * F.cos(lb) * x * x))) * 2 * RADIUS
    if how in ("ellipsoid", "ellip"):
        mean = (la + lb) / 2
        q_ = F.sqrt(1 - ECCENTRICITY * F.sin(mean) * F.sin(mean))
        m, n = MERIDIAN / (q_ * q_ * q_), NORMAL / q_
        y, x = (la - lb) * m, (lo - lq) * n * F.cos(mean)
        return F.sqrt(y * y + x * x)
    raise ValueError(f"no such approximation: {how}")


def in_circle(p: Column, centre: Column, radius, how: str = "rectangle") -> Column:
    """Within so many metres of the centre, or nearer to it than the point that is given as radius; a box is asked first."""
    p, centre = place(p), place(centre)
    metres = radius if isinstance(radius, Column) else F.lit(float(radius))
    reach = metres / RADIUS / _RADIAN * 1.02 + 1
    return (F.abs(p["lat_ms"] - centre["lat_ms"]) <= reach) & (distance(p, centre, how) <= metres)


def in_rectangle(p: Column, top_left: Column, bottom_right: Column) -> Column:
    """Borders included; a rectangle whose left edge lies east of its right one goes over the date line."""
    p, top_left, bottom_right = place(p), place(top_left), place(bottom_right)
    lon, west, east = p["lon_ms"], top_left["lon_ms"], bottom_right["lon_ms"]
    across = F.when(west <= east, (lon >= west) & (lon <= east)).otherwise((lon >= west) | (lon <= east))
    return (p["lat_ms"] <= top_left["lat_ms"]) & (p["lat_ms"] >= bottom_right["lat_ms"]) & across
