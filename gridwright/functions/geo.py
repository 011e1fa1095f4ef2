"""Map projections and plane geometry as column expressions; the SQL text runs on any ANSI engine."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# GRS80 (fixed values)
A = 6378137.0
FLATTENING = 1 / 298.257222101
_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# series of the transverse Mercator to the fifth order (fixed values)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630, 61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880, 49561 * _N**4 / 161280 - 179 * _N**5 / 168, 34729 * _N**5 / 80640]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105, 17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480, 4397 * _N**4 / 161280 - 11 * _N**5 / 504, 4583 * _N**5 / 161280]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45 + 26 * _N**5 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45 + 2704 * _N**5 / 315, 56 * _N**3 / 15 - 136 * _N**4 / 35 - 1262 * _N**5 / 105, 4279 * _N**4 / 630 - 332 * _N**5 / 35, 4174 * _N**5 / 315]


@dataclass(frozen=True)
class TransverseMercator:
    """Defaults are zone 56 south."""

    meridian: float = 153.0
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 10_000_000.0

    def forward_sql(self, lon: str, lat: str) -> tuple[str, str]:
        """Easting and northing of degrees."""
        lam, s = f"radians(({lon}) - {self.meridian!r})", f"sin(radians({lat}))"
        t = f"sinh(atanh({s}) - {_E!r} * atanh({_E!r} * {s}))"
        xi, eta = f"atan2({t}, cos({lam}))", f"asinh(sin({lam}) / sqrt(power({t}, 2) + power(cos({lam}), 2)))"
        x = " + ".join([eta, *(f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1))])
        y = " + ".join([xi, *(f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1))])
        k = self.scale * _RADIUS
        return f"({self.east!r} + {k!r} * ({x}))", f"({self.north!r} + {k!r} * ({y}))"

    def inverse_sql(self, x: str, y: str) -> tuple[str, str]:
        """Degrees of easting and northing."""
        k = self.scale * _RADIUS
        xi, eta = f"((({y}) - {self.north!r}) / {k!r})", f"((({x}) - {self.east!r}) / {k!r})"
        xi1 = f"({xi} - ({' + '.join(f'{b!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})' for j, b in enumerate(_BETA, 1))}))"
        eta1 = f"({eta} - ({' + '.join(f'{b!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})' for j, b in enumerate(_BETA, 1))}))"
        chi = f"asin(sin({xi1}) / cosh({eta1}))"
        lat = " + ".join([chi, *(f"{d!r} * sin({2 * j} * {chi})" for j, d in enumerate(_DELTA, 1))])
        return f"({self.meridian!r} + degrees(atan2(sinh({eta1}), cos({xi1}))))", f"degrees({lat})"


@dataclass(frozen=True)
class LambertConic:
    """Two standard parallels; defaults are the state-wide grid of the study area."""

    parallels: tuple[float, float] = (-30.75, -35.75)
    lat: float = -33.25
    lon: float = 147.0
    east: float = 9_300_000.0
    north: float = 4_500_000.0

    def forward_sql(self, lon: str, lat: str) -> tuple[str, str]:
        def m(p: float) -> float:
            return math.cos(p) / math.sqrt(1 - (_E * math.sin(p)) ** 2)

        def t(p: float) -> float:
            return math.tan(math.pi / 4 - p / 2) / ((1 - _E * math.sin(p)) / (1 + _E * math.sin(p))) ** (_E / 2)

        p1, p2, p0 = (math.radians(x) for x in (*self.parallels, self.lat))
        n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        f = m(p1) / (n * t(p1) ** n)
        r0 = A * f * t(p0) ** n
        s = f"sin(radians({lat}))"
        tq = f"(tan({math.pi / 4!r} - radians({lat}) / 2) / power((1 - {_E!r} * {s}) / (1 + {_E!r} * {s}), {_E / 2!r}))"
        r, theta = f"({A * f!r} * power({tq}, {n!r}))", f"({n!r} * radians(({lon}) - {self.lon!r}))"
        return f"({self.east!r} + {r} * sin({theta}))", f"({self.north!r} + {r0!r} - {r} * cos({theta}))"


@dataclass(frozen=True)
class Geographic:
    """Degrees themselves, as a system of their own: x is longitude, y latitude."""

    def forward_sql(self, lon: str, lat: str) -> tuple[str, str]:
        return lon, lat

    def inverse_sql(self, x: str, y: str) -> tuple[str, str]:
        return x, y


@dataclass(frozen=True)
class Datum:
    """A seven-parameter step between geodetic datums of one ellipsoid, by rotations of the coordinate frame.

    Metres, arc seconds and parts per million; the defaults are the published step from the older to the newer
    national datum of the study area (fixed values)."""

    shifts: tuple[float, float, float] = (0.06155, -0.01087, -0.04019)
    turns: tuple[float, float, float] = (-0.0394924, -0.0327221, -0.0328979)
    scale_ppm: float = -0.009994

    def reversed(self) -> Backwards:
        return Backwards(self)

    def matrix(self) -> list[list[float]]:
        rx, ry, rz = (math.radians(t / 3600) for t in self.turns)
        k = 1 + self.scale_ppm * 1e-6
        return [[k, k * rz, -k * ry], [-k * rz, k, k * rx], [k * ry, -k * rx, k]]

    def geocentric(self, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
        """Geocentric coordinates in the other datum."""
        return tuple(self.shifts[i] + sum(m * c for m, c in zip(row, (x, y, z), strict=True)) for i, row in enumerate(self.matrix()))

    def shift(self, points: DataFrame, lon: str, lat: str, height: str | None = None) -> DataFrame:
        """points with degrees (and heights in metres, 0 without a column) of the other datum in place of theirs."""
        return _shifted(points, lon, lat, height, self.geocentric)


@dataclass(frozen=True)
class Backwards:
    """The same step the other way, by the inverse matrix: exact, not by turned signs."""

    of: Datum

    def geocentric(self, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
        m = self.of.matrix()
        minor = lambda i, j: (lambda a, b: a[0] * b[1] - a[1] * b[0])(*[[v for k, v in enumerate(row) if k != j] for n, row in enumerate(m) if n != i])
        whole = sum((-1) ** j * m[0][j] * minor(0, j) for j in range(3))
        inverse = [[(-1) ** (i + j) * minor(j, i) / whole for j in range(3)] for i in range(3)]
        moved = [c - s for c, s in zip((x, y, z), self.of.shifts, strict=True)]
        return tuple(sum(a * c for a, c in zip(row, moved, strict=True)) for row in inverse)

    def shift(self, points: DataFrame, lon: str, lat: str, height: str | None = None) -> DataFrame:
        return _shifted(points, lon, lat, height, self.geocentric)


def to_geocentric(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """X, Y, Z in metres of degrees and a height above the ellipsoid."""
    lam, phi = F.radians(lon), F.radians(lat)
    n = A / F.sqrt(1 - _E**2 * F.sin(phi) ** 2)
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - _E**2) + height) * F.sin(phi)


def _shifted(points: DataFrame, lon: str, lat: str, height: str | None, geocentric) -> DataFrame:
    h = F.col(height) if height else F.lit(0.0)
    x, y, z = to_geocentric(F.col(lon), F.col(lat), h)
    out = points.withColumns({"_gx": x, "_gy": y, "_gz": z})
    x, y, z = geocentric(F.col("_gx"), F.col("_gy"), F.col("_gz"))
    out = out.withColumns({"_gx": x, "_gy": y, "_gz": z})
    p, b = F.hypot("_gx", "_gy"), A * (1 - FLATTENING)
    second = _E**2 / (1 - _E**2)
    # the reduced latitude converges by a factor of some 10^-5 a step near the surface: three are exact to rounding
    out = out.withColumn("_beta", F.atan2(F.col("_gz"), (1 - FLATTENING) * p))
    for _ in range(3):
        phi = F.atan2(F.col("_gz") + second * b * F.sin("_beta") ** 3, p - _E**2 * A * F.cos("_beta") ** 3)
        out = out.withColumn("_phi", phi).withColumn("_beta", F.atan2((1 - FLATTENING) * F.sin("_phi"), F.cos("_phi")))
    made = {lon: F.degrees(F.atan2("_gy", "_gx")), lat: F.degrees("_phi")}
    if height:
        n = A / F.sqrt(1 - _E**2 * F.sin("_phi") ** 2)
        made[height] = p * F.cos("_phi") + F.col("_gz") * F.sin("_phi") - A**2 / n
    return out.withColumns(made).drop("_gx", "_gy", "_gz", "_beta", "_phi")


def columns(pair: tuple[str, str]) -> tuple[Column, Column]:
    return F.expr(pair[0]), F.expr(pair[1])


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _between(ax, ay, bx, by, px, py) -> Column:
    return px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))


def segments_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Do two closed segments (x1, y1, x2, y2) share a point?"""
    ax, ay, bx, by = a
    cx, cy, dx, dy = b
    t1, t2 = _turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy)
    t3, t4 = _turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by)
    return (((t1 * t2 < 0) & (t3 * t4 < 0)) | ((t1 == 0) & _between(ax, ay, bx, by, cx, cy)) | ((t2 == 0) & _between(ax, ay, bx, by, dx, dy))
            | ((t3 == 0) & _between(cx, cy, dx, dy, ax, ay)) | ((t4 == 0) & _between(cx, cy, dx, dy, bx, by)))


def segment_meets_box(seg: tuple[Column, ...], box: tuple[Column, ...]) -> Column:
    """Does a closed segment touch a closed axis-parallel box (x1, y1, x2, y2)? By separating axes."""
    ax, ay, bx, by = seg
    x1, y1, x2, y2 = box
    side = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    corners = [side(x1, y1), side(x1, y2), side(x2, y1), side(x2, y2)]
    return (F.greatest(ax, bx) >= x1) & (F.least(ax, bx) <= x2) & (F.greatest(ay, by) >= y1) & (F.least(ay, by) <= y2) & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)
