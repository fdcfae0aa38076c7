"""Map projections and datum offsets as Column expressions.

A projection turns (lon, lat) in degrees into metres and back; each is a frozen set of
parameters with ``forward`` and ``inverse``, both returning struct<x, y>. Iterative
inverses are unrolled to a fixed number of steps, enough for double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WGS84_AXIS = 6378137.0
WGS84_FLATTENING = 298.257223563


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


@dataclass(frozen=True)
class Ellipsoid:
    axis: float = WGS84_AXIS
    flattening: float = WGS84_FLATTENING

    @property
    def e2(self) -> float:
        f = 1 / self.flattening
        return f * (2 - f)

    @property
    def second_e2(self) -> float:
        return self.e2 / (1 - self.e2)

    def meridian_series(self, terms: int = 6) -> list[float]:
        """A0..A(2n) with arc = axis * (1 - e2) * (A0 B + sum A2k sin 2kB).

        The integrand is expanded as sum of binomial(3/2 + k - 1, k) e2^k sin^2k, whose
        powers of the sine are sums of cosines of multiples.
        """
        cosines, weight = [0.0] * terms, 1.0
        for k in range(terms):
            if k:
                weight *= (0.5 + k) / k * self.e2
            for j in range(k + 1):
                share = math.comb(2 * k, k - j) / 4**k * (1 if j == 0 else 2 * (-1) ** j)
                cosines[j] += weight * share
        return [c if j == 0 else c / (2 * j) for j, c in enumerate(cosines)]

    def meridian_arc(self, lat: Column) -> Column:
        series = self.meridian_series()
        arc = lat * series[0]
        for j, c in enumerate(series[1:], 1):
            arc = arc + F.sin(lat * (2 * j)) * c
        return arc * (self.axis * (1 - self.e2))


@dataclass(frozen=True)
class GaussKruger:
    central_meridian: float = 0.0
    false_easting: float = 500000.0
    false_northing: float = 0.0
    scale: float = 1.0
    ellipsoid: Ellipsoid = field(default_factory=Ellipsoid)

    def forward(self, lon: Column, lat: Column) -> Column:
        """Sixth-order series about the central meridian."""
        e = self.ellipsoid
        b, diff = F.radians(lat), F.radians(lon) - math.radians(self.central_meridian)
        t2, n2 = F.tan(b) * F.tan(b), F.cos(b) * F.cos(b) * e.second_e2
        radius = F.lit(e.axis) / F.sqrt(1 - F.sin(b) * F.sin(b) * e.e2)
        p = diff * F.cos(b)
        p2 = p * p
        north = e.meridian_arc(b) + radius * F.tan(b) * p2 * (
            F.lit(0.5)
            + p2 / 24 * (5 - t2 + 9 * n2 + 4 * n2 * n2)
            + p2 * p2 / 720 * (61 - 58 * t2 + t2 * t2 + 270 * n2 - 330 * n2 * t2)
        )
        east = radius * p * (
            1
            + p2 / 6 * (1 - t2 + n2)
            + p2 * p2 / 120 * (5 - 18 * t2 + t2 * t2 + 14 * n2 - 58 * n2 * t2)
        )
        return _xy(east * self.scale + self.false_easting, north * self.scale + self.false_northing)

    def inverse(self, x: Column, y: Column) -> Column:
        e = self.ellipsoid
        arc = (y - self.false_northing) / self.scale
        series = e.meridian_series()
        unit = arc / (e.axis * (1 - e.e2))

        def closer(b):
            wave = sum((F.sin(b * (2 * j)) * c for j, c in enumerate(series[1:], 1)), F.lit(0.0))
            return (unit - wave) / series[0]

        start = unit / series[0]
        foot = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, lambda b, _: closer(b))

        def solve(b):
            t2, n2 = F.tan(b) * F.tan(b), F.cos(b) * F.cos(b) * e.second_e2
            root = F.sqrt(1 - F.sin(b) * F.sin(b) * e.e2)
            prime, meridian = F.lit(e.axis) / root, F.lit(e.axis * (1 - e.e2)) / (root * root * root)
            d = (x - self.false_easting) / self.scale / prime
            d2 = d * d
            lat = b - F.tan(b) * prime / meridian * d2 * (
                F.lit(0.5)
                - d2 / 24 * (5 + 3 * t2 + n2 - 9 * n2 * t2)
                + d2 * d2 / 720 * (61 + 90 * t2 + 45 * t2 * t2)
            )
            lon = d / F.cos(b) * (
                1
                - d2 / 6 * (1 + 2 * t2 + n2)
                + d2 * d2 / 120 * (5 + 28 * t2 + 24 * t2 * t2 + 6 * n2 + 8 * n2 * t2)
            )
            return _xy(F.degrees(lon) + self.central_meridian, F.degrees(lat))

        return let(foot, solve)


@dataclass(frozen=True)
class TransverseMercator(GaussKruger):
    """The same series with a scale on the central meridian."""

    scale: float = 0.9996


@dataclass(frozen=True)
class Mercator:
    central_meridian: float = 0.0
    standard_parallel: float = 0.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    ellipsoid: Ellipsoid = field(default_factory=Ellipsoid)

    @property
    def _k(self) -> float:
        phi = math.radians(self.standard_parallel)
        return self.ellipsoid.axis * math.cos(phi) / math.sqrt(1 - self.ellipsoid.e2 * math.sin(phi) ** 2)

    def forward(self, lon: Column, lat: Column) -> Column:
        e, b = math.sqrt(self.ellipsoid.e2), F.radians(lat)
        swollen = F.tan(b / 2 + math.pi / 4) * F.pow((1 - F.sin(b) * e) / (1 + F.sin(b) * e), F.lit(e / 2))
        x = (F.radians(lon) - math.radians(self.central_meridian)) * self._k
        return _xy(x + self.false_easting, F.log(swollen) * self._k + self.false_northing)

    def inverse(self, x: Column, y: Column) -> Column:
        lat = _isometric_inverse(F.exp(-(y - self.false_northing) / self._k), self.ellipsoid)
        lon = F.degrees((x - self.false_easting) / self._k) + self.central_meridian
        return _xy(lon, F.degrees(lat))


def _isometric_inverse(t: Column, ellipsoid: Ellipsoid) -> Column:
    e = math.sqrt(ellipsoid.e2)

    def closer(b):
        return F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - F.sin(b) * e) / (1 + F.sin(b) * e), F.lit(e / 2)))

    start = F.lit(math.pi / 2) - 2 * F.atan(t)
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, lambda b, _: closer(b))


@dataclass(frozen=True)
class LambertConformal:
    central_meridian: float = 0.0
    latitude_of_origin: float = 0.0
    standard_parallel_1: float = 25.0
    standard_parallel_2: float = 47.0
    false_easting: float = 0.0
    false_northing: float = 0.0
    ellipsoid: Ellipsoid = field(default_factory=Ellipsoid)

    def _cone(self) -> tuple[float, float, float]:
        """Cone constant, radius factor and radius at the origin."""
        e2 = self.ellipsoid.e2
        e = math.sqrt(e2)

        def m(p):
            return math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)

        def t(p):
            return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

        a, b = math.radians(self.standard_parallel_1), math.radians(self.standard_parallel_2)
        n = math.sin(a) if a == b else (math.log(m(a)) - math.log(m(b))) / (math.log(t(a)) - math.log(t(b)))
        factor = m(a) / (n * t(a) ** n)
        return n, factor, self.ellipsoid.axis * factor * t(math.radians(self.latitude_of_origin)) ** n

    def forward(self, lon: Column, lat: Column) -> Column:
        n, factor, origin = self._cone()
        e, b = math.sqrt(self.ellipsoid.e2), F.radians(lat)
        t = F.tan(F.lit(math.pi / 4) - b / 2) / F.pow((1 - F.sin(b) * e) / (1 + F.sin(b) * e), F.lit(e / 2))
        radius = F.pow(t, F.lit(n)) * (self.ellipsoid.axis * factor)
        turn = (F.radians(lon) - math.radians(self.central_meridian)) * n
        return _xy(
            radius * F.sin(turn) + self.false_easting,
            F.lit(origin) - radius * F.cos(turn) + self.false_northing,
        )

    def inverse(self, x: Column, y: Column) -> Column:
        n, factor, origin = self._cone()
        sign = math.copysign(1, n)
        dx, dy = x - self.false_easting, F.lit(origin) - (y - self.false_northing)
        radius = F.sqrt(dx * dx + dy * dy)
        t = F.pow(radius / (self.ellipsoid.axis * abs(factor)), F.lit(1 / n))
        lat = _isometric_inverse(t, self.ellipsoid)
        lon = F.degrees(F.atan2(dx * sign, dy * sign) / n) + self.central_meridian
        return _xy(lon, F.degrees(lat))


REGISTRY = {
    "Gauss_Kruger": GaussKruger,
    "Mercator": Mercator,
    "Transverse_Mercator": TransverseMercator,
    "Lambert_Conformal_Conic": LambertConformal,
}


def projection(name: str, **parameters):
    """A projection by the name that coordinate systems use for it."""
    if name not in REGISTRY:
        raise ValueError(f"unknown projection {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](**parameters)


# Fixed values of the published offset polynomials.
_KRASOVSKY_AXIS = 6378245.0
_KRASOVSKY_E2 = 0.00669342162296594323
_BD_PI = 3.141592653589793 * 3000.0 / 180.0
_BD_SHIFT = (0.0065, 0.006)


def _waves(v: Column, terms: list[tuple[float, float]]) -> Column:
    """Two thirds of a sum of amplitude * sin(pi * v * frequency)."""
    return sum((F.sin(v * (math.pi * f)) * a for a, f in terms), F.lit(0.0)) * 2 / 3


def _gcj_shift(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lon - 105.0, lat - 35.0
    common = [(20, 6), (20, 2)]
    north = -100.0 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x))
    north = north + _waves(x, common) + _waves(y, [(20, 1), (40, 1 / 3), (160, 1 / 12), (320, 1 / 30)])
    east = 300.0 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x))
    east = east + _waves(x, common) + _waves(x, [(20, 1), (40, 1 / 3), (150, 1 / 12), (300, 1 / 30)])
    sine = F.sin(F.radians(lat))
    w = 1 - sine * sine * _KRASOVSKY_E2
    per_lat = F.lit(_KRASOVSKY_AXIS * (1 - _KRASOVSKY_E2)) / (w * F.sqrt(w)) * math.pi
    per_lon = F.lit(_KRASOVSKY_AXIS) / F.sqrt(w) * F.cos(F.radians(lat)) * math.pi
    return east * 180 / per_lon, north * 180 / per_lat


def gcj02_forward(lon: Column, lat: Column) -> Column:
    dx, dy = _gcj_shift(lon, lat)
    return _xy(lon + dx, lat + dy)


def gcj02_inverse(lon: Column, lat: Column) -> Column:
    """One step back: the offset at the shifted place stands for that at the true one."""
    dx, dy = _gcj_shift(lon, lat)
    return _xy(lon - dx, lat - dy)


def bd09_forward(lon: Column, lat: Column) -> Column:
    """From GCJ-02 coordinates."""
    z = F.sqrt(lon * lon + lat * lat) + F.sin(lat * _BD_PI) * 0.00002
    turn = F.atan2(lat, lon) + F.cos(lon * _BD_PI) * 0.000003
    return _xy(z * F.cos(turn) + _BD_SHIFT[0], z * F.sin(turn) + _BD_SHIFT[1])


def bd09_inverse(lon: Column, lat: Column) -> Column:
    """To GCJ-02 coordinates."""
    x, y = lon - _BD_SHIFT[0], lat - _BD_SHIFT[1]
    z = F.sqrt(x * x + y * y) - F.sin(y * _BD_PI) * 0.00002
    turn = F.atan2(y, x) - F.cos(x * _BD_PI) * 0.000003
    return _xy(z * F.cos(turn), z * F.sin(turn))


OFFSETS = {
    ("gcj02", "forward"): gcj02_forward,
    ("gcj02", "inverse"): gcj02_inverse,
    ("bd09", "forward"): bd09_forward,
    ("bd09", "inverse"): bd09_inverse,
}


def map_points(df: DataFrame, change, pairs=(("x", "y"),)) -> DataFrame:
    """Replace each (x, y) pair of columns by ``change(x, y)``; layers, tracks or trips."""
    out = df
    for x, y in pairs:
        out = (
            out.withColumn("_xy", change(F.col(x), F.col(y)))
            .withColumn(x, F.col("_xy.x"))
            .withColumn(y, F.col("_xy.y"))
            .drop("_xy")
        )
    return out
