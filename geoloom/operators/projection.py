"""Map projections in closed form, as column expressions: equal-area conic, and azimuthal equidistant on the sphere.

Formulas: J. P. Snyder, Map Projections: A Working Manual, USGS Professional Paper 1395. Degrees and metres.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Albers:
    """Equal-area conic on an ellipsoid; by default that of the conterminous United States on GRS 80."""

    lat1: float = 29.5
    lat2: float = 45.5
    lat0: float = 23.0
    lon0: float = -96.0
    a: float = 6378137.0
    e2: float = 0.00669438002290

    @cached_property
    def e(self) -> float:
        return math.sqrt(self.e2)

    def _q(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return (1 - self.e2) * (s / (1 - self.e2 * s * s) - math.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))

    def _m2(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return (1 - s * s) / (1 - self.e2 * s * s)

    @cached_property
    def n(self) -> float:
        if self.lat1 == self.lat2:
            return math.sin(math.radians(self.lat1))
        return (self._m2(self.lat1) - self._m2(self.lat2)) / (self._q(self.lat2) - self._q(self.lat1))

    @cached_property
    def c(self) -> float:
        return self._m2(self.lat1) + self.n * self._q(self.lat1)

    @cached_property
    def rho0(self) -> float:
        return self.a * math.sqrt(self.c - self.n * self._q(self.lat0)) / self.n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        s = F.sin(F.radians(lat))
        q = (1 - self.e2) * (s / (1 - self.e2 * s * s) - F.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))
        rho = self.a * F.sqrt(self.c - self.n * q) / self.n
        theta = self.n * F.radians(lon - self.lon0)
        return rho * F.sin(theta), self.rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """By the series in the authalic latitude, which is good to about a millimetre, and one Newton step from there."""
        sign = math.copysign(1.0, self.n)
        down = self.rho0 - y
        rho = F.sqrt(x * x + down * down)
        theta = F.atan2(sign * x, sign * down)
        q = (self.c - F.pow(rho * self.n / self.a, 2)) / self.n
        beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / self._q(90.0))))
        e2, e4, e6 = self.e2, self.e2**2, self.e2**3
        lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta)
        s = F.sin(lat)
        off = q / (1 - e2) - s / (1 - e2 * s * s) + F.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e)
        step = F.when(F.cos(lat) > 1e-6, F.try_divide(F.pow(1 - e2 * s * s, 2) * off, 2 * F.cos(lat))).otherwise(F.lit(0.0))
        return self.lon0 + F.degrees(theta / self.n), F.degrees(lat + step)


def azimuthal_equidistant(lon: Column, lat: Column, lon0: float, lat0: float, radius: float = 6371007.181) -> tuple[Column, Column]:
    """Coordinates around a centre; distances from it are true. Null at the point opposite to it."""
    phi0, phi, lam = math.radians(lat0), F.radians(lat), F.radians(lon - lon0)
    cos_c = math.sin(phi0) * F.sin(phi) + math.cos(phi0) * F.cos(phi) * F.cos(lam)
    c = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_c)))
    k = F.when(cos_c > -1, F.when(F.sin(c) == 0, F.lit(1.0)).otherwise(F.try_divide(c, F.sin(c))))
    return radius * k * F.cos(phi) * F.sin(lam), radius * k * (math.cos(phi0) * F.sin(phi) - math.sin(phi0) * F.cos(phi) * F.cos(lam))


LONLAT_WKT = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'


def wkt(projection: Albers | None) -> str:
    """A projection as text; None is longitude and latitude."""
    if projection is None:
        return LONLAT_WKT
    p = projection
    flat = 1 / (1 - math.sqrt(1 - p.e2))
    base = f'GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",{p.a:.0f},{flat:.9f}]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]'
    numbers = {"standard_parallel_1": p.lat1, "standard_parallel_2": p.lat2, "latitude_of_center": p.lat0, "longitude_of_center": p.lon0, "false_easting": 0, "false_northing": 0}
    return f'PROJCS["Albers",{base},PROJECTION["Albers_Conic_Equal_Area"],' + ",".join(f'PARAMETER["{k}",{v:g}]' for k, v in numbers.items()) + ',UNIT["metre",1]]'
