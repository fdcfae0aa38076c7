"""Coordinate systems: well-known text in and out, and the projection each one names."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .projections import REGISTRY, Ellipsoid, projection


@dataclass(frozen=True)
class Crs:
    name: str
    kind: str  # geographic, projected or unknown
    datum: str = "D_WGS_1984"
    spheroid: str = "WGS_1984"
    axis: float = 6378137.0
    flattening: float = 298.257223563
    method: str = ""
    parameters: dict = field(default_factory=dict)
    unit: str = "Degree"

    def projection(self):
        """The projection of a projected system; None for others."""
        if self.kind != "projected":
            return None
        names = {
            "central_meridian": "central_meridian", "latitude_of_origin": "latitude_of_origin", "scale_factor": "scale",
            "false_easting": "false_easting", "false_northing": "false_northing",
            "standard_parallel_1": "standard_parallel_1", "standard_parallel_2": "standard_parallel_2",
        }
        cls = REGISTRY.get(self.method)
        if cls is None:
            raise ValueError(f"unknown projection {self.method!r}")
        given = {names[k]: v for k, v in self.parameters.items() if k in names}
        if self.method == "Mercator" and "standard_parallel_1" in given:
            given["standard_parallel"] = given.pop("standard_parallel_1")
        known = cls.__dataclass_fields__
        return projection(self.method, **{k: v for k, v in given.items() if k in known}, ellipsoid=Ellipsoid(self.axis, self.flattening))

    def to_wkt(self) -> str:
        if self.kind == "unknown":
            return "Unknown"
        base = (
            f'GEOGCS["{self.name if self.kind == "geographic" else "GCS_" + self.spheroid}",DATUM["{self.datum}",'
            f'SPHEROID["{self.spheroid}",{self.axis!r},{self.flattening!r}]],PRIMEM["Greenwich",0.0],'
            'UNIT["Degree",0.0174532925199433]]'
        )
        if self.kind == "geographic":
            return base
        listed = "".join(f',PARAMETER["{k}",{v!r}]' for k, v in self.parameters.items())
        return f'PROJCS["{self.name}",{base},PROJECTION["{self.method}"]{listed},UNIT["Meter",1.0]]'


WGS84 = Crs("GCS_WGS_1984", "geographic")
UNKNOWN = Crs("Unknown", "unknown", unit="")


def parse_wkt(text: str) -> Crs:
    """A system out of its text; text of another form gives the unknown one."""
    root = re.match(r'\s*(GEOGCS|PROJCS)\s*\[\s*"([^"]*)"', text or "")
    if not root:
        return UNKNOWN
    number = r"\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*"
    datum = re.search(r'DATUM\s*\[\s*"([^"]*)"', text)
    ball = re.search(rf'SPHEROID\s*\[\s*"([^"]*)"\s*,{number},{number}', text)
    shared = {
        "datum": datum[1] if datum else "",
        **({"spheroid": ball[1], "axis": float(ball[2]), "flattening": float(ball[3])} if ball else {}),
    }
    if root[1] == "GEOGCS":
        return Crs(root[2], "geographic", **shared)
    method = re.search(r'PROJECTION\s*\[\s*"([^"]*)"', text)
    parameters = {k.lower(): float(v) for k, v in re.findall(rf'PARAMETER\s*\[\s*"([^"]*)"\s*,{number}\]', text)}
    return Crs(root[2], "projected", method=method[1] if method else "", parameters=parameters, unit="Meter", **shared)


def project(df, source: Crs, target: Crs, pairs=(("x", "y"),)):
    """Coordinates of ``df`` in another system: to degrees first, then forward.

    An unknown source counts as WGS 84 degrees; datum shifts are not applied.
    """
    from .projections import map_points

    if source.kind == "projected":
        df = map_points(df, source.projection().inverse, pairs)
    if target.kind == "projected":
        df = map_points(df, target.projection().forward, pairs)
    return df
