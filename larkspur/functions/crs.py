"""Coordinate reference systems in closed form, as Column arithmetic.

Geographic WGS84 / ETRS89, UTM, Web Mercator, the German Gauss-Krüger zones, the British National
Grid, Lambert-93 and the European equal-area grid. Transverse Mercator uses the Krüger series in the
third flattening to the sixth order (Karney 2011, "Transverse Mercator with an accuracy of a few
nanometers"); the conic and azimuthal projections follow Snyder (1987, "Map Projections: A Working
Manual"). Systems on other datums are reached by seven-parameter shifts, good to a few metres. Other
systems are refused with a clear error.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Axis and flattening of ellipsoids.
ELLIPSOIDS = {
    "GRS80": (6_378_137.0, 1 / 298.257222101),
    "WGS84": (6_378_137.0, 1 / 298.257223563),
    "Bessel": (6_377_397.155, 1 / 299.1528128),
    "Airy": (6_377_563.396, 1 / 299.3249646),
}
#: Shifts to WGS84 by datum: metres, arc seconds (position vector), parts per million.
SHIFTS = {
    "Bessel": (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7),
    "Airy": (446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894),
}

#: The series' coefficients by power of n, forward (alpha) and inverse (beta).
ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)


@dataclass(frozen=True)
class System:
    """kind is geographic, mercator, transverse, conic or equal_area; the rest is for projections."""

    kind: str
    ellipsoid: str = "WGS84"
    lon: float = 0.0
    lat: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    parallels: tuple[float, float] = (0.0, 0.0)


#: Systems by EPSG code.
SYSTEMS = {
    4326: System("geographic"),
    4258: System("geographic", "GRS80"),
    3857: System("mercator"),
    27700: System("transverse", "Airy", -2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0),
    2154: System("conic", "GRS80", 3.0, 46.5, 1.0, 700_000.0, 6_600_000.0, (49.0, 44.0)),
    3035: System("equal_area", "GRS80", 10.0, 52.0, 1.0, 4_321_000.0, 3_210_000.0),
}
SYSTEMS |= {31464 + z: System("transverse", "Bessel", 3.0 * z, 0.0, 1.0, z * 1e6 + 500_000.0) for z in (2, 3, 4, 5)}
for _first, _ellipsoid, _zones, _north in ((32600, "WGS84", range(1, 61), 0.0), (32700, "WGS84", range(1, 61), 10_000_000.0), (25800, "GRS80", range(28, 39), 0.0)):
    SYSTEMS |= {_first + z: System("transverse", _ellipsoid, 6.0 * z - 183, 0.0, 0.9996, 500_000.0, _north) for z in _zones}


def system(name: str) -> System:
    """The system of an EPSG code such as "EPSG:25832"."""
    found = re.fullmatch(r"(?i)\s*(?:epsg:)?(\d+)\s*", str(name))
    known = SYSTEMS.get(int(found[1])) if found else None
    if known is None:
        raise NotImplementedError(f"{name!r}: supported are EPSG:4326, 4258, 3857, 326xx, 327xx, 25828 to 25838, 31466 to 31469, 27700, 2154 and 3035")
    return known


def _series(f: float) -> tuple[float, list[float], list[float]]:
    n = f / (2 - f)
    powers = [n**k for k in range(1, 7)]
    coefficients = lambda table: [sum(c * p for c, p in zip(row, powers)) for row in table]
    return (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) / (1 + n), coefficients(ALPHA), coefficients(BETA)


def _bound(values: dict[str, Column], make) -> Column:
    """`make` of a struct of values that are computed once, however often it uses them."""
    given = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(given), make), F.lit(0))


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _chained(pair: Column, step) -> Column:
    """A step on a pair, which is there once however often the step uses it: chains grow by their
    steps, not by powers of two."""
    made = lambda v: step(v["x"], v["y"])
    return F.get(F.transform(F.array(pair), lambda v: x if isinstance(x := made(v), Column) else _pair(*x)), F.lit(0))


def _iterated(start: Column, times: int, step) -> Column:
    return F.aggregate(F.array_repeat(F.lit(0), times), start, lambda v, _: step(v))


def _arc(s: System) -> float:
    """Northing of the origin's latitude, without the false one."""
    if not s.lat:
        return 0.0
    a, f = ELLIPSOIDS[s.ellipsoid]
    mean, alpha, _ = _series(f)
    e = (f * (2 - f)) ** 0.5
    sine = math.sin(math.radians(s.lat))
    xi = math.atan(math.sinh(math.atanh(sine) - e * math.atanh(e * sine)))
    return s.scale * a * mean * (xi + sum(c * math.sin(2 * k * xi) for k, c in enumerate(alpha, 1)))


def _transverse(lon: Column, lat: Column, s: System) -> tuple[Column, Column]:
    a, f = ELLIPSOIDS[s.ellipsoid]
    mean, alpha, _ = _series(f)
    e = (f * (2 - f)) ** 0.5
    turn = F.radians(lon - F.lit(s.lon))
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.pow(F.cos(turn), 2)))
    y, x = xi, eta
    for k, c in enumerate(alpha, 1):
        y = y + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        x = x + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return s.east + s.scale * a * mean * x, s.north - _arc(s) + s.scale * a * mean * y


def _transverse_back(x: Column, y: Column, s: System) -> Column:
    a, f = ELLIPSOIDS[s.ellipsoid]
    mean, _, beta = _series(f)
    e2 = f * (2 - f)
    xi, eta = (y - s.north + _arc(s)) / (s.scale * a * mean), (x - s.east) / (s.scale * a * mean)
    p, q = xi, eta
    for k, c in enumerate(beta, 1):
        p = p - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        q = q - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    def degrees(v: Column) -> Column:
        conformal = F.sin(v["p"]) / F.sqrt(F.pow(F.sinh(v["q"]), 2) + F.pow(F.cos(v["p"]), 2))
        return _bound({"t": conformal, "turn": F.atan2(F.sinh(v["q"]), F.cos(v["p"]))}, latitude)

    def latitude(v: Column) -> Column:
        # four rounds of the fixed point tan(lat) = sinh(asinh(t') + e atanh(e sin(lat))) reach 1e-15
        step = lambda t: F.sinh(F.asinh(v["t"]) + e2**0.5 * F.atanh(e2**0.5 * t / F.sqrt(1 + t * t)))
        return _pair(s.lon + F.degrees(v["turn"]), F.degrees(F.atan(_iterated(v["t"], 4, step))))

    return _bound({"p": p, "q": q}, degrees)


def _cone(s: System) -> tuple[float, float, float, float]:
    """(excentricity, n, a F, radius of the origin) of a conic projection with two parallels."""
    a, f = ELLIPSOIDS[s.ellipsoid]
    e = (f * (2 - f)) ** 0.5
    m = lambda lat: math.cos(lat) / (1 - (e * math.sin(lat)) ** 2) ** 0.5
    q = lambda lat: math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat))  # noqa: E731  isometric latitude
    one, two, origin = (math.radians(v) for v in (*s.parallels, s.lat))
    n = (math.log(m(one)) - math.log(m(two))) / (q(two) - q(one))
    size = a * m(one) * math.exp(n * q(one)) / n
    return e, n, size, size * math.exp(-n * q(origin))


def _conic(lon: Column, lat: Column, s: System) -> tuple[Column, Column]:
    e, n, size, origin = _cone(s)
    sine = F.sin(F.radians(lat))
    radius = size * F.exp(-n * (F.atanh(sine) - e * F.atanh(e * sine)))
    turn = n * F.radians(lon - F.lit(s.lon))
    return s.east + radius * F.sin(turn), s.north + origin - radius * F.cos(turn)


def _conic_back(x: Column, y: Column, s: System) -> tuple[Column, Column]:
    e, n, size, origin = _cone(s)
    dx, dy = x - s.east, s.north + origin - y
    isometric = -F.ln(F.sqrt(dx * dx + dy * dy) / size) / n
    sine = F.tanh(isometric)
    for _ in range(6):
        sine = F.tanh(isometric + e * F.atanh(e * sine))
    return s.lon + F.degrees(F.atan2(dx, dy) / n), F.degrees(F.asin(sine))


def _authalic(e: float, sine):
    """q of a latitude's sine, of a number or a column."""
    log = (math if isinstance(sine, float) else F).atanh
    return (1 - e * e) * (sine / (1 - e * e * sine * sine) + log(e * sine) / e)


def _disc(s: System) -> tuple[float, float, float, float, float]:
    """(excentricity, q of the pole, sine and cosine of the origin's authalic latitude, D) and the radius is a sqrt(q / 2)."""
    _, f = ELLIPSOIDS[s.ellipsoid]
    e = (f * (2 - f)) ** 0.5
    pole, sine = _authalic(e, 1.0), math.sin(math.radians(s.lat))
    beta = math.asin(_authalic(e, sine) / pole)
    d = math.cos(math.radians(s.lat)) / ((1 - (e * sine) ** 2) ** 0.5 * (pole / 2) ** 0.5 * math.cos(beta))
    return e, pole, math.sin(beta), math.cos(beta), d


def _equal_area(lon: Column, lat: Column, s: System) -> tuple[Column, Column]:
    e, pole, sine, cosine, d = _disc(s)
    radius = ELLIPSOIDS[s.ellipsoid][0] * (pole / 2) ** 0.5
    beta = F.asin(F.least(F.greatest(_authalic(e, F.sin(F.radians(lat))) / pole, F.lit(-1.0)), F.lit(1.0)))
    turn = F.radians(lon - F.lit(s.lon))
    b = radius * F.sqrt(2 / (1 + sine * F.sin(beta) + cosine * F.cos(beta) * F.cos(turn)))
    return s.east + b * d * F.cos(beta) * F.sin(turn), s.north + b / d * (cosine * F.sin(beta) - sine * F.cos(beta) * F.cos(turn))


def _equal_area_back(x: Column, y: Column, s: System) -> tuple[Column, Column]:
    e, pole, sine, cosine, d = _disc(s)
    radius = ELLIPSOIDS[s.ellipsoid][0] * (pole / 2) ** 0.5
    dx, dy = (x - s.east) / d, (y - s.north) * d
    rho = F.sqrt(dx * dx + dy * dy)
    c = 2 * F.asin(rho / (2 * radius))
    side = F.when(rho == 0, F.lit(0.0)).otherwise(dy * F.sin(c) / rho)
    q = pole * (F.cos(c) * sine + side * cosine)
    newton = lambda p: p + F.pow(1 - e * e * F.sin(p) * F.sin(p), 2) / (2 * F.cos(p)) * (q - _authalic(e, F.sin(p))) / (1 - e * e)
    lat = _iterated(F.asin(q / 2), 6, newton)
    turn = F.atan2(dx * F.sin(c), rho * cosine * F.cos(c) - dy * sine * F.sin(c))
    return s.lon + F.degrees(F.when(rho == 0, F.lit(0.0)).otherwise(turn)), F.degrees(lat)


def _shift(lon: Column, lat: Column, datum: str, sign: int) -> Column:
    """Degrees from a datum to WGS84 (sign 1) or back (-1), by earth-centred coordinates."""
    (a, f), (to_a, to_f) = (ELLIPSOIDS[datum], ELLIPSOIDS["WGS84"])[::sign]
    dx, dy, dz, rx, ry, rz, ppm = (sign * v for v in SHIFTS[datum])
    rx, ry, rz, k = *(math.radians(v / 3600) for v in (rx, ry, rz)), 1 + ppm / 1e6
    e2, to_e2 = f * (2 - f), to_f * (2 - to_f)

    def centred(v: Column) -> Column:
        p, q = F.radians(v["lat"]), F.radians(v["lon"])
        n = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
        return _bound({"x": n * F.cos(p) * F.cos(q), "y": n * F.cos(p) * F.sin(q), "z": n * (1 - e2) * F.sin(p)}, moved)

    def moved(v: Column) -> Column:
        x, y, z = v["x"], v["y"], v["z"]
        return _bound({"x": dx + k * (x - rz * y + ry * z), "y": dy + k * (rz * x + y - rx * z), "z": dz + k * (-ry * x + rx * y + z)}, degrees)

    def degrees(v: Column) -> Column:
        flat = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
        bowring = lambda p: F.atan2(v["z"] + to_e2 * to_a / F.sqrt(1 - to_e2 * F.sin(p) * F.sin(p)) * F.sin(p), flat)
        return _pair(F.degrees(F.atan2(v["y"], v["x"])), F.degrees(_iterated(F.atan2(v["z"], flat * (1 - to_e2)), 4, bowring)))

    return _bound({"lon": lon, "lat": lat}, centred)


def _mercator(lon: Column, lat: Column, s: System) -> tuple[Column, Column]:
    radius = ELLIPSOIDS["WGS84"][0]
    return F.radians(lon) * radius, F.ln(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * radius


def _mercator_back(x: Column, y: Column, s: System) -> tuple[Column, Column]:
    radius = ELLIPSOIDS["WGS84"][0]
    return F.degrees(x / radius), F.degrees(2 * F.atan(F.exp(y / radius)) - F.pi() / 2)


FORWARD = {"mercator": _mercator, "transverse": _transverse, "conic": _conic, "equal_area": _equal_area}
BACK = {"mercator": _mercator_back, "transverse": _transverse_back, "conic": _conic_back, "equal_area": _equal_area_back}


def transform(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """(x, y) in the target system; x is longitude or easting. Null where the result is not finite."""
    a, b = system(source), system(target)
    shifts = [(s.ellipsoid, sign) for s, sign in ((a, 1), (b, -1)) if s.ellipsoid in SHIFTS and a.ellipsoid != b.ellipsoid]
    finite = lambda u, v: F.coalesce(~F.isnan(u) & ~F.isnan(v) & (F.abs(u) < float("inf")) & (F.abs(v) < float("inf")), F.lit(False))
    if a.kind == "geographic" and not shifts:
        if a != b and b.kind != "geographic":
            x, y = FORWARD[b.kind](x, y, b)
        return F.when(finite(x, y), x), F.when(finite(x, y), y)
    steps = []
    if a != b and {a.kind, b.kind} != {"geographic"}:
        steps += [partial(BACK[a.kind], s=a)] if a.kind in BACK else []
        steps += [partial(_shift, datum=datum, sign=sign) for datum, sign in shifts]
        steps += [partial(FORWARD[b.kind], s=b)] if b.kind in FORWARD else []
    pair = _pair(x, y)
    for step in steps:
        pair = _chained(pair, step)
    pair = F.get(F.transform(F.array(pair), lambda v: F.when(finite(v["x"], v["y"]), v)), F.lit(0))
    return pair["x"], pair["y"]
