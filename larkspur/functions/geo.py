"""Coordinates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The mean radius of the earth in metres, and the geohash alphabet.
EARTH_RADIUS = 6_371_008.8
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"

#: What counts as a number in a text; engines differ in forms such as "1d" or "0x1p3".
NUMBER = "(?U)\\A\\s*[+-]?(?:\\d(?:_?\\d)*(?:\\.(?:\\d(?:_?\\d)*)?)?|\\.\\d(?:_?\\d)*)(?:[eE][+-]?\\d(?:_?\\d)*)?\\s*\\z"


def _finite(number: Column) -> Column:
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def number_of(value: Column, kind: T.DataType, comma: bool = True) -> Column:
    """Finite double of a column of the given type, or null; `comma`: "52,5" counts as 52.5."""
    if isinstance(kind, T.NumericType):
        return _finite(value.cast("double"))
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("double")
    text = F.replace(value, F.lit(","), F.lit(".")) if comma else value
    plain = F.btrim(F.replace(F.regexp_replace(text, "(?U)\\s+", " "), F.lit("_"), F.lit("")))
    return F.when(text.rlike(NUMBER), _finite(plain.try_cast("double")))


def in_range(lat: Column, lon: Column) -> Column:
    """Whether both are there and within the world; never null."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def validation(lat: Column, lon: Column, auto_swap: bool = True) -> dict[str, Column]:
    """latitude, longitude, valid, swapped and issue of two doubles."""
    missing, direct = lat.isNull() | lon.isNull(), in_range(lat, lon)
    swapped = ~missing & ~direct & in_range(lon, lat) & F.lit(auto_swap)
    issue = F.when(missing, "missing_or_non_numeric").when(swapped, "coordinates_swapped").when(~direct, "outside_valid_range")
    return {
        "latitude": F.when(swapped, lon).otherwise(lat),
        "longitude": F.when(swapped, lat).otherwise(lon),
        "valid": direct | swapped,
        "swapped": swapped,
        "issue": issue,
    }


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points, or null if one is not valid."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.when(in_range(lat1, lon1) & in_range(lat2, lon2), 2 * EARTH_RADIUS * F.asin(F.sqrt(a)))


def in_bounding_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return in_range(lat, lon) & F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def _cell(value: Column, low: float, span: float, bits: int) -> Column:
    """Index of the value's cell after `bits` bisections. The borders are exact doubles, so one step
    of correction makes up for the rounding of the division."""
    width = span / (1 << bits)
    at = F.floor((value - low) / width)
    at = F.when(value < low + at * width, at - 1).when(value >= low + (at + 1) * width, at + 1).otherwise(at)
    return F.least(F.greatest(at, F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def geohash(lat: Column, lon: Column, precision: int = 8) -> Column:
    """Geohash of 1 to 12 characters, or null if the point is not valid."""
    if not 1 <= precision <= 12:
        raise ValueError("geohash precision must be between 1 and 12")
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    cells = (_cell(lon, -180.0, 360.0, n_lon), n_lon), (_cell(lat, -90.0, 180.0, n_lat), n_lat)
    chars = []
    for k in range(precision):
        index = F.lit(0)
        for j in range(5):
            cell, size = cells[(5 * k + j) % 2]
            bit = F.shiftright(cell, size - 1 - (5 * k + j) // 2).bitwiseAND(F.lit(1).cast("long"))
            index = index + bit * (1 << (4 - j))
        chars.append(F.substring(F.lit(GEOHASH), (index + 1).cast("int"), F.lit(1)))
    return F.when(in_range(lat, lon), F.concat(*chars))


def spatial_group(lat: Column, lon: Column, cell: float = 0.05) -> Column:
    """Name of the grid cell, or null if the point is not valid."""
    if cell <= 0:
        raise ValueError("the cell size must be positive")
    part = lambda x, low: F.floor((x + low) / F.lit(float(cell))).cast("string")
    return F.when(in_range(lat, lon), F.concat(F.lit("grid-"), part(lat, 90.0), F.lit("-"), part(lon, 180.0)))


def map_point(lat: Column, lon: Column, width: int = 600, height: int = 320) -> tuple[Column, Column]:
    """Place of a point on a plate carrée picture."""
    return (lon + 180) / 360 * width, (90 - lat) / 180 * height
