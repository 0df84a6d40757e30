"""Address, coordinate and quarantine steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address, crs, geo, text
from .cleaning import replaced
from .rows import named, require


def normalize_address(frame: DataFrame, street: str = "street", city: str = "city", postal: str = "postal_code", country: str | None = "country") -> DataFrame:
    """Adds originals, normalised parts and the postal verdict. Normalised texts are computed once,
    in a projection of their own, as several columns build on each."""
    require(frame, [street, city, postal], "Address columns not found")
    own = {"__street": named(street), "__city": named(city), "__postal": named(postal)}
    if country is not None and country in frame.columns:
        own["__country"] = named(country)
    cleaned = frame.select("*", *[text.normalize_unicode(v).alias(k) for k, v in own.items()])
    code = address.country_of_normalized(F.col("__country")) if "__country" in own else F.lit("DE")
    parts = cleaned.select("*", address.street_of_normalized(F.col("__street")).alias("__road"), code.alias("__code"), address.postal_of_normalized(F.col("__postal"), F.coalesce(code, F.lit("DE"))).alias("__plz"))
    new = {
        "street_original": named(street),
        "street_normalized": address.street_part(F.col("__road")),
        "house_number_normalized": address.house_number(F.col("__road")),
        "city_original": named(city),
        "city_normalized": address.city_of_normalized(F.col("__city")),
        "postal_code_original": named(postal),
        "postal_code_normalized": F.col("__plz"),
        "postal_code_valid": address.postal_holds(F.col("__plz"), F.coalesce("__code", F.lit("DE"))),
        "country_normalized": F.col("__code"),
    }
    return replaced(parts, new).drop(*own, "__road", "__code", "__plz")


def validate_postal_code(frame: DataFrame, column: str = "postal_code", country: str = "DE", output: str = "postal_code_valid") -> DataFrame:
    """One country for all rows; a null stays null."""
    require(frame, [column])
    return replaced(frame, {output: F.when(named(column).isNotNull(), address.validate_postal_code(named(column), F.lit(country)))})


def validate_coordinates(frame: DataFrame, latitude: str = "latitude", longitude: str = "longitude", auto_swap: bool = True) -> DataFrame:
    require(frame, [latitude, longitude], "Coordinate columns not found")
    numbers = frame.select("*", *[geo.number_of(named(c), frame.schema[c].dataType).alias(k) for k, c in (("__lat", latitude), ("__lon", longitude))])
    found = geo.validation(F.col("__lat"), F.col("__lon"), auto_swap)
    new = {"latitude_validated": found["latitude"], "longitude_validated": found["longitude"], "coordinates_valid": found["valid"], "coordinates_swapped": found["swapped"], "coordinate_issue": found["issue"]}
    return replaced(numbers, new).drop("__lat", "__lon")


def transform_crs(frame: DataFrame, x: str = "longitude", y: str = "latitude", source: str = "EPSG:4326", target: str = "EPSG:25832", out_x: str = "easting", out_y: str = "northing") -> DataFrame:
    require(frame, [x, y])
    numbers = frame.select("*", *[geo.number_of(named(c), frame.schema[c].dataType, comma=False).alias(k) for k, c in (("__x", x), ("__y", y))])
    a, b = crs.transform(F.col("__x"), F.col("__y"), source, target)
    return replaced(numbers, {out_x: a, out_y: b}).drop("__x", "__y")


def calculate_distance(frame: DataFrame, reference_latitude: float, reference_longitude: float, latitude: str = "latitude", longitude: str = "longitude", output: str = "distance_meters") -> DataFrame:
    require(frame, [latitude, longitude])
    lat, lon = (geo.number_of(named(c), frame.schema[c].dataType, comma=False) for c in (latitude, longitude))
    return replaced(frame, {output: geo.haversine(lat, lon, F.lit(float(reference_latitude)), F.lit(float(reference_longitude)))})


def quarantine_mask(frame: DataFrame, condition: str, required: list[str]):
    """True for rows to set aside; never null."""
    wrong = lambda c: ~F.coalesce(named(c), F.lit(False))
    if condition == "missing_required":
        require(frame, required)
        mask = F.lit(False)
        for c in required:
            mask = mask | named(c).isNull() | F.coalesce(named(c).cast("string") == "", F.lit(False))
        return mask
    columns = {"invalid_postal_code": ["postal_code_valid"], "invalid_coordinates": ["coordinates_valid"]}.get(condition)
    if columns is None:
        columns = [c for c in ("postal_code_valid", "coordinates_valid") if c in frame.columns]
        if not columns:
            raise ValueError("No validation result columns exist for quarantine")
    elif columns[0] not in frame.columns:
        raise ValueError(f"{columns[0]} is required before this quarantine")
    mask = wrong(columns[0])
    for c in columns[1:]:
        mask = mask | wrong(c)
    return mask


def quarantine(frame: DataFrame, condition: str, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows set aside with quarantine_reason)."""
    mask = quarantine_mask(frame, condition, required or [])
    return frame.where(~mask), replaced(frame.where(mask), {"quarantine_reason": F.lit(condition)})


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all, by name; missing columns are null, and columns of different types become text."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    mixed = {c for c in names if len({f.schema[c].dataType for f in frames if c in f.columns}) > 1}
    frames = [replaced(f, {c: named(c).cast("string") for c in f.columns if c in mixed}) if mixed else f for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def coordinate_counts(frame: DataFrame) -> DataFrame:
    """One row: rows, and how many of them have valid and swapped coordinates, after their validation."""
    return frame.agg(F.count("*").alias("rows"), F.count_if("coordinates_valid").alias("valid"), F.count_if("coordinates_swapped").alias("swapped"))
