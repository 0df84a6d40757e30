import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import address, crs, geo, similarity, text


def values(spark, rows, kind, *columns):
    frame = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], kind)
    return [tuple(r) for r in frame.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()]


def one(spark, rows, column):
    return [r[0] for r in values(spark, rows, "v string", column)]


def test_text(spark):
    v = F.col("v")
    assert one(spark, [None, "", " \t ", "a\x00b", "ﬁ x", "  a \n b "], text.normalize_unicode(v)) == [None, None, None, "a b", "fi x", "a b"]
    assert one(spark, [None, "", " a   b "], text.trim_whitespace(v)) == [None, "", "a b"]
    assert one(spark, [" D-10115 ", None, "Straße", "Größe ÄÖÜ", "ẞ", "ＡＢ１"], text.matching_key(v)) == ["d10115", "", "strasse", "groesseaeoeue", "ss", "ab1"]
    assert one(spark, ["=1+1", "+a", "-a", "@a", "\ta", "\ra", "a=1", "", None], text.protect_cell(v)) == ["'=1+1", "'+a", "'-a", "'@a", "'\ta", "'\ra", "a=1", "", None]


def test_addresses(spark):
    v, de = F.col("v"), F.lit("DE")
    assert one(spark, ["  müller str.  ", "Hauptstrasse 12 b", "teststr.1", "STRASSE", "Am Markt; 3", None, " .,"], address.normalize_street(v)) == ["Müller Straße", "Hauptstraße 12 B", "Teststraße1", "Straße", "Am Markt 3", None, None]
    street = address.normalize_street(v)
    assert values(spark, ["Hauptstrasse 12 b", "Hauptstr. 5 - 7", "Hauptstr.", None], "v string", address.street_part(street), address.house_number(street)) == [("Hauptstraße", "12B"), ("Hauptstraße", "5-7"), ("Hauptstraße", None), (None, None)]
    assert one(spark, ["D-10115", "123", None, "abc", "10115"], address.validate_postal_code(v, de)) == [True, False, False, False, True]
    assert one(spark, ["1010", "A-1010", "10115"], address.validate_postal_code(v, F.lit("AT"))) == [True, True, False]
    assert one(spark, ["1234ab", "1234 AB", "12"], address.normalize_postal_code(v, F.lit("NL"))) == ["1234 AB", "1234 AB", "12"]
    assert one(spark, ["12345", "1\n"], address.validate_postal_code(v, F.lit("PL"))) == [True, False]
    assert one(spark, ["germany", "D", "Österreich.", "Poland", "", None], address.normalize_country_code(v)) == ["DE", None, "AT", "PO", None, None]
    assert one(spark, ["NEW  york", "o'neil-foo, x", None], address.normalize_city(v)) == ["New York", "O'neil-foo X", None]


def test_numbers(spark):
    from pyspark.sql import types as T

    rows = ["52,5", " 1.5 ", "1e3", "1d", "0x1p3", "nan", "inf", "1_000", "", None, "a", ".5", "5."]
    assert one(spark, rows, geo.number_of(F.col("v"), T.StringType())) == [52.5, 1.5, 1000.0, None, None, None, None, 1000.0, None, None, None, 0.5, 5.0]
    assert one(spark, ["52,5"], geo.number_of(F.col("v"), T.StringType(), comma=False)) == [None]


def test_coordinates(spark):
    found = geo.validation(F.col("lat"), F.col("lon"))
    rows = [(52.0, 13.0), (120.0, 52.0), (200.0, 200.0), (None, 1.0), (90.0, 180.0)]
    got = values(spark, rows, "lat double, lon double", *found.values())
    assert got == [(52.0, 13.0, True, False, None), (52.0, 120.0, True, True, "coordinates_swapped"), (200.0, 200.0, False, False, "outside_valid_range"), (None, 1.0, False, False, "missing_or_non_numeric"), (90.0, 180.0, True, False, None)]
    kept = geo.validation(F.col("lat"), F.col("lon"), auto_swap=False)
    assert values(spark, [(120.0, 52.0)], "lat double, lon double", kept["valid"], kept["swapped"]) == [(False, False)]
    d = geo.haversine(F.col("lat"), F.col("lon"), F.lit(53.5511), F.lit(9.9937))
    ((metres,),) = values(spark, [(52.52, 13.405)], "lat double, lon double", d)
    assert abs(metres - 255_000) < 0.03 * 255_000
    assert values(spark, [(91.0, 0.0)], "lat double, lon double", d) == [(None,)]


def plain_geohash(lat, lon, precision):
    box, out, bits, value, even = {True: [-180.0, 180.0], False: [-90.0, 90.0]}, "", 0, 0, True
    while len(out) < precision:
        low, high = box[even]
        middle, x = (low + high) / 2, lon if even else lat
        value = value * 2 + (x >= middle)
        box[even] = [middle, high] if x >= middle else [low, middle]
        even, bits = not even, bits + 1
        if bits == 5:
            out, bits, value = out + geo.GEOHASH[value], 0, 0
    return out


def test_geohash_and_grid(spark):
    random.seed(3)
    rows = [(random.uniform(-90, 90), random.uniform(-180, 180)) for _ in range(300)] + [(0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (45.0, 90.0), (math.nextafter(45.0, 0), math.nextafter(90.0, 0)), (22.5, 11.25)]
    for precision in (1, 5, 8, 12):
        got = values(spark, rows, "lat double, lon double", geo.geohash(F.col("lat"), F.col("lon"), precision))
        assert [g for (g,) in got] == [plain_geohash(*r, precision) for r in rows]
    assert values(spark, [(52.52, 13.405), (91.0, 0.0)], "lat double, lon double", geo.spatial_group(F.col("lat"), F.col("lon"))) == [("grid-2850-3868",), (None,)]
    with pytest.raises(ValueError):
        geo.geohash(F.col("lat"), F.col("lon"), 13)


def snyder(lat, lon, central=9.0):
    """Transverse Mercator by another series (Snyder 1987), good to a few millimetres near the middle."""
    a, f = crs.ELLIPSOIDS["GRS80"]
    e2 = f * (2 - f)
    ep, p = e2 / (1 - e2), math.radians(lat)
    n, t, c, q = a / math.sqrt(1 - e2 * math.sin(p) ** 2), math.tan(p) ** 2, ep * math.cos(p) ** 2, math.cos(p) * math.radians(lon - central)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))
    x = n * (q + (1 - t + c) * q**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * q**5 / 120)
    y = m + n * math.tan(p) * (q * q / 2 + (5 - t + 9 * c + 4 * c * c) * q**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * q**6 / 720)
    return 500_000 + 0.9996 * x, 0.9996 * y


def test_reference_systems(spark):
    rows = [(9.0, 48.0), (10.5, 51.0), (8.0, 54.0)]
    x, y = crs.transform(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:25832")
    for (lon, lat), (e, n) in zip(rows, values(spark, rows, "x double, y double", x, y)):
        assert (e, n) == pytest.approx(snyder(lat, lon), abs=0.02)
    far = [(13.405, 52.52), (6.0, 0.5), (12.0, -33.0)]
    frame = spark.createDataFrame(far, "x double, y double")
    for code in ("EPSG:25832", "EPSG:32733", "EPSG:3857"):
        a, b = crs.transform(F.col("x"), F.col("y"), "EPSG:4326", code)
        back = crs.transform(F.col("a"), F.col("b"), code, "EPSG:4326")
        got = frame.select(a.alias("a"), b.alias("b")).select(*[c.alias(f"c{i}") for i, c in enumerate(back)]).collect()
        for r, want in zip(got, far):
            assert tuple(r) == pytest.approx(want, abs=1e-6)
    ((e, n),) = values(spark, [far[0]], "x double, y double", x, y)
    assert (e, n) == pytest.approx((798812.803, 5827999.900), abs=0.01)
    with pytest.raises(NotImplementedError):
        crs.transform(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:2056")


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if c == d else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc1", max_size=90), st.text("abc1", max_size=90))
def test_lcs(a, b):
    assert similarity.lcs_length(a, b) == plain_lcs(a, b)


def test_ratio_forms_agree(spark):
    rows = [("hauptstrasse", "hauptstr"), ("", ""), ("", "a"), ("abc", "abc"), ("kitten", "sitting"), (None, "a")]
    frame = spark.createDataFrame(rows, "a string, b string")
    got = frame.select(similarity.ratio(F.col("a"), F.col("b")).alias("x"), similarity.ratio_native(F.col("a"), F.col("b")).alias("y")).collect()
    for (a, b), r in zip(rows[:-1], got):
        assert r["x"] == pytest.approx(r["y"]) == pytest.approx(similarity.ratio_of(a, b))


@settings(max_examples=25, deadline=None)
@given(value=st.text(max_size=30))
def test_normalisers_are_idempotent(spark, value):
    first = text.normalize_unicode(F.lit(value))
    a, b = spark.range(1).select(first.alias("a"), text.normalize_unicode(first).alias("b")).first()
    assert a == b and (a is None or not any(ord(c) < 32 for c in a))


def test_more_systems(spark):
    points = spark.createDataFrame([(5.0, 50.0), (2.3522, 48.8566), (13.4, 52.5), (1.716073972, 52.658007833)], "lon double, lat double")

    def at(code, row):
        x, y = crs.transform(F.col("lon"), F.col("lat"), "EPSG:4326", code)
        return points.select(x, y).collect()[row]

    assert np.allclose(at("EPSG:3035", 0), (3962799.45, 2999718.85), atol=0.01)
    assert np.allclose(at("EPSG:2154", 1), (652469.02, 6862035.26), atol=0.05)
    assert np.allclose(at("EPSG:27700", 3), (651409.8, 313177.4), atol=6)  # the shift is good to a few metres
    x, y = at("EPSG:31468", 2)
    plain = crs._transverse(F.col("lon"), F.col("lat"), crs.system("EPSG:31468"))
    px, py = points.select(*plain).collect()[2]
    assert 20 < math.hypot(x - px, y - py) < 300 and 4_500_000 < x < 4_700_000
    for code in ("EPSG:3035", "EPSG:2154", "EPSG:27700", "EPSG:31466", "EPSG:31469", "EPSG:32633"):
        there = crs.transform(F.col("lon"), F.col("lat"), "EPSG:4326", code)
        back = points.select("lon", "lat", there[0].alias("x"), there[1].alias("y"))
        lon, lat = crs.transform(F.col("x"), F.col("y"), code, "EPSG:4326")
        for r in back.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
            assert abs(r["lon"] - r["lon2"]) < 3e-7 and abs(r["lat"] - r["lat2"]) < 3e-7, code  # the shift back is the shift reversed, good to centimetres
    one, two = crs.transform(*crs.transform(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:31467"), "EPSG:31467", "EPSG:25832"), crs.transform(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:25832")
    for r in points.select(one[0].alias("a"), one[1].alias("b"), two[0].alias("c"), two[1].alias("d")).collect():
        assert math.hypot(r["a"] - r["c"], r["b"] - r["d"]) < 0.02
