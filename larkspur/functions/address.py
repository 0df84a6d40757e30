"""Postal addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, normalize_unicode

#: Country names and codes, and the postal code patterns of countries.
COUNTRIES = {
    "de": "DE", "deu": "DE", "deutschland": "DE", "germany": "DE",
    "at": "AT", "aut": "AT", "österreich": "AT", "austria": "AT",
    "ch": "CH", "che": "CH", "schweiz": "CH", "switzerland": "CH",
    "fr": "FR", "france": "FR",
    "nl": "NL", "netherlands": "NL",
}
POSTAL_PATTERNS = {"DE": "\\d{5}", "AT": "\\d{4}", "CH": "\\d{4}", "FR": "\\d{5}", "NL": "\\d{4} [A-Z]{2}"}
OTHER_PATTERN = "[A-Z0-9 -]{3,10}"
#: Fixed value: what a house number at the end of a street looks like.
HOUSE = "^(.*?)[,\\s]+(\\d{1,5}(?:\\s*[-/]\\s*\\d{1,5})?\\s*[A-Za-z]?)\\z"


def _spaced(text: Column) -> Column:
    """Separators between address parts as one space."""
    return F.regexp_replace(text, "(?U)\\s*[,;|]+\\s*", " ")


def street_of_normalized(text: Column) -> Column:
    road = F.regexp_replace(casefold(_spaced(text)), "(?U)(?:str\\b\\.?|strasse\\b)", "straße")
    bare = F.btrim(F.regexp_replace(road, "(?U)\\s+", " "), F.lit(" .,"))
    return F.nullif(F.initcap(bare), F.lit(""))


def normalize_street(value: Column) -> Column:
    """Street with words capitalised and every form of the German word for street written out."""
    return street_of_normalized(normalize_unicode(value))


def street_part(street: Column) -> Column:
    """Of a normalised street, what stands before the house number."""
    return F.btrim(F.regexp_replace(street, "(?U)" + HOUSE, "$1"))


def house_number(street: Column) -> Column:
    """Of a normalised street, the house number, or null."""
    found = F.regexp_replace(F.regexp_extract(street, "(?U)" + HOUSE, 2), "(?U)\\s+", "")
    return F.nullif(F.upper(found), F.lit(""))


def city_of_normalized(text: Column) -> Column:
    bare = F.btrim(_spaced(text), F.lit(" .,"))
    return F.initcap(F.btrim(F.regexp_replace(bare, "(?U)\\s+", " ")))


def normalize_city(value: Column) -> Column:
    return city_of_normalized(normalize_unicode(value))


def country_of_normalized(text: Column) -> Column:
    """Country code of a normalised text."""
    key = F.btrim(casefold(text), F.lit(" ."))
    known = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.when(F.char_length(key) >= 2, F.upper(key).substr(1, 2)))


def normalize_country_code(value: Column) -> Column:
    return country_of_normalized(normalize_unicode(value))


def postal_of_normalized(text: Column, code: Column) -> Column:
    """Postal code of a normalised text for a country code."""
    bare = F.regexp_replace(text, "^(?:[dD]|[dD][eE]|[aA]|[aA][tT]|[cC][hH])[-\\s]", "")
    dutch = F.regexp_replace(F.upper(F.regexp_replace(bare, "(?U)\\s+", "")), "\\A(.{4})(.{2})\\z", "$1 $2")
    return F.when(code == "NL", dutch).otherwise(F.regexp_replace(bare, "(?U)\\D", ""))


def postal_holds(postal: Column, code: Column) -> Column:
    """Whether a normalised postal code fits its country; false for null. One pattern over both
    texts, so that neither expression is repeated where the predicate is pushed down."""
    known = "|".join(f"{country}:(?:{pattern})" for country, pattern in POSTAL_PATTERNS.items())
    other = f"(?!(?:{'|'.join(POSTAL_PATTERNS)}):)[^:]*:{OTHER_PATTERN}"
    return F.coalesce(F.concat(code, F.lit(":"), postal).rlike(f"(?U)\\A(?:{known}|{other})\\z"), F.lit(False))


def country_or_default(value: Column) -> Column:
    return F.coalesce(normalize_country_code(value), F.lit("DE"))


def normalize_postal_code(value: Column, country: Column) -> Column:
    return postal_of_normalized(normalize_unicode(value), country_or_default(country))


def validate_postal_code(value: Column, country: Column) -> Column:
    return postal_holds(normalize_postal_code(value, country), country_or_default(country))
