"""Demonstration datasets, made by Spark from row numbers alone: any size, always the same.

Every theme has the address block with its usual faults: codes that are too short, coordinates that
are missing, swapped or out of range, cities without a name, control characters, dates in several
forms, and near copies of earlier rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STREETS = ("Hauptstraße", "Bahnhofstr.", "Gartenweg", "Lindenallee", "Am Markt", "Kirchgasse", "Schulstrasse", "Ringstr.")
CITIES = ("Berlin", "Hamburg", "München", "Köln", "Leipzig", "Bremen", "Dresden", "Mainz")
PEOPLE = ("Anna Weber", "Jonas Koch", "Lea Wolf", "Paul Braun", "Mia Lang", "Emil Roth")
COMPANIES = ("Nordlicht GmbH", "Alpen AG", "Rheinwerk KG", "Seeblick UG")


class Rows:
    """Choices that depend on the row's origin: a copy makes the same ones as the row it copies."""

    def __init__(self, copies: int, rows: int):
        i = F.col("id")
        self.row = i
        self.copy = (i > 0) & (self.dice(0, 100) < copies)
        self.origin = F.when(self.copy, F.pmod(F.xxhash64(i, F.lit("origin")), F.greatest(i, F.lit(1)))).otherwise(i)

    def dice(self, salt: int, sides: int, copied: bool = False) -> Column:
        return F.pmod(F.xxhash64(self.origin if copied else self.row, F.lit(salt)), F.lit(sides))

    def one_of(self, salt: int, values: tuple) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.dice(salt, len(values), True) + 1).cast("int"))

    def address(self) -> dict[str, Column]:
        fault = self.dice(1, 100)
        number = (self.dice(2, 180, True) + 1).cast("string")
        street = F.concat(self.one_of(3, STREETS), F.lit(" "), number)
        lat, lon = 47 + self.dice(4, 700, True) / F.lit(100.0), 6 + self.dice(5, 850, True) / F.lit(100.0)
        swapped = fault == 4
        return {
            "record_id": F.concat(F.lit("r-"), F.lpad(self.row.cast("string"), 9, "0")),
            "source_row": self.row + 1,
            "street": F.when(self.copy, F.upper(street)).when(fault == 6, F.concat(street, F.lit("\x07"))).otherwise(street),
            "city": F.when(fault != 5, self.one_of(6, CITIES)),
            "postal_code": F.when(fault == 1, "12").otherwise((10_000 + self.dice(7, 89_999, True)).cast("string")),
            "country": F.lit("DE"),
            "latitude": F.when(fault == 2, None).when(fault == 3, "999").otherwise(F.when(swapped, lon).otherwise(lat).cast("string")),
            "longitude": F.when(swapped, lat).otherwise(lon).cast("string"),
            "quality_note": F.when(self.copy, "copy").when(fault.between(1, 6), "fault").otherwise("clean"),
        }

    def day(self, salt: int) -> Column:
        day = F.date_add(F.lit("2024-01-01").cast("date"), self.dice(salt, 700, True).cast("int"))
        form = self.dice(salt + 1, 20)
        return F.when(form == 0, "no date").when(form < 4, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))

    def amount(self, salt: int, most: int) -> Column:
        value = (self.dice(salt, most * 100, True) / F.lit(100.0)).cast("string")
        return F.when(self.dice(salt + 1, 50) == 0, "n/a").when(self.dice(salt + 1, 50) > 1, value)


#: What each theme has besides the address.
THEMES = {
    "base": lambda r: {"event_date": r.day(20), "category": r.one_of(22, ("a", "b", "c"))},
    "marketing": lambda r: {
        "full_name": r.one_of(30, PEOPLE), "email": F.when(r.dice(31, 20) > 0, F.concat(F.lit("user"), r.origin.cast("string"), F.lit("@example.org"))), "company": r.one_of(32, COMPANIES),
        "campaign": r.one_of(33, ("spring", "summer")), "channel": r.one_of(34, ("mail", "web", "phone")), "utm_source": F.when(r.dice(35, 4) > 0, r.one_of(36, ("news", "search"))),
        "consent": F.when(r.dice(37, 10) > 0, r.one_of(38, ("yes", "no"))), "lead_score": r.amount(39, 100), "signup_date": r.day(41),
    },
    "security": lambda r: {"note": r.one_of(50, ("=1+1", "+cmd", "plain", "@sum")), "source_file": r.one_of(51, ("../a.csv", "b.csv")), "comment": r.one_of(52, ("<b>x</b>", "ok", "-2+3"))},
    "ecommerce": lambda r: {
        "order_number": F.concat(F.lit("o-"), r.origin.cast("string")), "customer": r.one_of(60, PEOPLE), "amount": r.amount(61, 500), "currency": r.one_of(63, ("EUR", "CHF")),
        "status": r.one_of(64, ("paid", "open", "returned")), "items": r.dice(65, 9, True) + 1, "order_date": r.day(66),
    },
    "logistics": lambda r: {"shipment_number": F.concat(F.lit("s-"), r.origin.cast("string")), "carrier": r.one_of(70, ("road", "rail", "air")), "weight_kg": r.amount(71, 900), "status": r.one_of(73, ("sent", "arrived")), "dispatch_date": r.day(74)},
}


def demo_dataset(spark: SparkSession, theme: str, rows: int = 1000, copies: int = 6) -> DataFrame:
    """A theme's rows; `copies` in a hundred repeat an earlier row with slips."""
    if theme not in THEMES:
        raise ValueError(f"unknown theme {theme!r}; there are {', '.join(THEMES)}")
    made = Rows(copies, rows)
    columns = made.address() | THEMES[theme](made)
    return spark.range(rows).select(*[c.alias(name) for name, c in columns.items()])
