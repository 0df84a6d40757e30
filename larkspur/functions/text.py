"""Text normalisation as Column expressions.

Only Unicode compatibility composition has no built-in form. It runs as an Arrow UDF that gets null
for every ASCII value, so plain data pays for an empty Arrow column and nothing else.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters whose case folding keeps an ASCII letter that lower-casing does not give.
FOLDED_FROM, FOLDED_TO = "ŉǰẖẗẘẙẚ", "njhtwya"


@F.pandas_udf(T.StringType())
def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def compose(text: Column) -> Column:
    """NFKC form."""
    odd = text.rlike("[^\\x00-\\x7F]")
    return F.coalesce(_compose(F.when(odd, text)), text)


def clean(text: Column) -> Column:
    """Control characters to spaces, white space runs to one space, trimmed; empty becomes null."""
    spaced = F.regexp_replace(text, "[\\x00-\\x1f\\x7f-\\x9f]", " ")
    bare = F.btrim(F.regexp_replace(spaced, "(?U)\\s+", " "))
    return F.nullif(bare, F.lit(""))


def normalize_unicode(value: Column) -> Column:
    return clean(compose(value.cast("string")))


def trim_whitespace(value: Column) -> Column:
    """Trimmed, with inner white space runs as one space; an empty text stays empty."""
    return F.btrim(F.regexp_replace(value.cast("string"), "(?U)\\s+", " "))


def casefold(text: Column) -> Column:
    """Lower case with sharp s as ss and final sigma as sigma."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def key_of_normalized(text: Column) -> Column:
    """Matching key of a text that is normalised already: a-z and 0-9 only, never null."""
    folded = F.translate(casefold(F.coalesce(text, F.lit(""))), FOLDED_FROM, FOLDED_TO)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.regexp_replace(folded, "[^a-z0-9]", "")


def matching_key(value: Column) -> Column:
    return key_of_normalized(normalize_unicode(value))


def protect_cell(text: Column) -> Column:
    """A leading quote for texts that a spreadsheet would take for a formula."""
    return F.when(text.rlike("\\A[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)
