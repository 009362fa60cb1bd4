"""Text expressions. Each helper takes and returns Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens read as missing, and tokens read as booleans.
NULL_TOKENS = ("", "null", "none", "na", "n/a", "nan", "missing")
BOOLEAN_TOKENS = ("true", "false", "yes", "no", "y", "n", "0", "1")

# Name parts that hint at information from after the prediction time.
FUTURE_NAME_PARTS = ("next_", "future_", "after_", "final_", "actual_", "realized_", "post_")

WHITESPACE = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    """Trim every kind of ASCII white space, not blanks alone."""
    return F.btrim(c, F.lit(WHITESPACE))


def cell(c: Column) -> Column:
    """A trimmed text cell; null reads as empty text."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def is_null_token(c: Column) -> Column:
    return F.lower(cell(c)).isin(*NULL_TOKENS)


def is_boolean_token(c: Column) -> Column:
    return F.lower(strip(c)).isin(*BOOLEAN_TOKENS)


def normalize_name(c: Column) -> Column:
    """`AdSpend (USD)` -> `ad_spend_usd`."""
    split_case = F.regexp_replace(strip(c), "([a-z0-9])([A-Z])", "$1_$2")
    joined = F.regexp_replace(split_case, "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(F.btrim(joined, F.lit("_")), "_+", "_"))


def has_future_name(normalized: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(normalized, F.lit(p)) for p in FUTURE_NAME_PARTS))


def row_fingerprint(*cells: Column) -> Column:
    """SHA-256 over trimmed cells joined with the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[cell(c) for c in cells]), 256)


def series_id(*groups: Column) -> Column:
    """Stable identifier of a series: the hash of a JSON array of its group values."""
    as_json = F.to_json(F.array(*[g.cast("string") for g in groups]), {"ignoreNullFields": "false"})
    return F.concat(F.lit("series_"), F.substring(F.sha2(as_json, 256), 1, 24))


def group_label(*groups: Column) -> Column:
    if not groups:
        return F.lit("all")
    return F.concat_ws(" | ", *[F.coalesce(g.cast("string"), F.lit("")) for g in groups])


def mask(c: Column, show_last: int = 4) -> Column:
    """Keep the last characters of a text, star out the others."""
    size = F.length(c)
    hidden = F.when(size <= show_last, size).otherwise(size - show_last)
    return F.when(c.isNull() | (size == 0), F.lit("")).otherwise(
        F.concat(F.repeat(F.lit("*"), hidden), F.substr(c, hidden + 1))
    )


def shorten(c: Column, limit: int) -> Column:
    """Cut a cell to `limit` characters, the last of them an ellipsis."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)
