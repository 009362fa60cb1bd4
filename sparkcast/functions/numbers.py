"""Lenient number parsing and safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcast.functions.text import strip

# The accepted shapes of a number.
DECIMAL_PATTERN = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
SPECIAL_PATTERN = r"^[+-]?(nan|inf|infinity)$"


def is_finite(x: Column) -> Column:
    """True for a finite number; NaN sorts above infinity, and null stays null."""
    return F.abs(x) < float("inf")


def _decimal(text: Column) -> Column:
    # Keeping only what has the shape of a decimal bars texts that one of the two engines alone would
    # take (`1d`, `0x1p3`), and names the text once: it is not computed again for a test.
    shaped = F.regexp_extract(text, DECIMAL_PATTERN, 0)
    return F.replace(shaped, F.lit("_"), F.lit("")).try_cast("double")


def parse_number_profile(c: Column) -> Column:
    """Number for profiling: thousands commas are dropped, nan and infinities count as numbers."""
    text = strip(F.replace(c, F.lit(","), F.lit("")))
    special = F.lower(text)
    return F.coalesce(
        _decimal(text),
        F.when(
            special.rlike(SPECIAL_PATTERN),
            F.when(F.contains(special, F.lit("nan")), float("nan"))
            .when(F.startswith(special, F.lit("-")), float("-inf"))
            .otherwise(float("inf")),
        ),
    )


def parse_number_quality(c: Column) -> Column:
    """Number for quality rules: commas and a trailing percent sign are dropped, finite only.

    Null tokens and amounts with a currency sign are not numbers: the decimal shape keeps them out.
    """
    text = F.replace(strip(c), F.lit(","), F.lit(""))
    number = _decimal(strip(F.rtrim(text, F.lit("%"))))
    return F.when(is_finite(number), number)


def parse_number_prep(c: Column) -> Column:
    """Number for preparation: plain decimal text, finite only."""
    number = _decimal(strip(c))
    return F.when(is_finite(number), number)


def is_whole(x: Column) -> Column:
    return is_finite(x) & (x == F.floor(x))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null when either is null or the denominator is zero."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))


def relative_gap(actual: Column, expected: Column, percent_scale: bool = False) -> Column:
    """Relative distance to an expected value; rates may also be stated per hundred."""
    def gap(e: Column) -> Column:
        return F.abs(actual - e) / F.greatest(F.abs(e), F.lit(1e-9))

    return F.least(gap(expected), gap(expected * 100)) if percent_scale else gap(expected)
