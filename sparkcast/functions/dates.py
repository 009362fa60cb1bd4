"""Lenient date parsing, period buckets and calendar features. Session time zone: UTC."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcast.functions.text import strip

FREQUENCIES = ("hourly", "daily", "weekly", "monthly", "quarterly")

# Accepted layouts in order of preference, as (shape, Spark pattern).
DATE_LAYOUTS_PROFILE = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-y"),
)
DATETIME_LAYOUTS_PROFILE = (
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d H:m:s"),
)
ZONED_LAYOUT = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(Z|[+-]\d{2}:?\d{2})$"
DATE_LAYOUTS_QUALITY = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d'T'H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
)
DATE_LAYOUTS_PREP = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
)
ISO_LAYOUT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
ZONE_SUFFIX = r"(Z|[+-]\d{2}:?\d{2})$"

# Upper bound of the median interval in seconds for each frequency label.
FREQUENCY_BOUNDS = (
    ("hourly", 5400),
    ("daily", 129600),
    ("weekly", 864000),
    ("monthly", 3888000),
    ("quarterly", 10368000),
)


def _try_layouts(text: Column, layouts: Iterable[tuple[str, str]]) -> Column:
    return F.coalesce(
        *[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern))) for shape, pattern in layouts]
    )


def _iso(text: Column) -> Column:
    basic = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    return F.coalesce(F.when(text.rlike(ISO_LAYOUT), text.try_cast("timestamp")), basic)


def parse_date_profile(c: Column) -> Column:
    """Timestamp for profiling, or null. Zone suffixes are dropped, wall time is kept."""
    text = strip(c)
    zoned = F.when(text.rlike(ZONED_LAYOUT), F.regexp_replace(text, ZONE_SUFFIX, ""))
    return F.coalesce(
        _try_layouts(text, DATETIME_LAYOUTS_PROFILE),
        _try_layouts(zoned, DATETIME_LAYOUTS_PROFILE[:1]),
        _try_layouts(text, DATE_LAYOUTS_PROFILE),
    )


def has_time_layout(c: Column) -> Column:
    """Whether a text carries a clock time, as the profile reader sees it."""
    text = strip(c)
    zoned = F.when(text.rlike(ZONED_LAYOUT), F.regexp_replace(text, ZONE_SUFFIX, ""))
    return F.coalesce(
        _try_layouts(text, DATETIME_LAYOUTS_PROFILE), _try_layouts(zoned, DATETIME_LAYOUTS_PROFILE[:1])
    ).isNotNull()


def parse_date_quality(c: Column) -> Column:
    """Timestamp for quality rules: six layouts, then ISO; the zone is dropped, not converted."""
    text = strip(c)
    return F.coalesce(_try_layouts(text, DATE_LAYOUTS_QUALITY), _iso(F.regexp_replace(text, ZONE_SUFFIX, "")))


def parse_date_prep(c: Column) -> Column:
    """Timestamp for preparation: ISO first, then day-first, then month-first; zones become UTC."""
    text = strip(c)
    return F.coalesce(_iso(text), _try_layouts(text, DATE_LAYOUTS_PREP))


def check_frequency(frequency: str) -> str:
    if frequency not in FREQUENCIES:
        raise ValueError(f"Unknown frequency {frequency!r}; choose one of {', '.join(FREQUENCIES)}")
    return frequency


def period_bucket(c: Column, frequency: str) -> Column:
    """Start of the period a moment falls in: a timestamp when hourly, else a date."""
    unit = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter"}
    start = F.date_trunc(unit[check_frequency(frequency)], c)
    return start if frequency == "hourly" else start.cast("date")


def period_step(frequency: str) -> Column:
    """Length of one period as an interval."""
    parts = {
        "hourly": {"hours": F.lit(1)},
        "daily": {"days": F.lit(1)},
        "weekly": {"weeks": F.lit(1)},
        "monthly": {"months": F.lit(1)},
        "quarterly": {"months": F.lit(3)},
    }[check_frequency(frequency)]
    return F.make_dt_interval(hours=parts["hours"]) if frequency == "hourly" else F.make_interval(**parts)


def next_period(c: Column, frequency: str) -> Column:
    if check_frequency(frequency) == "hourly":
        return c + F.make_dt_interval(hours=F.lit(1))
    months = {"monthly": 1, "quarterly": 3}.get(frequency)
    if months:
        return F.add_months(c.cast("date"), months)
    return F.date_add(c.cast("date"), 1 if frequency == "daily" else 7)


def calendar_features(c: Column) -> dict[str, Column]:
    """Calendar columns by name; weekday counts from Monday = 0, weeks are ISO weeks."""
    angle = 2 * F.pi() * F.month(c) / 12
    return {
        "calendar_year": F.year(c),
        "calendar_quarter": F.quarter(c),
        "calendar_month": F.month(c),
        "calendar_week": F.weekofyear(c),
        "calendar_day_of_week": F.weekday(c),
        "calendar_is_weekend": (F.weekday(c) >= 5).cast("int"),
        "calendar_month_sin": F.sin(angle),
        "calendar_month_cos": F.cos(angle),
    }


def holiday_flag(c: Column, holidays: Iterable[str]) -> Column:
    days = list(holidays)
    if not days:
        return F.lit(0)
    return c.cast("date").isin(*[F.to_date(F.lit(d)) for d in days]).cast("int")


def frequency_label(median_seconds: Column) -> Column:
    label = F.when(median_seconds.isNull(), "insufficient")
    for name, bound in FREQUENCY_BOUNDS:
        label = label.when(median_seconds <= bound, name)
    return label.otherwise("irregular")
