"""Registration of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query. Times are read in UTC, whatever session the caller brings."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# Values that fall exactly between two roundings are nudged the same way on both sides, so that noise
# in the last bit of a floating-point sum cannot tip them apart. It also settles the sign of zero.
NUDGE = 0.0314159


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(NUDGE * 10**-digits), digits)


def rnd_sql(expression: str, digits: int = 6) -> str:
    return f"round(({expression}) + {NUDGE}e-{digits}, {digits})"


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Round the named columns, or every floating-point column."""
    wanted = set(names) or {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[rnd(n, digits).alias(n) if n in wanted else F.col(n) for n in df.columns])
