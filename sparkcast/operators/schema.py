"""What the columns mean: role candidates, decisions, checks, overrides and confirmation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcast.config import ProfileConfig
from sparkcast.functions.numbers import parse_number_prep

# The roles in their listed order, each with the names it goes by.
ROLE_SYNONYMS = {
    "date": ["date", "order_date", "transaction_date", "event_date", "campaign_date", "day", "week", "month"],
    "timestamp": ["timestamp", "datetime", "event_time", "created_at", "time"],
    "revenue": ["revenue", "sales", "sales_amount", "total_sales", "gross_sales", "net_sales", "turnover", "gm_value",
                "gmv", "order_value"],
    "spend": ["spend", "ad_spend", "advertising_cost", "marketing_cost", "media_spend", "campaign_spend",
              "budget_spent"],
    "channel": ["channel", "marketing_channel", "platform", "network", "traffic_channel"],
    "campaign": ["campaign", "campaign_name", "campaign_id", "ad_group", "promotion_name"],
    "impressions": ["impressions", "ad_impressions", "views", "served"],
    "clicks": ["clicks", "ad_clicks", "link_clicks"],
    "conversions": ["conversions", "purchases", "leads", "signups", "completed_actions"],
    "orders": ["orders", "order_count", "transactions"],
    "units_sold": ["units_sold", "quantity", "qty"],
    "price": ["price", "unit_price", "selling_price"],
    "discount": ["discount", "discount_rate"],
    "cost": ["cost", "unit_cost", "cogs"],
    "profit": ["profit", "margin", "gross_profit"],
    "roas": ["roas", "return_on_ad_spend"],
    "ctr": ["ctr", "click_through_rate"],
    "cpc": ["cpc", "cost_per_click"],
    "cpa": ["cpa", "cost_per_acquisition"],
    "conversion_rate": ["conversion_rate", "cvr"],
    "customer_id": ["customer_id", "customer_key"],
    "product_id": ["product_id", "sku", "item_id"],
    "product_name": ["product_name", "item_name"],
    "product_category": ["product_category", "category"],
    "geography": ["geography", "location", "geo"],
    "country": ["country"],
    "region": ["region", "state"],
    "city": ["city"],
    "device": ["device", "device_type"],
    "source": ["source", "utm_source"],
    "medium": ["medium", "utm_medium"],
    "sessions": ["sessions", "visits"],
    "users": ["users", "visitors"],
    "inventory": ["inventory", "stock"],
    "promotion": ["promotion", "promo", "is_promotion"],
    "holiday": ["holiday", "is_holiday"],
    "target": ["target", "label", "outcome"],
    "identifier": ["id", "identifier", "key"],
    "descriptive_text": ["description", "notes", "text"],
}
ROLES = (*ROLE_SYNONYMS, "ignored", "unknown")

# Role classes.
NUMERIC_ROLES = ("revenue", "spend", "impressions", "clicks", "conversions", "orders", "units_sold", "price", "discount",
                 "cost", "profit", "roas", "ctr", "cpc", "cpa", "conversion_rate", "sessions", "users", "inventory")
DATE_ROLES = ("date", "timestamp")
DIMENSION_ROLES = ("channel", "campaign", "customer_id", "product_id", "product_name", "product_category", "geography",
                   "country", "region", "city", "device", "source", "medium")
ANY_TYPE_ROLES = ("promotion", "holiday", "target", "identifier", "descriptive_text")
GENERIC_VALUE_ROLES = ("revenue", "price", "cost")
TARGET_ROLES = ("revenue", "conversions", "orders", "units_sold", "target")
MARKETING_DIMENSIONS = ("channel", "campaign", "product_category", "country", "region", "city", "device", "source",
                        "medium")
PERFORMANCE_METRICS = ("revenue", "spend", "impressions", "clicks", "conversions", "orders", "units_sold", "roas",
                       "ctr", "cpc", "cpa", "conversion_rate")
RATIO_RELATIONS = {
    "roas": ("revenue", "spend"),
    "ctr": ("clicks", "impressions"),
    "cpc": ("spend", "clicks"),
    "cpa": ("spend", "conversions"),
    "conversion_rate": ("conversions", "clicks"),
}

COLUMN = "column_name"


class SchemaError(ValueError):
    """A mapping cannot be used as it is."""


def role_class(role: str) -> str:
    for name, members in (
        ("numeric", NUMERIC_ROLES), ("date", DATE_ROLES), ("dimension", DIMENSION_ROLES), ("any", ANY_TYPE_ROLES)
    ):
        if role in members:
            return name
    return "none"


def role_dictionary(spark: SparkSession) -> DataFrame:
    """Every role with its class and synonyms."""
    rows = [(r, r.replace("_", " ").title(), role_class(r), ROLE_SYNONYMS.get(r, [])) for r in ROLES]
    return spark.createDataFrame(rows, "role string, description string, role_class string, synonyms array<string>")


def _dictionary() -> Column:
    """The roles with synonyms as a constant array, so matching needs no join."""
    return F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.lit(role_class(role)).alias("role_class"),
                F.array(*[F.lit(s) for s in sorted(names)]).alias("synonyms"),
                F.lit(role in GENERIC_VALUE_ROLES).alias("generic"),
            )
            for role, names in ROLE_SYNONYMS.items()
        ]
    )


def _evidence(kind: str, text: Column, score: Column, observed: Column, pattern: Column, severity: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("evidence_type"),
        text.alias("description"),
        score.alias("score_contribution"),
        observed.alias("observed_value"),
        pattern.alias("expected_pattern"),
        severity.alias("severity"),
    )


def role_candidates(profile: DataFrame) -> DataFrame:
    """Scored roles of each column. `profile` has column_index, column_name, normalized_name,
    physical_type, nonnegative_rate and parse_success_rate."""
    name, kind = F.col("normalized_name"), F.col("physical_type")
    tokens = F.split(name, "_")
    pairs = profile.select("*", F.explode(_dictionary()).alias("_r")).select(
        "*", F.col("_r.role").alias("role"), F.col("_r.role_class").alias("role_class")
    )
    exact = F.array_contains("_r.synonyms", name)
    partial = F.exists("_r.synonyms", lambda s: F.size(F.array_except(F.split(s, "_"), tokens)) == 0)
    generic = (name == "value") & F.col("_r.generic")
    cls = F.col("role_class")
    compatible = (
        ((cls == "numeric") & kind.isin("integer", "float"))
        | ((cls == "date") & kind.isin("date", "datetime"))
        | ((cls == "dimension") & kind.isin("categorical", "identifier", "text"))
        | (cls == "any")
    )
    scored = pairs.select(
        "*",
        F.when(exact, 0.65).when(partial, 0.45).when(generic, 0.35).alias("name_score"),
        F.when(exact, "exact synonym").when(partial, "token synonym").when(generic, "generic metric name").alias("match"),
        F.when(compatible, 0.25).otherwise(-0.25).alias("type_score"),
        F.when((cls == "numeric") & (F.col("nonnegative_rate") >= 0.8), 0.10).otherwise(0.0).alias("distribution_score"),
    ).filter(F.col("name_score").isNotNull())
    total = F.col("name_score") + F.col("type_score") + F.col("distribution_score")
    fits = F.col("type_score") > 0
    evidence = F.array_compact(
        F.array(
            _evidence("name_match", F.col("match"), F.col("name_score"), name, F.col("_r.synonyms")[0], F.lit("info")),
            _evidence(
                "physical_type",
                F.when(fits, "The values have the type this role needs").otherwise("The values have another type than this role needs"),
                F.col("type_score"), kind, F.lit("the type of the role"),
                F.when(fits, "info").otherwise("warning"),
            ),
            F.when(
                F.col("distribution_score") > 0,
                _evidence(
                    "distribution", F.lit("Hardly any number lies below zero"), F.col("distribution_score"),
                    F.round("nonnegative_rate", 3).cast("string"), F.lit(">= 0.8"), F.lit("info"),
                ),
            ),
        )
    )
    return scored.select(
        "column_index", COLUMN, "role", "role_class", "match", "name_score", "type_score", "distribution_score",
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("score"),
        evidence.alias("evidence"),
    )


def _by_score() -> Window:
    # At most 39 candidates per column.
    return Window.partitionBy(COLUMN).orderBy(F.col("score").desc(), "role")


def rank_candidates(candidates: DataFrame, keep: int = 3) -> DataFrame:
    """The best candidates of each column: score first, then name."""
    return candidates.withColumn("rank", F.row_number().over(_by_score())).filter(F.col("rank") <= keep)


def assign_roles(profile: DataFrame, candidates: DataFrame, cfg: ProfileConfig = ProfileConfig()) -> DataFrame:
    """One role per column: the best candidate if it is sure enough and clear of the next, else unknown."""
    lead = F.lead("score").over(_by_score())
    top = (
        candidates.withColumns({"_n": F.row_number().over(_by_score()), "second_score": lead})
        .filter(F.col("_n") == 1)
        .select(COLUMN, F.col("role").alias("top_role"), F.col("score").alias("top_score"), "second_score", "evidence")
    )
    alternatives = rank_candidates(candidates).groupBy(COLUMN).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "role", "score"))),
            lambda a: F.struct(a["role"].alias("role"), a["score"].alias("confidence_score")),
        ).alias("alternatives")
    )
    ambiguous = F.coalesce(F.col("top_score") - F.col("second_score") < cfg.ambiguity_margin, F.lit(False))
    sure = (F.col("top_score") >= cfg.min_confidence) & ~F.col("ambiguous")
    low_dates = F.coalesce(F.col("top_role").isin(*DATE_ROLES) & (F.col("parse_success_rate") < 0.8), F.lit(False))
    return (
        profile.join(top, COLUMN, "left")
        .join(alternatives, COLUMN, "left")
        .withColumn("ambiguous", ambiguous)
        .select(
            "column_index",
            COLUMN,
            "normalized_name",
            "physical_type",
            F.when(sure, F.col("top_role")).otherwise("unknown").alias("semantic_role"),
            F.coalesce("top_score", F.lit(0.0)).alias("confidence"),
            F.when(sure, "proposed").otherwise("unresolved").alias("status"),
            F.array_compact(
                F.array(
                    F.when(F.col("ambiguous"), F.lit("ambiguous_candidates")),
                    F.when(low_dates, F.lit("low_date_parse_rate")),
                )
            ).alias("warnings"),
            F.coalesce("alternatives", F.array().cast("array<struct<role:string,confidence_score:double>>")).alias(
                "alternatives"
            ),
        )
    )


def roles_dict(mapping: DataFrame) -> dict[str, str]:
    """Column -> role in column order. A mapping has one row per column, so this is small."""
    rows = mapping.select(COLUMN, "semantic_role", "column_index").collect()
    return {r[COLUMN]: r["semantic_role"] for r in sorted(rows, key=lambda r: r["column_index"])}


def first_by_role(mapping: DataFrame) -> DataFrame:
    """The first column of each role."""
    return (
        mapping.filter(~F.col("semantic_role").isin("unknown", "ignored"))
        .groupBy("semantic_role")
        .agg(F.min_by(COLUMN, "column_index").alias(COLUMN))
    )


def relationship_evidence(df: DataFrame, by_role: Mapping[str, str]) -> DataFrame:
    """How often each mapped ratio agrees with its parts: all relations in one pass over the rows."""
    relations = {
        ratio: parts for ratio, parts in RATIO_RELATIONS.items() if {ratio, *parts} <= set(by_role)
    }
    schema = (
        "metric string, numerator string, denominator string, observed bigint, matches bigint, "
        "agreement double, contribution double"
    )
    if not relations:
        return df.sparkSession.createDataFrame([], schema)
    sums: list[Column] = []
    for ratio, (num, den) in relations.items():
        actual, top, bottom = (parse_number_prep(F.col(by_role[r]).cast("string")) for r in (ratio, num, den))
        expected = F.try_divide(top, F.nullif(bottom, F.lit(0.0)))
        gap = F.abs(actual - expected)
        sums += [
            F.count(gap).alias(f"{ratio}_observed"),
            F.count_if(gap <= F.greatest(F.abs(expected) * 0.25, F.lit(0.02))).alias(f"{ratio}_matches"),
        ]
    lines = F.array(
        *[
            F.struct(
                F.lit(ratio).alias("metric"),
                F.lit(num).alias("numerator"),
                F.lit(den).alias("denominator"),
                F.col(f"{ratio}_observed").alias("observed"),
                F.col(f"{ratio}_matches").alias("matches"),
            )
            for ratio, (num, den) in relations.items()
        ]
    )
    agreement = F.try_divide(F.col("matches"), F.col("observed"))
    return (
        df.agg(*sums)
        .select(F.explode(lines).alias("r"))
        .select("r.*")
        .filter(F.col("observed") > 0)
        .withColumn("agreement", agreement)
        .withColumn("contribution", F.when(F.col("agreement") >= 0.7, 0.05).otherwise(-0.05))
    )


def apply_relationships(mapping: DataFrame, relations: DataFrame) -> DataFrame:
    """Raise or lower the confidence of mapped ratios by the relationship evidence."""
    shift = relations.select(F.col("metric").alias("semantic_role"), "contribution")
    moved = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.col("contribution"))), 4)
    return (
        mapping.join(F.broadcast(shift), "semantic_role", "left")  # at most five rows
        .withColumn("confidence", F.when(F.col("contribution").isNotNull(), moved).otherwise(F.col("confidence")))
        .drop("contribution")
    )


def schema_issues(mapping: DataFrame) -> DataFrame:
    """Blocking issues and warnings of a mapping."""
    role = F.col("semantic_role")
    strong = F.filter(
        F.transform(
            F.sort_array(
                F.collect_list(F.when((role == "revenue") & (F.col("confidence") >= 0.75),
                                      F.struct("column_index", COLUMN)))
            ),
            lambda s: s[COLUMN],
        ),
        lambda n: n.isNotNull(),
    )
    counted = mapping.agg(
        F.count_if(role.isin(*DATE_ROLES)).alias("dates"),
        F.count_if(role.isin(*TARGET_ROLES)).alias("targets"),
        strong.alias("revenues"),
        F.count_if(role == "spend").alias("spends"),
        F.count_if(role == "revenue").alias("any_revenue"),
    )
    none = F.array().cast("array<string>")

    def issue(when: Column, code: str, severity: str, message: str, columns: Column = none) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(code).alias("code"),
                F.lit(severity).alias("severity"),
                F.lit(message).alias("message"),
                columns.alias("column_names"),
            ),
        )

    found = F.array_compact(
        F.array(
            issue(F.col("dates") == 0, "missing_date", "blocking",
                  "No column looks like a date or a time."),
            issue(F.col("targets") == 0, "missing_target", "blocking", "No column looks like something to forecast."),
            issue(F.size("revenues") > 1, "duplicate_revenue", "warning",
                  "More than one column may be the revenue; choose one.", F.col("revenues")),
            issue((F.col("spends") > 0) & (F.col("any_revenue") == 0), "spend_without_revenue", "warning",
                  "There is spend but no revenue to set against it."),
        )
    )
    return counted.select(F.explode(found).alias("i")).select("i.*")


def schema_summary(mapping: DataFrame) -> DataFrame:
    """One row of counts, candidates and readiness."""
    role, index = F.col("semantic_role"), F.col("column_index")

    def first(roles: Sequence[str]) -> Column:
        return F.min_by(F.col(COLUMN), F.when(role.isin(*roles), index))

    def listed(roles: Sequence[str]) -> Column:
        hits = F.collect_list(F.when(role.isin(*roles), F.struct("column_index", COLUMN)))
        return F.transform(F.sort_array(hits), lambda s: s[COLUMN])

    counted = mapping.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(~role.isin("unknown", "ignored")).alias("mapped_columns"),
        F.count_if(F.col("status").isin("confirmed", "manually_overridden")).alias("confirmed_columns"),
        F.count_if(role == "unknown").alias("unresolved_columns"),
        F.count_if(F.size("warnings") > 0).alias("ambiguous_columns"),
        F.round(F.avg("confidence"), 4).alias("average_confidence"),
        first(DATE_ROLES).alias("primary_date_candidate"),
        first(TARGET_ROLES).alias("primary_target_candidate"),
        first(["revenue"]).alias("revenue_candidate"),
        first(["spend"]).alias("spend_candidate"),
        listed(MARKETING_DIMENSIONS).alias("marketing_dimensions"),
        listed(PERFORMANCE_METRICS).alias("performance_metrics"),
    )
    review = (
        F.col("primary_date_candidate").isNull()
        | F.col("primary_target_candidate").isNull()
        | (F.col("unresolved_columns") > 0)
        | (F.col("ambiguous_columns") > 0)
    )
    return counted.withColumn("readiness_status", F.when(review, "needs_review").otherwise("mapping_ready"))


def override_roles(mapping: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply manual roles (column_name, new_role); overridden columns get full confidence."""
    chosen = F.col("new_role").isNotNull()
    return (
        mapping.join(F.broadcast(overrides), COLUMN, "left")  # at most one row per column
        .withColumns(
            {
                "old_role": F.col("semantic_role"),
                "semantic_role": F.coalesce("new_role", "semantic_role"),
                "confidence": F.when(chosen, 1.0).otherwise(F.col("confidence")),
                "status": F.when(chosen, "manually_overridden").otherwise(F.col("status")),
            }
        )
        .drop("new_role")
    )


def override_audit(overridden: DataFrame) -> DataFrame:
    """What an override changed."""
    return overridden.filter(F.col("status") == "manually_overridden").select(
        COLUMN, "old_role", F.col("semantic_role").alias("new_role"), F.lit("manual_override").alias("action_type")
    )


def check_overrides(overrides: Mapping[str, str]) -> None:
    unknown = sorted(set(overrides.values()) - set(ROLES))
    if unknown:
        raise SchemaError(f"Invalid semantic role: {', '.join(unknown)}")


def confirmable(mapping: DataFrame) -> DataFrame:
    """Why a mapping cannot be confirmed; empty when it can."""
    blocking = schema_issues(mapping).filter(F.col("severity") == "blocking").select("message")
    unknown = mapping.filter(F.col("semantic_role") == "unknown").select(
        F.format_string("Column %s must be mapped or ignored", F.col(COLUMN)).alias("message")
    )
    return blocking.unionByName(unknown)


def confirm_schema(mapping: DataFrame, check: bool = True) -> DataFrame:
    """Mark proposed columns confirmed; refuse while an issue blocks or a column is unknown."""
    if check:
        problems = [r["message"] for r in confirmable(mapping).collect()]
        if problems:
            raise SchemaError("; ".join(problems))
    return mapping.withColumn(
        "status", F.when(F.col("status") == "proposed", "confirmed").otherwise(F.col("status"))
    )


def target_type(physical_type: str, role: str) -> str:
    """Spark type a confirmed column is read as."""
    if role in DATE_ROLES or physical_type in ("date", "datetime"):
        return "timestamp" if physical_type == "datetime" or role == "timestamp" else "date"
    if role in NUMERIC_ROLES or physical_type in ("integer", "float"):
        return "double"
    return "string"
