"""Analytics over registry tables: datasets, schema profiles, reports, preparations, experiments, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_versions(versions: DataFrame, key: str = "dataset_id", version: str = "version") -> DataFrame:
    return versions.groupBy(key).agg((F.max(version) + 1).alias("next_version"))


def supersede(versions: DataFrame, key: str = "dataset_id", version: str = "version") -> DataFrame:
    """Completed versions older than the newest completed one become superseded."""
    newest = versions.filter(F.col("status") == "completed").groupBy(key).agg(F.max(version).alias("_newest"))
    old = (F.col("status") == "completed") & (F.col(version) < F.col("_newest"))
    return (
        versions.join(newest, key, "left")
        .withColumn("status", F.when(old, "superseded").otherwise(F.col("status")))
        .drop("_newest")
    )


def latest_version(
    versions: DataFrame, key: str = "dataset_id", version: str = "version", without: Sequence[str] = ("superseded", "failed")
) -> DataFrame:
    """The newest usable version of each dataset, as one combinable aggregate."""
    usable = versions.filter(~F.col("status").isin(*without))
    return usable.groupBy(key).agg(F.max_by(F.struct(*usable.columns), version).alias("_r")).select("_r.*")


def version_history(versions: DataFrame, key: str = "dataset_id", version: str = "version") -> DataFrame:
    """All versions, newest first inside each dataset."""
    order = Window.partitionBy(key).orderBy(F.col(version).desc())
    return versions.withColumn("position", F.row_number().over(order))


def dataset_library(
    datasets: DataFrame,
    schemas: DataFrame,
    reports: DataFrame,
    preparations: DataFrame,
    *,
    status: str | None = None,
    search: str | None = None,
    sort: str = "newest",
    number: int = 1,
    size: int = 20,
) -> DataFrame:
    """One page of datasets with the state of their schema, quality and preparation.

    The page is cut first, so the status tables are matched against one page of keys only.
    """
    hits = datasets
    if status:
        hits = hits.filter(F.col("status") == status)
    if search:
        pattern = search.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        hits = hits.filter(F.col("filename").ilike(f"%{pattern}%"))
    created = F.col("created_at")
    order = [created.asc() if sort == "oldest" else created.desc(), F.col("dataset_id")]
    shown = hits.orderBy(*order).offset((number - 1) * size).limit(size)
    schema = latest_version(schemas, without=("superseded",)).select("dataset_id", F.col("status").alias("schema_status"))
    quality = reports.filter(F.col("status") == "completed").select(
        "dataset_id", F.col("readiness").alias("quality_status"), "overall_score", "blocker_count"
    )
    prepared = latest_version(preparations, without=("superseded",)).select(
        "dataset_id", F.col("status").alias("preparation_status"), F.col("version").alias("preparation_version")
    )
    total = hits.agg(F.count(F.lit(1))).scalar()
    joined = shown.join(schema, "dataset_id", "left").join(quality, "dataset_id", "left").join(prepared, "dataset_id", "left")
    return joined.select(
        "dataset_id",
        "filename",
        "created_at",
        F.coalesce("schema_status", F.lit("not_analyzed")).alias("schema_status"),
        F.coalesce("quality_status", F.lit("not_analyzed")).alias("quality_status"),
        F.col("overall_score").alias("quality_score"),
        F.coalesce("blocker_count", F.lit(0)).alias("quality_blockers"),
        F.coalesce("preparation_status", F.lit("not_prepared")).alias("preparation_status"),
        "preparation_version",
    ).withColumn("total_items", total)


def dataset_stats(datasets: DataFrame) -> DataFrame:
    ready = F.col("status") == "ready"
    newest = F.when(ready, F.struct("created_at", "dataset_id"))
    return datasets.agg(
        F.count_if(ready).alias("active_datasets"),
        F.max_by("filename", newest).alias("latest_filename"),
        F.max(F.when(ready, F.col("created_at"))).alias("latest_upload_at"),
    )


def schema_stats(schemas: DataFrame) -> DataFrame:
    review = F.col("status") == "needs_review"
    return schemas.agg(
        F.count_if(review).alias("awaiting_review"),
        F.count_if(F.col("status") == "confirmed").alias("confirmed_schemas"),
        F.coalesce(F.sum(F.when(review, F.col("unresolved_columns"))), F.lit(0)).alias("unresolved_columns"),
    )


def quality_stats(datasets: DataFrame, reports: DataFrame) -> DataFrame:
    """Counts over completed reports of active datasets; datasets without one are not analysed."""
    active = datasets.filter(F.col("status") == "ready").select("dataset_id")
    done = reports.filter(F.col("status") == "completed").join(active, "dataset_id", "left_semi")
    without = active.join(done.select("dataset_id"), "dataset_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    state = lambda name: F.count_if(F.col("readiness") == name)
    return done.agg(
        state("blocked").alias("blocked_datasets"),
        state("needs_attention").alias("needs_attention"),
        state("conditionally_ready").alias("conditionally_ready"),
        state("quality_ready").alias("quality_ready"),
        F.coalesce(F.sum("blocker_count"), F.lit(0)).alias("total_blockers"),
        F.round(F.avg("overall_score"), 2).alias("average_quality_score"),
    ).withColumn("datasets_not_analyzed", without)


def preparation_stats(datasets: DataFrame, preparations: DataFrame) -> DataFrame:
    done = F.col("status").isin("completed", "superseded")
    prepared = preparations.filter(done).select("dataset_id")
    active = datasets.filter(F.col("status") == "ready").select("dataset_id")
    waiting = active.join(prepared, "dataset_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    return preparations.agg(
        F.count_if(done).alias("total_prepared_datasets"),
        F.count_if(done & (F.col("readiness") == "model_ready")).alias("model_ready_datasets"),
        F.count_if(F.col("status") == "failed").alias("failed_preparations"),
        F.avg(F.when(done, F.col("feature_count"))).alias("average_feature_count"),
        F.avg(F.when(done, F.col("duration_ms"))).alias("average_duration_ms"),
    ).withColumn("datasets_awaiting_preparation", waiting)


def forecast_stats(experiments: DataFrame, preparations: DataFrame) -> DataFrame:
    """Experiment counts, mean test WAPE, latest status and prepared datasets still to forecast."""
    done = F.col("status") == "completed"
    ready = preparations.filter((F.col("status") == "completed") & (F.col("readiness") == "model_ready"))
    used = experiments.filter(done).select("preparation_id")
    waiting = ready.join(used, "preparation_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    return experiments.agg(
        F.count(F.lit(1)).alias("total_experiments"),
        F.count_if(done).alias("completed_experiments"),
        F.count_if(F.col("status") == "failed").alias("failed_experiments"),
        F.avg("test_wape").alias("average_test_wape"),
        F.max_by("status", F.struct("created_at", "experiment_id")).alias("latest_experiment_status"),
    ).withColumn("datasets_awaiting_forecasting", waiting)


def winner_distribution(runs: DataFrame) -> DataFrame:
    """How often each model was selected."""
    return runs.filter("selected").groupBy("model").agg(F.count(F.lit(1)).alias("wins"))


def boosted_stats(runs: DataFrame) -> DataFrame:
    """Wins of boosted models and their mean gain over the best baseline of the same experiment.

    Baselines and winners of an experiment meet in one aggregate instead of a self-join.
    """
    boosted = F.col("family") == "gradient_boosting"
    baseline = ~boosted & (F.col("status") == "completed")
    winner = boosted & F.col("selected")
    by_experiment = runs.groupBy("experiment_id").agg(
        F.min(F.when(baseline, F.col("wape"))).alias("best"),
        F.min(F.when(winner, F.col("wape"))).alias("won"),
        F.count_if(winner).alias("wins"),
        F.count_if(boosted & (F.col("status") == "completed")).alias("completed"),
        F.count_if(boosted & (F.col("status") == "failed")).alias("failed"),
        F.sum(F.when(boosted & (F.col("tuning_ms") > 0), F.col("tuning_ms"))).alias("tuning"),
        F.count_if(boosted & (F.col("tuning_ms") > 0)).alias("tuned"),
    )
    gain = F.try_divide(F.col("best") - F.col("won"), F.col("best"))
    return by_experiment.agg(
        F.count_if(F.col("completed") > 0).alias("completed_experiments"),
        F.sum("wins").alias("boosted_wins"),
        F.try_divide(F.sum("tuning"), F.sum("tuned")).alias("average_tuning_ms"),
        F.avg(gain).alias("average_improvement"),
        F.sum("failed").alias("failed_models"),
    )

