"""Quality views: the common metrics over groups of enriched measurements, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.formulas import count_if, month, quality_metrics, rate, skewness_adjusted


def grouped(enriched: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Metrics by keys; more: further aggregates."""
    return enriched.groupBy(*keys).agg(*more, *quality_metrics())


def distincts(*names: str) -> list[Column]:
    return [F.countDistinct(f"{n}_id").alias(f"{n}_count") for n in names]


def grouped_distinct(enriched: DataFrame, keys: list[str], names: tuple[str, ...] = ("batch", "cabin"), flags: dict[str, str] | None = None) -> DataFrame:
    """grouped() with distinct counts of ids, and counts of flags.  Rows are brought to one for each of the ids first, so
    that the distinct counts multiply those few and not the measurements."""
    x, ids, flags = F.col("measured_value").cast("double"), [f"{n}_id" for n in names], flags or {}
    inner = enriched.groupBy(*keys, *ids).agg(
        F.count(F.lit(1)).alias("_n"), F.count(x).alias("_k"), F.sum(x).alias("_sum"), F.sum(x * x).alias("_squares"), F.min(x).alias("_min"), F.max(x).alias("_max"), count_if("is_oos").alias("_oos"),
        F.sum(F.col("deviation_from_target").cast("double")).alias("_deviation"), F.count("deviation_from_target").alias("_deviations"), *[count_if(f).alias(f"_{n}") for n, f in flags.items()],
    )
    n, k, total = F.sum("_n"), F.sum("_k"), F.sum("_sum")
    spread = F.when(k > 1, F.sqrt(F.greatest(F.lit(0.0), (F.sum("_squares") - total * total / k) / (k - 1))))
    return inner.groupBy(*keys).agg(
        *distincts(*names), *[F.sum(f"_{c}").alias(c) for c in flags], n.alias("measurement_count"), rate(total, k).alias("mean_thickness"), spread.alias("stddev_thickness"), F.min("_min").alias("min_thickness"), F.max("_max").alias("max_thickness"),
        F.sum("_oos").alias("oos_count"), rate(F.sum("_oos"), n).alias("oos_rate"), rate(F.sum("_deviation"), F.sum("_deviations")).alias("mean_deviation_from_target"),
    )


def production_volume(enriched: DataFrame, keys: list[str]) -> DataFrame:
    return enriched.groupBy(*keys).agg(*distincts("batch", "cabin"), F.count(F.lit(1)).alias("measurement_count"))


def batch_quality(enriched: DataFrame, keys: list[str]) -> DataFrame:
    return grouped(enriched, keys, F.min("batch_start").alias("batch_start"), F.max("batch_end").alias("batch_end"), F.min("production_timestamp").alias("first_cabin_timestamp"), F.max("production_timestamp").alias("last_cabin_timestamp"), *distincts("cabin"))


def compliance_distribution(enriched: DataFrame) -> DataFrame:
    n = enriched.groupBy("compliance_status").agg(F.count(F.lit(1)).alias("measurement_count"))
    total = F.sum("measurement_count").over(W.partitionBy())  # over three rows at most
    return n.select("compliance_status", "measurement_count", rate(F.col("measurement_count"), total).alias("measurement_rate"))


def cabin_oos_rate(cabins: DataFrame) -> DataFrame:
    n, bad = F.count(F.lit(1)), count_if(F.col("oos_count") > 0)
    return cabins.agg(n.alias("cabin_count"), bad.alias("cabins_with_oos"), rate(bad, n).alias("cabin_oos_rate"))


def within_variation(enriched: DataFrame, cabins: DataFrame) -> DataFrame:
    """Spread of all measurements of a booth and point, beside the mean spread within their cabins."""
    x = F.col("measured_value").cast("double")
    inner = cabins.select("cabin_id", F.col("stddev_thickness").alias("_within"))
    return enriched.join(inner, "cabin_id").groupBy("booth_name", "point_code").agg(F.count(F.lit(1)).alias("measurement_count"), F.avg(x).alias("mean_thickness"), F.stddev_samp(x).alias("overall_sample_stddev"), F.avg("_within").alias("mean_within_cabin_stddev"))


def distribution(enriched: DataFrame, *keys: str) -> DataFrame:
    x = F.col("measured_value").cast("double")
    return enriched.groupBy(*keys).agg(F.count(F.lit(1)).alias("measurement_count"), F.avg(x).alias("mean_thickness"), F.stddev_samp(x).alias("sample_stddev_thickness"), F.min(x).alias("min_thickness"), F.max(x).alias("max_thickness"))


def shape(enriched: DataFrame, *keys: str) -> DataFrame:
    x = F.col("measured_value").cast("double")
    return enriched.groupBy(*keys).agg(F.median(x).alias("median_thickness"), skewness_adjusted("measured_value").alias("skewness"))


def histogram(enriched: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Counts by equal bins of [low, high); 0 and bins + 1 hold what is outside."""
    return enriched.groupBy(F.width_bucket(F.col("measured_value").cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("measurement_count"))


def mart(enriched: DataFrame) -> DataFrame:
    return grouped_distinct(enriched, ["production_date", "booth_id", "booth_name"], flags={"below_lsl_count": "below_lsl", "above_usl_count": "above_usl"})


def kpis(enriched: DataFrame) -> DataFrame:
    n, oos = F.count(F.lit(1)), count_if("is_oos")
    return enriched.agg(F.countDistinct("cabin_id").alias("cabin_count"), n.alias("measurement_count"), oos.alias("oos_count"), (rate(oos, n) * 100).alias("oos_rate_pct"))


def daily_trend(enriched: DataFrame) -> DataFrame:
    n, oos = F.count(F.lit(1)), count_if("is_oos")
    return enriched.groupBy("production_date").agg(F.avg(F.col("measured_value").cast("double")).alias("mean_thickness"), oos.alias("oos_count"), n.alias("measurement_count"), (rate(oos, n) * 100).alias("oos_rate_pct"))


def booth_comparison(enriched: DataFrame) -> DataFrame:
    x = F.col("measured_value").cast("double")
    n, oos = F.count(F.lit(1)), count_if("is_oos")
    return enriched.groupBy("booth_name").agg(n.alias("measurement_count"), F.round(F.avg(x), 3).alias("mean_thickness"), F.round(F.stddev_samp(x), 3).alias("stddev_thickness"), oos.alias("oos_count"), F.round(rate(oos, n) * 100, 3).alias("oos_rate_pct"))


def latest(enriched: DataFrame, n: int = 1000) -> DataFrame:
    """The newest rows; equal times by the larger id.  A top-k report, so a limit is its meaning."""
    return enriched.orderBy(F.desc("production_timestamp"), F.desc("measurement_id")).limit(n)


def filtered(enriched: DataFrame, booths=(), shifts=(), points=(), first=None, last=None) -> DataFrame:
    """The quality page's filters; an empty list lets all through."""
    for name, values in (("booth_name", booths), ("shift_name", shifts), ("point_code", points)):
        if values:
            enriched = enriched.where(F.col(name).isin(*values))
    if first is not None:
        enriched = enriched.where(F.col("production_date") >= F.lit(first).cast("date"))
    if last is not None:
        enriched = enriched.where(F.col("production_date") <= F.lit(last).cast("date"))
    return enriched


def robot_attribution(enriched: DataFrame, bridge: DataFrame, robots: DataFrame) -> DataFrame:
    """Measurements by linked robot; a measurement that is linked twice to a robot counts once, its value twice."""
    x = F.col("measured_value").cast("double")
    n, oos = F.countDistinct("measurement_id"), F.countDistinct(F.when(F.col("is_oos"), F.col("measurement_id")))
    return (
        bridge.join(robots, "robot_id")
        .join(enriched.select("measurement_id", "cabin_id", "measured_value", "is_oos", "deviation_from_target"), "measurement_id")
        .groupBy("robot_id", "robot_name", "track_axis_id", "track_name", F.col("robot_booth_id").alias("booth_id"), F.col("robot_booth_name").alias("booth_name"))
        .agg(
            n.alias("linked_measurement_count"),
            F.countDistinct("cabin_id").alias("linked_cabin_count"),
            F.avg(x).alias("linked_mean_thickness"),
            F.stddev_samp(x).alias("linked_stddev_thickness"),
            F.min(x).alias("linked_min_thickness"),
            F.max(x).alias("linked_max_thickness"),
            oos.alias("linked_oos_count"),
            rate(oos, n).alias("linked_oos_rate"),
            F.avg(F.col("deviation_from_target").cast("double")).alias("linked_mean_deviation_from_target"),
        )
    )


def bridge_cardinality(bridge: DataFrame) -> DataFrame:
    """How many measurements have how many robots."""
    return bridge.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("robot_count")).groupBy("robot_count").agg(F.count(F.lit(1)).alias("measurement_count"))


def linked_names(enriched: DataFrame, bridge: DataFrame, robots: DataFrame) -> DataFrame:
    """enriched with the sorted array of linked robots' names; the links are aggregated before the join."""
    names = bridge.join(robots.select("robot_id", "robot_name"), "robot_id").groupBy("measurement_id").agg(F.array_sort(F.collect_list("robot_name")).alias("robot_names"))
    return enriched.join(names, "measurement_id", "left")


def any_robot(enriched: DataFrame, names: list[str]) -> DataFrame:
    return enriched.where(F.arrays_overlap("robot_names", F.array(*map(F.lit, names)))) if names else enriched


# ---------------------------------------------------------------- process events


def event_context(events: DataFrame, booths: DataFrame, batches: DataFrame) -> DataFrame:
    """Every event record with the quality of its batch; for looking back, never an input of detection."""
    keep = ["batch_id", "cabin_count", "measurement_count", "mean_thickness", "stddev_thickness", "oos_count", "oos_rate"]
    return events.join(booths, "booth_id").join(batches.select(*keep), "batch_id").select("event_id", "event_timestamp", "event_type", "description", "severity", "batch_id", "booth_id", "booth_name", *keep[1:])


def event_type_summary(context: DataFrame) -> DataFrame:
    return context.groupBy("event_type", "severity", "booth_name").agg(
        F.countDistinct("batch_id").alias("affected_batch_count"), F.sum("measurement_count").alias("affected_measurement_count"), F.avg("mean_thickness").alias("mean_of_batch_means"), F.avg("stddev_thickness").alias("mean_batch_stddev"), F.sum("oos_count").alias("oos_measurement_count")
    )


def event_periods(context: DataFrame) -> DataFrame:
    return context.groupBy("event_type", "severity", "booth_id", "booth_name", "description").agg(F.min("event_timestamp").cast("date").alias("period_start"), F.max("event_timestamp").cast("date").alias("period_end"))


def around_periods(periods: DataFrame, batches: DataFrame, days: int = 7) -> DataFrame:
    """Batches of a booth before, during and after each period.  A period is spread over its days, so that booth and day
    are the join's keys and each pair that is made is a row of the result's groups."""
    day = F.col("_day")
    spread = periods.withColumn("_day", F.explode(F.sequence(F.date_sub("period_start", days), F.date_add("period_end", days))))
    near = spread.join(batches.drop("booth_name").withColumn("_day", F.col("batch_start").cast("date")), ["booth_id", "_day"])
    when = F.when(day < F.col("period_start"), "BEFORE").when(day > F.col("period_end"), "AFTER").otherwise("DURING")
    return (
        near.withColumn("relative_period", when)
        .groupBy("event_type", "severity", "booth_name", "period_start", "period_end", "relative_period")
        .agg(F.count(F.lit(1)).alias("batch_count"), F.sum("measurement_count").alias("measurement_count"), F.avg("mean_thickness").alias("mean_of_batch_means"), F.avg("stddev_thickness").alias("mean_batch_stddev"), F.sum("oos_count").alias("oos_measurement_count"))
    )


def monthly(enriched: DataFrame) -> DataFrame:
    return grouped(enriched.withColumn("production_month", month("production_timestamp")), ["production_month"])
