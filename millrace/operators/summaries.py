"""Signal summaries of rule results; rates of signals are over evaluated rows, rates of violations over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.formulas import MR_UCL_FACTOR, count_if, month, rate, signal_metrics

_PLACE = ["booth_name", "point_code"]
_SHIFT = ["shift_instance", "shift_id", "shift_name"]


def overall(results: DataFrame) -> DataFrame:
    return results.groupBy(*_PLACE).agg(*signal_metrics(rules=True, rates=True, oos=False)).withColumn("summary_scope", F.lit("OVERALL"))


def by_month(results: DataFrame) -> DataFrame:
    return results.groupBy(month("production_timestamp").alias("production_month"), *_PLACE).agg(*signal_metrics())


def by_instance(results: DataFrame) -> DataFrame:
    at = F.when(F.col("spc_signal"), F.col("measurement_timestamp"))
    return results.groupBy(*_SHIFT, *_PLACE).agg(*signal_metrics(), F.min(at).alias("first_signal_timestamp"), F.max(at).alias("last_signal_timestamp"))


def rules_long(results: DataFrame) -> DataFrame:
    """Counts of each rule over all, by month and by shift instance.

    Rows are aggregated before the four rules become rows of their own, so no measurement is copied."""
    base = results.withColumn("production_month", month("production_timestamp"))
    sums = [F.count(F.lit(1)).alias("total_measurements"), F.count("spc_signal").alias("evaluated_measurements"), *[count_if(f"rule_{k}").alias(f"r{k}") for k in range(1, 5)]]
    sets = [[], [F.col("production_month")], [F.col(c) for c in _SHIFT]]
    grouped = base.groupingSets(sets, F.col("production_month"), *[F.col(c) for c in _SHIFT]).agg(F.grouping("production_month").alias("_m"), F.grouping("shift_instance").alias("_i"), *sums)
    scope = F.when(F.col("_m") == 0, "PRODUCTION_MONTH").when(F.col("_i") == 0, "SHIFT_INSTANCE").otherwise("OVERALL")
    stacked = grouped.select(scope.alias("summary_scope"), "production_month", *_SHIFT, "total_measurements", "evaluated_measurements", F.expr("stack(4, 'RULE_1', r1, 'RULE_2', r2, 'RULE_3', r3, 'RULE_4', r4) as (rule_name, rule_signal_measurements)"))
    return stacked.withColumn("rule_signal_rate", rate(F.col("rule_signal_measurements"), F.col("evaluated_measurements")))


def in_report_order(long: DataFrame) -> DataFrame:
    order = F.when(F.col("summary_scope") == "OVERALL", 1).when(F.col("summary_scope") == "PRODUCTION_MONTH", 2).otherwise(3)
    return long.orderBy(order, F.asc_nulls_first("production_month"), F.asc_nulls_first("shift_instance"), "rule_name")


def contingency(results: DataFrame) -> DataFrame:
    """Signals against violations of the specification."""
    s, o = F.coalesce("spc_signal", F.lit(False)), F.coalesce("is_oos", F.lit(False))
    return results.agg(count_if(s & o).alias("signal_and_oos"), count_if(s & ~o).alias("signal_only"), count_if(~s & o).alias("oos_only"), count_if(~s & ~o).alias("neither"))


def coverage(results: DataFrame) -> DataFrame:
    known = F.count("spc_signal")
    return results.agg(F.count(F.lit(1)).alias("measurements"), known.alias("evaluated"), count_if("spc_signal").alias("signals"), rate(count_if("spc_signal"), known).alias("signal_rate"))


def spc_overview(results: DataFrame) -> DataFrame:
    n, covered = F.count(F.lit(1)), F.count("baseline_id")
    return results.agg(n.alias("measurement_count"), covered.alias("covered_count"), (n - covered).alias("not_assessed_count"), (rate(covered, n) * 100).alias("coverage_pct"), count_if("spc_signal").alias("signal_count"), (rate(count_if("spc_signal"), covered) * 100).alias("signal_rate_pct"))


def rule_counts(results: DataFrame) -> DataFrame:
    covered = results.where("baseline_id is not null")
    return covered.agg(*[count_if(f"rule_{k}").alias(f"rule_{k}_count") for k in range(1, 5)], count_if(~F.col("spc_signal")).alias("assessed_without_signal"))


def mr_own_limits(results: DataFrame, *keys: str) -> DataFrame:
    """Moving ranges against limits from their own mean; all NULL where there are none."""
    mr = F.col("moving_range").cast("double")
    valid = results.where(mr.isNotNull() & ~F.isnan(mr) & (F.abs(mr) != float("inf"))).withColumn("_mr", mr)
    limits = valid.groupBy(*keys).agg(F.avg("_mr").alias("mr_center_line"))
    limits = limits.withColumn("mr_ucl_own", MR_UCL_FACTOR * F.col("mr_center_line"))
    joined = valid.join(limits, list(keys)) if keys else valid.crossJoin(F.broadcast(limits))
    n, bad = F.count(F.lit(1)), count_if(F.col("_mr") > F.col("mr_ucl_own"))
    out = joined.groupBy(*keys).agg(F.first("mr_center_line").alias("center_line"), F.first("mr_ucl_own").alias("upper_control_limit"), n.alias("valid_count"), bad.alias("violation_count"), (rate(bad, n) * 100).alias("violation_rate_pct"), F.max("_mr").alias("maximum"))
    return out.withColumn("lower_control_limit", F.when(F.col("valid_count") > 0, F.lit(0.0)))


def mr_stored_limits(results: DataFrame) -> DataFrame:
    """Moving ranges against the baseline's limit; the denominator is the covered moving ranges."""
    covered = results.where("baseline_id is not null")
    n, bad = F.count("moving_range"), count_if(F.col("moving_range") > F.col("mr_ucl"))
    return covered.agg(n.alias("valid_mr_count"), bad.alias("mr_violation_count"), (rate(bad, n) * 100).alias("mr_violation_rate_pct"), F.max("moving_range").cast("double").alias("max_moving_range"))
