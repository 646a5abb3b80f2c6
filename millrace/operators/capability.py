"""Process capability of ordered streams: one row of indices and statuses for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.formulas import D2, count_if, normal_quantile, rate


def _sigma_status(sigma: Column, n: Column, within: bool, near_zero: float) -> Column:
    out = F.when(sigma.isNull() if within else n < 2, "NO_VALID_MR_PAIR" if within else "INSUFFICIENT_OBSERVATIONS")
    return out.when(sigma.isNull(), "UNAVAILABLE").when(sigma == 0, "ZERO_SIGMA").when(sigma <= near_zero, "NEAR_ZERO_SIGMA").otherwise("AVAILABLE")


def capability(measurements: DataFrame, *keys: str, near_zero: float = 0.001) -> DataFrame:
    """Moving ranges pool by shift instance only, across changes of baseline.  Without keys an empty input gives one
    row with no measurements."""
    x = F.col("measured_value").cast("double")
    order = W.partitionBy(*keys, "shift_instance").orderBy("measurement_timestamp", "measurement_id")
    rows = measurements.withColumn("_mr", F.abs(x - F.lag(x).over(order)))
    spec = {c: F.col(c).cast("double") for c in ("lsl", "target", "usl")}
    missing = count_if(spec["lsl"].isNull() | spec["target"].isNull() | spec["usl"].isNull())
    same = [F.min(c) == F.max(c) for c in spec.values()]
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("measurement_count"),
        F.count("_mr").alias("valid_mr_pairs"),
        F.avg("_mr").alias("mrbar"),
        F.avg(x).alias("mean"),
        F.median(x).alias("median"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.stddev_samp(x).alias("overall_sigma"),
        F.count("spc_signal").alias("spc_evaluated_count"),
        count_if("spc_signal").alias("spc_signal_count"),
        missing.alias("_missing"),
        (same[0] & same[1] & same[2]).alias("_same"),
        *[F.min(c).alias(f"_{n}") for n, c in spec.items()],
        count_if(x < spec["lsl"]).alias("_below"),
        count_if(x > spec["usl"]).alias("_above"),
    )
    n, empty = F.col("measurement_count"), F.col("measurement_count") == 0
    valid = F.coalesce(~empty & (F.col("_missing") == 0) & F.col("_same") & (F.col("_lsl") < F.col("_target")) & (F.col("_target") < F.col("_usl")), F.lit(False))
    out = out.withColumns(
        {
            "_valid": valid,
            "specification_status": F.when(empty | (F.col("_missing") > 0), "MISSING_SPECIFICATION_LIMITS").when(valid, "AVAILABLE").otherwise("INVALID_OR_INCONSISTENT_SPECIFICATION_LIMITS"),
            "within_sigma": F.col("mrbar") / D2,
            "spc_not_evaluated_count": n - F.col("spc_evaluated_count"),
            "spc_signal_rate": rate(F.col("spc_signal_count"), F.col("spc_evaluated_count")),
            "stability_signal_status": F.when(F.col("spc_signal_count") > 0, "SPC_SIGNALS_PRESENT")
            .when(F.col("spc_evaluated_count") == 0, "SPC_SIGNALS_NOT_ASSESSED")
            .when(F.col("spc_evaluated_count") < n, "SPC_SIGNALS_PARTIALLY_ASSESSED")
            .otherwise("NO_SPC_SIGNALS_DETECTED"),
            **{k: F.when(valid, F.col(f"_{k}")) for k in spec},
        }
    )
    valid, mean, lsl, usl = F.col("_valid"), F.col("mean"), F.col("lsl"), F.col("usl")
    out = out.withColumns(
        {
            "within_sigma_status": _sigma_status(F.col("within_sigma"), n, True, near_zero),
            "overall_sigma_status": _sigma_status(F.col("overall_sigma"), n, False, near_zero),
            "below_lsl_count": F.when(valid, F.col("_below")),
            "above_usl_count": F.when(valid, F.col("_above")),
            "oos_count": F.when(valid, F.col("_below") + F.col("_above")),
            "oos_rate": F.when(valid, rate(F.col("_below") + F.col("_above"), n)),
            "distance_mean_to_lsl": mean - lsl,
            "distance_mean_to_usl": usl - mean,
        }
    )
    within, whole = valid & (F.col("within_sigma_status") == "AVAILABLE"), valid & (F.col("overall_sigma_status") == "AVAILABLE")
    ratio = lambda ok, s: F.when(ok, (usl - lsl) / (6 * F.col(s)))
    least = lambda ok, s: F.when(ok, F.least((usl - mean) / (3 * F.col(s)), (mean - lsl) / (3 * F.col(s))))
    out = out.withColumns({"cp": ratio(within, "within_sigma"), "cpk": least(within, "within_sigma"), "pp": ratio(whole, "overall_sigma"), "ppk": least(whole, "overall_sigma")})
    given = sum(F.col(c).isNotNull().cast("int") for c in ("cp", "cpk", "pp", "ppk"))
    out = out.withColumns(
        {
            "availability_status": F.when(given == 4, "AVAILABLE").when(given > 0, "PARTIALLY_AVAILABLE").otherwise("UNAVAILABLE"),
            "interpretation_status": F.when(n == 0, "EXPLORATORY_PHASE_I_NO_MEASUREMENTS").when(F.col("spc_signal_count") > 0, "EXPLORATORY_PHASE_I_SPC_SIGNALS_PRESENT").otherwise("EXPLORATORY_PHASE_I_STABILITY_NOT_ESTABLISHED"),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def groups(measurements: DataFrame, *keys: str) -> DataFrame:
    """Descriptions of groups, without indices."""
    x, n, known = F.col("measured_value").cast("double"), F.count(F.lit(1)), F.count("spc_signal")
    return measurements.groupBy(*keys).agg(
        n.alias("measurement_count"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("sample_std"), F.min(x).alias("min"), F.max(x).alias("max"),
        count_if("below_lsl").alias("below_lsl_count"), count_if("above_usl").alias("above_usl_count"), count_if("is_oos").alias("oos_count"), rate(count_if("is_oos"), n).alias("oos_rate"),
        count_if("spc_signal").alias("spc_signal_count"), known.alias("spc_evaluated_count"), (n - known).alias("spc_not_evaluated_count"), rate(count_if("spc_signal"), known).alias("spc_signal_rate"),
    )


def plotting_positions(measurements: DataFrame, *keys: str) -> DataFrame:
    """Ordered values of a group with their plotting positions (i - 1/2) / n and the normal quantiles of these.

    Only the distinct values of a group, with their counts, are ordered as a whole; rows are numbered among equal ones."""
    rows = measurements.select(*keys, "measurement_id", F.col("measured_value").cast("double").alias("value"))
    w = W.partitionBy(*keys)
    values = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(w.orderBy("value").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    values = values.select(*keys, "value", before.alias("_before"), F.sum("_n").over(w).alias("_all"))
    number = F.row_number().over(W.partitionBy(*keys, "value").orderBy("measurement_id"))
    placed = rows.withColumn("_number", number).join(values, [*keys, "value"])
    placed = placed.withColumn("plotting_position", (F.col("_before") + F.col("_number") - 0.5) / F.col("_all"))
    return placed.select(*keys, "measurement_id", "value", "plotting_position", normal_quantile("plotting_position").alias("theoretical_quantile"))
