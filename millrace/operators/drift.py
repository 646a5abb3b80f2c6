"""Drift and shift-to-shift variation of ordered streams.

Row-level input is aggregated to one row per shift instance first; only that small frame is ever ordered as a whole,
by stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.formulas import Z_975, count_if, month, rate

_SHIFT = ["shift_instance", "shift_id", "shift_name"]
STREAM = ["booth_name", "point_code"]


def _metrics(below: bool = True) -> list:
    x, n, known = F.col("measured_value").cast("double"), F.count(F.lit(1)), F.count("spc_signal")
    out = [n.alias("measurement_count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sample_std"), F.avg(F.col("deviation_from_target").cast("double")).alias("mean_deviation_from_target")]
    if below:
        out += [count_if("below_lsl").alias("below_lsl_count"), count_if("above_usl").alias("above_usl_count")]
    out += [count_if("is_oos").alias("oos_count"), rate(count_if("is_oos"), n).alias("oos_rate"), count_if("spc_signal").alias("spc_signal_count"), known.alias("spc_evaluated_count"), rate(count_if("spc_signal"), known).alias("spc_signal_rate")]
    return out + [count_if(f"rule_{k}").alias(f"rule_{k}_count") for k in range(1, 5)]


def _within():
    x = F.col("measured_value").cast("double")
    return (F.power(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 2) * F.greatest(F.count(F.lit(1)) - 1, F.lit(0))).alias("within_sum_of_squares")


def by_month(results: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    return results.groupBy(*keys, month("production_timestamp").alias("production_month")).agg(*_metrics())


def by_instance(results: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    return results.groupBy(*keys, *_SHIFT).agg(F.min("measurement_timestamp").alias("first_measurement_timestamp"), F.max("measurement_timestamp").alias("last_measurement_timestamp"), *_metrics(), _within())


def by_type(results: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    return results.groupBy(*keys, "shift_id", "shift_name").agg(F.countDistinct("shift_instance").alias("shift_instance_count"), *_metrics(below=False))


def sufficient(results: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """What a one-way decomposition needs of each shift instance."""
    x = F.col("measured_value").cast("double")
    return results.groupBy(*keys, *_SHIFT).agg(F.count(F.lit(1)).alias("measurement_count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sample_std"), _within())


def decomposition(results: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Total sum of squares = within shift instances + between them."""
    s = sufficient(results, keys)
    n, m = F.col("measurement_count"), F.col("mean")
    means = s.groupBy(*keys).agg((F.sum(n * m) / F.sum(n)).alias("overall_mean"))
    joined = s.join(means, keys) if keys else s.crossJoin(F.broadcast(means))
    out = joined.groupBy(*keys).agg(F.sum(n).alias("measurement_count"), F.count(F.lit(1)).alias("shift_instance_count"), F.first("overall_mean").alias("overall_mean"), F.sum("within_sum_of_squares").alias("within_shift_sum_of_squares"), F.sum(n * F.power(m - F.col("overall_mean"), 2)).alias("between_shift_sum_of_squares"))
    within, between = F.col("within_shift_sum_of_squares"), F.col("between_shift_sum_of_squares")
    total = within + between
    n, g = F.col("measurement_count"), F.col("shift_instance_count")
    return out.withColumns(
        {
            "total_sum_of_squares": total,
            "within_shift_share": F.when(total != 0, within / total),
            "between_shift_share": F.when(total != 0, between / total),
            "pooled_within_shift_sd": F.when(n > g, F.sqrt(within / (n - g))),
            "overall_sample_sd": F.when(n >= 2, F.sqrt(total / (n - 1))),
        }
    )


def subgroup_sizes(results: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    return results.groupBy(*keys, "shift_instance").agg(F.count(F.lit(1)).alias("measurement_count")).groupBy(*keys, "measurement_count").agg(F.count(F.lit(1)).alias("shift_instance_count"))


def instance_means(results: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    return results.groupBy(*keys, "shift_instance").agg(F.avg(F.col("measured_value").cast("double")).alias("mean"))


def rolling(means: DataFrame, windows: tuple[int, ...] = (7, 14, 21), keys: list[str] = STREAM) -> DataFrame:
    """Trailing means; NULL until a window is full."""
    w = W.partitionBy(*keys).orderBy("shift_instance")
    span = lambda k: w.rowsBetween(1 - k, 0)
    return means.withColumns({f"rolling_mean_{k}": F.when(F.count("mean").over(span(k)) == k, F.avg("mean").over(span(k))) for k in windows})


def halves(means: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """The chronological halves; of an odd number the later half gets the middle one.  Streams of fewer than two
    instances have none."""
    w = W.partitionBy(*keys)
    split = F.floor(F.count(F.lit(1)).over(w) / 2)
    rows = means.withColumns({"_first": F.row_number().over(w.orderBy("shift_instance")) <= split, "_n": F.count(F.lit(1)).over(w)}).where("_n >= 2")
    out = []
    for name, inside in (("first", F.col("_first")), ("second", ~F.col("_first"))):
        mean, at = F.when(inside, F.col("mean")), F.when(inside, F.col("shift_instance"))
        out += [F.count(mean).alias(f"{name}_half_shift_instance_count"), F.avg(mean).alias(f"{name}_half_mean"), F.stddev_samp(mean).alias(f"{name}_half_sample_std"), F.min(at).alias(f"{name}_half_start"), F.max(at).alias(f"{name}_half_end")]
    both = rows.groupBy(*keys).agg(*out).where("second_half_shift_instance_count > 0")
    return both.withColumn("second_minus_first_mean", F.col("second_half_mean") - F.col("first_half_mean"))


def _centred(means: DataFrame, keys: list[str]) -> DataFrame:
    """x: days since the first instance, centred; y: the mean, centred; n."""
    w = W.partitionBy(*keys)
    seconds = F.unix_timestamp(F.col("shift_instance").cast("timestamp"))
    days = means.withColumn("_d", (seconds - F.min(seconds).over(w)) / 86400.0)
    return days.withColumns({"_x": F.col("_d") - F.avg("_d").over(w), "_y": F.col("mean") - F.avg("mean").over(w), "_ybar": F.avg("mean").over(w), "_n": F.count(F.lit(1)).over(w)}).where("_n >= 3")


def _slopes(means: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys)
    rows = _centred(means, keys).withColumns({"_sxx": F.sum(F.col("_x") * F.col("_x")).over(w), "_sxy": F.sum(F.col("_x") * F.col("_y")).over(w)}).where("_sxx > 0")
    return rows.withColumn("_slope", F.col("_sxy") / F.col("_sxx"))


def trend(means: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Least squares of instance means on days, with a normal 95 % interval, and slopes with one instance left out.

    Leaving one out keeps x centred on the mean of all: the slope without i is (Sxy - x_i y_i + x_i ybar_i) / (Sxx - x_i^2)
    with ybar_i the mean of the other centred y.  Streams of fewer than three instances have no row."""
    rows = _slopes(means, keys)
    x, y, n = F.col("_x"), F.col("_y"), F.col("_n")
    residual = y - F.col("_slope") * x
    others = -y / (n - 1)
    left_out = (F.col("_sxy") - x * y + x * others) / (F.col("_sxx") - x * x)
    rows = rows.withColumns({"_r2": residual * residual, "_loo": left_out})
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observation_count"), F.min("shift_instance").alias("time_origin"), F.max("_d").alias("duration_days"), F.first("_slope").alias("slope_per_day"),
        F.sqrt(F.sum("_r2") / (F.count(F.lit(1)) - 2) / F.first("_sxx")).alias("slope_standard_error"), F.min("_loo").alias("loo_slope_min"), F.max("_loo").alias("loo_slope_max"),
        F.max(F.abs(F.col("_loo") - F.col("_slope"))).alias("max_loo_slope_change"),
    )
    half = Z_975 * F.col("slope_standard_error")
    return out.where("observation_count >= 3").withColumns(
        {
            "slope_ci_95_low": F.col("slope_per_day") - half,
            "slope_ci_95_high": F.col("slope_per_day") + half,
            "estimated_cumulative_fitted_change": F.col("slope_per_day") * F.col("duration_days"),
            "slope_direction_stable": (F.col("loo_slope_min") > 0) | (F.col("loo_slope_max") < 0),
        }
    )


def fitted(means: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    rows = _slopes(means, keys)
    return rows.select(*keys, "shift_instance", "mean", (F.col("_ybar") + F.col("_slope") * F.col("_x")).alias("fitted_value"), (F.col("_y") - F.col("_slope") * F.col("_x")).alias("residual"))


def evidence(results: DataFrame, capability: DataFrame, keys: list[str] = STREAM, share: float = 0.25, windows: tuple[int, ...] = (7, 14, 21)) -> DataFrame:
    """Five conditions that must all hold before a stream's pattern is called consistent with drift."""
    means = instance_means(results, keys)
    line, parts = trend(means, keys), halves(means, keys).select(*keys, "second_minus_first_mean")
    moved = rolling(means, windows, keys)
    ends = []
    for k in windows:
        pair = F.struct(F.col("shift_instance"), F.col(f"rolling_mean_{k}").alias("v"))
        full = F.when(F.col(f"rolling_mean_{k}").isNotNull(), pair)
        ends.append((F.max(full)["v"] - F.min(full)["v"]).alias(f"_c{k}"))
    moved = moved.groupBy(*keys).agg(*ends)
    all_ = line.join(parts, keys).join(moved, keys).join(capability.select(*keys, "within_sigma"), keys)
    way = F.signum("slope_per_day")
    ok = {
        "slope_ci_excludes_zero": (F.col("slope_ci_95_low") > 0) | (F.col("slope_ci_95_high") < 0),
        "practically_meaningful": F.abs("estimated_cumulative_fitted_change") >= share * F.col("within_sigma"),
        "half_direction_compatible": (F.signum("second_minus_first_mean") == way) & (way != 0),
        "leave_one_out_stable": F.col("slope_direction_stable"),
    }
    rolled = way != 0
    for k in windows:
        rolled = rolled & F.coalesce(F.signum(f"_c{k}") == way, F.lit(False))
    ok["rolling_direction_compatible"] = rolled
    every = F.lit(True)
    for c in ok.values():
        every = every & F.coalesce(c, F.lit(False))
    return all_.select(*keys, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in ok.items()], every.alias("consistent_with_drift"))


def coerced(raw: DataFrame, numbers: tuple[str, ...] = ("measured_value", "target"), times: tuple[str, ...] = ("measurement_timestamp", "production_month", "shift_instance")) -> DataFrame:
    """Text columns as numbers and local times; what does not parse becomes NULL."""
    parsed = {c: F.expr(f"try_cast(`{c}` as double)") for c in numbers}
    parsed |= {c: F.expr(f"try_cast(`{c}` as timestamp_ntz)") for c in times}
    return raw.withColumns(parsed)


def input_violations(measurements: DataFrame) -> DataFrame:
    """(check, violations) for what a drift study's input must not have; all counts are 0 for a valid input."""
    from millrace.operators.checks import counted, duplicates, union

    need = {"measurement_id", "measurement_timestamp", "production_month", "shift_instance", "shift_id", "shift_name", "measured_value", "target"}
    if missing := sorted(need - set(measurements.columns)):
        raise ValueError(f"columns are missing: {missing}")
    odd = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    shifts = measurements.groupBy("shift_instance").agg(F.countDistinct("shift_id").alias("ids"), F.countDistinct("shift_name").alias("names"))
    return union(
        [
            counted("no_rows", measurements.agg(F.count(F.lit(1)).alias("n")).where("n = 0")),
            counted("missing_id", measurements.where("measurement_id is null")),
            counted("repeated_id", duplicates(measurements.where("measurement_id is not null"), "measurement_id")),
            counted("missing_time", measurements.where("measurement_timestamp is null or production_month is null or shift_instance is null")),
            counted("missing_shift", measurements.where("shift_id is null or shift_name is null")),
            counted("instance_of_several_shifts", shifts.where("ids <> 1 or names <> 1")),
            counted("value_missing_or_not_finite", measurements.where(odd("measured_value"))),
            counted("target_missing_or_not_finite", measurements.where(odd("target"))),
        ]
    )
