"""Individuals charts with four run rules over ordered streams.

Every window is partitioned by the stream and the concrete shift first, so one exchange serves the whole chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.baseline import LIMITS, SCOPE, effective

STREAM = [*SCOPE, "shift_id", "shift_instance"]
_ORDER = ["measurement_timestamp", "measurement_id"]


def segments(matched: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """baseline_segment counts the changes of baseline so far; no baseline after none is no change."""
    w = W.partitionBy(*keys).orderBy(*_ORDER)
    changed = ~F.col("baseline_id").eqNullSafe(F.lag("baseline_id").over(w))
    return matched.withColumn("_changed", changed.cast("int")).withColumn("baseline_segment", F.sum("_changed").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_changed")


def apply_rules(matched: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """matched: a stream with baseline_id and limits.  Adds moving_range, rule_1 to rule_4, spc_signal and status."""
    inner = [*keys, "baseline_segment"]
    w = W.partitionBy(*inner).orderBy(*_ORDER)
    v, c, s = F.col("measured_value"), F.col("center_line"), F.col("sigma")
    covered = F.col("baseline_id").isNotNull()
    flag = lambda x: F.when(covered & x, 1).otherwise(0)
    side = F.when(covered & (v > c), 1).when(covered & (v < c), -1).otherwise(0)
    df = segments(matched, keys)
    df = df.withColumns(
        {
            "_n": F.row_number().over(w),
            "moving_range": F.abs(v - F.lag("measured_value").over(w)),
            "_side": side,
            **{f"_above_{k}": flag(v > c + k * s) for k in (1, 2)},
            **{f"_below_{k}": flag(v < c - k * s) for k in (1, 2)},
        }
    )
    three, five = w.rowsBetween(-2, 0), w.rowsBetween(-4, 0)
    df = df.withColumns(
        {
            "_two": F.greatest(F.sum("_above_2").over(three), F.sum("_below_2").over(three)),
            "_four": F.greatest(F.sum("_above_1").over(five), F.sum("_below_1").over(five)),
            "_turn": (F.col("_side") != F.lag("_side", 1, 0).over(w)).cast("int"),
        }
    )
    df = df.withColumn("_run", F.sum("_turn").over(w.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("_length", F.count(F.lit(1)).over(W.partitionBy(*inner, "_run").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumns(
        {
            "rule_1": covered & F.coalesce((v > F.col("i_ucl")) | (v < F.col("i_lcl")), F.lit(False)),
            "rule_2": covered & (F.col("_n") >= 3) & (F.col("_two") >= 2),
            "rule_3": covered & (F.col("_n") >= 5) & (F.col("_four") >= 4),
            "rule_4": covered & (F.col("_side") != 0) & (F.col("_length") >= 8),
        }
    )
    df = df.withColumns({"spc_signal": F.when(covered, F.expr("rule_1 or rule_2 or rule_3 or rule_4")), "spc_evaluation_status": F.when(covered, "EVALUATED").otherwise("NOT_EVALUATED")})
    return df.drop(*[x for x in df.columns if x.startswith("_")])


RESULT = ("measurement_timestamp", "measurement_id", "baseline_id", "booth_name", "point_code", "shift_id", "shift_name", "shift_instance", "measured_value", "moving_range", *LIMITS, "rule_1", "rule_2", "rule_3", "rule_4", "spc_signal", "spc_evaluation_status")


def spc_results(enriched: DataFrame, baselines: DataFrame, zone: str, booth: str | None = None, point: str | None = None) -> DataFrame:
    """Rule results of whole streams.  A scope is filtered before the windows: other streams are never computed."""
    if booth is not None:
        enriched = enriched.where(F.col("booth_name") == booth)
    if point is not None:
        enriched = enriched.where(F.col("point_code") == point)
    return apply_rules(effective(enriched, baselines, zone))


def result_columns(results: DataFrame) -> DataFrame:
    return results.select(*RESULT).withColumnsRenamed({"booth_name": "booth", "point_code": "measurement_point"})


def short_names(results: DataFrame) -> DataFrame:
    """The compatibility names of the individuals chart's limits."""
    return results.withColumnsRenamed({"i_lcl": "lcl", "i_ucl": "ucl"})


def rule_label() -> Column:
    """The triggered rules' names, joined."""
    return F.concat_ws(" + ", *[F.when(F.col(f"rule_{k}"), F.lit(f"Rule {k}")) for k in range(1, 5)])
