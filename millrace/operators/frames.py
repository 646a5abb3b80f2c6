"""The frames behind the monitoring pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.rules import rule_label

_STREAM = ["booth_name", "point_code"]


def specifications(enriched: DataFrame) -> DataFrame:
    """The selectable specifications."""
    return enriched.select("specification_id", "characteristic", "unit", "lsl", "target", "usl").distinct()


def ambiguous_specifications(enriched: DataFrame) -> DataFrame:
    return specifications(enriched).groupBy("specification_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def filtered(results: DataFrame, first=None, last=None, batches=(), shifts=(), robots=()) -> DataFrame:
    """Endpoint filters; empty lists let all through.  They come after the rules, whose context stays whole.
    robots needs the array column robot_names."""
    day = F.col("measurement_timestamp").cast("date")
    if first is not None:
        results = results.where(day >= F.lit(first).cast("date"))
    if last is not None:
        results = results.where(day <= F.lit(last).cast("date"))
    if batches:
        results = results.where(F.col("batch_id").isin(*batches))
    if shifts:
        results = results.where(F.col("shift_name").isin(*shifts))
    if robots:
        results = results.where(F.arrays_overlap("robot_names", F.array(*map(F.lit, robots))))
    return results


def masked(results: DataFrame) -> DataFrame:
    """Limits only where a baseline covers the row; the lower limit of moving ranges is 0 there."""
    covered = F.col("baseline_id").isNotNull()
    limits = {c: F.when(covered, F.col(c)) for c in ("center_line", "i_lcl", "i_ucl", "mr_center", "mr_ucl")}
    return results.withColumns(limits | {"mr_lcl": F.when(covered, F.lit(0.0))})


def positions(results: DataFrame, keys: list[str] = _STREAM) -> DataFrame:
    """Each row's position in its whole stream, from 0.  Rows are numbered by day; only the days' counts are added up over
    the stream, so a long stream is as many tasks as it has days."""
    day = F.col("measurement_timestamp").cast("date")
    days = results.groupBy(*keys, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    w = W.partitionBy(*keys, "_day").orderBy("measurement_timestamp", "measurement_id")
    numbered = results.withColumn("_day", day).withColumn("_number", F.row_number().over(w))
    placed = numbered.join(days.select(*keys, "_day", before.alias("_before")), [*keys, "_day"])
    return placed.withColumn("position", F.col("_before") + F.col("_number") - 1).select(*results.columns, "position")


def with_breaks(rows: DataFrame, keys: list[str] = _STREAM) -> DataFrame:
    """Chart rows with an empty row wherever filtering left a gap or the baseline changed.  rows: with position.

    A break precedes its row: both have its position, and is_break sorts first.  Rows are taken in stretches of the stream;
    the row before a stretch's first is the last one of the stretch before."""
    rows = rows.withColumn("_stretch", F.floor(F.col("position") / 10_000))
    w = W.partitionBy(*keys, "_stretch").orderBy("position")
    ends = rows.groupBy(*keys, "_stretch").agg(F.max(F.struct("position", "baseline_id")).alias("_end"))
    ends = ends.select(*keys, "_stretch", F.lag("_end").over(W.partitionBy(*keys).orderBy("_stretch")).alias("_end"))
    rows = rows.withColumn("_last", F.lag(F.struct("position", "baseline_id")).over(w)).join(ends, [*keys, "_stretch"])
    rows = rows.withColumn("_last", F.coalesce("_last", "_end")).drop("_stretch", "_end")
    before, last = F.col("_last.position"), F.col("_last.baseline_id")
    cut = before.isNotNull() & ((F.col("position") - before > 1) | ~F.col("baseline_id").eqNullSafe(last))
    marked = rows.withColumns({"is_break": F.lit(False), "_cut": F.coalesce(cut, F.lit(False))})
    keep = {*keys, "position"}
    breaks = marked.where("_cut").select(*[F.col(c) if c in keep else F.lit(None).cast(t).alias(c) for c, t in marked.dtypes if c not in ("is_break", "_cut", "_last")], F.lit(True).alias("is_break"))
    return marked.drop("_cut", "_last").unionByName(breaks)


def in_chart_order(rows: DataFrame, keys: list[str] = _STREAM) -> DataFrame:
    return rows.orderBy(*keys, "position", F.desc("is_break"))


def individuals_chart(results: DataFrame) -> DataFrame:
    rows = masked(positions(results)).select(*_STREAM, "position", "measurement_timestamp", "measured_value", "center_line", "i_lcl", "i_ucl", "spc_signal", "baseline_id")
    return with_breaks(rows)


def moving_range_chart(results: DataFrame) -> DataFrame:
    rows = masked(positions(results)).select(*_STREAM, "position", "measurement_timestamp", "moving_range", "mr_center", "mr_ucl", "mr_lcl", "baseline_id")
    return with_breaks(rows)


def signal_details(results: DataFrame) -> DataFrame:
    return results.where("spc_signal").select("measurement_timestamp", "measurement_id", *_STREAM, "shift_name", "shift_instance", "measured_value", "moving_range", "i_lcl", "i_ucl", rule_label().alias("triggered_rules"))


def mr_violations(results: DataFrame) -> DataFrame:
    return results.where("baseline_id is not null and moving_range > mr_ucl").select("measurement_timestamp", "measurement_id", *_STREAM, "moving_range", "mr_center", "mr_ucl")


def provenance(results: DataFrame) -> DataFrame:
    """The baselines that cover rows, with what they cover."""
    return results.where("baseline_id is not null").groupBy(*_STREAM, "baseline_id", "center_line", "sigma", "i_lcl", "i_ucl").agg(F.count(F.lit(1)).alias("covered_measurements"), F.min("measurement_timestamp").alias("first_measurement"), F.max("measurement_timestamp").alias("last_measurement"))


def unassigned(baselines: DataFrame, results: DataFrame) -> DataFrame:
    """Active baselines that cover no row."""
    return baselines.where("status = 'ACTIVE'").join(results.select("baseline_id").distinct(), "baseline_id", "left_anti")


def active_as_json(baselines: DataFrame) -> DataFrame:
    """Each scope's active baseline as JSON with its nulls."""
    body = F.to_json(F.struct("baseline_id", "version", "effective_from", "effective_to", "center_line", "sigma", "i_lcl", "i_ucl"), {"ignoreNullFields": "false"})
    return baselines.where("status = 'ACTIVE'").select("booth_id", "measurement_point_id", "specification_id", body.alias("active_baseline"))


#: What a page shows of the active baseline.
ACTIVE_JSON = ("baseline_id", "version", "status", "approved_by", "center_line", "sigma", "i_lcl", "i_ucl", "mr_center", "mr_ucl")


def monitoring_detail(results: DataFrame, enriched: DataFrame, specifications: DataFrame, baselines: DataFrame, robots: DataFrame) -> DataFrame:
    """Every control result with its specification, its own baseline, its scope's active one as JSON (NULL where there is
    none) and its robots' names.  All joins are left ones: a result is never lost.  robots: measurement_id, robot_name."""
    scope = ["booth_id", "measurement_point_id", "specification_id"]
    own = baselines.select("baseline_id", F.col("version").alias("baseline_version"), F.col("status").alias("baseline_current_status"), F.col("approved_by").alias("baseline_approved_by"))
    # The status is part of the join's condition, so it is applied to the right side before the join.
    text = [F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in baselines.select(*ACTIVE_JSON).dtypes]
    active = baselines.where("status = 'ACTIVE'").select(*scope, F.to_json(F.struct(*text), {"ignoreNullFields": "false"}).alias("active_baseline"))
    names = robots.groupBy("measurement_id").agg(F.array_sort(F.collect_list("robot_name")).alias("robot_names"))
    return (
        results.select("measurement_id", "measurement_timestamp", "baseline_id", "booth_name", "point_code", "shift_name", "measured_value", "moving_range", "spc_signal")
        .join(enriched.select("measurement_id", "batch_id", *scope), "measurement_id", "left")
        .join(specifications.select("specification_id", "characteristic", F.col("unit").alias("specification_unit")), "specification_id", "left")
        .join(own, "baseline_id", "left")
        .join(active, scope, "left")
        .join(names, "measurement_id", "left")
    )


def sanity(results: DataFrame) -> DataFrame:
    """(check, violations): what must stop an analysis."""
    from millrace.operators.checks import counted, union

    limits = ["center_line", "i_lcl", "i_ucl", "mr_center", "mr_ucl"]
    missing = " or ".join(f"{c} is null" for c in limits)
    return union(
        [
            counted("missing_context", results.where("specification_id is null or batch_id is null or shift_id is null")),
            counted("signal_without_baseline", results.where("baseline_id is null and (coalesce(spc_signal, false) or rule_1 or rule_2 or rule_3 or rule_4)")),
            counted("signal_nullability", results.where("(baseline_id is null) <> (spc_signal is null)")),
            counted("limits_missing_or_not_finite", results.where(f"baseline_id is not null and ({missing} or isnan(cast(i_ucl as double)) or isnan(cast(i_lcl as double)))")),
        ]
    )
