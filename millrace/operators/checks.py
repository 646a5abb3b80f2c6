"""Data-integrity and reconciliation checks: each is a relation of violations, or a count of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return union([df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for n, df in tables.items()])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child without a parent; a NULL key is none."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "LEFT_ONLY").unionByName(only(right, left, "RIGHT_ONLY"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    sums = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    return sums.select(F.expr(f"stack({len(cols)}, {', '.join(f"'not_null_{c}', `{c}`" for c in cols)}) as (check, violations)"))


def accepted(df: DataFrame, col: str, values: list) -> DataFrame:
    return counted(f"accepted_{col}", df.where(~F.col(col).isin(*values)))


def group_size(df: DataFrame, keys: list[str], low: int, high: int, distinct: str | None = None) -> DataFrame:
    """Groups whose number of rows (or of distinct values) is not within low and high."""
    n = F.countDistinct(distinct) if distinct else F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("n")).where(~F.col("n").between(low, high))


def totals(grouped: dict[str, DataFrame], total: DataFrame, measure: str = "measurement_count") -> DataFrame:
    """Sums of group counts against the rows they come from."""
    want = total.agg(F.count(F.lit(1)).alias("expected"))
    parts = [df.agg(F.lit(n).alias("relation"), F.sum(measure).cast("long").alias("total")) for n, df in grouped.items()]
    return union(parts).crossJoin(F.broadcast(want)).withColumn("agrees", F.col("total") == F.col("expected"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rows of a full join whose values differ, or that one side lacks."""
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in cols])
    j = side(left, "l_").join(side(right, "r_"), keys, "full")
    bad: Column = reduce(lambda a, b: a | b, [~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in cols])
    return j.where(bad)


def rule_checks(results: DataFrame) -> DataFrame:
    """Invariants of rule results."""
    rules = F.expr("rule_1 or rule_2 or rule_3 or rule_4")
    covered = F.col("baseline_id").isNotNull()
    return union(
        [
            counted("duplicate_measurement", duplicates(results, "measurement_id")),
            counted("signal_is_not_the_rules", results.where(covered & ~F.col("spc_signal").eqNullSafe(rules))),
            counted("signal_without_baseline", results.where(~covered & (F.col("spc_signal").isNotNull() | rules))),
            counted("status_is_not_coverage", results.where(covered != (F.col("spc_evaluation_status") == "EVALUATED"))),
            counted("rule_1_is_not_the_limits", results.where(covered & (F.col("rule_1") != ((F.col("measured_value") > F.col("i_ucl")) | (F.col("measured_value") < F.col("i_lcl")))))),
            counted("negative_moving_range", results.where("moving_range < 0")),
            counted("limits_without_baseline", results.where(~covered & (F.col("center_line").isNotNull() | F.col("sigma").isNotNull()))),
            counted("missing_scope", results.where("booth_name is null or point_code is null or shift_instance is null")),
        ]
    )


def production_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """The invariants of the canonical tables (names as in millrace.sources.generate)."""
    m, cabins, batches, bridge = tables["fact_quality_measurement"], tables["dim_cabin"], tables["dim_batch"], tables["bridge_measurement_robot"]
    robots = tables["dim_robot"].join(tables["dim_track_axis"], "track_axis_id")
    events = tables["fact_process_event"]
    placed = bridge.join(robots.select("robot_id", F.col("booth_id").alias("robot_booth"), "track_axis_id"), "robot_id").join(m.select("measurement_id", "cabin_id"), "measurement_id").join(cabins.select("cabin_id", "booth_id"), "cabin_id")
    in_batch = cabins.join(batches, "batch_id")
    spec_unit = m.join(tables["dim_specification"].select("specification_id", F.col("unit").alias("spec_unit")), "specification_id")
    by_event = events.join(cabins.select("batch_id", F.col("booth_id").alias("batch_booth")).distinct(), "batch_id", "left").join(batches, "batch_id", "left")
    sizes = bridge.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n"))
    return union(
        [
            counted("points_per_cabin", group_size(m, ["cabin_id"], 18, 18, "measurement_point_id")),
            counted("robots_per_measurement", m.select("measurement_id").join(sizes, "measurement_id", "left").where("coalesce(n, 0) not between 1 and 4")),
            counted("contributors_do_not_vary", sizes.agg(F.countDistinct("n").alias("k")).where("k < 2")),
            counted("robot_in_other_booth", placed.where("robot_booth <> booth_id")),
            counted("no_cross_track_measurement", placed.groupBy("measurement_id").agg(F.countDistinct("track_axis_id").alias("k")).agg(F.max("k").alias("k")).where("k < 2")),
            counted("timestamp_is_not_the_cabins", m.join(cabins, "cabin_id").where("measurement_timestamp <> production_timestamp")),
            counted("unit_is_not_the_specifications", spec_unit.where("unit <> spec_unit")),
            counted("booths_per_batch", group_size(cabins, ["batch_id"], 1, 1, "booth_id")),
            counted("cabins_per_batch", group_size(cabins, ["batch_id"], 5, 5)),
            counted("cabin_outside_batch", in_batch.where("production_timestamp < batch_start or production_timestamp >= batch_end")),
            counted("event_is_not_its_batchs", by_event.where("batch_booth is null or batch_booth <> booth_id or event_timestamp < batch_start or event_timestamp >= batch_end")),
            counted("robots_per_booth", group_size(robots, ["booth_id"], 4, 4)),
        ]
    )


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The join of two relations that have at most one row for a key each; a repeated key is an error when rows are read."""
    from pyspark.sql import Window as W

    def unique(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        return df.withColumn("_n", n).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"a key is not unique on the {side}")).cast("boolean"))).drop("_n")

    return unique(left, "left").join(unique(right, "right"), keys)


def expected_rows(expected: DataFrame, actual: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Expected rows that are missing or have other values; keys and values may be NULL, which equals NULL."""
    right = actual.select(*[F.col(c).alias(f"_a_{c}") for c in (*keys, *cols)], F.lit(True).alias("_here"))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_a_{k}")) for k in keys])
    other = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in cols], F.lit(False))
    found = expected.join(right, match, "left")
    state = F.when(F.col("_here").isNull(), "MISSING").when(other, "DIFFERENT")
    return found.select(*keys, state.alias("state")).where("state is not null")


def scalar_mismatches(child: DataFrame, parent: DataFrame, key: str, child_col: str, parent_col: str) -> DataFrame:
    """Rows of child whose value is not that of their parent, which a correlated scalar subquery looks up."""
    sql = f"SELECT c.* FROM {{child}} c WHERE c.`{child_col}` <> (SELECT max(p.`{parent_col}`) FROM {{parent}} p WHERE p.`{key}` = c.`{key}`)"
    return child.sparkSession.sql(sql, child=child, parent=parent)


def reference_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Tables whose number of rows is not the contract's."""
    want = F.create_map(*[x for n, k in expected.items() for x in (F.lit(n), F.lit(k).cast("long"))])
    return row_counts({n: tables[n] for n in expected}).withColumn("expected", want[F.col("table_name")]).where("row_count <> expected")


def bootstrap_checks(facts: DataFrame, enriched: DataFrame, baselines: DataFrame, results: DataFrame) -> DataFrame:
    """What must hold after a build: nothing lost, one active baseline a scope, limits and flags as stored."""
    from millrace.operators.baseline import LIMITS, SCOPE

    active = baselines.where("status = 'ACTIVE'")
    eligible = enriched.join(active.select(*SCOPE).distinct(), SCOPE, "left_semi")
    stored = baselines.select("baseline_id", *[F.col(c).alias(f"_{c}") for c in LIMITS])
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LIMITS])
    rules = F.expr("rule_1 or rule_2 or rule_3 or rule_4")
    covered = F.col("baseline_id").isNotNull()
    flags = (covered & ~F.col("spc_signal").eqNullSafe(rules)) | (~covered & (rules | F.col("spc_signal").isNotNull())) | (covered != F.col("spc_evaluation_status").eqNullSafe(F.lit("EVALUATED")))
    lost = facts.select("measurement_id").join(enriched.select("measurement_id"), "measurement_id", "left_anti")
    return union(
        [
            counted("no_measurements", facts.agg(F.count(F.lit(1)).alias("n")).where("n = 0")),
            counted("measurement_not_enriched", lost),
            counted("enriched_twice", duplicates(enriched, "measurement_id")),
            counted("scope_without_one_active_baseline", baselines.groupBy(*SCOPE).agg(F.count(F.when(F.col("status") == "ACTIVE", 1)).alias("n")).where("n <> 1")),
            counted("eligible_without_result", eligible.select("measurement_id").join(results.select("measurement_id"), "measurement_id", "left_anti")),
            counted("invalid_flags", results.where(flags)),
            counted("limits_not_preserved", results.join(stored, "baseline_id").where(changed)),
            counted("result_twice", duplicates(results, "measurement_id")),
        ]
    )


def input_reconciliation(source: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row: counts of an analysis input against its source, and whether all agree, row by row too."""
    cols = ["is_oos", "spc_signal", "baseline_id", "spc_evaluation_status"]
    n = lambda df, p: df.agg(F.count(F.lit(1)).alias(f"{p}_count"), F.countDistinct("measurement_id").alias(f"distinct_{p}_count"), F.count(F.when(F.col("is_oos"), 1)).alias(f"{p}_oos_count"), F.count(F.when(F.col("spc_signal"), 1)).alias(f"{p}_signal_count"))
    row = n(source, "source").crossJoin(n(inputs, "input")).crossJoin(reconcile(source, inputs, ["measurement_id"], cols).agg(F.count(F.lit(1)).alias("different_rows")))
    agree = reduce(lambda a, b: a & b, [F.col(f"source_{c}") == F.col(f"input_{c}") for c in ("count", "oos_count", "signal_count")]) & (F.col("input_count") == F.col("distinct_input_count")) & (F.col("different_rows") == 0)
    return row.withColumn("reconciliation_status", F.when(agree, "PASS").otherwise("FAIL"))


def drift_reconciliation(inputs: DataFrame, per_instance: tuple[int, int] = (1, 1 << 62), tolerance: float = 1e-6) -> DataFrame:
    """(check, violations) of a drift study's input: mapping, overnight shifts, group totals, sums of squares."""
    x = F.col("measured_value").cast("double")
    low, high = per_instance
    instances = inputs.groupBy("shift_instance").agg(F.countDistinct("shift_id").alias("ids"), F.countDistinct("shift_name").alias("names"), F.countDistinct("measurement_id").alias("n"))
    overnight = inputs.where((F.col("shift_name") == "SHIFT_03") & ((F.date_format("shift_instance", "HH:mm:ss") != "22:00:00") | (F.col("measurement_timestamp") < F.col("shift_instance")) | (F.col("measurement_timestamp") >= F.col("shift_instance") + F.expr("INTERVAL '8' HOUR"))))
    sums = [F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_oos"), 1)).alias("oos"), F.count("spc_signal").alias("evaluated"), F.count(F.when(F.col("spc_signal"), 1)).alias("signals")]
    names = ["n", "oos", "evaluated", "signals"]
    keys = ["production_month", "shift_instance", "shift_id"]
    grouped = inputs.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.grouping_id().alias("scope"), *sums)
    totals_ = grouped.groupBy("scope").agg(*[F.sum(c).alias(c) for c in names])
    overall = inputs.agg(*[c.alias(f"all_{n}") for c, n in zip(sums, names)])
    wrong = totals_.crossJoin(F.broadcast(overall)).where(reduce(lambda a, b: a | b, [F.col(c) != F.col(f"all_{c}") for c in names]))
    per = inputs.groupBy("shift_instance").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), (F.power(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 2) * F.greatest(F.count(F.lit(1)) - 1, F.lit(0))).alias("within"))
    mean = inputs.agg(F.avg(x).alias("overall"), (F.var_pop(x) * F.count(x)).alias("total"))
    squares = per.crossJoin(F.broadcast(mean)).agg(F.first("total").alias("total"), F.sum("within").alias("within"), F.sum(F.col("n") * F.power(F.col("mean") - F.col("overall"), 2)).alias("between"))
    off = squares.where(F.abs(F.col("total") - F.col("within") - F.col("between")) > tolerance * F.greatest(F.lit(1.0), F.col("total")))
    return union(
        [
            counted("repeated_measurement", duplicates(inputs, "measurement_id")),
            counted("instance_of_several_shifts", instances.where("ids <> 1 or names <> 1")),
            counted("measurements_per_instance", instances.where(~F.col("n").between(low, high))),
            counted("overnight_shift", overnight),
            counted("status_is_not_coverage", inputs.where("(baseline_id is null) <> (spc_evaluation_status = 'NOT_EVALUATED') or (baseline_id is null) <> (spc_signal is null)")),
            counted("group_totals", wrong),
            counted("sums_of_squares", off),
        ]
    )
