"""The registered queries: the engine's operators bound to the given tables.  Doubles are rounded to six places here,
and only here, so that the order of additions does not show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.formulas import instant
from millrace.operators import baseline, capability, checks, compare, drift, enrich, frames, lifecycle, quality, rules, summaries
from millrace.sources import bind, files, generate, store

ZONE = "Europe/Budapest"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Decimals as doubles; doubles with six places.  A billionth more keeps exact halves from going either way."""
    cols = {c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")}
    cols |= {c: F.round(F.col(c) + 1e-9, 6) for c, t in df.dtypes if t == "double"}
    return df.withColumns(cols) if cols else df


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
    return f


# ---------------------------------------------------------------- inputs


def stream(spark, d) -> DataFrame:
    return enrich.enrich_stream(bind.stream(spark, d))


def star(spark, d) -> DataFrame:
    return enrich.enrich_star(bind.star_tables(spark, d))


def _version(e: DataFrame, days: int, version: int, status: str, start: int | None, end: int | None) -> DataFrame:
    window = baseline.baseline_window(e, days)
    fitted = baseline.as_decimals(baseline.fit(baseline.in_window(e, window))).join(window, baseline.SCOPE)
    at = lambda n: F.lit(None).cast("timestamp") if n is None else instant(F.col("window_start") + F.expr(f"INTERVAL '{n}' DAY"), ZONE)
    return fitted.withColumns({"version": F.lit(version), "status": F.lit(status), "effective_from": at(start), "effective_to": at(end), "baseline_id": F.col("booth_id").cast("long") * 10_000_000 + F.col("measurement_point_id") * 10 + version})


def baselines(spark, d) -> DataFrame:
    """Three versions a scope: one that has ended, one in force that overlaps it, one that is a draft.  The table is
    stored, as a plant's baselines are, and fitted again only when the events change."""
    return store.stored(spark, "baselines", [f"{d}/events.parquet"], lambda: _fitted(stream(spark, d)))


def _fitted(e: DataFrame) -> DataFrame:
    return _version(e, 9, 1, "RETIRED", 9, 15).unionByName(_version(e, 12, 2, "ACTIVE", 12, None)).unionByName(_version(e, 6, 3, "DRAFT", None, None))


def results(spark, d) -> DataFrame:
    return rules.spc_results(stream(spark, d), baselines(spark, d), ZONE)


def bridge(spark, d) -> DataFrame:
    m = bind.stream(spark, d).select("measurement_id")
    a, b, c = F.col("measurement_id") % 8 + 1, F.floor(F.col("measurement_id") / 8) % 8 + 1, F.floor(F.col("measurement_id") / 64) % 8 + 1
    return m.select("measurement_id", F.explode(F.array_distinct(F.array(a, b, c))).alias("robot_id"))


def process_events(spark, d) -> DataFrame:
    return stream(spark, d).where("above_usl").select(
        F.col("measurement_id").alias("event_id"), F.col("measurement_timestamp").alias("event_timestamp"), F.lit("SPECIFICATION_VIOLATION").alias("event_type"), F.concat_ws(" ", "point_code", F.col("production_date").cast("string")).alias("description"), F.when(F.col("measured_value") > 200, "HIGH").otherwise("LOW").alias("severity"), "batch_id", "booth_id"
    )


_BATCH = ["batch_id", "booth_id", "booth_name", "shift_id", "shift_name", "production_date"]
_CABIN = ["cabin_id", "batch_id", "booth_id", "booth_name", "shift_id", "shift_name", "production_date"]


def context(spark, d) -> DataFrame:
    e = stream(spark, d)
    return quality.event_context(process_events(spark, d), e.select("booth_id", "booth_name").distinct(), quality.batch_quality(e, _BATCH))


# ---------------------------------------------------------------- enrichment and quality


@query
def measurement_enriched(spark, d):
    return enrich.contract(stream(spark, d), enrich.ENRICHED)


@query
def staging_measurements(spark, d):
    return enrich.staging(stream(spark, d))


@query
def star_enriched(spark, d):
    """The rows of the seven-table star, as counts by their flags."""
    return star(spark, d).groupBy("booth_name", "shift_name", "compliance_status").agg(F.count(F.lit(1)).alias("measurement_count"), F.sum("deviation_from_target").cast("double").alias("sum_deviation"))


@query
def compliance_distribution(spark, d):
    return quality.compliance_distribution(star(spark, d))


@query
def production_volume(spark, d):
    return quality.production_volume(stream(spark, d), ["production_date", "shift_id", "shift_name", "booth_id", "booth_name"])


@query
def cabin_quality(spark, d):
    return quality.grouped(stream(spark, d), _CABIN)


@query
def cabin_oos_rate(spark, d):
    return quality.cabin_oos_rate(quality.grouped(star(spark, d), ["cabin_id"]))


@query
def batch_quality(spark, d):
    return quality.batch_quality(stream(spark, d), _BATCH)


@query
def booth_quality_daily(spark, d):
    return quality.grouped_distinct(star(spark, d), ["production_date", "booth_id", "booth_name"])


@query
def booth_days_with_oos(spark, d):
    days = quality.grouped(star(spark, d), ["production_date", "booth_name"])
    return days.where("oos_count > 0").select("booth_name", "production_date", "measurement_count", "oos_count", "oos_rate")


@query
def shift_quality_daily(spark, d):
    return quality.grouped_distinct(stream(spark, d), ["production_date", "shift_id", "shift_name"])


@query
def point_quality(spark, d):
    return quality.grouped(star(spark, d), ["point_code", "component"])


@query
def descriptive_overall(spark, d):
    return quality.distribution(star(spark, d))


@query
def descriptive_booth_point(spark, d):
    return quality.distribution(star(spark, d), "booth_name", "point_code")


@query
def descriptive_shape(spark, d):
    return quality.shape(stream(spark, d), "booth_name", "point_code")


@query
def value_histogram(spark, d):
    return quality.histogram(stream(spark, d), 0, 200, 35)


@query
def within_cabin_variation(spark, d):
    e = star(spark, d)
    return quality.within_variation(e, quality.grouped(e, ["cabin_id"]))


@query
def mart_quality_metrics(spark, d):
    return quality.mart(star(spark, d))


@query
def quality_kpis(spark, d):
    return quality.kpis(star(spark, d))


@query
def daily_trend(spark, d):
    return quality.daily_trend(star(spark, d))


@query
def booth_comparison(spark, d):
    return quality.booth_comparison(star(spark, d))


@query
def monthly_quality(spark, d):
    return quality.monthly(star(spark, d))


@query
def latest_detail(spark, d):
    return quality.latest(stream(spark, d)).select("measurement_id", "production_timestamp", "booth_name", "point_code", "shift_name", "measured_value", "compliance_status")


@query
def quality_filtered(spark, d):
    e = quality.filtered(stream(spark, d), booths=["BOOTH_01"], shifts=["SHIFT_01", "SHIFT_03"], first="2024-01-05", last="2024-01-20")
    return quality.daily_trend(e)


@query
def robot_attribution(spark, d):
    return quality.robot_attribution(stream(spark, d), bridge(spark, d), bind.robots(spark, d))


@query
def bridge_cardinality(spark, d):
    return quality.bridge_cardinality(bridge(spark, d))


@query
def robot_array_filter(spark, d):
    named = quality.linked_names(stream(spark, d).select("measurement_id", "measured_value"), bridge(spark, d), bind.robots(spark, d))
    hit = quality.any_robot(named, ["Supplier#000000002", "Supplier#000000005"])
    return hit.select("measurement_id", F.concat_ws(",", "robot_names").alias("robot_names"))


@query
def event_context(spark, d):
    return context(spark, d)


@query
def event_type_summary(spark, d):
    return quality.event_type_summary(context(spark, d))


@query
def event_periods(spark, d):
    return quality.event_periods(context(spark, d))


@query
def before_during_after(spark, d):
    return quality.around_periods(quality.event_periods(context(spark, d)), quality.batch_quality(stream(spark, d), _BATCH))


# ---------------------------------------------------------------- baselines and rules


@query
def shift_instance(spark, d):
    return stream(spark, d).groupBy("shift_id", "shift_name", "shift_instance").agg(F.count(F.lit(1)).alias("measurement_count"), F.min("batch_start").alias("first_batch"), F.max("batch_start").alias("last_batch"))


@query
def moving_range(spark, d):
    return baseline.moving_ranges(stream(spark, d)).select("measurement_id", "shift_instance", "measured_value", "moving_range")


@query
def baseline_fit(spark, d):
    e = stream(spark, d)
    return baseline.fit(baseline.in_window(e, baseline.baseline_window(e, 18)))


@query
def baseline_fit_checks(spark, d):
    return baseline.fit_violations(stream(spark, d))


@query
def baseline_fingerprint(spark, d):
    e = stream(spark, d)
    return baseline.fingerprint(baseline.in_window(e, baseline.baseline_window(e, 9)))


@query
def baseline_table(spark, d):
    return baselines(spark, d).select("baseline_id", *baseline.SCOPE, "version", "status", "n_observations", "n_valid_mr", *[F.col(c).cast("double").alias(c) for c in baseline.LIMITS])


@query
def baseline_asof(spark, d):
    return baseline.effective(stream(spark, d), baselines(spark, d), ZONE).select("measurement_id", "baseline_id")


@query
def baseline_asof_by_row(spark, d):
    return baseline.effective_by_row(stream(spark, d), baselines(spark, d), ZONE).select("measurement_id", "baseline_id")


@query
def baseline_segments(spark, d):
    return rules.segments(baseline.effective(stream(spark, d), baselines(spark, d), ZONE)).select("measurement_id", "baseline_id", F.col("baseline_segment").cast("long").alias("baseline_segment"))


@query
def spc_rules(spark, d):
    return rules.result_columns(results(spark, d)).withColumns({c: F.col(c).cast("double") for c in baseline.LIMITS})


@query
def spc_rules_scoped(spark, d):
    r = rules.spc_results(stream(spark, d), baselines(spark, d), ZONE, "BOOTH_01", "view")
    return rules.short_names(rules.result_columns(r)).select("measurement_id", "booth", "measurement_point", F.col("lcl").cast("double").alias("lcl"), F.col("ucl").cast("double").alias("ucl"), "rule_1", "rule_2", "rule_3", "rule_4", "spc_signal")


@query
def mart_spc_metrics(spark, d):
    staged = enrich.staging(stream(spark, d))
    return enrich.mart_spc(staged, rules.spc_results(stream(spark, d), baselines(spark, d), ZONE, "BOOTH_01", "view"), "BOOTH_01", "view", "Event Value", "u")


@query
def spc_overall(spark, d):
    return summaries.overall(results(spark, d))


@query
def spc_monthly(spark, d):
    return summaries.by_month(results(spark, d))


@query
def spc_shift_instance(spark, d):
    return summaries.by_instance(results(spark, d))


@query
def spc_rules_long(spark, d):
    return summaries.rules_long(results(spark, d))


@query
def oos_signal_contingency(spark, d):
    return summaries.contingency(results(spark, d))


@query
def signal_coverage(spark, d):
    return summaries.coverage(results(spark, d))


@query
def spc_overview(spark, d):
    return summaries.spc_overview(results(spark, d))


@query
def rule_counts(spark, d):
    return summaries.rule_counts(results(spark, d))


@query
def mr_violations(spark, d):
    return summaries.mr_own_limits(results(spark, d), "booth_name", "point_code")


@query
def mr_stored_limits(spark, d):
    return summaries.mr_stored_limits(results(spark, d))


@query
def signal_details(spark, d):
    return frames.signal_details(results(spark, d)).select("measurement_id", "booth_name", "point_code", "shift_name", "measured_value", "moving_range", "triggered_rules")


@query
def mr_violation_details(spark, d):
    return frames.mr_violations(results(spark, d)).select("measurement_id", "moving_range", F.col("mr_ucl").cast("double").alias("mr_ucl"))


@query
def provenance(spark, d):
    return frames.provenance(results(spark, d)).select("booth_name", "point_code", "baseline_id", "covered_measurements", "first_measurement", "last_measurement")


@query
def individuals_chart(spark, d):
    shown = frames.positions(results(spark, d))
    shown = frames.filtered(shown, shifts=["SHIFT_01", "SHIFT_03"], first="2024-01-08")
    return frames.with_breaks(frames.masked(shown).select("booth_name", "point_code", "position", "measurement_id", "baseline_id", F.col("center_line").cast("double").alias("center_line"))).withColumn("position", F.col("position").cast("long"))


@query
def frame_sanity(spark, d):
    return frames.sanity(results(spark, d))


@query
def specification_list(spark, d):
    return frames.specifications(stream(spark, d))


# ---------------------------------------------------------------- capability and drift


@query
def capability_streams(spark, d):
    return capability.capability(results(spark, d), "booth_name", "point_code")


@query
def capability_groups(spark, d):
    return capability.groups(results(spark, d), "shift_name")


@query
def plotting_positions(spark, d):
    return capability.plotting_positions(stream(spark, d), "booth_name", "point_code")


@query
def drift_monthly(spark, d):
    return drift.by_month(results(spark, d))


@query
def drift_shift_instance(spark, d):
    return drift.by_instance(results(spark, d))


@query
def drift_shift_type(spark, d):
    return drift.by_type(results(spark, d))


@query
def ss_sufficient_stats(spark, d):
    return drift.sufficient(stream(spark, d))


@query
def variation_decomposition(spark, d):
    return drift.decomposition(stream(spark, d))


@query
def subgroup_sizes(spark, d):
    return drift.subgroup_sizes(stream(spark, d))


@query
def rolling_means(spark, d):
    return drift.rolling(drift.instance_means(stream(spark, d)))


@query
def half_comparison(spark, d):
    return drift.halves(drift.instance_means(stream(spark, d)))


@query
def trend(spark, d):
    keep = ["booth_name", "point_code", "observation_count", "time_origin", "duration_days", "slope_per_day", "slope_standard_error", "slope_ci_95_low", "slope_ci_95_high", "estimated_cumulative_fitted_change"]
    return drift.trend(drift.instance_means(stream(spark, d))).select(*keep)


@query
def leave_one_out(spark, d):
    return drift.trend(drift.instance_means(stream(spark, d))).select("booth_name", "point_code", "loo_slope_min", "loo_slope_max", "max_loo_slope_change", "slope_direction_stable")


@query
def trend_fitted(spark, d):
    return drift.fitted(drift.instance_means(stream(spark, d)))


@query
def drift_evidence(spark, d):
    r = results(spark, d)
    return drift.evidence(r, capability.capability(r, "booth_name", "point_code"))


# ---------------------------------------------------------------- checks, comparison, lifecycle


def _changed_orders(spark, d) -> tuple[DataFrame, DataFrame]:
    """orders, and orders with some rows gone, some new and some changed."""
    a = bind.read(spark, d, "orders")
    k = F.col("o_orderkey")
    b = a.where(k % 97 != 3).withColumns({"o_totalprice": F.when(k % 101 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(k % 103 == 7, F.lit(None)).otherwise(F.col("o_orderstatus"))})
    return a, b.unionByName(a.where(k % 89 == 2).withColumn("o_orderkey", -k - 1))


@query
def table_compare(spark, d):
    a, b = _changed_orders(spark, d)
    return compare.report(compare.differences(a, b, ["o_orderkey"]))


@query
def compare_samples(spark, d):
    a, b = _changed_orders(spark, d)
    return compare.samples(compare.differences(a, b, ["o_orderkey"]), ["o_orderkey"], 20)


@query
def compare_key_checks(spark, d):
    return compare.key_violations(bind.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def integrity_anti(spark, d):
    small = bind.read(spark, d, "customer").where("c_custkey % 50 <> 1")
    lost = checks.orphans(bind.read(spark, d, "orders"), small, "o_custkey", "c_custkey")
    return lost.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orphans"))


@query
def integrity_both_ways(spark, d):
    a = bind.read(spark, d, "orders").where("o_custkey % 11 <> 2").select(F.col("o_custkey").alias("k"))
    return checks.both_ways(a, bind.read(spark, d, "customer").where("c_custkey % 13 <> 5").select(F.col("c_custkey").alias("k")), "k")


@query
def integrity_full_join(spark, d):
    e = star(spark, d)
    a = e.groupBy("booth_name").agg(F.count(F.lit(1)).alias("n"))
    b = e.where("not is_oos or booth_name <> 'ASIA'").groupBy("booth_name").agg(F.count(F.lit(1)).alias("n"))
    return checks.reconcile(a, b, ["booth_name"], ["n"])


@query
def integrity_counts_union(spark, d):
    return checks.row_counts({n: bind.read(spark, d, n) for n in ("region", "nation", "customer", "orders", "lineitem", "part", "supplier", "events")})


@query
def integrity_group_sizes(spark, d):
    return checks.group_size(bind.read(spark, d, "lineitem"), ["l_orderkey"], 1, 6)


@query
def integrity_duplicates(spark, d):
    return checks.duplicates(bind.read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query
def integrity_generic(spark, d):
    o = bind.read(spark, d, "orders")
    return checks.not_null(o, "o_orderkey", "o_custkey", "o_orderstatus").unionByName(checks.accepted(o, "o_orderstatus", ["F", "O"]))


@query
def aggregate_totals(spark, d):
    e = star(spark, d)
    return checks.totals({"cabin": quality.grouped(e, ["cabin_id"]), "day": quality.grouped(e, ["production_date"]), "point": quality.grouped(e, ["point_code"])}, e)


@query
def spc_result_checks(spark, d):
    return checks.rule_checks(results(spark, d))


def _broken_baselines(spark, d) -> DataFrame:
    b = baselines(spark, d).withColumns({"approved_by": F.lit("quality"), "approved_at": F.col("effective_from"), "supersedes_baseline_id": F.when(F.col("version") == 2, F.col("baseline_id") - 1), "source_query_hash": F.lit("x")})
    b = b.withColumns({"window_start": instant("window_start", ZONE), "window_end": instant("window_end", ZONE)})
    p = F.col("measurement_point_id")
    first, second = F.col("version") == 1, F.col("version") == 2
    return b.withColumns(
        {
            "effective_to": F.when(first & (F.col("booth_id") == 1), F.col("effective_from")).otherwise(F.col("effective_to")),
            "approved_by": F.when(second & (F.col("booth_id") == 2), F.lit("  ")).otherwise(F.col("approved_by")),
            "i_ucl": F.when(second & (p % 2 == 0), (F.col("i_ucl") + F.lit("0.000004").cast("decimal(14,6)")).cast("decimal(14,6)")).otherwise(F.col("i_ucl")),
            "supersedes_baseline_id": F.when(first & (p % 2 == 1), F.col("baseline_id") + 1).when(second & (F.col("booth_id") == 1), F.col("baseline_id")).otherwise(F.col("supersedes_baseline_id")),
        }
    )


@query
def baseline_constraint_violations(spark, d):
    return lifecycle.constraint_violations(_broken_baselines(spark, d))


@query
def supersession_violations(spark, d):
    return lifecycle.supersession_violations(_broken_baselines(spark, d))


@query
def transition_violations(spark, d):
    old = _broken_baselines(spark, d)
    new = old.where("not (version = 1 and booth_id = 2)").withColumns({"status": F.when(F.col("version") == 2, "DRAFT").otherwise(F.col("status")), "n_observations": F.when(F.col("booth_id") == 1, F.col("n_observations") + 1).otherwise(F.col("n_observations"))})
    return lifecycle.transition_violations(old, new)


# ---------------------------------------------------------------- input contracts, reports, validators


def scoped_results(spark, d) -> DataFrame:
    return rules.spc_results(stream(spark, d), baselines(spark, d), ZONE, "BOOTH_01", "view")


def _capability_input(spark, d) -> DataFrame:
    return enrich.capability_input(stream(spark, d), scoped_results(spark, d), "BOOTH_01", "view", "Event Value", "u", (1, 50, 150))


@query
def capability_inputs(spark, d):
    return _capability_input(spark, d)


@query
def drift_inputs(spark, d):
    return enrich.drift_input(_capability_input(spark, d)).orderBy("shift_instance", "measurement_timestamp", "measurement_id")


@query
def variation_by_batch(spark, d):
    b = quality.batch_quality(stream(spark, d), _BATCH)
    return b.select("production_date", "shift_name", "booth_name", "batch_id", "mean_thickness", "stddev_thickness").orderBy("production_date", "shift_name", "booth_name", "batch_id")


@query
def variation_by_shift(spark, d):
    s = quality.grouped_distinct(stream(spark, d), ["production_date", "shift_id", "shift_name"])
    return s.select("production_date", "shift_name", "mean_thickness", "stddev_thickness", "oos_rate").orderBy("production_date", "shift_name")


@query
def variation_by_point(spark, d):
    p = quality.grouped(stream(spark, d), ["point_code", "component"])
    return p.select("point_code", "component", "mean_thickness", "stddev_thickness", "oos_rate").orderBy("point_code")


@query
def volume_report(spark, d):
    v = quality.production_volume(stream(spark, d), ["production_date", "shift_id", "shift_name", "booth_id", "booth_name"])
    return v.select("production_date", "shift_name", "booth_name", "batch_count", "cabin_count", "measurement_count").orderBy("production_date", "shift_name", "booth_name")


@query
def rules_report(spark, d):
    long = summaries.in_report_order(summaries.rules_long(results(spark, d)))
    return long.select("summary_scope", "production_month", "shift_instance", "rule_name", "rule_signal_measurements")


@query
def moving_range_chart(spark, d):
    shown = frames.filtered(frames.positions(results(spark, d)), shifts=["SHIFT_02"], first="2024-01-05", last="2024-01-25")
    shown = frames.masked(shown).select("booth_name", "point_code", "position", "measurement_id", "baseline_id", "moving_range", F.col("mr_center").cast("double").alias("mr_center"), F.col("mr_ucl").cast("double").alias("mr_ucl"), "mr_lcl")
    return frames.with_breaks(shown).withColumn("position", F.col("position").cast("long"))


def _stored_baselines(spark, d) -> DataFrame:
    return baselines(spark, d).withColumn("approved_by", F.when(F.col("status") != "DRAFT", "quality"))


@query
def monitoring_detail(spark, d):
    e = stream(spark, d)
    links = bridge(spark, d).join(bind.robots(spark, d).select("robot_id", "robot_name"), "robot_id").where("robot_id <> 3").select("measurement_id", "robot_name")
    b = _stored_baselines(spark, d).where("not (status = 'ACTIVE' and booth_id = 2)")
    out = frames.monitoring_detail(results(spark, d), e, frames.specifications(e), b, links)
    return out.withColumn("robot_names", F.concat_ws(",", "robot_names"))


@query
def active_baseline_json(spark, d):
    b = _stored_baselines(spark, d)
    return files.json_rows(b.where("status = 'ACTIVE'").select("baseline_id", "booth_id", "measurement_point_id", "version", "status", "approved_by", "n_observations", "effective_to"))


@query
def unassigned_baselines(spark, d):
    early = results(spark, d).where("measurement_timestamp < timestamp_ntz'2024-01-12 00:00:00' or booth_name = 'BOOTH_02'")
    return frames.unassigned(baselines(spark, d), early).select("baseline_id", "booth_id", "measurement_point_id")


@query
def ambiguous_specifications(spark, d):
    e = stream(spark, d).withColumn("unit", F.when(F.col("booth_id") == 2, "mm").otherwise(F.col("unit")))
    return frames.ambiguous_specifications(e)


@query
def bootstrap_checks(spark, d):
    e = stream(spark, d)
    return checks.bootstrap_checks(e, e, baselines(spark, d), results(spark, d))


@query
def bootstrap_violations(spark, d):
    """The same checks on a build that has been spoilt."""
    e, k = stream(spark, d), F.col("measurement_id")
    r = results(spark, d).where(k % 101 != 7).withColumns({"i_ucl": F.when(k % 89 == 3, F.col("i_ucl") + 1).otherwise(F.col("i_ucl")), "spc_signal": F.when(k % 83 == 5, F.lit(None)).otherwise(F.col("spc_signal"))})
    b = baselines(spark, d).where("not (booth_id = 1 and status = 'ACTIVE')")
    return checks.bootstrap_checks(e, e.where(k % 97 != 1), b, r.unionByName(r.where(k % 79 == 2)))


@query
def capability_reconciliation(spark, d):
    source = scoped_results(spark, d).select("measurement_id", "is_oos", "spc_signal", "baseline_id", "spc_evaluation_status")
    return checks.input_reconciliation(source, _capability_input(spark, d))


@query
def drift_reconciliation(spark, d):
    return checks.drift_reconciliation(enrich.drift_input(_capability_input(spark, d)))


@query
def drift_reconciliation_violations(spark, d):
    """The same checks on inputs that have been spoilt."""
    k = F.col("measurement_id")
    x = enrich.drift_input(_capability_input(spark, d)).withColumns({"shift_name": F.when(k % 53 == 1, "SHIFT_03").otherwise(F.col("shift_name")), "spc_signal": F.when(k % 47 == 2, F.lit(None)).otherwise(F.col("spc_signal"))})
    return checks.drift_reconciliation(x.unionByName(x.where(k % 43 == 3)), (1, 40))


@query
def drift_input_checks(spark, d):
    """Text input, parsed with what does not parse as NULL, and its violations."""
    k = F.col("measurement_id")
    e = stream(spark, d).withColumn("production_month", F.trunc("production_date", "MM"))
    text = {c: F.col(c).cast("string") for c in ("measurement_timestamp", "production_month", "shift_instance", "measured_value", "target")}
    raw = e.withColumns(text).withColumns({"measured_value": F.when(k % 31 == 4, "n/a").when(k % 37 == 5, "inf").otherwise(F.col("measured_value")), "measurement_timestamp": F.when(k % 41 == 6, "yesterday").otherwise(F.col("measurement_timestamp")), "target": F.when(k % 29 == 7, "").otherwise(F.col("target")), "shift_name": F.when(k % 23 == 8, F.lit(None)).otherwise(F.col("shift_name"))})
    return drift.input_violations(drift.coerced(raw.unionByName(raw.where(k % 19 == 9))))


@query
def enrichment_checks(spark, d):
    """Lines without an enriched row and the other way round, by booth, on a star that lacks some parts."""
    t = bind.star_tables(spark, d)
    e = enrich.enrich_star({**t, "point": t["point"].where("part_id % 17 <> 3")})
    lost = checks.orphans(t["fact"], e.select("part_id").distinct(), "part_id", "part_id")
    return checks.union([checks.counted("line_not_enriched", lost), checks.counted("part_without_line", checks.orphans(t["point"], t["fact"], "part_id", "part_id"))])


@query
def scalar_subquery_mismatches(spark, d):
    """Lines whose status is not that of their order, as a correlated subquery finds it."""
    lines = bind.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("status"))
    orders = bind.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return checks.scalar_mismatches(lines, orders, "k", "status", "status").groupBy("status").agg(F.count(F.lit(1)).alias("mismatches"))


@query
def expected_rows(spark, d):
    """Groups with subtotals, whose keys are NULL, against those of lines that lack a segment."""
    e = star(spark, d)
    n = lambda x: x.rollup("booth_name", "shift_name").agg(F.count(F.lit(1)).alias("n"))
    return checks.expected_rows(n(e), n(e.where("shift_name <> 'BUILDING' or booth_name <> 'ASIA'")), ["booth_name", "shift_name"], ["n"])


@query
def one_to_one_merge(spark, d):
    m = drift.sufficient(stream(spark, d))
    keys = ["booth_name", "point_code", "shift_instance"]
    times = stream(spark, d).groupBy(*keys).agg(F.min("measurement_timestamp").alias("first_measurement"), F.max("measurement_timestamp").alias("last_measurement"))
    return checks.one_to_one(m.select(*keys, "measurement_count", "mean"), times, keys)


@query
def stream_compare(spark, d):
    a, b = _changed_orders(spark, d)
    return compare.checked_report(a, b, ["o_orderkey"])


@query
def stream_compare_incomplete(spark, d):
    """A key that repeats makes the comparison incomplete, and it fails."""
    a = bind.read(spark, d, "orders")
    return compare.checked_report(a.unionByName(a.where("o_orderkey % 1000 = 1")), a, ["o_orderkey"]).select("error", "complete", "verdict")


@query
def catalog_compare(spark, d):
    a, b = _changed_orders(spark, d)
    a.createOrReplaceTempView("millrace_orders_source")
    b.withColumnRenamed("o_totalprice", "price").createOrReplaceTempView("millrace_orders_target")
    return compare.compare_tables(spark, "millrace_orders_source", "millrace_orders_target", ["o_orderkey"], rename={"price": "o_totalprice"})


# ---------------------------------------------------------------- sources, sinks and the synthetic plant


@query
def csv_round_trip(spark, d):
    """customer written as CSV and read with its fixed schema."""
    path = store.new_path(spark, "csv")
    bind.read(spark, d, "customer").write.option("header", True).csv(path)
    return files.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query
def csv_extract(spark, d):
    """An extract with t and f for booleans, read typed; a time that is none is NULL."""
    path, k = store.new_path(spark, "extract"), F.col("o_orderkey")
    o = bind.read(spark, d, "orders")
    flag = F.when(k % 7 == 3, F.lit(None)).when(F.col("o_totalprice") > 100_000, "t").otherwise("f")
    o.select("o_orderkey", flag.alias("large"), F.when(k % 11 == 4, "soon").otherwise(F.col("o_orderdate").cast("string")).alias("o_orderdate"), F.col("o_totalprice").cast("string").alias("o_totalprice")).write.option("header", True).csv(path)
    return files.read_extract(spark, path, "o_orderkey bigint, large boolean, o_orderdate timestamp_ntz, o_totalprice double")


@query
def integer_series(spark, d):
    return files.series(spark, 1, 500)


@query
def load_reconciliation(spark, d):
    """The small dimensions of the plant written as CSV, loaded and counted."""
    names = ("dim_booth", "dim_track_axis", "dim_robot", "dim_shift", "dim_measurement_point", "dim_specification")
    dims, folder = generate.dimensions(spark), store.new_path(spark, "plant")
    for n in names:
        dims[n].coalesce(1).write.option("header", True).csv(f"{folder}/{n}.csv")
    return files.load(spark, folder, f"{folder}/loaded", names)


@query
def next_ids(spark, d):
    return checks.union([bind.read(spark, d, n).agg(F.lit(n).alias("table_name"), (F.coalesce(F.max(k), F.lit(0)) + 1).cast("long").alias("next_id")) for n, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("events", "event_id"))])


@query
def plant_points(spark, d):
    return generate.dimensions(spark)["dim_measurement_point"].select("measurement_point_id", "point_code", "component", "side", "point_number")


@query
def plant_robots(spark, d):
    """Robots with their axis and booth, whose ids were looked up by name."""
    t = generate.dimensions(spark)
    return t["dim_robot"].join(t["dim_track_axis"], "track_axis_id").join(t["dim_booth"], "booth_id").select("robot_id", "robot_name", "track_axis_id", "track_name", "booth_id", "booth_name")


@query
def plant_calendar(spark, d):
    return generate.calendar(spark, generate.Period())


@query
def plant_batches(spark, d):
    return generate.batches(spark, generate.Period(), generate.dimensions(spark)["dim_shift"])


@query
def plant_cabins(spark, d):
    """Each cabin, and whether it lies within half a minute of its even place in the batch."""
    p = generate.Period()
    b = generate.batches(spark, p, generate.dimensions(spark)["dim_shift"])
    c = generate.cabins(b, p).join(b.select("batch_id", "batch_start", "batch_end"), "batch_id")
    seconds = lambda t: F.unix_timestamp(F.col(t).cast("timestamp"))
    place = seconds("batch_start") + ((F.col("cabin_id") - 1) % generate.CABINS_PER_BATCH + 0.5) * (seconds("batch_end") - seconds("batch_start")) / generate.CABINS_PER_BATCH
    return c.select("cabin_id", "batch_id", "booth_id", (F.abs(seconds("production_timestamp") - place) <= 31).alias("in_place"))


@query
def plant_events(spark, d):
    b = generate.batches(spark, generate.Period(), generate.dimensions(spark)["dim_shift"])
    return generate.events(spark, b).select("event_id", "event_timestamp", "batch_id", "booth_id", "event_type", "severity")


@query
def plant_reference_counts(spark, d):
    """Dimensions whose size is not the contract's; the plant of 19 points is the one that is wrong."""
    t = generate.dimensions(spark)
    more = t["dim_measurement_point"].unionByName(t["dim_measurement_point"].limit(1))
    return checks.reference_counts({**t, "dim_measurement_point": more}, {"dim_booth": 2, "dim_track_axis": 4, "dim_robot": 8, "dim_shift": 3, "dim_measurement_point": 18, "dim_specification": 1})


def _plant(spark) -> dict[str, DataFrame]:
    made = generate.generate(spark, generate.Period(first="2026-01-16", last="2026-02-04"))
    return {name: store.stored(spark, f"plant-{name}", [], lambda df=df: df) for name, df in made.items()}


@query
def plant_checks(spark, d):
    """The invariants of a generated plant of 17 production days."""
    return checks.production_checks(_plant(spark))


@query
def plant_measurement_grid(spark, d):
    """What of the measurements does not depend on draws: rows and points by booth and day, contributors within bounds."""
    t = _plant(spark)
    m = t["fact_quality_measurement"].join(t["dim_cabin"], "cabin_id")
    robots_ = t["bridge_measurement_robot"].groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n"))
    b = t["dim_batch"].select("batch_id", F.col("batch_start").cast("date").alias("day"))
    return m.join(robots_, "measurement_id").join(b, "batch_id").groupBy("day", "booth_id").agg(F.count(F.lit(1)).alias("measurements"), F.countDistinct("cabin_id").alias("cabins"), F.countDistinct("measurement_point_id").alias("points"), (F.min("n") >= 1).alias("some"), (F.max("n") <= 4).alias("at_most_four"), (F.min("measured_value") >= 0).alias("not_negative"))


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: rule results of every stream."""
    return QUERIES["spc_rules"](spark, "/root/testdata/sf0.001")
