"""Control charts, baselines, capability, drift: hand-made sequences with known results."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import formulas
from millrace.operators import baseline, capability, checks, compare, drift, enrich, frames, lifecycle, quality, rules, summaries

T0 = dt.datetime(2026, 3, 2, 6)
LIMITS = {"center_line": "0", "sigma": "1", "i_lcl": "-3", "i_ucl": "3", "mr_center": "1.128", "mr_ucl": "3.685176"}


def measurements(spark, rows):
    """rows: (stream, instance number, minutes, id, value)."""
    data = [(1, s, 1, 1, T0 + dt.timedelta(days=i), T0 + dt.timedelta(days=i, minutes=m), n, Decimal(str(v)), f"S{s}", "B1", "SHIFT_01") for s, i, m, n, v in rows]
    return spark.createDataFrame(data, "booth_id int, measurement_point_id int, specification_id int, shift_id int, shift_instance timestamp_ntz, measurement_timestamp timestamp_ntz, measurement_id long, measured_value decimal(10,3), point_code string, booth_name string, shift_name string").repartition(3)


def covered(df, baseline_id=1):
    return df.withColumns({"baseline_id": F.lit(baseline_id).cast("long")} | {c: F.lit(v).cast("decimal(14,6)") for c, v in LIMITS.items()})


#: name -> values, expected ids by rule (ids count from 1)
GOLDEN = {
    "rule 1 at the limit": ([3.000, 3.001], {1: [2]}),
    "rule 1 below": ([-3.000, -3.001], {1: [2]}),
    "rule 2 same side": ([2.1, 2.2, 0], {2: [3]}),
    "rule 2 mixed sides": ([2.1, -2.1, 0], {}),
    "rule 2 at the zone": ([2.0, 2.2, 0], {}),
    "rule 3 same side": ([2.1, 1.1, 1.2, 0, 1.5], {3: [5]}),
    "rule 3 mixed sides": ([1.1, -1.1, 1.2, -1.2, 0], {}),
    "rule 3 at the zone": ([1.0, 1.1, 1.1, 1.1, 0], {}),
    "rule 4": ([0.5] * 9, {4: [8, 9]}),
    "rule 4 on the centre": ([0.5] * 7 + [0, 0.5], {}),
}


def test_run_rules_golden(spark):
    rows, n = [], 0
    for s, (values, _) in enumerate(GOLDEN.values(), 1):
        rows += [(s, 0, m, s * 100 + m + 1, v) for m, v in enumerate(values)]
    got = {r["measurement_id"]: r for r in rules.apply_rules(covered(measurements(spark, rows))).collect()}
    for s, (name, (values, hits)) in enumerate(GOLDEN.items(), 1):
        for k in range(1, 5):
            found = [m + 1 for m in range(len(values)) if got[s * 100 + m + 1][f"rule_{k}"]]
            assert found == hits.get(k, []), (name, k)


def test_rules_restart_with_each_shift(spark):
    rows = [(1, m // 4, m % 4, m + 1, 0.5) for m in range(12)] + [(2, i, m, 100 + 2 * i + m, v) for i, (a, b) in enumerate([(0, 0.1), (2, 2.1)]) for m, v in enumerate((a, b))]
    got = {r["measurement_id"]: r for r in rules.apply_rules(covered(measurements(spark, rows))).collect()}
    assert not any(r["rule_4"] for r in got.values())
    assert [got[i]["moving_range"] for i in (100, 101, 102, 103)] == [None, Decimal("0.100"), None, Decimal("0.100")]


def test_ties_are_ordered_by_id(spark):
    rows = [(1, 0, 0, i, v) for i, v in ((703, 2.5), (700, 2.5), (702, 2.5), (701, 0))]
    got = {r["measurement_id"]: r for r in rules.apply_rules(covered(measurements(spark, rows))).collect()}
    assert [i for i in sorted(got) if got[i]["rule_2"]] == [702, 703]
    assert [got[i]["moving_range"] for i in sorted(got)] == [None, Decimal("2.500"), Decimal("2.500"), Decimal("0.000")]


def table(spark, rows):
    """rows: (id, point, version, status, from hour, to hour) around T0, in UTC."""
    at = lambda h: None if h is None else T0 + dt.timedelta(hours=h - 1)  # noqa: E731  the plant is an hour ahead
    data = [(i, 1, p, 1, v, s, at(a), at(b), *(Decimal(x) for x in LIMITS.values())) for i, p, v, s, a, b in rows]
    return spark.createDataFrame(data, "baseline_id long, booth_id int, measurement_point_id int, specification_id int, version int, status string, effective_from timestamp, effective_to timestamp, " + ", ".join(f"{c} decimal(14,6)" for c in LIMITS))


BASELINES = [(1, 1, 1, "RETIRED", 0, 4), (2, 1, 2, "ACTIVE", 3, 5), (3, 1, 3, "DRAFT", 0, None), (4, 2, 1, "RETIRED", 0, 8), (5, 2, 2, "ACTIVE", 2, 3)]


def test_effective_baseline_both_forms(spark):
    rows = [(1, 0, 60 * h, 10 + h, 0.4) for h in range(7)] + [(2, 0, 30 * k, 100 + k, 0.4) for k in range(16)]
    df, b = measurements(spark, rows), table(spark, BASELINES)
    a = {r["measurement_id"]: r["baseline_id"] for r in baseline.effective_by_row(df, b, "Europe/Budapest").collect()}
    assert a == {r["measurement_id"]: r["baseline_id"] for r in baseline.effective(df, b, "Europe/Budapest").collect()}
    assert [a[10 + h] for h in range(7)] == [1, 1, 1, 2, 2, None, None]
    assert [a[100 + k] for k in range(16)] == [4] * 4 + [5] * 2 + [4] * 10


def test_returning_baseline_starts_a_new_segment(spark):
    rows = [(2, 0, 30 * k, 100 + k, 0.4) for k in range(17)]
    got = sorted(rules.spc_results(measurements(spark, rows), table(spark, BASELINES), "Europe/Budapest").collect(), key=lambda r: r["measurement_id"])
    assert [r["baseline_segment"] for r in got] == [1] * 4 + [2] * 2 + [3] * 10 + [4]
    assert [r["rule_4"] for r in got] == [False] * 13 + [True] * 3 + [False]
    assert got[16]["spc_signal"] is None and got[16]["spc_evaluation_status"] == "NOT_EVALUATED"
    assert got[4]["moving_range"] is None and got[6]["moving_range"] is None


@pytest.mark.parametrize(
    "values, expect",
    [
        ([(0, 1), (0, 2), (0, 4), (0, 7)], {"n_observations": 4, "n_valid_mr": 3, "center_line": 3.5, "sigma": 2 / 1.128, "mr_ucl": 6.534}),
        ([(0, 1), (0, 3), (1, 100), (1, 104)], {"n_valid_mr": 2, "center_line": 52.0, "mr_center": 3.0}),
        ([(0, 10), (1, 100), (2, 30), (0, 13), (1, 106), (2, 32), (1, 110)], {"n_valid_mr": 4, "mr_center": 3.75}),
        ([(0, 5), (0, 5), (0, 5)], {"sigma": 0.0, "i_lcl": 5.0, "i_ucl": 5.0, "mr_ucl": 0.0}),
    ],
)
def test_fit(spark, values, expect):
    got = baseline.fit(measurements(spark, [(1, i, m, m + 1, v) for m, (i, v) in enumerate(values)])).first()
    for k, v in expect.items():
        assert got[k] == pytest.approx(v)


def test_fit_violations(spark):
    good = measurements(spark, [(1, 0, m, m + 1, m) for m in range(4)])
    assert all(r["violations"] == 0 for r in baseline.fit_violations(good).collect())
    bad = good.unionByName(good.limit(1)).unionByName(measurements(spark, [(2, 0, 0, 50, 1)]))
    got = {r["check"]: r["violations"] for r in baseline.fit_violations(bad).collect()}
    assert got["duplicate_measurement_id"] == 1 and got["too_few_observations"] == 1 and got["no_moving_range"] == 1


def test_fingerprint_ignores_order(spark):
    rows = [(1, 0, m, m + 1, m) for m in range(5)]
    a, b = (baseline.fingerprint(measurements(spark, r)).first()["source_query_hash"] for r in (rows, rows[::-1]))
    assert a == b != baseline.fingerprint(measurements(spark, rows[:4])).first()["source_query_hash"]


def test_limits_round_half_up(spark):
    df = spark.createDataFrame([(1.2345675,)], "center_line double").withColumns({c: F.col("center_line") for c in LIMITS if c != "center_line"})
    assert baseline.as_decimals(df).first()["sigma"] == Decimal("1.234568")


def test_summaries_divide_by_what_was_evaluated(spark):
    rows = [(1, 0, m, m + 1, 0) for m in range(4)]
    df = measurements(spark, rows).withColumns({"production_timestamp": F.col("measurement_timestamp"), "is_oos": F.col("measurement_id") == 1, "spc_signal": F.expr("case measurement_id when 1 then true when 2 then false end")} | {f"rule_{k}": F.lit(k == 1) & (F.col("measurement_id") == 1) for k in range(1, 5)})
    r = summaries.overall(df).first()
    assert (r["total_measurements"], r["evaluated_measurements"], r["signal_measurements"], r["signal_rate"], r["rule_1_rate"]) == (4, 2, 1, 0.5, 0.5)
    assert summaries.by_month(df).first()["oos_rate"] == 0.25
    assert tuple(summaries.contingency(df).first()) == (1, 0, 0, 3)
    long = {(r["summary_scope"], r["rule_name"]): r for r in summaries.rules_long(df).collect()}
    assert len(long) == 12 and long["OVERALL", "RULE_1"]["rule_signal_rate"] == 0.5
    none = summaries.overall(df.withColumn("spc_signal", F.lit(None).cast("boolean"))).first()
    assert none["signal_rate"] is None


def test_moving_ranges_against_their_own_limit(spark):
    df = spark.createDataFrame([(v,) for v in (None, 1.0, 1.0, 1.0, 1.0, 10.0)], "moving_range double")
    r = summaries.mr_own_limits(df).first()
    assert (r["violation_count"], r["violation_rate_pct"], r["maximum"], r["valid_count"]) == (1, 20.0, 10.0, 5)


# ---------------------------------------------------------------- capability and drift


def inputs(spark, values, instances=None, signals=None, lsl=0.0, target=5.0, usl=10.0):
    rows = [(i + 1, T0 + dt.timedelta(days=(instances or [0] * len(values))[i]), T0 + dt.timedelta(days=(instances or [0] * len(values))[i], minutes=i), float(v), lsl, target, usl, (signals or [None] * len(values))[i]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "measurement_id long, shift_instance timestamp_ntz, measurement_timestamp timestamp_ntz, measured_value double, lsl double, target double, usl double, spc_signal boolean")
    return df.withColumns({"is_oos": F.expr("measured_value < lsl or measured_value > usl"), "below_lsl": F.expr("measured_value < lsl"), "above_usl": F.expr("measured_value > usl"), "deviation_from_target": F.expr("measured_value - target")})


def test_capability_indices(spark):
    r = capability.capability(inputs(spark, [3, 5, 7, 9], signals=[True, False, None, None])).first()
    assert r["mrbar"] == 2 and [round(r[k], 2) for k in ("cp", "cpk", "pp", "ppk")] == [0.94, 0.75, 0.65, 0.52]
    assert (r["spc_evaluated_count"], r["spc_signal_rate"], r["stability_signal_status"], r["availability_status"]) == (2, 0.5, "SPC_SIGNALS_PRESENT", "AVAILABLE")
    r = capability.capability(inputs(spark, [-0.1, 0, 5, 10, 10.1])).first()
    assert (r["below_lsl_count"], r["above_usl_count"], r["oos_rate"]) == (1, 1, 0.4)


@pytest.mark.parametrize(
    "values, instances, within, overall, availability",
    [
        ([5], None, "NO_VALID_MR_PAIR", "INSUFFICIENT_OBSERVATIONS", "UNAVAILABLE"),
        ([4, 6], [0, 1], "NO_VALID_MR_PAIR", "AVAILABLE", "PARTIALLY_AVAILABLE"),
        ([5, 5, 5], None, "ZERO_SIGMA", "ZERO_SIGMA", "UNAVAILABLE"),
        ([5, 5.0001, 5.0002], None, "NEAR_ZERO_SIGMA", "NEAR_ZERO_SIGMA", "UNAVAILABLE"),
    ],
)
def test_capability_statuses(spark, values, instances, within, overall, availability):
    r = capability.capability(inputs(spark, values, instances)).first()
    assert (r["within_sigma_status"], r["overall_sigma_status"], r["availability_status"]) == (within, overall, availability)


def test_capability_without_valid_specification(spark):
    empty = capability.capability(inputs(spark, [1]).limit(0)).first()
    assert (empty["measurement_count"], empty["interpretation_status"]) == (0, "EXPLORATORY_PHASE_I_NO_MEASUREMENTS")
    r = capability.capability(inputs(spark, [3, 5], lsl=6.0)).first()
    assert r["specification_status"].startswith("INVALID") and r["cp"] is None and r["oos_count"] is None
    r = capability.capability(inputs(spark, [3, 5], lsl=None)).first()
    assert r["specification_status"] == "MISSING_SPECIFICATION_LIMITS"


def means(spark, values):
    return spark.createDataFrame([(T0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "shift_instance timestamp_ntz, mean double")


def test_rolling_and_halves(spark):
    rows = drift.rolling(means(spark, [1, 2, 3, 4]), (2, 3), []).orderBy("shift_instance").collect()
    assert [r["rolling_mean_2"] for r in rows] == [None, 1.5, 2.5, 3.5] and [r["rolling_mean_3"] for r in rows] == [None, None, 2.0, 3.0]
    h = drift.halves(means(spark, [1, 2, 3, 4, 5]), []).first()
    assert (h["first_half_shift_instance_count"], h["second_half_shift_instance_count"], h["second_minus_first_mean"]) == (2, 3, 2.5)


def test_trend_and_leave_one_out(spark):
    t = drift.trend(means(spark, [1, 3, 5, 7, 9, 11]), []).first()
    assert t["slope_per_day"] == pytest.approx(2) and t["estimated_cumulative_fitted_change"] == pytest.approx(10) and t["slope_direction_stable"]
    import numpy as np

    y = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    t = drift.trend(means(spark, y), []).first()
    x = np.arange(7.0) - 3
    y = np.array(y)
    loo = [np.dot(np.delete(x, i), np.delete(y, i) - np.delete(y, i).mean()) / (np.delete(x, i) ** 2).sum() for i in range(7)]
    assert (t["loo_slope_min"], t["loo_slope_max"]) == (pytest.approx(min(loo)), pytest.approx(max(loo)))
    assert drift.trend(means(spark, [1, 2]), []).count() == 0


def test_decomposition(spark):
    r = drift.decomposition(inputs(spark, [0, 2, 10, 12], [0, 0, 1, 1]).withColumns({"shift_id": F.lit(1), "shift_name": F.lit("S")}), []).first()
    assert (r["within_shift_sum_of_squares"], r["between_shift_sum_of_squares"]) == (pytest.approx(4), pytest.approx(100))
    assert r["pooled_within_shift_sd"] == pytest.approx(2**0.5)


def test_skewness_is_adjusted(spark):
    import pandas as pd

    v = [1.0, 2.0, 2.5, 9.0, 11.0]
    df = spark.createDataFrame([(x,) for x in v], "measured_value double")
    assert quality.shape(df).first()["skewness"] == pytest.approx(pd.Series(v).skew())


# ---------------------------------------------------------------- comparison, lifecycle, frames, checks


def test_compare(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "before", 1.0), (4, "s", 2.0)], "id int, value string, n double")
    b = spark.createDataFrame([(1, "x", None), (2, "after", 1.0), (3, "t", 2.0)], "id int, value string, n double")
    found = compare.differences(a, b, ["id"])
    r = compare.report(found).first()
    assert (r["matched"], r["source_only"], r["target_only"], r["different"], r["verdict"]) == (1, 1, 1, 1, "FAIL")
    assert {x["id"]: x["fields"] for x in found.where("state = 'DIFFERENT'").collect()} == {2: "value"}
    assert compare.samples(found, ["id"], 2).count() == 2
    assert compare.report(compare.differences(a, a, ["id"])).first()["verdict"] == "PASS"
    with pytest.raises(compare.SchemaMismatch):
        compare.differences(a, b.withColumn("id", F.col("id").cast("string")), ["id"])
    with pytest.raises(compare.SchemaMismatch):
        compare.differences(a, a, ["nothing"])
    bad = {x["check"]: x["violations"] for x in compare.key_violations(a.unionByName(a).withColumn("id", F.when(F.col("id") == 4, None).otherwise(F.col("id"))), ["id"]).collect()}
    assert (bad["null_key"], bad["duplicate_key"]) == (2, 3)


def versions(spark, **changes):
    row = {"baseline_id": 1, "booth_id": 1, "measurement_point_id": 1, "specification_id": 1, "version": 1, "status": "ACTIVE", "window_start": dt.datetime(2026, 1, 1), "window_end": dt.datetime(2026, 2, 1), "effective_from": dt.datetime(2026, 2, 1), "effective_to": None, "approved_by": "quality", "approved_at": dt.datetime(2026, 2, 1), "n_observations": 10, "n_valid_mr": 9, "center_line": Decimal("75"), "sigma": Decimal("0.177305"), "i_lcl": Decimal("74.468085"), "i_ucl": Decimal("75.531915"), "mr_center": Decimal("0.2"), "mr_ucl": Decimal("0.6534"), "source_query_hash": "h", "supersedes_baseline_id": None}
    rows = changes.pop("rows", [{}])
    data = [tuple((row | changes | r).values()) for r in rows]
    return spark.createDataFrame(data, "baseline_id long, booth_id int, measurement_point_id int, specification_id int, version int, status string, window_start timestamp, window_end timestamp, effective_from timestamp, effective_to timestamp, approved_by string, approved_at timestamp, n_observations int, n_valid_mr int, " + ", ".join(f"{c} decimal(14,6)" for c in ("center_line", "sigma", "i_lcl", "i_ucl", "mr_center", "mr_ucl")) + ", source_query_hash string, supersedes_baseline_id long")


@pytest.mark.parametrize(
    "changes, check",
    [
        ({}, None), ({"mr_ucl": Decimal("0.653402")}, None), ({"n_valid_mr": 8}, None), ({"i_lcl": Decimal("74.468087")}, None),
        ({"i_lcl": Decimal("74.468089")}, "i_chart_limits"), ({"mr_ucl": Decimal("0.653404")}, "mr_limits"), ({"version": 0}, "version"), ({"status": "PENDING"}, "status"),
        ({"window_end": dt.datetime(2026, 1, 1)}, "window"), ({"effective_to": dt.datetime(2026, 2, 1)}, "effective_period"), ({"effective_from": None}, "active_effective_from"),
        ({"status": "RETIRED"}, "retired_effective_to"), ({"approved_by": "  "}, "active_approval"), ({"n_valid_mr": 10}, "counts"), ({"n_valid_mr": 0}, "counts"), ({"supersedes_baseline_id": 1}, "not_self"),
    ],
)
def test_baseline_constraints(spark, changes, check):
    found = {r["check"] for r in lifecycle.constraint_violations(versions(spark, **changes)).collect()}
    assert found == set() if check is None else check in found


def test_baseline_lifecycle(spark, tmp_path):
    old = versions(spark)
    moves = lambda new: {r["check"] for r in lifecycle.transition_violations(old, new).collect()}
    assert moves(old) == set()
    assert moves(versions(spark, status="RETIRED", effective_to=dt.datetime(2026, 3, 1))) == set()
    assert moves(versions(spark, status="DRAFT")) == {"lifecycle"}
    assert moves(versions(spark, version=2)) == {"immutable_version"}
    assert moves(versions(spark, approved_by="x")) == {"immutable_approved"}
    assert moves(old.limit(0)) == {"immutable_approved"}
    two = versions(spark, rows=[{}, {"baseline_id": 2}])
    assert {r["check"] for r in lifecycle.set_violations(two).collect()} == {"unique_version", "one_active"}
    chain = versions(spark, rows=[{"supersedes_baseline_id": 2}, {"baseline_id": 2, "version": 2, "supersedes_baseline_id": 1}, {"baseline_id": 3, "booth_id": 2, "supersedes_baseline_id": 1}])
    assert {(r["baseline_id"], r["check"]) for r in lifecycle.supersession_violations(chain).collect()} == {(1, "lower_version"), (3, "same_scope")}
    with pytest.raises(ValueError):
        lifecycle.publish(None, two, str(tmp_path / "no"))
    lifecycle.publish(None, old, str(tmp_path / "yes"))
    assert spark.read.parquet(str(tmp_path / "yes")).count() == 1


def test_draft_and_activate(spark):
    df = measurements(spark, [(1, 0, m, m + 1, m) for m in range(4)])
    window = baseline.baseline_window(df, 18)
    drafted = baseline.draft(baseline.fit(baseline.in_window(df, window)), window, baseline.fingerprint(df), None, "Europe/Budapest")
    r = baseline.activate(drafted, "quality").first()
    assert (r["status"], r["version"], r["effective_from"]) == ("ACTIVE", 1, r["window_end"]) and r["window_start"] == T0 - dt.timedelta(hours=1)
    known = versions(spark, version=3)
    again = baseline.draft(baseline.fit(df), window, baseline.fingerprint(df), known, "Europe/Budapest").first()
    assert (again["version"], again["supersedes_baseline_id"]) == (4, 1)


def test_chart_breaks(spark):
    rows = spark.createDataFrame([("B", "P", i, b) for i, b in enumerate([1, 1, 2, 2, None])], "booth_name string, point_code string, position long, baseline_id long")
    out = frames.in_chart_order(frames.with_breaks(rows)).collect()
    assert [r["is_break"] for r in out] == [False, False, True, False, False, True, False]
    gap = frames.in_chart_order(frames.with_breaks(rows.where("position in (0, 1, 3)").withColumn("baseline_id", F.lit(1)))).collect()
    assert [(r["position"], r["is_break"]) for r in gap] == [(0, False), (1, False), (3, True), (3, False)]


def test_checks(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r["k"], r["side"]) for r in checks.both_ways(a, b, "k").collect()} == {(1, "LEFT_ONLY"), (3, "RIGHT_ONLY")}
    assert [r["k"] for r in checks.duplicates(a, "k").collect()] == [2]
    assert checks.group_size(a, ["k"], 1, 1).count() == 1
    assert checks.not_null(a, "k").first()["violations"] == 0 and checks.accepted(a, "k", [2]).first()["violations"] == 1


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.001, 0.02, 0.0243, 0.1, 0.5, 0.77, 0.976, 0.99999]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select("p", formulas.normal_quantile("p").alias("z")).collect()
    assert all(abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-7 for r in got[: len(ps)]) and [r["z"] for r in got[len(ps) :]] == [None, None]


def test_instants_do_not_depend_on_the_sessions_zone(spark):
    df = spark.sql("select timestamp_ntz'2026-07-01 12:30:00.25' as t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        micros = set()
        for z in ("UTC", "Europe/Budapest", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            micros.add(df.select(F.unix_micros(formulas.instant("t", "Europe/Budapest"))).first()[0])
        assert micros == {1782901800250000}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_drift_input_violations(spark):
    schema = "measurement_id long, measurement_timestamp string, production_month string, shift_instance string, shift_id int, shift_name string, measured_value string, target string"
    day, good = "2026-01-05", lambda i, **k: (i, f"2026-01-05 08:00:0{i}", day, "2026-01-05 06:00:00", k.get("shift", 1), k.get("name", "S1"), k.get("v", "1.5"), k.get("t", "2"))
    show = lambda rows: {r["check"]: r["violations"] for r in drift.input_violations(drift.coerced(spark.createDataFrame(rows, schema))).collect() if r["violations"]}
    assert show([good(1), good(2)]) == {}
    assert show([]) == {"no_rows": 1}
    assert show([good(1), good(1)]) == {"repeated_id": 1}
    assert show([good(1), good(2, name="S2")]) == {"instance_of_several_shifts": 1}
    assert show([good(1, v="x"), good(2, v="NaN"), good(3, t="")]) == {"value_missing_or_not_finite": 2, "target_missing_or_not_finite": 1}
    with pytest.raises(ValueError, match="missing"):
        drift.input_violations(spark.createDataFrame([(1,)], "measurement_id long"))


def test_checked_comparison(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], "id long, v double, s string")
    b = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (4, 3.0, "z")], "id long, v double, s string")
    whole = compare.checked_report(a, b, ["id"]).first()
    assert (whole["complete"], whole["error"], whole["verdict"], whole["matched"]) == (True, None, "FAIL", 2)
    assert compare.checked_report(a, a, ["id"]).first()["verdict"] == "PASS"
    odd = compare.checked_report(a.unionByName(a.where("id = 1")), b.withColumn("v", F.lit(float("nan"))), ["id"]).first()
    assert (odd["complete"], odd["error"], odd["verdict"]) == (False, "source duplicate_key, target not_finite", "FAIL")
    seen = []
    assert compare.for_each_difference(compare.differences(a, b, ["id"]), ["id"], seen.append) == 2
    assert [(r["id"], r["state"]) for r in seen] == [(3, "SOURCE_ONLY"), (4, "TARGET_ONLY")]
    with pytest.raises(ZeroDivisionError):
        compare.for_each_difference(compare.differences(a, b, ["id"]), ["id"], lambda r: 1 / 0)


def test_comparison_of_catalog_tables_times_and_bytes(spark):
    a = spark.sql("select 1 as id, binary('ab') as b, timestamp'2026-07-01 12:00:00+02:00' as t")
    b = spark.sql("select 1 as id, binary('ab') as b, timestamp'2026-07-01 10:00:00Z' as u")
    a.createOrReplaceTempView("cmp_a")
    b.createOrReplaceTempView("cmp_b")
    assert compare.compare_tables(spark, "cmp_a", "cmp_b", ["id"], rename={"u": "t"}).first()["verdict"] == "PASS"
    with pytest.raises(compare.SchemaMismatch, match="no table"):
        compare.compare_tables(spark, "cmp_a", "cmp_none", ["id"])
    shown = compare.in_utc(a).select("t").first()["t"]
    assert str(shown) == "2026-07-01 10:00:00" and dict(compare.in_utc(a).dtypes)["t"] == "timestamp_ntz"


def test_one_to_one_and_expected_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    assert checks.one_to_one(a, a.withColumnRenamed("v", "w"), ["k"]).count() == 2
    with pytest.raises(Exception, match="not unique on the right"):
        checks.one_to_one(a, a.unionByName(a).withColumnRenamed("v", "w"), ["k"]).collect()
    keys = spark.createDataFrame([(None, 1, 5), ("a", None, 6), ("b", 1, 7)], "p string, q int, n int")
    other = spark.createDataFrame([(None, 1, 5), ("a", None, 9)], "p string, q int, n int")
    assert {(r["p"], r["q"], r["state"]) for r in checks.expected_rows(keys, other, ["p", "q"], ["n"]).collect()} == {("a", None, "DIFFERENT"), ("b", 1, "MISSING")}


def test_positions_and_breaks_over_many_days(spark):
    rows = spark.range(40_000).selectExpr("'B' as booth_name", "cast(id % 2 as string) as point_code", "id as measurement_id", "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int), 0) as measurement_timestamp", "id div 26000 as baseline_id")
    placed = frames.positions(rows)
    assert placed.where("position <> measurement_id div 2").isEmpty()
    kept = placed.where("not (position between 9990 and 10010) and position <> 5").select("booth_name", "point_code", "position", "measurement_id", "baseline_id")
    breaks = frames.with_breaks(kept).where("is_break").select("point_code", "position").collect()
    assert {(r["point_code"], r["position"]) for r in breaks} == {(p, at) for p in "01" for at in (6, 10011, 13000)}


def test_contract_names_what_is_missing(spark):
    with pytest.raises(ValueError, match="point_number"):
        enrich.staging(spark.createDataFrame([(1,)], "measurement_id long"))
