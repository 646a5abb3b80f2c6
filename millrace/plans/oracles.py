"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark code.

The events lie in January, when the plant's wall time is one hour ahead of UTC throughout, so effective periods are
compared in wall time here."""

from __future__ import annotations

_SPEC = "CAST({0} AS DECIMAL(10,3)) AS lsl, CAST({1} AS DECIMAL(10,3)) AS target, CAST({2} AS DECIMAL(10,3)) AS usl"
_FLAGS = """measured_value - target AS deviation_from_target, measured_value < lsl AS below_lsl, measured_value > usl AS above_usl,
  (measured_value < lsl OR measured_value > usl) AS is_oos,
  CASE WHEN measured_value < lsl THEN 'BELOW_LSL' WHEN measured_value > usl THEN 'ABOVE_USL' ELSE 'IN_SPEC' END AS compliance_status"""

STREAM = f"""
s0 AS (SELECT event_id AS measurement_id, user_id AS cabin_id, CAST(user_id % 2 + 1 AS INTEGER) AS booth_id, event_type AS point_code, ts,
  CAST(value AS DECIMAL(10,3)) AS measured_value, hour(ts) - hour(ts) % 2 AS h, date_trunc('day', ts)::TIMESTAMP AS day0 FROM events),
s1 AS (SELECT *, CASE WHEN h >= 6 AND h < 14 THEN 1 WHEN h >= 14 AND h < 22 THEN 2 ELSE 3 END AS shift_id,
  day0 + to_hours(CAST(h AS BIGINT)) AS batch_start, {_SPEC.format(1, 50, 150)} FROM s0),
e AS (SELECT measurement_id, cabin_id, CAST(date_diff('day', DATE '2000-01-01', day0::DATE) * 24 + h * 2 + booth_id AS BIGINT) AS batch_id,
  booth_id, 'BOOTH_0' || booth_id AS booth_name, CAST(length(point_code) * 1000 + ascii(point_code) AS INTEGER) AS measurement_point_id,
  point_code, 'EVENT' AS component, CASE booth_id WHEN 1 THEN 'LEFT' ELSE 'RIGHT' END AS side, CAST(length(point_code) AS INTEGER) AS point_number, 1 AS specification_id, 'Event Value' AS characteristic, 'u' AS unit, lsl, target, usl, shift_id, 'SHIFT_0' || shift_id AS shift_name,
  batch_start, batch_start + INTERVAL 2 HOUR AS batch_end, ts AS production_timestamp, ts::DATE AS production_date, ts AS measurement_timestamp,
  measured_value, {_FLAGS},
  CASE shift_id WHEN 1 THEN day0 + INTERVAL 6 HOUR WHEN 2 THEN day0 + INTERVAL 14 HOUR
    ELSE day0 + INTERVAL 22 HOUR - CASE WHEN h < 22 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END END AS shift_instance
  FROM s1)"""

STAR = f"""
t0 AS (SELECT l_orderkey AS cabin_id, o_custkey AS batch_id, r_regionkey AS booth_id, r_name AS booth_name, c_mktsegment AS shift_name,
  p_brand AS point_code, p_type AS component, l_shipdate AS production_timestamp, l_shipdate::DATE AS production_date,
  CAST(l_quantity AS DECIMAL(10,3)) AS measured_value, {_SPEC.format(5, 25, 45)}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
e AS (SELECT *, {_FLAGS} FROM t0)"""

_X = "CAST(measured_value AS DOUBLE)"
Q = f"""count(*) AS measurement_count, avg({_X}) AS mean_thickness, stddev_samp({_X}) AS stddev_thickness, min({_X}) AS min_thickness,
  max({_X}) AS max_thickness, count(*) FILTER (is_oos) AS oos_count, count(*) FILTER (is_oos)::DOUBLE / nullif(count(*), 0) AS oos_rate,
  avg(CAST(deviation_from_target AS DOUBLE)) AS mean_deviation_from_target"""
Q_D = "mean_thickness stddev_thickness min_thickness max_thickness oos_rate mean_deviation_from_target"
_DIST = "count(DISTINCT batch_id) AS batch_count, count(DISTINCT cabin_id) AS cabin_count"

_SCOPE = "booth_id, measurement_point_id, specification_id"
MR = f"""m AS (SELECT *, abs(measured_value - lag(measured_value) OVER (PARTITION BY {_SCOPE}, shift_id, shift_instance
  ORDER BY measurement_timestamp, measurement_id)) AS moving_range FROM e)"""


def _fit(name: str, days: int) -> str:
    """Limits as doubles from the first days."""
    return f"""
w_{name} AS (SELECT {_SCOPE}, min(shift_instance) AS ws FROM e GROUP BY ALL),
i_{name} AS (SELECT e.*, ws FROM e JOIN w_{name} USING ({_SCOPE}) WHERE shift_instance >= ws AND shift_instance < ws + INTERVAL {days} DAY),
r_{name} AS (SELECT *, abs(measured_value - lag(measured_value) OVER (PARTITION BY {_SCOPE}, shift_id, shift_instance ORDER BY measurement_timestamp, measurement_id)) AS mr FROM i_{name}),
g_{name} AS (SELECT {_SCOPE}, ws, count(*) AS n_observations, count(mr) AS n_valid_mr, avg({_X}) AS cl, avg(CAST(mr AS DOUBLE)) AS mrc FROM r_{name} GROUP BY ALL),
f_{name} AS (SELECT {_SCOPE}, ws, n_observations, n_valid_mr, cl AS center_line, mrc / 1.128::DOUBLE AS sigma, cl - 3 * (mrc / 1.128::DOUBLE) AS i_lcl,
  cl + 3 * (mrc / 1.128::DOUBLE) AS i_ucl, mrc AS mr_center, mrc * 3.267::DOUBLE AS mr_ucl FROM g_{name})"""


_LIM = ("center_line", "sigma", "i_lcl", "i_ucl", "mr_center", "mr_ucl")
_DEC = ", ".join(f"CAST({c} AS DECIMAL(14,6)) AS {c}" for c in _LIM)


def _version(name: str, v: int, status: str, start: str, end: str) -> str:
    return f"SELECT booth_id::BIGINT * 10000000 + measurement_point_id * 10 + {v} AS baseline_id, {_SCOPE}, {v} AS version, '{status}' AS status, n_observations, n_valid_mr, {start} AS since, {end} AS until, {_DEC} FROM f_{name}"


BASE = f"""{STREAM},{_fit("a", 9)},{_fit("b", 12)},{_fit("c", 6)},
bl AS ({_version("a", 1, "RETIRED", "ws + INTERVAL 9 DAY", "ws + INTERVAL 15 DAY")} UNION ALL {_version("b", 2, "ACTIVE", "ws + INTERVAL 12 DAY", "NULL::TIMESTAMP")}
  UNION ALL {_version("c", 3, "DRAFT", "NULL::TIMESTAMP", "NULL::TIMESTAMP")})"""

ASOF = f"""{BASE},
k AS (SELECT e.*, b.baseline_id, b.center_line, b.sigma, b.i_lcl, b.i_ucl, b.mr_center, b.mr_ucl,
  row_number() OVER (PARTITION BY measurement_id ORDER BY b.since DESC NULLS LAST, b.version DESC, b.baseline_id DESC) AS rk
  FROM e LEFT JOIN (SELECT * FROM bl WHERE status IN ('ACTIVE', 'RETIRED')) b ON e.booth_id = b.booth_id AND e.measurement_point_id = b.measurement_point_id
   AND e.specification_id = b.specification_id AND b.since <= measurement_timestamp AND (b.until IS NULL OR measurement_timestamp < b.until)),
a AS (SELECT * EXCLUDE (rk) FROM k WHERE rk = 1),
c0 AS (SELECT *, lag(baseline_id) OVER w AS before FROM a WINDOW w AS (PARTITION BY {_SCOPE}, shift_id, shift_instance ORDER BY measurement_timestamp, measurement_id)),
sg AS (SELECT * EXCLUDE (before), CAST(sum(CASE WHEN baseline_id IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY {_SCOPE}, shift_id, shift_instance
  ORDER BY measurement_timestamp, measurement_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS baseline_segment FROM c0)"""

_W = f"PARTITION BY {_SCOPE}, shift_id, shift_instance, baseline_segment ORDER BY measurement_timestamp, measurement_id"
RULES = f"""{ASOF},
z AS (SELECT *, row_number() OVER w AS obs, abs(measured_value - lag(measured_value) OVER w) AS moving_range,
  CASE WHEN baseline_id IS NULL THEN 0 WHEN measured_value > center_line THEN 1 WHEN measured_value < center_line THEN -1 ELSE 0 END AS over_under,
  CASE WHEN measured_value > center_line + 2 * sigma THEN 1 ELSE 0 END AS a2, CASE WHEN measured_value < center_line - 2 * sigma THEN 1 ELSE 0 END AS b2,
  CASE WHEN measured_value > center_line + sigma THEN 1 ELSE 0 END AS a1, CASE WHEN measured_value < center_line - sigma THEN 1 ELSE 0 END AS b1
  FROM sg WINDOW w AS ({_W})),
y AS (SELECT *, sum(a2) OVER (w ROWS 2 PRECEDING) AS sa2, sum(b2) OVER (w ROWS 2 PRECEDING) AS sb2, sum(a1) OVER (w ROWS 4 PRECEDING) AS sa1,
  sum(b1) OVER (w ROWS 4 PRECEDING) AS sb1, CASE WHEN over_under <> lag(over_under, 1, 0) OVER w THEN 1 ELSE 0 END AS turn FROM z WINDOW w AS ({_W})),
x AS (SELECT *, sum(turn) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run FROM y),
v AS (SELECT *, count(*) OVER (PARTITION BY {_SCOPE}, shift_id, shift_instance, baseline_segment, run ORDER BY measurement_timestamp, measurement_id ROWS UNBOUNDED PRECEDING) AS len FROM x),
u AS (SELECT *, baseline_id IS NOT NULL AND (measured_value > i_ucl OR measured_value < i_lcl) AS rule_1,
  baseline_id IS NOT NULL AND obs >= 3 AND (sa2 >= 2 OR sb2 >= 2) AS rule_2, baseline_id IS NOT NULL AND obs >= 5 AND (sa1 >= 4 OR sb1 >= 4) AS rule_3,
  baseline_id IS NOT NULL AND over_under <> 0 AND len >= 8 AS rule_4 FROM v),
r AS (SELECT *, CASE WHEN baseline_id IS NOT NULL THEN (rule_1 OR rule_2 OR rule_3 OR rule_4) END AS spc_signal,
  CASE WHEN baseline_id IS NULL THEN 'NOT_EVALUATED' ELSE 'EVALUATED' END AS spc_evaluation_status FROM u)"""

_KNOWN, _HIT = "count(spc_signal)", "count(*) FILTER (spc_signal)"
_SIG = f"count(*) AS total_measurements, {_KNOWN} AS evaluated_measurements, {_HIT} AS signal_measurements, {_HIT}::DOUBLE / nullif({_KNOWN}, 0) AS signal_rate"
_OOS = "count(*) FILTER (is_oos) AS oos_measurements, count(*) FILTER (is_oos)::DOUBLE / nullif(count(*), 0) AS oos_rate"
_RULES_N = ", ".join(f"count(*) FILTER (rule_{k}) AS rule_{k}_measurements, count(*) FILTER (rule_{k})::DOUBLE / nullif({_KNOWN}, 0) AS rule_{k}_rate" for k in range(1, 5))
_LABEL = "concat_ws(' + ', CASE WHEN rule_1 THEN 'Rule 1' END, CASE WHEN rule_2 THEN 'Rule 2' END, CASE WHEN rule_3 THEN 'Rule 3' END, CASE WHEN rule_4 THEN 'Rule 4' END)"

_DRIFT_HEAD = f"count(*) AS measurement_count, avg({_X}) AS mean, stddev_samp({_X}) AS sample_std, avg(CAST(deviation_from_target AS DOUBLE)) AS mean_deviation_from_target"
_DRIFT_SIDES = "count(*) FILTER (below_lsl) AS below_lsl_count, count(*) FILTER (above_usl) AS above_usl_count"
_DRIFT_TAIL = f"""count(*) FILTER (is_oos) AS oos_count, count(*) FILTER (is_oos)::DOUBLE / nullif(count(*), 0) AS oos_rate, {_HIT} AS spc_signal_count, {_KNOWN} AS spc_evaluated_count,
  {_HIT}::DOUBLE / nullif({_KNOWN}, 0) AS spc_signal_rate, """ + ", ".join(f"count(*) FILTER (rule_{k}) AS rule_{k}_count" for k in range(1, 5))
_DRIFT_D = "mean sample_std mean_deviation_from_target oos_rate spc_signal_rate"
_WITHIN = f"power(coalesce(stddev_samp({_X}), 0), 2) * greatest(count(*) - 1, 0) AS within_sum_of_squares"

BRIDGE = """br AS (SELECT DISTINCT event_id AS measurement_id, unnest([event_id % 8 + 1, event_id // 8 % 8 + 1, event_id // 64 % 8 + 1]) AS robot_id FROM events),
rb AS (SELECT s_suppkey AS robot_id, s_name AS robot_name, n_nationkey AS track_axis_id, n_name AS track_name, r_regionkey AS booth_id, r_name AS booth_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_BATCH = f"""bq AS (SELECT batch_id, booth_id, booth_name, shift_id, shift_name, production_date, min(batch_start) AS batch_start, max(batch_end) AS batch_end,
  min(production_timestamp) AS first_cabin_timestamp, max(production_timestamp) AS last_cabin_timestamp, count(DISTINCT cabin_id) AS cabin_count, {Q} FROM e GROUP BY ALL)"""
CONTEXT = f"""{STREAM}, {_BATCH},
pe AS (SELECT measurement_id AS event_id, measurement_timestamp AS event_timestamp, 'SPECIFICATION_VIOLATION' AS event_type, concat_ws(' ', point_code, CAST(production_date AS VARCHAR)) AS description,
  CASE WHEN measured_value > 200 THEN 'HIGH' ELSE 'LOW' END AS severity, batch_id, booth_id FROM e WHERE above_usl),
cx AS (SELECT event_id, event_timestamp, event_type, description, severity, pe.batch_id, pe.booth_id, bq.booth_name, cabin_count, measurement_count, mean_thickness, stddev_thickness, oos_count, oos_rate
  FROM pe JOIN bq ON pe.batch_id = bq.batch_id)"""
_SUMMARY = "avg(mean_thickness) AS mean_of_batch_means, avg(stddev_thickness) AS mean_batch_stddev, CAST(sum(oos_count) AS BIGINT) AS oos_measurement_count"

MEANS = f"{STREAM}, im AS (SELECT booth_name, point_code, shift_instance, avg({_X}) AS mean FROM e GROUP BY ALL)"
_P = "PARTITION BY booth_name, point_code"
TREND = f"""{MEANS},
d0 AS (SELECT *, epoch(shift_instance - min(shift_instance) OVER ({_P})) / 86400.0::DOUBLE AS d, count(*) OVER ({_P}) AS n FROM im),
d1 AS (SELECT *, d - avg(d) OVER ({_P}) AS x, mean - avg(mean) OVER ({_P}) AS y, avg(mean) OVER ({_P}) AS ybar FROM d0 WHERE n >= 3),
d2 AS (SELECT *, sum(x * x) OVER ({_P}) AS sxx, sum(x * y) OVER ({_P}) AS sxy FROM d1),
d3 AS (SELECT *, sxy / sxx AS slope, (sxy - x * y - x * y / (n - 1)) / (sxx - x * x) AS loo FROM d2 WHERE sxx > 0),
tr AS (SELECT booth_name, point_code, count(*) AS observation_count, min(shift_instance) AS time_origin, max(d) AS duration_days, any_value(slope) AS slope_per_day,
  sqrt(sum((y - slope * x) ** 2) / (count(*) - 2) / any_value(sxx)) AS slope_standard_error, min(loo) AS loo_slope_min, max(loo) AS loo_slope_max, max(abs(loo - slope)) AS max_loo_slope_change FROM d3 GROUP BY ALL)"""
_ROLL = ", ".join(f"CASE WHEN count(mean) OVER ({_P} ORDER BY shift_instance ROWS {k - 1} PRECEDING) = {k} THEN avg(mean) OVER ({_P} ORDER BY shift_instance ROWS {k - 1} PRECEDING) END AS rolling_mean_{k}" for k in (7, 14, 21))
_HALF = f"""hv AS (SELECT *, row_number() OVER ({_P} ORDER BY shift_instance) <= count(*) OVER ({_P}) // 2 AS first FROM im),
hf AS (SELECT booth_name, point_code, """ + ", ".join(
    f"count(*) FILTER ({c}) AS {h}_half_shift_instance_count, avg(mean) FILTER ({c}) AS {h}_half_mean, stddev_samp(mean) FILTER ({c}) AS {h}_half_sample_std, min(shift_instance) FILTER ({c}) AS {h}_half_start, max(shift_instance) FILTER ({c}) AS {h}_half_end"
    for h, c in (("first", "first"), ("second", "NOT first"))
) + ", avg(mean) FILTER (NOT first) - avg(mean) FILTER (first) AS second_minus_first_mean FROM hv GROUP BY ALL HAVING count(*) >= 2)"

CAP = f"""{RULES},
cm AS (SELECT *, abs({_X} - lag({_X}) OVER (PARTITION BY booth_name, point_code, shift_instance ORDER BY measurement_timestamp, measurement_id)) AS mr2 FROM r),
cg AS (SELECT booth_name, point_code, count(*) AS measurement_count, count(mr2) AS valid_mr_pairs, avg(mr2) AS mrbar, avg({_X}) AS mean, median({_X}) AS median, min({_X}) AS min, max({_X}) AS max,
  stddev_samp({_X}) AS overall_sigma, {_KNOWN} AS spc_evaluated_count, {_HIT} AS spc_signal_count, count(*) FILTER (below_lsl) AS below_lsl_count, count(*) FILTER (above_usl) AS above_usl_count,
  1.0::DOUBLE AS lsl, 50.0::DOUBLE AS target, 150.0::DOUBLE AS usl FROM cm GROUP BY ALL),
cp AS (SELECT *, mrbar / 1.128::DOUBLE AS within_sigma FROM cg),
cs AS (SELECT *, CASE WHEN within_sigma IS NULL THEN 'NO_VALID_MR_PAIR' WHEN within_sigma = 0 THEN 'ZERO_SIGMA' WHEN within_sigma <= 0.001 THEN 'NEAR_ZERO_SIGMA' ELSE 'AVAILABLE' END AS within_sigma_status,
  CASE WHEN measurement_count < 2 THEN 'INSUFFICIENT_OBSERVATIONS' WHEN overall_sigma = 0 THEN 'ZERO_SIGMA' WHEN overall_sigma <= 0.001 THEN 'NEAR_ZERO_SIGMA' ELSE 'AVAILABLE' END AS overall_sigma_status FROM cp),
ci AS (SELECT *, CASE WHEN within_sigma_status = 'AVAILABLE' THEN (usl - lsl) / (6 * within_sigma) END AS cp, CASE WHEN within_sigma_status = 'AVAILABLE' THEN least((usl - mean) / (3 * within_sigma), (mean - lsl) / (3 * within_sigma)) END AS cpk,
  CASE WHEN overall_sigma_status = 'AVAILABLE' THEN (usl - lsl) / (6 * overall_sigma) END AS pp, CASE WHEN overall_sigma_status = 'AVAILABLE' THEN least((usl - mean) / (3 * overall_sigma), (mean - lsl) / (3 * overall_sigma)) END AS ppk FROM cs)"""

CHANGED = """ca AS (SELECT * FROM orders),
cb AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 103 = 7 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 101 = 5 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 3
  UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 89 = 2),
cd AS (SELECT coalesce(ca.o_orderkey, cb.o_orderkey) AS o_orderkey, concat_ws(',', CASE WHEN ca.o_custkey IS DISTINCT FROM cb.o_custkey THEN 'o_custkey' END, CASE WHEN ca.o_orderstatus IS DISTINCT FROM cb.o_orderstatus THEN 'o_orderstatus' END,
  CASE WHEN ca.o_totalprice IS DISTINCT FROM cb.o_totalprice THEN 'o_totalprice' END, CASE WHEN ca.o_orderdate IS DISTINCT FROM cb.o_orderdate THEN 'o_orderdate' END, CASE WHEN ca.o_orderpriority IS DISTINCT FROM cb.o_orderpriority THEN 'o_orderpriority' END) AS f,
  ca.o_orderkey IS NULL AS new, cb.o_orderkey IS NULL AS gone FROM ca FULL JOIN cb ON ca.o_orderkey = cb.o_orderkey),
cf AS (SELECT o_orderkey, CASE WHEN gone THEN 'SOURCE_ONLY' WHEN new THEN 'TARGET_ONLY' WHEN f <> '' THEN 'DIFFERENT' ELSE 'MATCHED' END AS state, CASE WHEN NOT gone AND NOT new AND f <> '' THEN f END AS fields FROM cd)"""


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"({coefficients[0]!r}::DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def _quantile(p: str) -> str:
    """The rational approximation of the normal quantile, with the engine's fixed coefficients."""
    from millrace.functions import formulas as f

    tail = lambda q: f"{_horner(q, f._QC)} / {_horner(q, f._QD)}"
    q = f"({p} - 0.5)"
    return f"""CASE WHEN {p} < {f._Q_LOW} THEN {tail(f"sqrt(-2 * ln({p}))")} WHEN {p} > 1 - {f._Q_LOW} THEN -({tail(f"sqrt(-2 * ln(1 - {p}))")})
  ELSE {_horner(f"({q} * {q})", f._QA)} * {q} / {_horner(f"({q} * {q})", f._QB)} END"""


def R(sql: str, doubles: str = "", decimals: str = "") -> str:
    """sql with its doubles rounded to six places (a billionth more keeps exact halves from going either way), and its
    decimals as doubles."""
    cut = [f"round({c} + 1e-9::DOUBLE, 6) AS {c}" for c in doubles.split()] + [f"CAST({c} AS DOUBLE) AS {c}" for c in decimals.split()]
    return f"SELECT * REPLACE ({', '.join(cut)}) FROM ({sql})" if cut else sql


def W(ctes: str, sql: str, doubles: str = "", decimals: str = "") -> str:
    return R(f"WITH {ctes} {sql}", doubles, decimals)


def _checks(rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) AS violations FROM ({q})" for n, q in rows)


_VIOL = "SELECT 1 FROM r WHERE "
_BROKEN = f"""{BASE}, b0 AS (SELECT *, CASE WHEN version = 2 THEN baseline_id - 1 END AS sup0, CASE version WHEN 1 THEN since - INTERVAL 9 DAY WHEN 2 THEN since - INTERVAL 12 DAY END AS ws0 FROM bl),
bb AS (SELECT * EXCLUDE (until, i_ucl), CASE WHEN version = 1 AND booth_id = 1 THEN since ELSE until END AS until, CASE WHEN version = 2 AND booth_id = 2 THEN '' ELSE 'quality' END AS approver,
  CASE WHEN version = 2 AND measurement_point_id % 2 = 0 THEN CAST(i_ucl + 0.000004 AS DECIMAL(14,6)) ELSE i_ucl END AS i_ucl,
  CASE WHEN version = 1 AND measurement_point_id % 2 = 1 THEN baseline_id + 1 WHEN version = 2 AND booth_id = 1 THEN baseline_id ELSE sup0 END AS sup FROM b0)"""

SQL: dict[str, str] = {
    "measurement_enriched": W(STREAM, "SELECT measurement_id, cabin_id, batch_id, shift_id, shift_name, booth_id, booth_name, production_timestamp, production_date, measurement_timestamp, measurement_point_id, point_code, component, side, point_number, specification_id, characteristic, unit, lsl, target, usl, measured_value, deviation_from_target, below_lsl, above_usl, is_oos, compliance_status, batch_start, batch_end FROM e", "", "measured_value lsl target usl deviation_from_target"),
    "staging_measurements": W(STREAM, "SELECT measurement_id, cabin_id, batch_id, shift_id, shift_name, booth_id, booth_name, production_timestamp, production_date, measurement_timestamp, measurement_point_id, point_code, component, side, point_number, specification_id, characteristic, unit, lsl, target, usl, measured_value, deviation_from_target, below_lsl, above_usl, is_oos FROM e", "", "measured_value lsl target usl deviation_from_target"),
    "star_enriched": W(STAR, "SELECT booth_name, shift_name, compliance_status, count(*) AS measurement_count, CAST(sum(deviation_from_target) AS DOUBLE) AS sum_deviation FROM e GROUP BY ALL", "sum_deviation"),
    "compliance_distribution": W(STAR, "SELECT compliance_status, count(*) AS measurement_count, count(*)::DOUBLE / sum(count(*)) OVER () AS measurement_rate FROM e GROUP BY compliance_status", "measurement_rate"),
    "production_volume": W(STREAM, f"SELECT production_date, shift_id, shift_name, booth_id, booth_name, {_DIST}, count(*) AS measurement_count FROM e GROUP BY ALL"),
    "cabin_quality": W(STREAM, f"SELECT cabin_id, batch_id, booth_id, booth_name, shift_id, shift_name, production_date, {Q} FROM e GROUP BY ALL", Q_D),
    "cabin_oos_rate": W(STAR, "SELECT count(*) AS cabin_count, count(*) FILTER (o > 0) AS cabins_with_oos, count(*) FILTER (o > 0)::DOUBLE / nullif(count(*), 0) AS cabin_oos_rate FROM (SELECT cabin_id, count(*) FILTER (is_oos) AS o FROM e GROUP BY cabin_id)", "cabin_oos_rate"),
    "batch_quality": W(f"{STREAM}, {_BATCH}", "SELECT * FROM bq", Q_D),
    "booth_quality_daily": W(STAR, f"SELECT production_date, booth_id, booth_name, {_DIST}, {Q} FROM e GROUP BY ALL", Q_D),
    "booth_days_with_oos": W(STAR, "SELECT booth_name, production_date, count(*) AS measurement_count, count(*) FILTER (is_oos) AS oos_count, count(*) FILTER (is_oos)::DOUBLE / count(*) AS oos_rate FROM e GROUP BY booth_name, production_date HAVING count(*) FILTER (is_oos) > 0", "oos_rate"),
    "shift_quality_daily": W(STREAM, f"SELECT production_date, shift_id, shift_name, {_DIST}, {Q} FROM e GROUP BY ALL", Q_D),
    "point_quality": W(STAR, f"SELECT point_code, component, {Q} FROM e GROUP BY ALL", Q_D),
    "descriptive_overall": W(STAR, f"SELECT count(*) AS measurement_count, avg({_X}) AS mean_thickness, stddev_samp({_X}) AS sample_stddev_thickness, min({_X}) AS min_thickness, max({_X}) AS max_thickness FROM e", "mean_thickness sample_stddev_thickness"),
    "descriptive_booth_point": W(STAR, f"SELECT booth_name, point_code, count(*) AS measurement_count, avg({_X}) AS mean_thickness, stddev_samp({_X}) AS sample_stddev_thickness, min({_X}) AS min_thickness, max({_X}) AS max_thickness FROM e GROUP BY ALL", "mean_thickness sample_stddev_thickness"),
    "descriptive_shape": W(STREAM, f"SELECT booth_name, point_code, median({_X}) AS median_thickness, skewness({_X}) AS skewness FROM e GROUP BY ALL", "median_thickness skewness"),
    "value_histogram": W(STREAM, f"SELECT CAST(CASE WHEN {_X} < 0 THEN 0 WHEN {_X} >= 200 THEN 36 ELSE floor({_X} / (200.0::DOUBLE / 35)) + 1 END AS BIGINT) AS bin, count(*) AS measurement_count FROM e GROUP BY ALL"),
    "within_cabin_variation": W(STAR, f"SELECT booth_name, point_code, count(*) AS measurement_count, avg({_X}) AS mean_thickness, stddev_samp({_X}) AS overall_sample_stddev, avg(sd) AS mean_within_cabin_stddev FROM e JOIN (SELECT cabin_id, stddev_samp({_X}) AS sd FROM e GROUP BY cabin_id) USING (cabin_id) GROUP BY ALL", "mean_thickness overall_sample_stddev mean_within_cabin_stddev"),
    "mart_quality_metrics": W(STAR, f"SELECT production_date, booth_id, booth_name, {_DIST}, count(*) FILTER (below_lsl) AS below_lsl_count, count(*) FILTER (above_usl) AS above_usl_count, {Q} FROM e GROUP BY ALL", Q_D),
    "quality_kpis": W(STAR, "SELECT count(DISTINCT cabin_id) AS cabin_count, count(*) AS measurement_count, count(*) FILTER (is_oos) AS oos_count, count(*) FILTER (is_oos)::DOUBLE / count(*) * 100 AS oos_rate_pct FROM e", "oos_rate_pct"),
    "daily_trend": W(STAR, f"SELECT production_date, avg({_X}) AS mean_thickness, count(*) FILTER (is_oos) AS oos_count, count(*) AS measurement_count, count(*) FILTER (is_oos)::DOUBLE / count(*) * 100 AS oos_rate_pct FROM e GROUP BY ALL", "mean_thickness oos_rate_pct"),
    "booth_comparison": W(STAR, f"SELECT booth_name, count(*) AS measurement_count, round(avg({_X}), 3) AS mean_thickness, round(stddev_samp({_X}), 3) AS stddev_thickness, count(*) FILTER (is_oos) AS oos_count, round(count(*) FILTER (is_oos)::DOUBLE / count(*) * 100, 3) AS oos_rate_pct FROM e GROUP BY ALL"),
    "monthly_quality": W(STAR, f"SELECT date_trunc('month', production_timestamp)::DATE AS production_month, {Q} FROM e GROUP BY ALL", Q_D),
    "latest_detail": W(STREAM, "SELECT measurement_id, production_timestamp, booth_name, point_code, shift_name, measured_value, compliance_status FROM e ORDER BY production_timestamp DESC, measurement_id DESC LIMIT 1000", "", "measured_value"),
    "quality_filtered": W(STREAM, f"SELECT production_date, avg({_X}) AS mean_thickness, count(*) FILTER (is_oos) AS oos_count, count(*) AS measurement_count, count(*) FILTER (is_oos)::DOUBLE / count(*) * 100 AS oos_rate_pct FROM e WHERE booth_name = 'BOOTH_01' AND shift_name IN ('SHIFT_01', 'SHIFT_03') AND production_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL", "mean_thickness oos_rate_pct"),
    "robot_attribution": W(f"{STREAM}, {BRIDGE}", f"SELECT robot_id, robot_name, track_axis_id, track_name, rb.booth_id, rb.booth_name, count(DISTINCT measurement_id) AS linked_measurement_count, count(DISTINCT cabin_id) AS linked_cabin_count, avg({_X}) AS linked_mean_thickness, stddev_samp({_X}) AS linked_stddev_thickness, min({_X}) AS linked_min_thickness, max({_X}) AS linked_max_thickness, count(DISTINCT measurement_id) FILTER (is_oos) AS linked_oos_count, count(DISTINCT measurement_id) FILTER (is_oos)::DOUBLE / nullif(count(DISTINCT measurement_id), 0) AS linked_oos_rate, avg(CAST(deviation_from_target AS DOUBLE)) AS linked_mean_deviation_from_target FROM br JOIN rb USING (robot_id) JOIN e USING (measurement_id) GROUP BY robot_id, robot_name, track_axis_id, track_name, rb.booth_id, rb.booth_name", "linked_mean_thickness linked_stddev_thickness linked_oos_rate linked_mean_deviation_from_target"),
    "bridge_cardinality": W(BRIDGE, "SELECT robot_count, count(*) AS measurement_count FROM (SELECT measurement_id, count(*) AS robot_count FROM br GROUP BY 1) GROUP BY 1"),
    "robot_array_filter": W(BRIDGE, "SELECT measurement_id, string_agg(robot_name, ',' ORDER BY robot_name) AS robot_names FROM br JOIN rb USING (robot_id) GROUP BY measurement_id HAVING bool_or(robot_name IN ('Supplier#000000002', 'Supplier#000000005'))"),
    "event_context": W(CONTEXT, "SELECT * FROM cx", "mean_thickness stddev_thickness oos_rate"),
    "event_type_summary": W(CONTEXT, f"SELECT event_type, severity, booth_name, count(DISTINCT batch_id) AS affected_batch_count, CAST(sum(measurement_count) AS BIGINT) AS affected_measurement_count, {_SUMMARY} FROM cx GROUP BY ALL", "mean_of_batch_means mean_batch_stddev"),
    "event_periods": W(CONTEXT, "SELECT event_type, severity, booth_id, booth_name, description, min(event_timestamp)::DATE AS period_start, max(event_timestamp)::DATE AS period_end FROM cx GROUP BY ALL"),
    "before_during_after": W(
        CONTEXT,
        f"""SELECT event_type, severity, booth_name, period_start, period_end, relative_period, count(*) AS batch_count, CAST(sum(measurement_count) AS BIGINT) AS measurement_count, {_SUMMARY} FROM (
  SELECT p.event_type, p.severity, p.booth_name, period_start, period_end, CASE WHEN batch_start::DATE < period_start THEN 'BEFORE' WHEN batch_start::DATE > period_end THEN 'AFTER' ELSE 'DURING' END AS relative_period, bq.mean_thickness, bq.stddev_thickness, bq.oos_count, bq.measurement_count
  FROM (SELECT event_type, severity, booth_id, booth_name, description, min(event_timestamp)::DATE AS period_start, max(event_timestamp)::DATE AS period_end FROM cx GROUP BY ALL) p
  JOIN bq ON bq.booth_id = p.booth_id AND batch_start::DATE BETWEEN period_start - 7 AND period_end + 7) GROUP BY ALL""",
        "mean_of_batch_means mean_batch_stddev",
    ),
    "shift_instance": W(STREAM, "SELECT shift_id, shift_name, shift_instance, count(*) AS measurement_count, min(batch_start) AS first_batch, max(batch_start) AS last_batch FROM e GROUP BY ALL"),
    "moving_range": W(f"{STREAM}, {MR}", "SELECT measurement_id, shift_instance, measured_value, moving_range FROM m", "", "measured_value moving_range"),
    "baseline_fit": W(f"{STREAM},{_fit('a', 18)}", "SELECT * EXCLUDE (ws) FROM f_a", " ".join(_LIM)),
    "baseline_fit_checks": " UNION ALL ".join(f"SELECT '{n}' AS \"check\", 0::BIGINT AS violations" for n in ("missing_value", "value_does_not_fit_numeric_10_3", "missing_key", "id_does_not_fit_integer", "duplicate_measurement_id", "no_rows", "too_few_observations", "no_moving_range", "limits_do_not_fit_numeric_14_6", "too_many_scopes")) + " UNION ALL SELECT 'non_positive_id', count(*) FROM events WHERE event_id <= 0",
    "baseline_fingerprint": W(f"{STREAM},{_fit('a', 9)}", f"SELECT {_SCOPE}, sha256(string_agg(h, chr(10) ORDER BY shift_instance, shift_id)) AS source_query_hash FROM (SELECT {_SCOPE}, shift_id, shift_instance, sha256(string_agg(concat_ws('|', measurement_id, strftime(measurement_timestamp, '%Y-%m-%d %H:%M:%S.%f'), shift_id, strftime(shift_instance, '%Y-%m-%d %H:%M:%S'), measured_value), chr(10) ORDER BY measurement_id)) AS h FROM i_a GROUP BY ALL) GROUP BY ALL"),
    "baseline_table": W(BASE, f"SELECT baseline_id, {_SCOPE}, version, status, n_observations, n_valid_mr, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _LIM)} FROM bl", " ".join(_LIM)),
    "baseline_asof": W(ASOF, "SELECT measurement_id, baseline_id FROM a"),
    "baseline_asof_by_row": W(ASOF, "SELECT measurement_id, baseline_id FROM a"),
    "baseline_segments": W(ASOF, "SELECT measurement_id, baseline_id, baseline_segment FROM sg"),
    "spc_rules": W(RULES, f"SELECT measurement_timestamp, measurement_id, baseline_id, booth_name AS booth, point_code AS measurement_point, shift_id, shift_name, shift_instance, measured_value, moving_range, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _LIM)}, rule_1, rule_2, rule_3, rule_4, spc_signal, spc_evaluation_status FROM r", " ".join(_LIM), "measured_value moving_range"),
    "spc_rules_scoped": W(RULES, "SELECT measurement_id, booth_name AS booth, point_code AS measurement_point, CAST(i_lcl AS DOUBLE) AS lcl, CAST(i_ucl AS DOUBLE) AS ucl, rule_1, rule_2, rule_3, rule_4, spc_signal FROM r WHERE booth_name = 'BOOTH_01' AND point_code = 'view'", "lcl ucl"),
    "mart_spc_metrics": W(RULES, "SELECT measurement_id, production_date, booth_name, point_code, characteristic, unit, measured_value, is_oos, shift_instance, shift_id, shift_name, rule_1, rule_2, rule_3, rule_4, spc_signal, baseline_id, spc_evaluation_status FROM r WHERE booth_name = 'BOOTH_01' AND point_code = 'view' AND characteristic = 'Event Value' AND unit = 'u'", "", "measured_value"),
    "spc_overall": W(RULES, f"SELECT 'OVERALL' AS summary_scope, booth_name, point_code, {_SIG}, {_RULES_N} FROM r GROUP BY booth_name, point_code", "signal_rate rule_1_rate rule_2_rate rule_3_rate rule_4_rate"),
    "spc_monthly": W(RULES, f"SELECT date_trunc('month', production_timestamp)::DATE AS production_month, booth_name, point_code, {_SIG}, {_OOS} FROM r GROUP BY ALL", "signal_rate oos_rate"),
    "spc_shift_instance": W(RULES, f"SELECT shift_instance, shift_id, shift_name, booth_name, point_code, {_SIG}, {_OOS}, min(measurement_timestamp) FILTER (spc_signal) AS first_signal_timestamp, max(measurement_timestamp) FILTER (spc_signal) AS last_signal_timestamp FROM r GROUP BY ALL", "signal_rate oos_rate"),
    "spc_rules_long": W(
        f"""{RULES}, rl AS (SELECT date_trunc('month', production_timestamp)::DATE AS production_month, shift_instance, shift_id, shift_name, spc_signal, measurement_id, unnest(['RULE_1', 'RULE_2', 'RULE_3', 'RULE_4']) AS rule_name, unnest([rule_1, rule_2, rule_3, rule_4]) AS hit FROM r)""",
        """SELECT CASE WHEN grouping(production_month) = 0 THEN 'PRODUCTION_MONTH' WHEN grouping(shift_instance) = 0 THEN 'SHIFT_INSTANCE' ELSE 'OVERALL' END AS summary_scope, production_month, shift_instance, shift_id, shift_name, rule_name,
  count(DISTINCT measurement_id) AS total_measurements, count(DISTINCT measurement_id) FILTER (spc_signal IS NOT NULL) AS evaluated_measurements, count(DISTINCT measurement_id) FILTER (hit) AS rule_signal_measurements,
  count(DISTINCT measurement_id) FILTER (hit)::DOUBLE / nullif(count(DISTINCT measurement_id) FILTER (spc_signal IS NOT NULL), 0) AS rule_signal_rate
  FROM rl GROUP BY GROUPING SETS ((rule_name), (production_month, rule_name), (shift_instance, shift_id, shift_name, rule_name))""",
        "rule_signal_rate",
    ),
    "oos_signal_contingency": W(RULES, "SELECT count(*) FILTER (spc_signal AND is_oos) AS signal_and_oos, count(*) FILTER (spc_signal AND NOT is_oos) AS signal_only, count(*) FILTER (coalesce(spc_signal, false) = false AND is_oos) AS oos_only, count(*) FILTER (coalesce(spc_signal, false) = false AND NOT is_oos) AS neither FROM r"),
    "signal_coverage": W(RULES, f"SELECT count(*) AS measurements, {_KNOWN} AS evaluated, {_HIT} AS signals, {_HIT}::DOUBLE / nullif({_KNOWN}, 0) AS signal_rate FROM r", "signal_rate"),
    "spc_overview": W(RULES, f"SELECT count(*) AS measurement_count, count(baseline_id) AS covered_count, count(*) - count(baseline_id) AS not_assessed_count, count(baseline_id)::DOUBLE / count(*) * 100 AS coverage_pct, {_HIT} AS signal_count, {_HIT}::DOUBLE / nullif(count(baseline_id), 0) * 100 AS signal_rate_pct FROM r", "coverage_pct signal_rate_pct"),
    "rule_counts": W(RULES, "SELECT count(*) FILTER (rule_1) AS rule_1_count, count(*) FILTER (rule_2) AS rule_2_count, count(*) FILTER (rule_3) AS rule_3_count, count(*) FILTER (rule_4) AS rule_4_count, count(*) FILTER (NOT spc_signal) AS assessed_without_signal FROM r WHERE baseline_id IS NOT NULL"),
    "mr_violations": W(f"{RULES}, ml AS (SELECT booth_name, point_code, avg(CAST(moving_range AS DOUBLE)) AS c FROM r WHERE moving_range IS NOT NULL GROUP BY ALL)", "SELECT booth_name, point_code, any_value(c) AS center_line, any_value(3.267::DOUBLE * c) AS upper_control_limit, count(*) AS valid_count, count(*) FILTER (CAST(moving_range AS DOUBLE) > 3.267::DOUBLE * c) AS violation_count, count(*) FILTER (CAST(moving_range AS DOUBLE) > 3.267::DOUBLE * c)::DOUBLE / count(*) * 100 AS violation_rate_pct, max(CAST(moving_range AS DOUBLE)) AS maximum, 0.0::DOUBLE AS lower_control_limit FROM r JOIN ml USING (booth_name, point_code) WHERE moving_range IS NOT NULL GROUP BY ALL", "center_line upper_control_limit violation_rate_pct"),
    "mr_stored_limits": W(RULES, "SELECT count(moving_range) AS valid_mr_count, count(*) FILTER (moving_range > mr_ucl) AS mr_violation_count, count(*) FILTER (moving_range > mr_ucl)::DOUBLE / nullif(count(moving_range), 0) * 100 AS mr_violation_rate_pct, CAST(max(moving_range) AS DOUBLE) AS max_moving_range FROM r WHERE baseline_id IS NOT NULL", "mr_violation_rate_pct"),
    "signal_details": W(RULES, f"SELECT measurement_id, booth_name, point_code, shift_name, measured_value, moving_range, {_LABEL} AS triggered_rules FROM r WHERE spc_signal", "", "measured_value moving_range"),
    "mr_violation_details": W(RULES, "SELECT measurement_id, moving_range, CAST(mr_ucl AS DOUBLE) AS mr_ucl FROM r WHERE moving_range > mr_ucl", "mr_ucl", "moving_range"),
    "provenance": W(RULES, "SELECT booth_name, point_code, baseline_id, count(*) AS covered_measurements, min(measurement_timestamp) AS first_measurement, max(measurement_timestamp) AS last_measurement FROM r WHERE baseline_id IS NOT NULL GROUP BY ALL"),
    "individuals_chart": W(
        f"""{RULES}, p0 AS (SELECT *, row_number() OVER ({_P} ORDER BY measurement_timestamp, measurement_id) - 1 AS position FROM r),
p1 AS (SELECT *, lag(position) OVER w AS pp, lag(baseline_id) OVER w AS pb FROM p0 WHERE shift_name IN ('SHIFT_01', 'SHIFT_03') AND measurement_timestamp >= TIMESTAMP '2024-01-08' WINDOW w AS ({_P} ORDER BY position))""",
        """SELECT booth_name, point_code, position, measurement_id, baseline_id, CAST(center_line AS DOUBLE) AS center_line, false AS is_break FROM p1
  UNION ALL SELECT booth_name, point_code, position, NULL, NULL, NULL, true FROM p1 WHERE pp IS NOT NULL AND (position - pp > 1 OR pb IS DISTINCT FROM baseline_id)""",
        "center_line",
    ),
    "frame_sanity": " UNION ALL ".join(f"SELECT '{n}' AS \"check\", 0::BIGINT AS violations" for n in ("missing_context", "signal_without_baseline", "signal_nullability", "limits_missing_or_not_finite")),
    "specification_list": W(STREAM, "SELECT DISTINCT specification_id, characteristic, unit, lsl, target, usl FROM e", "", "lsl target usl"),
    "capability_streams": W(
        CAP,
        """SELECT booth_name, point_code, measurement_count, valid_mr_pairs, mrbar, mean, median, min, max, overall_sigma, spc_evaluated_count, spc_signal_count, 'AVAILABLE' AS specification_status, within_sigma,
  measurement_count - spc_evaluated_count AS spc_not_evaluated_count, spc_signal_count::DOUBLE / nullif(spc_evaluated_count, 0) AS spc_signal_rate,
  CASE WHEN spc_signal_count > 0 THEN 'SPC_SIGNALS_PRESENT' WHEN spc_evaluated_count = 0 THEN 'SPC_SIGNALS_NOT_ASSESSED' WHEN spc_evaluated_count < measurement_count THEN 'SPC_SIGNALS_PARTIALLY_ASSESSED' ELSE 'NO_SPC_SIGNALS_DETECTED' END AS stability_signal_status,
  lsl, target, usl, within_sigma_status, overall_sigma_status, below_lsl_count, above_usl_count, below_lsl_count + above_usl_count AS oos_count, (below_lsl_count + above_usl_count)::DOUBLE / measurement_count AS oos_rate,
  mean - lsl AS distance_mean_to_lsl, usl - mean AS distance_mean_to_usl, cp, cpk, pp, ppk,
  CASE WHEN cp IS NOT NULL AND pp IS NOT NULL THEN 'AVAILABLE' WHEN cp IS NOT NULL OR pp IS NOT NULL THEN 'PARTIALLY_AVAILABLE' ELSE 'UNAVAILABLE' END AS availability_status,
  CASE WHEN spc_signal_count > 0 THEN 'EXPLORATORY_PHASE_I_SPC_SIGNALS_PRESENT' ELSE 'EXPLORATORY_PHASE_I_STABILITY_NOT_ESTABLISHED' END AS interpretation_status FROM ci""",
        "mrbar mean median overall_sigma within_sigma spc_signal_rate oos_rate distance_mean_to_lsl distance_mean_to_usl cp cpk pp ppk",
    ),
    "capability_groups": W(RULES, f"SELECT shift_name, count(*) AS measurement_count, avg({_X}) AS mean, median({_X}) AS median, stddev_samp({_X}) AS sample_std, min({_X}) AS min, max({_X}) AS max, {_DRIFT_SIDES}, count(*) FILTER (is_oos) AS oos_count, count(*) FILTER (is_oos)::DOUBLE / count(*) AS oos_rate, {_HIT} AS spc_signal_count, {_KNOWN} AS spc_evaluated_count, count(*) - {_KNOWN} AS spc_not_evaluated_count, {_HIT}::DOUBLE / nullif({_KNOWN}, 0) AS spc_signal_rate FROM r GROUP BY ALL", "mean median sample_std oos_rate spc_signal_rate"),
    "plotting_positions": W(STREAM, f"SELECT *, {_quantile('plotting_position')} AS theoretical_quantile FROM (SELECT booth_name, point_code, measurement_id, {_X} AS value, (row_number() OVER ({_P} ORDER BY {_X}, measurement_id) - 0.5::DOUBLE) / count(*) OVER ({_P}) AS plotting_position FROM e)", "plotting_position theoretical_quantile"),
    "drift_monthly": W(RULES, f"SELECT booth_name, point_code, date_trunc('month', production_timestamp)::DATE AS production_month, {_DRIFT_HEAD}, {_DRIFT_SIDES}, {_DRIFT_TAIL} FROM r GROUP BY ALL", _DRIFT_D),
    "drift_shift_instance": W(RULES, f"SELECT booth_name, point_code, shift_instance, shift_id, shift_name, min(measurement_timestamp) AS first_measurement_timestamp, max(measurement_timestamp) AS last_measurement_timestamp, {_DRIFT_HEAD}, {_DRIFT_SIDES}, {_DRIFT_TAIL}, {_WITHIN} FROM r GROUP BY ALL", _DRIFT_D + " within_sum_of_squares"),
    "drift_shift_type": W(RULES, f"SELECT booth_name, point_code, shift_id, shift_name, count(DISTINCT shift_instance) AS shift_instance_count, {_DRIFT_HEAD}, {_DRIFT_TAIL} FROM r GROUP BY ALL", _DRIFT_D),
    "ss_sufficient_stats": W(STREAM, f"SELECT booth_name, point_code, shift_instance, shift_id, shift_name, count(*) AS measurement_count, avg({_X}) AS mean, stddev_samp({_X}) AS sample_std, {_WITHIN} FROM e GROUP BY ALL", "mean sample_std within_sum_of_squares"),
    "variation_decomposition": W(
        f"""{STREAM}, q0 AS (SELECT *, avg({_X}) OVER ({_P}) AS om, avg({_X}) OVER (PARTITION BY booth_name, point_code, shift_instance) AS gm FROM e),
q1 AS (SELECT booth_name, point_code, count(*) AS n, count(DISTINCT shift_instance) AS g, any_value(om) AS om, sum(({_X} - om) ** 2) AS total, sum(({_X} - gm) ** 2) AS within, sum((gm - om) ** 2) AS between FROM q0 GROUP BY ALL)""",
        "SELECT booth_name, point_code, n AS measurement_count, g AS shift_instance_count, om AS overall_mean, within AS within_shift_sum_of_squares, between AS between_shift_sum_of_squares, total AS total_sum_of_squares, within / total AS within_shift_share, between / total AS between_shift_share, CASE WHEN n > g THEN sqrt(within / (n - g)) END AS pooled_within_shift_sd, CASE WHEN n >= 2 THEN sqrt(total / (n - 1)) END AS overall_sample_sd FROM q1",
        "overall_mean within_shift_sum_of_squares between_shift_sum_of_squares total_sum_of_squares within_shift_share between_shift_share pooled_within_shift_sd overall_sample_sd",
    ),
    "subgroup_sizes": W(STREAM, "SELECT booth_name, point_code, measurement_count, count(*) AS shift_instance_count FROM (SELECT booth_name, point_code, shift_instance, count(*) AS measurement_count FROM e GROUP BY ALL) GROUP BY ALL"),
    "rolling_means": W(MEANS, f"SELECT *, {_ROLL} FROM im", "mean rolling_mean_7 rolling_mean_14 rolling_mean_21"),
    "half_comparison": W(f"{MEANS}, {_HALF}", "SELECT * FROM hf", "first_half_mean first_half_sample_std second_half_mean second_half_sample_std second_minus_first_mean"),
    "trend": W(TREND, "SELECT booth_name, point_code, observation_count, time_origin, duration_days, slope_per_day, slope_standard_error, slope_per_day - 1.959963984540054::DOUBLE * slope_standard_error AS slope_ci_95_low, slope_per_day + 1.959963984540054::DOUBLE * slope_standard_error AS slope_ci_95_high, slope_per_day * duration_days AS estimated_cumulative_fitted_change FROM tr", "duration_days slope_per_day slope_standard_error slope_ci_95_low slope_ci_95_high estimated_cumulative_fitted_change"),
    "leave_one_out": W(TREND, "SELECT booth_name, point_code, loo_slope_min, loo_slope_max, max_loo_slope_change, (loo_slope_min > 0 OR loo_slope_max < 0) AS slope_direction_stable FROM tr", "loo_slope_min loo_slope_max max_loo_slope_change"),
    "trend_fitted": W(TREND, "SELECT booth_name, point_code, shift_instance, mean, ybar + slope * x AS fitted_value, y - slope * x AS residual FROM d3", "mean fitted_value residual"),
    "drift_evidence": W(
        f"""{CAP}, im AS (SELECT booth_name, point_code, shift_instance, avg({_X}) AS mean FROM e GROUP BY ALL),{TREND.split("im AS", 1)[1].split("),", 1)[1]}, {_HALF},
ro AS (SELECT *, {_ROLL} FROM im),
re AS (SELECT booth_name, point_code, {", ".join(f"arg_max(rolling_mean_{k}, shift_instance) FILTER (rolling_mean_{k} IS NOT NULL) - arg_min(rolling_mean_{k}, shift_instance) FILTER (rolling_mean_{k} IS NOT NULL) AS c{k}" for k in (7, 14, 21))} FROM ro GROUP BY ALL),
ev AS (SELECT booth_name, point_code, (slope_per_day - 1.959963984540054::DOUBLE * slope_standard_error > 0 OR slope_per_day + 1.959963984540054::DOUBLE * slope_standard_error < 0) AS slope_ci_excludes_zero,
  abs(slope_per_day * duration_days) >= 0.25 * within_sigma AS practically_meaningful, (sign(second_minus_first_mean) = sign(slope_per_day) AND sign(slope_per_day) <> 0) AS half_direction_compatible,
  (loo_slope_min > 0 OR loo_slope_max < 0) AS leave_one_out_stable, (sign(slope_per_day) <> 0 AND coalesce(sign(c7) = sign(slope_per_day), false) AND coalesce(sign(c14) = sign(slope_per_day), false) AND coalesce(sign(c21) = sign(slope_per_day), false)) AS rolling_direction_compatible
  FROM tr JOIN hf USING (booth_name, point_code) JOIN re USING (booth_name, point_code) JOIN ci USING (booth_name, point_code))""",
        "SELECT *, (slope_ci_excludes_zero AND practically_meaningful AND half_direction_compatible AND leave_one_out_stable AND rolling_direction_compatible) AS consistent_with_drift FROM ev",
    ),
    "table_compare": W(CHANGED, "SELECT count(*) AS compared, count(*) FILTER (state = 'MATCHED') AS matched, count(*) FILTER (state = 'SOURCE_ONLY') AS source_only, count(*) FILTER (state = 'TARGET_ONLY') AS target_only, count(*) FILTER (state = 'DIFFERENT') AS different, CASE WHEN count(*) = count(*) FILTER (state = 'MATCHED') THEN 'PASS' ELSE 'FAIL' END AS verdict FROM cf"),
    "compare_samples": W(CHANGED, "SELECT * FROM cf WHERE state <> 'MATCHED' ORDER BY o_orderkey LIMIT 20"),
    "compare_key_checks": "SELECT 'null_key' AS \"check\", count(*) AS violations FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'not_finite', count(*) FROM lineitem WHERE NOT isfinite(l_quantity) OR NOT isfinite(l_extendedprice) OR NOT isfinite(l_discount) OR NOT isfinite(l_tax)",
    "integrity_anti": "SELECT o_custkey, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 1) GROUP BY 1",
    "integrity_both_ways": "SELECT k, 'LEFT_ONLY' AS side FROM (SELECT o_custkey AS k FROM orders WHERE o_custkey % 11 <> 2 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 5) UNION ALL SELECT k, 'RIGHT_ONLY' FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 13 <> 5 EXCEPT SELECT o_custkey FROM orders WHERE o_custkey % 11 <> 2)",
    "integrity_full_join": W(STAR, "SELECT booth_name, l.n AS l_n, r.n AS r_n FROM (SELECT booth_name, count(*) AS n FROM e GROUP BY 1) l FULL JOIN (SELECT booth_name, count(*) AS n FROM e WHERE NOT is_oos OR booth_name <> 'ASIA' GROUP BY 1) r USING (booth_name) WHERE l.n IS DISTINCT FROM r.n"),
    "integrity_counts_union": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("region", "nation", "customer", "orders", "lineitem", "part", "supplier", "events")),
    "integrity_group_sizes": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) NOT BETWEEN 1 AND 6",
    "integrity_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "integrity_generic": " UNION ALL ".join(f"SELECT 'not_null_{c}' AS \"check\", count(*) AS violations FROM orders WHERE {c} IS NULL" for c in ("o_orderkey", "o_custkey", "o_orderstatus")) + " UNION ALL SELECT 'accepted_o_orderstatus', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')",
    "aggregate_totals": W(STAR, " UNION ALL ".join(f"SELECT '{n}' AS relation, CAST(sum(k) AS BIGINT) AS total, (SELECT count(*) FROM e) AS expected, sum(k) = (SELECT count(*) FROM e) AS agrees FROM (SELECT count(*) AS k FROM e GROUP BY {c})" for n, c in (("cabin", "cabin_id"), ("day", "production_date"), ("point", "point_code")))),
    "spc_result_checks": W(
        RULES,
        _checks([
            ("duplicate_measurement", "SELECT 1 FROM r GROUP BY measurement_id HAVING count(*) > 1"), ("signal_is_not_the_rules", _VIOL + "baseline_id IS NOT NULL AND spc_signal IS DISTINCT FROM (rule_1 OR rule_2 OR rule_3 OR rule_4)"),
            ("signal_without_baseline", _VIOL + "baseline_id IS NULL AND (spc_signal IS NOT NULL OR rule_1 OR rule_2 OR rule_3 OR rule_4)"), ("status_is_not_coverage", _VIOL + "(baseline_id IS NOT NULL) <> (spc_evaluation_status = 'EVALUATED')"),
            ("rule_1_is_not_the_limits", _VIOL + "baseline_id IS NOT NULL AND rule_1 <> (measured_value > i_ucl OR measured_value < i_lcl)"), ("negative_moving_range", _VIOL + "moving_range < 0"),
            ("limits_without_baseline", _VIOL + "baseline_id IS NULL AND (center_line IS NOT NULL OR sigma IS NOT NULL)"), ("missing_scope", _VIOL + "booth_name IS NULL OR point_code IS NULL OR shift_instance IS NULL"),
        ]),
    ),
    "baseline_constraint_violations": W(
        _BROKEN,
        """SELECT baseline_id, 'effective_period' AS "check" FROM bb WHERE until IS NOT NULL AND until <= since UNION ALL SELECT baseline_id, 'active_approval' FROM bb WHERE status IN ('ACTIVE', 'RETIRED') AND approver = ''
  UNION ALL SELECT baseline_id, 'i_chart_limits' FROM bb WHERE abs(CAST(sigma AS DECIMAL(24,9)) * 1.128 - mr_center) > 0.000003 OR abs(i_lcl - (center_line - 3 * sigma)) > 0.000003 OR abs(i_ucl - (center_line + 3 * sigma)) > 0.000003
  UNION ALL SELECT baseline_id, 'mr_limits' FROM bb WHERE abs(mr_ucl - 3.267 * CAST(mr_center AS DECIMAL(24,9))) > 0.000003 UNION ALL SELECT baseline_id, 'not_self' FROM bb WHERE sup = baseline_id""",
    ),
    "supersession_violations": W(_BROKEN, """SELECT x.baseline_id, 'lower_version' AS "check" FROM bb x JOIN bb y ON x.sup = y.baseline_id WHERE y.version >= x.version"""),
    "transition_violations": W(
        _BROKEN,
        """SELECT baseline_id, 'immutable_approved' AS "check" FROM bb WHERE status <> 'DRAFT' AND (booth_id = 1 OR (version = 1 AND booth_id = 2)) UNION ALL SELECT baseline_id, 'lifecycle' FROM bb WHERE status = 'ACTIVE'""",
    ),
}


# ---------------------------------------------------------------- input contracts, reports, validators

_SCOPED = "FROM r WHERE booth_name = 'BOOTH_01' AND point_code = 'view'"
_INPUT = """measurement_id, measurement_timestamp, production_timestamp, date_trunc('month', production_timestamp)::DATE AS production_month, shift_instance, shift_id, shift_name,
  booth_name AS booth, point_code AS measurement_point, characteristic, unit, lsl, target, usl, measured_value, below_lsl, above_usl, is_oos, rule_1, rule_2, rule_3, rule_4, spc_signal, baseline_id, spc_evaluation_status"""
_NONE = lambda *names: " UNION ALL ".join(f"SELECT '{n}' AS \"check\", 0::BIGINT AS violations" for n in names)

_SPOILT = f"""{RULES},
rr AS (SELECT * REPLACE (CASE WHEN measurement_id % 89 = 3 THEN i_ucl + 1 ELSE i_ucl END AS i_ucl, CASE WHEN measurement_id % 83 = 5 THEN NULL ELSE spc_signal END AS spc_signal) FROM r WHERE measurement_id % 101 <> 7),
rx AS (SELECT * FROM rr UNION ALL SELECT * FROM rr WHERE measurement_id % 79 = 2), bs AS (SELECT * FROM bl WHERE NOT (booth_id = 1 AND status = 'ACTIVE'))"""
_ANY_RULE = "(rule_1 OR rule_2 OR rule_3 OR rule_4)"

_DRIFTED = f"""{RULES},
di AS (SELECT measurement_id, measurement_timestamp, shift_instance, shift_id, CASE WHEN measurement_id % 53 = 1 THEN 'SHIFT_03' ELSE shift_name END AS shift_name, baseline_id, spc_evaluation_status,
  CASE WHEN measurement_id % 47 = 2 THEN NULL ELSE spc_signal END AS spc_signal {_SCOPED}),
dx AS (SELECT * FROM di UNION ALL SELECT * FROM di WHERE measurement_id % 43 = 3)"""

_PARSED = f"""{STREAM},
dp AS (SELECT measurement_id, shift_instance, shift_id, CASE WHEN measurement_id % 23 = 8 THEN NULL ELSE shift_name END AS shift_name FROM e),
dy AS (SELECT * FROM dp UNION ALL SELECT * FROM dp WHERE measurement_id % 19 = 9)"""

#: The synthetic plant: production days, two-hour batches, special causes.
_PLANT = """days AS (SELECT d::DATE AS day, row_number() OVER (ORDER BY d) - 1 AS day_number FROM generate_series(DATE '{0}', DATE '{1}', INTERVAL 1 DAY) t(d) WHERE dayofweek(d) <> 0),
pb AS (SELECT day_number * 12 + (s - 1) * 4 + k + 1 AS batch_id, CAST(s AS INTEGER) AS shift_id, day::TIMESTAMP + to_hours(CAST(6 + 8 * (s - 1) + 2 * k AS BIGINT)) AS batch_start,
  day::TIMESTAMP + to_hours(CAST(8 + 8 * (s - 1) + 2 * k AS BIGINT)) AS batch_end, CAST(k // 2 + 1 AS INTEGER) AS booth_id FROM days, range(1, 4) a(s), range(0, 4) b(k))"""
_YEAR, _SHORT = _PLANT.format("2026-01-01", "2026-06-30"), _PLANT.format("2026-01-16", "2026-02-04")
_CAUSES = """pc(event_type, booth_id, first, last, severity, description) AS (VALUES ('PROCESS_DRIFT', 1, DATE '2026-02-02', DATE '2026-02-13', 'MEDIUM', 'Slow rise'), ('PROCESS_SHIFT', 2, DATE '2026-03-09', DATE '2026-03-20', 'HIGH', 'Sudden fall'),
  ('INCREASED_VARIATION', 1, DATE '2026-04-06', DATE '2026-04-17', 'MEDIUM', 'Wider spread'), ('SPECIFICATION_VIOLATION', 2, DATE '2026-05-04', DATE '2026-05-05', 'HIGH', 'Below'), ('SPECIFICATION_VIOLATION', 1, DATE '2026-06-15', DATE '2026-06-15', 'HIGH', 'Above'),
  ('OUTLIER', 1, DATE '2026-01-20', DATE '2026-01-20', 'LOW', 'Single'), ('OUTLIER', 2, DATE '2026-02-25', DATE '2026-02-25', 'LOW', 'Single'), ('OUTLIER', 2, DATE '2026-04-29', DATE '2026-04-29', 'LOW', 'Single'), ('OUTLIER', 1, DATE '2026-06-03', DATE '2026-06-03', 'LOW', 'Single'))"""
_POINTS = ", ".join(
    f"({i}, '{p}', '{c}', '{s}', {n})"
    for i, (p, c, s, n) in enumerate(
        ((f"{g}-{s[0]}{n}", c, s, n) for g, c, k in (("A", "A_PILLAR", 3), ("B", "B_PILLAR", 3), ("T", "UPPER_CONNECTING_ELEMENT", 1), ("C", "A_B_CONNECTING_ELEMENT", 2)) for s in ("LEFT", "RIGHT") for n in range(1, k + 1)), 1
    )
)
_ROBOTS = ", ".join(f"({r}, 'ROBOT_{r:02}', {(r + 1) // 2}, 'TRACK_{(r + 1) // 2:02}', {(r + 3) // 4}, 'BOOTH_{(r + 3) // 4:02}')" for r in range(1, 9))

SQL |= {
    "capability_inputs": W(RULES, f"SELECT {_INPUT} {_SCOPED}", "", "lsl target usl measured_value"),
    "drift_inputs": W(RULES, f"SELECT {_INPUT}, deviation_from_target {_SCOPED}", "", "lsl target usl measured_value deviation_from_target"),
    "variation_by_batch": W(f"{STREAM}, {_BATCH}", "SELECT production_date, shift_name, booth_name, batch_id, mean_thickness, stddev_thickness FROM bq", "mean_thickness stddev_thickness"),
    "variation_by_shift": W(STREAM, f"SELECT production_date, shift_name, avg({_X}) AS mean_thickness, stddev_samp({_X}) AS stddev_thickness, count(*) FILTER (is_oos)::DOUBLE / count(*) AS oos_rate FROM e GROUP BY ALL", "mean_thickness stddev_thickness oos_rate"),
    "variation_by_point": W(STREAM, f"SELECT point_code, component, avg({_X}) AS mean_thickness, stddev_samp({_X}) AS stddev_thickness, count(*) FILTER (is_oos)::DOUBLE / count(*) AS oos_rate FROM e GROUP BY ALL", "mean_thickness stddev_thickness oos_rate"),
    "volume_report": W(STREAM, f"SELECT production_date, shift_name, booth_name, {_DIST}, count(*) AS measurement_count FROM e GROUP BY ALL"),
    "rules_report": f"SELECT summary_scope, production_month, shift_instance, rule_name, rule_signal_measurements FROM ({SQL['spc_rules_long']})",
    "moving_range_chart": W(
        f"""{RULES}, p0 AS (SELECT *, row_number() OVER ({_P} ORDER BY measurement_timestamp, measurement_id) - 1 AS position FROM r),
p1 AS (SELECT *, lag(position) OVER w AS pp, lag(baseline_id) OVER w AS pb FROM p0 WHERE shift_name = 'SHIFT_02' AND measurement_timestamp >= TIMESTAMP '2024-01-05' AND measurement_timestamp < TIMESTAMP '2024-01-26' WINDOW w AS ({_P} ORDER BY position))""",
        """SELECT booth_name, point_code, position, measurement_id, baseline_id, moving_range, CAST(mr_center AS DOUBLE) AS mr_center, CAST(mr_ucl AS DOUBLE) AS mr_ucl, CASE WHEN baseline_id IS NOT NULL THEN 0.0::DOUBLE END AS mr_lcl, false AS is_break FROM p1
  UNION ALL SELECT booth_name, point_code, position, NULL, NULL, NULL, NULL, NULL, NULL, true FROM p1 WHERE pp IS NOT NULL AND (position - pp > 1 OR pb IS DISTINCT FROM baseline_id)""",
        "mr_center mr_ucl",
        "moving_range",
    ),
    "monitoring_detail": W(
        f"""{RULES}, {BRIDGE}, sb AS (SELECT *, CASE WHEN status <> 'DRAFT' THEN 'quality' END AS approved_by FROM bl WHERE NOT (status = 'ACTIVE' AND booth_id = 2)),
act AS (SELECT {_SCOPE}, json_object('baseline_id', baseline_id, 'version', version, 'status', status, 'approved_by', approved_by, {", ".join(f"'{c}', CAST({c} AS VARCHAR)" for c in _LIM)})::VARCHAR AS active_baseline FROM sb WHERE status = 'ACTIVE'),
nm AS (SELECT measurement_id, string_agg(robot_name, ',' ORDER BY robot_name) AS robot_names FROM br JOIN rb USING (robot_id) WHERE robot_id <> 3 GROUP BY 1)""",
        f"""SELECT r.measurement_id, measurement_timestamp, r.baseline_id, booth_name, point_code, shift_name, measured_value, moving_range, spc_signal, batch_id, r.booth_id, r.measurement_point_id, r.specification_id, characteristic, unit AS specification_unit,
  sb.version AS baseline_version, sb.status AS baseline_current_status, sb.approved_by AS baseline_approved_by, active_baseline, coalesce(robot_names, '') AS robot_names
  FROM r LEFT JOIN sb ON sb.baseline_id = r.baseline_id LEFT JOIN act ON act.booth_id = r.booth_id AND act.measurement_point_id = r.measurement_point_id AND act.specification_id = r.specification_id LEFT JOIN nm ON nm.measurement_id = r.measurement_id""",
        "",
        "measured_value moving_range",
    ),
    "active_baseline_json": W(BASE, "SELECT json_object('approved_by', 'quality', 'baseline_id', baseline_id, 'booth_id', booth_id, 'effective_to', NULL, 'measurement_point_id', measurement_point_id, 'n_observations', n_observations, 'status', status, 'version', version)::VARCHAR AS report FROM bl WHERE status = 'ACTIVE'"),
    "unassigned_baselines": W(RULES, "SELECT baseline_id, booth_id, measurement_point_id FROM bl WHERE status = 'ACTIVE' AND baseline_id NOT IN (SELECT baseline_id FROM r WHERE baseline_id IS NOT NULL AND (measurement_timestamp < TIMESTAMP '2024-01-12' OR booth_name = 'BOOTH_02'))"),
    "ambiguous_specifications": W(STREAM, "SELECT specification_id, count(*) AS n FROM (SELECT DISTINCT specification_id, characteristic, CASE booth_id WHEN 2 THEN 'mm' ELSE unit END AS unit, lsl, target, usl FROM e) GROUP BY 1 HAVING count(*) > 1"),
    "bootstrap_checks": _NONE("no_measurements", "measurement_not_enriched", "enriched_twice", "scope_without_one_active_baseline", "eligible_without_result", "invalid_flags", "limits_not_preserved", "result_twice"),
    "bootstrap_violations": W(
        _SPOILT,
        _checks([
            ("no_measurements", "SELECT 1 WHERE (SELECT count(*) FROM e) = 0"), ("measurement_not_enriched", "SELECT 1 FROM e WHERE measurement_id % 97 = 1"), ("enriched_twice", "SELECT 1 FROM e GROUP BY measurement_id HAVING count(*) > 1"),
            ("scope_without_one_active_baseline", f"SELECT 1 FROM bs GROUP BY {_SCOPE} HAVING count(*) FILTER (status = 'ACTIVE') <> 1"),
            ("eligible_without_result", f"SELECT 1 FROM e JOIN (SELECT {_SCOPE} FROM bs WHERE status = 'ACTIVE') USING ({_SCOPE}) WHERE measurement_id % 97 <> 1 AND measurement_id NOT IN (SELECT measurement_id FROM rx)"),
            ("invalid_flags", f"SELECT 1 FROM rx WHERE (baseline_id IS NOT NULL AND spc_signal IS DISTINCT FROM {_ANY_RULE}) OR (baseline_id IS NULL AND ({_ANY_RULE} OR spc_signal IS NOT NULL)) OR (baseline_id IS NOT NULL) <> (spc_evaluation_status = 'EVALUATED')"),
            ("limits_not_preserved", "SELECT 1 FROM rx JOIN bs USING (baseline_id) WHERE " + " OR ".join(f"rx.{c} IS DISTINCT FROM bs.{c}" for c in _LIM)), ("result_twice", "SELECT 1 FROM rx GROUP BY measurement_id HAVING count(*) > 1"),
        ]),
    ),
    "capability_reconciliation": W(RULES, f"""SELECT n AS source_count, n AS distinct_source_count, o AS source_oos_count, s AS source_signal_count, n AS input_count, n AS distinct_input_count, o AS input_oos_count, s AS input_signal_count, 0::BIGINT AS different_rows, 'PASS' AS reconciliation_status
  FROM (SELECT count(*) AS n, count(*) FILTER (is_oos) AS o, count(*) FILTER (spc_signal) AS s {_SCOPED})"""),
    "drift_reconciliation": _NONE("repeated_measurement", "instance_of_several_shifts", "measurements_per_instance", "overnight_shift", "status_is_not_coverage", "group_totals", "sums_of_squares"),
    "drift_reconciliation_violations": W(
        _DRIFTED,
        _checks([
            ("repeated_measurement", "SELECT 1 FROM dx GROUP BY measurement_id HAVING count(*) > 1"), ("instance_of_several_shifts", "SELECT 1 FROM dx GROUP BY shift_instance HAVING count(DISTINCT shift_id) <> 1 OR count(DISTINCT shift_name) <> 1"),
            ("measurements_per_instance", "SELECT 1 FROM dx GROUP BY shift_instance HAVING count(DISTINCT measurement_id) NOT BETWEEN 1 AND 40"),
            ("overnight_shift", "SELECT 1 FROM dx WHERE shift_name = 'SHIFT_03' AND (hour(shift_instance) <> 22 OR measurement_timestamp < shift_instance OR measurement_timestamp >= shift_instance + INTERVAL 8 HOUR)"),
            ("status_is_not_coverage", "SELECT 1 FROM dx WHERE (baseline_id IS NULL) <> (spc_evaluation_status = 'NOT_EVALUATED') OR (baseline_id IS NULL) <> (spc_signal IS NULL)"),
            ("group_totals", "SELECT 1 WHERE false"), ("sums_of_squares", "SELECT 1 WHERE false"),
        ]),
    ),
    "drift_input_checks": W(
        _PARSED,
        _checks([
            ("no_rows", "SELECT 1 WHERE (SELECT count(*) FROM dy) = 0"), ("missing_id", "SELECT 1 FROM dy WHERE measurement_id IS NULL"), ("repeated_id", "SELECT 1 FROM dy GROUP BY measurement_id HAVING count(*) > 1"),
            ("missing_time", "SELECT 1 FROM dy WHERE measurement_id % 41 = 6"), ("missing_shift", "SELECT 1 FROM dy WHERE shift_name IS NULL"),
            ("instance_of_several_shifts", "SELECT 1 FROM dy GROUP BY shift_instance HAVING count(DISTINCT shift_id) <> 1 OR count(DISTINCT shift_name) <> 1"),
            ("value_missing_or_not_finite", "SELECT 1 FROM dy WHERE measurement_id % 31 = 4 OR measurement_id % 37 = 5"), ("target_missing_or_not_finite", "SELECT 1 FROM dy WHERE measurement_id % 29 = 7"),
        ]),
    ),
    "enrichment_checks": _checks([("line_not_enriched", "SELECT 1 FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 17 <> 3)"), ("part_without_line", "SELECT 1 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")]),
    "scalar_subquery_mismatches": "SELECT l_linestatus AS status, count(*) AS mismatches FROM lineitem WHERE l_linestatus <> (SELECT max(o_orderstatus) FROM orders WHERE o_orderkey = l_orderkey) GROUP BY 1",
    "expected_rows": W(
        f"{STAR}, ra AS (SELECT booth_name, shift_name, count(*) AS n FROM e GROUP BY ROLLUP (booth_name, shift_name)), rc AS (SELECT booth_name, shift_name, count(*) AS n FROM e WHERE shift_name <> 'BUILDING' OR booth_name <> 'ASIA' GROUP BY ROLLUP (booth_name, shift_name))",
        "SELECT ra.booth_name, ra.shift_name, CASE WHEN rc.n IS NULL THEN 'MISSING' ELSE 'DIFFERENT' END AS state FROM ra LEFT JOIN rc ON ra.booth_name IS NOT DISTINCT FROM rc.booth_name AND ra.shift_name IS NOT DISTINCT FROM rc.shift_name WHERE ra.n IS DISTINCT FROM rc.n",
    ),
    "one_to_one_merge": W(STREAM, f"SELECT booth_name, point_code, shift_instance, count(*) AS measurement_count, avg({_X}) AS mean, min(measurement_timestamp) AS first_measurement, max(measurement_timestamp) AS last_measurement FROM e GROUP BY booth_name, point_code, shift_instance", "mean"),
    "stream_compare": f"SELECT *, CAST(NULL AS VARCHAR) AS error, true AS complete FROM ({SQL['table_compare']})",
    "stream_compare_incomplete": "SELECT 'source duplicate_key' AS error, false AS complete, 'FAIL' AS verdict",
    "catalog_compare": SQL["table_compare"],
    # sources, sinks and the synthetic plant
    "csv_round_trip": R("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", "c_acctbal"),
    "csv_extract": R("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_totalprice > 100000 END AS large, CASE WHEN o_orderkey % 11 = 4 THEN NULL ELSE o_orderdate END AS o_orderdate, o_totalprice FROM orders", "o_totalprice"),
    "integer_series": "SELECT range AS value FROM range(1, 501)",
    "load_reconciliation": "SELECT * FROM (VALUES ('dim_booth', 2::BIGINT, 2::BIGINT), ('dim_track_axis', 4, 4), ('dim_robot', 8, 8), ('dim_shift', 3, 3), ('dim_measurement_point', 18, 18), ('dim_specification', 1, 1)) t(table_name, staged, loaded)",
    "next_ids": " UNION ALL ".join(f"SELECT '{n}' AS table_name, max({k}) + 1 AS next_id FROM {n}" for n, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("events", "event_id"))),
    "plant_points": f"SELECT * FROM (VALUES {_POINTS}) t(measurement_point_id, point_code, component, side, point_number)",
    "plant_robots": f"SELECT * FROM (VALUES {_ROBOTS}) t(robot_id, robot_name, track_axis_id, track_name, booth_id, booth_name)",
    "plant_calendar": W(_YEAR, "SELECT * FROM days"),
    "plant_batches": W(_YEAR, "SELECT * FROM pb"),
    "plant_cabins": W(_YEAR, "SELECT (batch_id - 1) * 5 + c + 1 AS cabin_id, batch_id, booth_id, true AS in_place FROM pb, range(0, 5) t(c)"),
    "plant_events": W(f"{_YEAR}, {_CAUSES}", "SELECT row_number() OVER (ORDER BY batch_start, batch_id, description) AS event_id, batch_start AS event_timestamp, batch_id, pb.booth_id, event_type, severity FROM pb JOIN pc ON pb.booth_id = pc.booth_id AND batch_start::DATE BETWEEN first AND last"),
    "plant_reference_counts": "SELECT 'dim_measurement_point' AS table_name, 19::BIGINT AS row_count, 18::BIGINT AS expected",
    "plant_checks": _NONE("points_per_cabin", "robots_per_measurement", "contributors_do_not_vary", "robot_in_other_booth", "no_cross_track_measurement", "timestamp_is_not_the_cabins", "unit_is_not_the_specifications", "booths_per_batch", "cabins_per_batch", "cabin_outside_batch", "event_is_not_its_batchs", "robots_per_booth"),
    "plant_measurement_grid": W(_SHORT, "SELECT batch_start::DATE AS day, booth_id, count(*) * 90 AS measurements, count(*) * 5 AS cabins, 18::BIGINT AS points, true AS some, true AS at_most_four, true AS not_negative FROM pb GROUP BY ALL"),
}
