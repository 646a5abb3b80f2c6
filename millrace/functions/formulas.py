"""The formulas of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of individuals and moving-range charts for subgroups of two.
D2 = 1.128
MR_UCL_FACTOR = 3.267
Z_975 = 1.959963984540054


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_if(condition: str | Column) -> Column:
    """Rows where the condition is true; unknown is not true."""
    return F.count(F.when(col(condition), F.lit(1)))


def rate(part: Column, whole: Column) -> Column:
    """part / whole as a double, NULL when there is no whole."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def below(value="measured_value", lsl="lsl") -> Column:
    return col(value) < col(lsl)


def above(value="measured_value", usl="usl") -> Column:
    return col(value) > col(usl)


def compliance(value="measured_value", lsl="lsl", usl="usl") -> list[Column]:
    """Strict specification flags: equality with a limit is in specification."""
    low, high = below(value, lsl), above(value, usl)
    return [
        low.alias("below_lsl"),
        high.alias("above_usl"),
        (low | high).alias("is_oos"),
        F.when(low, "BELOW_LSL").when(high, "ABOVE_USL").otherwise("IN_SPEC").alias("compliance_status"),
    ]


def shift_instance(batch_start="batch_start", start="shift_start", end="shift_end") -> Column:
    """The scheduled start of the concrete shift; an overnight shift belongs to the day it began on.
    start and end: strings HH:mm:ss."""
    begins = F.to_timestamp_ntz(F.concat(col(batch_start).cast("date").cast("string"), F.lit(" "), col(start)))
    overnight = (col(end) <= col(start)) & (F.date_format(col(batch_start), "HH:mm:ss") < col(start))
    return F.when(overnight, begins - F.expr("INTERVAL '1' DAY")).otherwise(begins)


def instant(local: str | Column, zone: str) -> Column:
    """The instant of a wall time in a zone, whatever the session's zone is."""
    c = col(local)
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), F.extract(F.lit("SECOND"), c), F.lit(zone))


# Coefficients of Acklam's rational approximation of the normal quantile (relative error below 1.2e-9).
_QA = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
_QB = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_QC = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_QD = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
_Q_LOW = 0.02425


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: str | Column) -> Column:
    """The standard normal quantile of a probability; NULL outside (0, 1)."""
    p = col(p)
    tail = lambda q: _polynomial(q, _QC) / _polynomial(q, _QD)
    q = p - 0.5
    middle = _polynomial(q * q, _QA) * q / _polynomial(q * q, _QB)
    low, high = tail(F.sqrt(-2 * F.log(p))), -tail(F.sqrt(-2 * F.log(1 - p)))
    return F.when((p > 0) & (p < _Q_LOW), low).when((p > 1 - _Q_LOW) & (p < 1), high).when((p > 0) & (p < 1), middle)


def month(day: str | Column) -> Column:
    return F.trunc(col(day).cast("date"), "MM")


def skewness_adjusted(value: str | Column) -> Column:
    """The bias-adjusted sample skewness; NULL below three values or without spread."""
    x, n = col(value).cast("double"), F.count(col(value)).cast("double")
    return F.when((n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def quality_metrics(value="measured_value", name="thickness") -> list[Column]:
    """The common metric set of a group of measurements."""
    x = col(value).cast("double")
    n, oos = F.count(F.lit(1)), count_if("is_oos")
    return [
        n.alias("measurement_count"),
        F.avg(x).alias(f"mean_{name}"),
        F.stddev_samp(x).alias(f"stddev_{name}"),
        F.min(x).alias(f"min_{name}"),
        F.max(x).alias(f"max_{name}"),
        oos.alias("oos_count"),
        rate(oos, n).alias("oos_rate"),
        F.avg(col("deviation_from_target").cast("double")).alias("mean_deviation_from_target"),
    ]


def signal_metrics(rules: bool = False, rates: bool = False, oos: bool = True, total: str = "total_measurements", evaluated: str = "evaluated_measurements", signals: str = "signal_measurements", rule: str = "rule_{}_measurements", oos_name: str = "oos_measurements") -> list[Column]:
    """Signals over evaluated rows, violations of the specification over all rows.  One row is one measurement."""
    n, known, hit = F.count(F.lit(1)), F.count("spc_signal"), count_if("spc_signal")
    out = [n.alias(total), known.alias(evaluated), hit.alias(signals), rate(hit, known).alias("signal_rate")]
    if rules:
        for k in range(1, 5):
            out.append(count_if(f"rule_{k}").alias(rule.format(k)))
            if rates:
                out.append(rate(count_if(f"rule_{k}"), known).alias(f"rule_{k}_rate"))
    if oos:
        out += [count_if("is_oos").alias(oos_name), rate(count_if("is_oos"), n).alias("oos_rate")]
    return out
