"""Monitoring of an unbounded stream against fixed limits.  An extension: the batch rules are the definition.

Rule 1 needs no state: it is a stream-static join.  Rules 2 to 4 keep, for each stream and concrete shift, the last
four zones and the current run's side and length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.baseline import LIMITS, SCOPE, effective
from millrace.operators.rules import STREAM


def rule_1(stream: DataFrame, baselines: DataFrame, zone: str) -> DataFrame:
    """The stream with the limits in force and rule_1."""
    v = F.col("measured_value")
    hit = F.col("baseline_id").isNotNull() & F.coalesce((v > F.col("i_ucl")) | (v < F.col("i_lcl")), F.lit(False))
    return effective(stream, baselines, zone).withColumn("rule_1", hit)


RESULT = "measurement_id long, measurement_timestamp timestamp_ntz, baseline_id long, moving_range double, rule_1 boolean, rule_2 boolean, rule_3 boolean, rule_4 boolean, spc_signal boolean"
#: baseline, rows seen, last value, the last rows' zones as text, side and length of the run
STATE = "baseline long, n int, last double, zones string, side int, run int"


def run_rules(key, frames: Iterator[pd.DataFrame], state: GroupState, expire_hours: int | None = None) -> Iterator[pd.DataFrame]:
    """One shift's new rows, in the order of their times; late rows join at the end of what was seen."""
    if state.hasTimedOut:
        state.remove()
        return
    baseline, n, last, zones, side, run = state.get if state.exists else (-1, 0, 0.0, "", 0, 0)
    rows = pd.concat(list(frames)).sort_values(["measurement_timestamp", "measurement_id"])
    out = []
    for r in rows.itertuples(index=False):
        own = -1 if pd.isna(r.baseline_id) else int(r.baseline_id)
        if own != baseline:
            baseline, n, zones, side, run = own, 0, "", 0, 0
        v, mr = float(r.measured_value), abs(float(r.measured_value) - last) if n else None
        n, last = n + 1, v
        if own < 0:
            out.append((r.measurement_id, r.measurement_timestamp, None, mr, False, False, False, False, None))
            continue
        c, s = float(r.center_line), float(r.sigma)
        zone = 2 if v > c + 2 * s else 1 if v > c + s else -2 if v < c - 2 * s else -1 if v < c - s else 0
        zones = (zones + "cbaxy"[zone + 2])[-5:]  # c, b: below; a: inside; x, y: above
        now = (v > c) - (v < c)
        run = run + 1 if now == side and n > 1 else 1
        side = now
        hits = (
            v > float(r.i_ucl) or v < float(r.i_lcl),
            n >= 3 and max(zones[-3:].count("y"), zones[-3:].count("c")) >= 2,
            n >= 5 and max(zones.count("x") + zones.count("y"), zones.count("b") + zones.count("c")) >= 4,
            side != 0 and run >= 8,
        )
        out.append((r.measurement_id, r.measurement_timestamp, own, mr, *hits, any(hits)))
    state.update((baseline, n, last, zones, side, run))
    if expire_hours:
        state.setTimeoutDuration(expire_hours * 3600 * 1000)
    yield pd.DataFrame(out, columns=["measurement_id", "measurement_timestamp", "baseline_id", "moving_range", "rule_1", "rule_2", "rule_3", "rule_4", "spc_signal"]).astype({"baseline_id": "Int64", "spc_signal": "boolean"})


def monitor(stream: DataFrame, baselines: DataFrame, zone: str, expire_hours: int | None = None) -> DataFrame:
    """All rules on a streaming DataFrame with the columns of an enriched stream; use output mode append.

    expire_hours drops a shift's state so long after its last row.  A query that runs without end should set it, as
    every shift leaves a state; a query with an available-now trigger must not, as it would wait for the expiry."""
    matched = effective(stream, baselines, zone).select("measurement_id", "measurement_timestamp", *STREAM, "measured_value", "baseline_id", *LIMITS)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire_hours else GroupStateTimeout.NoTimeout

    def run(key, frames, state):
        yield from run_rules(key, frames, state, expire_hours)

    return matched.groupBy(*STREAM).applyInPandasWithState(run, RESULT, STATE, "append", timeout)


__all__ = ["SCOPE", "monitor", "rule_1", "run_rules"]
