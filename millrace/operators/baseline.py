"""Control-limit baselines: fit, persist, activate, and match to measurements by effective period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.formulas import D2, MR_UCL_FACTOR, instant

SCOPE = ["booth_id", "measurement_point_id", "specification_id"]
_INSTANCE = ["shift_id", "shift_instance"]
LIMITS = ("center_line", "sigma", "i_lcl", "i_ucl", "mr_center", "mr_ucl")


def baseline_window(enriched: DataFrame, days: int, skip: int = 0) -> DataFrame:
    """Per scope: window_start (the first shift instance plus skip days) and window_end (days later, exclusive)."""
    first = F.min("shift_instance")
    return enriched.groupBy(*SCOPE).agg((first + F.expr(f"INTERVAL '{skip}' DAY")).alias("window_start"), (first + F.expr(f"INTERVAL '{skip + days}' DAY")).alias("window_end"))


def in_window(enriched: DataFrame, window: DataFrame) -> DataFrame:
    return enriched.join(window, SCOPE).where((F.col("shift_instance") >= F.col("window_start")) & (F.col("shift_instance") < F.col("window_end")))


def moving_ranges(enriched: DataFrame, keys: list[str] = SCOPE + _INSTANCE) -> DataFrame:
    """enriched with moving_range: the distance to the measurement before in the same keys, NULL for the first."""
    order = W.partitionBy(*keys).orderBy("measurement_timestamp", "measurement_id")
    return enriched.withColumn("moving_range", F.abs(F.col("measured_value") - F.lag("measured_value").over(order)))


def fit(enriched: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """Limits by scope, as doubles.  Moving ranges never cross a shift instance."""
    center, mr = F.avg(F.col("measured_value").cast("double")), F.avg(F.col("moving_range").cast("double"))
    fitted = moving_ranges(enriched, [*keys, *_INSTANCE]).groupBy(*keys).agg(F.count("measured_value").alias("n_observations"), F.count("moving_range").alias("n_valid_mr"), center.alias("center_line"), mr.alias("mr_center"))
    sigma = F.col("mr_center") / D2
    return fitted.select(
        *keys, "n_observations", "n_valid_mr", "center_line", sigma.alias("sigma"), (F.col("center_line") - 3 * sigma).alias("i_lcl"), (F.col("center_line") + 3 * sigma).alias("i_ucl"), "mr_center", (F.col("mr_center") * MR_UCL_FACTOR).alias("mr_ucl")
    )


def fit_violations(enriched: DataFrame, keys: list[str] = SCOPE, scopes: int | None = None) -> DataFrame:
    """(check, violations) for what a fit's input must not have; all counts are 0 for a valid input.  scopes: how many
    the input may hold.  Local times must be without a zone, which is a matter of the schema."""
    if bad := [c for c in ("measurement_timestamp", "shift_instance") if dict(enriched.dtypes).get(c) != "timestamp_ntz"]:
        raise TypeError(f"local times without a zone are needed: {bad}")
    v = F.col("measured_value").cast("double")
    by_id = enriched.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n"))
    scoped = moving_ranges(enriched, [*keys, *_INSTANCE]).groupBy(*keys).agg(F.count("measured_value").alias("n"), F.count("moving_range").alias("mr"))
    limits = fit(enriched, keys)
    rows = enriched.agg(F.count(F.lit(1)).alias("n"))
    ints = [k for k in [*keys, "shift_id"]]
    one = lambda name, df: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))
    checks = [
        one("missing_value", enriched.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))),
        one("value_does_not_fit_numeric_10_3", enriched.where((F.abs(v) >= 1e7) | (F.abs(v * 1000 - F.round(v * 1000)) > 1e-6))),
        one("missing_key", enriched.where(" or ".join(f"{k} is null" for k in [*keys, *_INSTANCE, "measurement_id", "measurement_timestamp"]))),
        one("non_positive_id", enriched.where(" or ".join(f"{k} <= 0" for k in [*ints, "measurement_id"]))),
        one("id_does_not_fit_integer", enriched.where(" or ".join(f"cast({k} as long) > 2147483647" for k in ints))),
        one("duplicate_measurement_id", by_id.where("n > 1")),
        one("no_rows", rows.where("n = 0")),
        one("too_few_observations", scoped.where("n < 2")),
        one("no_moving_range", scoped.where("mr < 1")),
        one("limits_do_not_fit_numeric_14_6", limits.where(" or ".join(f"abs({c}) >= 100000000" for c in LIMITS))),
        one("too_many_scopes", scoped.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (scopes if scopes is not None else 1 << 62))),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def as_decimals(fitted: DataFrame) -> DataFrame:
    """Limits as decimal(14,6), rounded half up."""
    return fitted.withColumns({c: F.col(c).cast("decimal(14,6)") for c in LIMITS})


def fingerprint(enriched: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """SHA-256 by scope of the hashes of its shift instances, each of its canonical rows by id, whatever order they come
    in.  No task holds more than the rows of one shift instance, or a scope's hashes."""
    row = F.concat_ws("|", "measurement_id", F.date_format("measurement_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "shift_id", F.date_format("shift_instance", "yyyy-MM-dd HH:mm:ss"), F.col("measured_value").cast("decimal(10,3)").cast("string"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("measurement_id"), row.alias("row")))), lambda r: r["row"])
    instances = enriched.groupBy(*keys, *_INSTANCE).agg(F.sha2(F.concat_ws("\n", ordered), 256).alias("hash"))
    inner = F.transform(F.array_sort(F.collect_list(F.struct("shift_instance", "shift_id", "hash"))), lambda r: r["hash"])
    return instances.groupBy(*keys).agg(F.sha2(F.concat_ws("\n", inner), 256).alias("source_query_hash"))


def draft(fitted: DataFrame, window: DataFrame, hashes: DataFrame, known: DataFrame | None, zone: str) -> DataFrame:
    """New DRAFT versions for the fitted scopes: the version is one more than the scope's last."""
    rows = as_decimals(fitted).join(window, SCOPE).join(hashes, SCOPE)
    if known is not None:
        last = known.groupBy(*SCOPE).agg(F.max("version").alias("_last"), F.max_by("baseline_id", "version").alias("supersedes_baseline_id"))
        rows = rows.join(last, SCOPE, "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last")
    else:
        rows = rows.withColumns({"version": F.lit(1), "supersedes_baseline_id": F.lit(None).cast("long")})
    return rows.withColumns({"status": F.lit("DRAFT"), "effective_from": F.lit(None).cast("timestamp"), "effective_to": F.lit(None).cast("timestamp"), "approved_by": F.lit(None).cast("string"), "approved_at": F.lit(None).cast("timestamp")}).withColumns({"window_start": instant("window_start", zone), "window_end": instant("window_end", zone)})


def activate(drafts: DataFrame, approver: str) -> DataFrame:
    """Drafts in force from the end of their window on."""
    return drafts.withColumns({"status": F.lit("ACTIVE"), "effective_from": F.col("window_end"), "approved_at": F.col("window_end"), "approved_by": F.lit(approver)})


# ---------------------------------------------------------------- effective period lookup


def _usable(baselines: DataFrame) -> DataFrame:
    keep = ["baseline_id", *SCOPE, "version", "effective_from", "effective_to", *LIMITS]
    return baselines.where(F.col("status").isin("ACTIVE", "RETIRED") & F.col("effective_from").isNotNull()).select(*keep)


def _latest() -> list:
    return [F.desc("effective_from"), F.desc("version"), F.desc("baseline_id")]


def effective_by_row(stream: DataFrame, baselines: DataFrame, zone: str) -> DataFrame:
    """Each measurement with the latest baseline in force: all matches are joined and the first is kept."""
    b = _usable(baselines)
    now = instant("measurement_timestamp", zone)
    joined = stream.withColumn("_now", now).join(b, SCOPE, "left")
    hit = (F.col("effective_from") <= F.col("_now")) & (F.col("effective_to").isNull() | (F.col("_now") < F.col("effective_to")))
    ranked = joined.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_rank", F.row_number().over(W.partitionBy("measurement_id").orderBy(F.desc("_hit"), *_latest())))
    kept = ranked.where("_rank = 1")
    return kept.withColumns({c: F.when(F.col("_hit"), F.col(c)) for c in ("baseline_id", *LIMITS)}).drop("_rank", "_now", "_hit", "version", "effective_from", "effective_to")


def winners(baselines: DataFrame) -> DataFrame:
    """The baseline table cut at every instant where one comes into force or ends: of each piece the latest baseline
    remains, so a measurement has one match at most."""
    b = _usable(baselines)
    ends = b.select(*SCOPE, F.col("effective_from").alias("since")).unionByName(b.where("effective_to is not null").select(*SCOPE, F.col("effective_to").alias("since"))).distinct()
    pieces = ends.withColumn("until", F.lead("since").over(W.partitionBy(*SCOPE).orderBy("since")))
    covering = pieces.join(b, SCOPE).where((F.col("effective_from") <= F.col("since")) & (F.col("effective_to").isNull() | (F.col("since") < F.col("effective_to"))))
    first = covering.withColumn("_rank", F.row_number().over(W.partitionBy(*SCOPE, "since").orderBy(*_latest()))).where("_rank = 1")
    return first.select(*SCOPE, "since", "until", "baseline_id", *LIMITS)


def effective(stream: DataFrame, baselines: DataFrame, zone: str) -> DataFrame:
    """effective_by_row without its sort by measurement: a left join with three keys and a period as residual."""
    pieces = winners(baselines).withColumnsRenamed({k: f"_b_{k}" for k in SCOPE})
    now = instant("measurement_timestamp", zone)
    match = (F.col("since") <= now) & (F.col("until").isNull() | (now < F.col("until")))
    for k in SCOPE:
        match = match & (F.col(k) == F.col(f"_b_{k}"))
    return stream.join(pieces, match, "left").drop("since", "until", *[f"_b_{k}" for k in SCOPE])
