"""Rules of a baseline's life as violation queries: what a database would refuse is a row here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.formulas import D2, MR_UCL_FACTOR
from millrace.operators.baseline import SCOPE

TOLERANCE = "0.000003"
_IDENTITY = ["baseline_id", *SCOPE, "version"]
_APPROVED = ["window_start", "window_end", "effective_from", "approved_by", "approved_at", "n_observations", "n_valid_mr", "center_line", "sigma", "i_lcl", "i_ucl", "mr_center", "mr_ucl", "source_query_hash", "supersedes_baseline_id"]


def _near(a: Column, b: Column) -> Column:
    return F.abs(a.cast("decimal(24,9)") - b.cast("decimal(24,9)")) <= F.lit(TOLERANCE).cast("decimal(24,9)")


def row_checks() -> dict[str, Column]:
    """What must hold in each row."""
    c = F.col
    approved = c("status").isin("ACTIVE", "RETIRED")
    blank = F.coalesce(F.trim(c("approved_by")), F.lit("")) == ""
    period = F.when(c("effective_from").isNull(), c("effective_to").isNull()).otherwise((c("effective_from") >= c("window_end")) & (c("effective_to").isNull() | (c("effective_to") > c("effective_from"))))
    sigma, mr = c("sigma").cast("decimal(24,9)"), c("mr_center").cast("decimal(24,9)")
    return {
        "version": c("version") >= 1,
        "status": c("status").isin("DRAFT", "ACTIVE", "RETIRED"),
        "window": c("window_end") > c("window_start"),
        "effective_period": period,
        "active_effective_from": (c("status") != "ACTIVE") | c("effective_from").isNotNull(),
        "retired_effective_to": (c("status") != "RETIRED") | c("effective_to").isNotNull(),
        "active_approval": ~approved | (~blank & c("approved_at").isNotNull()),
        "counts": (c("n_observations") >= 2) & (c("n_valid_mr") >= 1) & (c("n_valid_mr") < c("n_observations")),
        "i_chart_limits": _near(c("sigma") * F.lit(str(D2)).cast("decimal(6,3)"), mr) & _near(c("i_lcl"), c("center_line") - 3 * sigma) & _near(c("i_ucl"), c("center_line") + 3 * sigma),
        "mr_limits": _near(c("mr_ucl"), F.lit(str(MR_UCL_FACTOR)).cast("decimal(6,3)") * mr),
        "not_self": c("supersedes_baseline_id").isNull() | (c("supersedes_baseline_id") != c("baseline_id")),
    }


def constraint_violations(baselines: DataFrame) -> DataFrame:
    """(baseline_id, check) for every row check that fails."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in row_checks().items()]))
    return baselines.select("baseline_id", F.explode(names).alias("check"))


def set_violations(baselines: DataFrame) -> DataFrame:
    """(baseline_id, check): versions that occur twice in a scope, more than one active in a scope."""
    ids = F.explode("ids").alias("baseline_id")
    several = lambda keys, rows, name: rows.groupBy(*keys).agg(F.collect_list("baseline_id").alias("ids")).where("size(ids) > 1").select(ids, F.lit(name).alias("check"))
    return several([*SCOPE, "version"], baselines, "unique_version").unionByName(several(SCOPE, baselines.where("status = 'ACTIVE'"), "one_active"))


def supersession_violations(baselines: DataFrame) -> DataFrame:
    """(baseline_id, check): a predecessor must exist in the same scope and have a lower version."""
    before = baselines.select(F.col("baseline_id").alias("_before"), *[F.col(k).alias(f"_{k}") for k in SCOPE], F.col("version").alias("_version"))
    joined = baselines.where("supersedes_baseline_id is not null").join(before, F.col("supersedes_baseline_id") == F.col("_before"), "left")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in SCOPE])
    check = F.when(~F.coalesce(same, F.lit(False)), "same_scope").when(F.col("_version") >= F.col("version"), "lower_version")
    return joined.select("baseline_id", check.alias("check")).where("check is not null")


def transition_violations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(baseline_id, check) for changes from old to new that may not be published."""
    cols = ["status", "effective_to", *[c for c in _IDENTITY if c != "baseline_id"], *_APPROVED]
    side = lambda df, p: df.select("baseline_id", *[F.col(c).alias(f"{p}{c}") for c in cols], F.lit(True).alias(f"{p}here"))
    j = side(old, "o_").join(side(new, "n_"), "baseline_id", "full")
    changed = lambda names: reduce(lambda a, b: a | b, [~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")) for c in names])
    both, approved = F.col("o_here").isNotNull() & F.col("n_here").isNotNull(), F.col("o_status") != "DRAFT"
    gone = F.col("o_here").isNotNull() & F.col("n_here").isNull()
    lifecycle = (F.col("o_status") == "ACTIVE") & (~F.col("n_status").isin("ACTIVE", "RETIRED") | (~F.col("o_effective_to").eqNullSafe(F.col("n_effective_to")) & F.col("o_effective_to").isNotNull()))
    retired = (F.col("o_status") == "RETIRED") & changed(["status", "effective_to"])
    checks = {
        "immutable_version": both & changed([c for c in _IDENTITY if c != "baseline_id"]),
        "immutable_approved": (approved & gone) | (both & approved & changed(_APPROVED)),
        "lifecycle": both & (lifecycle | retired),
    }
    names = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in checks.items()]))
    return j.select("baseline_id", F.explode(names).alias("check"))


def publish(old: DataFrame | None, new: DataFrame, path: str) -> None:
    """Writes new as a copy if nothing forbids it; a reader never sees half of it."""
    bad = constraint_violations(new).unionByName(set_violations(new)).unionByName(supersession_violations(new))
    if old is not None:
        bad = bad.unionByName(transition_violations(old, new))
    found = bad.orderBy("baseline_id", "check").limit(20).collect()
    if found:
        raise ValueError(f"baselines not published: {[tuple(r) for r in found]}")
    new.write.mode("errorifexists").parquet(path)
