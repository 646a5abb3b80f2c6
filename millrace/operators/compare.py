"""Table-to-table reconciliation on a primary key: one full outer join, counts and bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that a key may have: they have one order and equality on every platform.
KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.BooleanType)
STATES = ("MATCHED", "SOURCE_ONLY", "TARGET_ONLY", "DIFFERENT")


class SchemaMismatch(ValueError):
    pass


def check_schemas(source: DataFrame, target: DataFrame, key: list[str]) -> None:
    """Both sides need the same columns with the same kinds of types; decimals compare by value."""
    kind = lambda t: "decimal" if isinstance(t, T.DecimalType) else t.simpleString()
    a, b = ({f.name: kind(f.dataType) for f in x.schema.fields} for x in (source, target))
    if not key:
        raise SchemaMismatch("a primary key is needed")
    if missing := [k for k in key if k not in a or k not in b]:
        raise SchemaMismatch(f"missing key columns: {missing}")
    if a != b:
        raise SchemaMismatch(f"columns differ: {sorted(set(a.items()) ^ set(b.items()))}")
    if bad := [f.name for f in source.schema.fields if f.name in key and not isinstance(f.dataType, KEY_TYPES)]:
        raise SchemaMismatch(f"not admissible as key: {bad}")
    if bad := [f.name for f in source.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]:
        raise SchemaMismatch(f"nested columns cannot be compared: {bad}")


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """(check, violations) for keys that are null or repeated, and numbers that are not finite."""
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    odd = F.lit(False)
    for c in doubles:
        odd = odd | F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(False))
    count = lambda name, rows: rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))
    return count("null_key", df.where(null)).unionByName(count("duplicate_key", df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))).unionByName(count("not_finite", df.where(odd)))


def differences(source: DataFrame, target: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row for each key: its state and the names of fields that differ (NULL equals NULL)."""
    if columns is not None:
        source, target = source.select(*columns), target.select(*columns)
    check_schemas(source, target, key)
    fields = [c for c in source.columns if c not in key]
    side = lambda df, p: df.select(*key, *[F.col(c).alias(f"{p}{c}") for c in fields], F.lit(True).alias(f"{p}here"))
    joined = side(source, "_s_").join(side(target, "_t_"), key, "full")
    names = F.array_compact(F.array(*[F.when(~F.col(f"_s_{c}").eqNullSafe(F.col(f"_t_{c}")), F.lit(c)) for c in fields])) if fields else F.array().cast("array<string>")
    state = F.when(F.col("_t_here").isNull(), "SOURCE_ONLY").when(F.col("_s_here").isNull(), "TARGET_ONLY").when(F.size(names) > 0, "DIFFERENT").otherwise("MATCHED")
    return joined.select(*key, state.alias("state"), F.when(state == "DIFFERENT", F.concat_ws(",", names)).alias("fields"))


def report(found: DataFrame) -> DataFrame:
    """Counts of states and the verdict."""
    counts = [F.count(F.when(F.col("state") == s, 1)).alias(s.lower()) for s in STATES]
    out = found.agg(F.count(F.lit(1)).alias("compared"), *counts)
    return out.withColumn("verdict", F.when(F.col("compared") == F.col("matched"), "PASS").otherwise("FAIL"))


def checked_report(source: DataFrame, target: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """The report with `complete` and `error`: keys that are null or repeated, or numbers that are not finite, make a
    comparison incomplete, and an incomplete one fails."""
    if columns is not None:
        source, target = source.select(*columns), target.select(*columns)
    bad = key_violations(source, key).withColumn("side", F.lit("source")).unionByName(key_violations(target, key).withColumn("side", F.lit("target")))
    errors = bad.where("violations > 0").agg(F.concat_ws(", ", F.array_sort(F.collect_list(F.concat_ws(" ", "side", "check")))).alias("error"))
    out = report(differences(source, target, key)).crossJoin(F.broadcast(errors))
    return out.withColumns({"complete": F.col("error") == "", "verdict": F.when(F.col("error") == "", F.col("verdict")).otherwise("FAIL"), "error": F.nullif(F.col("error"), F.lit(""))})


def for_each_difference(found: DataFrame, key: list[str], f) -> int:
    """Calls f with each difference, in key order, a partition at a time; an error of f ends the comparison.  The number
    of calls."""
    n = 0
    for row in found.where("state <> 'MATCHED'").orderBy(*key).toLocalIterator():
        f(row.asDict())
        n += 1
    return n


def in_utc(df: DataFrame) -> DataFrame:
    """Instants as wall time in UTC, so that both sides of a comparison show them alike; local times stay what they are
    and differ from instants by their type."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: epoch + F.make_dt_interval(secs=(F.unix_micros(c) / 1_000_000).cast("decimal(18,6)")) for c in cols}) if cols else df


def samples(found: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    """The first n differences in key order; a sample report, so a limit is its meaning."""
    return found.where("state <> 'MATCHED'").orderBy(*key).limit(n)


def compare_tables(spark, source: str, target: str, key: list[str], columns: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """The report for two tables of the catalog; rename: target's names to source's."""
    for name in (source, target):
        if not spark.catalog.tableExists(name):
            raise SchemaMismatch(f"no table {name}")
    right = spark.table(target).withColumnsRenamed(rename or {})
    return report(differences(spark.table(source), right, key, columns))
