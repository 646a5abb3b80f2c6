"""Typed sources and sinks: CSV with a fixed schema, guarded loads, JDBC scans, JSON reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.store import file_system

#: Schemas of the canonical tables, as DDL; times of day are strings HH:mm:ss.
SCHEMAS: dict[str, str] = {
    "dim_booth": "booth_id int, booth_name string, description string",
    "dim_track_axis": "track_axis_id int, booth_id int, track_name string",
    "dim_robot": "robot_id int, track_axis_id int, robot_name string, robot_type string, status string",
    "dim_shift": "shift_id int, shift_name string, start_time string, end_time string",
    "dim_batch": "batch_id bigint, shift_id int, batch_start timestamp_ntz, batch_end timestamp_ntz",
    "dim_cabin": "cabin_id bigint, batch_id bigint, booth_id int, production_timestamp timestamp_ntz",
    "dim_measurement_point": "measurement_point_id int, point_code string, component string, side string, point_number int, description string",
    "dim_specification": "specification_id int, characteristic string, unit string, lsl decimal(10,3), target decimal(10,3), usl decimal(10,3)",
    "fact_quality_measurement": "measurement_id bigint, cabin_id bigint, measurement_point_id int, specification_id int, measurement_timestamp timestamp_ntz, measured_value decimal(10,3), unit string",
    "bridge_measurement_robot": "measurement_id bigint, robot_id int",
    "fact_process_event": "event_id bigint, event_timestamp timestamp_ntz, batch_id bigint, booth_id int, event_type string, description string, severity string",
}
#: Loading order: parents first.
ORDER = tuple(SCHEMAS)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV with a header; the schema is given, never inferred, and a bad line is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header; for tables that are small by nature."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def read_extract(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A database extract as CSV: booleans are t and f, times are ISO; what is neither is NULL, as an empty field is."""
    fields = T.StructType.fromDDL(schema).fields
    raw = read_csv(spark, path, T.StructType([T.StructField(f.name, T.StringType()) for f in fields]))
    flag = lambda c: F.when(F.lower(F.trim(c)).isin("t", "true"), True).when(F.lower(F.trim(c)).isin("f", "false"), False)
    return raw.select(*[(flag(F.col(f.name)) if isinstance(f.dataType, T.BooleanType) else F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})")).alias(f.name) for f in fields])


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def load(spark: SparkSession, folder: str, out: str, tables: tuple[str, ...] = ORDER, check=None) -> DataFrame:
    """Reads folder's CSV tables, checks them and writes them as Parquet; nothing is written if a target has rows or a
    check finds violations.  All tables are written aside first and moved in one go at the end, and taken back if a move
    fails, so a failed load leaves no table behind and can be run again.  Returns (table_name, staged, loaded)."""
    fs, _ = file_system(spark, out)
    path = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    for t in tables:
        if fs.exists(path(f"{out}/{t}.parquet")):
            raise FileExistsError(f"{t} has been loaded before")
    staged = {t: read_csv(spark, f"{folder}/{t}.csv", SCHEMAS[t]) for t in tables}
    if check is not None:
        bad = check(staged).where("violations > 0").collect()
        if bad:
            raise ValueError(f"not loaded: {[(r['check'], r['violations']) for r in bad]}")
    aside, moved = f"{out}/_loading-{uuid.uuid4().hex}", []
    try:
        for t in tables:
            staged[t].write.mode("errorifexists").parquet(f"{aside}/{t}.parquet")
        for t in tables:
            if not fs.rename(path(f"{aside}/{t}.parquet"), path(f"{out}/{t}.parquet")):
                raise OSError(f"{t} could not be moved into place")
            moved.append(t)
    except BaseException:
        for t in moved:
            fs.delete(path(f"{out}/{t}.parquet"), True)
        raise
    finally:
        fs.delete(path(aside), True)
    rows = None
    for t in tables:
        one = staged[t].agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("staged")).crossJoin(spark.read.parquet(f"{out}/{t}.parquet").agg(F.count(F.lit(1)).alias("loaded")))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def next_id(df: DataFrame, col: str) -> int:
    """What an identity sequence would give next."""
    return int(df.agg(F.max(col)).first()[0] or 0) + 1


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, columns: list[str] | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, fetch_size: int = 10_000, **properties: str) -> DataFrame:
    """A table over JDBC, fetched in pieces; with key and bounds as parallel ranges of the key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size).options(**properties)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    df = reader.load()
    if missing := [c for c in columns or [] if c not in df.columns]:
        raise ValueError(f"{table} lacks {missing}")
    return df.select(*columns) if columns else df


def rows_in_order(df: DataFrame, key: list[str]):
    """Rows in key order, a partition at a time: memory is bounded by one partition."""
    return df.orderBy(*key).toLocalIterator(prefetchPartitions=False)


def as_json(row: dict) -> str:
    return json.dumps(row, sort_keys=True, default=str)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON with its keys sorted and its nulls kept: `report`."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("report"))


def series(spark: SparkSession, first: int, last: int, step: int = 1) -> DataFrame:
    """The integers from first to last, both included: `value`."""
    return spark.range(first, last + 1, step).withColumnRenamed("id", "value")


def parameterised(spark: SparkSession, sql: str, **args) -> DataFrame:
    """A query with named parameters :name."""
    return spark.sql(sql, args=args)
