"""Bindings of given tables to the engine's canonical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scheduled shifts: id, name, start, end.
SHIFTS = ((1, "SHIFT_01", "06:00:00", "14:00:00"), (2, "SHIFT_02", "14:00:00", "22:00:00"), (3, "SHIFT_03", "22:00:00", "06:00:00"))
STREAM_SPEC = (1, "Event Value", "u", "1.000", "50.000", "150.000")
STAR_SPEC = (1, "Quantity", "pcs", "5.000", "25.000", "45.000")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spec(values: tuple) -> list:
    i, characteristic, unit, lsl, target, usl = values
    return [F.lit(i).alias("specification_id"), F.lit(characteristic).alias("characteristic"), F.lit(unit).alias("unit"), *(F.lit(v).cast("decimal(10,3)").alias(n) for v, n in ((lsl, "lsl"), (target, "target"), (usl, "usl")))]


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an ordered stream of measurements: one booth by user parity, one point by event type, two-hour batches."""
    hour = F.hour("ts") - F.hour("ts") % 2
    start = F.to_timestamp_ntz(F.concat(F.to_date("ts").cast("string"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00")))
    booth = (F.col("user_id") % 2 + 1).cast("int")
    pick = lambda k: F.when((hour >= 6) & (hour < 14), F.lit(SHIFTS[0][k])).when((hour >= 14) & (hour < 22), F.lit(SHIFTS[1][k])).otherwise(F.lit(SHIFTS[2][k]))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("measurement_id"),
        F.col("user_id").alias("cabin_id"),
        (F.datediff(F.to_date("ts"), F.lit("2000-01-01").cast("date")).cast("long") * 24 + hour * 2 + booth).alias("batch_id"),
        booth.alias("booth_id"),
        F.concat(F.lit("BOOTH_0"), booth.cast("string")).alias("booth_name"),
        (F.length("event_type") * 1000 + F.ascii("event_type")).cast("int").alias("measurement_point_id"),
        F.col("event_type").alias("point_code"),
        F.lit("EVENT").alias("component"),
        F.when(booth == 1, "LEFT").otherwise("RIGHT").alias("side"),
        F.length("event_type").alias("point_number"),
        *_spec(STREAM_SPEC),
        pick(0).alias("shift_id"),
        pick(1).alias("shift_name"),
        pick(2).alias("shift_start"),
        pick(3).alias("shift_end"),
        start.alias("batch_start"),
        (start + F.expr("INTERVAL '2' HOUR")).alias("batch_end"),
        F.col("ts").alias("production_timestamp"),
        F.to_date("ts").alias("production_date"),
        F.col("ts").alias("measurement_timestamp"),
        F.col("value").cast("decimal(10,3)").alias("measured_value"),
    )


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The canonical star: orders are cabins, customers batches, regions booths, brands points; no unique measurement id."""
    region, nation, customer, orders, part, lineitem = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "part", "lineitem"))
    return {
        "booth": region.select(F.col("r_regionkey").alias("booth_id"), F.col("r_name").alias("booth_name")),
        "batch": customer.select(F.col("c_custkey").alias("batch_id"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("shift_name")),
        "nation": nation.select(F.col("n_nationkey").alias("nation_id"), F.col("n_regionkey").alias("booth_id")),
        "cabin": orders.select(F.col("o_orderkey").alias("cabin_id"), F.col("o_custkey").alias("batch_id"), F.col("o_orderdate").alias("cabin_timestamp")),
        "point": part.select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("point_code"), F.col("p_type").alias("component")),
        "fact": lineitem.select(F.col("l_orderkey").alias("cabin_id"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("robot_id"), F.col("l_shipdate").alias("production_timestamp"), F.col("l_quantity").cast("decimal(10,3)").alias("measured_value")),
        "spec": spark.range(1).select(*_spec(STAR_SPEC)),
    }


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as robots on axes (nations) of booths (regions)."""
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("robot_id"), F.col("s_name").alias("robot_name"), F.col("n_nationkey").alias("track_axis_id"), F.col("n_name").alias("track_name"), F.col("r_regionkey").alias("robot_booth_id"), F.col("r_name").alias("robot_booth_name"))
    )
