"""A synthetic production period as canonical tables, made by Spark.

Every draw is a function of (seed, purpose, row id), so a recomputed partition gives the same rows, and the data do
not depend on the number of partitions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import SCHEMAS

# The plant, its calendar and its special causes.
BOOTHS = ("BOOTH_01", "BOOTH_02")
BATCHES_PER_SHIFT = 4
CABINS_PER_BATCH = 5
BATCH_BOOTHS = (1, 1, 2, 2)
ROBOT_COUNTS = ((1, 0.15), (2, 0.45), (3, 0.30), (4, 0.10))
SHIFTS = (("SHIFT_01", "06:00:00", "14:00:00"), ("SHIFT_02", "14:00:00", "22:00:00"), ("SHIFT_03", "22:00:00", "06:00:00"))
POINT_GROUPS = (("A", "A_PILLAR", "LEFT", 3), ("A", "A_PILLAR", "RIGHT", 3), ("B", "B_PILLAR", "LEFT", 3), ("B", "B_PILLAR", "RIGHT", 3), ("T", "UPPER_CONNECTING_ELEMENT", "LEFT", 1), ("T", "UPPER_CONNECTING_ELEMENT", "RIGHT", 1), ("C", "A_B_CONNECTING_ELEMENT", "LEFT", 2), ("C", "A_B_CONNECTING_ELEMENT", "RIGHT", 2))
SPECIFICATION = ("Coating Thickness", "um", "70.000", "75.000", "80.000")
MEAN, SD, POINT_SD, ROBOT_SD = 75.0, 1.2, 0.3, 0.25
BOOTH_EFFECT = (-0.2, 0.2)
#: type, booth, first day, last day, severity, description, size, number of outliers
EVENTS = (
    ("PROCESS_DRIFT", 1, "2026-02-02", "2026-02-13", "MEDIUM", "Slow rise of the mean in booth 1", 2.5, 0),
    ("PROCESS_SHIFT", 2, "2026-03-09", "2026-03-20", "HIGH", "Sudden fall of the mean in booth 2", -2.2, 0),
    ("INCREASED_VARIATION", 1, "2026-04-06", "2026-04-17", "MEDIUM", "Wider spread in booth 1", 3.0, 0),
    ("SPECIFICATION_VIOLATION", 2, "2026-05-04", "2026-05-05", "HIGH", "Readings below the lower limit in booth 2", -7.0, 0),
    ("SPECIFICATION_VIOLATION", 1, "2026-06-15", "2026-06-15", "HIGH", "Readings above the upper limit in booth 1", 6.5, 0),
    ("OUTLIER", 1, "2026-01-20", "2026-01-20", "LOW", "Single extreme readings in booth 1", 9.0, 3),
    ("OUTLIER", 2, "2026-02-25", "2026-02-25", "LOW", "Single extreme readings in booth 2", -8.5, 3),
    ("OUTLIER", 2, "2026-04-29", "2026-04-29", "LOW", "Single extreme readings in booth 2", 8.0, 4),
    ("OUTLIER", 1, "2026-06-03", "2026-06-03", "LOW", "Single extreme readings in booth 1", -9.5, 3),
)


@dataclass(frozen=True)
class Period:
    first: str = "2026-01-01"
    last: str = "2026-06-30"
    day_off: int = 1  # of dayofweek(): Sunday
    seed: int = 42


def uniform(seed: int, purpose: str, *ids: str | Column) -> Column:
    """In (0, 1), the same for the same ids."""
    h = F.xxhash64(F.lit(seed), F.lit(purpose), *ids)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(seed: int, purpose: str, *ids: str | Column) -> Column:
    """Box-Muller on two uniform draws."""
    return F.sqrt(-2 * F.log(uniform(seed, f"{purpose}-r", *ids))) * F.cos(2 * math.pi * uniform(seed, f"{purpose}-a", *ids))


def dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    make = lambda rows, name: spark.createDataFrame(rows, SCHEMAS[name].replace("decimal(10,3)", "string"))
    points = [(f"{code}-{side[0]}{k}", component, side, k) for code, component, side, n in POINT_GROUPS for k in range(1, n + 1)]
    booths = make([(i, b, f"Coating booth {i}") for i, b in enumerate(BOOTHS, 1)], "dim_booth")
    # Children name their parents; the ids are looked up.
    tracks = spark.createDataFrame([(a, f"TRACK_{a:02}", BOOTHS[(a - 1) // 2]) for a in range(1, 5)], "track_axis_id int, track_name string, booth_name string")
    axes = tracks.join(F.broadcast(booths.select("booth_name", "booth_id")), "booth_name").select("track_axis_id", "booth_id", "track_name")
    named = spark.createDataFrame([(r, f"TRACK_{(r + 1) // 2:02}", f"ROBOT_{r:02}", "six-axis coating robot", "ACTIVE") for r in range(1, 9)], "robot_id int, track_name string, robot_name string, robot_type string, status string")
    robots = named.join(F.broadcast(axes.select("track_name", "track_axis_id")), "track_name").select("robot_id", "track_axis_id", "robot_name", "robot_type", "status")
    spec = make([(1, *SPECIFICATION)], "dim_specification")
    return {
        "dim_booth": booths,
        "dim_track_axis": axes,
        "dim_robot": robots,
        "dim_shift": make([(i, *s) for i, s in enumerate(SHIFTS, 1)], "dim_shift"),
        "dim_measurement_point": make([(i, *p, f"{p[1].lower()} point {p[3]}") for i, p in enumerate(points, 1)], "dim_measurement_point"),
        "dim_specification": spec.withColumns({c: F.col(c).cast("decimal(10,3)") for c in ("lsl", "target", "usl")}),
    }


def calendar(spark: SparkSession, period: Period) -> DataFrame:
    """(day, day_number): production days, numbered from 0."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(period.first).cast("date"), F.lit(period.last).cast("date"))).alias("day")).where(F.dayofweek("day") != period.day_off)
    off = F.expr(f"size(filter(sequence(date'{period.first}', day), d -> dayofweek(d) <> {period.day_off})) - 1")
    return days.select("day", off.cast("long").alias("day_number"))


def batches(spark: SparkSession, period: Period, shifts: DataFrame) -> DataFrame:
    """dim_batch with the booth that a batch goes through."""
    start = F.to_timestamp_ntz(F.concat(F.col("day").cast("string"), F.lit(" "), F.col("start_time")))
    hours = F.expr("pmod(hour(to_timestamp(end_time, 'HH:mm:ss')) - hour(to_timestamp(start_time, 'HH:mm:ss')), 24)")
    seconds = (hours * 3600 / BATCHES_PER_SHIFT).cast("int")
    each = calendar(spark, period).crossJoin(F.broadcast(shifts)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(BATCHES_PER_SHIFT - 1))))
    after = lambda k: start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * seconds).cast("decimal(18,6)"))
    per_day = len(SHIFTS) * BATCHES_PER_SHIFT
    return each.select(
        (F.col("day_number") * per_day + (F.col("shift_id") - 1) * BATCHES_PER_SHIFT + F.col("k") + 1).alias("batch_id"), "shift_id", after(F.col("k")).alias("batch_start"), after(F.col("k") + 1).alias("batch_end"),
        F.element_at(F.array(*map(F.lit, BATCH_BOOTHS)), F.col("k") % len(BATCH_BOOTHS) + 1).alias("booth_id"),
    )


def cabins(batch: DataFrame, period: Period) -> DataFrame:
    """Evenly spaced cabins with half a minute of jitter either way."""
    each = batch.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(CABINS_PER_BATCH - 1)))).withColumn("cabin_id", (F.col("batch_id") - 1) * CABINS_PER_BATCH + F.col("k") + 1)
    length = F.unix_timestamp(F.col("batch_end").cast("timestamp")) - F.unix_timestamp(F.col("batch_start").cast("timestamp"))
    at = (F.col("k") + 0.5) * length / CABINS_PER_BATCH + 60 * uniform(period.seed, "jitter", "cabin_id") - 30
    moment = F.col("batch_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), at.cast("decimal(18,6)"))
    return each.select("cabin_id", "batch_id", "booth_id", moment.alias("production_timestamp"))


def measurements(cabin: DataFrame, points: DataFrame, robots: DataFrame, axes: DataFrame, period: Period) -> DataFrame:
    """Every cabin at every point, with the array robot_ids of those that contributed."""
    s = period.seed
    pool = robots.join(axes, "track_axis_id").withColumn("effect", ROBOT_SD * normal(s, "robot", "robot_id")).groupBy("booth_id").agg(F.array_sort(F.collect_list(F.struct("robot_id", "effect"))).alias("pool"))
    n_points = sum(g[3] for g in POINT_GROUPS)
    df = cabin.crossJoin(F.broadcast(points.select("measurement_point_id", (POINT_SD * normal(s, "point", "measurement_point_id")).alias("point_effect")))).join(F.broadcast(pool), "booth_id")
    df = df.withColumn("measurement_id", (F.col("cabin_id") - 1) * n_points + F.col("measurement_point_id"))
    u, total, count = uniform(s, "count", "measurement_id"), 0.0, F.lit(ROBOT_COUNTS[-1][0])
    for n, share in reversed(ROBOT_COUNTS[:-1]):
        total = sum(w for k, w in ROBOT_COUNTS if k <= n)
        count = F.when(u < total, n).otherwise(count)
    # A random order of the pool: sorted by a draw for each (measurement, robot).
    drawn = F.array_sort(F.transform("pool", lambda r: F.struct(F.xxhash64(F.lit(s), F.lit("pick"), F.col("measurement_id"), r["robot_id"]).alias("h"), r["robot_id"].alias("robot_id"), r["effect"].alias("effect"))))
    df = df.withColumn("robots", F.slice(drawn, 1, count))
    robot_effect = F.aggregate("robots", F.lit(0.0), lambda a, r: a + r["effect"]) / F.size("robots")
    day = F.col("production_timestamp").cast("date")
    mean = MEAN + F.col("point_effect") + F.when(F.col("booth_id") == 1, BOOTH_EFFECT[0]).otherwise(BOOTH_EFFECT[1]) + robot_effect
    sd, pinned = F.lit(SD), F.lit(None).cast("double")
    for i, (kind, booth, first, last, _, _, size, count_) in enumerate(EVENTS):
        here = (F.col("booth_id") == booth) & day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        if kind == "PROCESS_DRIFT":
            mean = mean + F.when(here, size * F.datediff(day, F.lit(first)) / F.greatest(F.datediff(F.lit(last), F.lit(first)), F.lit(1))).otherwise(0.0)
        elif kind == "INCREASED_VARIATION":
            sd = F.when(here, size).otherwise(sd)
        elif kind == "OUTLIER":
            pinned = F.when(F.col(f"_pick_{i}"), F.lit(float(size))).otherwise(pinned)
        else:
            mean = mean + F.when(here, size).otherwise(0.0)
    for i, (kind, booth, first, last, _, _, _, count_) in enumerate(EVENTS):
        if kind == "OUTLIER":
            chosen = df.where((F.col("booth_id") == booth) & day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))).orderBy(F.xxhash64(F.lit(s), F.lit(f"outlier-{i}"), "measurement_id")).limit(count_)
            df = df.join(F.broadcast(chosen.select("measurement_id", F.lit(True).alias(f"_pick_{i}"))), "measurement_id", "left")
    value = F.greatest(F.lit(0.0), F.coalesce(mean + pinned, mean + sd * normal(s, "noise", "measurement_id")))
    return df.select("measurement_id", "cabin_id", "measurement_point_id", F.lit(1).alias("specification_id"), F.col("production_timestamp").alias("measurement_timestamp"), F.round(value, 3).cast("decimal(10,3)").alias("measured_value"), F.lit(SPECIFICATION[1]).alias("unit"), F.transform("robots", lambda r: r["robot_id"]).alias("robot_ids"))


def events(spark: SparkSession, batch: DataFrame) -> DataFrame:
    """The ground truth: a row for every batch of the booth that starts in a special cause's days."""
    rows = [(k, b, f, last, sev, text) for k, b, f, last, sev, text, _, _ in EVENTS]
    causes = spark.createDataFrame(rows, "event_type string, booth_id int, first_day string, last_day string, severity string, description string")
    hit = batch.join(F.broadcast(causes), "booth_id").where(F.col("batch_start").cast("date").between(F.col("first_day").cast("date"), F.col("last_day").cast("date")))
    from pyspark.sql import Window as W

    # A few hundred rows at most for each cause, so one ordering of them is small.
    number = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("batch_start", "batch_id", "description"))
    return hit.select(number.cast("long").alias("event_id"), F.col("batch_start").alias("event_timestamp"), "batch_id", "booth_id", "event_type", "description", "severity")


def generate(spark: SparkSession, period: Period = Period()) -> dict[str, DataFrame]:
    """All canonical tables."""
    t = dimensions(spark)
    batch = batches(spark, period, t["dim_shift"])
    cabin = cabins(batch, period)
    facts = measurements(cabin, t["dim_measurement_point"], t["dim_robot"], t["dim_track_axis"], period)
    return t | {
        "dim_batch": batch.drop("booth_id"),
        "dim_cabin": cabin,
        "fact_quality_measurement": facts.drop("robot_ids"),
        "bridge_measurement_robot": facts.select("measurement_id", F.explode("robot_ids").alias("robot_id")),
        "fact_process_event": events(spark, batch),
    }
