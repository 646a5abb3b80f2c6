"""Star enrichment: a fact joined to its dimensions, with deviation and specification flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.formulas import compliance, month, shift_instance


def with_flags(df: DataFrame) -> DataFrame:
    """df with deviation_from_target, below_lsl, above_usl, is_oos, compliance_status."""
    return df.select("*", (F.col("measured_value") - F.col("target")).alias("deviation_from_target"), *compliance())


def enrich_stream(stream: DataFrame) -> DataFrame:
    """An ordered stream with flags and the concrete shift of every measurement."""
    return with_flags(stream).withColumn("shift_instance", shift_instance())


def enrich_star(tables: dict[str, DataFrame]) -> DataFrame:
    """fact, cabin, batch, nation, booth, point and spec joined on their keys.

    Dimensions are joined in the order of the hierarchy, so the large fact is joined once with the large cabin side
    and otherwise with whatever Spark finds small enough to broadcast."""
    place = tables["batch"].join(tables["nation"], "nation_id").join(tables["booth"], "booth_id")
    cabins = tables["cabin"].join(place, "batch_id")
    joined = tables["fact"].join(cabins, "cabin_id").join(tables["point"], "part_id").crossJoin(F.broadcast(tables["spec"].limit(1)))
    return with_flags(joined.withColumn("production_date", F.to_date("production_timestamp")))


def enrich(measurements: DataFrame, cabins: DataFrame, batches: DataFrame, shifts: DataFrame, booths: DataFrame, points: DataFrame, specifications: DataFrame) -> DataFrame:
    """The canonical seven tables joined; the result has the 29 enrichment columns and the shift's times."""
    joined = (
        measurements.drop("unit")
        .join(cabins, "cabin_id")
        .join(batches, "batch_id")
        .join(shifts.withColumnsRenamed({"start_time": "shift_start", "end_time": "shift_end"}), "shift_id")
        .join(booths.drop("description"), "booth_id")
        .join(points.drop("description"), "measurement_point_id")
        .join(specifications, "specification_id")
        .withColumn("production_date", F.to_date("production_timestamp"))
    )
    return with_flags(joined).withColumn("shift_instance", shift_instance())


# The column contracts.
#: What later models may use of the enriched measurements.
STAGING = (
    "measurement_id", "cabin_id", "batch_id", "shift_id", "shift_name", "booth_id", "booth_name", "production_timestamp", "production_date",
    "measurement_timestamp", "measurement_point_id", "point_code", "component", "side", "point_number", "specification_id", "characteristic",
    "unit", "lsl", "target", "usl", "measured_value", "deviation_from_target", "below_lsl", "above_usl", "is_oos",
)
#: All enrichment columns.
ENRICHED = (*STAGING, "compliance_status", "batch_start", "batch_end")
#: The row-level mart of control results.
MART_SPC = (
    "measurement_id", "production_date", "booth_name", "point_code", "characteristic", "unit", "measured_value", "is_oos", "shift_instance",
    "shift_id", "shift_name", "rule_1", "rule_2", "rule_3", "rule_4", "spc_signal", "baseline_id", "spc_evaluation_status",
)


#: The input of capability studies; drift studies have the deviation too.
CAPABILITY_INPUT = (
    "measurement_id", "measurement_timestamp", "production_timestamp", "production_month", "shift_instance", "shift_id", "shift_name", "booth",
    "measurement_point", "characteristic", "unit", "lsl", "target", "usl", "measured_value", "below_lsl", "above_usl", "is_oos", "rule_1", "rule_2",
    "rule_3", "rule_4", "spc_signal", "baseline_id", "spc_evaluation_status",
)
DRIFT_INPUT = (*CAPABILITY_INPUT[:15], "deviation_from_target", *CAPABILITY_INPUT[15:])


def contract(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df with just these columns; one that is missing is an error."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*columns)


def staging(enriched: DataFrame) -> DataFrame:
    return contract(enriched, STAGING)


def capability_input(enriched: DataFrame, results: DataFrame, booth: str, point: str, characteristic: str, unit: str, limits: tuple | None = None) -> DataFrame:
    """One scope's measurements with their control results; limits: the (lsl, target, usl) that they must have."""
    scope = (F.col("booth_name") == booth) & (F.col("point_code") == point) & (F.col("characteristic") == characteristic) & (F.col("unit") == unit)
    for name, value in zip(("lsl", "target", "usl"), limits or ()):
        scope = scope & (F.col(name) == F.lit(value).cast("decimal(10,3)"))
    own = ["rule_1", "rule_2", "rule_3", "rule_4", "spc_signal", "baseline_id", "spc_evaluation_status"]
    measured = enriched.where(scope).withColumn("production_month", month("production_timestamp"))
    joined = measured.join(results.select("measurement_id", *own), "measurement_id").withColumnsRenamed({"booth_name": "booth", "point_code": "measurement_point"})
    return contract(joined, CAPABILITY_INPUT)


def drift_input(capability: DataFrame) -> DataFrame:
    return contract(capability.withColumn("deviation_from_target", F.col("measured_value") - F.col("target")), DRIFT_INPUT)


def mart_spc(staged: DataFrame, results: DataFrame, booth: str, point: str, characteristic: str, unit: str) -> DataFrame:
    """The scope's measurements with their control results, which are taken as they are."""
    scope = (F.col("booth_name") == booth) & (F.col("point_code") == point) & (F.col("characteristic") == characteristic) & (F.col("unit") == unit)
    own = ["shift_instance", "rule_1", "rule_2", "rule_3", "rule_4", "spc_signal", "baseline_id", "spc_evaluation_status"]
    return contract(staged.where(scope).join(results.select("measurement_id", *own), "measurement_id"), MART_SPC)
