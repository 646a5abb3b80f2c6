"""The named relations as temporary views, each over the one before; nothing is computed until a view is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import enrich, quality, rules


def create(spark: SparkSession, tables: dict[str, DataFrame], baselines: DataFrame, zone: str = "Europe/Budapest", booth: str = "BOOTH_01", point: str = "A-L1") -> dict[str, DataFrame]:
    """Registers and returns the thirteen views.  booth and point: the stream of the scoped views."""
    t = tables
    measured = enrich.enrich(t["fact_quality_measurement"], t["dim_cabin"], t["dim_batch"], t["dim_shift"], t["dim_booth"], t["dim_measurement_point"], t["dim_specification"])
    results = rules.spc_results(measured, baselines, zone)
    scoped = rules.spc_results(measured, baselines, zone, booth, point)
    day = ["production_date"]
    where, when = ["booth_id", "booth_name"], ["shift_id", "shift_name"]
    batch = quality.batch_quality(measured, ["batch_id", *where, *when, *day])
    robots = t["dim_robot"].join(t["dim_track_axis"], "track_axis_id").join(t["dim_booth"].select("booth_id", "booth_name"), "booth_id").withColumnsRenamed({"booth_id": "robot_booth_id", "booth_name": "robot_booth_name"})
    first = t["dim_specification"].orderBy("specification_id").first()
    inputs = enrich.capability_input(measured, scoped, booth, point, first["characteristic"], first["unit"])
    views = {
        "v_measurement_enriched": measured,
        "v_spc_rule_results": rules.result_columns(results),
        "v_spc_rule_results_scoped": rules.short_names(rules.result_columns(scoped)),
        "v_capability_measurements": inputs,
        "v_drift_shift_measurements": enrich.drift_input(inputs),
        "v_production_volume": quality.production_volume(measured, [*day, *when, *where]),
        "v_cabin_quality": quality.grouped(measured, ["cabin_id", "batch_id", *where, *when, *day]),
        "v_batch_quality": batch,
        "v_booth_quality_daily": quality.grouped(measured, [*day, *where], *quality.distincts("batch", "cabin")),
        "v_shift_quality_daily": quality.grouped(measured, [*day, *when], *quality.distincts("batch", "cabin")),
        "v_measurement_point_quality": quality.grouped(measured, ["measurement_point_id", "point_code", "component", "side", "point_number"]),
        "v_robot_attribution_quality": quality.robot_attribution(measured, t["bridge_measurement_robot"], robots),
        "v_event_evaluation_context": quality.event_context(t["fact_process_event"], t["dim_booth"].select("booth_id", "booth_name"), batch),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views
