"""Generated tables, typed files, views and the streaming extension."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import baseline, checks, enrich, quality, rules
from millrace.plans import views
from millrace.sources import files, generate, store
from millrace.streaming import monitor


PERIOD = generate.Period(first="2026-01-16", last="2026-02-04")


@pytest.fixture(scope="module")
def plant(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("plant")
    for name, df in generate.generate(spark, PERIOD).items():
        df.coalesce(1).write.parquet(str(out / name))
    return {name: spark.read.parquet(str(out / name)) for name in files.ORDER}


def test_calendar(spark):
    days = generate.calendar(spark, generate.Period())
    assert days.count() == 155 and days.agg(F.max("day_number")).first()[0] == 154
    assert generate.batches(spark, generate.Period(), generate.dimensions(spark)["dim_shift"]).count() == 1860


def test_generated_tables_hold_their_invariants(spark, plant):
    assert {r["check"]: r["violations"] for r in checks.production_checks(plant).collect()} == {
        c: 0 for c in ("points_per_cabin", "robots_per_measurement", "contributors_do_not_vary", "robot_in_other_booth", "no_cross_track_measurement", "timestamp_is_not_the_cabins", "unit_is_not_the_specifications", "booths_per_batch", "cabins_per_batch", "cabin_outside_batch", "event_is_not_its_batchs", "robots_per_booth")
    }
    bad = plant | {"dim_cabin": plant["dim_cabin"].withColumn("booth_id", F.when(F.col("cabin_id") == 1, 2).otherwise(F.col("booth_id")))}
    assert sum(r["violations"] for r in checks.production_checks(bad).collect()) > 0


def test_generation_is_reproducible(spark, plant):
    again = generate.generate(spark, PERIOD)["fact_quality_measurement"]
    assert plant["fact_quality_measurement"].exceptAll(again).isEmpty()
    m = plant["fact_quality_measurement"].agg(F.avg("measured_value"), F.stddev("measured_value")).first()
    assert 74 < float(m[0]) < 76 and 1 < float(m[1]) < 2.5


def test_views(spark, plant, tmp_path):
    t = plant
    measured = enrich.enrich(t["fact_quality_measurement"], t["dim_cabin"], t["dim_batch"], t["dim_shift"], t["dim_booth"], t["dim_measurement_point"], t["dim_specification"])
    window = baseline.baseline_window(measured, 14)
    inside = baseline.in_window(measured, window)
    drafted = baseline.draft(baseline.fit(inside), window, baseline.fingerprint(inside), None, "Europe/Budapest").withColumn("baseline_id", F.col("booth_id").cast("long") * 100 + F.col("measurement_point_id"))
    baseline.activate(drafted, "quality").write.parquet(str(tmp_path / "limits"))
    limits = spark.read.parquet(str(tmp_path / "limits"))
    made = views.create(spark, plant, limits)
    assert len(made) == 13
    n = t["fact_quality_measurement"].count()
    assert spark.table("v_measurement_enriched").count() == n == spark.table("v_spc_rule_results").count()
    assert spark.sql("select sum(measurement_count) from v_production_volume").first()[0] == n
    assert spark.sql("select count(*) from v_measurement_point_quality").first()[0] == 18
    scoped = spark.table("v_spc_rule_results_scoped")
    whole = spark.table("v_spc_rule_results").where("booth = 'BOOTH_01' and measurement_point = 'A-L1'")
    cols = ["measurement_id", "rule_1", "rule_2", "rule_3", "rule_4", "spc_signal"]
    assert scoped.select(cols).exceptAll(whole.select(cols)).isEmpty() and scoped.count() == whole.count()
    assert scoped.where("spc_signal is null").count() > 0 < scoped.where("spc_signal is not null").count()
    assert all(r["violations"] == 0 for r in checks.rule_checks(rules.spc_results(measured, limits, "Europe/Budapest", "BOOTH_01", "A-L1")).collect())
    assert spark.table("v_event_evaluation_context").count() == t["fact_process_event"].count()
    days = quality.grouped(measured, ["production_date"])
    assert all(r["agrees"] for r in checks.totals({"day": days}, measured).collect())


def test_one_exchange_serves_all_windows(spark, tmp_path):
    cols = {"booth_id": "int", "measurement_point_id": "int", "specification_id": "int", "shift_id": "int", "shift_instance": "timestamp_ntz", "measurement_timestamp": "timestamp_ntz", "measurement_id": "long", "measured_value": "decimal(10,3)", "baseline_id": "long"} | {c: "decimal(14,6)" for c in baseline.LIMITS}
    empty = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in cols.items()))
    empty.write.parquet(str(tmp_path / "m"))
    matched = spark.read.parquet(str(tmp_path / "m"))
    plan = rules.apply_rules(matched)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(booth_id") == 1


def test_csv_load(spark, plant, tmp_path):
    small = {n: df.limit(50) if n == "dim_batch" else df for n, df in plant.items()}
    for n in ("dim_booth", "dim_shift", "dim_specification", "dim_batch"):
        files.write_csv(small[n], str(tmp_path / "in" / f"{n}.csv"))
    names = ("dim_booth", "dim_shift", "dim_specification", "dim_batch")
    rows = files.load(spark, str(tmp_path / "in"), str(tmp_path / "out"), names).collect()
    assert all(r["staged"] == r["loaded"] for r in rows) and len(rows) == 4
    back = spark.read.parquet(str(tmp_path / "out" / "dim_batch.parquet"))
    assert back.schema.simpleString() == spark.createDataFrame([], files.SCHEMAS["dim_batch"]).schema.simpleString()
    with pytest.raises(FileExistsError):
        files.load(spark, str(tmp_path / "in"), str(tmp_path / "out"), names)
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "in"), str(tmp_path / "other"), names, check=lambda t: checks.accepted(t["dim_booth"], "booth_name", ["X"]))
    assert files.next_id(back, "batch_id") == back.agg(F.max("batch_id")).first()[0] + 1
    assert files.empty(spark, files.SCHEMAS["dim_booth"]).count() == 0
    assert files.parameterised(spark, "select :a + 1 as x", a=2).first()["x"] == 3
    assert [r["booth_id"] for r in files.rows_in_order(plant["dim_booth"], ["booth_id"])] == [1, 2]


def test_streaming_rules_agree_with_batch(spark, tmp_path):
    import datetime as dt
    import random
    from decimal import Decimal

    rng, t0 = random.Random(3), dt.datetime(2026, 3, 2, 6)
    rows = [(1, p, 1, 1, t0, t0 + dt.timedelta(minutes=m), p * 1000 + m, Decimal(str(round(rng.gauss(0.8, 1.5), 3)))) for p in (1, 2) for m in range(60)]
    schema = "booth_id int, measurement_point_id int, specification_id int, shift_id int, shift_instance timestamp_ntz, measurement_timestamp timestamp_ntz, measurement_id long, measured_value decimal(10,3)"
    limits = {"center_line": "0", "sigma": "1", "i_lcl": "-3", "i_ucl": "3", "mr_center": "1.128", "mr_ucl": "3.685176"}
    b = spark.createDataFrame([(p, 1, p, 1, 1, "ACTIVE", t0 - dt.timedelta(days=2), None, *(Decimal(v) for v in limits.values())) for p in (1, 2)], "baseline_id long, booth_id int, measurement_point_id int, specification_id int, version int, status string, effective_from timestamp, effective_to timestamp, " + ", ".join(f"{c} decimal(14,6)" for c in limits))
    df = spark.createDataFrame(rows, schema)
    for i, part in enumerate((df.where("minute(measurement_timestamp) < 25"), df.where("minute(measurement_timestamp) >= 25"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = monitor.monitor(source, b, "Europe/Budapest").writeStream.format("memory").queryName("monitored").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    cols = ["measurement_id", "rule_1", "rule_2", "rule_3", "rule_4", "spc_signal"]
    got = sorted(tuple(r) for r in spark.table("monitored").select(cols).collect())
    want = sorted(tuple(r) for r in rules.spc_results(df.withColumns({"booth_name": F.lit("B"), "point_code": F.lit("P"), "shift_name": F.lit("S")}), b, "Europe/Budapest").select(cols).collect())
    assert got == want and any(w[5] for w in want)


def test_load_is_all_or_nothing(spark, tmp_path, monkeypatch):
    dims = generate.dimensions(spark)
    names = ("dim_booth", "dim_shift", "dim_specification")
    for n in names:
        dims[n].coalesce(1).write.option("header", True).csv(str(tmp_path / f"{n}.csv"))
    out = tmp_path / "out"
    broken = dict(files.SCHEMAS) | {"dim_specification": files.SCHEMAS["dim_specification"].replace("unit string", "unit int")}
    with monkeypatch.context() as m:
        m.setattr(files, "SCHEMAS", broken)
        with pytest.raises(Exception):
            files.load(spark, str(tmp_path), str(out), names)
    assert not out.exists() or not list(out.iterdir())
    assert {r["table_name"]: (r["staged"], r["loaded"]) for r in files.load(spark, str(tmp_path), str(out), names).collect()} == {"dim_booth": (2, 2), "dim_shift": (3, 3), "dim_specification": (1, 1)}
    with pytest.raises(FileExistsError):
        files.load(spark, str(tmp_path), str(out), names)
    assert sorted(p.name for p in out.iterdir()) == sorted(f"{n}.parquet" for n in names)


def test_extract_and_json(spark, tmp_path):
    (tmp_path / "x.csv").write_text("k,ok,at,v\n1,t,2026-01-02 03:04:05,1.5\n2,f,soon,\n3,,2026-01-02 00:00:00,x\n")
    got = files.read_extract(spark, str(tmp_path / "x.csv"), "k int, ok boolean, at timestamp_ntz, v double").orderBy("k").collect()
    assert [(r["ok"], str(r["at"]), r["v"]) for r in got] == [(True, "2026-01-02 03:04:05", 1.5), (False, "None", None), (None, "2026-01-02 00:00:00", None)]
    rows = files.json_rows(spark.createDataFrame([(2, None)], "b int, a string")).collect()
    assert rows[0]["report"] == '{"a":null,"b":2}' and files.as_json({"b": 1, "a": None}) == '{"a": null, "b": 1}'


def test_stored_results_are_made_once_and_again_when_old_or_changed(spark, tmp_path):
    made, now = [], [0.0]

    def make():
        made.append(1)
        return spark.range(len(made))

    source = tmp_path / "in.parquet"
    spark.range(3).write.parquet(str(source))
    get = lambda: store.stored(spark, "t", [str(source)], make, ttl=10, clock=lambda: now[0]).count()
    assert (get(), get(), len(made)) == (1, 1, 1)
    now[0] = 11.0
    assert (get(), len(made)) == (2, 2)
    spark.range(5).write.mode("overwrite").parquet(str(source))
    assert (get(), len(made)) == (3, 3)


def test_jdbc_scan(spark):
    url = "jdbc:derby:memory:millrace;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark.range(100).selectExpr("cast(id as int) as k", "id * 2 as v").write.jdbc(url, "t", mode="overwrite", properties=driver)
    except Exception as error:
        pytest.skip(f"no embedded database: {str(error)[:80]}")
    df = files.read_jdbc(spark, url, "t", key="k", bounds=(0, 100), parts=4, columns=["k", "v"], **driver)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100
    assert [r["k"] for r in files.rows_in_order(df, ["k"])] == list(range(100))
    with pytest.raises(ValueError, match="lacks"):
        files.read_jdbc(spark, url, "t", columns=["k", "nothing"], **driver)
