"""The driver's contract, with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_query_of_the_engine_has_sql():
    import __spark_entry__ as entry

    from millrace.plans import oracles, queries

    assert set(queries.QUERIES) == set(oracles.SQL)
    assert set(oracles.SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "millrace"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    target = tmp_path / "millrace"
    target.mkdir()
    for p in (ROOT / "millrace").iterdir():
        if p.name != "llm":
            (target / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'spc_rules' in q and not any(k.startswith('op') for k in q); assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_entry_keeps_the_corpus_operators_without_the_pipeline(tmp_path):
    if not (ROOT / "millrace" / "llm").exists():
        pytest.skip("the corpus operators are absent")
    for name in ("__spark_entry__.py", "millrace"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'spc_rules' in q and sum(k.startswith('op') for k in q) == 10 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "spc_signal" in df.columns


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", ["compliance_distribution", "spc_rules_long", "capability_streams", "table_compare", "baseline_constraint_violations", "transition_violations"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    from millrace.plans import oracles, queries

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries.QUERIES[name](spark, str(DATA)).collect()
    rel = con.sql(oracles.SQL[name])
    show = lambda v: None if v is None else round(float(v), 5) if isinstance(v, float) else str(v)
    want = sorted((tuple(show(v) for _, v in sorted(zip(rel.columns, r))) for r in rel.fetchall()), key=str)
    assert sorted((tuple(show(v) for _, v in sorted(r.asDict().items())) for r in got), key=str) == want


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_before_during_after_takes_all_events(spark):
    import duckdb

    from millrace.plans import oracles, queries

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    sql = oracles.SQL["before_during_after"]
    assert "TIMESTAMP '2024" not in sql
    rel = con.sql(sql)
    show = lambda v: round(float(v), 5) if isinstance(v, float) else str(v)
    want = sorted((tuple(show(v) for _, v in sorted(zip(rel.columns, r))) for r in rel.fetchall()), key=str)
    got = queries.QUERIES["before_during_after"](spark, str(DATA)).collect()
    assert got and sorted((tuple(show(v) for _, v in sorted(r.asDict().items())) for r in got), key=str) == want
    assert {r["relative_period"] for r in got} == {"BEFORE", "DURING", "AFTER"}
