"""Each query of the reference's operators against its SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from weirflow.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: These need rows that a composed number tells apart, which only the larger tables have.
LARGER = {"prior_window_ties", "prior_distinct_ties"}


def cells(rows, names):
    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, (bool, int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        return str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, name):
    folder = "/root/testdata/" + ("sf0.01" if name in LARGER else "sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = plans.queries()[name](spark, folder)
    want = con.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert cells([tuple(r) for r in got.collect()], got.columns) == cells(want.fetchall(), want.columns)


def test_entry_without_the_corpus_modules(tmp_path):
    """The entry still imports, and has the other queries, when the corpus subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/weirflow", tmp_path / "weirflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.stdout.split() == [str(len(plans.queries())), "False"], done.stderr


def test_training_table_has_every_flow(spark):
    folder = "/root/testdata/sf0.001"
    flows = plans.flow_rows(spark, folder).select("flow_id").distinct()
    assert plans.training_table(spark, folder).count() == flows.count()
