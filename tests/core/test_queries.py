"""Every registered query with SQL gives the rows of its SQL, and the rest imports alone."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

from pagelattice import plans

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
ROOT = Path(__file__).resolve().parents[2]
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


def cell(x):
    import pandas as pd

    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.9g}"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in sorted(DATA.iterdir()):
        glob = f if f.is_file() else f / "*.parquet"
        c.execute(f"create view {f.name.split('.')[0]} as select * from '{glob}'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, duck, name):
    got = plans.queries()[name](spark, str(DATA)).toPandas()
    want = duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [sorted(tuple(map(cell, r)) for r in x[columns].itertuples(index=False, name=None)) for x in (got, want)]
    assert rows[0] == rows[1]


@needs_data
@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_without_sql(spark, name):
    assert plans.queries()[name](spark, str(DATA)).count() > 0


def test_imports_without_the_corpus_operators():
    code = (
        "import sys; sys.modules['pagelattice.llm'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert q and not any(n[0] == 'p' and n[1].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})


def test_nothing_else_imports_them():
    for p in (ROOT / "pagelattice").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", p.read_text(), re.M), p
