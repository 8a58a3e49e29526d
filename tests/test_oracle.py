"""Every query with SQL against DuckDB on the smallest tables, and the entry module without its optional parts."""

import glob
import os
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

from crossgauge.plans import registry
from tests.conftest import ROOT, SF

registry.load()
ONE_EACH = {f: k for k, f in reversed(registry.QUERIES.items())}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    def cell(v):
        if isinstance(v, (np.ndarray, list)):
            return str([str(x) for x in v])
        if pd.isna(v):
            return "null"
        return str(v) if isinstance(v, (bool, np.bool_, str)) else f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ONE_EACH.values()))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        want = con.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_imports_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "crossgauge"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name) if name.endswith(".py") else None
    os.makedirs(tmp_path / "crossgauge")
    for name in os.listdir(f"{ROOT}/crossgauge"):
        if name != "llm":
            os.symlink(f"{ROOT}/crossgauge/{name}", tmp_path / "crossgauge" / name)
    code = f"import sys; sys.path = [p for p in sys.path if p not in ('', {ROOT!r})]; sys.path.insert(0, {str(tmp_path)!r}); import importlib.util as u; s = u.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); assert q and not [x for x in q if x.startswith('op')], q"
    env = {**os.environ, "PYTHONPATH": ""}
    assert subprocess.run([sys.executable, "-B", "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120).returncode == 0
