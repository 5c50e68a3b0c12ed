"""Registered queries of the clustering engine against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pandas as pd
import pytest

from pointweave.catalogue import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")
NAMES = ["dbscan_labels", "dbscan_per_group", "voxel_spans", "voxel_neighbor_lut", "neighbor_counts", "label_colors_cli", "label_colors_script", "noise_candidates_anti_join", "sorted_positions", "epsilon_pairs", "dbscan_scans", "recentred"]


def rows(df):
    def plain(v):
        if v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "events", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, str(DATA)).toPandas()) == rows(con.execute(ORACLE[name]).fetchdf())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_entry_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "pointweave", tmp_path / "pointweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'dbscan_labels' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})


def test_entry_where_a_package_of_the_corpus_operators_is_missing():
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; assert 'dbscan_labels' in e.queries() and not any(q.startswith('op') for q in e.queries()) and 'dbscan_labels' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
