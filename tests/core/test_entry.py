import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillgraph import registry

SMOKE = ["tokenize_terms", "lexical_verdict", "schema_validate", "find_paths", "neighborhood", "bm25_topk", "rrf_fusion", "answer_score", "dataset_summary"]


def rounded(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(rounded, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", SMOKE)
def test_against_sql(spark, sf_dir, name):
    if not os.path.exists(sf_dir):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, sf_dir)
    cur = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(rounded(v) for v in r) for r in cur.fetchall()), key=repr)


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
