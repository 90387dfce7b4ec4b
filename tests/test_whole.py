"""Queries over whole tables against their SQL."""

from collections import Counter
from math import isclose
from pathlib import Path

import pytest

from eventry.plans import queries

DATA = Path("/root/testdata/sf0.01")
WHOLE = ["c01_normalize_text", "f13_sanitize_numeric", "a15_zscore", "o01_sort_total", "j07_join_context", "j22_attach_source", "j27_knn_edges", "m06_normalise_edges", "a24_max_present"]


def same(a, b):
    return isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(DATA)).select(*names).collect()
    rows = sorted(want.fetchall(), key=repr)
    assert len(got) == len(rows)
    rounded = lambda r: tuple(round(float(x), 6) if isinstance(x, float) else x for x in r)
    if Counter(map(rounded, map(tuple, got))) != Counter(map(rounded, rows)):
        for g, w in zip(sorted(map(tuple, got), key=repr), rows, strict=True):
            assert all(map(same, g, w)), (g, w)
