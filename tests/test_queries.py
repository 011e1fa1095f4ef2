"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from gridwright.operators import checks
from gridwright.plans import bindings, catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float | np.floating) and x != x:
        return None
    if isinstance(x, list | tuple | np.ndarray):
        return tuple(plain(v) for v in x)
    if isinstance(x, bool | np.bool_):
        return bool(x)
    return round(float(x), 6) + 0.0 if isinstance(x, int | float | np.number) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_lines_take_every_event(spark, duck):
    """Segments of whole lines against plain Python: no event with a value is left out, no list of a user's events is made."""
    events = {}
    for user, event, value in duck.sql("select user_id, event_id, value from events where value is not null").fetchall():
        events.setdefault(user, []).append((event, round(value * 100)))
    want = set()
    for user, es in events.items():
        line = [(v % 1200, (i * 97 + user * 13) % 1200) for i, (_, v) in enumerate(sorted(es))]
        want |= {(user, i, *a, *b) for i, (a, b) in enumerate(zip(line, line[1:], strict=False))}
    whole = bindings.segments(spark, FOLDER)
    got = [tuple(r) for r in whole.select("id", "seq", "x1", "y1", "x2", "y2").collect()]
    assert set(got) == want and len(got) == len(want) and max(len(es) for es in events.values()) > 12
    assert "collect_list" not in whole._jdf.queryExecution().toString()


def test_every_cached_page_is_reused(spark, tmp_path):
    """A page is cached by its line whatever the part: no part of the cached side is left out."""
    con = duckdb.connect()
    con.sql("create table orders as select (i * 100)::BIGINT as o_orderkey from range(6) t(i)")
    con.sql("create table lineitem as select (i * 100 + 7)::BIGINT as l_orderkey, case when i = 3 then 6 else 7 end as l_linenumber, case when i = 2 then 'N' else 'R' end as l_returnflag, (i * 5 + 11)::BIGINT as l_partkey from range(5) t(i)")
    for t in ("orders", "lineitem"):
        con.sql(f"copy {t} to '{tmp_path}/{t}.parquet'")
    got = sorted(r.page for r in catalogue.QUERIES["cache_reuse_antijoin"](spark, str(tmp_path)).collect())
    assert got == [2, 3, 5] == sorted(r[0] for r in con.sql(catalogue.ORACLE_SQL["cache_reuse_antijoin"]).fetchall())


def test_ids_of_both_sides_are_grouped_once(spark):
    """Repeated and null ids; no task holds a side made unique beside another side's."""
    expected, seen = (spark.createDataFrame([(x,) for x in ids], "id long") for ids in ([1, 2, 2, 3, None], [2, 3, 3, 4, 4, None]))
    found = checks.missing_and_unexpected(expected, seen, "id")
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "missing"), (4, "unexpected"), (None, "missing"), (None, "unexpected")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
