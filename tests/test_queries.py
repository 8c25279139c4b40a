"""The queries as the driver runs them: hostile tables, empty tables, and the SQL."""

from __future__ import annotations

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from kithspark.plans import all_registries
from tests import hostile

DATA = "/root/testdata/sf0.001"
QUERIES = {n: q for r in all_registries() for n, q in r.queries.items()}
SQL = {n: s for r in all_registries() for n, s in r.sql.items()}


@pytest.fixture(scope="module")
def bad(spark, tmp_path_factory):
    return hostile.write(spark, str(tmp_path_factory.mktemp("hostile")))


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return hostile.write(spark, str(tmp_path_factory.mktemp("empty")), empty=True)


#: Queries over the tables that hostile.py has.
OURS = [n for n in QUERIES if n.startswith(("p2_", "k6_", "i1_", "i4_", "i5_", "b3_", "b2_", "b4_", "a5_", "a6_", "a9_", "d6_", "d7_", "c1_", "c3_", "g2_", "g3_n", "g9_", "g10_", "j4_", "j8_", "r1_people_by", "r4_intersections", "r8_co_occurrence_by", "s8_", "sv_p2", "t2_", "v7_", "v9_", "w4_", "k1_", "k3_", "i2_", "w5_", "t6_", "k5_", "i3_", "s3_", "u1_", "sv_p1_", "g16_", "c2_", "c8_", "j3_"))]


@pytest.mark.parametrize("name", OURS)
def test_hostile_and_empty_tables(spark, bad, none, name):
    query = entry.queries()[name]
    query(spark, bad).collect()
    rows = query(spark, none).collect()
    assert len(rows) == (1 if name in ("a9_scan_totals", "v9_named_and_unnamed") else 0)


def test_heavy_keys_of_hostile_tables(spark, bad):
    got = {tuple(r) for r in entry.queries()["p2_found"](spark, bad).collect()}
    assert got == {("cluster_id", 1), ("cluster_id", 7), ("person_id", 1)}


def test_name_lists_of_a_hot_cluster(spark, tmp_path):
    rows = [(i, 1, 7 if i % 10 else i, f" Name {i % 900}, NAME {i % 700},,{' ' * (i % 3)}" if i % 5 else " , ", None, None) for i in range(4000)]
    spark.createDataFrame(rows, hostile.SCHEMAS["name_requests"]).write.parquet(f"{tmp_path}/name_requests.parquet")
    df = entry.queries()["g9_name_lists"](spark, str(tmp_path))
    assert "collect_list" not in df._jdf.queryExecution().toString()  # a cluster's names never come together in one row
    want = {}
    for _, _, c, names, _, _ in rows:
        want.setdefault(c, set()).update(x.strip().lower() for x in names.split(",") if x.strip())
    assert {tuple(r) for r in df.collect()} == {(c, len(v)) for c, v in want.items() if v}


def _plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, (bool, str)):
            return str(x)
        if isinstance(x, pd.Timestamp):
            return str(x.tz_localize(None))
        return f"{float(x):.4f}"

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _plain(got) == _plain(want)
