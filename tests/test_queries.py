"""Every query against its SQL on the smallest tables, and the driver's contract."""

import datetime
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from fieldstone.plans import registry
from fieldstone.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return db


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, views, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = views.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    a = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=str)
    assert a == b


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["divergence_quality", "residual_valuation", "unit_mix_apportion"])
def test_valuations_leave_orders_where_they_are(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and "hashpartitioning(o_orderkey" not in plan


def test_explanations_come_in_tasks_of_bounded_size(spark, views, monkeypatch):
    monkeypatch.setattr(registry, "TASK_ROWS", 500)
    n = views.sql("SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)").fetchall()[0][0]
    got = QUERIES["explanation_payloads"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {int(x) for x in re.findall(r"hashpartitioning\(run_id#\d+L?, (\d+)\)", plan)} == {-(-n // 500)}
    assert sorted(got.select("run_id", "unknown_count").collect()) == sorted(views.sql(f"SELECT run_id, unknown_count FROM ({ORACLE['explanation_payloads']})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert QUERIES.keys() <= entry.queries().keys()


def test_the_rest_does_not_import_the_corpus_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(f"{root}/fieldstone"):
        if "/llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(f"{folder}/{f}").read(), f
