"""Queries over target records that give every row they name."""

import datetime as dt

import pytest

from parcelflow.plans import registry
from parcelflow.schemas import TARGET_METRICS

registry.load()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Six lines of one market, type and source in three quarters; the third price is far from the others."""
    folder = str(tmp_path_factory.mktemp("tables"))
    lines = [(k, 10 + k, 1, 1, 10.0, price, 0.05, 0.02, "A", "F", dt.date(1996, 2 + k, 1)) for k, price in enumerate([100.0, 110.0, 900.0, 905.0, 910.0, 915.0])]
    orders = [(k, 1, day, "2-HIGH", "F") for k, day in enumerate([dt.date(1996, 1, 5), dt.date(1996, 4, 5), *[dt.date(1996, 10, 5)] * 4])]
    made = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string, o_orderstatus string"),
        "customer": ([(1, 2, "OFFICE")], "c_custkey long, c_nationkey long, c_mktsegment string"),
        "nation": ([(2, 0)], "n_nationkey long, n_regionkey long"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_warning_table_reads_every_metric(spark, tables):
    """F8: warnings of levels stand beside those of rates."""
    got = {(r.code, r.metric, r.period) for r in registry.QUERIES["warning_table"](spark, tables).collect()}
    assert {("missing_periods", "vacancy_rate", "1996-Q4"), ("missing_periods", "asking_rent", "1996-Q4"), ("sudden_jump", "asking_rent", "1996-Q4")} <= got


def test_target_audit_names_targets_without_a_source(spark, tables):
    """governed pairs that no source covers are rows of the audit."""
    got = {(r.property_type, r.metric): r for r in registry.QUERIES["target_audit"](spark, tables).collect()}
    governed = {(t, m.metric) for m in TARGET_METRICS for t in m.property_types}
    held = {("office", "vacancy_rate"), ("office", "asking_rent")}
    assert set(got) == governed | held
    assert all(got[k].observations > 0 and got[k].automation_status == "local_file_only" for k in held)
    assert all(got[k].observations == 0 and got[k].source is None and got[k].automation_status == "no_source_installed" for k in governed - held)
