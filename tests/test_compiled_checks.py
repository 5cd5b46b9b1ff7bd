"""Work per row is compiled and spread: no lambda around the checks, constant patterns, one shuffle for entities."""

from pyspark.sql import functions as F

from parcelflow.operators import text, validate
from parcelflow.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_record_checks_hold_no_lambda(spark):
    registry.load()
    assert "lambdafunction" not in plan(registry.QUERIES["record_validation"](spark, SF))


def test_errors_keep_order_and_skip_null_conditions(spark):
    row = spark.range(1).select(validate.errors({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False), "d": F.lit(True)}).alias("e")).first()
    assert row["e"] == ["a", "d"]


def test_documents_are_spread_before_matching(spark):
    registry.load()
    found = registry.QUERIES["extract_fields"](spark, SF)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_entities_move_once_and_the_last_cell_wins(spark):
    cells = spark.createDataFrame([
        ("d", "t12_operating_statement", 1, "c1", "row.1.account_name", "Rent"), ("d", "t12_operating_statement", 1, "c3", "row.1.jan", "5"), ("d", "t12_operating_statement", 1, "c2", "row.1.jan", "4"),
        ("d", "t12_operating_statement", 1, "c2", "row.1.feb", None), ("d", "t12_operating_statement", 1, "c9", "row.2.jan", "7"),
    ], "document_id string, category string, page_number int, cell_id string, field_name string, value string")
    out = text.derive_entities(cells)
    rows = out.collect()
    assert len(rows) == 1 and rows[0]["data"] == {"account_label": "Rent"} and rows[0]["period_values"] == {"feb": None, "jan": "5"} and rows[0]["source_value_ids"] == ["c1", "c2", "c3"]
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") <= 1 and plan(out).count("Aggregate [") == 1
