"""Readers of wide panels, target histories, comparables, locations, outcomes and report tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import keyed, numbers
from parcelflow.operators.validate import blank, errors
from parcelflow.sources.public import _csv, require

# Rate and level metrics of the market panel; property types.
RATES = (
    "rent_growth_12m", "vacancy_rate", "availability_rate", "transaction_cap_rate", "employment_growth", "population_growth", "income_growth", "inflation", "treasury_rate", "treasury_rate_2y", "sofr_rate",
    "high_yield_spread", "mortgage_rate_30y", "cre_delinquency_rate", "renewal_probability", "leasing_commission_rate", "expense_growth", "property_tax_growth", "insurance_growth", "discount_rate", "debt_interest_rate",
    "construction_cost_growth",
)
LEVELS = (
    "effective_rent", "asking_rent", "net_absorption", "inventory", "new_deliveries", "construction_pipeline", "transaction_count", "lease_comp_count", "building_permits", "downtime_months", "tenant_improvements",
    "lease_up_units_per_month", "operating_expense_per_area", "property_tax_per_area", "insurance_per_area", "utility_cost_per_area", "payroll_cost_per_area", "repair_maintenance_per_area", "corporate_profit_after_tax",
    "housing_starts", "housing_supply_months", "retail_sales", "vehicle_sales", "industrial_production_index", "commercial_industrial_loans", "equity_market_index", "inflation_index", "rent_primary_residence_index",
    "owners_equivalent_rent_index", "construction_input_price_index", "financial_activities_employment", "professional_services_employment", "leisure_hospitality_employment", "population", "median_household_income",
    "renter_households", "vacant_housing_units", "median_gross_rent",
)
PANEL_PROPERTY_TYPES = (
    "office", "industrial", "retail", "multifamily", "mixed_use", "student_housing", "self_storage", "medical_office", "life_science", "data_center", "hotel", "senior_housing", "manufactured_housing", "parking", "land", "ground_lease",
)
PANEL_REQUIRED = {"period", "market_id", "market_name", "property_type", "source", "source_date", "source_reference", "usage_rights"}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: research panel from CSV or Parquet."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)


def read_market_panel(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    require(df, PANEL_REQUIRED, "market panel")
    return df


def panel_observations(rows: DataFrame) -> DataFrame:
    """SRC-13: wide panel rows to one observation per non-null metric, geography by fallback."""
    metrics = [m for m in (*RATES, *LEVELS) if m in rows.columns]
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    full = lambda c: F.when(~blank(have(c)), have(c))
    kind = F.coalesce(full("geography_type"), F.when(full("submarket").isNotNull(), "submarket").when(full("market_id").isNotNull(), "market").otherwise("county"))
    place = F.coalesce(full("geography_id"), full("submarket"), full("market_id"), full("county_fips"))
    base = rows.select(
        F.col("period").alias("observation_date"), kind.alias("geography_type"), place.alias("geography_id"), full("county_fips").alias("county_fips"), full("cbsa").alias("cbsa"), full("submarket").alias("submarket"), "property_type",
        full("property_subtype").alias("property_subtype"), F.col("source").alias("source_label"), "source_reference", have("lease_comp_count").try_cast("double").cast("long").alias("comps"), *[F.col(m).cast("string").alias(m) for m in metrics],
    )
    keys = [c for c in base.columns if c not in metrics]
    long = base.unpivot(keys, metrics, "metric", "value").filter(~blank(F.col("value")))
    money = F.col("metric").isin("effective_rent", "asking_rent")
    return long.withColumns({
        "unit": F.when(F.col("metric").isin(*RATES), "decimal_fraction").when(money, "USD").otherwise("count_or_level"), "currency": F.when(money, "USD"),
        "sample_count": F.when(F.col("metric") != "lease_comp_count", F.col("comps")), "quality_level": F.lit("moderate"),
    }).drop("comps")


def series_panel(df: DataFrame, metric: str, *, percent: bool, source: str, source_date: str, reference: str, rights: str, property_type: str) -> DataFrame:
    """SRC-14: one catalogued series as single-metric interchange rows; percents become fractions."""
    value = F.col("value").try_cast("decimal(28,12)")
    value = (value / 100).cast("decimal(28,12)") if percent else value
    rows = df.filter(~F.coalesce(F.trim("value"), F.lit("")).isin("", ".", "NA", "null", "-"))
    return rows.select(
        "period", F.col("geography_id").alias("market_id"), F.col("geography_id").alias("market_name"), F.lit(property_type).alias("property_type"), F.lit(source).alias("source"), F.lit(source_date).alias("source_date"),
        F.lit(reference).alias("source_reference"), F.lit(rights).alias("usage_rights"), "geography_type", "geography_id", value.alias(metric),
    )


def read_target_history(spark: SparkSession, path: str, mapping: dict | None = None) -> DataFrame:
    """SRC-15: target history; a mapping template must match the file's columns exactly."""
    df = scan(spark, path)
    if mapping is None:
        return df
    expected, columns = set(mapping["expected_columns"]), mapping["column_mapping"]
    if set(df.columns) != expected:
        raise ValueError("source columns do not match the saved mapping template")
    if len(set(columns.values())) != len(columns):
        raise ValueError("two input columns cannot map to the same field")
    out = df.select(*[F.col(s).alias(t) for s, t in columns.items()])
    for name, value in {"source_name": mapping.get("source_name"), "licensing_notes": mapping.get("licensing_notes"), **mapping.get("defaults", {})}.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    return out


# Required columns per evidence file.
EVIDENCE_COLUMNS = {
    "rent_comps": {"address", "latitude", "longitude", "property_type", "asking_rent", "rent_unit", "observed_date", "source_reference"},
    "pois": {"name", "category", "latitude", "longitude", "source_reference"},
    "sale_comps": {"address", "latitude", "longitude", "property_type", "sale_price", "price_unit", "sale_date", "source_reference"},
    "location_evidence": {"name", "category", "latitude", "longitude", "evidence_date", "source_reference"},
    "outcomes": {
        "observation_id", "property_id", "market_id", "period", "property_type", "forecast_origin", "feature_available_at", "outcome_realized_at", "outcome_released_at", "outcome", "outcome_value", "data_status", "source_hash",
        "feature_hash", "source_name", "source_record_id", "licensing_notes", "methodology",
    },
}


def read_evidence(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """SRC-16..19: required columns, with rows that leave one blank marked in ``errors``."""
    df = _csv(spark, path)
    required = EVIDENCE_COLUMNS[kind]
    require(df, required, kind)
    df = df.withColumn("source_row", F.monotonically_increasing_id())
    if kind == "outcomes":
        return df.withColumn("row_number", F.col("source_row"))
    return df.withColumn("errors", errors({f"blank_{c}": blank(F.col(c)) for c in sorted(required)}))


class _PageTables(HTMLParser):
    """Tables of one page with a stack for tables inside cells; references are decoded by the parser."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.count, self.open, self.found = 0, [], []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "table":
            self.open.append({"table_no": self.count, "row_no": -1, "cells": None, "text": None})
            self.count += 1
        elif self.open and tag == "tr":
            self.end_row()
            self.open[-1].update(row_no=self.open[-1]["row_no"] + 1, cells=[])
        elif self.open and tag in ("td", "th") and self.open[-1]["cells"] is not None:
            self.end_cell()
            self.open[-1]["text"] = []

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["text"] is not None:
            self.open[-1]["text"].append(data)

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        if tag in ("td", "th"):
            self.end_cell()
        elif tag == "tr":
            self.end_row()
        elif tag == "table":
            self.end_row()
            self.open.pop()

    def end_cell(self) -> None:
        table = self.open[-1]
        if table["text"] is not None:
            table["cells"].append(" ".join("".join(table["text"]).split()))
            table["text"] = None

    def end_row(self) -> None:
        self.end_cell()
        table = self.open[-1]
        if table["cells"] and any(table["cells"]):
            self.found.append((table["table_no"], table["row_no"], table["cells"]))
        table["cells"] = None

    def rows(self, html: str | None) -> list[tuple[int, int, list[str]]]:
        self.feed(html or "")
        self.close()
        while self.open:  # tables that the page never closes
            self.end_row()
            self.open.pop()
        return sorted(self.found)


def html_tables(pages: DataFrame) -> DataFrame:
    """SRC-25: (page_id, table_no, row_no, cells) of every non-empty table row, in one pass per page.

    Tables are numbered in the order in which they open.  A table inside a cell is a table of its own and its
    text is no part of that cell.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(page, *row) for page, html in zip(batch["page_id"], batch["html"], strict=True) for row in _PageTables().rows(html)]
            yield pd.DataFrame(rows, columns=["page_id", "table_no", "row_no", "cells"])

    return pages.select("page_id", "html").mapInPandas(parsed, f"page_id {kind}, table_no int, row_no int, cells array<string>")


def _percent(value: Column) -> Column:
    return (F.regexp_replace(value, "[%$,]", "").try_cast("double") / 100).cast("double")


def _amount(value: Column) -> Column:
    text = F.regexp_replace(value, "[$,%\\s]", "")
    return F.when(text.rlike(r"^\(.*\)$"), -F.regexp_replace(text, "[()]", "").try_cast("double")).otherwise(text.try_cast("double"))


# Metrics of a filing row by position: current, prior, growth for four measures, after the unit count.
FILING_MEASURES = (
    ("same_store_revenue", "revenue_growth_yoy", "USD_thousands_quarter"), ("same_store_operating_expense", "operating_expense_growth_yoy", "USD_thousands_quarter"),
    ("same_store_noi", "noi_growth_yoy", "USD_thousands_quarter"), ("effective_rent", "rent_growth_yoy", "USD_per_unit_month"),
)


def filing_rows(text: DataFrame, heading: str, until: str | None = None) -> DataFrame:
    """SRC-22: market rows of one section of filing text (file, lines) as number arrays with check columns.

    Each document is its own row, so a section is sliced with array functions and lines are
    exploded only inside it.
    """
    start = F.array_position(F.transform("lines", lambda x: x.contains(heading)), True)
    section = F.slice("lines", F.greatest(start, F.lit(1)).cast("int"), F.size("lines"))
    if until:
        stop = F.array_position(F.transform(section, lambda x: x.contains(until)), True)
        section = F.when(stop > 1, F.slice(section, F.lit(1), (stop - 1).cast("int"))).otherwise(section)
    lines = text.filter(start > 0).select("file", F.explode(section).alias("line"))
    market = F.trim(F.regexp_extract("line", r"^\s*([A-Z][A-Za-z .,/'&-]+?)\s+[\d(]", 1))
    values = F.transform(F.regexp_extract_all("line", F.lit(r"(\(?-?\$?\d[\d,]*\.?\d*%?\)?)"), 1), lambda v: _amount(v))
    rows = lines.select("file", market.alias("market"), values.alias("v")).filter((F.size("v") >= 13) & (F.col("market") != "") & ~F.col("market").rlike("^(Total|Other|Units )"))
    at = lambda i: F.try_element_at("v", F.lit(i + 1))
    growth_off = [F.coalesce(F.abs(F.try_divide(at(3 * i + 1), at(3 * i + 2)) - 1 - at(3 * i + 3) / 100) > 0.0015, F.lit(True)) for i in range(4)]
    identity_off = (at(1) - at(4) != at(7)) | (at(2) - at(5) != at(8))
    return rows.withColumn("errors", errors({"growth_cross_check": growth_off[0] | growth_off[1] | growth_off[2] | growth_off[3], "noi_identity": identity_off}))


def filing_metrics(rows: DataFrame) -> DataFrame:
    """SRC-22/23: accepted filing rows to nine metrics each."""
    at = lambda i: F.try_element_at("v", F.lit(i + 1))
    entries = [F.struct(F.lit("inventory").alias("metric"), at(0).alias("value"), F.lit("units").alias("unit"))]
    for i, (level, growth, unit) in enumerate(FILING_MEASURES):
        entries.append(F.struct(F.lit(level).alias("metric"), at(3 * i + 1).alias("value"), F.lit(unit).alias("unit")))
        entries.append(F.struct(F.lit(growth).alias("metric"), (at(3 * i + 3) / 100).alias("value"), F.lit("decimal_fraction").alias("unit")))
    return rows.filter(F.size("errors") == 0).select("file", "market", F.inline(F.array(*entries)))


# Cell layouts of table filings: position of each metric after the market name.
CELL_LAYOUTS = {
    6: ("inventory", "average_rental_rate", "average_rental_rate_growth_yoy", "occupancy_rate", "same_store_revenue", "revenue_growth_yoy"),
    8: ("inventory", "average_rental_rate", "average_rental_rate_growth_yoy", "occupancy_rate", "same_store_revenue", "revenue_growth_yoy", "same_store_noi", "noi_growth_yoy"),
}


def cell_rows(tables: DataFrame) -> DataFrame:
    """SRC-23: table rows whose cell count matches a layout, mapped by position to metrics."""
    cells = F.filter("cells", lambda c: F.trim(c) != "")
    rows = tables.withColumn("c", cells).filter(F.size("c").isin([n + 1 for n in CELL_LAYOUTS]))
    parts = []
    for width, names in CELL_LAYOUTS.items():
        of = rows.filter(F.size("c") == width + 1)
        entries = F.array(*[
            F.struct(F.lit(n).alias("metric"), (_percent(F.element_at("c", i + 2)) if n.endswith(("yoy", "rate")) and n != "average_rental_rate" else _amount(F.element_at("c", i + 2))).alias("value")) for i, n in enumerate(names)
        ])
        parts.append(of.select("page_id", "table_no", "row_no", F.element_at("c", 1).alias("market"), F.inline(entries)))
    return parts[0].unionByName(parts[1]).filter("value IS NOT NULL")


def rollup_errors(rows: DataFrame, parents: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """SRC-23: parent inventory must equal the sum of its children."""
    children = rows.join(parents, "market").groupBy("parent").agg(F.sum("value").alias("children_total"), F.count(F.lit(1)).alias("children"))
    own = rows.select(F.col("market").alias("parent"), F.col("value").alias("reported"))
    return own.join(children, "parent").filter(F.abs(F.col("reported") - F.col("children_total")) > tolerance)


def reconcile_extracted(rows: DataFrame, tolerance: float = 0.0015) -> DataFrame:
    """SRC-24: reported growth against growth recomputed from the level one year earlier.

    ``rows``: market, period index ``idx``, level, reported_growth.
    """
    prior = rows.select("market", (F.col("idx") + 4).alias("idx"), F.col("level").alias("prior_level"))
    joined = rows.join(prior, ["market", "idx"])
    recomputed = numbers.ratio(F.col("level"), F.col("prior_level")) - 1
    return joined.withColumns({"recomputed_growth": recomputed, "mismatch": F.coalesce(F.abs(recomputed - F.col("reported_growth")) > tolerance, F.lit(True))})


def table_candidates(rows: DataFrame, profile: dict, table_key: list[str], label: str = "label", value: str = "value") -> DataFrame:
    """SRC-26: long report rows to metric candidates; a table whose labels drift yields none.

    ``profile``: label -> (metric, unit, methodology); every label is expected.
    """
    expected = F.array(*[F.lit(x) for x in sorted(profile)])
    labels = rows.select(*table_key, F.trim(label).alias("__l")).distinct().groupBy(*table_key).agg(F.array_sort(F.collect_set("__l")).alias("__labels"))
    drift = labels.withColumns({"missing_labels": F.array_except(expected, "__labels"), "unexpected_labels": F.array_except("__labels", expected)})
    joined = keyed.null_safe_join(rows, drift.drop("__labels"), table_key)
    dim = rows.sparkSession.createDataFrame([(k, *v) for k, v in profile.items()], "__label string, metric string, unit string, methodology string")
    mapped = joined.withColumn("__label", F.trim(label)).join(dim, "__label", "left")
    text = F.trim(F.col(value))
    number = F.regexp_replace(text, "[$,%\\s]", "").try_cast("double")
    number = F.when(text.endswith("%") & (F.col("unit") == "decimal_fraction"), number / 100).otherwise(number)
    compatible = (F.size("missing_labels") == 0) & (F.size("unexpected_labels") == 0)
    return mapped.withColumns({"compatible": compatible, "number": F.when(compatible, number)}).drop("__label")


REPORT_QUARTER = r"(?i)(?:q([1-4])[-_ ]?((?:19|20)\d{2})|((?:19|20)\d{2})[-_ ]?q([1-4]))"


def discover_reports(files: DataFrame, sources: dict[str, str], property_types: tuple[str, ...]) -> DataFrame:
    """SRC-27: inventory of (path, content) files with digest and the metadata their names suggest."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    lower = F.lower(F.regexp_replace(stem, "[_-]", " "))
    quarter, year = (F.coalesce(*[F.when(F.regexp_extract(stem, REPORT_QUARTER, i) != "", F.regexp_extract(stem, REPORT_QUARTER, i)) for i in pair]) for pair in ((1, 4), (2, 3)))
    source = F.coalesce(*[F.when(lower.contains(token), F.lit(label)) for token, label in sources.items()])
    kind = F.coalesce(*[F.when(lower.contains(t.replace("_", " ")), F.lit(t)) for t in property_types])
    noise = F.array(*[F.lit(t) for t in (*sources, *property_types, "market", "report", "research", "quarterly", "q")])
    tokens = F.filter(F.split(F.regexp_replace(stem, "[^A-Za-z]+", " "), " "), lambda t: (t != "") & ~F.array_contains(noise, F.lower(t)))
    market = F.when(F.size(tokens) > 0, F.array_join(tokens, " "))
    return files.select(
        name.alias("filename"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("document_type"), source.alias("source"), market.alias("likely_market"),
        F.concat_ws("-Q", year, quarter).alias("likely_period"), kind.alias("likely_property_type"),
    ).withColumn("likely_period", F.when(F.col("likely_period").rlike(r"^\d{4}-Q[1-4]$"), F.col("likely_period")))


def missing_quarters(df: DataFrame, keys: list[str], period: str) -> DataFrame:
    """SRC-27: quarters between the first and last of a series that no row covers."""
    idx = F.substring(period, 1, 4).cast("int") * 4 + F.substring(period, 7, 1).cast("int") - 1
    have = df.filter(F.col(period).isNotNull()).select(*keys, idx.alias("idx")).distinct()
    span = have.groupBy(*keys).agg(F.min("idx").alias("a"), F.max("idx").alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("idx"))
    gaps = span.join(have, [*keys, "idx"], "left_anti")
    return gaps.select(*keys, F.concat(F.floor(F.col("idx") / 4).cast("string"), F.lit("-Q"), (F.col("idx") % 4 + 1).cast("string")).alias("missing_period"))
