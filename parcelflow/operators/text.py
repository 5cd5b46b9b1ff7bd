"""Document classification, field extraction, value normalisation and cell regrouping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.session import spread_rows

# Phrases that score a document category, in tie-break order.
CATEGORIES = {
    "offering_memorandum": ("offering memorandum", "investment offering", "executive summary", "om"),
    "rent_roll": ("rent roll", "tenant", "suite", "lease expiration"),
    "t12_operating_statement": ("t-12", "t12", "trailing twelve", "operating statement"),
    "historical_operating_statement": ("historical operations", "income statement"),
    "commercial_lease": ("lease agreement", "landlord", "tenant", "premises"),
    "lease_amendment": ("lease amendment", "amendment to lease"),
    "debt_quote": ("debt quote", "loan quote"),
    "loan_term_sheet": ("loan term sheet", "indicative terms"),
    "purchase_and_sale_agreement": ("purchase and sale agreement", "purchase agreement"),
    "letter_of_intent": ("letter of intent", "non-binding loi"),
    "capital_expenditure_budget": ("capital budget", "capex"),
    "property_condition_report": ("property condition", "physical needs assessment"),
    "environmental_report": ("phase i environmental", "environmental site assessment"),
    "appraisal": ("appraisal report", "market value"),
}


def classify(df: DataFrame, name: str, text: str, categories: dict = CATEGORIES) -> DataFrame:
    """TXT-01: two points per phrase found in name and text; the first best category wins.

    The whole text is searched.
    """
    stem = F.regexp_replace(F.col(name), r"\.[^./]*$", "")
    hay = F.regexp_replace(F.lower(F.concat_ws(" ", stem, F.coalesce(F.col(text), F.lit("")))), "[_-]", " ")
    scored = df.withColumn("__hay", hay)
    entries = [
        F.struct(sum((F.when(F.col("__hay").contains(p), 2).otherwise(0) for p in phrases), F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("category"))
        for i, (c, phrases) in enumerate(categories.items())
    ]
    return scored.withColumn("__best", F.array_max(F.array(*entries))).withColumns({
        "category": F.when(F.col("__best")["score"] > 0, F.col("__best")["category"]).otherwise("unknown"),
        "confidence": F.when(F.col("__best")["score"] > 0, F.round(F.least(F.lit(0.98), F.lit(0.55) + F.col("__best")["score"] * 0.08), 4)).otherwise(0.2), "score": F.col("__best")["score"],
    }).drop("__hay", "__best")


PROPERTY = ("offering_memorandum", "appraisal", "property_condition_report", "environmental_report")
TRANSACTION = ("offering_memorandum", "letter_of_intent", "purchase_and_sale_agreement", "appraisal")
LEASE = ("commercial_lease", "lease_amendment", "rent_roll")
OPERATIONS = ("offering_memorandum", "t12_operating_statement", "historical_operating_statement", "appraisal")
DEBT = ("debt_quote", "loan_term_sheet")
CAPITAL = ("capital_expenditure_budget", "property_condition_report")
OUTLOOK = ("offering_memorandum", "appraisal")
ROWS = ("rent_roll", "t12_operating_statement", "historical_operating_statement", "capital_expenditure_budget")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    pattern: str
    categories: tuple[str, ...]
    unit: str | None = None
    confidence: float = 0.82


def _line(name, label, categories):
    return Field(name, "text", rf"(?im)^{label}\s*[:,-]\s*(.+)$", categories)


def _money(name, label, categories, unit=None):
    return Field(name, "decimal", rf"(?i){label}\s*[:$ ]+([($0-9,.]+)", categories, unit)


def _amount(name, label, categories, unit=None, kind="decimal", tail="([0-9,.]+)", sign="[: ]+"):
    return Field(name, kind, rf"(?i){label}\s*{sign}{tail}", categories, unit)


def _rate(name, label, categories, unit="decimal_fraction"):
    return _amount(name, label, categories, unit, "rate", "([0-9.]+%?)")


def _growth(name, label):
    return _amount(name, label, OUTLOOK, "decimal_fraction", "signed_rate", "([-0-9.]+%?)")


def _count(name, label, categories, unit):
    return _amount(name, label, categories, unit, "integer", "([0-9,]+)")


def _months(name, label, categories):
    return _amount(name, label, categories, "months", "integer", r"([0-9]+)\s*months?")


def _day(name, label, categories):
    return _amount(name, label, categories, None, "date", "([A-Za-z0-9, /.-]+)")


# Governed fields with the label that introduces each value.
FIELDS = (
    _line("property_name", "property(?: name)?", PROPERTY), _line("address", "(?:property )?address", PROPERTY),
    _amount("rentable_square_feet", r"(?:rentable (?:area|square feet)|\brsf)", PROPERTY + LEASE, "sqft"), _count("unit_count", "(?:unit count|total units|number of units)", PROPERTY + OPERATIONS, "units"),
    _amount("year_built", "year built", PROPERTY, None, "integer", "([0-9]{4})"), _amount("land_area_acres", "(?:land area|site area|acreage)", PROPERTY, "acres", "decimal", r"([0-9,.]+)\s*(?:acres?)?"),
    _amount("county_fips", "county fips", PROPERTY, None, "fips", "([0-9]{5})"), _line("state", "state", PROPERTY), _line("municipality", "(?:municipality|city|town)", PROPERTY),
    _line("parcel_id", "(?:parcel|tax parcel)(?: id| number)?", PROPERTY), _money("asking_price", "(?:asking|purchase) price", TRANSACTION), _money("loi_price", "(?:loi|proposed) (?:purchase )?price", ("letter_of_intent",)),
    _money("psa_price", "(?:purchase price|consideration)", ("purchase_and_sale_agreement",)), _money("appraised_value", "(?:appraised|market) value", ("appraisal",)), _money("broker_stated_noi", "(?:broker[- ]stated )?noi", OUTLOOK),
    _rate("broker_stated_cap_rate", "(?:cap(?:italization)? rate)", OUTLOOK), _rate("occupancy", "(?:physical )?occupancy", OPERATIONS + ("rent_roll",)),
    _amount("rent_roll_occupied_area", "(?:occupied (?:area|square feet)|occupied rsf)", ("rent_roll",), "sqft"), _amount("rent_roll_total_area", "(?:rent[- ]roll )?(?:total|rentable) (?:area|square feet|rsf)", ("rent_roll",), "sqft"),
    _money("rent_roll_annualized_rent", "(?:annualized|annual) (?:base )?rent", ("rent_roll",)), _money("operating_rental_revenue", "(?:rental|base rent) revenue", OPERATIONS),
    _money("gross_revenue", "(?:gross (?:potential )?revenue|total revenue)", OPERATIONS), _money("operating_expenses", "(?:total )?operating expenses", OPERATIONS), _money("reported_noi", "(?:reported|actual|net operating income)", OPERATIONS),
    _money("calculated_noi", "calculated noi", OPERATIONS), _money("historical_noi", "historical noi", ("historical_operating_statement",) + OUTLOOK), _money("pro_forma_noi", "pro[ -]?forma noi", OUTLOOK),
    _line("tenant_name", "tenant(?: name)?", LEASE), _line("suite", "(?:suite|premises)", LEASE), _amount("lease_area", "(?:leased? (?:area|premises)|lease rsf)", LEASE, "sqft"),
    _day("lease_commencement_date", "(?:lease )?(?:commencement|start) date", LEASE), _day("lease_expiration_date", "(?:lease )?(?:expiration|expiry|end) date", LEASE), _money("lease_current_rent", "(?:current|base) rent", LEASE),
    _day("rent_roll_expiration", "rent[- ]roll expiration(?: date)?", ("rent_roll",)), _money("rent_roll_current_rent", "rent[- ]roll current rent", ("rent_roll",)), _amount("rent_roll_lease_area", "rent[- ]roll lease (?:area|rsf)", ("rent_roll",), "sqft"),
    _count("rent_roll_unit_count", "rent[- ]roll (?:unit count|total units)", ("rent_roll",), "units"), _money("security_deposit", "security deposit", LEASE), _money("loan_amount", "loan amount", DEBT), _rate("interest_rate", "(?:all-in )?interest rate", DEBT),
    _amount("loan_spread", "(?:credit )?spread", DEBT, "basis_points", "rate", r"([0-9.]+)\s*(?:bps|basis points)"), _months("loan_term_months", "(?:loan )?term", DEBT), _months("amortization_months", "amortization", DEBT),
    _months("interest_only_months", "interest[- ]only(?: period)?", DEBT), _rate("stated_ltv", "(?:maximum |stated )?ltv", DEBT), _rate("stated_ltc", "(?:maximum |stated )?ltc", DEBT), _rate("calculated_ltv", "calculated ltv", DEBT),
    _rate("calculated_ltc", "calculated ltc", DEBT), _rate("calculated_all_in_rate", "calculated all[- ]in rate", DEBT), _amount("minimum_dscr", "(?:minimum )?dscr", DEBT, None, "decimal", "([0-9.]+)x?"),
    _money("capex_stated_total", "(?:total |stated )?(?:capital expenditures|capex)", CAPITAL), _money("capex_line_item_total", "(?:calculated |line[- ]item )capex total", CAPITAL), _count("expected_row_count", "expected row count", ROWS, "rows"),
    _count("actual_row_count", "(?:actual|parsed) row count", ROWS, "rows"), _day("forecast_start_date", "forecast start(?: date)?", OUTLOOK), _months("forecast_months", "forecast (?:term|period|months)", OUTLOOK), _rate("discount_rate", "discount rate", ("appraisal",)),
    _growth("market_rent_growth", "market rent growth"), _amount("market_rent", "market rent", OUTLOOK, "USD_per_area", sign="[:$ ]+"), _rate("vacancy", "market vacancy", OUTLOOK), _rate("renewal_probability", "renewal probability", OUTLOOK),
    _amount("downtime", "downtime", OUTLOOK, "months", "decimal", "([0-9.]+)"), _amount("tenant_improvements", "tenant improvements?", OUTLOOK, "USD_per_area", sign="[:$ ]+"), _rate("leasing_commissions", "leasing commissions?", OUTLOOK),
    _growth("expense_growth", "expense growth"), _growth("property_tax_growth", "property tax growth"), _growth("insurance_growth", "insurance growth"), _rate("exit_cap_rate", "exit cap(?:italization)? rate", OUTLOOK), _rate("debt_interest_rate", "debt interest rate", DEBT),
    _growth("construction_cost_growth", "construction cost growth"), _amount("lease_up_pace", "lease[- ]up pace", OUTLOOK, "units_per_month", "decimal", "([0-9.]+)"),
)


def number(text: Column) -> Column:
    """TXT-03: decimal of a locale-formatted number: the last separator decides, brackets negate."""
    t = F.trim(text)
    cleaned = F.regexp_replace(t, "[^0-9.,]", "")
    comma, dot = cleaned.contains(","), cleaned.contains(".")
    last = lambda ch: F.length(cleaned) - F.instr(F.reverse(cleaned), ch)
    one_comma = (F.length(cleaned) - F.length(F.replace(cleaned, F.lit(","), F.lit("")))) == 1
    tail = F.length(F.element_at(F.split(cleaned, ","), -1))
    no_commas = F.replace(cleaned, F.lit(","), F.lit(""))
    decimal_comma = F.replace(cleaned, F.lit(","), F.lit("."))
    plain = (
        F.when(comma & dot & (last(".") > last(",")), no_commas).when(comma & dot, F.replace(F.replace(cleaned, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & one_comma & (tail != 3), decimal_comma).otherwise(no_commas)
    )
    negative = (t.startswith("(") & t.endswith(")")) | t.startswith("-")
    value = plain.try_cast("decimal(28,8)")
    return F.when(t.rlike(r"(?i)^(n/?a|none|tbd|-|—)?$"), F.lit(None)).otherwise(F.when(negative, -value).otherwise(value))


def day(text: Column, preference: str = "mdy") -> Column:
    """TXT-03: struct(value, ambiguous) from serial, ISO-like, numeric and named-month dates."""
    t = F.trim(text)
    serial = F.when(t.rlike(r"^\d{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), t.try_cast("int")))
    ymd, mixed = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})$"
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    make = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    a, b, c = (part(mixed, i) for i in (1, 2, 3))
    year = F.when(c < 70, c + 2000).when(c < 100, c + 1900).otherwise(c)
    first_month = (preference == "mdy")
    month = F.when(b > 12, a).when(a > 12, b).otherwise(a if first_month else b)
    date_of = F.when(b > 12, b).when(a > 12, a).otherwise(b if first_month else a)
    is_ymd, is_mixed = t.rlike(ymd), t.rlike(mixed)
    named = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")])
    value = F.when(serial.isNotNull(), serial).when(is_ymd, make(part(ymd, 1), part(ymd, 2), part(ymd, 3))).when(is_mixed, make(year, month, date_of)).otherwise(named)
    return F.struct(value.alias("value"), (is_mixed & value.isNotNull() & (a <= 12) & (b <= 12) & (a != b)).alias("ambiguous"))


def normalize(text: Column, kind: str, unit: str | None, parsed: Column | None = None, parsed_day: Column | None = None) -> Column:
    """TXT-03: normalised text of an extracted value, null when it breaks its type.

    ``parsed`` and ``parsed_day`` are the number and date of the text when already computed.
    """
    if kind == "text":
        return F.nullif(F.trim(text), F.lit(""))
    if kind == "fips":
        return F.when(F.trim(text).rlike(r"^\d{5}$"), F.trim(text))
    if kind == "date":
        return (day(text)["value"] if parsed_day is None else parsed_day).cast("string")
    value = number(text) if parsed is None else parsed
    if kind == "integer":
        value = F.when(value == F.floor(value), value)
    if kind in ("rate", "signed_rate"):
        if unit == "basis_points":
            value = F.when(value > 1, (value / 10000).cast("decimal(28,8)")).otherwise(value)
            value = F.when(value.between(-1 if kind == "signed_rate" else 0, 1), value)
        elif unit == "decimal_fraction":
            value = F.when(text.contains("%"), (value / 100).cast("decimal(28,8)")).otherwise(value)
            value = F.when(value.between(0, 1), value)
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def extract_fields(df: DataFrame, text: str, category: str | None = "category", fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """TXT-02: first match of every applicable field as long rows with excerpt and confidence.

    Only matched fields become rows, and values are normalised there by kind and unit, once per match.  Patterns are
    constants, so each is compiled once; small tables are spread first, as the work per document is large.
    """
    keys = [c for c in df.columns if c != text]
    body = F.coalesce(F.col(text), F.lit("")).alias("__body")
    kind_of = F.coalesce(F.col(category), F.lit("unknown")) if category else F.lit("unknown")
    spread = spread_rows(df).select(*keys, body, kind_of.alias("__category"))
    slots = []
    for at, f in enumerate(fields):
        wanted = F.col("__category").isin("unknown", *f.categories) & F.col("__body").rlike(f.pattern)
        slots.append(F.when(wanted, F.struct(F.lit(at).alias("__at"), F.regexp_extract("__body", f.pattern, 0).alias("__whole"), F.regexp_extract("__body", f.pattern, 1).alias("__raw"))))
    table = F.array(*[
        F.struct(F.lit(f.name).alias("field_name"), F.lit(f.kind).alias("kind"), F.lit(f.unit).cast("string").alias("unit"), F.lit(f.confidence).alias("confidence")) for f in fields
    ])
    found = spread.select(*keys, "__body", F.inline(F.array(*slots))).filter("__at IS NOT NULL").withColumn("__field", F.element_at(table, F.col("__at") + 1))
    found = found.withColumns({"field_name": F.col("__field.field_name"), "__kind": F.col("__field.kind"), "unit": F.col("__field.unit"), "__confidence": F.col("__field.confidence")})
    found = found.withColumn("raw_value", F.trim("__raw"))
    numeric = F.col("__kind").isin("decimal", "integer", "rate", "signed_rate")
    found = found.withColumn("__number", F.when(numeric, number(F.col("raw_value")))).withColumn("__day", F.when(F.col("__kind") == "date", day(F.col("raw_value"))["value"]))
    value = F.lit(None).cast("string")
    for kind, unit in sorted({(f.kind, f.unit if f.kind in ("rate", "signed_rate") else None) for f in fields}, key=str):
        match = (F.col("__kind") == kind) & (F.col("unit") == unit if unit else F.lit(True))
        value = F.when(match, normalize(F.col("raw_value"), kind, unit, F.col("__number"), F.col("__day"))).otherwise(value)
    start, width = F.instr("__body", F.col("__whole")), F.length("__whole")
    excerpt = F.trim(F.substring("__body", F.greatest(start - 60, F.lit(1)), width + F.least(start - 1, F.lit(60)) + 60))
    out = found.withColumns({"normalized_value": value, "excerpt": excerpt})
    confidence = F.when(F.col("normalized_value").isNull(), F.least("__confidence", F.lit(0.45))).otherwise(F.col("__confidence"))
    return out.select(*keys, "field_name", "raw_value", "normalized_value", "excerpt", confidence.alias("confidence"), "unit")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def table_cells(tables: DataFrame, keys: list[str], cells: str = "cells", row: str = "row_no") -> DataFrame:
    """TXT-04: data rows under a header row (row 0) as ``row.N.header`` cells."""
    head = tables.filter(F.col(row) == 0).select(*keys, F.transform(cells, slug).alias("__header"))
    body = tables.filter(F.col(row) > 0).select(*keys, F.col(row).alias("__row"), F.posexplode(cells).alias("__at", "raw_value"))
    joined = body.join(head, keys).filter((F.trim("raw_value") != "") & (F.col("__at") < F.size("__header")))
    name = F.coalesce(F.nullif(F.element_at("__header", F.col("__at") + 1), F.lit("")), F.col("__at").cast("string"))
    value = F.coalesce(number(F.col("raw_value")).cast("string"), F.trim("raw_value"))
    return joined.select(*keys, F.concat_ws(".", F.lit("row"), (F.col("__row") + 1).cast("string"), name).alias("field_name"), "raw_value", value.alias("normalized_value"))


# Column header aliases per document category.
_RENT_ROLL = {
    "tenant": "tenant_name", "tenant_name": "tenant_name", "tenant_legal_name": "tenant_name", "lessee": "tenant_name", "unit": "unit", "unit_no": "unit", "unit_number": "unit", "building": "building", "building_name": "building",
    "suite": "suite", "suite_no": "suite", "suite_number": "suite", "unit_type": "unit_type", "rentable_area": "rentable_area", "rentable_sf": "rentable_area", "rentable_square_feet": "rentable_area", "rsf": "rentable_area",
    "lease_commencement": "lease_commencement", "lease_start": "lease_commencement", "commencement_date": "lease_commencement", "lease_expiration": "lease_expiration", "lease_end": "lease_expiration", "expiration_date": "lease_expiration",
    "current_rent": "current_rent", "rent_unit": "rent_unit", "base_rent_basis": "rent_unit", "escalations": "escalations", "reimbursements": "reimbursements", "occupancy_status": "occupancy_status", "security_deposit": "security_deposit",
    "concessions": "concessions", "renewal_options": "renewal_options", "lease_status": "occupancy_status", "notes": "notes",
}
_ACCOUNT = {
    "account": "account_label", "account_name": "account_label", "account_label": "account_label", "line_item": "account_label", "classification": "account_classification", "account_classification": "account_classification",
    "category": "account_classification", "annual_total": "annual_total", "source_total": "source_total",
}
_LEASE_SCHEDULE = {
    "tenant": "tenant_name", "tenant_name": "tenant_name", "lessee": "tenant_name", "party": "party", "premises": "premises", "leased_premises": "premises", "suite": "premises", "rentable_area": "rentable_area", "rentable_sf": "rentable_area",
    "rsf": "rentable_area", "commencement": "commencement", "commencement_date": "commencement", "lease_start": "commencement", "expiration": "expiration", "expiration_date": "expiration", "lease_end": "expiration", "base_rent": "base_rent",
    "initial_base_rent": "base_rent", "base_rent_basis": "base_rent_basis", "rent_basis": "base_rent_basis", "lease_status": "lease_status", "status": "lease_status", "free_rent": "free_rent", "recovery_structure": "recovery_structure",
    "base_year": "base_year", "expense_stop": "expense_stop", "pro_rata_share": "pro_rata_share", "renewal_options": "renewal_options", "termination_rights": "termination_rights", "guarantor": "guarantor",
}
_AMENDMENT = {
    **{c: c for c in ("party", "premises", "rentable_area", "commencement", "expiration", "base_rent", "base_rent_basis", "lease_status", "renewal_options", "termination_rights", "amendment_effects")}, "tenant": "tenant_name",
}
_TERMS = {
    c: c for c in (
        "lender", "loan_amount", "funding_date", "debt_type", "rate_type", "interest_rate", "index", "spread", "rate_floor", "rate_cap", "amortization", "interest_only_period", "term", "maturity", "origination_fee", "exit_fee",
        "prepayment_terms", "dscr_requirement", "debt_yield_requirement", "ltv_requirement", "ltc_requirement", "recourse", "reserves", "extension_options", "conditions_precedent",
    )
}
_QUOTE = {
    **_TERMS, "lender_name": "lender", "commitment": "loan_amount", "maximum_loan_amount": "loan_amount", "closing_date": "funding_date", "loan_type": "debt_type", "interest_rate_type": "rate_type", "fixed_rate": "interest_rate", "term_months": "term",
}
ENTITIES = {
    "rent_roll": ("rent_roll_record", _RENT_ROLL), "t12_operating_statement": ("operating_account_period", {**_ACCOUNT, "trailing_12_total": "annual_total", "t12_total": "annual_total"}),
    "historical_operating_statement": ("operating_account_period", {**_ACCOUNT, "year_total": "annual_total"}), "commercial_lease": ("lease_schedule_record", _LEASE_SCHEDULE), "lease_amendment": ("lease_schedule_record", _AMENDMENT),
    "debt_quote": ("debt_term_record", _QUOTE), "loan_term_sheet": ("debt_term_record", _TERMS),
}


def derive_entities(cells: DataFrame) -> DataFrame:
    """TXT-05: cells (document_id, category, page_number, cell_id, field_name, value) to typed records.

    A table row has as many cells as columns, so the maps built per row are bounded, and
    cells move once, to their row.
    """
    dim = cells.sparkSession.createDataFrame([(c, kind, header, target) for c, (kind, aliases) in ENTITIES.items() for header, target in aliases.items()], "category string, entity_type string, header string, target string")
    kinds = F.create_map(*[F.lit(v) for c, (kind, _) in ENTITIES.items() for v in (c, kind)])
    pattern = r"^row\.(\d+)\.(.+)$"
    rows = cells.filter(F.col("field_name").rlike(pattern) & F.col("category").isin(*ENTITIES)).withColumns({
        "source_row": F.regexp_extract("field_name", pattern, 1).cast("int"), "header": F.regexp_extract("field_name", pattern, 2), "entity_type": kinds[F.col("category")], "source_page": F.coalesce("page_number", F.lit(1)),
    })
    mapped = rows.join(F.broadcast(dim.drop("entity_type")), ["category", "header"], "left")
    account = F.col("entity_type") == "operating_account_period"
    used = mapped.filter(F.col("target").isNotNull() | account)
    key = ["document_id", "category", "entity_type", "source_page", "source_row"]
    cell = F.struct("cell_id", "target", F.when(F.col("target").isNull(), F.col("header")).alias("header"), "value")
    rows = used.groupBy(*key).agg(F.array_sort(F.collect_list(cell)).alias("__cells"))

    def last(name: str) -> Column:
        """The value of the greatest cell id per name, as a map in the order of names; null without any."""
        later = lambda x, i: F.exists(F.slice("__cells", i + 2, F.size("__cells")), lambda y: y[name].eqNullSafe(x[name]))
        kept = F.filter("__cells", lambda x, i: x[name].isNotNull() & ~later(x, i))
        entries = F.transform(kept, lambda x: F.struct(x[name], F.when(x["cell_id"].isNotNull(), x["value"])))
        return F.when(F.size(kept) > 0, F.map_from_entries(F.array_sort(entries)))

    ids = F.array_distinct(F.filter(F.transform("__cells", lambda x: x["cell_id"]), lambda c: c.isNotNull()))
    joined = rows.select(*key, ids.alias("source_value_ids"), last("target").alias("data"), last("header").alias("period_values")).filter("data IS NOT NULL OR period_values IS NOT NULL")
    complete = joined.filter((F.col("entity_type") != "operating_account_period") | F.coalesce(F.map_contains_key("data", F.lit("account_label")), F.lit(False)))
    return complete.withColumn("data_sha256", F.sha2(F.to_json(F.struct("data", "period_values")), 256))


def facility_rollup(facilities: DataFrame, key: str = "county_fips") -> DataFrame:
    """AGG-27: facilities, operational ones and known capacity."""
    return facilities.groupBy(key).agg(
        F.count(F.lit(1)).alias("facilities"), F.count_if(F.lower("status") == "operational").alias("operational"), F.sum("capacity").alias("known_capacity")
    )


def freshness(updated: Column, as_of: str) -> Column:
    age = F.datediff(F.lit(as_of).cast("date"), updated)
    return F.when(updated.isNull(), "unknown").when(age < 0, "future_dated").when(age <= 90, "current").otherwise("stale")


def jurisdiction(requests: DataFrame, policies: DataFrame, facilities: DataFrame, incentives: DataFrame, states: DataFrame, as_of: str) -> DataFrame:
    """TXT-07, JN-21: policy, facility, incentive and state evidence per requested county, with a freshness class.

    ``incentives`` carry an array of counties, exploded once before the join.
    """
    counts = incentives.select(F.explode("fips_list").alias("county_fips")).groupBy("county_fips").agg(F.count(F.lit(1)).alias("incentives"))
    rows = requests.withColumn("state_fips", F.substring("county_fips", 1, 2))
    rows = rows.join(policies.select("county_fips", "policy", "updated", "pipeline_verified"), "county_fips", "left").join(facility_rollup(facilities), "county_fips", "left")
    rows = rows.join(counts, "county_fips", "left").join(states.select("state_fips", "regulation"), "state_fips", "left").fillna(0, ["facilities", "operational", "incentives"])
    county = F.col("policy").isNotNull() | (F.col("facilities") > 0) | (F.col("incentives") > 0)
    fresh = freshness(F.col("updated"), as_of)
    present = F.col("policy").isNotNull().cast("int") + (F.col("facilities") > 0).cast("int") + (F.col("incentives") > 0).cast("int") + F.col("regulation").isNotNull().cast("int")
    return rows.withColumns({
        "match_status": F.when(county, "matched").when(F.col("regulation").isNotNull(), "state_only").otherwise("no_match"), "freshness": fresh, "datasets_present": present,
        "verified": F.coalesce(F.col("pipeline_verified") & (fresh == "current"), F.lit(False)),
    })
