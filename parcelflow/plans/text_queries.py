"""Documents, pages, fields, cells and jurisdiction evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.operators import text as t
from parcelflow.plans import bindings as b
from parcelflow.plans.registry import query
from parcelflow.sources import panels

# Phrases that occur in the invented prose of the documents.
PROSE = {"rent_roll": ("the", "and", "of"), "appraisal": ("der", "die", "und"), "debt_quote": ("le", "la", "que"), "commercial_lease": ("el", "los", "para")}


def _classify_sql(name_expr, text_expr, source, categories, columns):
    hay = f"regexp_replace(lower(concat_ws(' ', {name_expr}, {text_expr})), '[_-]', ' ', 'g')"
    scores = ", ".join("(" + " + ".join(f"case when contains(hay, '{p}') then 2 else 0 end" for p in phrases) + f") as s{i}" for i, phrases in enumerate(categories.values()))
    names = list(categories)
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(names))) + ")"
    pick = "case " + " ".join(f"when s{i} = best then '{n}'" for i, n in enumerate(names)) + " end"
    return f"""with h as (select *, {hay} as hay from {source}), s as (select *, {scores} from h), m as (select *, {best} as best from s)
select {columns}, case when best > 0 then {pick} else 'unknown' end as category, round(case when best > 0 then least(0.98::double, 0.55::double + best * 0.08::double) else 0.2::double end, 4) as confidence, cast(best as integer) as score from m"""


@query("classify_docs", _classify_sql("source", "text", "documents", PROSE, "doc_id"))
def classify_docs(spark, sf_dir):
    return t.classify(b.table(spark, sf_dir, "documents"), "source", "text", PROSE).select("doc_id", "category", "confidence", "score")


@query("classify_deal_documents", _classify_sql("role", "text", "conversations", t.CATEGORIES, "conv_id, turn"))
def classify_deal_documents(spark, sf_dir):
    return t.classify(b.table(spark, sf_dir, "conversations"), "role", "text").select("conv_id", "turn", "category", "confidence", "score")


def memoranda(spark, sf_dir):
    """One short memorandum per part, written from its columns."""
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("Property name: "), "p_name", F.lit("\nAsking price: $"), F.format_string("%.2f", F.col("p_retailprice") * 1000), F.lit("\nTotal units: "), (k % 400).cast("string"),
        F.lit("\nCap rate: "), F.format_string("%.1f", (k % 90) / 10.0), F.lit("%\nYear built: "), (k % 70 + 1950).cast("string"), F.lit("\nForecast start date: "), F.format_string("%d/%d/%d", k % 12 + 1, k % 28 + 1, k % 30 + 1995),
    )
    return b.table(spark, sf_dir, "part").select(k.alias("document_id"), F.lit("offering_memorandum").alias("category"), text.alias("text"))


@query("extract_fields", """
with p as (select *, p_partkey as k from part)
select k as document_id, 'property_name' as field_name, p_name as raw_value, p_name as normalized_value, 0.82::double as confidence from p
union all select k, 'asking_price', printf('%.2f', p_retailprice * 1000), regexp_replace(regexp_replace(printf('%.2f', p_retailprice * 1000), '0+$', ''), '\\.$', ''), 0.82 from p
union all select k, 'unit_count', cast(k % 400 as varchar), cast(k % 400 as varchar), 0.82 from p
union all select k, 'broker_stated_cap_rate', printf('%.1f', (k % 90) / 10.0) || '%', case when k % 90 = 0 then '0' else regexp_replace(printf('%.3f', (k % 90) / 1000.0), '0+$', '') end, 0.82 from p
union all select k, 'year_built', cast(k % 70 + 1950 as varchar), cast(k % 70 + 1950 as varchar), 0.82 from p
union all select k, 'forecast_start_date', concat(k % 12 + 1, '/', k % 28 + 1, '/', k % 30 + 1995), cast(make_date(k % 30 + 1995, case when k % 28 + 1 > 12 then k % 12 + 1 else k % 12 + 1 end, k % 28 + 1) as varchar), 0.82 from p""")
def extract_fields(spark, sf_dir):
    return t.extract_fields(memoranda(spark, sf_dir), "text").select("document_id", "field_name", "raw_value", "normalized_value", "confidence")


@query("normalize_numbers", """
select l_orderkey, l_linenumber, l_partkey, cast(-cast(l_extendedprice as decimal(18,2)) as double) as value from lineitem""")
def normalize_numbers(spark, sf_dir):
    """Bracketed, grouped currency text read back as negative decimals."""
    raw = F.concat(F.lit("($"), F.format_number("l_extendedprice", 2), F.lit(")"))
    return b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.number(raw).cast("double").alias("value"))


@query("normalize_dates", """
select o_orderkey, cast(o_orderdate as date) as value, month(o_orderdate) <= 12 and day(o_orderdate) <= 12 and month(o_orderdate) <> day(o_orderdate) as ambiguous from orders""")
def normalize_dates(spark, sf_dir):
    d = F.to_date("o_orderdate")
    parsed = t.day(F.concat_ws("/", F.month(d), F.dayofmonth(d), F.year(d)))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", parsed["value"].alias("value"), parsed["ambiguous"].alias("ambiguous"))


@query("html_tables", """
with u as (select page_id, unnest(regexp_extract_all(html, '(?is)<ul>(.*?)</ul>', 1)) as block, unnest(range(len(regexp_extract_all(html, '(?is)<ul>(.*?)</ul>', 1)))) as table_no from pages),
c as (select page_id, table_no, regexp_extract_all(block, '(?is)<li>(.*?)</li>', 1) as cells from u)
select page_id, cast(table_no as integer) as table_no, cast(0 as integer) as row_no, array_to_string(list_transform(cells, lambda x: trim(regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))), '|') as cells from c where len(cells) > 0""")
def html_tables(spark, sf_dir):
    """Navigation lists of every page, rewritten as one-row tables and parsed."""
    html = F.col("html")
    for old, new in (("<ul>", "<table><tr>"), ("</ul>", "</tr></table>"), ("<li>", "<td>"), ("</li>", "</td>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    out = panels.html_tables(b.table(spark, sf_dir, "pages").withColumn("html", html))
    return out.withColumn("cells", F.array_join("cells", "|"))


@query("table_cells", """
with c as (select o_orderkey as document_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as integer) as r, l_partkey, l_quantity from lineitem join orders on o_orderkey = l_orderkey)
select document_id, 'row.' || (r + 1) || '.part_no' as field_name, 'P-' || l_partkey as raw_value from c union all select document_id, 'row.' || (r + 1) || '.quantity', printf('%.1f', l_quantity) from c""")
def table_cells(spark, sf_dir):
    """Order lines as document tables with a header row, flattened to cells."""
    return t.table_cells(order_tables(spark, sf_dir), ["document_id"]).select("document_id", "field_name", "raw_value")


def order_tables(spark, sf_dir):
    from parcelflow.functions import keyed

    lines = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    placed = keyed.dense_positions(lines, ["document_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], F.col("l_linenumber"))
    body = placed.select("document_id", (F.col("position") + 1).cast("int").alias("row_no"), F.array(F.concat(F.lit("P-"), F.col("l_partkey").cast("string")), F.format_string("%.1f", "l_quantity")).alias("cells"))
    head = lines.select("document_id").distinct().select("document_id", F.lit(0).alias("row_no"), F.array(F.lit("Part No."), F.lit(" Quantity")).alias("cells"))
    return body.unionByName(head)


@query("entity_pivot", """
with c as (select l_orderkey as document_id, l_linenumber, count(*) as n, max_by(l_quantity, l_partkey) as q from lineitem group by all)
select document_id, 1 as source_page, cast(l_linenumber as integer) as source_row, 'operating_account_period' as entity_type, 'line ' || l_linenumber as account_label, printf('%.2f', l_extendedprice) as jan, cast(3 as integer) as source_values
from (select l_orderkey as document_id, l_linenumber, max(l_extendedprice) as l_extendedprice from lineitem group by all)""")
def entity_pivot(spark, sf_dir):
    """Lines as statement rows: label, classification and one period column each."""
    lines = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    cells = F.array(*[
        F.struct(F.concat(F.lit("row."), F.col("l_linenumber").cast("string"), F.lit(f".{h}")).alias("field_name"), v.alias("value")) for h, v in (
            ("account_name", F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))), ("classification", F.lit("expense")), ("jan", F.format_string("%.2f", "price")))
    ])
    rows = lines.select("document_id", F.lit("t12_operating_statement").alias("category"), F.lit(1).alias("page_number"), F.inline(cells))
    rows = rows.withColumn("cell_id", F.concat_ws("/", "document_id", "field_name"))
    out = t.derive_entities(rows)
    return out.select(
        "document_id", "source_page", "source_row", "entity_type", F.col("data")["account_label"].alias("account_label"), F.col("period_values")["jan"].alias("jan"), F.size("source_value_ids").alias("source_values"))


@query("table_candidates", """
with r as (select l_orderkey as report, l_returnflag as label, sum(cast(l_quantity as decimal(18,2))) as v from lineitem group by all),
ok as (select report from r group by 1 having count(*) = 3)
select report, label, case label when 'A' then 'vacancy_rate' when 'N' then 'asking_rent' else 'inventory' end as metric, round(cast(v as double) / case when label = 'A' then 100 else 1 end, 6) as number, report in (select report from ok) as compatible
from r where report in (select report from ok)""")
def table_candidates(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("report"), F.col("l_returnflag").alias("label")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("v"))
    rows = lines.withColumn("value", F.concat(F.col("v").cast("string"), F.when(F.col("label") == "A", "%").otherwise("")))
    profile = {"A": ("vacancy_rate", "decimal_fraction", "market_vacancy"), "N": ("asking_rent", "USD_per_unit_month", "asking_rent"), "R": ("inventory", "units", "market_inventory")}
    out = panels.table_candidates(rows, profile, ["report"]).filter("compatible")
    return out.select("report", "label", "metric", F.round("number", 6).alias("number"), "compatible")


@query("missing_quarters", """
with h as (select distinct c_nationkey as series, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 as idx from orders join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT' and c_mktsegment = 'BUILDING'),
s as (select series, unnest(range(min(idx), max(idx) + 1)) as idx from h group by 1)
select series, (idx // 4) || '-Q' || (idx % 4 + 1) as missing_period from s anti join h using (series, idx)""")
def missing_quarters(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").join(b.table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).filter("o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING'")
    label = F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    return panels.missing_quarters(rows.select(F.col("c_nationkey").alias("series"), label.alias("period")), ["series"], "period")


@query("report_inventory", """
select url as filename, sha256(html) as sha256, octet_length(encode(html)) as bytes from (select 'x' || page_id || '.html' as url, html from pages)""")
def report_inventory(spark, sf_dir):
    """Pages as report files: digest and size of every document."""
    files = b.table(spark, sf_dir, "pages").select(F.concat(F.lit("inbox/x"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    out = panels.discover_reports(files, {"survey": "Survey"}, ("office", "retail"))
    return out.select("filename", "sha256", F.col("bytes").cast("long").alias("bytes"))


@query("extraction_reconciliation", "with " + b.SQL_LINES + ", " + b.sql_market_sums("sums", "geography_id") + """,
l as (select geography_id as market, year(period_start) * 4 + quarter(period_start) - 1 as idx, cast(price_sum as double) as level, case when cast(geography_id as integer) % 4 = 0 then 9.0::double end as wrong from sums)
select c.market, cast(c.idx as integer) as idx, round(c.level / p.level - 1, 6) as recomputed_growth, c.wrong is not null as mismatch from l c join l p on p.market = c.market and p.idx = c.idx - 4""")
def extraction_reconciliation(spark, sf_dir):
    from parcelflow.functions import periods

    rows = b.market_sums(spark, sf_dir, "geography_id").select(F.col("geography_id").alias("market"), periods.date_index("period_start", "quarterly").alias("idx"), F.col("price_sum").cast("double").alias("level"))
    prior = rows.select("market", (F.col("idx") + 4).alias("idx"), F.col("level").alias("p"))
    reported = rows.join(prior, ["market", "idx"], "left").withColumn("reported_growth", F.when(F.col("market").cast("int") % 4 == 0, 9.0).otherwise(F.col("level") / F.col("p") - 1)).drop("p")
    return panels.reconcile_extracted(reported).select("market", "idx", F.round("recomputed_growth", 6).alias("recomputed_growth"), "mismatch")


@query("facility_rollup", """
select lpad(cast(s_nationkey as varchar), 5, '0') as county_fips, count(*) as facilities, count(*) filter (where s_acctbal > 0) as operational, round(sum(s_acctbal), 2) as known_capacity from supplier group by 1""")
def facility_rollup(spark, sf_dir):
    return t.facility_rollup(_facilities(spark, sf_dir)).withColumn("known_capacity", F.round("known_capacity", 2))


def _facilities(spark, sf_dir):
    return b.table(spark, sf_dir, "supplier").select(
        F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("county_fips"), F.when(F.col("s_acctbal") > 0, "Operational").otherwise("planned").alias("status"), F.col("s_acctbal").alias("capacity"))


@query("jurisdiction_enrich", """
with f as (select s_nationkey, count(*) as facilities, count(*) filter (where s_acctbal > 0) as operational from supplier group by 1),
i as (select n_nationkey as nk, count(*) as incentives from nation join region on n_regionkey = r_regionkey and r_regionkey <> 2 group by 1),
p as (select c_nationkey, max(cast(o_orderdate as date)) as updated from orders join customer on c_custkey = o_custkey group by 1)
select c_custkey as request_id, lpad(cast(c.c_nationkey as varchar), 5, '0') as county_fips, coalesce(facilities, 0) as facilities, coalesce(incentives, 0) as incentives, 'matched' as match_status,
  case when date '1999-01-31' - updated < 0 then 'future_dated' when date '1999-01-31' - updated <= 90 then 'current' else 'stale' end as freshness
from customer c left join f on s_nationkey = c.c_nationkey left join i on nk = c.c_nationkey left join p on p.c_nationkey = c.c_nationkey""")
def jurisdiction_enrich(spark, sf_dir):
    fips = lambda c: F.lpad(F.col(c).cast("string"), 5, "0")
    orders = b.table(spark, sf_dir, "orders").join(b.table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    policies = orders.groupBy(fips("c_nationkey").alias("county_fips")).agg(F.max(F.to_date("o_orderdate")).alias("updated")).withColumns({"policy": F.lit("p"), "pipeline_verified": F.lit(True)})
    nations = b.table(spark, sf_dir, "nation").filter("n_regionkey <> 2")
    incentives = nations.groupBy("n_regionkey").agg(F.collect_list(fips("n_nationkey")).alias("fips_list"))
    states = nations.select(F.lit("00").alias("state_fips"), F.lit("r").alias("regulation")).distinct()
    requests = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), fips("c_nationkey").alias("county_fips"))
    out = t.jurisdiction(requests, policies, _facilities(spark, sf_dir), incentives, states, "1999-01-31")
    return out.select("request_id", "county_fips", "facilities", "incentives", "match_status", "freshness")
