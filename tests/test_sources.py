"""Raw files to canonical rows, validation, immutable store and tamper detection."""

import pytest
from pyspark.sql import functions as F

from parcelflow.operators import validate
from parcelflow.sources import panels, public, store


def write(path, text):
    path.write_text(text)
    return str(path)


def values(df):
    return sorted((r.metric, r.geography_id, r.observation_date, r.value) for r in df.collect())


def test_national_series_drops_placeholders_and_validates(spark, tmp_path):
    path = write(tmp_path / "fred.csv", "observation_date,DGS10\n2024-01-02,4.0\n2024-01-03,.\n")
    rows = public.canonical(public.read_fred(spark, path, "DGS10"), source_id="fred_public", dataset="macro", version="v1", retrieved_at="2024-02-01T00:00:00Z")
    valid, bad = validate.split(validate.observation_errors(rows))
    assert bad.count() == 0
    row = valid.first()
    assert (row.metric, str(row.observation_date), float(row.value), row.period_type) == ("treasury_10y", "2024-01-02", 4.0, "daily")
    assert row.normalized_row_hash == "sha256:" + row.observation_id


def test_county_labour(spark, tmp_path):
    path = write(tmp_path / "la.tsv", "series_id \tyear\tperiod\tvalue\tfootnote_codes\nLAUCN010010000000003 \t2024\tM01\t3.1\t\nLAUCN010010000000003\t2024\tM13\t3.0\t\nLAUST010000000000003\t2024\tM01\t9\t\n")
    assert values(public.read_bls_laus(spark, path)) == [("unemployment_rate", "01001", "2024-01", "3.1")]


def test_nested_api_scales_thousands(spark, tmp_path):
    path = write(tmp_path / "api.json", '{"status":"REQUEST_SUCCEEDED","Results":{"series":[{"seriesID":"LNS12000000","data":[{"year":"2024","period":"M02","value":"160.5"}]}]}}')
    row = public.read_bls_api(spark, path).first()
    assert (row.metric, row.unit, float(row.value)) == ("employment", "persons", 160500.0)
    failed = write(tmp_path / "failed.json", '{"status":"REQUEST_NOT_PROCESSED","Results":null}')
    with pytest.raises(Exception, match="REQUEST_NOT_PROCESSED"):
        public.read_bls_api(spark, failed).collect()


def test_wide_year_columns_and_permits_and_rents(spark, tmp_path):
    bea = write(tmp_path / "bea.csv", 'GeoFIPS,GeoName,Region,TableName,LineCode,IndustryClassification,Description,Unit,2024,2025\n"01001",A,5,CAINC1,1,...,Income,Thousands,"1,000",(NA)\n"01000",B,5,CAINC1,1,...,Income,Thousands,5,6\n')
    assert values(public.read_bea(spark, bea, "CAINC1")) == [("personal_income", "01", "2024", "5"), ("personal_income", "01", "2025", "6"), ("personal_income", "01001", "2024", "1000")]
    bps = write(tmp_path / "bps.csv", "state_fips,county_fips,total_permits,total_units,units_1,units_2_to_4,units_5_plus\n1,1,3,10,2,3,5\n")
    assert len(values(public.read_permits(spark, bps, 2024))) == 5
    fmr = write(tmp_path / "fmr.csv", "fips,state,county,cousub,name,msa26,fmr26_0,fmr26_2,fmr99_2\n0100199999,1,1,99999,X,M,$900,\"1,050\",\n0900112345,9,1,12345,Y,M,700,,500\n")
    rows = {(r.geography_type, r.geography_id, r.observation_date, r.property_subtype): r.value for r in public.read_fmr(spark, fmr).collect()}
    assert rows[("county", "01001", "2026", "two_bedroom")] == "1050"
    assert rows[("county_subdivision", "0900112345", "1999", "two_bedroom")] == "500"


def test_matrix_survey_and_sheet_and_crosswalk(spark, tmp_path):
    acs = write(tmp_path / "acs.json", '[["NAME","B01003_001E","B19013_001E","state","county"],["A","100","-666666666","01","001"]]')
    assert values(public.read_acs(spark, acs, 2024)) == [("population", "01001", "2024", "100")]
    table = write(tmp_path / "acs.dat", "GEO_ID|B01003_E001\n0500000US01001|55\n0400000US01|9\n")
    assert values(public.read_acs(spark, table, 2023, "B01003_001E")) == [("population", "01001", "2023", "55")]
    sheet = write(tmp_path / "hvs.csv", "2020,\n1st Quarter,6.6\n2nd Quarter,NA\n2020r,\n1st Quarter,6.7\n")
    got = sorted((r.source_series, r.observation_date, r.value) for r in public.read_hvs(spark, sheet, "rental_vacancy_rate").collect())
    assert got == [("CPS_HVS_rental_vacancy_rate_US_published", "2020-Q1", "6.6"), ("CPS_HVS_rental_vacancy_rate_US_revised", "2020-Q1", "6.7")]
    walk = write(tmp_path / "cw.csv", "CBSA Code,CBSA Title,County/County Equivalent,State Name,FIPS State Code,FIPS County Code\n12345,T,A,S,1,1\n")
    row = public.read_crosswalk(spark, walk).first()
    assert (row.county_fips, row.cbsa, row.observation_date) == ("01001", "12345", "2023-07-21")


def test_covered_employment_and_annual_county(spark, tmp_path):
    head = "area_fips,own_code,industry_code,agglvl_code,size_code,year,qtr,disclosure_code," + ",".join(public.QCEW)
    path = write(tmp_path / "q.csv", f"{head}\n01001,0,10,70,0,2024,A,,1,2,3,4,5\n01001,5,10,70,0,2024,A,,1,2,3,4,5\n01003,0,10,70,0,2024,A,N,1,2,3,4,5\n")
    assert len(values(public.read_qcew(spark, path))) == 5
    annual = write(tmp_path / "a.csv", "State FIPS Code,County FIPS Code,Year,Labor Force,Employed,Unemployed,Unemployment Rate (%)\n1,1,2024,\"1,000\",960,N.A.,4.0\n")
    assert {(r[0], r[3]) for r in values(public.read_bls_annual(spark, annual))} == {("labor_force", "1000"), ("employment", "960"), ("unemployment_rate", "4.0")}


def test_economic_snapshot(spark, tmp_path):
    county = write(tmp_path / "c.json", '{"counties":{"01001":{"history":[{"year":"2023","population":"10","unemployment_rate":"0.03"}]}}}')
    series = write(tmp_path / "s.json", '{"series":{"DGS10":{"observations":[["2024-01-02","4.0"],["2024-01-03","."]]}}}')
    got = values(public.read_economic_snapshot(spark, county, series, {"DGS10": "treasury_rate"}))
    assert ("population", "01001", "2023", "10") in got and ("treasury_rate", "US", "2024-01-02", "0.04") in got and len(got) == 3


def test_market_panel(spark, tmp_path):
    path = write(tmp_path / "p.csv", "period,market_id,market_name,property_type,source,source_date,source_reference,usage_rights,county_fips,rent_growth_12m,vacancy_rate,lease_comp_count\n2024-03-31,m1,M,office,s,2024-04-01,r,ok,01001,0.03,0.1,7\n2024-06-30,m1,M,castle,s,2024-04-01,r,ok,1,2.5,,\n")
    judged = validate.panel_row_errors(panels.read_market_panel(spark, path), list(panels.RATES), list(panels.LEVELS), panels.PANEL_PROPERTY_TYPES)
    valid, bad = validate.split(judged)
    assert sorted(bad.first().errors) == ["county_fips_invalid", "property_type_unsupported", "rate_out_of_range"]
    rows = {r.metric: r for r in panels.panel_observations(valid).collect()}
    assert set(rows) == {"rent_growth_12m", "vacancy_rate", "lease_comp_count"} and rows["vacancy_rate"].sample_count == 7 and rows["lease_comp_count"].sample_count is None


def test_filing_rows(spark):
    lines = ["Same store", "Atlanta, GA 1,200 110.0 100.0 10.0% 44.0 40.0 10.0% 66.0 60.0 10.0% 1,650 1,500 10.0%", "Boise 1,000 110.0 100.0 12.0% 44.0 40.0 10.0% 66.0 60.0 10.0% 1,650 1,500 10.0%", "End"]
    rows = panels.filing_rows(spark.createDataFrame([("f", lines)], "file string, lines array<string>"), "Same store", "End")
    assert {r.market: list(r.errors) for r in rows.collect()} == {"Atlanta, GA": [], "Boise": ["growth_cross_check"]}
    metrics = {r.metric: r.value for r in panels.filing_metrics(rows).collect()}
    assert len(metrics) == 9 and metrics["inventory"] == 1200 and metrics["rent_growth_yoy"] == pytest.approx(0.1)


def test_store_is_immutable_and_detects_tampering(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([("a", "2024-01-01", 1.0), ("b", "2024-01-02", 2.0)], "observation_id string, observation_date string, value double")
    first = store.publish_version(df, root, source_id="s", dataset_id="d", version="1")
    assert first["outcome"] == "published" and store.publish_version(df.repartition(3), root, source_id="s", dataset_id="d", version="1")["outcome"] == "unchanged"
    with pytest.raises(store.StoreError):
        store.publish_version(df.limit(1), root, source_id="s", dataset_id="d", version="1")
    with pytest.raises(store.StoreError):
        store.publish_version(df.union(df), root, source_id="s", dataset_id="d", version="dup")
    with pytest.raises(store.StoreError):
        store.publish_version(df.limit(0), root, source_id="s", dataset_id="d", version="empty")
    second = store.publish_version(df.withColumn("value", F.col("value") + 1), root, source_id="s", dataset_id="d", version="2")
    assert second["predecessor_hash"] == first["manifest_hash"] and store.ledger(spark, root).count() == 2
    assert store.scan_versions(spark, root).agg(F.sum("value")).first()[0] == 5.0
    assert store.verify_store(spark, root).filter("problem IS NOT NULL").count() == 0
    df.withColumn("value", F.lit(9.0)).write.mode("append").parquet(second["path"])
    assert [r.problem for r in store.verify_store(spark, root).filter("problem IS NOT NULL").collect()] == ["content_changed"]


def test_publish_tables_and_review_extract(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x")], "id int, note string")
    root = str(tmp_path / "panels")
    assert store.publish_tables({"panel": df}, root, {"v": 1})["outcome"] == "published"
    assert store.publish_tables({"panel": df}, root, {"v": 1})["outcome"] == "unchanged"
    store.write_review_extract(df, str(tmp_path / "review"), ["comment"])
    assert spark.read.option("header", True).csv(str(tmp_path / "review")).first().note == "'=x"


def test_streamed_batches_are_one_version(spark, tmp_path):
    from parcelflow.streaming import refresh

    rows = [(str(i), f"2024-01-{i % 28 + 1:02d}", float(i)) for i in range(30)]
    schema = "observation_id string, observation_date string, value double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "raw"))
    root = str(tmp_path / "store")
    for attempt in ("first", "replay"):
        stream = refresh.file_stream(spark, str(tmp_path / "raw"), schema, max_files=1)
        refresh.incremental_refresh(stream, lambda df: df, root, str(tmp_path / attempt), source_id="s", dataset_id="d").awaitTermination()
    assert store.ledger(spark, root).count() == 3 and store.scan_versions(spark, root).count() == 30
    assert store.verify_store(spark, root).filter("problem IS NOT NULL").count() == 0
    with pytest.raises(store.StoreError, match="unique over the batches"):
        store.publish_version(spark.createDataFrame(rows[:1], schema), root, source_id="s", dataset_id="d", version="stream", batch="again")


def test_first_load_reports_conflicting_contents(spark, tmp_path):
    files = spark.createDataFrame([("p", bytearray(b"one")), ("p", bytearray(b"two")), ("q", bytearray(b"x"))], "path string, content binary")
    first = {(r.path, r.outcome) for r in store.snapshot_raw(files, str(tmp_path)).collect()}
    assert first == {("p", "stored"), ("p", "conflict"), ("q", "stored")}
    again = sorted((r.path, r.outcome) for r in store.snapshot_raw(files, str(tmp_path)).collect())
    assert again == [("p", "conflict"), ("p", "unchanged"), ("q", "unchanged")]


def test_html_tables_nest_and_decode(spark):
    page = "<table><tr><td>a<table><tr><td>in&#160;side</td></tr></table></td><td>b&mdash;c &#38; &amp;d</td></tr><tr><td> </td></tr></table><p>x</p><table><tr><th>open<td>end"
    got = [(r.table_no, r.row_no, list(r.cells)) for r in panels.html_tables(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).collect()]
    assert got == [(0, 0, ["a", "b\u2014c & &d"]), (1, 0, ["in side"]), (2, 0, ["open", "end"])]
