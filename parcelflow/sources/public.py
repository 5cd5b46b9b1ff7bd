"""Readers of public raw files: one lazy DataFrame job per directory of files, canonical rows out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import periods
from parcelflow.operators.validate import blank
from parcelflow.schemas import OBSERVATION_COLUMNS

# Fixed values: (metric, unit, frequency) per national series.
FRED_SERIES = {
    "DFF": ("fed_funds_rate", "percent", "daily"), "SOFR": ("sofr", "percent", "daily"), "DGS2": ("treasury_2y", "percent", "daily"), "DGS5": ("treasury_5y", "percent", "daily"),
    "DGS10": ("treasury_10y", "percent", "daily"), "DGS30": ("treasury_30y", "percent", "daily"), "MORTGAGE30US": ("mortgage_rate", "percent", "weekly"),
    "CPIAUCSL": ("cpi", "index_1982_1984_100", "monthly"), "SUBLPDRCSM": ("cre_lending_standards_multifamily", "percent_net_respondents", "quarterly"),
    "SUBLPDRCSN": ("cre_lending_standards_nonresidential", "percent_net_respondents", "quarterly"), "SUBLPDRCDM": ("cre_loan_demand_multifamily", "percent_net_respondents", "quarterly"),
    "SUBLPDRCDN": ("cre_loan_demand_nonresidential", "percent_net_respondents", "quarterly"), "DRCRELEXFACBS": ("cre_loan_delinquency_rate", "percent", "quarterly"),
    "CREACBM027SBOG": ("cre_bank_loans", "billions_USD_current", "monthly"),
}
# Measure by series suffix; national employment series; annual county and covered-employment columns.
LAUS_SUFFIXES = {"03": ("unemployment_rate", "percent"), "04": ("unemployment", "persons"), "05": ("employment", "persons"), "06": ("labor_force", "persons")}
BLS_NATIONAL = {"LNS14000000": ("unemployment_rate", "percent"), "LNS12000000": ("employment", "thousands_persons"), "LNS11000000": ("labor_force", "thousands_persons"), "LNS13000000": ("unemployment", "thousands_persons")}
BLS_ANNUAL = {"laborforce": ("labor_force", "persons", "06"), "employed": ("employment", "persons", "05"), "unemployed": ("unemployment", "persons", "04"), "unemploymentrate": ("unemployment_rate", "percent", "03")}
QCEW = {
    "annual_avg_emplvl": ("covered_employment", "persons"), "annual_avg_estabs_count": ("annual_average_establishments", "establishments"), "total_annual_wages": ("total_annual_wages", "USD_current"),
    "annual_avg_wkly_wage": ("average_weekly_wage", "USD_current_per_week"), "avg_annual_pay": ("average_annual_pay", "USD_current_per_year"),
}
BEA_TABLES = {
    ("CAINC1", "1"): ("personal_income", "thousands_USD_current"), ("CAINC1", "2"): ("population", "persons"), ("CAINC1", "3"): ("personal_income_per_capita", "USD_current"),
    ("CAGDP1", "1"): ("gdp", "thousands_USD_current"),
}
ACS = {
    "B01003_001E": ("population", "persons"), "B11001_001E": ("households", "households"), "B19013_001E": ("median_household_income", "USD_current"), "B19301_001E": ("per_capita_income", "USD_current"),
    "B25001_001E": ("housing_units", "units"), "B25002_002E": ("occupied_housing_units", "units"), "B25002_003E": ("vacant_housing_units", "units"), "B25010_001E": ("average_household_size", "persons_per_household"),
    "B23025_001E": ("civilian_population_16_plus", "persons"), "B15003_022E": ("bachelors_degree_population", "persons"),
}
PERMITS = {
    "total_units": ("units_authorized_total", "units"), "units_1": ("single_family_units_authorized", "units"), "units_2_to_4": ("multifamily_2_to_4_units_authorized", "units"),
    "units_5_plus": ("multifamily_5_plus_units_authorized", "units"), "total_permits": ("residential_permits_total", "permits"),
}
BEDROOMS = {"0": "studio", "1": "one_bedroom", "2": "two_bedroom", "3": "three_bedroom", "4": "four_bedroom"}
HVS = {"rental_vacancy_rate": ("percent", 1956), "median_asking_rent_vacant_units": ("USD_current_per_month", 1988)}


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    df = spark.read.options(header=True, **options).csv(path)
    names = {c: c.strip().lstrip("﻿") for c in df.columns}
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in names.items()], F.col("_metadata.file_path").alias("__file"))


def require(df: DataFrame, columns: set[str], source: str) -> None:
    missing = sorted(columns - set(df.columns))
    if missing:
        raise ValueError(f"{source} schema changed; missing {missing}")


def _lookup(table: dict, position: int, key: Column) -> Column:
    return F.create_map(*[F.lit(v) for k, row in table.items() for v in (k, row[position])])[key]


def canonical(rows: DataFrame, *, source_id: str, dataset: str, version: str, retrieved_at: str, normalizer: str = "1.0.0") -> DataFrame:
    """Complete rows to the canonical columns; text values stay text until validation."""
    evidence = [c for c in rows.columns if not c.startswith("__")]
    out = rows.withColumn("raw_row_hash", F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*sorted(evidence))), 256)))
    fixed = {
        "source_id": F.lit(source_id), "source_dataset": F.lit(dataset), "source_version": F.lit(version), "retrieved_at": F.lit(retrieved_at), "as_of_date": F.lit(retrieved_at[:10]),
        "transformation_version": F.lit(f"source-normalizer/{normalizer}"), "raw_source_reference": F.col("__file") if "__file" in out.columns else F.lit("memory"),
        "currency": F.when(F.col("unit").startswith("USD"), "USD"),
    }
    out = out.withColumns(fixed)
    defaults = {"quality_level": F.lit("high"), "methodology": F.lit("Official source value; no imputation.")}
    for name in OBSERVATION_COLUMNS:
        if name not in out.columns:
            out = out.withColumn(name, defaults.get(name, F.lit(None).cast("string")))
    return out.select(*OBSERVATION_COLUMNS)


def read_fred(spark: SparkSession, path: str, series: str) -> DataFrame:
    """SRC-01: date and one series column; placeholder values are dropped, frequency is kept."""
    df = _csv(spark, path)
    day = "observation_date" if "observation_date" in df.columns else "DATE"
    require(df, {day, series}, "national series")
    metric, unit, frequency = FRED_SERIES[series]
    rows = df.filter(~F.coalesce(F.col(series), F.lit("")).isin("", ".", "ND"))
    return rows.select(
        F.lit(series).alias("source_series"), F.lit("national").alias("geography_type"), F.lit("US").alias("geography_id"), F.col(day).alias("observation_date"),
        F.lit(frequency).alias("period_type"), F.lit(metric).alias("metric"), F.col(series).alias("value"), F.lit(unit).alias("unit"), "__file",
    )


def _years(df: DataFrame, year: Column, first: int | None, last: int | None) -> DataFrame:
    if first:
        df = df.filter(year >= first)
    return df.filter(year <= last) if last else df


def read_bls_laus(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """SRC-02: monthly county labour series; annual averages are skipped."""
    df = _csv(spark, path, sep="\t")
    require(df, {"series_id", "year", "period", "value"}, "county labour")
    suffix = F.substring("series_id", -2, 2)
    rows = df.filter((F.col("period") != "M13") & F.col("series_id").startswith("LAUCN") & (F.length("series_id") >= 18) & suffix.isin(*LAUS_SUFFIXES))
    rows = _years(rows, F.col("year").cast("int"), first, last)
    fips = F.substring("series_id", 6, 5)
    return rows.select(
        F.col("series_id").alias("source_series"), F.lit("county").alias("geography_type"), fips.alias("geography_id"), F.concat("year", F.lit("-"), F.substring("period", 2, 2)).alias("observation_date"),
        F.lit("monthly").alias("period_type"), _lookup(LAUS_SUFFIXES, 0, suffix).alias("metric"), "value", _lookup(LAUS_SUFFIXES, 1, suffix).alias("unit"), F.substring(fips, 1, 2).alias("state_fips"), fips.alias("county_fips"), "__file",
    )


def read_bls_api(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: nested national payloads; published thousands become persons.  A payload that reports a failure raises."""
    payload = "status string, Results struct<series: array<struct<seriesID: string, data: array<struct<year: string, period: string, value: string>>>>>"
    df = spark.read.schema(payload).json(path, multiLine=True).select("status", "Results", F.col("_metadata.file_path").alias("__file"))
    failed = F.raise_error(F.concat(F.lit("failed payload in "), F.col("__file"), F.lit(": "), F.coalesce("status", F.lit("no status")))).cast(df.schema["Results"].dataType)
    df = df.withColumn("Results", F.when(F.col("status") == "REQUEST_SUCCEEDED", F.col("Results")).otherwise(failed))
    rows = df.select("__file", F.explode("Results.series").alias("s")).select("__file", "s.seriesID", F.explode("s.data").alias("d"))
    rows = rows.filter((F.col("d.period") != "M13") & F.col("seriesID").isin(*BLS_NATIONAL))
    thousands = _lookup(BLS_NATIONAL, 1, F.col("seriesID")) == "thousands_persons"
    value = F.col("d.value").cast("decimal(28,6)")
    return rows.select(
        F.col("seriesID").alias("source_series"), F.lit("national").alias("geography_type"), F.lit("US").alias("geography_id"), F.concat("d.year", F.lit("-"), F.substring("d.period", 2, 2)).alias("observation_date"),
        F.lit("monthly").alias("period_type"), _lookup(BLS_NATIONAL, 0, F.col("seriesID")).alias("metric"), F.when(thousands, value * 1000).otherwise(value).cast("string").alias("value"),
        F.when(thousands, "persons").otherwise(_lookup(BLS_NATIONAL, 1, F.col("seriesID"))).alias("unit"), "__file",
    )


def _long(df: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    return df.unpivot([*keep, "__file"], fields, "__field", "value")


def _clean(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, "[$,%]", ""))


def read_bls_annual(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """SRC-04: annual county table with free-form headers."""
    df = _csv(spark, path)
    import re

    names = {c: re.sub(r"[^a-z0-9]", "", c.lower()) for c in df.columns if c != "__file"}
    names = {c: "unemploymentrate" if n.startswith("unemploymentrate") else n for c, n in names.items()}
    df = df.withColumnsRenamed(names)
    require(df, {"statefipscode", "countyfipscode", "year", *BLS_ANNUAL}, "annual county labour")
    state, county = (F.lpad(F.split_part(F.col(c), F.lit("."), F.lit(1)), w, "0") for c, w in (("statefipscode", 2), ("countyfipscode", 3)))
    df = df.withColumns({"state_fips": state, "county_fips": F.concat(state, county)}).filter(F.col("county_fips").rlike(r"^\d{5}$") & F.col("year").isNotNull())
    rows = _long(_years(df, F.col("year").cast("int"), first, last), ["state_fips", "county_fips", "year"], list(BLS_ANNUAL))
    rows = rows.filter(~F.coalesce(F.col("value"), F.lit("")).isin("", "N.A."))
    f = F.col("__field")
    return rows.select(
        F.concat(F.lit("LAUCN"), "county_fips", F.lit("0000000"), _lookup(BLS_ANNUAL, 2, f)).alias("source_series"), F.lit("county").alias("geography_type"), F.col("county_fips").alias("geography_id"), F.col("year").alias("observation_date"),
        F.lit("annual").alias("period_type"), _lookup(BLS_ANNUAL, 0, f).alias("metric"), _clean(F.col("value")).alias("value"), _lookup(BLS_ANNUAL, 1, f).alias("unit"), "state_fips", "county_fips", "__file",
    )


def read_qcew(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: all-industry, all-ownership annual county rows that are not suppressed."""
    df = _csv(spark, path)
    require(df, {"area_fips", "own_code", "industry_code", "year", "qtr", "disclosure_code", *QCEW}, "covered employment")
    keep = (
        F.col("area_fips").rlike(r"^\d{5}$") & ~F.col("area_fips").endswith("000") & (F.col("own_code") == "0") & (F.col("industry_code") == "10")
        & (F.upper("qtr") == "A") & (F.upper(F.coalesce("disclosure_code", F.lit(""))) != "N")
    )
    rows = _long(df.filter(keep), ["area_fips", "year"], list(QCEW)).withColumn("value", _clean(F.col("value"))).filter("value IS NOT NULL AND value NOT IN ('', '-')")
    f = F.col("__field")
    return rows.select(
        F.concat(F.lit("QCEW:"), "area_fips", F.lit(":10:0:"), f).alias("source_series"), F.lit("county").alias("geography_type"), F.col("area_fips").alias("geography_id"), F.col("year").alias("observation_date"), F.lit("annual").alias("period_type"),
        _lookup(QCEW, 0, f).alias("metric"), "value", _lookup(QCEW, 1, f).alias("unit"), F.substring("area_fips", 1, 2).alias("state_fips"), F.col("area_fips").alias("county_fips"), "__file",
    )


def require_rows(df: DataFrame, source: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{source} contains no governed rows")
    return df


def read_bea(spark: SparkSession, path: str, table: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """SRC-06: year columns to rows; state rows end in 000."""
    df = _csv(spark, path, encoding="iso-8859-1")
    require(df, {"GeoFIPS", "LineCode", "Unit"}, "regional accounts")
    years = [c for c in df.columns if c.isdigit() and len(c) == 4 and (not first or int(c) >= first) and (not last or int(c) <= last)]
    lines = {line: row for (t, line), row in BEA_TABLES.items() if t == table}
    df = df.withColumns({"__fips": F.regexp_replace("GeoFIPS", r"\D", ""), "__line": F.trim("LineCode")}).filter(F.col("__line").isin(*lines) & F.length("__fips").isin(2, 5))
    rows = _long(df, ["__fips", "__line", "Unit"], years).filter(~F.coalesce(F.trim("value"), F.lit("")).isin("", "(NA)", "(D)"))
    state = (F.length("__fips") == 2) | F.col("__fips").endswith("000")
    return rows.select(
        F.concat(F.lit(f"{table}:"), "__line").alias("source_series"), F.when(state, "state").otherwise("county").alias("geography_type"), F.when(state, F.substring("__fips", 1, 2)).otherwise(F.col("__fips")).alias("geography_id"),
        F.col("__field").alias("observation_date"), F.lit("annual").alias("period_type"), _lookup(lines, 0, F.col("__line")).alias("metric"), _clean(F.col("value")).alias("value"), _lookup(lines, 1, F.col("__line")).alias("unit"),
        F.substring("__fips", 1, 2).alias("state_fips"), F.when(~state, F.col("__fips")).alias("county_fips"), F.concat(F.lit("original unit="), "Unit").alias("methodology"), "__file",
    )


def read_acs(spark: SparkSession, path: str, year: int, variable: str | None = None, geography: str = "county") -> DataFrame:
    """SRC-07: pipe table files for one variable, or header-plus-rows JSON matrices when no variable is given."""
    if variable is None:
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("m"), F.col("_metadata.file_path").alias("__file"))
        cells = text.select("__file", F.element_at("m", 1).alias("h"), F.explode(F.slice("m", 2, F.greatest(F.size("m"), F.lit(1)))).alias("r"))
        rows = cells.select("__file", F.map_from_arrays("h", "r").alias("c"))
        state, county, place = F.col("c")["state"], F.col("c")["county"], F.col("c")["place"]
        rows = rows.select(
            "__file", F.when(county.isNotNull(), "county").when(place.isNotNull(), "place").otherwise("state").alias("geography_type"), F.concat(state, F.coalesce(county, place, F.lit(""))).alias("geography_id"),
            state.alias("state_fips"), F.when(county.isNotNull(), F.concat(state, county)).alias("county_fips"), F.explode(F.map_filter("c", lambda k, v: k.isin(*ACS))).alias("variable", "value"),
        )
    else:
        table, column = variable.split("_")
        estimate = f"{table}_E{column[:-1]}"
        df = _csv(spark, path, sep="|")
        require(df, {"GEO_ID", estimate}, "survey table")
        prefix = {"state": "0400000US", "county": "0500000US", "place": "1600000US"}[geography]
        place = F.substring("GEO_ID", len(prefix) + 1, 20)
        rows = df.filter(F.col("GEO_ID").startswith(prefix)).select(
            "__file", F.lit(geography).alias("geography_type"), place.alias("geography_id"), F.substring(place, 1, 2).alias("state_fips"),
            (place if geography == "county" else F.lit(None).cast("string")).alias("county_fips"), F.lit(variable).alias("variable"), F.col(estimate).alias("value"),
        )
    number = F.col("value").try_cast("double")
    rows = rows.filter(number.isNotNull() & (number >= -1e8))
    return rows.select(
        F.col("variable").alias("source_series"), "geography_type", "geography_id", F.lit(str(year)).alias("observation_date"), F.lit("annual").alias("period_type"), _lookup(ACS, 0, F.col("variable")).alias("metric"), "value",
        _lookup(ACS, 1, F.col("variable")).alias("unit"), "state_fips", "county_fips", F.lit("ACS 5-year estimate; not a single-year measurement.").alias("methodology"), "__file",
    )


def read_permits(spark: SparkSession, path: str, year: int, layout: str = "canonical") -> DataFrame:
    """SRC-08: the named-column layout, or the positional annual file with structure triplets."""
    if layout == "canonical":
        df = _csv(spark, path)
        require(df, {"state_fips", "county_fips", *PERMITS}, "building permits")
        df = df.withColumns({"__state": F.lpad("state_fips", 2, "0"), "__county": F.lpad("county_fips", 3, "0")})
    else:
        text = spark.read.text(path).select(F.split("value", ",").alias("v"), F.col("_metadata.file_path").alias("__file")).filter("size(v) >= 18")
        cell = lambda i: F.trim(F.element_at("v", i + 1))
        number = lambda i: F.coalesce(cell(i).try_cast("long"), F.lit(0))
        digits = reduce(lambda a, b: a & b, [cell(i).rlike(r"^\d+$") for i in range(3)])
        df = text.filter(digits).select(
            "__file", F.lpad(cell(1), 2, "0").alias("__state"), F.lpad(cell(2), 3, "0").alias("__county"), (number(6) + number(9) + number(12) + number(15)).cast("string").alias("total_permits"),
            (number(7) + number(10) + number(13) + number(16)).cast("string").alias("total_units"), number(7).cast("string").alias("units_1"), (number(10) + number(13)).cast("string").alias("units_2_to_4"), number(16).cast("string").alias("units_5_plus"),
        ).filter("__state <> '00' AND __county <> '000'")
    rows = _long(df, ["__state", "__county"], list(PERMITS)).withColumn("value", _clean(F.col("value"))).filter(~blank(F.col("value")))
    f, fips = F.col("__field"), F.concat("__state", "__county")
    return rows.select(
        f.alias("source_series"), F.lit("county").alias("geography_type"), fips.alias("geography_id"), F.lit(str(year)).alias("observation_date"), F.lit("annual").alias("period_type"), _lookup(PERMITS, 0, f).alias("metric"), "value",
        _lookup(PERMITS, 1, f).alias("unit"), F.col("__state").alias("state_fips"), fips.alias("county_fips"), "__file",
    )


def read_fmr(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """SRC-09: fmrYY_B columns to (year, bedroom) rows; subdivisions stay apart from counties."""
    import re

    df = _csv(spark, path, encoding="iso-8859-1")
    require(df, {"fips", "state", "county", "cousub", "name"}, "fair market rents")
    fields = [c for c in df.columns if re.fullmatch(r"fmr\d{2}_[0-4]", c)]
    if not fields:
        raise ValueError("fair market rents contain no bedroom columns")
    df = df.withColumns({"__s": F.lpad("state", 2, "0"), "__c": F.lpad("county", 3, "0"), "__d": F.lpad("cousub", 5, "0")}).filter("__s RLIKE '^[0-9]{2}$' AND __c RLIKE '^[0-9]{3}$' AND __d RLIKE '^[0-9]{5}$'")
    rows = _long(df, ["fips", "__s", "__c", "__d"], fields).withColumn("value", _clean(F.col("value"))).filter(~blank(F.col("value")) & ~F.upper("value").isin("NA", "N/A", "N.A."))
    two = F.regexp_extract("__field", r"^fmr(\d{2})_", 1).cast("int")
    rows = rows.withColumns({"__year": F.when(two >= 83, two + 1900).otherwise(two + 2000), "__bed": F.substring("__field", -1, 1)})
    rows = _years(rows, F.col("__year"), first, last)
    county, part = F.concat("__s", "__c"), F.col("__d") != "99999"
    return rows.select(
        F.concat_ws("_", F.lit("HUD_FMR"), F.concat(F.lit("FY"), F.col("__year").cast("string")), "fips", F.concat("__bed", F.lit("BR"))).alias("source_series"), F.when(part, "county_subdivision").otherwise("county").alias("geography_type"),
        F.when(part, F.concat(county, "__d")).otherwise(county).alias("geography_id"), F.col("__year").cast("string").alias("observation_date"), F.lit("annual").alias("period_type"), F.lit("fair_market_rent").alias("metric"), "value",
        F.lit("USD_per_month").alias("unit"), F.col("__s").alias("state_fips"), county.alias("county_fips"), F.lit("multifamily").alias("property_type"),
        F.create_map(*[F.lit(v) for p in BEDROOMS.items() for v in p])[F.col("__bed")].alias("property_subtype"), "__file",
    )


def read_hvs(spark: SparkSession, path: str, series: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """SRC-10: report sheets exported as text; the year heading is carried to its quarter rows.

    A sheet is one small file, so it is parsed within its own row: lines become an array and
    the year is folded along it.
    """
    unit, earliest = HVS[series]
    sheets = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"), F.col("_metadata.file_path").alias("__file"))
    entry = F.struct(F.lit(None).cast("int").alias("year"), F.lit("published").alias("vintage"), F.lit(None).cast("int").alias("quarter"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("stop"))

    def fold(acc, line):
        cells = F.split(line, ",")
        label = F.trim(F.element_at(cells, 1))
        last_entry = F.element_at(acc, -1)
        heading = label.rlike(r"^\d{4}")
        quarter = F.regexp_extract(F.lower(label), r"^([1-4])(st|nd|rd|th)", 1).try_cast("int")
        stop = last_entry["stop"] | (F.lit(series == "median_asking_rent_vacant_units") & line.contains("Table 11B"))
        nxt = F.struct(
            F.when(heading, F.substring(label, 1, 4).try_cast("int")).otherwise(last_entry["year"]).alias("year"),
            F.when(heading, F.when(F.lower(F.substring(label, 5, 50)).contains("r"), "revised").otherwise("published")).otherwise(last_entry["vintage"]).alias("vintage"),
            F.when(~heading & ~stop, quarter).alias("quarter"), F.trim(F.try_element_at(cells, F.lit(2))).alias("value"), stop.alias("stop"),
        )
        return F.array_append(acc, nxt)

    rows = sheets.select("__file", F.explode(F.aggregate("lines", F.array(entry), fold)).alias("e")).select("__file", "e.*")
    rows = rows.filter("quarter IS NOT NULL AND year IS NOT NULL").filter(~blank(F.col("value")) & ~F.upper("value").isin("NA", "N/A", "N.A."))
    rows = _years(rows, F.col("year"), first or earliest, last or 2100)
    return rows.select(
        F.concat(F.lit(f"CPS_HVS_{series}_US_"), "vintage").alias("source_series"), F.lit("national").alias("geography_type"), F.lit("US").alias("geography_id"), F.concat(F.col("year").cast("string"), F.lit("-Q"), F.col("quarter").cast("string")).alias("observation_date"),
        F.lit("quarterly").alias("period_type"), F.lit(series).alias("metric"), "value", F.lit(unit).alias("unit"), F.lit("moderate").alias("quality_level"), "__file",
    )


def read_crosswalk(spark: SparkSession, path: str, vintage: str = "2023", effective: str = "2023-07-21") -> DataFrame:
    """SRC-11: county components of metropolitan areas for one delineation vintage."""
    import re

    df = _csv(spark, path)
    df = df.withColumnsRenamed({c: re.sub(r"[^a-z0-9]", "", c.lower()) for c in df.columns if c != "__file"})
    require(df, {"cbsacode", "cbsatitle", "fipsstatecode", "fipscountycode"}, "delineation")
    part = lambda c, w: F.lpad(F.split_part(F.col(c), F.lit("."), F.lit(1)), w, "0")
    rows = df.withColumns({"cbsa": part("cbsacode", 5), "__s": part("fipsstatecode", 2), "__c": part("fipscountycode", 3)}).filter("cbsa RLIKE '^[0-9]{5}$' AND __s RLIKE '^[0-9]{2}$' AND __c RLIKE '^[0-9]{3}$'")
    county = F.concat("__s", "__c")
    return rows.select(
        F.concat(F.lit("OMB_BULLETIN_23_01_"), "cbsa").alias("source_series"), F.lit("county").alias("geography_type"), county.alias("geography_id"), F.lit(effective).alias("observation_date"), F.lit("irregular").alias("period_type"),
        F.lit("county_cbsa_membership").alias("metric"), F.lit("1").alias("value"), F.lit("membership").alias("unit"), F.col("__s").alias("state_fips"), county.alias("county_fips"), "cbsa", F.lit(f"delineation vintage {vintage}").alias("methodology"), "__file",
    )


ECONOMIC_UNITS = {"population": "persons", "households": "households", "median_household_income": "USD_current", "unemployment_rate": "decimal_fraction", "inflation": "decimal_fraction", "treasury_rate": "decimal_fraction"}


def read_economic_snapshot(spark: SparkSession, county_path: str, series_path: str, series_metrics: dict[str, str]) -> DataFrame:
    """SRC-12: nested county histories and national series of every county at once; percents become fractions."""
    history = "year string, date string, population string, households string, median_household_income string, unemployment_rate string"
    counties = spark.read.text(county_path, wholetext=True).select(F.from_json("value", f"counties map<string, struct<history: array<struct<{history.replace(' string', ': string')}>>>>").alias("j"), F.col("_metadata.file_path").alias("__file"))
    fields = ["population", "households", "median_household_income", "unemployment_rate"]
    rows = counties.select("__file", F.explode("j.counties").alias("fips", "c")).select("__file", "fips", F.explode("c.history").alias("h")).select("__file", "fips", F.coalesce("h.year", "h.date").alias("p"), *[F.col(f"h.{f}").alias(f) for f in fields])
    local = _long(rows, ["fips", "p"], fields).filter("value IS NOT NULL")
    annual = F.col("__field").isin("population", "households", "median_household_income") & (F.length("p").isin(4) | F.col("p").endswith("-01-01"))
    local = local.select(
        F.col("__field").alias("source_series"), F.lit("county").alias("geography_type"), F.col("fips").alias("geography_id"), F.when(annual, F.substring("p", 1, 4)).when(F.length("p") == 4, F.concat("p", F.lit("-01-01"))).otherwise(F.col("p")).alias("observation_date"),
        F.when(annual, "annual").otherwise("irregular").alias("period_type"), F.col("__field").alias("metric"), "value", F.create_map(*[F.lit(v) for p in ECONOMIC_UNITS.items() for v in p])[F.col("__field")].alias("unit"),
        F.substring("fips", 1, 2).alias("state_fips"), F.col("fips").alias("county_fips"), "__file",
    )
    national = spark.read.text(series_path, wholetext=True).select(F.from_json("value", "series map<string, struct<observations: array<array<string>>>>").alias("j"), F.col("_metadata.file_path").alias("__file"))
    points = national.select("__file", F.explode("j.series").alias("id", "s")).filter(F.col("id").isin(*series_metrics)).select("__file", "id", F.explode("s.observations").alias("o"))
    points = points.filter("size(o) >= 2 AND o[1] IS NOT NULL AND o[1] <> '.'").withColumn("metric", F.create_map(*[F.lit(v) for p in series_metrics.items() for v in p])[F.col("id")])
    percent = F.col("metric").isin("inflation", "unemployment_rate", "treasury_rate")
    none = F.lit(None).cast("string")
    world = points.select(
        F.col("id").alias("source_series"), F.lit("national").alias("geography_type"), F.lit("US").alias("geography_id"), F.col("o")[0].alias("observation_date"), F.lit("irregular").alias("period_type"), "metric",
        F.when(percent, (F.col("o")[1].cast("double") / 100).cast("string")).otherwise(F.col("o")[1]).alias("value"), F.create_map(*[F.lit(v) for p in ECONOMIC_UNITS.items() for v in p])[F.col("metric")].alias("unit"), none.alias("state_fips"), none.alias("county_fips"), "__file",
    )
    return local.unionByName(world)
