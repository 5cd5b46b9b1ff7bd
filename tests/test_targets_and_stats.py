"""Verification fixtures, panel statistics on a synthetic panel, name pairs and chains against brute force."""

import datetime as dt
import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelflow.operators import chain, deals, stats, target_panel, verification as v

D = dt.date
COLUMNS = (
    "observation_id string, geography_type string, geography_id string, period string, frequency string, property_type string, property_subtype string, metric string, value double, unit string, source_name string,"
    " source_identifier string, vintage string, methodology string, release_date date, retrieved_on date, verification_status string, target_classification string, source_class string, sample_count long, notes string,"
    " redistribution_permitted string, licensing_notes string, is_rate boolean, jump_threshold double"
)


def record(oid, period="2024-Q1", value=0.05, source="A", vintage="original", metric="vacancy_rate", identifier="doc-1", status="analyst_verified", release=D(2024, 4, 15), method="market_vacancy"):
    return (
        oid, "market", "M1", period, "quarterly", "multifamily", None, metric, value, "decimal_fraction", source, identifier, vintage, method, release, D(2024, 5, 1), status, "institutional_target", "federal_public", 12, "n", "yes",
        "ok", True, 0.10,
    )


@pytest.fixture(scope="module")
def scored(spark):
    rows = spark.createDataFrame([
        record("a"), record("b", value=0.13, source="B"), record("c", value=0.06, vintage="revision-1"), record("d", period="2024-Q3", value=0.22, release=D(2024, 10, 15)),
        record("e", period="2023-Q1"), record("e", period="2023-Q1"), record("f", period="2024-Q2", metric="occupancy_rate", value=0.94, method="physical_occupancy"), record("g", period="2024-Q2", value=0.08, method="physical_vacancy"),
    ], COLUMNS)
    findings = v.all_findings(rows, evaluated_on="2024-06-30", confirmed=True)
    return rows, findings, v.score(rows, findings, evaluated_on="2024-06-30", confirmed=True)


def test_each_finding(scored):
    _, findings, _ = scored
    found = {}
    for r in findings.collect():
        found.setdefault(r.code, set()).add(r.observation_id)
    assert found["source_conflict"] == {"a", "b", "c"}
    assert found["revised_observation"] == {"a", "c"}
    assert found["duplicate_observation"] == {"e"}
    assert found["occupancy_vacancy_mismatch"] == {"f", "g"}
    assert "d" in found["missing_periods"] and "d" in found["sudden_jump"]
    assert found["methodology_change"] >= {"g"}


def test_fused_checks_find_what_single_checks_find(spark):
    """One aggregate and one join give the rows of the separate checks, with their finding ids."""
    draw = random.Random(4)
    metrics = ["vacancy_rate", "occupancy_rate", "same_store_revenue", "same_store_operating_expense", "same_store_noi", "noi_margin"]
    made = []
    for k in range(300):
        row = dict(zip([c.split()[0] for c in COLUMNS.split(", ")], record(f"o{k % 290}", period=f"{draw.choice([2021, 2023])}-Q{draw.randint(1, 4)}", value=draw.choice([0.05, 0.2, 0.9, 5.0])), strict=True))
        row |= {
            "metric": draw.choice(metrics), "source_name": draw.choice("AB"), "vintage": draw.choice(["original", None, "revision-1"]), "methodology": draw.choice(["m1", "m1", "m2"]),
            "property_subtype": draw.choice([None, "garden"]), "geography_id": draw.choice(["M1", "M2"]), "unit": draw.choice(["x", "y"]), "is_rate": draw.random() < 0.5,
            "target_classification": draw.choice(["institutional_target", "context_proxy", None]), "retrieved_on": draw.choice([D(2020, 1, 1), D(2024, 5, 1), None]),
        }
        if draw.random() < 0.2:
            row |= {"frequency": "annual", "period": row["period"][:4]}
        row["is_rate"] = row["metric"] in ("vacancy_rate", "occupancy_rate", "noi_margin")
        made.append(tuple(row.values()))
    rows = spark.createDataFrame(made, COLUMNS).cache()
    governed = spark.createDataFrame([("M1",)], "geography_id string")
    for confirmed in (False, True):
        single = [
            v.duplicates(rows), v.methodology_mismatch(rows), v.source_conflicts(rows), v.revisions(rows), v.frequency_mismatch(rows), v.methodology_change(rows), v.complement_mismatch(rows),
            v.operating_mismatches(rows), v.geography_mismatch(rows, governed), v.proxies(rows), v.gaps_and_jumps(rows), v.retrieval_findings(rows, "2024-06-30", confirmed),
        ]
        want = sorted((tuple(r) for part in single for r in part.select("code", "severity", "finding_id", "observation_id").collect()), key=str)
        fused = v.all_findings(rows, evaluated_on="2024-06-30", confirmed=confirmed, governed=governed)
        assert sorted((tuple(r) for r in fused.select("code", "severity", "finding_id", "observation_id").collect()), key=str) == want
        assert len({w[0] for w in want}) >= 12


def test_code_sets_and_totals_hold_what_all_findings_hold(spark, monkeypatch):
    """The compact forms agree with the rows of all findings, also where periods are split into pieces and ids repeat."""
    draw = random.Random(9)
    made = []
    for k in range(240):
        row = dict(zip([c.split()[0] for c in COLUMNS.split(", ")], record(f"o{k % 225}", period=f"{draw.choice([2021, 2023])}-Q{draw.randint(1, 4)}", value=draw.choice([0.05, 0.2, 0.9])), strict=True))
        row |= {
            "metric": draw.choice(["vacancy_rate", "vacancy_rate", "occupancy_rate"]), "source_name": draw.choice("AB"), "vintage": draw.choice(["original", None, "revision-1"]),
            "methodology": draw.choice(["m1", "m1", "m2"]), "geography_id": draw.choice(["M1", "M2"]), "retrieved_on": draw.choice([D(2020, 1, 1), D(2024, 5, 1), None]),
            "target_classification": draw.choice(["institutional_target", "context_proxy", None]), "source_identifier": draw.choice(["x", f"y{k}"]),
        }
        made.append(tuple(row.values()))
    rows = spark.createDataFrame(made, COLUMNS).cache()
    governed = spark.createDataFrame([("M1",)], "geography_id string")
    findings = [tuple(r) for r in v.all_findings(rows, evaluated_on="2024-06-30", governed=governed).select("code", "finding_id", "observation_id").collect()]
    sets, totals = {}, {}
    for code, finding, observation in findings:
        sets.setdefault(observation, set()).add(code)
        totals.setdefault(code, []).append((finding, observation))
    monkeypatch.setattr(v, "PERIOD_PIECE", 1)
    got = {r.observation_id: r.verification_findings for r in v.code_sets(rows, evaluated_on="2024-06-30", governed=governed).collect()}
    assert got == {o: sorted(c) for o, c in sets.items()} and v._pieces(rows.withColumn("__idx", F.lit(1))) > 1
    counted = {r.code: (r.findings, r.rows, r.observations) for r in v.finding_totals(rows, evaluated_on="2024-06-30", governed=governed).collect()}
    assert counted == {c: (len({f for f, _ in x}), len(x), len({o for _, o in x})) for c, x in totals.items()}
    assert len(counted) >= 8


def test_rows_carry_their_codes(spark, monkeypatch):
    """Codes, eligibility and totals equal those of all findings, and no row is joined by its id; some ids recur, one is missing."""
    draw = random.Random(11)
    made = []
    for k in range(260):
        row = dict(zip([c.split()[0] for c in COLUMNS.split(", ")], record(f"o{k % 250}" if k else None, period=draw.choice(["2021-Q1", "2021-Q2", "2023-Q1", "2023-Q4", "soon"]), value=draw.choice([0.05, 0.2, 0.9])), strict=True))
        row |= {
            "metric": draw.choice(["vacancy_rate", "vacancy_rate", "occupancy_rate"]), "source_name": draw.choice("AB"), "vintage": draw.choice(["original", None, "revision-1"]),
            "methodology": draw.choice(["m1", "m1", "m2"]), "geography_id": draw.choice(["M1", "M2"]), "retrieved_on": draw.choice([D(2020, 1, 1), D(2024, 5, 1), None]),
            "target_classification": draw.choice(["institutional_target", "context_proxy", None]), "source_identifier": draw.choice(["x", f"y{k}"]),
        }
        made.append(tuple(row.values()))
    rows = spark.createDataFrame(made, COLUMNS).cache()
    checks = {"evaluated_on": "2024-06-30", "confirmed": True, "governed": spark.createDataFrame([("M1",)], "geography_id string")}
    findings = v.all_findings(rows, **checks).cache()
    chosen = ["observation_id", "value", "verification_findings", "model_eligible"]
    want = sorted((tuple(r) for r in v.judge(rows, findings, confirmed=True).select(*chosen).collect()), key=str)
    totals = {r.code: tuple(r)[1:] for r in findings.groupBy("code").agg(F.countDistinct("finding_id"), F.count(F.lit(1)), F.countDistinct("observation_id")).collect()}
    monkeypatch.setattr(v, "code_sets", lambda *args, **kwargs: pytest.fail("rows were joined by their ids"))
    for piece in (v.PERIOD_PIECE, 1):
        monkeypatch.setattr(v, "PERIOD_PIECE", piece)
        got = v.verified(rows, **checks)
        assert sorted((tuple(r) for r in got.select(*chosen).collect()), key=str) == want and set(rows.columns) < set(got.columns)
    assert {r.code: tuple(r)[1:] for r in v.finding_totals(rows, **checks).collect()} == totals
    assert len(totals) >= 8


def test_counts_of_groups_equal_those_of_rows(scored, spark):
    """rows are counted before the keys of their group come back by a join."""
    rows, _, _ = scored
    checks = {"evaluated_on": "2024-06-30", "confirmed": True}
    got = v.verified_counts(rows, ["codes", "model_eligible"], **checks)
    tops = got._jdf.queryExecution().optimizedPlan().toString()
    assert tops.index("Join") < tops.index("Aggregate")
    whole = v.verified(rows, **checks).groupBy(*v.METHOD, "verification_findings", "model_eligible").count()
    keys = [*v.METHOD, "verification_findings", "model_eligible"]
    counted = got.withColumn("verification_findings", v.code_names(F.col("codes"))).select(*keys, "n")
    assert sorted(map(str, (tuple(r) for r in counted.collect()))) == sorted(map(str, (tuple(r) for r in whole.select(*keys, "count").collect())))


def test_eligibility_and_reconciliation(scored):
    rows, _, out = scored
    eligible = {r.observation_id for r in out.filter("model_eligible").collect()}
    assert eligible.isdisjoint({"a", "b", "c", "e", "f", "g"})
    known = {r.observation_id: r.included for r in v.available_as_of(rows, "2024-03-31").collect()}
    assert not any(known.values())
    with pytest.raises(ValueError):
        v.reconcile(out, ["A", "A"])


def test_duplicate_priority_picks_one(scored):
    rows, _, out = scored
    free = out.withColumn("model_eligible", F.lit(True))
    picked = v.reconcile(free, ["B", "A"]).filter("period = '2024-Q1'").first()
    assert picked.selected_observation_id == "b" and picked.alternatives == 2


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for m in range(4):
        driver = {y: 0.01 + ((7 * y + 3 * m) % 11) * 0.001 for y in range(2009, 2022)}
        for y in range(2010, 2022):
            supply = 0.02 + ((y + m) % 3) * 0.003
            rows.append((f"M{m}", str(y), "multifamily", 0.015 + 1.5 * driver[y - 1] - 0.4 * supply + 0.002 * m, driver[y], supply))
    return stats.prepare_panel(spark.createDataFrame(rows, "market_id string, period string, property_type string, rent_growth double, employment_growth double, supply_growth double"), "rent_growth", ["employment_growth", "supply_growth"])


def dummy_ols(rows, entities, cluster):
    x = np.array([[1, r.employment_growth, r.supply_growth, *[float(r.entity == e) for e in entities[1:]]] for r in rows])
    y = np.array([r.rent_growth for r in rows])
    n, k = x.shape
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    if cluster:
        s = np.array([sum(x[i] * e[i] for i in range(n) if rows[i].entity == g) for g in entities])
        cov = inv @ (s.T @ s) @ inv * len(entities) / (len(entities) - 1) * (n - 1) / (n - k)
    else:
        cov = inv @ ((x * e[:, None]).T @ (x * e[:, None])) @ inv * n / (n - k)
    return beta[1:3], np.sqrt(np.diag(cov))[1:3]


@pytest.mark.parametrize("covariance", ["hc1", "cluster_entity"])
def test_fixed_effects_equal_dummy_regression(panel, covariance):
    rows = sorted(panel.collect(), key=lambda r: (r.entity, r.label))
    assert len(rows) == 48
    fit = {r.term: r for r in stats.fit_ols(panel, "rent_growth", ["employment_growth", "supply_growth"], entity_effects=True, covariance=covariance).collect()}
    beta, se = dummy_ols(rows, ["M0", "M1", "M2", "M3"], covariance == "cluster_entity")
    for i, term in enumerate(("employment_growth", "supply_growth")):
        assert fit[term].coefficient == pytest.approx(beta[i], abs=1e-9) and fit[term].standard_error == pytest.approx(se[i], rel=1e-6)
        assert fit[term].parameters == 6


def test_best_lag_is_one(panel):
    out = {r.lag: r.model_mae for r in stats.lag_search(panel, "rent_growth", "employment_growth", [0, 1, 2], frequency="annual").collect()}
    assert min(out, key=out.get) == 1


def test_name_variations_equal_all_pairs(spark):
    rng = random.Random(3)
    base = ["northwind trading company", "harbor point holdings", "acme logistics llc", "blue river foods", "sunset dental group"]
    names = []
    for name in base:
        for _ in range(8):
            chars = list(name)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(chars))
                if rng.random() < 0.5:
                    chars.pop(at)
                else:
                    chars.insert(at, rng.choice("abcxyz"))
            names.append("".join(chars))
    df = spark.createDataFrame([("d", n) for n in names], "deal_id string, name string")
    got = {frozenset((r.left_name, r.right_name)) for r in deals.name_variations(df).collect()}
    fold = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    unique = {}
    for n in sorted(names):
        unique.setdefault(fold(n), n)
    want = {
        frozenset((unique[a], unique[b])) for a, b in itertools.combinations(sorted(unique), 2) if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) > 0.88
    }
    assert got == want and want


def test_chain_break_is_located(spark):
    import hashlib

    rows, previous = [], None
    for i in range(40):
        digest = hashlib.sha256("|".join([str(i), "act", previous or "~"]).encode()).hexdigest()
        rows.append(("org", i, "act", previous, digest))
        previous = digest
    schema = "org string, seq long, action string, previous_hash string, event_hash string"
    check = lambda data: chain.verify_chain(spark.createDataFrame(data, schema), "org", "seq", chain.event_digest(["seq", "action"], F.col("previous_hash"))).first()
    assert check(rows).valid
    rows[17] = (*rows[17][:2], "edited", *rows[17][3:])
    broken = check(rows)
    assert not broken.valid and broken.first_break == 17 and broken.broken_links == 1


def test_evidence_roots_follow_chains_circles_and_missing_parents(spark):
    chain = [(f"o{i}", f"derived:o{i + 1}") for i in range(7)] + [("o7", "doc#page-3"), ("a", "derived:b"), ("b", "derived:a"), ("s", "derived:s"), ("m", "derived:gone")]
    got = {(r.root_id, r.source_identifier): r.depth for r in v.evidence_roots(spark.createDataFrame(chain, "observation_id string, source_identifier string")).collect()}
    want = {(f"o{i}", "doc"): 7 - i for i in range(8)}
    assert {k: d for k, d in got.items() if k[0].startswith("o")} == want
    assert {k for k in got if not k[0].startswith("o")} == {("a", "derived:b"), ("b", "derived:a"), ("s", "derived:s"), ("m", "derived:gone")}
    rows = [("m", "derived:gone", "x", "g", "p"), ("n", "peer#1", "x", "g", "p"), ("k", "other", "x", "g", "q")]
    found = v.evidence_roots(spark.createDataFrame(rows, "observation_id string, source_identifier string, source_name string, geography_id string, period string")).collect()
    assert {(r.root_id, r.source_identifier) for r in found} == {("m", "peer"), ("n", "peer"), ("k", "other")}


def test_a_check_of_one_code_reports_that_nothing_was_found(spark, monkeypatch):
    """Its SQL counts without groups, so there is a row of zeros."""
    from parcelflow.plans import registry, target_queries

    registry.QUERIES or registry.load()
    monkeypatch.setattr(target_queries, "complement_records", lambda s, d: s.createDataFrame([record("a")], COLUMNS))
    out = [tuple(r) for r in registry.QUERIES["ver_complements"](spark, "").collect()]
    assert out == [("occupancy_vacancy_mismatch", "error", 0, 0, 0)]


def test_bounds_of_name_similarity_lose_nothing():
    """only pairs that the bounds leave open are matched character by character."""
    draw, names = random.Random(5), []
    for _ in range(400):
        name = list(draw.choice(["large ring LARGE 12", "hot bolt ECONOMY 33", "überprüfung süd 4", "straße Ä"]).replace(" ", ""))
        for _ in range(draw.randrange(0, 5)):
            name[draw.randrange(len(name))] = draw.choice("abcoLü1")
        names.append("".join(name))
    left, right = pd.Series(names[:200]), pd.Series(names[200:])
    got = deals.close_ratio.func(left, right)
    want = [max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) for a, b in zip(left, right)]
    assert all(w == g if w > deals.SIMILARITY else pd.isna(g) or g == w for g, w in zip(got, want))
    assert any(w > deals.SIMILARITY for w in want) and got.isna().sum() > 100


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for ch in a:
            row = [0, *itertools.accumulate(range(len(b)), lambda left, j: max(row[j + 1], left, row[j] + (ch == b[j])), initial=0)][1:]
        return row[-1]

    draw = random.Random(7)
    for _ in range(300):
        a, b = ("".join(draw.choice("abcd") for _ in range(draw.randrange(1, 12))) for _ in range(2))
        assert deals._common({}, a, b) == plain(a, b)


def test_single_checks_sort_no_rows(spark):
    """group checks aggregate all rows by hashing, counts agree with the rows of findings."""
    made = []
    for k in range(60):
        row = dict(zip([c.split()[0] for c in COLUMNS.split(", ")], record(f"o{k % 50}" if k else None, value=k / 100), strict=True))
        row |= {"metric": ("vacancy_rate", "occupancy_rate")[k % 2], "geography_id": f"M{k % 7}", "methodology": "ab"[k % 3 == 0], "vintage": ("x", "y", None)[k % 5 % 3],
                "retrieved_on": (D(2020, 1, 1), D(2024, 5, 1), None)[k % 3], "verification_status": ("analyst_verified", "unverified")[k % 4 == 0]}
        made.append(tuple(row.values()))
    rows = spark.createDataFrame(made, COLUMNS)
    counts = (F.countDistinct("finding_id").alias("findings"), F.count(F.lit(1)).alias("rows"), F.countDistinct("observation_id").alias("observations"))
    listed = lambda df: sorted(tuple(r) for r in df.select("code", "severity", "findings", "rows", "observations").collect())
    want = v.retrieval_findings(rows, "2024-06-30", False).groupBy("code", "severity").agg(*counts)
    assert listed(v.retrieval_totals(rows, "2024-06-30", False)) == listed(want) != []
    found = v.revisions(rows)
    assert listed(v.code_counts(found, ["code", "severity"])) == listed(found.groupBy("code", "severity").agg(*counts)) != []
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_few_pairs_of_names_are_scored(spark):
    """names of a deal that share words are not all met, whatever they share; the pairs found are those of all pairs."""
    rng = random.Random(5)
    names = sorted({f"{rng.choice(['hot', 'cold', 'large', 'small', 'blue'])} {rng.choice(['ring', 'plate', 'gear', 'widget'])} {rng.choice(['PROMO', 'LARGE', 'ECONOMY'])} {rng.randint(1, 50)}" for _ in range(700)})
    names += ["\U0001f600\U0001f600x", "\U0001f600\U0001f600y", "q", "é" * 210 + "a", "é" * 205 + "b" * 5, "abcdefghij" * 21, "abcdefghij" * 20 + "zz"]
    rows = [(deal, n) for n in names for deal in ("d", "e", None)]
    df = spark.createDataFrame(rows, "deal_id string, name string")
    got = {(r.deal_id, r.left_name, r.right_name): r.similarity for r in deals.name_variations(df).collect()}
    fold = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    unique = {fold(n): n for n in sorted(names, reverse=True) if fold(n)}
    ratio = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio())
    want = {(deal, unique[a], unique[b]): ratio(a, b) for a, b in itertools.combinations(sorted(unique), 2) if 2 * min(len(a), len(b)) / (len(a) + len(b)) > 0.88 and ratio(a, b) > 0.88 for deal in ("d", "e")}
    assert got == want and len(want) > 4000
    base = spark.createDataFrame([(d, fold(n), i) for i, (d, n) in enumerate(rows) if d and fold(n)], "deal_id string, f string, id long").withColumn("bits", deals.letter_bits("f"))
    assert deals.close_pairs(base).count() < 1.3 * len(want)


def test_matched_characters_are_those_of_the_library():
    rng = random.Random(8)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc1") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert deals._matched(a, b) == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


@pytest.mark.parametrize("piece", [v.PERIOD_PIECE, 1])
def test_scores_beside_the_steps_equal_scores_by_join(spark, monkeypatch, piece):
    """the distance to peers comes to the rows where their steps are judged, whatever is null or repeated."""
    monkeypatch.setattr(v, "PERIOD_PIECE", piece)
    draw = random.Random(12)
    rows = []
    for i in range(2_000):
        row = list(record(f"o{i // 2}" if i % 9 else None, draw.choice(["2024-Q1", "2024-Q2", "soon", "later"]), draw.choice([0.05, 0.1, -0.0, 0.0, None, 0.3]), draw.choice(["A", "B", None])))
        row[6], row[13] = draw.choice(["garden", None]), draw.choice(["m1", "m2", None])
        rows.append(tuple(row))
    df = spark.createDataFrame(rows, COLUMNS)
    agreement = v.peer_agreement(df)
    checks = {"evaluated_on": "2024-06-30", "confirmed": True}
    whole = v.with_confidence(v.verified(df, **checks), agreement, **checks)
    got = v.verified_scores(df, agreement, **checks)
    assert got.columns == whole.columns
    listed = lambda x: sorted(str(tuple(r)) for r in x.collect())
    assert listed(got) == listed(whole) and got.filter("confidence IS NOT NULL").select("confidence").distinct().count() > 2
    short = v.verified_scores(df, agreement, keys=False, **checks)
    assert listed(short) == listed(whole.select(*short.columns))


def test_readiness_of_counted_rows_is_that_of_rows(spark):
    """rows that are alike are judged once, with their number."""
    draw = random.Random(3)
    rows = [(draw.choice(["M1", "M2", None]), draw.choice(["2024-Q1", "2024-Q2"]), "quarterly", draw.choice(["office", None]), draw.choice(["rent", "vacancy"]), draw.choice("AB"), draw.choice(["m1", "m1", "m1", "m2"]),
             draw.choice(["analyst_verified", "unverified", None]), draw.random() < 0.8, draw.choice([[], [], ["duplicate_observation"]]), draw.choice([D(2024, 1, 1), None]), D(2024, 2, 1) if draw.random() < 0.5 else None) for _ in range(60)] * 2
    names = "geography_id string, period string, frequency string, property_type string, metric string, source_name string, methodology string, verification_status string, model_eligible boolean, verification_findings array<string>, release_date date, retrieved_on date"
    df = spark.createDataFrame([*rows, ("M3", "2024-Q1", "quarterly", "office", "rent", "A", "m1", "analyst_verified", True, [], D(2024, 1, 1), None)], names)
    available = F.coalesce("release_date", "retrieved_on")
    kept = [c for c in df.columns if c not in ("release_date", "retrieved_on")]
    counted = df.groupBy(*kept, available.isNull().alias("undated")).agg(F.count(F.lit(1)).alias("n"), F.max(available).alias("target_available_at"))
    ready = lambda x: sorted(str(tuple(r)) for r in target_panel.target_readiness(target_panel.eligibility(x), markets=1, periods_minimum=1, observations=1).collect())
    assert ready(counted) == ready(df) and len(ready(df)) == 4
