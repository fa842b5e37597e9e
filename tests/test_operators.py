import pytest
from pyspark.sql import functions as F

from tallyweave.operators import grading, lineage, ranking, sector, sizing, visibility
from tallyweave.spec import Database, LineageError, Visibility, demo_spec

SECTOR = demo_spec().sector


def company(spark, codes=(), license="", service="", text=None, names="", owned=False):
    text = text if text is not None else " | ".join(x for x in (service, license) if x)
    return spark.createDataFrame([("C1", list(codes), license, service, text, names, owned)], "company_id string, codes array<string>, license_text string, service_text string, all_text string, names string, parent_owned boolean")


@pytest.mark.parametrize(
    ("kw", "tier"),
    [
        ({"license": "fire sprinkler contractor"}, "A"),
        ({"codes": ["541350"], "service": "fire safety inspections"}, "A"),
        ({"service": "fire alarm inspection; alarm monitoring"}, "B"),
        ({"codes": ["238220"], "names": "braxmoor fire protection"}, "B"),
        ({"names": "braxmoor fire protection"}, "C"),
        ({"codes": ["238220"]}, "C"),
        ({"codes": ["238220"], "service": "furnace repair; air conditioning installation"}, "D"),
        ({"codes": ["561720"]}, "D"),
    ],
)
def test_fit_tiers(spark, kw, tier):
    assert sector.classify(company(spark, **kw), SECTOR).first().fit_tier == tier


def test_segment_and_mix(spark):
    r = sector.classify(company(spark, service="fire alarm inspection; alarm monitoring; serving homeowners"), SECTOR).first()
    assert (r.segment, r.service_mix, r.residential) == ("alarm", "recurring_heavy", True)
    r = sector.classify(company(spark, service="sprinklers retrofit and installation"), SECTOR).first()
    assert (r.segment, r.service_mix) == ("sprinkler", "install_heavy")


def test_keywords_need_boundaries(spark):
    df = spark.createDataFrame([("FIRE  ALARMS and sprinklered",), (None,)], "t string")
    assert [r.h for r in df.select(sector.find_keywords("t", ["fire alarm", "sprinkler"]).alias("h")).collect()] == [["fire alarm"], []]


def test_hook_lifts_only_on_a_verified_quote(spark):
    c = sector.classify(company(spark, names="acme fire protection", text="we check Pumps"), SECTOR)
    yes = sector.apply_hook(c, lambda p: {"in_sector": {"value": True, "evidence": "PUMPS"}})
    assert sector.lift(c, yes, SECTOR).first().fit_tier == "B"
    no = sector.apply_hook(c, lambda p: {"in_sector": {"value": True, "evidence": "valves"}})
    assert sector.lift(c, no, SECTOR).first().fit_tier == "C"


def signals(spark, *rows):
    return spark.createDataFrame([("C1", f"R{i}", *r) for i, r in enumerate(rows)], "company_id string, record_id string, kind string, lo double, hi double, weight double, is_floor boolean, raw string")


@pytest.mark.parametrize(
    ("rows", "lo", "hi", "conflict"),
    [
        ([("band", 5.0, 9.0, 1.0, False, ""), ("headcount", 51.0, 75.0, 0.9, False, "")], 5, 75, True),
        ([("band", 5.0, 9.0, 1.0, False, ""), ("technicians", 12.5, 40.0, 0.6, True, "")], 12.5, 18.75, False),
        ([("technicians", 12.5, 40.0, 0.6, True, "")], 12.5, 40, False),
        ([("band", 20.0, 49.0, 1.0, False, ""), ("headcount", 20.0, 49.0, 0.9, False, "")], 20, 49, False),
    ],
)
def test_size_ranges(spark, rows, lo, hi, conflict):
    r = sizing.size_ranges(sizing.pick_signals(signals(spark, *rows), "company_id", F.lit(0.5)), "company_id").first()
    assert (r.lo, r.hi, r.conflict) == (lo, hi, conflict)


def test_exact_products(spark):
    df = spark.createDataFrame([(35.0, 70.0, 150000.0, 210000.0, 0.13, 0.16)], "a double, b double, c double, d double, e double, f double")
    fit = df.select(sizing.product_fit([(F.col("a"), F.col("b")), (F.col("c"), F.col("d")), (F.col("e"), F.col("f"))]).alias("x")).first().x
    assert fit.low == pytest.approx(682500, abs=1e-6) and fit.high == pytest.approx(70 * 210000 * 0.16)


def test_visibility(spark):
    spec = Visibility(databases=(Database("a", "x", 0.6), Database("b", "x", 0.3)))
    c = spark.createDataFrame([("C1", "Braxmoor Fire", "IL", ["braxmoor fire protection"]), ("C2", "Other", None, ["other"])], "company_id string, display_name string, state string, variants array<string>")
    listed = spark.createDataFrame([("a", "L1", "Braxmoor Fire Protection, Inc.", "il"), ("a", "L2", "Braxmoor Fire Protection", "OH")], "database string, listing_id string, name string, state string")
    found = visibility.lookup(c, listed, spec=spec)
    got = {(r.company_id, r.database): (r.found, r.listing_id) for r in found.collect()}
    assert got == {("C1", "a"): (True, "L1"), ("C1", "b"): (False, None), ("C2", "a"): (False, None), ("C2", "b"): (False, None)}
    seen = {r.company_id: r.obviousness for r in visibility.obviousness(found, c, F.lit(False), spec).collect()}
    assert seen == {"C1": pytest.approx(0.6), "C2": 0.0}
    none = visibility.obviousness(found, c, F.lit(True), Visibility(site_weight=0.0))
    assert all(r.obviousness == 0 for r in none.collect())


def test_screens_rank_and_tiers(spark):
    df = spark.createDataFrame([("a", "IL", "A", 5.0, 0.9), ("b", "IL", "A", 5.0, 0.1), ("c", "TX", "D", 9.0, 0.9), ("d", None, "B", 1.0, None)], "id string, state string, tier string, score double, p double")
    df = df.withColumn("why", ranking.screens(["IL"], "state", "tier"))
    assert {r.id: r.why for r in df.collect()} == {"a": [], "b": [], "c": ["out_of_geography", "no_sector_evidence"], "d": ["location_unknown"]}
    ranked = ranking.global_rank(df, [F.col("score").desc(), F.col("id")])
    assert [r.id for r in ranked.orderBy("rank").collect()] == ["c", "a", "b", "d"]
    tiers = ranked.withColumn("t", ranking.tiers("rank", "p", F.size("why") == 0))
    assert {r.id: r.t for r in tiers.collect()} == {"a": "Priority", "b": "Watchlist", "c": "Excluded", "d": "Excluded"}
    assert ranking.global_rank(df.limit(0), [F.col("id")]).count() == 0


def test_pairwise(spark):
    p = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x"), ("4", "y")], "record_id string, group string")
    t = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "B"), ("4", "B")], "record_id string, group string")
    r = grading.pairwise(p, t).first()
    assert (r.precision, r.recall) == (0.3333, 0.5)
    alone = grading.pairwise(spark.createDataFrame([("1", "x")], "record_id string, group string"), t).first()
    assert alone.precision == 1.0


def test_marks():
    passed = {n: ok for n, _, _, ok in grading.check_marks({"precision": 0.96, "recall": 0.9, "coverage": None, "calibration_gap": 0.2, "agreement": 0.95})}
    assert passed == {"precision": True, "recall": True, "coverage": False, "calibration_gap": False, "agreement": True}
    assert not grading.report_allowed({"a": True, "b": False})


def test_ledger_rules(spark):
    c = spark.createDataFrame([("C1", "Acme", None, ["R1"])], "company_id string, name string, state string, ids array<string>")
    claims = [
        lineage.claim(c, "name", F.col("name"), F.lit("printed"), F.lit("strong"), "observed", F.lit("f"), F.col("ids")),
        lineage.claim(c, "location", F.coalesce("state", F.lit("unknown")), F.lit("stated"), F.lit("weak"), "observed", F.lit("f"), F.col("ids")),
        lineage.claim(c, "screen", F.lit("excluded"), F.lit(" "), F.lit("inferred"), "derived", depends=("location",)),
    ]
    led = lineage.ledger(claims)
    assert [r.claim_id for r in led.orderBy("seq").collect()] == ["C1.01", "C1.02", "C1.03"]
    assert {r.problem for r in lineage.rule_violations(led).collect()} == {"no evidence", "stronger than its inputs"}
    assert lineage.capped(led).where("claim = 'screen'").first().confidence == "weak"
    members = spark.createDataFrame([("C1", "R9")], "company_id string, record_id string")
    problems = lineage.verify(led, c.select("company_id"), members, F.array(F.lit("name"), F.lit("segment")))
    assert {r.problem for r in problems.collect()} == {"C1.01 cites R1", "C1.02 cites R1", "no claim segment"}
    with pytest.raises(LineageError):
        lineage.require_clean(problems)
    assert lineage.latest(led, "name").first().value == "Acme"
    assert lineage.spans(led).first().last_claim == "C1.03"


def test_lookup_gives_the_best_of_all_pairs_without_writing_them(spark, monkeypatch):
    from itertools import product

    from tallyweave.functions.similarity import best_name_score
    from tallyweave.spec import Database, Linkage, Visibility

    written = []
    monkeypatch.setattr(visibility, "cut", lambda df, *_: written.append(df.count()) or df, raising=False)
    starts, ends = ("bruno", "zando", "morgi", "hesto", "crelo"), ("vale", "fell", "stead", "burn", "toft")
    words = [a + b for a, b in product(starts, ends)]
    long = "doing business as " + " ".join(words[:9])
    rows = [(f"C{i:02}", f"C{i}", "IL" if i % 7 else "OH", [f"{w} {words[-1 - i]} fire alarm", f"{w} alarm"]) for i, w in enumerate(words)] + [("C90", "long", "IL", [long, "alarm"]), ("C91", "none", None, ["x"]), ("C92", "empty", "IL", [])]
    listings = [(f"d{i % 2}", f"L{i:02}", f"{w} {words[(3 * i) % 25]} {'fire ' * (i % 3)}alarm", "il") for i, w in enumerate(words)] + [("d0", "L90", long + " fire", "IL"), ("d1", "L05b", "morgifell alarm", "IL"), ("d1", "L05a", "morgifell alarm", "IL"), ("d1", "L99", None, "IL")]
    spec = Visibility(databases=(Database("d0", "x", 0.5), Database("d1", "x", 0.5)))
    c = spark.createDataFrame(rows, "company_id string, display_name string, state string, variants array<string>")
    listed = spark.createDataFrame(listings, "database string, listing_id string, name string, state string")
    names = Linkage(generic=("fire", "alarm"))
    got = {(r.company_id, r.database): (r.found, r.score, r.listing_id) for r in visibility.lookup(c, listed, names, spec, 7, 5).collect()}
    want = {}
    for (cid, _, state, variants), d in product(rows, ("d0", "d1")):
        found = [(-s, variants.index(a), lid) for base, lid, n, st in listings if base == d and n and st.upper() == state for s, a, _ in [best_name_score(variants, [n], frozenset(names.generic), names.slack)] if s > 0]
        s, _, lid = min(found, default=(0.0, 0, None))
        want[cid, d] = (-s >= spec.match_at, pytest.approx(-s, abs=0.051), lid if -s >= spec.match_at else None)
    assert got == want and not any(n > 2 * len(rows) for n in written)
    assert got["C90", "d0"][2] == "L90" and sum(f for f, *_ in got.values()) > 5
