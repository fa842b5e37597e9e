import pytest
from pyspark.sql import functions as F

from tallyweave.functions.similarity import best_name_score
from tallyweave.operators import entities, linkage
from tallyweave.pipeline import resolve, trust_of
from tallyweave.sources.feeds import RECORD
from tallyweave.spec import Feed, Linkage, Spec, SpecError

WORDS = frozenset("fire protection alarm sprinkler extinguisher mechanical safety service".split())
LINK = Linkage(generic=WORDS, abbreviations=dict(Linkage().abbreviations) | {"prot": "protection"})
SPEC = Spec("t", (Feed("business_registry", "x", 0.9), Feed("state_license", "x", 0.85), Feed("web_listing", "x", 0.6)), linkage=LINK)
ROWS = [
    ("REG-1", "business_registry", "BRAXMOOR FIRE PROTECTION, INC.", None, "IL", "61204", None, None),
    ("LIC-1", "state_license", "Braxmoor Fire Prot.", None, "IL", None, "217-555-0142", None),
    ("WEB-1", "web_listing", "Braxmoor Fire Protecton", None, "IL", None, "(217) 555-0142", "braxmoorfire.example"),
    ("REG-2", "business_registry", "Ostrvane Holdings, LLC", "Quenholt Fire Alarm", "IL", None, None, None),
    ("WEB-2", "web_listing", "Quenholt Fire Alarm", None, "IL", None, "309-555-0101", None),
    ("WEB-3", "web_listing", "Braxmoor Mechanical", None, "IL", "61204", "217-555-0199", None),
    ("REG-3", "business_registry", "Braxmoor Fire Protection Inc", None, "OH", None, None, None),
    ("WEB-4", "web_listing", "Pellstead Extinguisher Service", None, "IL", None, "309-555-0101", None),
    ("REG-4", "business_registry", "Veltmere Fire Sprinkler LLC", None, "IL", None, None, None),
    ("WEB-5", "web_listing", "Veltmere Fire", None, "IL", None, None, None),
]


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(i, s, n, d, None, st, z, p, w, None, k) for k, (i, s, n, d, st, z, p, w) in enumerate(ROWS)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RECORD) + ", pos bigint"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def resolved(messy):
    return resolve(messy, SPEC)


def test_clusters(resolved):
    _, _, members = resolved
    groups = {tuple(sorted(r.ids)) for r in members.groupBy("company_id").agg(F.collect_list("record_id").alias("ids")).collect()}
    assert {g for g in groups if len(g) > 1} == {("LIC-1", "REG-1", "WEB-1"), ("REG-2", "WEB-2")}
    assert len(groups) == 7


def test_review_queue(resolved):
    _, pairs, members = resolved
    queue = {(r.a, r.b): r.score for r in entities.open_reviews(pairs, members).collect()}
    assert queue[("REG-1", "REG-3")] == 85.0 and queue[("REG-4", "WEB-5")] == 86.1


def test_canonical_values(messy, resolved):
    prepared, _, members = resolved
    cards = {(r.display_name, r.state): r for r in entities.canonical(messy, prepared, members, trust_of(SPEC), LINK).collect()}
    c = cards["Braxmoor Fire Protection", "IL"]
    assert (c.legal_name, c.phone, c.domain, c.zip) == ("Braxmoor Fire Protection, Inc.", "2175550142", "braxmoorfire.example", "61204")
    assert ("Quenholt Fire Alarm", "IL") in cards


def test_verdicts(spark, messy, resolved):
    v = spark.createDataFrame([("WEB-5", "REG-4", "merge"), ("LIC-1", "REG-1", "reject"), ("WEB-4", "REG-4", "merge"), ("NONE-1", "REG-1", "merge"), ("REG-1", "WEB-2", "reject")], "record_a string, record_b string, decision string")
    prepared, pairs, _ = resolved
    out = {(r.a, r.b): r for r in linkage.adjudicate(pairs, v, prepared, LINK).collect()}
    assert out[("REG-4", "WEB-5")].decision == "merge" and "adjudicated: merge" in out[("REG-4", "WEB-5")].reasons
    assert out[("LIC-1", "REG-1")].decision == "reject"
    assert out[("REG-4", "WEB-4")].decision == "merge"
    assert ("NONE-1", "REG-1") not in out and ("REG-1", "WEB-2") not in out


def test_oversized_blocks_give_no_pairs(messy):
    keyed = linkage.blocks(linkage.prepare(messy, LINK), LINK)
    small = linkage.candidate_pairs(keyed, Linkage(most_in_block=2, generic=WORDS))
    every = linkage.candidate_pairs(keyed, LINK)
    assert small.count() < every.count()


def test_long_chain_is_one_component(spark):
    n = 70
    nodes = spark.range(n + 1).select(F.format_string("n%03d", F.col("id")).alias("node"))
    edges = spark.range(n - 1).select(F.format_string("n%03d", F.col("id")).alias("a"), F.format_string("n%03d", F.col("id") + 1).alias("b"))
    roots = entities.connected(nodes, edges).groupBy("root").count().collect()
    assert sorted(r["count"] for r in roots) == [1, n]


def test_repeated_id_is_an_error(spark):
    with pytest.raises(SpecError, match="X1"):
        entities.unique_ids(spark.createDataFrame([("X1",), ("X1",)], "record_id string"))


def test_cohesion_and_empty_input(spark, messy, resolved):
    prepared, _, members = resolved
    weakest = entities.cohesion(prepared, members, LINK).collect()
    assert len(weakest) == 1 and weakest[0].weakest > 90
    empty = messy.limit(0)
    assert linkage.candidate_pairs(linkage.blocks(linkage.prepare(empty, LINK), LINK), LINK).count() == 0


def test_cohesion_scores_every_pair_of_a_large_company(spark):
    # like the smallest record, unlike each other; by brute force, with repeated lists and a company of one list
    lists = [["alder birch"]] + [[f"alder {w}"] for w in ("quo", "zim")] + [["birch fyxu"]] + [["alder birch"]] * 70
    rows = [(f"A{k:03}", v, "C1") for k, v in enumerate(lists)] + [(f"B{k}", ["same name"], "C2") for k in range(3)] + [(f"D{k}", [f"w{k}"], "C3") for k in range(2)]
    rows += [(f"E{k:03}", [f"name {k * 7919 % 1000:03}"], "C4") for k in range(90)]
    df = spark.createDataFrame(rows, "record_id string, variants array<string>, company_id string")
    got = {r.company_id: r.weakest for r in entities.cohesion(df.drop("company_id"), df.drop("variants"), LINK).collect()}
    want = {}
    for c in ("C1", "C2", "C4"):
        own = [v for _, v, of in rows if of == c]
        want[c] = min(best_name_score(a, b, LINK.generic, LINK.slack)[0] for i, a in enumerate(own) for b in own[i + 1 :])
    assert got == {c: pytest.approx(w) for c, w in want.items()}
    assert want["C1"] < min(best_name_score(lists[0], b, LINK.generic, LINK.slack)[0] for b in lists[1:])
