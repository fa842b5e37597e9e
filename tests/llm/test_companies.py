"""Matching of records and linking of spellings."""

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.llm import matching, names, spelled
from tallyweave.llm.blocking import whole_pairs
from tallyweave.llm.variants import found_variants, link_spellings

SCHEMA = "record_id string, source string, name string, dba string, state string, zip string, phone string, website string"
CORES = ["Brunovale Kestirham", "Zandorfell Lundumgate", "Morgistead Vintaywick", "Hestolburn Jarnusford", "Oxenagrave Pralimmont", "Crelotoft Quinaspole", "Ruddaylock Gildensett", "Farlowmere Nystumkirk"]
Q_SCHEMA = "record_a string, record_b string, name_a string, name_b string, decision string, seq bigint"


def rows():
    out = []
    for k, core in enumerate(CORES):
        site, line = core.lower().replace(" ", "") + ".example", f"29{k}-2{k}5-01{k}0"
        a, b = core.split()
        out += [
            (f"R{k}1", "reg", f"{core} Fire Alarm Inc", None, "IL", "60101", None, None),
            (f"L{k}2", "lic", f"Fire Alm: {b}/{a}", None, "il", None, line, f"https://{site}/"),
            (f"W{k}3", "web", f"{a[:3]}{a[4:]} {b} Fire Alarm", None, "Illinois", None, f"+1 {line}", None),
            (f"W{k}4", "Web", "Name Not Provided", None, "IL", None, line, site),
            (f"P{k}5", "per", f"{core} Plumbing", None, "IL", "60101", None, None),
            (f"R{k}6", "reg", f"{core} Fire Alarm", None, "OH", None, None, None),
        ]
    return out


@pytest.fixture(scope="module")
def records(spark):
    data = rows()
    return spark.createDataFrame(data + data[:3] + [(None, "reg", "x", None, None, None, None, None)], SCHEMA)


def test_matches_and_non_matches(records):
    m = matching.match_records(records)
    got = {(r.record_a, r.record_b) for r in matching.found_pairs(m.groups).collect()}
    want = set()
    for k in range(len(CORES)):
        ids = sorted([(f"R{k}1", "reg"), (f"L{k}2", "lic"), (f"W{k}3", "web"), (f"W{k}4", "web")])
        want |= {(a, b) for i, (a, fa) in enumerate(ids) for b, fb in ids[i + 1 :] if fa != fb}
    assert got == want
    p = [r.posterior for r in m.pairs.collect()]
    assert all(0 <= x <= 1 for x in p)


def test_spellings(spark, records):
    queue = spark.createDataFrame([("W03", "R01", "x", "Brunovale Kestirham", None, 1), ("P05", "R01", None, None, "merge", 2), (None, "R01", None, None, None, 3), ("W14", "R11", None, None, None, 4)], Q_SCHEMA)
    linked = link_spellings(records, queue)
    groups = {}
    for r in linked.collect():
        groups.setdefault(r.root, set()).add(r.rid)
    for k in range(len(CORES)):
        assert {f"R{k}1", f"L{k}2", f"W{k}3"} in groups.values() and {f"P{k}5"} in groups.values() and {f"R{k}6"} in groups.values()
    assert [tuple(r) for r in found_variants(linked, queue).collect()] == [("R01", "W03")]


def test_empty_tables(spark, records):
    none = records.limit(0)
    queue = spark.createDataFrame([], Q_SCHEMA)
    m = matching.match_records(none)
    assert matching.found_pairs(m.groups).count() == 0 and m.pairs.count() == 0
    assert link_spellings(none, queue).count() == 0


def test_mixture_separates_counted_cells():
    cells = np.array([[20, 2, 1, 3], [19, -1, -1, 2], [3, 0, 0, 0], [21, -1, -1, 3], [-1, 2, -1, 2], [2, -1, -1, 0]])
    counts = np.array([50, 40, 60, 20, 10, 30.0])
    mix, post = matching.fit_mixture(cells, counts)
    assert (post > 0.5).tolist() == [True, True, False, False, True, False] and 0 < mix.share < 1
    _, cut = matching.fit_mixture(cells, counts, np.array([1, 1, 1, 1, 0.0, 1]))
    assert cut[4] == 0


@pytest.mark.parametrize(
    ("name", "dba", "own", "family"),
    [
        ("The Skaravern & Varnirbach Sprinkler Svc., L.L.C.", None, ("skaravern", "varnirbach"), 1),
        ("CALDEST QUINOR HOLDINGS, INC. D/B/A LUNDATOFT KESTUDLOCK PLMBG", None, ("lundatoft", "kestudlock"), 3),
        ("Caldest Quinor Holdings LLC", "Lundatoft Kestudlock F.A.", ("lundatoft", "kestudlock"), 1),
        ("Caldest Quinor Holdings LLC", None, (), 0),
        ("Fire Protection Services", None, (), 1),
        ("name not provided.", None, (), 0),
        (None, None, (), 0),
        ("Skar0vern Mont1nwick Elec", None, ("skarovern", "montlnwick"), 4),
    ],
)
def test_parse(name, dba, own, family):
    trading, _ = names.parse_name(name, dba)
    assert (trading.own, trading.family) == (own, family)


def entities_of(linked):
    groups = {}
    for r in linked.collect():
        groups.setdefault(r.root, set()).add(r.rid)
    return sorted(map(sorted, groups.values()))


def test_line_and_site_bring_less_alike_spellings_together(spark):
    data = [
        ("A1", "reg", "Brunovale Kestirham Fire Alarm", None, "IL", None, None, "a.example"),
        ("A2", "lic", "Brunovale Kestwolom Fire Alarm", None, "IL", None, None, "a.example"),  # 0.56 and a site
        ("B1", "reg", "Crelotoft Quinaspole Fire Alarm", None, "IL", None, "290-215-0100", "b.example"),
        ("B2", "lic", "Crelotoft Quinexbult Fire Alarm", None, "IL", None, "290-215-0100", "b.example"),  # 0.5, line and site
        ("C1", "reg", "Morgistead Vintaywick Fire Alarm", None, "IL", None, "291-215-0100", "c.example"),
        ("C2", "lic", "Zandorfell Lundolgosk Fire Alarm", None, "IL", None, "291-215-0100", "c.example"),  # 0.5 to another spelling of C1
        ("D1", "reg", "Hestolburn Jarnusford Fire Alarm", None, "IL", None, "292-215-0100", None),
        ("D2", "lic", "Hestolburn Jarwiskolm Fire Alarm", None, "IL", None, "292-215-0100", None),  # 0.5 and a line only
    ]
    queue = spark.createDataFrame([("C1", "A1", "Zandorfell Lundumgate Fire Alarm", None, None, 1)], Q_SCHEMA)
    assert entities_of(link_spellings(spark.createDataFrame(data, SCHEMA), queue)) == [["A1", "A2"], ["B1", "B2"], ["C1", "C2"], ["D1"], ["D2"]]


def test_merging_goes_on_until_nothing_merges(spark):
    starts, ends = ("Brunovale", "Zandorfell", "Morgistead", "Hestolburn"), ("Kestirham", "Lundumgate", "Vintaywick", "Jarnusford")
    cores = [f"{a} {b} Fire Alarm" for a in starts for b in ends][:15]
    # each record but the first lacks its state, and prints a spelling of the next: one joins in each round
    data = [(f"A{k:02}", "reg", core, None, None if k else "IL", None, None, None) for k, core in enumerate(cores)]
    queue = [(f"A{k:02}", f"A{k + 1:02}", cores[k + 1], None, None, k) for k in range(14)]
    assert entities_of(link_spellings(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(queue, Q_SCHEMA))) == [[r[0] for r in data]]


def like_by_names(spark, words, **kw):
    rows = spark.createDataFrame([(k, *w) for k, w in enumerate(words)], "sid long, w1 string, w2 string")
    return {(r.s, r.t) for r in matching.like_spellings(rows, **kw).collect()}


def test_like_spellings_meet_with_a_typo_in_each_word(spark):
    pairs = [
        (("borkestvale", "mardoronby"), ("birkestvale", "mrdoronby")),
        (("vinttirstad", "bodtorick"), ("vintirstad", "bostorick")),
        (("nevudling", "vlntudstow"), ("evudling", "vintudstow")),
        (("kestirhamm", "lundumgate"), ("kastilhamm", "lendumgote")),  # two letters in each
        (("eskanvarcorsumlock", ""), ("corsumock", "eskanvar")),
        (("skarayvalelundorland", ""), ("skarxvalelundrland", "")),
    ]
    assert like_by_names(spark, [w for p in pairs for w in p]) == {(2 * k, 2 * k + 1) for k in range(len(pairs))}


def test_every_pair_of_a_large_block_is_compared(spark):
    # one frequent word, with 300 others of the same start; pairs differ in an early and in a late letter
    letters = "bcdfghjklmnprstvwz"
    other = [f"ba{x}o{y}e{letters[(3 * k) % 18]}i{letters[-1 - k % 18]}o" for k, (x, y) in enumerate((x, y) for x in letters for y in letters)][:300]
    words = [("american", w) for w in other] + [("american", w[:2] + "q" + w[3:8] + "q" + w[9:]) for w in other[:20]]
    assert {(k, 300 + k) for k in range(20)} <= like_by_names(spark, words)
    rows = spark.createDataFrame([(k, "x") for k in range(45)] + [(k, "y") for k in range(3)] + [(k, None) for k in range(3)], "id long, key string")
    pairs = sorted((r.key, r.a, r.b) for r in rows.transform(lambda d: whole_pairs(d.withColumn("k", d.key), "k", ("id", "key"), 10)).selectExpr("a.key", "a.id a", "b.id b").collect())
    assert pairs == [("x", a, b) for a in range(45) for b in range(a + 1, 45)] + [("y", 0, 1), ("y", 0, 2), ("y", 1, 2)]


def test_parts_of_a_frequent_spelling_meet(spark):
    core = "Brunovale Kestirham"
    data = [(f"A{k}", "reg", f"{core} Fire Alarm", None, "IL", "60101", None, None) for k in range(4)]
    data += [("B1", "lic", f"{core} Fire Alarm", None, "IL", "60202", None, None), ("B2", "web", f"{core} Fire Alarm", None, "IL", None, None, None), ("B3", "web", core, None, "IL", "60101", None, None)]
    data += [("C1", "reg", f"{core} Fire Alarm", None, "OH", "44101", None, None), ("C2", "reg", f"{core} Plumbing", None, "IL", "60101", None, None), ("D1", "lic", "Brunovale Kestirhan Fire Alarm", None, "OH", None, None, None)]
    records = spark.createDataFrame(data, SCHEMA)
    pairs = {(r.a, r.b) for r in matching.candidates(matching.prepared(records), 3).collect()}
    assert {("A0", "B1"), ("A0", "B2"), ("A0", "B3"), ("B1", "B2"), ("B1", "B3"), ("B2", "B3"), ("B3", "C2"), ("C1", "D1")} <= pairs and ("A0", "C1") not in pairs
    linked = entities_of(link_spellings(records, spark.createDataFrame([], Q_SCHEMA), 3))
    assert ["C1", "D1"] in linked


def test_records_that_say_less_are_placed_over_any_number_of_steps(spark):
    # F says everything, L1 to L6 hang on it one by one; M1 and M2 hang on nothing
    edges = [("F", "L1", True, False, 2.0)] + [(f"L{k}", f"L{k + 1}", False, False, 2.0) for k in range(1, 6)] + [("M1", "M2", False, False, 2.0)]
    labels, _ = matching._labels(spark.createDataFrame(edges, "a string, b string, fa boolean, fb boolean, w double"))
    assert {(r.rid, r.root) for r in labels.collect()} == {("F", "F"), *((f"L{k}", "F") for k in range(1, 7)), ("M1", "M1"), ("M2", "M1")}


def test_a_large_part_of_a_frequent_spelling_is_paired_whole(spark):
    data = [(f"A{k}", "reg", "Brunovale Kestirham Fire Alarm", None, "IL", "60101", None, None) for k in range(8)]
    pairs = {(r.a, r.b) for r in matching.candidates(matching.prepared(spark.createDataFrame(data, SCHEMA)), 3).collect()}
    assert pairs == {(f"A{i}", f"A{j}") for i in range(8) for j in range(i + 1, 8)}


def test_violated_triangles_are_settled_pair_by_pair(spark):
    scored = [
        # A-B and B-C match, A-C speaks against more than B-C for it: B-C is lowered
        ("A", "B", 1, 0.99, True, True), ("B", "C", 2, 0.8, True, True), ("A", "C", 3, 0.001, True, True),
        # here A-C is only doubtful and is raised
        ("D", "E", 1, 0.99, True, True), ("E", "F", 1, 0.99, True, True), ("D", "F", 4, 0.4, True, True),
        # L says less and stands between two groups: the larger claim takes it
        ("G", "L", 1, 0.99, True, False), ("H", "L", 2, 0.8, True, False), ("G", "H", 3, 0.001, True, True),
    ]
    df = spark.createDataFrame(scored, "a string, b string, v int, p double, fa boolean, fb boolean")
    labels, corrections = matching.transitive(df)
    root = {r.rid: r.root for r in labels.collect()}
    assert root == {"A": "A", "B": "A", "D": "D", "E": "D", "F": "D", "G": "G", "L": "G"}
    new = {(r.a, r.b): r.q for r in corrections.collect()}
    assert set(new) == {("B", "C"), ("D", "F"), ("H", "L")} and new["D", "F"] == pytest.approx(0.9801) and max(new["B", "C"], new["H", "L"]) < 0.5
    final = {(a, b): new.get((a, b), p) for a, b, _, p, _, _ in scored}
    assert all((p >= 0.5) == (root.get(a, a) == root.get(b, b)) for (a, b), p in final.items())


def test_posteriors_and_groups_agree(records):
    m = matching.match_records(records)
    root = {r.rid: r.root for r in m.groups.collect()}
    for r in m.pairs.collect():
        assert (r.posterior >= 0.5) == (r.a in root and root.get(r.a) == root.get(r.b)), r


def test_large_blocks_dealt_into_parts_give_the_same_pairs(spark):
    from tallyweave.llm import spelled

    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeo"), 9)) for _ in range(12)]
    rows = [(i, "brunostell", w[:k] + c + w[k + 1 :]) for i, (w, k, c) in enumerate((w, k, c) for w in words for k in (0, 4, 8) for c in "xy")]
    df = spark.createDataFrame(rows, "sid long, w1 string, w2 string")
    pairs = [{(r.s, r.t, round(r.like, 6)) for r in spelled.like_spellings(df, 0.68, most).collect()} for most in (4096, 5)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 100


def test_a_line_on_many_records_of_one_firm_gives_every_pair(spark):
    line, shared = "290-215-0100", "291-215-0100"
    data = [(f"A{k}", "reg", "Brunovale Kestirham Fire Alarm", None, "IL", f"6010{k}", line, None) for k in range(5)]
    data += [("B1", "web", "Name Not Provided", None, "IL", None, line, None), ("B2", "lic", "Vintaywick Brunovale Alarm", None, "IL", None, line, None)]
    data += [(f"C{k}", "reg", f"{core} Fire Alarm", None, "IL", None, shared, None) for k, core in enumerate(CORES[1:6])]
    pairs = {(r.a, r.b) for r in matching.candidates(matching.prepared(spark.createDataFrame(data, SCHEMA)), 3).collect()}
    firm = sorted(r[0] for r in data if r[6] == line)
    assert pairs == {(a, b) for i, a in enumerate(firm) for b in firm[i + 1 :]}


def test_a_site_on_many_records_of_one_firm_links_spellings(spark):
    # a spelling of likeness 0.56 needs the site, which more records than ``most`` state
    data = [(f"A{k}", "reg", "Brunovale Kestirham Fire Alarm", None, "IL", None, None, "a.example") for k in range(5)]
    data += [("A5", "lic", "Brunovale Kestwolom Fire Alarm", None, "IL", None, None, "a.example")]
    data += [(f"B{k}", "reg", f"{w} Fire Alarm", None, "IL", None, None, "b.example") for k, w in enumerate(("Crelotoft Quinaspole", "Crelotoft Quinexbult", "Ruddaylock Gildensett", "Farlowmere Nystumkirk", "Oxenagrave Pralimmont"))]
    linked = entities_of(link_spellings(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([], Q_SCHEMA), 3))
    assert linked == [[f"A{k}" for k in range(6)], *[[f"B{k}"] for k in range(5)]]


def test_components_settled_in_a_task_agree_with_joins(spark):
    rng = np.random.default_rng(5)
    full = rng.random(240) < 0.6
    rows = []
    for g in range(0, 240, 6):
        for a in range(g, g + 6):
            for b in range(a + 1, g + 6):
                if rng.random() < 0.7:
                    rows.append((a, b, int(rng.integers(9)), float(rng.choice([0.97, 0.9, 0.8, 0.6, 0.4, 0.2, 0.02])), bool(full[a]), bool(full[b])))
    scored = spark.createDataFrame(rows, "a long, b long, v int, p double, fa boolean, fb boolean")

    def told(labels, corrections):
        return sorted(map(tuple, labels.collect())), sorted((r.a, r.b, r.v, round(r.p, 9), round(r.q, 6)) for r in corrections.collect())

    expected = told(*matching.transitive(scored))
    assert expected[1]
    assert told(*matching.settle(scored)) == expected
    assert told(*matching.settle(scored, most=8)) == expected


def test_a_changed_letter_touches_two_letter_bits():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeimnorst"), rng.integers(4, 14))) for _ in range(400)]
    typed = [w[:i] + x + w[i + k :] for w, i, x, k in zip(words, rng.integers(0, 4, 400), rng.choice(["", "a", "e", "t"], 400), rng.integers(0, 2, 400))]
    bits = [spelled._letters(spelled.letter_counts(pa.array(ws))) for ws in (words, typed)]
    apart = np.bitwise_count(bits[0] ^ bits[1])
    assert (apart <= 2 * spelled.changes(pa.array(words), pa.array(typed))).all()


def test_words_of_a_block_compared_once_lose_no_spelling():
    rng = np.random.default_rng(4)
    typo = lambda w: w[:3] + rng.choice(list("aeo")) + w[4:] if rng.random() < 0.4 else w
    ends = ["".join(rng.choice(list("abdeilmnorst"), 6)) for _ in range(40)]
    m = [typo(ends[rng.integers(40)]) + "stone" for _ in range(700)]
    o = [typo(ends[rng.integers(8)]) + "wick" for _ in range(700)]
    keyed = next(spelled._keyed([pa.RecordBatch.from_arrays([pa.array(["-"] * 700), pa.array(m), pa.array(o)], ["label", "w1", "w2"])]))
    rows = keyed.set_column(0, "key", keyed["key"].dictionary_encode().indices.cast(pa.int64())).append_column("side", pa.array(np.zeros(keyed.num_rows, np.int8)))
    blocks = rows.select(["key", "side", "m", "o"]).sort_by("key")
    found = {tuple(sorted([tuple(sorted([r["xm"], r["xo"]])), tuple(sorted([r["ym"], r["yo"]]))])) for batch in spelled._pairs(blocks, matching.LIKE) for r in batch.to_pylist()}
    left, right = np.triu_indices(700, 1)
    like = spelled._likeness(*(pa.array(np.array(w)[i]) for i in (left, right) for w in (m, o)), matching.LIKE)
    assert len(found) > 500
    assert found == {tuple(sorted([tuple(sorted([m[i], o[i]])), tuple(sorted([m[j], o[j]]))])) for i, j in zip(left[like >= matching.LIKE], right[like >= matching.LIKE])}
    assert len(list(spelled._close(np.zeros(5, np.uint64), np.zeros(5, np.uint64), np.zeros(5, np.uint8), np.zeros(5, np.uint8), True))[0][0]) == 15


def test_a_like_pair_is_measured_where_it_first_meets_and_only_crowded_labels_are_counted(spark):
    """Words of eight letters give three starts and ends: one block of each word measures the pair, not six."""
    pair = [("brunovel", "kestirha"), ("brunovel", "kestirhb")]
    keyed = [(k, 0, m, o, mark) for a, b in pair for k, m, o, mark in spelled.meeting_keys(a, b)]
    keyed.sort(key=lambda r: (r[0], r[1], r[4]))
    number = {k: i for i, k in enumerate(dict.fromkeys(r[0] for r in keyed))}
    kinds = (pa.int64(), pa.int8(), pa.string(), pa.string(), pa.int8())
    rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(number[k], s, m, o, x) for k, s, m, o, x in keyed]), kinds)], ["key", "side", "m", "o", "mark"])
    found = [r for batch in spelled._pairs(rows, matching.LIKE) for r in batch.to_pylist()]
    assert len(found) == 2 and {frozenset((r["xm"], r["ym"])) for r in found} == {frozenset(("brunovel",)), frozenset(("kestirha", "kestirhb"))}
    told = spark.createDataFrame([("IL", chr(97 + i % 13) + "alumet", chr(97 + i // 13) + "orwen") for i in range(100)], "label string, w1 string, w2 string")
    assert spelled._crowded(told, {"IL": 100}, 150) == [] and spelled._crowded(told, {"IL": 100}, 99) == ["IL"]
