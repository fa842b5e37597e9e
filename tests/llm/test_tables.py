"""Top N, components, survivorship, packing."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import packing
from tallyweave.llm.blocking import block_pairs, heavy
from tallyweave.llm.components import components, merged_groups
from tallyweave.llm.survivorship import record_survivors, survivors, target_survivors
from tallyweave.llm.topn import top_n


def test_top_n_equals_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice(["x", None]), rng.choice([1.5, 2.0, 2.0, -7.0, 1e300, float("inf"), 0.0]), f"i{i:04d}") for i in range(400)]
    rows += [("hot", "x", 5.0, f"h{i:04d}") for i in range(500)] + [("a", "x", None, "n1"), ("a", "x", float("nan"), "n2"), ("few", None, 1.0, "f1")]
    df = spark.createDataFrame(rows, "g string, h string, s double, i string").repartition(5)
    got = sorted((r.g, r.h or "", r.place, r.i) for r in top_n(df, ["g", "h"], "s", [F.col("i")], 3).collect())
    want = []
    groups = {}
    for r in rows:
        if r[2] is not None and r[2] == r[2]:
            groups.setdefault(r[:2], []).append(r)
    for (g, h), rs in groups.items():
        want += [(g, h or "", k, r[3]) for k, r in enumerate(sorted(rs, key=lambda r: (-r[2], r[3]))[:3], 1)]
    assert got == sorted(want)


def test_top_n_edges(spark):
    df = spark.createDataFrame([], "g string, s double, i string")
    assert top_n(df, ["g"], "s", [F.col("i")], 3).count() == 0
    with pytest.raises(ValueError):
        top_n(df.withColumn("place", F.lit(1)), ["g"], "s", [F.col("i")], 3)


def roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("bound", [1_000_000, 1])
def test_components_either_way(spark, bound):
    rng = random.Random(5)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("hub", f"z{i}") for i in range(80)]
    edges += [(f"r{rng.randrange(120):03d}", f"r{rng.randrange(120):03d}") for _ in range(70)] + [("a", None), (None, None), ("q", "q"), ("z1", "hub")]
    df = spark.createDataFrame(edges, "x string, y string").withColumn("u", F.lit("clash")).repartition(4)
    got = {r.node: r.root for r in components(df, "x", "y", bound).collect()}
    assert got == roots(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "x string, y string"), "x", "y").count() == 0


def test_latest_decision_counts(spark):
    q = [("a", "b", "merge", 1), ("b", "a", "reject", 2), ("c", "d", "reject", 3), ("d", "c", " MERGE ", 4), ("d", "e", "merge?", 5), ("e", "f", "merge", None), (None, "a", "merge", 9), ("a", "a", "merge", 10)]
    got = {r.record_id: r.group_id for r in merged_groups(spark.createDataFrame(q, "record_a string, record_b string, decision string, seq bigint")).collect()}
    assert got == {"c": "c", "d": "c", "e": "e", "f": "e"}


def test_survivors_rules(spark):
    rows = [("g", "r1", 0.9, None, True), ("g", "r2", 0.9, "2024-01-01", True), ("g", "r0", 0.9, "2024-01-01", True), ("g", "r3", 0.5, "2025-01-01", True), ("g", "r4", 1.0, "2025-01-01", False), ("h", "s1", 0.5, None, False), (None, "t", 1.0, None, True)]
    df = spark.createDataFrame(rows, "group_id string, id string, t double, d string, ok boolean")
    got = survivors(df.union(df), "group_id", "id", {"f": F.col("ok")}, F.col("t"), F.to_timestamp("d")).collect()
    assert [tuple(r) for r in got] == [("g", "f", "r0")]


def test_record_and_target_survivors(spark):
    r = [("r1", "Web-Listing", "N/A", "555-0142", "www", "99999", None), ("r2", " web_listing", "Acme LLC d/b/a Bolt", "(123) 456-7890", "info@a.example", "60101-1234", None), ("r3", "other", "Acme Fire, Inc.", "1-290-955-0100 x3", None, None, None)]
    records = spark.createDataFrame(r, "record_id string, source string, name string, phone string, website string, zip string, observed_at timestamp")
    groups = spark.createDataFrame([(f"r{i}", "r1") for i in (1, 2, 3)], "record_id string, group_id string")
    specs = spark.createDataFrame([("web_listing", "x", 0.6)], "feed string, adapter string, trust double")
    got = {x.field: x.row_id for x in record_survivors(records, groups, specs).collect()}
    assert got == {"name": "r2", "legal_name": "r2", "phone": "r3", "website": "r2", "zip": "r2"}
    t = [("c", "t1", "Acme", " ", "other; WEB LISTING", None), ("c", "t2", "Acme", "-", None, None), ("d", "t3", "Solo", None, None, None), ("c", "t1", "Acme", " ", "other; WEB LISTING", None)]
    targets = spark.createDataFrame(t, "company_id string, target_id string, name string, legal_name string, sources string, scored_at timestamp")
    assert [tuple(x) for x in target_survivors(targets, specs).collect()] == [("c", "target_name", "t1")]


def test_block_pairs_past_the_bound(spark):
    rows = [("big", f"b{i:02d}", "p" if i < 3 else "q") for i in range(10)] + [("s", "s1", "p"), ("s", "s2", "q"), (None, "n", "p")]
    df = spark.createDataFrame(rows, "k string, id string, f string")
    assert [r.k for r in heavy(df, "k", 4).collect()] == ["big"]
    got = {(r.a.id, r.b.id) for r in block_pairs(df, "k", ("id",), F.col("f"), 4).collect()}
    want = {("s1", "s2")} | set(itertools.combinations(["b00", "b01", "b02"], 2)) | {("b03", f"b{i:02d}") for i in range(4, 10)}
    assert got == want
    assert {(r.a.id, r.b.id) for r in block_pairs(df, "k", ("id",), None, 4).collect()} == {("s1", "s2")}


def test_hilbert_is_a_curve():
    import numpy as np

    cells = np.array(list(itertools.product(range(8), repeat=2)))
    order = cells[np.argsort(packing.hilbert_key(cells, 3))]
    assert len(set(packing.hilbert_key(cells, 3))) == 64
    assert all(abs(a - b).sum() == 1 for a, b in zip(order, order[1:]))


def test_packing_places_everything_once(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alarm", "valve", "riser", "pump"]) for _ in range(rng.randrange(1, 300)))) for i in range(150)]
    texts += [(900, "word " * 3000), (901, None), (902, ""), (903, "x")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("n", F.lit("clash")).repartition(3)
    rows = packing.pack_texts(df, capacity=256).collect()
    enc = packing.encoding()
    sizes = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in texts}
    placed, boxes = {}, {}
    for r in rows:
        placed.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
        boxes[r.container_id] = boxes.get(r.container_id, 0) + r.n_tokens
    assert max(boxes.values()) <= 256 and {k: sum(n for *_, n in v) for k, v in placed.items()} == sizes
    for i, v in placed.items():
        v.sort()
        assert [p for p, *_ in v] == list(range(len(v))) and all(a == p * 256 for p, a, _ in v)
        assert len(v) == 1 or sizes[i] > 256
    assert len(boxes) <= sum(sizes.values()) / 256 + 3
    assert packing.pack_texts(df.limit(0)).count() == 0


def test_containers_are_full_and_hold_neighbours(spark):
    rng = random.Random(11)
    n = 4000
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(range(i, i + 500)), "n": pa.array([min(1024, int(rng.lognormvariate(5.2, 0.9)) + 5) for _ in range(500)])}) for i in range(0, n, 500)]
    boxes, held = {}, {}
    df = spark.createDataFrame(pa.Table.from_batches(batches).to_pandas()).coalesce(1).sortWithinPartitions("k")
    for r in df.mapInArrow(lambda it: packing._pack(it, 1024, packing.WINDOW), "box bigint, k bigint, piece int, at bigint, n int").collect():
        boxes.setdefault(r.box, []).append(r.k)
        held[r.box] = held.get(r.box, 0) + r.n
    assert sorted(k for ks in boxes.values() for k in ks) == list(range(n)) and max(held.values()) <= 1024
    assert sum(held.values()) / (1024 * len(held)) >= 0.98
    spans = sorted(max(ks) - min(ks) for ks in boxes.values())
    assert spans[len(spans) // 2] <= 0.02 * n


def test_fullest_takes_first_of_equal_choices():
    assert packing.fullest([3, 5, 5, 2], 8) == [0, 1] and packing.fullest([], 4) == [] and packing.fullest([9], 4) == [] and packing.fullest([0, 4], 4) == [1]
