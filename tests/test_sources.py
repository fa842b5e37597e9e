import zipfile

import pytest
from pyspark.sql import functions as F

from tallyweave import cli
from tallyweave.operators.skew import balanced_key_counts, heavy_keys
from tallyweave.sources import feeds, sinks, synthetic
from tallyweave.spec import Feed, Spec, SpecError, demo_spec, spec_from_mapping, spec_from_yaml


def good():
    return {"name": "x", "feeds": [{"feed": "a", "adapter": "synthetic"}]}


@pytest.mark.parametrize(
    "change",
    [
        {"name": ""},
        {"feeds": []},
        {"feeds": [{"feed": "a", "adapter": "s"}, {"feed": "a", "adapter": "s"}]},
        {"feeds": [{"feed": "a", "adapter": "s", "trust": 2}]},
        {"states": ["Illinois"]},
        {"unknown": 1},
        {"linkage": {"merge_at": 50}},
        {"linkage": {"prefix": 0}},
        {"ranking": {"weight_p": -1}},
        {"sizing": {"mode": "other"}},
        {"visibility": {"databases": [{"database": "d", "checker": "c"}, {"database": "d", "checker": "c"}]}},
        {"sector": {"fit": {"A": 1}}},
        {"top_n": 0},
    ],
)
def test_bad_settings(change):
    with pytest.raises(SpecError):
        spec_from_mapping(good() | change)


def test_good_settings():
    assert demo_spec().feeds[0].trust == 0.9
    with pytest.raises(SpecError):
        spec_from_yaml("a: [")
    assert "prot" in spec_from_mapping(good() | {"linkage": {"abbreviations": {"prot": "protection"}}}).linkage.abbreviations


def test_unknown_adapter_names_the_known(spark):
    with pytest.raises(SpecError, match="synthetic"):
        feeds.read_feeds(spark, Spec("x", (Feed("a", "nothing"),)))


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    a = synthetic.feed_rows(spark, "web_listing", 7, 50).drop("attributes").collect()
    b = synthetic.feed_rows(spark, "web_listing", 7, 50).drop("attributes").repartition(3).collect()
    assert sorted(a, key=str) == sorted(b, key=str) and len(a) > 20
    with pytest.raises(SpecError):
        synthetic.firms(spark, 1, synthetic.MOST_FIRMS + 1)


def test_decisions_last_wins(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("record_a,record_b,decision,x\nA,B, Merge ,1\nB,A,reject,2\nC,D,later,3\n")
    got = feeds.read_decisions(spark, str(p)).collect()
    assert [(r.record_a, r.record_b, r.decision) for r in got] == [("A", "B", "reject")]
    p.write_text("record_a,decision\nA,merge\n")
    with pytest.raises(SpecError):
        feeds.read_decisions(spark, str(p))
    with pytest.raises(SpecError):
        feeds.read_decisions(spark, str(tmp_path / "none.csv"))


def test_licence_csv(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("business_name,state,license_type\nAcme,IL,Fire\nBolt,OH,\n")
    got = feeds.licence_csv(spark, str(p)).orderBy("record_id").collect()
    assert [(r.record_id, r.name, r.attributes.license_type) for r in got] == [("LIC-00001", "Acme", "Fire"), ("LIC-00002", "Bolt", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, True, ["x", "y"])], "i string, n string, b boolean, l array<string>")
    sinks.write_csv(df, tmp_path / "o.csv", ("b", "i", "n", "l"))
    assert (tmp_path / "o.csv").read_text() == "b,i,n,l\nyes,a,,x; y\n"
    for k in (1, 2):
        sinks.write_workbook(tmp_path / f"w{k}.xlsx", {"one": (("a", "b"), [("x & y", 1)])})
    assert (tmp_path / "w1.xlsx").read_bytes() == (tmp_path / "w2.xlsx").read_bytes()
    sheet = zipfile.ZipFile(tmp_path / "w1.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "x &amp; y" in sheet and 'ref="A1:B2"' in sheet and 'state="frozen"' in sheet
    text = sinks.brief("T", {"n": 1}, [{"name": "A", "rank": 1}], ("rank", "name"))
    assert "| 1 | A |" in text
    sinks.write_table(df.drop("l"), str(tmp_path / "t"), "csv")


def test_command_line(tmp_path, capsys):
    p = tmp_path / "s.yaml"
    p.write_text("name: x\nfeeds: [{feed: a, adapter: synthetic}]\n")
    assert cli.main(["validate", str(p)]) == 0
    p.write_text("name: x\n")
    assert cli.main(["validate", str(p)]) == 2
    assert "error" in capsys.readouterr().err


def brute(rows):
    out = {}
    for k, o in rows:
        if k is not None and o is not None:
            out.setdefault(k, []).append(o)
    return {k: (len(v), len(set(v)), min(v), max(v)) for k, v in out.items()}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_balanced_counts_equal_plain_ones(spark, parts):
    rows = [("hot", f"r{i % 37:03d}") for i in range(300)] + [(f"k{i % 20}", f"r{i}") for i in range(100)] + [(None, "r1"), ("k1", None), ("hot", "r000"), ("", "r5")]
    df = spark.createDataFrame(rows, "key string, o string").withColumn("n_rows", F.lit("clash"))
    got = {r.key: (r.n_rows, r.n_distinct, r.low, r.high) for r in balanced_key_counts(df, ["key"], "o", parts).collect()}
    assert got == brute(rows)


def test_balanced_counts_of_nothing(spark):
    assert balanced_key_counts(spark.createDataFrame([], "key string, o string"), ["key"], "o").count() == 0
    assert heavy_keys(spark.createDataFrame([], "k string, m string"), {"k": F.col("k")}, "m").count() == 0


def test_heavy_keys(spark):
    rows = [("hot", f"r{i}") for i in range(30)] + [(f"k{i}", f"s{i}") for i in range(70)] + [("hot", "r1")] * 5
    got = heavy_keys(spark.createDataFrame(rows, "k string, m string"), {"k": F.col("k")}, "m").collect()
    assert [tuple(r) for r in got] == [("k", "hot")]


def test_licences_of_two_files_have_different_ids(spark, tmp_path):
    for k, names in enumerate((["A", "B"], ["C", "D", "E"])):
        (tmp_path / f"{k}.csv").write_text("business_name\n" + "\n".join(names) + "\n")
    got = [r.record_id for r in feeds.licence_csv(spark, str(tmp_path)).collect()]
    assert sorted(got) == [f"LIC-{i:05d}" for i in range(1, 6)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    from tallyweave.streaming.incremental import known_records, link_step

    schema = "record_id string, source string, name string, dba string, city string, state string, zip string, phone string, website string, pos bigint"
    known = [("A", "reg", "Braxmoor Fire", None, None, "IL", None, "217-555-0142", None, 1)]
    first, second = [("B", "lic", "Braxmoor Fire", None, None, "IL", None, "217-555-0142", None, 2)], [("C", "web", "Braxmoor Fire", None, None, "IL", None, "217-555-0142", None, 3), known[0]]
    base, added, out = (str(tmp_path / n) for n in ("base", "added", "out"))
    spark.createDataFrame(known, schema).write.parquet(base)
    for epoch, rows in ((0, first), (0, first), (1, second), (1, second)):
        link_step(spark.createDataFrame(rows, schema), epoch, base, added, out)
    pairs = sorted((r.a, r.b) for r in spark.read.parquet(out).collect())
    assert pairs == [("A", "B"), ("A", "C"), ("B", "C")]
    assert sorted(r.record_id for r in known_records(spark, base, added).collect()) == ["A", "B", "C"]
