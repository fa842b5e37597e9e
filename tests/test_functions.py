import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import names as N
from tallyweave.functions import numbers as M
from tallyweave.functions import similarity as S
from tallyweave.functions import tokens as T


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols) or "x string"
    row = spark.createDataFrame([tuple(cols.values()) or ("",)], schema).select(expr.alias("v")).first()
    return row.v


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("A.B.C. Fire & Safety Svcs., Inc.", "abc fire safety service"),
        ("Müller's Équip. LLC", "mullers equipment"),
        ("Company Fire Protection Co.", "company fire protection"),
        ("The Co. Company", "co"),
        (None, ""),
        ("  ", ""),
        ("X + Y Holdings Limited", "x y holdings"),
    ],
)
def test_normalize_name(spark, name, want):
    assert one(spark, N.normalize_name("x"), x=name) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Ostrvane Holdings, LLC d/b/a Quenholt Fire Alarm", ("Ostrvane Holdings, LLC", "Quenholt Fire Alarm")),
        ("Acme, doing business as Bolt", ("Acme", "Bolt")),
        ("Acme Fire (IL)", ("Acme Fire (IL)", None)),
        ("Acme Fire (Inc.)", ("Acme Fire (Inc.)", None)),
        ("Acme Fire (Bolt Alarm)", ("Acme Fire", "Bolt Alarm")),
        (None, ("", None)),
    ],
)
def test_split_alias(spark, name, want):
    assert tuple(one(spark, N.split_alias("x"), x=name)) == want


def test_variants_keep_order_and_drop_repeats(spark):
    v = one(spark, N.name_variants("x", "y"), x="Acme Inc dba Bolt Alarm", y="BOLT ALARM LLC")
    assert v == ["acme", "bolt alarm"]


@pytest.mark.parametrize(
    ("name", "drop", "want"),
    [("ACME FIRE AND SAFETY, INC.", False, "Acme Fire and Safety, Inc."), ("ACME L.L.C.", False, "Acme L.L.C."), ("Acme&Bolt  Co.", True, "Acme & Bolt"), ("Inc.", True, "Inc."), (None, True, "")],
)
def test_display_name(spark, name, drop, want):
    assert one(spark, N.display_name("x", drop), x=name) == want


@pytest.mark.parametrize(("x", "want"), [("+1 (217) 555-0142", "2175550142"), ("555-0142", None), ("1217555014", "1217555014"), (None, None)])
def test_nanp_phone(spark, x, want):
    assert one(spark, N.nanp_phone("x"), x=x) == want


@pytest.mark.parametrize(("x", "want"), [("HTTPS://WWW.Acme.example:8080/x?y", "acme.example"), ("info@acme.example", "acme.example"), ("www", None), ("a b.example", None), (None, None)])
def test_site_domain(spark, x, want):
    assert one(spark, N.site_domain("x"), x=x) == want


@pytest.mark.parametrize(("x", "want"), [("(290) 955-0100 ext. 7", "2909550100"), ("1-290-955-0100 x3", "2909550100"), ("123-456-7890", None), ("unlisted", None), (None, None)])
def test_ten_digits(spark, x, want):
    assert one(spark, T.ten_digits("x"), x=x) == want


@pytest.mark.parametrize(("x", "want"), [("Acme Holdings LLC d/b/a Bolt", True), ("Acme (Bolt Inc)", False), ("Acme, Corp..", True), ("Acme", False), (None, False)])
def test_ends_in_legal_form(spark, x, want):
    assert one(spark, T.ends_in_legal_form(T.legal_part("x")), x=x) is want


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=14), st.text("abcd ", max_size=14))
def test_kernel_equals_table(a, b):
    assert S.common_length(a, b) == dp(a, b)


def test_kernel_equals_column_twin(spark):
    rows = [("braxmoor fire", "braxmor fier"), ("a", ""), ("", ""), ("abc", "abc")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.common_length_column(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == dp(r.a, r.b) for r in df.collect())


def test_name_scores():
    g = frozenset({"fire", "protection"})
    assert S.token_set("a b", "a b c") == 100
    assert S.token_set("", "a") == 0
    assert S.name_score("", "a", g, 15) == 0
    assert S.name_score("acme fire protection", "bolt fire protection", g, 15) < 60
    assert S.best_name_score(["x", "acme fire"], ["acme fire"], g, 15) == (100.0, "acme fire", "acme fire")


def test_numbers(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-1.96,), (None,)], "x double").select(M.normal_cdf("x").alias("p"))
    p = [r.p for r in df.collect()]
    assert [round(v, 6) for v in p[:3]] == [0.5, 0.841345, 0.024998] and p[3] is None or math.isnan(p[3])
    bands = {"20-49": (20, 49), "10 to 19": (10, 19), "500+": (500, 1500), "many": None, "9-5": None}
    for text, want in bands.items():
        got = one(spark, M.parse_band("x"), x=text)
        assert (tuple(got) if got else None) == want
    shown = spark.createDataFrame([(1234567.5,), (0.123456,), (12.5,), (0.0,)], "x double").select(M.short_number("x").alias("s"))
    assert [r.s for r in shown.collect()] == ["1,234,568", "0.1235", "12.5", "0"]
    g = spark.createDataFrame([(20.0, 1.0), (25.5, 0.9)], "v double, w double").select(M.geometric_mean("v", "w").alias("g")).first().g
    assert abs(g - math.exp((math.log(20) + 0.9 * math.log(25.5)) / 1.9)) < 1e-9
