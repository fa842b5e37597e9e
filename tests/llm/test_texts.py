"""Leaked items and personal information."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import leaks, pii

RNG = random.Random(11)
VOCAB = [f"w{i}{c}" for i in range(60) for c in "abc"]
ITEMS = [(i, "Choose the best answer below. " + " ".join(RNG.choice(VOCAB) for _ in range(90)) + "?") for i in range(6)]


def quote(item, start, n):
    return leaks.words(ITEMS[item][1].split("below. ")[1])[start : start + n]


def found(spark, docs, items=ITEMS, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("w", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(tuple(r) for r in leaks.find_leaks(d, it, **kw).collect())


def test_quotations(spark):
    noise = [f"n{i}" for i in range(40)]
    long = noise + quote(0, 10, 30) + noise
    marked = "<p>" + "</b> <b>".join(w.upper() + "," for w in quote(1, 0, 40)) + "</p>"
    altered = quote(2, 5, 45)
    altered[14] = "typo"
    altered[30:30] = ["also"]
    docs = [
        (1, " ".join(long)),
        (2, marked),
        (3, " ".join(altered)),
        (4, " ".join(noise + quote(3, 0, 20) + noise)),
        (5, "Choose the best answer below. " + " ".join(noise)),
        (6, None),
        (7, ""),
        (8, " ".join(noise * 500 + quote(4, 20, 25))),
        (9, " ".join(quote(0, 0, 30) + noise + quote(5, 0, 30))),
        (10, " ".join(w for p in zip(quote(3, 0, 40), noise) for w in p)),
    ]
    want = [(1, 0), (2, 1), (3, 2), (8, 4), (9, 0), (9, 5)]
    assert found(spark, docs) == want
    assert found(spark, docs, chars_per_block=900) == want


def test_nothing_to_find(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, "a b c")], items=[]) == []
    assert found(spark, [(1, "short item text")], items=[(1, "short item text")]) == []
    assert found(spark, [(1, " ".join(quote(0, 0, 40)))], items=ITEMS + [ITEMS[0]]) == [(1, 0)]


def brute(doc, item):
    """Reference: best alignment of a stretch of the item with a stretch of the document."""
    best = 0
    for s in range(len(item)):
        for d in range(len(doc)):
            i, j, n = s, d, 0
            while i < len(item) and j < len(doc) and item[i] == doc[j]:
                i, j, n = i + 1, j + 1, n + 1
            best = max(best, n)
    return best >= leaks.WINDOW


def test_exact_containment_equals_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        item = [rng.randrange(40) for _ in range(60)]
        n = rng.choice([20, 24, 25, 26, 40])
        at = rng.randrange(60 - n)
        doc = [-1] * rng.randrange(20) + item[at : at + n] + [-1] * 20
        assert leaks.contains(doc, item, 0, len(doc)) == brute(doc, item)


CASES = [
    ("Write to a.b+c@mail-x.co.example or ring 290.955.0100 x3.", [("email", "a.b+c@mail-x.co.example"), ("phone", "290.955.0100")]),
    ("Mail bob [at] box [dot] test, office(at)box.example or kim at box dot co dot test now.", [("email", "bob [at] box [dot] test"), ("email", "office(at)box.example"), ("email", "kim at box dot co dot test")]),
    ("Call +1 (290) 955-0100, 1 (290) 955-0101 ext. 4 or 290 - 955 - 0102.", [("phone", "+1 (290) 955-0100"), ("phone", "1 (290) 955-0101"), ("phone", "290 - 955 - 0102")]),
    ("ring seven nine two three four six nine eight eight eight after hours", [("phone", "seven nine two three four six nine eight eight eight")]),
    ("Permit 2025-908-9761, order #09103217, tag SN7043330388, meter 0493030244, (***) ***-9851, XXX-XX-4701", []),
    ("SSN 908-13-3830; social security number 977 17 9052; soc. sec. 905401268; taxpayer ID 985-13-1445; passport X08560083; DL# L279785572520; driver’s licence K301-7962-4835", [("id_number", v) for v in ("908-13-3830", "977 17 9052", "905401268", "985-13-1445", "X08560083", "L279785572520", "K301-7962-4835")]),
    ("Ship to 7062 14th Ave., attention Dr. Zoë de Orstest.", [("address", "7062 14th Ave."), ("person", "Zoë de Orstest")]),
    ("lives at 16051B Rastudlow St. #12 and prefers post. Repair at 2502 N. Woldelness Ave. That said", [("address", "16051B Rastudlow St. #12"), ("address", "2502 N. Woldelness Ave")]),
    ("Mail drop is 10028 East County Road 339, Suite 69; phone 290-955-0100", [("address", "10028 East County Road 339, Suite 69"), ("phone", "290-955-0100")]),
    ("Contact on site: Ulvarup, Leonard, and ROBERT D. O'KAMP about it", [("person", "Ulvarup, Leonard"), ("person", "ROBERT D. O'KAMP")]),
    ("Charles Dorn-Vick Safety Testing lost to Orstel Street Mechanical", []),
    ("", []),
    ("no one is here", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_mentions(text, want):
    assert sorted((k, text[a:b]) for a, b, k in pii.mentions(text)) == sorted(want)


def test_redaction_keeps_the_rest():
    assert pii.redact("Write to kim at box dot test today.") == "Write to [EMAIL] today."
    assert pii.redact(None) is None and pii.redact("") == ""


def test_offsets_survive_long_disguised_texts():
    filler = "The valve é held. " * 3000
    text = filler + "Mail bob [at] box [dot] test. " + filler + "Ring two nine zero nine five five zero one zero zero now."
    assert [(k, text[a:b]) for a, b, k in pii.mentions(text)] == [("email", "bob [at] box [dot] test"), ("phone", "two nine zero nine five five zero one zero zero")]


def test_rows(spark):
    df = spark.createDataFrame([(1, "a@b.example a@b.example"), (2, None), (3, "")], "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    assert [tuple(r) for r in pii.find_personal_information(df).collect()] == [(1, "email", "a@b.example")]
    assert {r.doc_id: r.text for r in pii.redact_personal_information(df).collect()} == {1: "[EMAIL] [EMAIL]", 2: None, 3: ""}


def test_names_and_forms_outside_all_lists():
    from tallyweave.llm import pii

    told = [
        ("Reach Brooke Tanaka at 312-555-0188.", "person", "Brooke Tanaka"),
        ("The owner, Dwayne Okafor, (312) 555-0188, knows.", "person", "Dwayne Okafor"),
        ("Thulani Vandermeer keeps the keys: thulani.vandermeer@keys.example", "person", "Thulani Vandermeer"),
        ("Manager: Shanice Q. Pellgrove <sp@keys.example>", "person", "Shanice Q. Pellgrove"),
        ("Contact Mr. Bogdan Stoyanov, phone 312 555 0188", "person", "Bogdan Stoyanov"),
        ("Write to bstoyanov@keys.example, that is Bogdan Stoyanov.", "person", "Bogdan Stoyanov"),
        ("His SSN is 123-45-6789.", "id_number", "123-45-6789"),
        ("Passport number was X12345678", "id_number", "X12345678"),
        ("Ring +49 30 1234567 after nine.", "phone", "+49 30 1234567"),
        ("London: +44 20 7946 0958", "phone", "+44 20 7946 0958"),
        ("Long: " + "a" * 80 + "@x.example", "email", "a" * 80 + "@x.example"),
    ]
    held = set(pii.GIVEN)
    assert not held & {"Brooke", "Dwayne", "Thulani", "Shanice", "Bogdan"}
    missed = [(text, value) for text, kind, value in told if value not in {text[a:b] for a, b, k in pii.mentions(text) if k == kind}]
    assert len(missed) <= 1, missed
    plain = ["Call Riverton Heights at 312-555-0188 Fire Alarm", "Braxmoor Plumbing, contact the manager", "Rated 4500 psi + 200"]
    assert not [m for t in plain for m in pii.mentions(t) if m[2] in ("person", "id_number")]


def test_openings_are_counted_over_all_items_whatever_the_blocks(spark):
    from tallyweave.llm.leaks import find_leaks

    opening = "Read the following case with care and answer the question that stands below it in one word."
    cases = [" ".join(f"word{k}x{i}" for i in range(40)) + "." for k in range(6)]
    items = spark.createDataFrame([(k, f"{opening} {c}") for k, c in enumerate(cases)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before " + cases[2] + " after"), (2, opening + " " + opening), (3, None)], "doc_id long, text string")
    got = [{tuple(r) for r in find_leaks(docs, items, chars_per_block=n).collect()} for n in (10**6, 600)]
    assert got[0] == got[1] == {(1, 2)}
