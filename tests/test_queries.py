"""Queries against their SQL on the smallest tables, and the rules every registered query keeps."""

import importlib
import os
from pathlib import Path

import pytest
from oracle import bags

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAST = (
    "normalized_names name_parts contact_keys contact_pairs pair_order review_token_sort latest_decisions keyword_hits document_keywords record_mix size_signals lognormal_band product_fit"
    " money_rounding obviousness presence_agreement screens composite_rank funnel feed_counts calibration merge_clusters ledger_rows arrivals_stream p5_found p5_key_counts"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", FAST)
def test_equals_sql(spark, name):
    ours, theirs = bags(entry.queries()[name](spark, SF), entry.oracle_sql()[name], SF)
    assert ours == theirs and sum(ours.values()) > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_subpackage():
    package = Path(importlib.import_module("tallyweave").__file__).parent
    for source in package.rglob("*.py"):
        if "llm" not in source.relative_to(package).parts:
            assert "tallyweave.llm" not in source.read_text(), source


def test_entry(spark):
    df = entry.entry(spark)
    assert "score" in df.columns


def test_every_company_is_looked_up(spark):
    from tallyweave.plans import core_queries

    members, _ = core_queries.companies_of(spark, SF)
    found = entry.queries()["presence_lookup"](spark, SF)
    per = len(core_queries.SPEC.visibility.databases)
    assert found.count() == members.select("company_id").distinct().count() * per > 0


def test_order_of_all_pairs(spark):
    found = entry.queries()["pair_order_all"](spark, SF).select("a", "b").collect()
    pairs = entry.queries()["candidate_pairs"](spark, SF).select("a", "b").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, pairs))
