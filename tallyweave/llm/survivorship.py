"""Field-by-field survivorship in one aggregation.

For each attribute a composite struct of (priority, time, id), present only where
the value is usable, goes through one min or max per group; the struct that wins
names the surviving row. All attributes share a single shuffle with map-side
combining, so a group of any size costs one state per task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.tokens import ends_in_legal_form, feed_key, five_digits, is_stand_in, legal_part, ten_digits, web_host

MAX_FEEDS = 10_000
DEFAULT_TRUST = 0.5


def survivors(df: DataFrame, group: str, row_id: str, usable: Mapping[str, Column], trust: Column, at: Column) -> DataFrame:
    """``group, field, row_id`` of the row that supplies each surviving value.

    Among a group's rows with a usable value: highest ``trust``, then latest
    ``at`` (null is oldest), then smallest ``row_id``. A field without any usable
    value gives no row; null trust is lowest; a null ``usable`` counts as false.
    Repeated rows change nothing. An empty table gives an empty result.
    """
    rank = F.struct(
        (-F.coalesce(trust, F.lit(float("-inf")))).alias("t"),
        F.coalesce(-F.unix_micros(at.cast("timestamp")), F.lit(2**63 - 1)).alias("w"),
        F.col(row_id).alias("id"),
    )
    picks = [F.min(F.when(ok, rank)).alias(f"_f{i}") for i, ok in enumerate(usable.values())]
    best = df.where(F.col(group).isNotNull() & F.col(row_id).isNotNull()).groupBy(group).agg(*picks)
    pairs = [F.struct(F.lit(name).alias("field"), F.col(f"_f{i}.id").alias("row_id")) for i, name in enumerate(usable)]
    return best.select(group, F.inline(F.array(*pairs))).where("row_id IS NOT NULL")


def trust_map(specs: DataFrame, max_feeds: int = MAX_FEEDS) -> dict[str, float]:
    """Trust by normalised feed name; the list of feeds is bounded and its size checked.

    A feed listed twice keeps its highest trust; rows without feed or trust are left out.
    """
    rows = specs.groupBy(feed_key("feed").alias("feed")).agg(F.max("trust").alias("trust")).dropna().limit(max_feeds + 1).collect()
    if len(rows) > max_feeds:
        raise ValueError(f"more than {max_feeds} feeds; raise max_feeds if the list is meant to be that long")
    return {r.feed: r.trust for r in rows}


def _lookup(table: dict[str, float], key: Column) -> Column:
    if not table:
        return F.lit(DEFAULT_TRUST)
    literal = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.element_at(literal, key), F.lit(DEFAULT_TRUST))


def record_survivors(records: DataFrame, groups: DataFrame, specs: DataFrame) -> DataFrame:
    """Name, legal name, phone, website and zip of each group of merged records."""
    name_ok = ~is_stand_in("name")
    # names are read only for records that are in a group
    grouped = records.select("record_id", "source", "observed_at", "name", "phone", "website", "zip").join(groups.select("record_id", "group_id"), "record_id")
    facts = grouped.select(
        "group_id",
        "record_id",
        _lookup(trust_map(specs), feed_key("source")).alias("trust"),
        "observed_at",
        name_ok.alias("name"),
        (name_ok & ends_in_legal_form(legal_part("name"))).alias("legal_name"),
        ten_digits("phone").isNotNull().alias("phone"),
        web_host("website").isNotNull().alias("website"),
        five_digits("zip").isNotNull().alias("zip"),
    )
    fields = ("name", "legal_name", "phone", "website", "zip")
    return survivors(facts, "group_id", "record_id", {f: F.col(f) for f in fields}, F.col("trust"), F.col("observed_at"))


def target_survivors(targets: DataFrame, specs: DataFrame) -> DataFrame:
    """Name and legal name of each company with two or more scorings.

    The trust of a scoring is the highest of the feeds in ``sources`` (0.5 for a
    feed that is not listed, 0 without any feed).
    """
    table = trust_map(specs)
    feeds = F.filter(F.transform(F.split("sources", r"[;,|]"), feed_key), lambda f: f != "")
    trust = F.coalesce(F.array_max(F.transform(feeds, lambda f: _lookup(table, f))), F.lit(0.0))
    rows = targets.select(
        F.col("company_id").alias("group_id"), "target_id", "scored_at", trust.alias("trust"), (~is_stand_in("name")).alias("a"), (~is_stand_in("legal_name")).alias("b")
    )
    repeated = rows.groupBy("group_id").agg(F.min("target_id").alias("lo"), F.max("target_id").alias("hi")).where("lo <> hi")
    found = survivors(rows, "group_id", "target_id", {"target_name": F.col("a"), "target_legal_name": F.col("b")}, F.col("trust"), F.col("scored_at"))
    return found.join(repeated.select("group_id"), "group_id", "left_semi")
