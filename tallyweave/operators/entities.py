"""From merge decisions to companies with one value per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.names import display_name, has_legal_form, normalize_name, operating_name, split_alias
from tallyweave.functions.similarity import best_name_udf
from tallyweave.operators import graph
from tallyweave.session import cut
from tallyweave.spec import Linkage, SpecError


def unique_ids(records: DataFrame, key: str = "record_id") -> DataFrame:
    """The records, after a check that no id stands on two different rows."""
    twice = records.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise SpecError(f"{key} is not unique: {', '.join(str(r[0]) for r in twice)}")
    return records


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` (smallest node) for every node, alone or joined by ``edges`` (a, b)."""
    labels = graph.connected(edges, "a", "b")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def company_ids(members: DataFrame) -> DataFrame:
    """``record_id, company_id``: groups numbered in the order of their smallest record.

    Only the distinct roots are sorted, range by range; the offset of a range is
    the count of those before it, so no task sees them all.
    """
    roots = cut(members.select("root").distinct().repartitionByRange("root").sortWithinPartitions("root").withColumn("part", F.spark_partition_id()), "roots")
    sizes = {r.part: r["count"] for r in roots.groupBy("part").count().collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not before:
        return members.select("record_id", F.lit("").alias("company_id"))
    offset = F.element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), F.col("part"))
    n = F.row_number().over(Window.partitionBy("part").orderBy("root")) + offset
    named = roots.select("root", F.format_string("C%04d", n).alias("company_id"))
    return members.join(named, "root").select("record_id", "company_id")


def weighted_vote(rows: DataFrame, group: str, value: str, weight: Column, order: Column) -> DataFrame:
    """``group, value``: the non-empty value with the largest weight; of equal ones the first by ``order``."""
    some = rows.where(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    votes = some.groupBy(group, value).agg(F.round(F.sum(weight), 9).alias("_w"), F.min(order).alias("_o"))
    return votes.groupBy(group).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col("_o").alias("o"), F.col(value).alias("v"))).alias("b")).select(group, F.col("b.v").alias(value))


def canonical(records: DataFrame, prepared: DataFrame, members: DataFrame, trust: Column, spec: Linkage = Linkage()) -> DataFrame:
    """One row per company: display and legal name, city, state, zip, phone, domain, members, sources, variants.

    Records are taken by trust, highest first, then by id.
    """
    order = F.struct((-trust).alias("t"), F.col("record_id").alias("id"))
    raw = records.select("record_id", "name", "dba", "city", "zip")
    rows = prepared.join(members, "record_id").join(raw, "record_id").withColumn("_order", order).withColumn("_trust", trust)
    rows = cut(rows.withColumn("operating", operating_name("name", "dba")).withColumn("norm", normalize_name(operating_name("name", "dba"), spec.abbreviations)), "members")
    out = rows.groupBy("company_id").agg(
        F.array_sort(F.collect_set("record_id")).alias("member_ids"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_order", "variants"))), lambda s: s["variants"]))).alias("variants"),
        F.min(F.struct("_order", display_name("name", True).alias("v")))["v"].alias("_first"),
        F.min(F.when(has_legal_form(split_alias("name")["legal"]), F.struct("_order", display_name(split_alias("name")["legal"]).alias("v"))))["v"].alias("legal_name"),
    )
    for field in ("state", "phone", "domain"):
        out = out.join(weighted_vote(rows, "company_id", field, F.col("_trust"), F.col("_order")), "company_id", "left")
    won = rows.join(out.select("company_id", F.col("state").alias("_state")), "company_id").where(F.col("_state").isNull() | (F.col("state") == F.col("_state")))
    place = won.groupBy("company_id").agg(
        F.min(F.when(F.nullif("city", F.lit("")).isNotNull(), F.struct("_order", "city")))["city"].alias("city"),
        F.min(F.when(F.nullif("zip", F.lit("")).isNotNull(), F.struct("_order", "zip")))["zip"].alias("zip"),
    )
    norm = weighted_vote(rows, "company_id", "norm", F.col("_trust"), F.col("_order"))
    spelled = rows.join(norm, ["company_id", "norm"], "left_semi").withColumn("v", display_name("operating", True))
    dots = F.length("v") - F.length(F.regexp_replace("v", r"\.", ""))
    shout = (F.col("v") == F.upper("v")).cast("int")
    name = spelled.groupBy("company_id").agg(F.min(F.struct(dots.alias("d"), (-F.length("v")).alias("n"), shout.alias("u"), F.col("_order").alias("o"), F.col("v").alias("v")))["v"].alias("display_name"))
    out = out.join(place, "company_id", "left").join(name, "company_id", "left")
    return out.withColumn("display_name", F.coalesce("display_name", "_first")).drop("_first")


def cohesion(prepared: DataFrame, members: DataFrame, spec: Linkage = Linkage(), most: int = 60) -> DataFrame:
    """``company_id, weakest``: the lowest name score inside each company of three or more.

    Every pair of a company counts; repeated variant lists are scored once. Companies
    of more than ``most`` lists are dealt into parts of about that size, and each part
    is joined with itself and with every other, so no task holds a larger company.
    """
    rows = prepared.select("record_id", "variants").join(members, "record_id")
    sizes = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("company_id")
    lists = cut(rows.join(sizes, "company_id").groupBy("company_id", "variants").agg(F.count(F.lit(1)).alias("k")), "variant-lists")
    parts = lists.groupBy("company_id").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n"))
    dealt = lists.join(parts, "company_id").withColumn("_p", F.pmod(F.xxhash64("variants"), F.col("_n")).cast("int"))
    x = dealt.select("company_id", F.col("variants").alias("va"), "k", F.col("_p").alias("_i"), F.explode(F.sequence(F.col("_p"), F.col("_n") - 1)).alias("_j"))
    y = dealt.select("company_id", F.col("variants").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("_p"))).alias("_i"), F.col("_p").alias("_j"))
    # a list on several records meets itself
    pairs = x.join(y, ["company_id", "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col("va") < F.col("vb")) | ((F.col("va") == F.col("vb")) & (F.col("k") > 1)))
    pairs = pairs.select("company_id", F.least("va", "vb").alias("va"), F.greatest("va", "vb").alias("vb"))
    names = pairs.select("va", "vb").distinct().withColumn("s", best_name_udf(spec.generic, spec.slack)(F.col("va"), F.col("vb"))["score"])
    return pairs.join(names, ["va", "vb"]).groupBy("company_id").agg(F.min("s").alias("weakest"))


def open_reviews(scored: DataFrame, members: DataFrame) -> DataFrame:
    """Review pairs whose records ended in different companies."""
    a = members.select(F.col("record_id").alias("a"), F.col("company_id").alias("ca"))
    b = members.select(F.col("record_id").alias("b"), F.col("company_id").alias("cb"))
    return scored.where("decision = 'review'").join(a, "a").join(b, "b").where("ca <> cb").drop("ca", "cb")


def merge_edges(scored: DataFrame, members: DataFrame) -> DataFrame:
    """``company_id, a, b`` of the pairs that were merged."""
    return scored.where("decision = 'merge'").join(members.withColumnRenamed("record_id", "a"), "a").select("company_id", "a", "b")
