"""Queries of the linkage, ranking, grading and lineage operators, and their SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import names, numbers
from tallyweave.functions.similarity import best_name_udf, token_ratios
from tallyweave.functions.tokens import feed_key
from tallyweave.operators import entities, grading, lineage, linkage, ranking, sector, sizing, visibility
from tallyweave.session import cut
from tallyweave.sources.feeds import decisions
from tallyweave.spec import demo_spec
from tallyweave.streaming.incremental import feed_arrivals, run_to_table

SPEC = demo_spec()
TRUST = {"business_registry": 0.9, "state_license": 0.85, "trade_association": 0.7, "web_listing": 0.6, "insurer_roll": 0.7, "permit_desk": 0.6}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once: redelivered rows have the same content, the first position stands."""
    r = read(spark, sf_dir, "records")
    return r.drop("pos", "loaded_at").dropDuplicates(["record_id"]).join(r.groupBy("record_id").agg(F.min("pos").alias("pos")), "record_id")


def trust() -> F.Column:
    table = F.create_map(*[F.lit(v) for kv in TRUST.items() for v in kv])
    return F.coalesce(F.element_at(table, feed_key("source")), F.lit(0.5))


def companies_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``record_id, company_id`` by the reviewers' latest merge decisions, and all ids."""
    ids = read(spark, sf_dir, "records").select(F.col("record_id").alias("node")).distinct()
    merged = decisions(read(spark, sf_dir, "review_queue")).where("decision = 'merge' AND record_a <> record_b")
    roots = entities.connected(ids, merged.select(F.col("record_a").alias("a"), F.col("record_b").alias("b")))
    return entities.company_ids(roots.withColumnRenamed("node", "record_id")), ids


def normalized_names(spark, sf_dir):
    r = read(spark, sf_dir, "records")
    return r.select("pos", names.normalize_name("name").alias("norm"), F.array_join(names.distinctive_tokens(names.normalize_name("name"), SPEC.linkage.generic), " ").alias("distinctive"))


def name_parts(spark, sf_dir):
    r = read(spark, sf_dir, "records")
    parts = names.split_alias("name")
    return r.select("pos", parts["legal"].alias("legal"), parts["alias"].alias("alias"), names.operating_name("name", "dba").alias("operating"), F.array_join(names.name_variants("name", "dba"), "|").alias("variants"))


def display_names(spark, sf_dir):
    r = read(spark, sf_dir, "records")
    return r.select("pos", names.display_name("name").alias("tidy"), names.display_name("name", True).alias("short"), names.has_legal_form("name").alias("has_form"))


def contact_keys(spark, sf_dir):
    r = read(spark, sf_dir, "records")
    return r.select("pos", names.nanp_phone("phone").alias("phone"), names.site_domain("website").alias("domain"), names.zip_five("zip").alias("zip5"), F.nullif(F.upper(F.trim("state")), F.lit("")).alias("state"))


def _keyed(spark, sf_dir):
    return linkage.blocks(linkage.prepare(records(spark, sf_dir), SPEC.linkage), SPEC.linkage)


def block_sizes(spark, sf_dir):
    return linkage.block_sizes(_keyed(spark, sf_dir)).withColumn("oversized", F.col("n_records") > SPEC.linkage.most_in_block)


def contact_pairs(spark, sf_dir):
    """Candidate pairs by line and site alone."""
    keyed = _keyed(spark, sf_dir).where("key LIKE 'phone:%' OR key LIKE 'web:%'")
    return linkage.candidate_pairs(keyed, SPEC.linkage)


def candidate_pairs(spark, sf_dir):
    return linkage.candidate_pairs(_keyed(spark, sf_dir), SPEC.linkage)


def pair_order(spark, sf_dir):
    """Pairs of common lines and sites with their place in block-creation order."""
    return _ordered(_keyed(spark, sf_dir).where("key LIKE 'phone:%' OR key LIKE 'web:%'"))


def pair_order_all(spark, sf_dir):
    """Pairs of all block keys with their place in block-creation order."""
    return _ordered(_keyed(spark, sf_dir))


def _ordered(keyed):
    return linkage.candidate_pairs(keyed, SPEC.linkage, True).select("a", "b", F.col("at.born.pos").alias("block_pos"), F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))


def _scored(spark, sf_dir):
    prepared = cut(linkage.prepare(records(spark, sf_dir), SPEC.linkage), "prepared")
    keyed = linkage.blocks(prepared, SPEC.linkage)
    return prepared, linkage.score_pairs(linkage.candidate_pairs(keyed, SPEC.linkage), prepared, SPEC.linkage)


def pair_scores(spark, sf_dir):
    return _scored(spark, sf_dir)[1].select("a", "b", "score", "name_score", F.array_join("reasons", "; ").alias("reasons"), "decision")


def adjudicated_pairs(spark, sf_dir):
    prepared, scored = _scored(spark, sf_dir)
    out = linkage.adjudicate(cut(scored, "scored-pairs"), decisions(read(spark, sf_dir, "review_queue")), prepared, SPEC.linkage)
    return out.select("a", "b", "score", "decision", F.array_join("reasons", "; ").alias("reasons"))


def _queue_names(spark, sf_dir):
    q = read(spark, sf_dir, "review_queue")
    return q.select("seq", names.normalize_name("name_a").alias("na"), names.normalize_name("name_b").alias("nb"))


def review_token_sort(spark, sf_dir):
    q = _queue_names(spark, sf_dir)
    return q.select("seq", F.round(token_ratios(F.col("na"), F.col("nb"))["sort"], 6).alias("ratio"))


def review_name_scores(spark, sf_dir):
    q = _queue_names(spark, sf_dir)
    s = best_name_udf(SPEC.linkage.generic, SPEC.linkage.slack)(F.array("na"), F.array("nb"))["score"]
    return q.select("seq", F.round(s, 6).alias("score"))


def latest_decisions(spark, sf_dir):
    return decisions(read(spark, sf_dir, "review_queue"))


def merge_clusters(spark, sf_dir):
    members, _ = companies_of(spark, sf_dir)
    return members.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_members"), F.min("record_id").alias("first_member"), F.max("record_id").alias("last_member"))


def cluster_votes(spark, sf_dir):
    members, _ = companies_of(spark, sf_dir)
    rows = records(spark, sf_dir).join(members, "record_id").select("company_id", "record_id", F.nullif(F.upper(F.trim("state")), F.lit("")).alias("state"), names.nanp_phone("phone").alias("phone"), trust().alias("trust"))
    order = F.struct((-F.col("trust")).alias("t"), F.col("record_id").alias("id"))
    state = entities.weighted_vote(rows, "company_id", "state", F.col("trust"), order)
    phone = entities.weighted_vote(rows, "company_id", "phone", F.col("trust"), order)
    return state.join(phone, "company_id", "full")


def company_cards(spark, sf_dir):
    members, _ = companies_of(spark, sf_dir)
    r = records(spark, sf_dir)
    c = entities.canonical(r, linkage.prepare(r, SPEC.linkage), members, trust(), SPEC.linkage)
    return c.select("company_id", "display_name", "legal_name", "city", "state", "zip", "phone", "domain", F.size("member_ids").alias("n_members"), F.array_join("sources", "; ").alias("sources"))


def cohesion(spark, sf_dir):
    members, _ = companies_of(spark, sf_dir)
    return entities.cohesion(linkage.prepare(records(spark, sf_dir), SPEC.linkage), members, SPEC.linkage).select("company_id", F.round("weakest", 6).alias("weakest"), (F.col("weakest") < SPEC.linkage.cohesion_floor).alias("flagged"))


def open_reviews(spark, sf_dir):
    """Pairs of the queue without a verdict whose records are in different companies."""
    members, _ = companies_of(spark, sf_dir)
    q = read(spark, sf_dir, "review_queue").where("decision IS NULL OR trim(decision) = ''").select(F.col("record_a").alias("a"), F.col("record_b").alias("b"), "seq", F.lit("review").alias("decision"))
    return entities.open_reviews(q, members).select("seq", "a", "b")


def keyword_hits(spark, sf_dir):
    t = sector.evidence_texts(read(spark, sf_dir, "records"))
    return t.select("pos", "field", F.array_join(sector.find_keywords("text", SPEC.sector.include), "; ").alias("hits"))


def document_keywords(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    every = (*SPEC.sector.include, *SPEC.sector.adjacent)
    return d.select("doc_id", F.array_join(sector.find_keywords("text", every), "; ").alias("hits"))


def sector_fit(spark, sf_dir):
    members, _ = companies_of(spark, sf_dir)
    r = records(spark, sf_dir)
    prepared = linkage.prepare(r, SPEC.linkage)
    named = prepared.join(members, "record_id").groupBy("company_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))), " | ").alias("names"))
    c = sector.classify(sector.company_texts(r, members).join(named, "company_id"), SPEC.sector)
    return c.select("company_id", "fit_tier", "fit_score", "segment", "service_mix", "adjacent", "residential", "parent_owned")


def record_mix(spark, sf_dir):
    """Segment and service mix of each row's own services."""
    r = read(spark, sf_dir, "records")
    text = F.lower(F.coalesce(F.array_join("attributes.services", "; "), F.lit("")))
    return r.select("pos", sector.segment(text, F.lit(""), SPEC.sector).alias("segment"), sector.service_mix(text, SPEC.sector).alias("service_mix"))


def _signals(spark, sf_dir):
    return sizing.size_signals(records(spark, sf_dir), SPEC.sizing)


def size_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("record_id", "kind", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "weight", "is_floor")


def _picked(spark, sf_dir):
    members, _ = companies_of(spark, sf_dir)
    s = _signals(spark, sf_dir).join(members, "record_id").join(records(spark, sf_dir).select("record_id", "source"), "record_id")
    return sizing.pick_signals(s, "company_id", trust())


def picked_signals(spark, sf_dir):
    return _picked(spark, sf_dir).select("company_id", "kind", "record_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def size_ranges(spark, sf_dir):
    return sizing.size_ranges(_picked(spark, sf_dir), "company_id", SPEC.sizing).select("company_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n_signals", "conflict", "grade")


def lognormal_band(spark, sf_dir):
    t = read(spark, sf_dir, "targets").where("ebitda_95_low > 0 AND ebitda_95_high > ebitda_95_low AND ebitda_median > 0")
    above, inside = sizing.band_probability("ebitda_median", "ebitda_95_low", "ebitda_95_high", 1e6, 5e6, SPEC.sizing)
    return t.select("target_id", F.round(above, 6).alias("p_above"), F.round(inside, 6).alias("p_inside"))


def product_fit(spark, sf_dir):
    """Log-normal of employees times price range, per part."""
    p = read(spark, sf_dir, "part")
    fit = sizing.product_fit([(F.col("p_size").cast("double"), F.col("p_size") + 10.0), (F.col("p_retailprice") * 0.9, F.col("p_retailprice") * 1.2)], SPEC.sizing)
    return p.select("p_partkey", fit.alias("f")).select("p_partkey", *[F.round(f"f.{k}", 5).alias(k) for k in ("median", "sigma", "low", "high")])


def money_rounding(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", numbers.whole("o_totalprice").alias("dollars"), numbers.whole("o_totalprice", -3).alias("thousands"))


def presence_lookup(spark, sf_dir):
    members, _ = companies_of(spark, sf_dir)
    r = records(spark, sf_dir)
    prepared = linkage.prepare(r, SPEC.linkage)
    cards = entities.canonical(r, prepared, members, trust(), SPEC.linkage)
    listed = r.where(feed_key("source").isin("permit_desk", "insurer_roll", "tip_sheet")).select(feed_key("source").alias("database"), F.col("record_id").alias("listing_id"), "name", "state")
    found = visibility.lookup(cards, listed, SPEC.linkage, SPEC.visibility)
    return found.select("company_id", "database", "found", "score", "listing_id", "query")


def _listed_in(spark, sf_dir):
    """Which scorings name a feed that serves as listing database."""
    t = read(spark, sf_dir, "targets").dropDuplicates(["target_id"])
    feeds = F.transform(F.split(F.coalesce("sources", F.lit("")), ";"), feed_key)
    grid = t.select(F.col("target_id").alias("company_id"), F.explode(F.array(*[F.lit(d.database) for d in SPEC.visibility.databases])).alias("database"), feeds.alias("feeds"), "website")
    return t, grid.select("company_id", "database", F.array_contains("feeds", F.col("database")).alias("found"))


def obviousness(spark, sf_dir):
    t, found = _listed_in(spark, sf_dir)
    rows = t.select(F.col("target_id").alias("company_id"), "website")
    return visibility.obviousness(found, rows, F.col("website").isNotNull(), SPEC.visibility).select("company_id", F.round("obviousness", 6).alias("obviousness"), "hidden")


def presence_agreement(spark, sf_dir):
    t, found = _listed_in(spark, sf_dir)
    truth = found.select("company_id", "database").join(t.select(F.col("target_id").alias("company_id"), (F.col("n_sources") >= 2).alias("listed")), "company_id")
    return grading.agreement(found, truth)


def _targets(spark, sf_dir):
    t = read(spark, sf_dir, "targets").dropDuplicates(["target_id"])
    reasons = ranking.screens(SPEC.states, F.upper(F.trim("state")), "fit_tier")
    strength = ranking.evidence("n_sources", "size_confidence", SPEC.ranking)
    fit = F.element_at(F.create_map(*[F.lit(v) for kv in SPEC.sector.fit.items() for v in kv]), F.col("fit_tier"))
    score = ranking.composite("p_ebitda_in_band", F.coalesce(fit, F.lit(0.0)), F.coalesce("obviousness", F.lit(0.0)), strength, SPEC.ranking)
    return t.select("target_id", "thesis_id", "state", "fit_tier", F.col("p_ebitda_in_band").alias("p"), "ebitda_median", "ebitda_95_low", "ebitda_95_high", F.array_join(reasons, ";").alias("reasons"), F.round(score, 9).alias("score"))


def screens(spark, sf_dir):
    return _targets(spark, sf_dir).select("target_id", "reasons")


def composite_rank(spark, sf_dir):
    inside = _targets(spark, sf_dir).where("reasons = ''").select("target_id", "score", "p")
    ranked = ranking.global_rank(inside, [F.col("score").desc(), F.col("target_id")])
    return ranked.select("target_id", F.round("score", 6).alias("score"), "rank", ranking.tiers("rank", "p", F.lit(True), SPEC.ranking).alias("tier"))


def leaders(spark, sf_dir):
    """The first rows of the brief."""
    return composite_rank(spark, sf_dir).orderBy("rank").limit(SPEC.top_n)


def funnel(spark, sf_dir):
    t = _targets(spark, sf_dir)
    stages = {
        "n_targets": F.lit(True),
        "in_geography": ~F.col("reasons").contains("location") & ~F.col("reasons").contains("geography"),
        "in_scope": F.col("reasons") == "",
        "sized": (F.col("reasons") == "") & F.col("p").isNotNull(),
        "likely": (F.col("reasons") == "") & (F.col("p") >= 0.5),
    }
    return grading.funnel(t, stages)


def feed_counts(spark, sf_dir):
    return grading.feed_counts(read(spark, sf_dir, "records").withColumn("source", feed_key("source")))


def _site_truth(spark, sf_dir):
    return read(spark, sf_dir, "records").select("record_id", names.site_domain("website").alias("group")).dropna().distinct()


def pairwise_grade(spark, sf_dir):
    """Reviewers' companies graded against common sites."""
    members, _ = companies_of(spark, sf_dir)
    return grading.pairwise(members.withColumnRenamed("company_id", "group"), _site_truth(spark, sf_dir))


def majority_site(spark, sf_dir):
    members, _ = companies_of(spark, sf_dir)
    return grading.majority(members, _site_truth(spark, sf_dir).withColumnRenamed("group", "entity_id"))


def calibration(spark, sf_dir):
    t = _targets(spark, sf_dir).where("p IS NOT NULL AND ebitda_median IS NOT NULL")
    inside = F.col("ebitda_median").between(1e6, 5e6)
    covered = F.col("ebitda_median").between(F.col("ebitda_95_low"), F.col("ebitda_95_high"))
    return grading.calibration(t, F.col("p"), inside, covered)


def _ledger(spark, sf_dir):
    members, _ = companies_of(spark, sf_dir)
    r = records(spark, sf_dir).join(members, "record_id").withColumn("feed", feed_key("source"))
    c = r.groupBy("company_id").agg(
        F.array_sort(F.collect_list("record_id")).alias("ids"), F.array_sort(F.collect_set("feed")).alias("feeds"), F.min(F.nullif(F.trim("name"), F.lit(""))).alias("name"), F.min(F.nullif(F.upper(F.trim("state")), F.lit(""))).alias("state")
    )
    conf = F.when(F.size("feeds") >= 2, "confirmed").otherwise("strong")
    src = F.array_join("feeds", "; ")
    claims = [
        lineage.claim(c, "name", F.col("name"), F.concat(F.lit("printed as "), "name"), conf, "observed", src, F.col("ids")),
        lineage.claim(c, "location", F.coalesce("state", F.lit("unknown")), F.lit("as stated"), F.when(F.col("state").isNull(), "weak").otherwise(conf), "observed", src, F.col("ids")),
        lineage.claim(c, "entity_resolution", F.size("ids").cast("string"), F.lit("merged records"), F.lit("strong"), "observed", src, F.col("ids")),
        lineage.claim(c, "screen", F.when(F.col("state").isNull(), "excluded: location_unknown").otherwise("in scope"), F.lit("screens"), F.lit("inferred"), "derived", depends=("location",)),
    ]
    return lineage.ledger(claims), c, members


def ledger_rows(spark, sf_dir):
    led, _, _ = _ledger(spark, sf_dir)
    return lineage.capped(led).select("claim_id", "claim", "value", "confidence", F.size("record_ids").alias("n_records"), F.array_join("depends_on", ";").alias("depends_on"))


def ledger_violations(spark, sf_dir):
    """Claims stronger than what they rest on, before they are capped."""
    return lineage.rule_violations(_ledger(spark, sf_dir)[0])


def ledger_gaps(spark, sf_dir):
    led, companies, members = _ledger(spark, sf_dir)
    return lineage.verify(led, companies, members, F.array(F.lit("name"), F.lit("location"), F.lit("legal_name"))).groupBy("problem").count().where("problem LIKE 'no claim%'").withColumnRenamed("count", "n_companies")


def ledger_spans(spark, sf_dir):
    return lineage.spans(_ledger(spark, sf_dir)[0])


def arrivals_stream(spark, sf_dir):
    """Records per feed and week, run as a stream over the table."""
    schema = read(spark, sf_dir, "records").schema
    path = f"{sf_dir}/records.parquet"
    import os

    source = path if os.path.isdir(path) else f"{sf_dir}/records.parq[u]et"
    stream = spark.readStream.schema(schema).parquet(source).withColumn("source", feed_key("source")).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    from tallyweave.session import shared_dir

    out = run_to_table(spark, feed_arrivals(stream), ["window", "source"], f"{shared_dir(spark)}/stream-{next(tempfile._get_candidate_names())}")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("week"), "source", "n_records")


QUERIES = {
    f.__name__: f
    for f in (
        normalized_names, name_parts, display_names, contact_keys, block_sizes, contact_pairs, candidate_pairs, pair_order, pair_order_all, pair_scores, adjudicated_pairs, review_token_sort, review_name_scores,
        latest_decisions, merge_clusters, cluster_votes, company_cards, cohesion, open_reviews, keyword_hits, document_keywords, sector_fit, record_mix, size_signals, picked_signals, size_ranges,
        lognormal_band, product_fit, money_rounding, presence_lookup, obviousness, presence_agreement, screens, composite_rank, leaders, funnel, feed_counts, pairwise_grade, majority_site,
        calibration, ledger_rows, ledger_violations, ledger_gaps, ledger_spans, arrivals_stream,
    )
}
