"""A whole run: feeds, companies, sector, size, visibility, ranks, lineage."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import entities, grading, lineage, linkage, ranking, sector, sizing, visibility
from tallyweave.session import cut
from tallyweave.sources import sinks
from tallyweave.sources.feeds import read_feeds, read_labels, read_listings
from tallyweave.spec import Spec

TARGET_COLUMNS = ("rank", "tier", "company_id", "display_name", "legal_name", "city", "state", "fit_tier", "segment", "service_mix", "size_lo", "size_hi", "size_grade", "obviousness", "n_sources", "sources", "domain", "composite")
LEDGER_COLUMNS = ("claim_id", "company_id", "claim", "value", "evidence", "source", "confidence", "kind", "record_ids", "depends_on", "external_ref")
REVIEW_COLUMNS = ("a", "b", "name_a", "name_b", "score", "name_score", "reasons", "decision")
RAW_COLUMNS = ("record_id", "source", "name", "dba", "city", "state", "zip", "phone", "website", "attributes")


@dataclass
class Run:
    records: DataFrame
    members: DataFrame
    pairs: DataFrame
    reviews: DataFrame
    companies: DataFrame
    ledger: DataFrame
    funnel: dict
    grades: dict | None


def trust_of(spec: Spec, source: str = "source") -> Column:
    table = [F.lit(v) for f in spec.feeds for v in (f.feed, float(f.trust))]
    return F.coalesce(F.element_at(F.create_map(*table), F.col(source)), F.lit(0.5))


def resolve(records: DataFrame, spec: Spec, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``prepared, pairs, members``: scored pairs and one company per record."""
    prepared = cut(linkage.prepare(entities.unique_ids(records), spec.linkage), "prepared")
    found = linkage.candidate_pairs(linkage.blocks(prepared, spec.linkage), spec.linkage)
    pairs = linkage.score_pairs(found, prepared, spec.linkage)
    if verdicts is not None:
        pairs = linkage.adjudicate(pairs, verdicts, prepared, spec.linkage)
    pairs = cut(pairs, "scored-pairs")
    roots = entities.connected(prepared.select(F.col("record_id").alias("node")), pairs.where("decision = 'merge'"))
    members = cut(entities.company_ids(roots.withColumnRenamed("node", "record_id")), "members")
    return prepared, pairs, members


def _claims(companies: DataFrame, found: DataFrame, spec: Spec) -> DataFrame:
    """The claims of a run, one projection per claim."""
    rank = F.when(F.size("sources") >= 2, "confirmed").otherwise("strong")
    place = F.when(F.col("state").isNull(), "unknown").otherwise(F.concat_ws(", ", "city", "state"))
    ids, feeds = F.col("member_ids"), F.array_join("sources", "; ")
    sized = F.col("size_lo").isNotNull()
    c = lineage.claim

    def said(text: str, value: Column) -> Column:
        return F.concat(F.lit(text), value.cast("string"))

    parts = [
        c(companies, "name", F.col("display_name"), said("named ", F.col("display_name")), rank, "observed", feeds, ids),
        c(companies, "location", place, said("stated as ", place), F.when(F.col("state").isNull(), "weak").otherwise(rank), "observed", feeds, ids),
        c(companies, "entity_resolution", F.concat(F.size("member_ids").cast("string"), F.lit(" record(s) from "), F.size("sources").cast("string"), F.lit(" source(s)")), said("merged: ", F.array_join(F.slice("member_ids", 1, 5), ", ")), F.when(F.col("weakest") < spec.linkage.cohesion_floor, "weak").otherwise("strong"), "observed", feeds, ids),
        c(companies, "legal_name", F.col("legal_name"), said("printed as ", F.col("legal_name")), rank, "observed", feeds, ids),
        c(companies, "website", F.col("domain"), said("host ", F.col("domain")), rank, "observed", feeds, ids),
        c(companies, "naics_code", F.nullif(F.array_join("codes", "; "), F.lit("")), said("codes ", F.array_join("codes", "; ")), F.lit("confirmed"), "observed", feeds, ids),
        c(companies, "services_listed", F.nullif(F.col("service_text"), F.lit("")), said("listed: ", F.col("service_text")), F.lit("strong"), "observed", feeds, ids),
        c(companies, "ownership", F.when(F.col("parent_owned"), "parent-owned"), F.lit("a parent is named"), F.lit("confirmed"), "observed", feeds, ids),
        c(companies, "fit_tier", F.col("fit_tier"), said("evidence gives tier ", F.col("fit_tier")), F.when(F.col("fit_tier") == "A", "strong").when((F.col("fit_tier") == "B") | F.col("adjacent"), "inferred").otherwise("weak"), "derived", depends=("services_listed", "naics_code", "name")),
        c(companies, "adjacent_trade", F.when(F.col("adjacent"), "true"), F.lit("keywords of an adjacent trade only"), F.lit("inferred"), "derived", depends=("services_listed", "name")),
        c(companies, "residential_only", F.when(F.col("residential"), "true"), F.lit("residential wording"), F.lit("inferred"), "derived", depends=("services_listed", "name")),
        c(companies, "segment", F.col("segment"), said("most keywords of ", F.col("segment")), F.when(F.col("segment") == "unknown", "weak").otherwise("inferred"), "derived", depends=("services_listed", "name")),
        c(companies, "service_mix", F.col("service_mix"), said("keyword balance: ", F.col("service_mix")), F.when(F.col("service_mix") == "unknown", "weak").otherwise("inferred"), "derived", depends=("services_listed", "fit_tier")),
        c(companies.where(sized), "employees_range", F.concat_ws("-", F.bround("size_lo", 0).cast("int").cast("string"), F.bround("size_hi", 0).cast("int").cast("string")), F.lit("combined statements of size"), F.when(F.col("conflict"), "contradictory").when(F.col("size_grade") == "high", "strong").when(F.col("size_grade") == "medium", "inferred").otherwise("weak"), "derived", depends=("entity_resolution",)),
        c(companies, "obviousness", F.bround("obviousness", 3).cast("string"), F.lit("weighted share of databases"), F.lit("inferred"), "derived", depends=("presence", "website", "entity_resolution")),
        c(companies, "screen", F.when(F.size("exclusions") == 0, "in scope").otherwise(F.concat(F.lit("excluded: "), F.array_join("exclusions", ", "))), F.lit("screens applied in order"), F.lit("inferred"), "derived", depends=("location", "fit_tier", "residential_only", "ownership")),
        c(companies.where("rank IS NOT NULL"), "composite_score", F.bround("composite", 2).cast("string"), F.lit("weighted parts"), F.lit("inferred"), "derived", depends=("employees_range", "fit_tier", "obviousness", "entity_resolution")),
    ]
    if found is not None:
        hits = F.when(F.col("found"), F.when(F.col("score") >= spec.visibility.confirmed_at, "confirmed").otherwise("strong")).otherwise("inferred")
        parts.append(c(found, "presence", F.when(F.col("found"), "found").otherwise("not found"), said("looked up in ", F.col("database")), hits, "external", F.col("database"), ref=F.coalesce("listing_id", F.concat(F.lit("query: "), "query")), sub=F.col("database")))
    return lineage.capped(lineage.ledger(parts))


def run(spark: SparkSession, spec: Spec, verdicts: DataFrame | None = None) -> Run:
    """Feeds to ranked companies with verified lineage; a claim that does not stand stops the run."""
    records = cut(read_feeds(spark, spec), "records")
    prepared, pairs, members = resolve(records, spec, verdicts)
    trust = trust_of(spec)
    companies = entities.canonical(records, prepared, members, trust, spec.linkage)
    companies = companies.join(sector.company_texts(records, members), "company_id", "left").withColumn("names", F.array_join("variants", " | "))
    companies = sector.classify(companies, spec.sector)
    signals = sizing.size_signals(records, spec.sizing).join(members, "record_id").join(records.select("record_id", "source"), "record_id")
    sizes = sizing.size_ranges(sizing.pick_signals(signals, "company_id", trust), "company_id", spec.sizing)
    sizes = sizes.select("company_id", F.col("lo").alias("size_lo"), F.col("hi").alias("size_hi"), F.col("grade").alias("size_grade"), "conflict")
    companies = companies.join(sizes, "company_id", "left").join(entities.cohesion(prepared, members, spec.linkage), "company_id", "left")
    listings = read_listings(spark, spec)
    companies = cut(companies, "companies")
    found = cut(visibility.lookup(companies, listings, spec.linkage, spec.visibility), "presence") if listings is not None else None
    if found is not None:
        seen = visibility.obviousness(found, companies, F.col("domain").isNotNull(), spec.visibility)
        companies = companies.join(seen, "company_id")
    else:
        companies = companies.withColumn("obviousness", F.lit(0.0)).withColumn("hidden", F.lit(True))
    companies = companies.withColumn("n_sources", F.size("sources")).withColumn("exclusions", ranking.screens(spec.states, "state", "fit_tier", F.col("adjacent"), F.col("residential"), F.col("parent_owned")))
    strength = ranking.evidence("n_sources", "size_grade", spec.ranking)
    companies = companies.withColumn("composite", ranking.composite(F.lit(None).cast("double"), "fit_score", "obviousness", strength, spec.ranking))
    inside = companies.where(F.size("exclusions") == 0)
    ranked = ranking.global_rank(inside.select("company_id", "composite"), [F.col("composite").desc(), F.col("company_id")]).select("company_id", "rank")
    companies = companies.join(ranked, "company_id", "left").withColumn("tier", ranking.tiers("rank", F.lit(1.0), F.size("exclusions") == 0, spec.ranking))
    companies = cut(companies, "ranked-companies")
    ledger = cut(_claims(companies, found, spec), "ledger")
    needs = F.filter(lineage.required(F.lit(False), F.col("rank").isNotNull()), lambda x: x.isNotNull())
    lineage.require_clean(lineage.verify(ledger, companies, members, needs))
    counts = grading.funnel(companies, {"companies": F.lit(True), "in_geography": ~F.arrays_overlap("exclusions", F.array(F.lit("location_unknown"), F.lit("out_of_geography"))), "in_scope": F.size("exclusions") == 0, "sized": F.col("size_lo").isNotNull(), "hidden": F.col("hidden"), "first_tier": F.col("tier") == "Priority"}).first().asDict()
    reviews = entities.open_reviews(pairs, members)
    labels = read_labels(spark, spec)
    grades = None
    if labels is not None:
        grades = grading.pairwise(members.withColumnRenamed("company_id", "group"), labels.withColumnRenamed("entity_id", "group")).first().asDict()
    return Run(records, members, pairs, reviews, companies, ledger, {"records": records.count(), "reviews": reviews.count(), **counts}, grades)


def export(result: Run, spec: Spec, folder: str | Path) -> None:
    """CSV files, a workbook and a Markdown brief with the same rows."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    top = result.companies.where("rank IS NOT NULL").orderBy("rank")
    sinks.write_csv(top, folder / "targets.csv", TARGET_COLUMNS)
    sinks.write_csv(result.ledger.orderBy("company_id", "seq"), folder / "evidence_ledger.csv", LEDGER_COLUMNS)
    sinks.write_csv(result.reviews.withColumn("decision", F.lit("")).orderBy("a", "b"), folder / "review_queue.csv", REVIEW_COLUMNS)
    sinks.write_csv(result.records.orderBy("pos"), folder / "raw_records.csv", RAW_COLUMNS)

    def rows(df: DataFrame, columns: tuple[str, ...]) -> list:
        return [list(r) for r in df.select(*columns).toLocalIterator()]

    facts = [(k, v) for k, v in result.funnel.items()]
    sheets = {
        "about": (("item", "value"), [("run", spec.name), *facts]),
        "targets": (TARGET_COLUMNS, rows(top, TARGET_COLUMNS)),
        "universe": (TARGET_COLUMNS, rows(result.companies.orderBy("company_id"), TARGET_COLUMNS)),
        "evidence_ledger": (LEDGER_COLUMNS, rows(result.ledger.orderBy("company_id", "seq"), LEDGER_COLUMNS)),
        "review_queue": (REVIEW_COLUMNS, rows(result.reviews.orderBy("a", "b"), REVIEW_COLUMNS)),
        "raw_records": (RAW_COLUMNS, rows(result.records.orderBy("pos"), RAW_COLUMNS)),
        "assumptions": (("setting", "value"), [(f"{part}.{k}", str(v)) for part in ("linkage", "sizing", "ranking", "visibility") for k, v in vars(getattr(spec, part)).items()]),
        "qa": (("measure", "value"), list((result.grades or {"grades": "no labels"}).items())),
    }
    sinks.write_workbook(folder / "targets.xlsx", sheets)
    leaders = [r.asDict() for r in top.select(*TARGET_COLUMNS).limit(spec.top_n).collect()]
    (folder / "target_brief.md").write_text(sinks.brief(spec.name, result.funnel, leaders, ("rank", "display_name", "state", "segment", "composite"), [f"{k}: {v}" for k, v in (result.grades or {}).items()]), encoding="utf-8")
