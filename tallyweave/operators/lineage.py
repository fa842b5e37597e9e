"""Claims with their evidence, as rows, and the rules they are held against."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.numbers import short_number
from tallyweave.functions.tokens import c
from tallyweave.spec import LineageError

# Confidence levels from strongest to weakest.
STRENGTH = {"confirmed": 4, "strong": 3, "inferred": 2, "weak": 1, "contradictory": 0}
KINDS = ("observed", "external", "derived")
# The order in which a company's claims are numbered.
ORDER = (
    "name location entity_resolution legal_name website naics_code license services_listed ownership model_in_sector fit_tier adjacent_trade residential_only"
    " segment service_mix size_signal employees_range ebitda_estimate p_ge_min p_in_band presence obviousness screen composite_score"
).split()
ALWAYS = ("name", "location", "entity_resolution", "fit_tier", "segment", "service_mix", "obviousness", "screen")
IF_SIZED = ("employees_range", "ebitda_estimate", "p_in_band")
IF_RANKED = ("composite_score",)


def claim(rows: DataFrame, name: str, value: Column, evidence: Column, confidence: Column, kind: str, source: Column | None = None, records: Column | None = None, depends: Sequence[str] = (), ref: Column | None = None, sub: Column | None = None) -> DataFrame:
    """One claim per row of ``rows`` (with ``company_id``); rows with a null value make none.

    ``depends`` names the claims it rests on; they become ids when the ledger is numbered.
    """
    none = F.lit(None).cast("string")
    return rows.select(
        "company_id",
        F.lit(name).alias("claim"),
        F.lit(ORDER.index(name)).alias("_at"),
        (sub if sub is not None else F.lit("")).alias("_sub"),
        value.cast("string").alias("value"),
        evidence.alias("evidence"),
        (source if source is not None else none).alias("source"),
        confidence.alias("confidence"),
        F.lit(kind).alias("kind"),
        (records if records is not None else F.array().cast("array<string>")).alias("record_ids"),
        F.array(*[F.lit(d) for d in depends]).cast("array<string>").alias("_depends"),
        (ref if ref is not None else none).alias("external_ref"),
    ).where("value IS NOT NULL")


def ledger(claims: Sequence[DataFrame]) -> DataFrame:
    """All claims numbered ``<company>.<nn>`` in fixed order, names of dependencies resolved to all earlier claims of that name."""
    rows = reduce(DataFrame.unionByName, claims)
    w = Window.partitionBy("company_id").orderBy("_at", "_sub")
    rows = rows.withColumn("seq", F.row_number().over(w)).withColumn("claim_id", F.concat("company_id", F.lit("."), F.lpad(F.col("seq").cast("string"), 2, "0")))
    # the claims before each one stand in the window's frame; a company has a few dozen
    before = F.collect_list(F.struct("claim", "claim_id")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    known = rows.withColumn("_all", before)
    earlier = F.flatten(F.transform("_depends", lambda d: F.transform(F.filter("_all", lambda s: s["claim"] == d), lambda s: s["claim_id"])))
    return known.withColumn("depends_on", F.array_sort(F.array_distinct(earlier))).drop("_all", "_at", "_sub", "_depends")


def ceiling(led: DataFrame) -> DataFrame:
    """``claim_id, ceiling``: the most a derived claim may claim: its strongest input; weak if all inputs contradict each other."""
    level = F.create_map(*[F.lit(v) for kv in STRENGTH.items() for v in kv])
    inputs = led.select("company_id", F.col("claim_id").alias("dep"), F.element_at(level, F.col("confidence")).alias("s"))
    edges = led.where("kind = 'derived'").select("company_id", "claim_id", F.explode("depends_on").alias("dep"))
    return edges.join(inputs, ["company_id", "dep"]).groupBy("claim_id").agg(F.greatest(F.max("s"), F.lit(1)).alias("ceiling"))


def capped(led: DataFrame) -> DataFrame:
    """The ledger with derived claims lowered to their ceiling (contradictory ones stay)."""
    level = F.create_map(*[F.lit(v) for kv in STRENGTH.items() for v in kv])
    name = F.create_map(*[F.lit(v) for k, s in STRENGTH.items() for v in (s, k)])
    own = F.element_at(level, F.col("confidence"))
    over = (F.col("kind") == "derived") & (F.col("confidence") != "contradictory") & (own > F.col("ceiling"))
    return led.join(ceiling(led), "claim_id", "left").withColumn("confidence", F.when(over, F.element_at(name, F.col("ceiling"))).otherwise(F.col("confidence"))).drop("ceiling")


def rule_violations(led: DataFrame) -> DataFrame:
    """``claim_id, problem``: claims that break a rule of writing."""
    level = F.create_map(*[F.lit(v) for kv in STRENGTH.items() for v in kv])
    own = F.element_at(level, F.col("confidence"))
    checked = led.join(ceiling(led), "claim_id", "left")
    problems = F.array(
        F.when(own.isNull(), "unknown confidence"),
        F.when(~F.col("kind").isin(*KINDS), "unknown kind"),
        F.when(F.trim(F.coalesce("evidence", F.lit(""))) == "", "no evidence"),
        F.when((F.col("kind") == "observed") & (F.size("record_ids") == 0), "observed without a record"),
        F.when((F.col("kind") == "external") & (F.coalesce("external_ref", F.lit("")) == ""), "external without a reference"),
        F.when((F.col("kind") == "derived") & (F.size("depends_on") == 0), "derived without inputs"),
        F.when((F.col("kind") == "derived") & (F.col("confidence") != "contradictory") & (own > F.col("ceiling")), "stronger than its inputs"),
    )
    return checked.select("claim_id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def required(sized: Column, ranked: Column) -> Column:
    """Names of the claims a company must have."""
    names = F.array(*[F.lit(x) for x in ALWAYS])
    none = F.array().cast("array<string>")
    return F.concat(names, F.when(sized, F.array(*[F.lit(x) for x in IF_SIZED])).otherwise(none), F.when(ranked, F.array(*[F.lit(x) for x in IF_RANKED])).otherwise(none))


def verify(led: DataFrame, companies: DataFrame, members: DataFrame, needs: Column) -> DataFrame:
    """``company_id, problem``: unknown companies, cited records that are not theirs, inputs that are no earlier claim, missing claims. Anti-joins throughout."""
    known = companies.select("company_id")
    lost = led.join(known, "company_id", "left_anti").select("company_id", F.concat(F.lit("unknown company in "), "claim_id").alias("problem"))
    cited = led.select("company_id", "claim_id", F.explode("record_ids").alias("record_id"))
    foreign = cited.join(members, ["company_id", "record_id"], "left_anti").select("company_id", F.concat("claim_id", F.lit(" cites "), "record_id").alias("problem"))
    deps = led.select("company_id", "claim_id", F.col("seq").alias("own"), F.explode("depends_on").alias("dep"))
    earlier = led.select(F.col("claim_id").alias("dep"), F.col("seq").alias("dseq"), F.col("company_id"))
    loose = deps.join(earlier, ["company_id", "dep"], "left").where("dseq IS NULL OR dseq >= own").select("company_id", F.concat("claim_id", F.lit(" rests on "), "dep").alias("problem"))
    have = led.groupBy("company_id").agg(F.collect_set("claim").alias("have"))
    gaps = companies.withColumn("need", needs).join(have, "company_id", "left").select("company_id", F.explode(F.array_except("need", F.coalesce("have", F.array().cast("array<string>")))).alias("m"))
    missing = gaps.select("company_id", F.concat(F.lit("no claim "), "m").alias("problem"))
    return lost.unionByName(foreign).unionByName(loose).unionByName(missing)


def require_clean(problems: DataFrame, shown: int = 20) -> None:
    """Stops a run with the first problems, if there are any."""
    rows = problems.orderBy("company_id", "problem").limit(shown).collect()
    if rows:
        raise LineageError("; ".join(f"{r.company_id}: {r.problem}" for r in rows))


def latest(led: DataFrame, name: str) -> DataFrame:
    """``company_id, claim_id, value`` of the latest claim of a name."""
    return led.where(F.col("claim") == name).groupBy("company_id").agg(F.max(F.struct("seq", "claim_id", "value")).alias("l")).select("company_id", "l.claim_id", "l.value")


def spans(led: DataFrame) -> DataFrame:
    """``company_id, first_claim, last_claim``."""
    return led.groupBy("company_id").agg(F.min(F.struct("seq", "claim_id"))["claim_id"].alias("first_claim"), F.max(F.struct("seq", "claim_id"))["claim_id"].alias("last_claim"))


def rendered(x: Column | str, kind: str) -> Column:
    """Printed form of a value: null empty, booleans yes and no, numbers short, lists and maps joined by semicolons."""
    v = c(x)
    forms: Mapping[str, Column] = {
        "bool": F.when(v, "yes").otherwise("no") if kind == "bool" else v,
        "number": short_number(v) if kind == "number" else v,
        "list": F.array_join(v, "; ") if kind == "list" else v,
        "map": F.array_join(F.transform(F.map_entries(v), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), "; ") if kind == "map" else v,
        "text": v.cast("string") if kind == "text" else v,
    }
    return F.when(v.isNull(), F.lit("")).otherwise(forms[kind])
