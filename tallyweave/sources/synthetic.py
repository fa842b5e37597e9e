"""Generated feeds with labels. Every draw is a hash of (seed, firm, what), so rows don't depend on each other or on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.sources.feeds import ATTRIBUTES, register_adapter, register_checker
from tallyweave.spec import Feed, Spec, SpecError

_ONSETS = ("Bral", "Corv", "Dell", "Ferr", "Gann", "Hask", "Jost", "Kell", "Lorr", "Mest", "Norr", "Pell", "Quar", "Ross", "Stav", "Trell", "Ulm", "Vess", "Wend", "Yarl")
_CODAS = ("moor", "field", "wick", "stead", "ford", "mere", "holt", "gate", "ham", "den", "ley", "shaw", "by", "ness", "croft", "well")
_TRADES = ("Fire Protection", "Fire Alarm", "Fire Sprinkler", "Extinguisher Service", "Life Safety", "Mechanical")
_STATES = ("IL", "IN", "IA", "KS", "MI", "MN", "MO", "NE", "OH", "WI")
_PREFIX = {"business_registry": "REG", "state_license": "LIC", "trade_association": "ASN", "web_listing": "WEB"}
MOST_FIRMS = len(_ONSETS) ** 2 * len(_CODAS) ** 2


def draw(seed: int, *what: Column | str) -> Column:
    """A number in [0, 1) that depends only on seed, firm and the named draw."""
    parts = [F.lit(w) if isinstance(w, str) else w.cast("string") for w in what]
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) / float(1 << 52)


def _choice(u: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def firms(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """``firm`` 0..n-1 with name parts, state, phone, size and listing facts. Names are distinct up to the capacity."""
    if n > MOST_FIRMS:
        raise SpecError(f"at most {MOST_FIRMS} distinct firm names")
    k = F.pmod(F.col("id") * 7919 + F.lit(seed), F.lit(MOST_FIRMS))
    a, b, c_, d = len(_ONSETS), len(_CODAS), len(_ONSETS), len(_CODAS)

    def at(values: tuple[str, ...], index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    first = F.concat(at(_ONSETS, F.pmod(k, F.lit(a))), at(_CODAS, F.pmod(F.floor(k / a), F.lit(b))))
    second = F.concat(at(_ONSETS, F.pmod(F.floor(k / (a * b)), F.lit(c_))), at(_CODAS, F.pmod(F.floor(k / (a * b * c_)), F.lit(d))))
    i = F.col("id")
    size = F.exp(F.lit(2.7) + F.lit(0.8) * F.sqrt(-2 * F.log(draw(seed, i, "s1") + 1e-12)) * F.cos(6.283185307179586 * draw(seed, i, "s2")))
    return spark.range(n).select(
        i.alias("firm"),
        F.concat_ws(" ", first, second).alias("core"),
        _choice(draw(seed, i, "trade"), _TRADES).alias("trade"),
        _choice(draw(seed, i, "state"), _STATES).alias("state"),
        F.concat(F.lit("(217) 555-"), F.lpad(F.floor(draw(seed, i, "phone") * 10000).cast("string"), 4, "0")).alias("phone"),
        F.greatest(F.lit(2.0), F.round(size)).alias("employees"),
    )


def feed_rows(spark: SparkSession, feed: str, seed: int, n: int) -> DataFrame:
    """Records of one feed: about two thirds of the firms, with that feed's damage, and the firm as ``entity_id``."""
    f, who = F.col("firm"), F.lit(feed)
    base = firms(spark, seed, n).where(draw(seed, f, who, "in") < 0.67)
    name = F.concat_ws(" ", "core", "trade")
    cut_at = (F.floor(draw(seed, f, who, "typo_at") * 6) + 3).cast("int")
    typo = F.concat(F.substring(name, F.lit(1), cut_at), F.substring(name, cut_at + 2, F.lit(100)))
    name = F.when(draw(seed, f, who, "typo") < 0.08, typo).otherwise(name)
    name = F.when(draw(seed, f, who, "short") < 0.2, F.regexp_replace(F.regexp_replace(name, "Protection", "Prot."), "Service", "Svc.")).otherwise(name)
    name = F.when(draw(seed, f, who, "form") < 0.4, F.concat(name, F.lit(", Inc."))).otherwise(name)
    name = F.when(F.lit(feed == "business_registry"), F.upper(name)).otherwise(name)
    u = draw(seed, f, who, "facts")
    low = F.floor(F.col("employees") * 0.7).cast("int")
    own = {
        "license_type": F.when(F.lit(feed == "state_license"), F.concat(F.col("trade"), F.lit(" Contractor"))),
        "license_status": F.when(F.lit(feed == "state_license"), F.lit("Active")),
        "employee_band": F.when(u < 0.5, F.concat_ws("-", F.greatest(low, F.lit(1)).cast("string"), F.floor(F.col("employees") * 1.5 + 1).cast("int").cast("string"))),
        "stated_headcount": F.when(u > 0.7, F.col("employees")),
        "services": F.when(F.lit(feed == "web_listing"), F.array(F.lower("trade"))),
        "naics": F.when(F.lit(feed == "business_registry"), F.lit("238220")),
    }
    attributes = F.struct(*[own[x.name].cast(x.dataType).alias(x.name) if x.name in own else F.lit(None).cast(x.dataType).alias(x.name) for x in ATTRIBUTES])
    return base.select(
        F.format_string(f"{_PREFIX.get(feed, 'GEN')}-%06d", f).alias("record_id"),
        who.alias("source"),
        name.alias("name"),
        F.lit(None).cast("string").alias("dba"),
        F.concat(_choice(draw(seed, f, "town"), _ONSETS), F.lit("ville")).alias("city"),
        F.when(draw(seed, f, who, "state") < 0.95, F.col("state")).alias("state"),
        F.lit(None).cast("string").alias("zip"),
        F.when(draw(seed, f, who, "phone") < 0.8, F.col("phone")).alias("phone"),
        F.lit(None).cast("string").alias("website"),
        attributes.alias("attributes"),
        F.format_string("F%06d", f).alias("entity_id"),
    )


def _options(feed: Feed) -> tuple[int, int]:
    return int(feed.options.get("seed", 42)), int(feed.options.get("firms", 60))


def _read(spark: SparkSession, feed: Feed, spec: Spec) -> DataFrame:
    return feed_rows(spark, feed.feed, *_options(feed)).drop("entity_id")


def _labels(spark: SparkSession, feed: Feed) -> DataFrame:
    return feed_rows(spark, feed.feed, *_options(feed)).select("record_id", "entity_id")


def _listings(spark: SparkSession, database: str, seed: int = 42, n: int = 60) -> DataFrame:
    """Larger firms are listed more often: a logistic in the log of their size."""
    f = F.col("firm")
    odds = 1 / (1 + F.exp(-(F.log("employees") - 3.0)))
    rows = firms(spark, seed, n).where(draw(seed, f, database, "listed") < odds)
    return rows.select(F.lit(database).alias("database"), F.format_string(f"{database}-%06d", f).alias("listing_id"), F.concat_ws(" ", "core", "trade").alias("name"), "state")


register_adapter("synthetic", _read, _labels)
register_checker("synthetic", _listings)
