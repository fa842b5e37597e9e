"""Feeds of raw records: adapters by name, one schema, one union."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.tokens import feed_key
from tallyweave.spec import Feed, Spec, SpecError

ATTRIBUTES = T.StructType(
    [
        T.StructField("naics", T.StringType()),
        T.StructField("license_type", T.StringType()),
        T.StructField("license_status", T.StringType()),
        T.StructField("licensed_technicians", T.IntegerType()),
        T.StructField("employee_band", T.StringType()),
        T.StructField("stated_headcount", T.DoubleType()),
        T.StructField("locations", T.IntegerType()),
        T.StructField("services", T.ArrayType(T.StringType())),
        T.StructField("listing_category", T.StringType()),
        T.StructField("formation_year", T.IntegerType()),
        T.StructField("parent_entity", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
TEXT_FIELDS = ("record_id", "source", "name", "dba", "city", "state", "zip", "phone", "website")
RECORD = T.StructType([*[T.StructField(f, T.StringType()) for f in TEXT_FIELDS], T.StructField("attributes", ATTRIBUTES)])

Adapter = Callable[[SparkSession, Feed, Spec], DataFrame]
_ADAPTERS: dict[str, Adapter] = {}
_CHECKERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_LABELS: dict[str, Callable[[SparkSession, Feed], DataFrame]] = {}


def register_adapter(name: str, read: Adapter, labels: Callable[[SparkSession, Feed], DataFrame] | None = None) -> None:
    """Makes ``read`` available to specs; ``labels`` optionally gives ``record_id, entity_id``."""
    _ADAPTERS[name] = read
    if labels:
        _LABELS[name] = labels


def register_checker(name: str, listings: Callable[[SparkSession, str], DataFrame]) -> None:
    """Makes a source of listings (``database, listing_id, name, state``) available to specs."""
    _CHECKERS[name] = listings


def _known(table: dict, name: str, what: str):
    if name not in table:
        raise SpecError(f"no {what} named {name}; there are: {', '.join(sorted(table)) or 'none'}")
    return table[name]


def conform(df: DataFrame) -> DataFrame:
    """The columns of RECORD in order; absent ones null, extra ones left out."""
    have = set(df.columns)
    if not {"record_id", "name"} <= have:
        raise SpecError("a feed needs record_id and name")
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in RECORD])


def read_feeds(spark: SparkSession, spec: Spec) -> DataFrame:
    """All feeds of a spec in its order, with a global ``pos`` and their feed as ``source``."""
    parts = []
    for i, feed in enumerate(spec.feeds):
        rows = conform(_known(_ADAPTERS, feed.adapter, "adapter")(spark, feed, spec))
        parts.append(rows.withColumn("source", F.lit(feed.feed)).withColumn("_feed", F.lit(i)))
    every = reduce(DataFrame.unionByName, parts)
    # unique, in feed order, without a global sort: the feed in the high bits
    return every.withColumn("pos", (F.col("_feed").cast("bigint") * F.lit(1 << 56)) + F.monotonically_increasing_id()).drop("_feed")


def read_labels(spark: SparkSession, spec: Spec) -> DataFrame | None:
    """Labels of all feeds, or None unless every feed has them."""
    if not all(f.adapter in _LABELS for f in spec.feeds):
        return None
    return reduce(DataFrame.unionByName, [_LABELS[f.adapter](spark, f) for f in spec.feeds])


def read_listings(spark: SparkSession, spec: Spec) -> DataFrame | None:
    parts = [_known(_CHECKERS, d.checker, "checker")(spark, d.database) for d in spec.visibility.databases]
    return reduce(DataFrame.unionByName, parts) if parts else None


def table_adapter(path: str) -> Adapter:
    """Serves each feed from one Parquet table with a ``source`` column, whatever the writing of feed names."""

    def read(spark: SparkSession, feed: Feed, spec: Spec) -> DataFrame:
        return spark.read.parquet(path).where(feed_key("source") == feed.feed).dropDuplicates(["record_id"])

    return read


def licence_csv(spark: SparkSession, path: str) -> DataFrame:
    """A licence register in CSV (``business_name, dba_name, city, state, zip, phone, license_type, license_status``) as records ``LIC-00001`` and on.

    Rows are numbered through all files in reading order: each read split counts its
    own rows, and the counts of the splits before it are added.
    """
    raw = spark.read.option("header", True).csv(path)
    have = set(raw.columns)

    def col(name: str):
        return F.col(name) if name in have else F.lit(None).cast("string")

    # a split's rows have the split's number in the upper bits, so it is counted where it is read
    rows = raw.withColumn("_at", F.monotonically_increasing_id())
    split = F.shiftright("_at", 33)
    sizes = {r._split: r["count"] for r in rows.groupBy(split.alias("_split")).count().collect()}  # a number per split
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    offset = F.element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), split) if before else F.lit(0)
    n = offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in ATTRIBUTES]
    own = {"license_type": col("license_type"), "license_status": col("license_status")}
    attributes = F.struct(*[own[f.name].alias(f.name) if f.name in own else e for f, e in zip(ATTRIBUTES, empty)])
    return rows.select(
        F.format_string("LIC-%05d", n).alias("record_id"), F.lit("state_license").alias("source"), col("business_name").alias("name"), col("dba_name").alias("dba"), col("city").alias("city"), col("state").alias("state"), col("zip").alias("zip"), col("phone").alias("phone"), F.lit(None).cast("string").alias("website"), attributes.alias("attributes")
    )


def decisions(df: DataFrame) -> DataFrame:
    """``record_a, record_b, decision``: merge and reject only, trimmed and lower case; the last of several on one pair stands. Rows with a null side are left out.

    Rows are in the order of ``seq`` where there is one, else in reading order.
    """
    missing = [f for f in ("record_a", "record_b", "decision") if f not in df.columns]
    if missing:
        raise SpecError(f"decisions need {', '.join(missing)}")
    at = F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()
    sides = df.where("record_a IS NOT NULL AND record_b IS NOT NULL")
    rows = sides.select(F.least("record_a", "record_b").alias("record_a"), F.greatest("record_a", "record_b").alias("record_b"), F.lower(F.trim("decision")).alias("decision"), at.alias("at"))
    rows = rows.where("decision IN ('merge', 'reject')")
    return rows.groupBy("record_a", "record_b").agg(F.max(F.struct("at", "decision"))["decision"].alias("decision"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions from a CSV file; one that cannot be read is an error of the settings."""
    try:
        raw = spark.read.option("header", True).csv(path)
        raw.schema  # noqa: B018
    except Exception as e:
        raise SpecError(f"cannot read decisions {path}: {e}") from None
    return decisions(raw)


def feed_names(spec: Spec) -> Sequence[str]:
    return [f.feed for f in spec.feeds]
