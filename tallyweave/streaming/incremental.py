"""New records linked to what is already there, batch by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators.linkage import blocks, prepare, score_pairs
from tallyweave.session import cut, drop
from tallyweave.spec import Linkage


def linked_batch(new: DataFrame, base: DataFrame, spec: Linkage = Linkage()) -> DataFrame:
    """Scored pairs of new records with known ones and with each other; blocks count both sides."""
    rows = prepare(base.unionByName(new, allowMissingColumns=True), spec).dropDuplicates(["record_id"])
    keyed = blocks(rows, spec)
    fresh = new.select("record_id").distinct()
    sizes = keyed.groupBy("key").count().where(F.col("count").between(2, spec.most_in_block))
    kept = keyed.join(sizes.select("key"), "key", "left_semi")
    mine = kept.join(fresh, "record_id", "left_semi").select("key", F.col("record_id").alias("x"))
    pairs = mine.join(kept.select("key", F.col("record_id").alias("y")), "key").where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return score_pairs(pairs, rows, spec)


def _with_batch(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])


def known_records(spark: SparkSession, base_path: str, added_path: str, before: int | None = None) -> DataFrame:
    """The base table and what batches (those ``before`` one) have added to it."""
    base = spark.read.parquet(base_path)
    try:
        added = spark.read.schema(_with_batch(base)).parquet(added_path)
    except AnalysisException:
        return base  # nothing added yet
    earlier = added if before is None else added.where(F.col("batch") < before)
    return base.unionByName(earlier.drop("batch"))


def link_step(batch: DataFrame, epoch: int, base_path: str, added_path: str, out_path: str, spec: Linkage = Linkage()) -> None:
    """Scores one micro-batch against what earlier batches left, writes its pairs, then its new records.

    Both go to the batch's own folder, and what is new is told by earlier batches
    only, so a batch that is repeated after a failure anywhere replaces itself.
    """
    spark = batch.sparkSession
    base = known_records(spark, base_path, added_path, epoch)
    new = cut(batch.join(base.select("record_id"), "record_id", "left_anti").dropDuplicates(["record_id"]), "new-records")
    linked_batch(new, base, spec).write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")
    new.select(*base.columns).write.mode("overwrite").parquet(f"{added_path}/batch={epoch}")
    drop(new)


def start_linkage(stream: DataFrame, base_path: str, added_path: str, out_path: str, checkpoint: str, spec: Linkage = Linkage()):
    """A query that scores each micro-batch against the known records, writes its pairs and then adds it to them."""

    def step(batch: DataFrame, epoch: int) -> None:
        link_step(batch, epoch, base_path, added_path, out_path, spec)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed_arrivals(stream: DataFrame, window: str = "7 days", late: str = "60 days") -> DataFrame:
    """Records per feed and window of ``observed_at``; rows later than ``late`` are past the watermark."""
    timed = stream.where("observed_at IS NOT NULL").withWatermark("observed_at", late)
    return timed.groupBy(F.window("observed_at", window), "source").agg(F.count(F.lit(1)).alias("n_records"))


def run_to_table(spark: SparkSession, df: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs a stream over what there is; of each key what its last batch said.

    Updates are written to Parquet batch by batch, and state past the watermark is let go.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={epoch}")

    query = df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        updates = spark.read.schema(_with_batch(df)).parquet(f"{folder}/updates")
    except AnalysisException:
        return spark.createDataFrame([], df.schema)
    rest = [c for c in df.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
