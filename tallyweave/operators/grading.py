"""Counts along a run and grades against labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def funnel(rows: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """One row with the count of each stage, in one pass."""
    return rows.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in stages.items()])


def feed_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"))


def pairwise(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``precision, recall, f1`` over pairs, from a contingency table: no pair is listed.

    ``predicted`` and ``truth`` are ``record_id, group``; ids in both count. Without
    predicted pairs precision is 1, without true pairs recall is 1.
    """
    both = predicted.select("record_id", F.col("group").alias("p")).join(truth.select("record_id", F.col("group").alias("t")), "record_id")
    cells = both.groupBy("p", "t").count()
    pairs = F.col("count") * (F.col("count") - 1) / 2
    tp = cells.agg(F.sum(pairs).alias("tp"))
    pp = cells.groupBy("p").agg(F.sum("count").alias("count")).agg(F.sum(pairs).alias("pp"))
    rp = cells.groupBy("t").agg(F.sum("count").alias("count")).agg(F.sum(pairs).alias("rp"))
    one = F.lit(1).alias("_")
    row = tp.select("tp", one).join(pp.select("pp", one), "_").join(rp.select("rp", one), "_")
    precision = F.when(F.coalesce("pp", F.lit(0.0)) == 0, 1.0).otherwise(F.col("tp") / F.col("pp"))
    recall = F.when(F.coalesce("rp", F.lit(0.0)) == 0, 1.0).otherwise(F.col("tp") / F.col("rp"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return row.select(precision.alias("precision"), recall.alias("recall")).select(F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def majority(members: DataFrame, truth: DataFrame) -> DataFrame:
    """``company_id, entity_id``: the most common entity of each company; of equal ones the one whose record comes first."""
    votes = members.join(truth, "record_id").groupBy("company_id", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first"))
    w = Window.partitionBy("company_id").orderBy(F.col("n").desc(), "first")
    return votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("company_id", "entity_id")


def calibration(rows: DataFrame, p: Column, actual: Column, covered: Column) -> DataFrame:
    """``n, coverage, mean_p, share, brier`` rounded to three decimals; null for no rows."""
    a = actual.cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(covered.cast("double")), 3).alias("coverage"),
        F.round(F.avg(p), 3).alias("mean_p"),
        F.round(F.avg(a), 3).alias("share"),
        F.round(F.avg((p - a) * (p - a)), 3).alias("brier"),
    )


def agreement(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of company and database pairs where found equals listed."""
    both = found.join(truth, ["company_id", "database"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("found") == F.col("listed")).cast("double")), 4).alias("agreement"))


# Marks a graded run must reach.
MARKS = {"precision": 0.95, "recall": 0.90, "coverage": 0.80, "calibration_gap": 0.15, "agreement": 0.90}


def check_marks(values: Mapping[str, float | None]) -> list[tuple[str, float | None, str, bool]]:
    """``name, value, requirement, passed``; a missing value fails; the gap has an upper bound."""
    out = []
    for name, mark in MARKS.items():
        v = values.get(name)
        below = name == "calibration_gap"
        passed = v is not None and (v <= mark if below else v >= mark)
        out.append((name, v, f"{'<=' if below else '>='} {mark:g}", passed))
    return out


def report_allowed(labelled: Mapping[str, bool]) -> bool:
    """Grades are given only if every source supplies labels."""
    return bool(labelled) and all(labelled.values())
