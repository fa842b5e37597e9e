"""Top N rows of every group, for any number of groups and any group size.

1. A histogram of the scores of each group, pre-aggregated where the rows lie.
2. Walking a group's few bins from the top gives the highest bin edge with at
   least N rows on or above it: no row below it can be among the first N.
3. Rows below are dropped where they lie, as long as the thresholds are few enough
   to be sent; what is left is ranked exactly with the tie keys.
   The ranking window carries a per-task limit, so a group whose best score is
   shared by millions of rows still sends N rows of each task to one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.blocking import sendable

BINS_PER_OCTAVE = 64


def score_bin(score: Column) -> Column:
    """A bin number that never falls while the score rises; needs no range and takes infinities."""
    size = F.least(F.log2(F.lit(1.0) + F.abs(score)), F.lit(1100.0))
    return F.floor(F.signum(score) * size * BINS_PER_OCTAVE).cast("int")


def safe_bins(df: DataFrame, groups: Sequence[str], score: str, n: int) -> DataFrame:
    """``groups`` and ``_least``: the highest bin with at least ``n`` rows of the group on or above it.

    A group with fewer than ``n`` rows gets its lowest bin. Null groups are groups of their own.
    """
    bins = df.groupBy(*groups, score_bin(F.col(score)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups).orderBy(F.col("_bin").desc())
    walked = bins.withColumn("_above", F.sum("_n").over(w))
    enough = F.max(F.when(F.col("_above") >= n, F.col("_bin")))
    return walked.groupBy(*groups).agg(F.coalesce(enough, F.min("_bin")).alias("_least"))


def top_n(df: DataFrame, groups: Sequence[str], score: str, ties: Sequence[Column], n: int, place: str = "place") -> DataFrame:
    """The ``n`` rows of each group with the highest score, numbered 1..n in ``place``.

    ``ties`` order equal scores and must make the order total for a repeatable
    result. Rows with a null or NaN score are left out. Groups are compared with
    nulls equal. Repeated rows count each time (deduplicate before if they should
    not). An empty table gives an empty result; other columns are carried along,
    but must not be named ``place``, ``_bin``, ``_n``, ``_above`` or ``_least``.
    """
    clash = {place, "_bin", "_n", "_above", "_least"} & set(df.columns)
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    least = safe_bins(scored, groups, score, n)
    right = sendable(least.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_least"))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    kept = scored.join(right, same & (score_bin(F.col(score)) >= F.col("_least")), "left_semi")
    w = Window.partitionBy(*groups).orderBy(F.col(score).desc(), *ties)
    return kept.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n)
