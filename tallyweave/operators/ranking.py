"""Screens, composite scores, ranks and tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.tokens import c
from tallyweave.session import cut
from tallyweave.spec import Ranking


def screens(states: Sequence[str], state: Column | str = "state", tier: Column | str = "fit_tier", adjacent: Column | None = None, residential: Column | None = None, owned: Column | None = None) -> Column:
    """All reasons against a company, in fixed order; an empty array means in scope."""
    s, t, no = c(state), c(tier), F.lit(False)
    outside = ~s.isin(*states) if states else F.lit(False)
    reasons = F.array(
        F.when(F.coalesce(s, F.lit("")) == "", "location_unknown").when(outside, "out_of_geography"),
        F.when(t == "D", F.when(adjacent if adjacent is not None else no, "adjacent_trade").otherwise("no_sector_evidence")),
        F.when(residential if residential is not None else no, "residential_only"),
        F.when(owned if owned is not None else no, "parent_owned"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def evidence(n_sources: Column | str, confidence: Column | str, spec: Ranking = Ranking()) -> Column:
    """Half for the number of sources up to saturation, half for confidence in the size."""
    credit = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in spec.credit.items() for v in kv]), c(confidence)), F.lit(0.0))
    return 0.5 * F.least(F.lit(1.0), c(n_sources) / F.lit(float(spec.sources_for_full))) + 0.5 * credit


def composite(p: Column | str, fit: Column | str, obviousness: Column | str, strength: Column, spec: Ranking = Ranking()) -> Column:
    """Weighted mean of the four parts on a scale of 100; a missing probability counts 0."""
    total = spec.weight_p + spec.weight_fit + spec.weight_hidden + spec.weight_evidence
    parts = spec.weight_p * F.coalesce(c(p), F.lit(0.0)) + spec.weight_fit * c(fit) + spec.weight_hidden * (1 - c(obviousness)) + spec.weight_evidence * strength
    return 100 * parts / total


def global_rank(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """A global 1..n without one task that sorts all rows.

    Rows are range-partitioned in the given order; each partition numbers its own
    and adds the count of those before it (one number per partition on the driver).
    """
    spread = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = {r["_part"]: r["count"] for r in spread.groupBy("_part").count().collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(total)]
        total += sizes[p]
    base = F.element_at(F.create_map(*offsets), F.col("_part")) if offsets else F.lit(0)
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.withColumn(name, (n + base).cast("int")).drop("_part")


def tiers(rank: Column | str, p: Column | str, in_scope: Column, spec: Ranking = Ranking()) -> Column:
    """Priority within the first ranks and from the least probability on, else Watchlist; out of scope Excluded."""
    first = (c(rank) <= spec.first_ranks) & (F.coalesce(c(p), F.lit(0.0)) >= spec.least_p)
    return F.when(~in_scope, "Excluded").when(first, "Priority").otherwise("Watchlist")
