"""Size ranges from several statements, and the log-normal behind a product of ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.numbers import geometric_mean, interval_sigma, lognormal_above, parse_band
from tallyweave.spec import Sizing


def size_signals(records: DataFrame, spec: Sizing = Sizing()) -> DataFrame:
    """``record_id, kind, lo, hi, weight, is_floor, raw``: up to four per record, one projection and an unpivot."""
    a = "attributes"
    band = parse_band(f"{a}.employee_band", spec.open_factor)

    def scaled(kind: str, value: Column, factors: tuple[float, float], least: float, floor: bool) -> Column:
        v = value.cast("double")
        return F.when(
            v >= least,
            F.struct(
                F.lit(kind).alias("kind"),
                (v * factors[0]).alias("lo"),
                (v * factors[1]).alias("hi"),
                F.lit(spec.weights[kind]).alias("weight"),
                F.lit(floor).alias("is_floor"),
                value.cast("string").alias("raw"),
            ),
        )

    banded = F.when(
        band.isNotNull(),
        F.struct(F.lit("band").alias("kind"), band["lo"].alias("lo"), band["hi"].alias("hi"), F.lit(spec.weights["band"]).alias("weight"), F.lit(False).alias("is_floor"), F.col(f"{a}.employee_band").alias("raw")),
    )
    every = F.array(
        banded,
        scaled("headcount", F.col(f"{a}.stated_headcount"), spec.headcount, 1e-9, False),
        scaled("locations", F.col(f"{a}.locations"), spec.per_location, 2, False),
        scaled("technicians", F.col(f"{a}.licensed_technicians"), spec.per_technician, 2, True),
    )
    return records.select("record_id", F.inline(F.filter(every, lambda s: s.isNotNull())))


def pick_signals(signals: DataFrame, group: str, trust: Column) -> DataFrame:
    """One signal per group and kind: the most trusted record, then the smallest id. A single min per kind, no window."""
    fields = ("lo", "hi", "weight", "is_floor", "raw")
    best = signals.groupBy(group, "kind").agg(F.min(F.struct((-trust).alias("t"), "record_id", *fields)).alias("s"))
    return best.select(group, "kind", "s.record_id", *[f"s.{f}" for f in fields])


def size_ranges(picked: DataFrame, group: str, spec: Sizing = Sizing()) -> DataFrame:
    """``group, lo, hi, n_signals, conflict, grade``.

    Ranges that lie apart by more than ``conflict_factor`` give their hull and
    grade low; others their weighted geometric means. A floor above the lower end
    lifts it. Floors alone give their largest.
    """
    ranged = ~F.col("is_floor")
    r = {k: F.when(ranged, F.col(k)) for k in ("lo", "hi")}
    w = F.when(ranged, F.col("weight"))
    told = picked.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_signals"),
        geometric_mean(r["lo"], w).alias("lo_mean"),
        geometric_mean(r["hi"], w).alias("hi_mean"),
        F.min(r["lo"]).alias("lo_min"),
        F.max(r["hi"]).alias("hi_max"),
        (F.max(r["lo"]) > spec.conflict_factor * F.min(r["hi"])).alias("apart"),
        F.max(F.when(~ranged, F.col("lo"))).alias("floor"),
        F.max(F.when(~ranged, F.col("hi"))).alias("floor_hi"),
    )
    conflict = F.coalesce("apart", F.lit(False))
    lo = F.when(conflict, F.col("lo_min")).otherwise(F.coalesce("lo_mean", "floor"))
    hi = F.when(conflict, F.col("hi_max")).otherwise(F.coalesce("hi_mean", "floor_hi"))
    lifted = F.coalesce(F.col("floor") > lo, F.lit(False)) & F.col("lo_min").isNotNull()
    new_lo = F.when(lifted, F.col("floor")).otherwise(lo)
    new_hi = F.when(lifted, F.greatest(hi, spec.floor_spread * F.col("floor"))).otherwise(hi)
    spread = F.log(F.col("hi") / F.col("lo"))
    grade = F.when(F.col("conflict"), "low").when((F.col("n_signals") >= 3) & (spread <= 1.2), "high").when((F.col("n_signals") >= 2) & (spread <= 2.0), "medium").otherwise("low")
    return told.select(group, new_lo.alias("lo"), new_hi.alias("hi"), "n_signals", conflict.alias("conflict")).withColumn("grade", grade)


def product_fit(ranges: Sequence[tuple[Column, Column]], spec: Sizing = Sizing()) -> Column:
    """Struct ``median, sigma, low, high`` of the product of independent ranges.

    With ``endpoints`` the bounds are the exact products of the ends, unless the
    deviation had to be raised to its floor.
    """
    median, low, high = F.lit(1.0), F.lit(1.0), F.lit(1.0)
    total = F.lit(0.0)
    for lo, hi in ranges:
        median, low, high = median * F.sqrt(lo * hi), low * lo, high * hi
        s = F.log(hi / lo) / (2 * spec.z)
        total = total + (s if spec.mode == "endpoints" else s * s)
    raw = total if spec.mode == "endpoints" else F.sqrt(total)
    sigma = F.greatest(raw, F.lit(spec.least_sigma))
    exact = (raw >= spec.least_sigma) if spec.mode == "endpoints" else F.lit(False)
    return F.struct(
        median.alias("median"),
        sigma.alias("sigma"),
        F.when(exact, low).otherwise(median * F.exp(-spec.z * sigma)).alias("low"),
        F.when(exact, high).otherwise(median * F.exp(spec.z * sigma)).alias("high"),
    )


def band_probability(median: Column | str, low: Column | str, high: Column | str, least: float, most: float, spec: Sizing = Sizing()) -> tuple[Column, Column]:
    """Probabilities of exceeding ``least`` and of lying between ``least`` and ``most``, from a central interval."""
    sigma = interval_sigma(low, high, spec.z, spec.least_sigma)
    above = lognormal_above(least, median, sigma)
    return above, above - lognormal_above(most, median, sigma)
