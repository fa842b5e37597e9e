"""Numeric kernels Spark has no built-in for, and rounding to printed forms."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tallyweave.functions.tokens import c


@pandas_udf(T.DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else math.erf(v)).astype("float64")


def normal_cdf(x: Column | str) -> Column:
    """Standard normal distribution function."""
    return (F.lit(1.0) + erf(c(x) / math.sqrt(2.0))) / 2


def lognormal_above(x: Column | float, median: Column | str, sigma: Column | str) -> Column:
    """Probability that a log-normal value exceeds ``x``."""
    x = F.lit(x) if isinstance(x, (int, float)) else x
    return F.lit(1.0) - normal_cdf((F.log(x) - F.log(c(median))) / c(sigma))


def interval_sigma(low: Column | str, high: Column | str, z: float = 1.96, least: float = 0.15) -> Column:
    """Log standard deviation behind a central interval, with a floor."""
    return F.greatest(F.log(c(high) / c(low)) / (2 * z), F.lit(least))


def geometric_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: weighted geometric mean; exactly the value if all values are equal."""
    v, w = c(value), c(weight)
    return F.when(F.min(v) == F.max(v), F.min(v)).otherwise(F.exp(F.sum(w * F.log(v)) / F.sum(w)))


def parse_band(x: Column | str, open_factor: float = 3.0) -> Column:
    """Struct ``lo, hi`` of ``20-49``, ``10 to 19`` or ``500+``; null unless 0 < lo <= hi."""
    s = F.regexp_replace(F.trim(c(x)), ",", "")
    both = r"^(\d+(?:\.\d+)?)\s*(?:-|–|to)\s*(\d+(?:\.\d+)?)$"
    lo = F.regexp_extract(s, both, 1)
    hi = F.regexp_extract(s, both, 2)
    plus = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)\s*\+$", 1)
    low = F.coalesce(F.nullif(lo, F.lit("")).cast("double"), F.nullif(plus, F.lit("")).cast("double"))
    high = F.coalesce(F.nullif(hi, F.lit("")).cast("double"), F.nullif(plus, F.lit("")).cast("double") * open_factor)
    return F.when((low > 0) & (low <= high), F.struct(low.alias("lo"), high.alias("hi")))


def whole(x: Column | str, digits: int = 0) -> Column:
    """Half-up rounding to whole units (``digits=-3``: thousands)."""
    return F.round(c(x), digits)


def short_number(x: Column | str) -> Column:
    """Grouped whole number from 1,000 on, else four significant digits without closing zeros."""
    v = c(x).cast("double")
    size = F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(v))))
    scaled = F.bround(v * F.pow(F.lit(10.0), 3 - size)) / F.pow(F.lit(10.0), 3 - size)
    plain = F.regexp_replace(F.regexp_replace(scaled.cast("decimal(30,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.abs(v) >= 1000, F.format_number(F.bround(v), 0)).otherwise(plain)
