"""Pairs inside blocks whose size is bounded, with an exact way for the blocks beyond."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import cut, shuffle_width

MOST_IN_BLOCK = 200
BUCKETS_PER_TASK = 16_384
BROADCAST_BYTES = 4 << 20


def sendable(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, written once, with a broadcast hint if its rows take at most ``most`` bytes; beyond, Spark shuffles it."""
    kept = cut(df, "small-side")
    wide = sum(f.dataType.defaultSize() if hasattr(f.dataType, "defaultSize") else 32 if f.dataType.typeName() in ("string", "struct", "array") else 8 for f in df.schema.fields)
    rows = most // max(8, wide)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def heavy(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``key``: values on more than ``most`` rows.

    Rows are first counted by hash bucket, which costs a small number per bucket
    whatever the number of keys. Only rows of buckets with more than ``most`` rows
    are then counted by key.
    """
    n = shuffle_width(rows.sparkSession) * BUCKETS_PER_TASK
    bucket = F.pmod(F.xxhash64(key), F.lit(n))
    full = rows.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_b")
    suspects = rows.select(key, bucket.alias("_b")).join(sendable(full), "_b", "left_semi")
    return suspects.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(key)


def bounded_pairs(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Every pair of a block once; ``rows`` holds only blocks of bounded size, and the first of ``fields`` once in each.

    The rows meet themselves in a join, whose two sides share one shuffle; lists of the
    rows of each key would be sorted and copied before the shuffle as well.
    """
    one, two = (rows.select(F.col(key).alias("_k"), F.struct(*fields).alias(e)) for e in "ab")
    return one.join(two, "_k").where(F.col(f"a.{fields[0]}") < F.col(f"b.{fields[0]}")).select("a", "b")


def whole_pairs(rows: DataFrame, key: str, fields: Sequence[str], most: int = MOST_IN_BLOCK) -> DataFrame:
    """``a, b`` structs of ``fields`` for every pair of rows with the same ``key``; the first field orders the two.

    Blocks of more than ``most`` rows are dealt into parts of about that size, and
    each part is joined with itself and with every other, so that no task holds a
    larger block and no pair is left out. Null keys give none.
    """
    some = rows.where(F.col(key).isNotNull())
    big = sendable(heavy(some, key, most))
    pairs = bounded_pairs(some.join(big, key, "left_anti"), key, fields)
    large = cut(some.join(big, key, "left_semi").select(F.col(key).alias("_k"), F.struct(*fields).alias("_r")), "large-blocks")
    sizes = sendable(large.groupBy("_k").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n")))
    dealt = large.join(sizes, "_k").withColumn("_p", F.pmod(F.xxhash64(f"_r.{fields[0]}"), F.col("_n")).cast("int"))
    one = dealt.select("_k", F.col("_r").alias("a"), F.col("_p").alias("_i"), F.explode(F.sequence(F.col("_p"), F.col("_n") - 1)).alias("_j"))
    two = dealt.select("_k", F.col("_r").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_p"))).alias("_i"), F.col("_p").alias("_j"))
    met = one.join(two, ["_k", "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col(f"a.{fields[0]}") < F.col(f"b.{fields[0]}")))
    return pairs.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def parted_pairs(rows: DataFrame, key: str, part: Sequence[str], fields: Sequence[str], most: int = MOST_IN_BLOCK, fits: str = "true", frequent: DataFrame | None = None) -> DataFrame:
    """``a, b`` structs of ``fields`` for pairs of rows with the same ``key``; ``part`` and the first of ``fields`` are columns.

    Keys of at most ``most`` rows give every pair. The rows of others give every pair
    within the same ``part`` values (null being a value), and one row of each such part
    meets those of all other parts of the key that it ``fits``. ``frequent`` are the keys of more than ``most`` rows if they are known.
    """
    some = rows.where(F.col(key).isNotNull())
    frequent = sendable(heavy(some, key, most)) if frequent is None else frequent
    rare = bounded_pairs(some.join(frequent, key, "left_anti"), key, fields)
    if not frequent.take(1):
        return rare
    often = some.join(frequent, key, "left_semi").withColumn("_part", F.concat_ws("|", key, *[F.coalesce(F.col(p).cast("string"), F.lit("?")) for p in part]))
    heads = often.groupBy(key, *part).agg(F.min(F.struct(*fields)).alias("_r")).select(key, F.col("_r"))
    met = whole_pairs(heads.select(F.col(key).alias("_of"), "_r.*"), "_of", fields, most)
    return rare.unionByName(whole_pairs(often, "_part", fields, most)).unionByName(met.where(fits))


def block_pairs(rows: DataFrame, key: str, fields: Sequence[str], finer: Column | None = None, most: int = MOST_IN_BLOCK) -> DataFrame:
    """``a, b`` structs of ``fields`` for pairs of rows with the same ``key``; the first field orders the two.

    Blocks of at most ``most`` rows give all pairs, after a single shuffle. With
    ``finer``, the rows of a larger block are paired within the same ``finer``
    value: all pairs while that part is bounded, else each row with the part's
    first row, which links the part as one. Without ``finer``, a key on more rows
    than ``most`` is no evidence and gives none. Null keys give none.
    """
    some = rows.where(F.col(key).isNotNull())
    big = sendable(heavy(some, key, most))
    pairs = bounded_pairs(some.join(big, key, "left_anti"), key, fields)
    if finer is None:
        return pairs
    rest = some.join(big, key, "left_semi").withColumn("_k2", F.concat_ws("\x1f", F.col(key), finer))
    parts = sendable(heavy(rest, "_k2", most))
    pairs = pairs.unionByName(bounded_pairs(rest.join(parts, "_k2", "left_anti"), "_k2", fields))
    large = rest.join(parts, "_k2", "left_semi")
    heads = large.groupBy("_k2").agg(F.min(F.struct(*fields)).alias("a"))
    star = large.select("_k2", F.struct(*fields).alias("b")).join(heads, "_k2").where(F.col(f"a.{fields[0]}") < F.col(f"b.{fields[0]}"))
    return pairs.unionByName(star.select("a", "b"))
