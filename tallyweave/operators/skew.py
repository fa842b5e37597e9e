"""Per-key results that a few heavy keys cannot hold up.

Rows are range-partitioned on the composite (key, order), with boundaries from
sampled quantiles, so a key that holds a third of all rows is split over as many
partitions as its share asks for. Each partition walks its sorted rows once and
emits one partial state per key. Only the first and the last key of a partition
can continue elsewhere; those few boundary states are stitched in order, all
others are final where they stand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import cut, shuffle_width

PART, EDGE = "_part", "_edge"


def _change(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Positions at which any of the columns differs from the row before; 0 is always one."""
    n = batch.num_rows
    diff = np.zeros(n, dtype=bool)
    diff[0] = True
    for name in names:
        codes = batch.column(name).dictionary_encode()
        idx = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        diff[1:] |= idx[1:] != idx[:-1]
    return diff


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], order: str) -> Iterator[pa.RecordBatch]:
    """Partial states of one sorted partition: rows, distinct order values, first and last of them."""
    held: dict | None = None
    first = True

    def pack(rows: list[dict]) -> pa.RecordBatch:
        cols = {k: pa.array([r[k] for r in rows], pa.string()) for k in keys}
        cols |= {
            "n_rows": pa.array([r["n_rows"] for r in rows], pa.int64()),
            "n_distinct": pa.array([r["n_distinct"] for r in rows], pa.int64()),
            "low": pa.array([r["low"] for r in rows], pa.string()),
            "high": pa.array([r["high"] for r in rows], pa.string()),
            EDGE: pa.array([r[EDGE] for r in rows], pa.bool_()),
        }
        return pa.RecordBatch.from_pydict(cols)

    for batch in batches:
        if not batch.num_rows:
            continue
        new_key = _change(batch, keys)
        new_val = _change(batch, [*keys, order])
        starts = np.flatnonzero(new_key)
        ends = np.append(starts[1:], batch.num_rows)
        values = np.add.reduceat(new_val.astype(np.int64), starts)
        take = pa.array(starts)
        key_cols = [batch.column(k).take(take).to_pylist() for k in keys]
        low = batch.column(order).take(take).to_pylist()
        high = batch.column(order).take(pa.array(ends - 1)).to_pylist()
        out: list[dict] = []
        for i, key in enumerate(zip(*key_cols)):
            run = dict(zip(keys, key)) | {"n_rows": int(ends[i] - starts[i]), "n_distinct": int(values[i]), "low": low[i], "high": high[i], EDGE: False}
            if held is not None and all(held[k] == run[k] for k in keys):
                held["n_rows"] += run["n_rows"]
                held["n_distinct"] += run["n_distinct"] - (held["high"] == run["low"])
                held["high"] = run["high"]
            else:
                if held is not None:
                    held[EDGE], first = first, False
                    out.append(held)
                held = run
        if out:
            yield pack(out)
    if held is not None:
        held[EDGE] = True
        yield pack([held])


def balanced_key_counts(df: DataFrame, keys: Sequence[str], order: str, partitions: int | None = None) -> DataFrame:
    """Rows and distinct ``order`` values of every key, whatever the skew.

    Returns ``keys``, ``n_rows``, ``n_distinct``, ``low`` and ``high`` (smallest
    and largest order value). Keys and order are compared as strings. Rows with a
    null key or a null order value count as nothing: they state no member of a
    group. Repeated rows count in ``n_rows`` and once in ``n_distinct``; an empty
    table gives an empty result; columns other than ``keys`` and ``order`` are
    ignored, whatever their names.
    """
    spark = df.sparkSession
    keys = list(keys)
    inner = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).cast("string").alias(a) for k, a in zip(keys, inner)], F.col(order).cast("string").alias("o"))
    rows = rows.dropna(subset=[*inner, "o"])
    width = partitions or shuffle_width(spark)
    spread = rows.repartitionByRange(width, *inner, "o").sortWithinPartitions(*inner, "o")
    schema = ", ".join(f"{a} string" for a in inner) + f", n_rows bigint, n_distinct bigint, low string, high string, {EDGE} boolean"
    states = cut(spread.mapInArrow(lambda it: _runs(it, inner, "o"), schema), "key-states")
    inside = states.where(~F.col(EDGE)).drop(EDGE)
    # At most two boundary states per partition: ordered, neighbours share at most one order value.
    pieces = F.array_sort(F.collect_list(F.struct("low", "high", "n_rows", "n_distinct")))
    start = F.struct(F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("n_distinct"), F.lit(None).cast("string").alias("high"))
    joined = F.aggregate(
        "pieces",
        start,
        lambda a, p: F.struct(
            (a["n_rows"] + p["n_rows"]).alias("n_rows"),
            (a["n_distinct"] + p["n_distinct"] - F.coalesce((a["high"] == p["low"]).cast("bigint"), F.lit(0))).alias("n_distinct"),
            p["high"].alias("high"),
        ),
    )
    edges = (
        states.where(EDGE)
        .groupBy(*inner)
        .agg(pieces.alias("pieces"))
        .withColumn("s", joined)
        .select(*inner, F.col("s.n_rows").alias("n_rows"), F.col("s.n_distinct").alias("n_distinct"), F.element_at("pieces", 1)["low"].alias("low"), F.col("s.high").alias("high"))
    )
    out = inside.unionByName(edges)
    return out.select(*[F.col(a).alias(k) for a, k in zip(inner, keys)], "n_rows", "n_distinct", "low", "high")


def heavy_keys(df: DataFrame, kinds: dict[str, F.Column], member: str, share: float = 0.02) -> DataFrame:
    """``key_kind, key_value`` of the keys standing on at least ``share`` of all distinct members.

    Every row is also counted under one key that holds the whole table, so the
    total comes from the same balanced pass. Null keys and null members don't count.
    """
    total_kind = "*"
    triples = [F.struct(F.lit(kind).alias("key_kind"), key.alias("key_value")) for kind, key in kinds.items()]
    triples.append(F.struct(F.lit(total_kind).alias("key_kind"), F.lit("").alias("key_value")))
    long = df.select(F.col(member).alias("m"), F.explode(F.array(*triples)).alias("k")).select("k.*", "m")
    counts = balanced_key_counts(long, ["key_kind", "key_value"], "m")
    total = counts.where(F.col("key_kind") == total_kind).select("n_distinct").first()
    least = share * (total[0] if total else 0)
    return counts.where((F.col("key_kind") != total_kind) & (F.col("n_distinct") >= F.lit(least))).select("key_kind", "key_value")
