"""Spanning forests of edge partitions, and star contraction for what no single task may hold."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, LongType, StringType

from tallyweave.session import cut, drop


def node_type(edges: DataFrame, column: str) -> DataType:
    """Nodes stay whole numbers if they are; everything else is compared as text."""
    return LongType() if isinstance(edges.schema[column].dataType, IntegralType) else StringType()


def _root(parent: dict, x):
    top = x
    while (up := parent[top]) != top:
        top = up
    while (up := parent[x]) != top:
        parent[x] = top
        x = up
    return top


def _numbered_forest(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for whole numbers: every tree hangs under its smallest neighbour until no edge joins two trees."""
    ends = [np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1)]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    u, v = at[: len(ends[0])], at[len(ends[0]) :]
    top = np.arange(len(nodes))
    while len(u):
        high, low = np.maximum(u, v), np.minimum(u, v)
        np.minimum.at(top, high, low)
        while (up := top[top]).tobytes() != top.tobytes():
            top = up
        u, v = top[u], top[v]
        apart = u != v
        u, v = u[apart], v[apart]
    some = np.flatnonzero(top != np.arange(len(nodes)))
    for i in range(0, len(some), 65536):
        part = some[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[top[part]])], ["u", "v"])


def spanning_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over (u, v) of one partition; emits (node, smallest node of its tree) for every other node."""
    parent: dict = {}
    kind = None
    first = next(iter_ := iter(batches), None)
    if first is not None and pa.types.is_int64(first.schema.field(0).type):
        yield from _numbered_forest([first, *iter_])
        return
    for batch in [] if first is None else chain([first], iter_):
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra = _root(parent, a) if a in parent else parent.setdefault(a, a)
            rb = _root(parent, b) if b in parent else parent.setdefault(b, b)
            if ra < rb:
                parent[rb] = ra
            elif rb < ra:
                parent[ra] = rb
    nodes = [x for x, up in parent.items() if x != up]
    for i in range(0, len(nodes), 65536):
        part = nodes[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([_root(parent, x) for x in part], kind)], ["u", "v"])


def oriented(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``u, v`` with u > v of the pairs that connect two different nodes; null ends connect nothing."""
    x, y = (F.col(e).cast(node_type(pairs, e)) for e in (a, b))
    return pairs.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (F.col("u") != F.col("v")))


def contract(edges: DataFrame) -> DataFrame:
    """Large-star and small-star rounds until every node points at its smallest; all steps distributed.

    ``edges`` (u, v) with u > v. Hot nodes only meet aggregates with map-side
    combining and joins that adaptive execution may split. Ends when a round
    changes nothing.
    """
    signature, kept = None, None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u go to u's smallest
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "large-star")
        # small star: u's neighbours below and u itself go to u's smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct(), "small-star")
        drop(large, *([] if kept is None else [kept]))
        kept = edges
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            return edges
        signature = now


def as_members(forest: DataFrame) -> DataFrame:
    """``node, root`` of all nodes, roots included."""
    roots = forest.select(F.col("v").alias("node")).distinct()
    return forest.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def connected(edges: DataFrame, a: str, b: str, edges_per_task: int = 400_000) -> DataFrame:
    """``node, root`` of every node that ``edges`` connects to another; ``root`` is the smallest node.

    Forests of the edge partitions as they lie; if they have at most
    ``edges_per_task`` edges in all, one task joins them, else star contraction does.
    """
    pairs = oriented(edges, a, b)
    shape = ", ".join(f"{c} {pairs.schema['u'].dataType.simpleString()}" for c in ("u", "v"))
    forest = cut(pairs.mapInArrow(spanning_forest, shape), "forest")
    if forest.limit(edges_per_task + 1).count() <= edges_per_task:
        whole = cut(forest.coalesce(1).mapInArrow(spanning_forest, shape), "forest")
    else:
        whole = contract(forest)
    drop(forest)
    return as_members(whole)
