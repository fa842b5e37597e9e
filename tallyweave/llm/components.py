"""Connected components of a graph given as pairs.

Every edge partition, as it lies, runs union-find over its own edges and keeps a
spanning forest, at most one edge per node it saw. Forests are merged level by
level: their sizes are counted, forests are packed into bins that stay under a
bound whatever nodes they hold, and each bin is thinned again by one task, until
one forest is left, whose roots are the components. If no two forests fit into one
bin any more, what is left is finished by star contraction, whose steps are joins
and aggregates over all executors, so that no task ever holds more than the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.graph import as_members, contract, oriented, spanning_forest
from tallyweave.session import cut, drop

EDGES_PER_TASK = 400_000
FAN_IN = 16


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's spanning forest, with the partition's number."""
    here = TaskContext.get().partitionId()
    for batch in spanning_forest(batches):
        yield batch.append_column("part", pa.array([here] * batch.num_rows, pa.int32()))


def _merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One forest of all forests of a bin."""
    for batch in spanning_forest(b.select(["u", "v"]) for b in batches):
        yield batch.append_column("part", pa.array([key[0].as_py()] * batch.num_rows, pa.int32()))


def bins(sizes: dict[int, int], most: int) -> dict[int, int]:
    """Forest -> bin: at most ``FAN_IN`` forests and ``most`` edges to a bin, the smallest together."""
    out: dict[int, int] = {}
    held, filled, b = 0, 0, 0
    for part in sorted(sizes, key=lambda p: (sizes[p], p)):
        if filled and (filled == FAN_IN or held + sizes[part] > most):
            b, held, filled = b + 1, 0, 0
        out[part] = b
        held, filled = held + sizes[part], filled + 1
    return out


def components(pairs: DataFrame, a: str, b: str, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``node, root`` for every node in a component of two or more; ``root`` is the smallest node.

    Whole numbers are compared as such, all else as text. Order of the two ends,
    repeated pairs and extra columns make no difference. Pairs with a null end and
    pairs of one node with itself connect nothing. An empty table gives an empty
    result.
    """
    edges = oriented(pairs, a, b)
    kind = edges.schema["u"].dataType.simpleString()
    shape = f"u {kind}, v {kind}, part int"
    forest = cut(edges.mapInArrow(_numbered, shape), "forest")
    while True:
        sizes = {r.part: r["count"] for r in forest.groupBy("part").count().collect()}  # a number per partition
        if len(sizes) < 2:
            return as_members(forest)
        dealt = bins(sizes, edges_per_task)
        if len(set(dealt.values())) == len(sizes):
            done = contract(forest)
            drop(forest)
            return as_members(done)
        table = pairs.sparkSession.createDataFrame(list(dealt.items()), "part int, bin int")
        less = forest.join(F.broadcast(table), "part").select("u", "v", "bin").groupBy("bin").applyInArrow(_merged, shape)
        larger, forest = forest, cut(less, "forest")
        drop(larger)


def latest_decisions(queue: DataFrame) -> DataFrame:
    """One row per unordered pair of two different records: the decision of the highest ``seq``.

    Rows with a null id don't count. A null ``seq`` is older than any other; of rows
    with equal ``seq`` the larger decision text stands.
    """
    sides = queue.where("record_a <> record_b")
    return (
        sides.groupBy(F.least("record_a", "record_b").alias("low"), F.greatest("record_a", "record_b").alias("high"))
        .agg(F.max(F.struct("seq", "decision")).alias("last"))
        .select("low", "high", F.lower(F.trim("last.decision")).alias("decision"))
    )


def merged_groups(queue: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``record_id, group_id`` of all records that merge decisions connect."""
    merged = latest_decisions(queue).where(F.col("decision") == "merge")
    found = components(merged, "low", "high", edges_per_task)
    return found.select(F.col("node").alias("record_id"), F.col("root").alias("group_id"))
