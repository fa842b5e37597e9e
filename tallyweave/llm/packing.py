"""Filling fixed-size containers with texts measured in tokens of a public tokenizer.

1. One pass tokenises every whole text and projects its hashed token counts to a
   few coordinates. Only id, length and coordinates go on, never the text.
2. Means and deviations over all documents scale the coordinates; a Hilbert
   curve through them gives one key per document.
3. Documents are range-sorted by that key and packed along the curve: each
   container takes the first text that waits and those of the next ones that fill
   it best, and is closed then, so it holds neighbours on the curve.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public splitting pattern that belongs to these ranks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 1024
BUCKETS = 512
DIMENSIONS = 4
BITS = 12
WINDOW = 64  # texts that wait at a time
CONTAINERS_PER_TASK = 2_000
MOST_TASKS = 10_000


@lru_cache(maxsize=2)
def encoding(path: str = TOKENIZER):
    """The tokenizer of a ranks file (``base64 rank`` lines)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20240607).standard_normal((BUCKETS, DIMENSIONS))


def _measure(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Token count and projected hashed counts of every text; null and empty texts have no tokens."""
    enc, plane = encoding(path), _projection()
    for batch in batches:
        n = np.zeros(batch.num_rows, dtype=np.int64)
        at = np.zeros((batch.num_rows, DIMENSIONS))
        for i, text in enumerate(batch.column(1).to_pylist()):
            if not text:
                continue
            ids = enc.encode_to_numpy(text, disallowed_special=())
            n[i] = len(ids)
            v = np.log1p(np.bincount((ids * np.uint32(2654435761)) >> np.uint32(23), minlength=BUCKETS))
            at[i] = v @ plane / np.sqrt(v @ v)
        cols = [batch.column(0), pa.array(n), *[pa.array(at[:, d].astype(np.float32)) for d in range(DIMENSIONS)]]
        yield pa.RecordBatch.from_arrays(cols, ["k", "n", *[f"c{d}" for d in range(DIMENSIONS)]])


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of whole-number cells, one row each (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            flip = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ flip)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ flip)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _keyed(batches: Iterable[pa.RecordBatch], mean: list[float], dev: list[float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.stack([batch.column(2 + d).to_numpy(zero_copy_only=False) for d in range(DIMENSIONS)], axis=1)
        scaled = (at - np.array(mean)) / np.array(dev)
        cells = np.clip((scaled + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert_key(cells))], ["k", "n", "h"])


def fullest(sizes: list[int], room: int) -> list[int]:
    """Which of the sizes fill ``room`` best, the first ones preferred; exact, by the sums that each start of the list reaches."""
    below = (2 << room) - 1
    sums = [1]
    for s in sizes:
        sums.append((sums[-1] | sums[-1] << s) & below)
    left, taken = sums[-1].bit_length() - 1, []
    for i in range(len(sizes) - 1, -1, -1):
        if not sums[i] >> left & 1:
            taken.append(i)
            left -= sizes[i]
    return taken[::-1]


def _pack(batches: Iterable[pa.RecordBatch], capacity: int, window: int) -> Iterator[pa.RecordBatch]:
    """Pack one sorted range, a container at a time: the first text that waits, and what fills it best of the next ones along the curve.

    At most ``window`` texts wait, so a container holds neighbours only and is closed before the curve moves on.
    """
    box = TaskContext.get().partitionId() << 32
    key_type = None
    waiting: list[tuple[int, object, int]] = []
    rows: list[tuple[int, object, int, int, int]] = []

    def close() -> None:
        nonlocal box
        chosen = [0] + [i + 1 for i in fullest([n for n, _, _ in waiting[1:]], capacity - waiting[0][0])]
        for i in chosen:
            n, k, piece = waiting[i]
            rows.append((box, k, piece, piece * capacity, n))
        for i in reversed(chosen):
            del waiting[i]
        box += 1

    def packed() -> pa.RecordBatch:
        types = (pa.int64(), key_type, pa.int32(), pa.int64(), pa.int32())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["box", "k", "piece", "at", "n"])
        rows.clear()
        return out

    for batch in batches:
        key_type = batch.schema.field(0).type
        for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            whole, rest = divmod(n, capacity) if n > capacity else (0, n)
            for piece in range(whole):
                rows.append((box, k, piece, piece * capacity, capacity))
                box += 1
            if rest or not whole:
                waiting.append((rest, k, whole))
            if len(waiting) > window:
                close()
        if rows:
            yield packed()
    waiting.sort(key=lambda w: -w[0])  # of the last ones the largest first, as nothing follows to fill up with
    while waiting:
        close()
    if rows:
        yield packed()


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """``container_id, key, piece, first_token, n_tokens``: where each text, or each piece of a longer text, lies.

    Every row of ``docs`` is placed. A text of at most ``capacity`` tokens is one
    piece; a longer one is cut at multiples of ``capacity``, its full pieces fill a
    container each. Null and empty texts are placed with 0 tokens. Repeated rows
    are placed each time; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    coords = ", ".join(f"c{d} float" for d in range(DIMENSIONS))
    measured = cut(rows.mapInArrow(lambda it: _measure(it, tokenizer), f"k {kind}, n bigint, {coords}"), "text-sizes")
    dims = range(DIMENSIONS)
    some = F.col("n") > 0
    stats = measured.agg(
        F.sum("n"),
        *[F.avg(F.when(some, F.col(f"c{d}"))) for d in dims],
        *[F.stddev_pop(F.when(some, F.col(f"c{d}"))) for d in dims],
    ).first()
    total = stats[0] or 0
    mean = [stats[1 + d] or 0.0 for d in dims]
    dev = [stats[1 + DIMENSIONS + d] or 1.0 for d in dims]
    tasks = max(1, min(MOST_TASKS, -(-total // (capacity * CONTAINERS_PER_TASK))))
    keyed = measured.mapInArrow(lambda it: _keyed(it, mean, dev), f"k {kind}, n bigint, h bigint")
    curve = keyed.repartitionByRange(tasks, "h", "k").sortWithinPartitions("h", "k")
    packed = curve.mapInArrow(lambda it: _pack(it, capacity, window), f"box bigint, k {kind}, piece int, at bigint, n int")
    return packed.select(F.col("box").alias("container_id"), F.col("k").alias(key), "piece", F.col("at").alias("first_token"), F.col("n").alias("n_tokens"))
