"""Held-out items that stand, whole or in part, in a corpus.

A prefix-filtered set join of item windows with documents, on word shingles:

1. One scan turns each document into word numbers of the items' vocabulary and
   keeps the documents with any item shingle. Layout, case, punctuation and
   mark-up are gone by then.
2. Document frequencies of the item shingles order them by rarity. A passage of
   ``window`` words with ``edits`` words altered or added still has
   ``window - shingle + 1 - shingle * edits`` of its shingles, so at least one of
   the correspondingly many rarest shingles of some item window must be in the
   document: only those prefixes are joined.
3. Hits give diagonals (positional bound); texts and items under the length bound
   are left out; an item-sized window of the document round each diagonal is
   aligned exactly with the item.

The items are a bounded test set. They are taken in blocks of at most
``chars_per_block`` characters, each block's index broadcast by itself; the size is
counted before anything is collected, so more items mean more blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.pii import fold
from tallyweave.session import cut

SHINGLE = 5
WINDOW = 25
EDITS = 2  # that a window of 25 words may hold at one in 15, rounded up
ONE_IN = 15
SHARED_BY = 3
CHARS_PER_BLOCK = 16_000_000

_TAG = re.compile(r"<[/a-zA-Z!][^<>]*>|&[a-zA-Z]{2,8};|&#\d+;")
_HIDDEN = re.compile("[­​-‍⁠﻿]")
_WORD = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def words(text: str | None) -> list[str]:
    """Words of a text in order, lower case, without mark-up."""
    if not text:
        return []
    if not text.isascii():
        text = fold(_HIDDEN.sub("", text))
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text.strip()) if s]


def _openings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, t) to (i, t, k, head): a digest of the first k sentences, k up to three and less than all."""
    for batch in batches:
        rows = []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            split = sentences(t)
            rows += [(i, t, k, hashlib.blake2b("\x1f".join(split[:k]).encode(), digest_size=16).hexdigest()) for k in range(1, min(len(split), 4))]
        cols = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.string()))], ["i", "t", "k", "head"])


def with_openings(listed: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """``i, t, skip``: items and the number of leading sentences that at least ``shared_by`` items open with, counted over all items."""
    heads = cut(listed.mapInArrow(_openings, "i bigint, t string, k int, head string"), "item-openings")
    shared = heads.groupBy("head").count().where(F.col("count") >= shared_by).select("head")
    skip = heads.join(shared, "head").groupBy("i", "t").agg(F.max("k").alias("skip"))
    return cut(listed.join(skip, ["i", "t"], "left").select("i", "t", F.coalesce("skip", F.lit(0)).alias("skip")), "items")


@dataclass
class ItemIndex:
    """Vocabulary, shingles and windows of a block of items."""

    ids: list
    content: list[list[int]]
    vocabulary: dict[str, int]
    hashes: np.ndarray
    places: list[list[tuple[int, int]]] = field(default_factory=list)

    @classmethod
    def build(cls, ids: list, texts: list[list[str]]) -> ItemIndex:
        vocabulary: dict[str, int] = {}
        content = [[vocabulary.setdefault(w, len(vocabulary)) for w in ws] for ws in texts]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, ws in enumerate(content):
            if len(ws) >= WINDOW:
                for i, h in enumerate(shingle_hashes(np.array(ws, dtype=np.int64)).tolist()):
                    places[h].append((n, i))
        order = sorted(places)
        return cls(ids, content, vocabulary, np.array(order, dtype=np.uint64), [places[h] for h in order])

    def prefixes(self, frequency: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """Shingles that some window needs: number of the shingle -> (item, position)."""
        at: dict[tuple[int, int], int] = {p: s for s, ps in enumerate(self.places) for p in ps}
        per = WINDOW - SHINGLE + 1
        need = per - (per - SHINGLE * EDITS) + 1
        wanted: set[tuple[int, int]] = set()
        for n, ws in enumerate(self.content):
            for start in range(max(0, len(ws) - WINDOW + 1)):
                span = sorted(range(start, start + per), key=lambda i: (frequency.get(at[n, i], 0), at[n, i]))
                wanted.update((n, i) for i in span[:need])
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in wanted:
            out[at[p]].append(p)
        return dict(out)


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    u = (ids + 1).astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h = (h ^ (u[k : k + n] * _MULTIPLIERS[k])) * _MULTIPLIERS[(k + 1) % SHINGLE]
        h ^= h >> np.uint64(29)
    return h


def _scan(batches: Iterable[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    """Documents with item shingles: word numbers (-1 for others), positions and numbers of the shingles."""
    get = index.vocabulary.get
    for batch in batches:
        keys = batch.column(0).to_pylist()
        flat: list[int] = []
        ends = []
        for text in batch.column(1).to_pylist():
            flat += [get(w, -1) for w in words(text)]
            flat.append(-1)
            ends.append(len(flat))
        ids = np.array(flat, dtype=np.int64)
        if len(ids) < SHINGLE or not len(index.hashes):
            continue
        bad = np.concatenate([[0], np.cumsum(ids < 0)])
        n = len(ids) - SHINGLE + 1
        start = np.flatnonzero(bad[SHINGLE : SHINGLE + n] == bad[:n])
        if not len(start):
            continue
        u = (ids + 1).astype(np.uint64)
        h = np.zeros(len(start), dtype=np.uint64)
        for k in range(SHINGLE):
            h = (h ^ (u[start + k] * _MULTIPLIERS[k])) * _MULTIPLIERS[(k + 1) % SHINGLE]
            h ^= h >> np.uint64(29)
        where = np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)
        hit = index.hashes[where] == h
        start, where = start[hit], where[hit]
        begins = np.array([0, *ends[:-1]])
        doc = np.searchsorted(begins, start, side="right") - 1
        out_keys, out_words, out_at, out_shingle = [], [], [], []
        for d in np.unique(doc):
            own = doc == d
            out_keys.append(keys[d])
            out_words.append(ids[begins[d] : ends[d] - 1].astype(np.int32))
            out_at.append((start[own] - begins[d]).astype(np.int32))
            out_shingle.append(where[own].astype(np.int32))
        if out_keys:
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, batch.schema.field(0).type), pa.array(out_words, ints), pa.array(out_at, ints), pa.array(out_shingle, ints)], ["k", "w", "at", "sh"])


def contains(doc: list[int], item: list[int], low: int, high: int) -> bool:
    """Whether ``doc[low:high]`` holds at least WINDOW consecutive words of ``item`` with few words altered or added.

    Maximal runs of equal words (two or more) are chained in order; between two
    runs the longer gap counts as edits. For each run and number of edits the
    earliest start is kept. A chain of L item words may have 1 + L // 15 edits.
    """
    places: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(item):
        places[w].append(i)
    open_runs: dict[int, tuple[int, int]] = {}
    runs: list[tuple[int, int, int]] = []
    for j in range(low, high):
        now: dict[int, tuple[int, int]] = {}
        for i in places.get(doc[j], ()):
            before = open_runs.pop(i - 1, None)
            now[i] = (before[0], before[1] + 1) if before else (i, 1)
        runs += [(i - n + 1, j - n, n) for i, (_, n) in open_runs.items() if n >= 2]
        open_runs = now
    runs += [(i - n + 1, high - n, n) for i, (_, n) in open_runs.items() if n >= 2]
    most = 1 + len(item) // ONE_IN
    runs.sort(key=lambda r: (r[1], r[0]))
    best: list[dict[int, int]] = []
    for x, (i, j, n) in enumerate(runs):
        state = {0: i}
        for y in range(x - 1, -1, -1):
            pi, pj, pn = runs[y]
            over = max(0, pi + pn - i, pj + pn - j)
            if over >= n or pi >= i or pj >= j:
                continue
            gap = max(i + over - pi - pn, j + over - pj - pn)
            for e, s in best[y].items():
                if e + gap <= most and s < state.get(e + gap, i):
                    state[e + gap] = s
        best.append(state)
        for e, s in state.items():
            length = i + n - s
            if length >= WINDOW and e <= 1 + length // ONE_IN:
                return True
    return False


def _verify(batches: Iterable[pa.RecordBatch], index: ItemIndex, prefixes: dict[int, list[tuple[int, int]]], key_type) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, items = [], []
        cols = [batch.column(c).to_pylist() for c in range(4)]
        for key, doc, at, shingles in zip(*cols):
            if len(doc) < WINDOW - EDITS:
                continue
            diagonals: dict[int, list[int]] = defaultdict(list)
            for j, s in zip(at, shingles):
                for n, i in prefixes.get(s, ()):
                    diagonals[n].append(j - i)
            for n, ds in diagonals.items():
                item = index.content[n]
                slack = 2 + len(item) // ONE_IN
                ds.sort()
                k = 0
                while k < len(ds):
                    last = k
                    while last + 1 < len(ds) and ds[last + 1] - ds[last] <= slack:
                        last += 1
                    if contains(doc, item, max(0, ds[k] - slack), min(len(doc), ds[last] + len(item) + slack)):
                        keys.append(key)
                        items.append(index.ids[n])
                        break
                    k = last + 1
        yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(items, pa.int64())], ["k", "item"])


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", chars_per_block: int = CHARS_PER_BLOCK) -> DataFrame:
    """``key, item``, each once: the documents that hold at least 25 consecutive words of an item.

    The opening sentences that three or more items share don't count. Null and
    empty texts, and items shorter than 25 words, give nothing. Items listed twice
    count once; item ids must be integers. Whole texts are read.
    """
    spark = docs.sparkSession
    listed = with_openings(items.select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t")).dropna().distinct())
    total = listed.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // chars_per_block) or 1
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    found = []
    for b in range(blocks):
        block = listed.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i", "t").collect()
        index = ItemIndex.build([r.i for r in block], [words(" ".join(sentences(r.t)[r.skip :])) for r in block])
        sent = spark.sparkContext.broadcast(index)
        hits = cut(rows.mapInArrow(lambda it, s=sent: _scan(it, s.value), f"k {kind}, w array<int>, at array<int>, sh array<int>"), "leak-hits")
        counted = hits.select(F.explode(F.array_distinct("sh")).alias("s")).groupBy("s").count().collect()  # at most one row per shingle of the block
        need = spark.sparkContext.broadcast(index.prefixes({r.s: r["count"] for r in counted}))
        key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        found.append(hits.mapInArrow(lambda it, s=sent, p=need, t=key_type: _verify(it, s.value, p.value, t), f"k {kind}, item bigint"))
    result = reduce(DataFrame.unionByName, found).distinct()
    return result.select(F.col("k").alias(key), F.col("item").alias(item))
