"""Which spellings of company names are alike, without comparing each with every other.

Two spellings meet in a block if one of their words begins or ends alike. Blocks
are walked by an Arrow kernel: each word gets a 64-bit count of its letters, of which
a changed letter touches at most two bits, and a 128-bit signature of its letter
pairs, of which it touches at most four; a pair that asks for more changes than a
like pair may have is left out without measuring it. The words that gave the key are
compared once each, and only spellings of near ones meet. What passes is measured
exactly. This costs nanoseconds a pair, so few and short keys do, and little is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from tallyweave.session import cut, drop

MOST_IN_PART = 100_000  # spellings of a block that one task compares at a time
PAIRS_AT_ONCE = 1 << 15
ODD_LABELS = 64
ODDS = [(ord(x) + 7) % 26 for x in "aeiorsnltdmk"]  # letters of which three are counted
MOST_CHANGES = 6  # words with more letters to change are wholly unlike
OLD, END = 1, 2  # marks of a key


def state_label(state: Column) -> Column:
    """A two-letter code as it is; other wordings share ``ODD_LABELS`` labels, so there are at most 740."""
    return F.when(state.rlike("^[A-Z]{2}$"), state).otherwise(F.concat(F.lit("?"), F.pmod(F.xxhash64(state), F.lit(ODD_LABELS)).cast("string")))


def spelling_id(a: Column, b: Column) -> Column:
    """The number of a spelling, whatever the order of its two words; ``b`` may be empty."""
    return F.when(b == "", F.xxhash64(a, b)).otherwise(F.xxhash64(F.least(a, b), F.greatest(a, b)))


def word_ends(n: int) -> tuple[int, ...]:
    """How many letters of the start and the end of a word of ``n`` letters are keys.

    A word and one of a neighbouring length with one changed letter have as many in
    common as half of the shorter one less one, so they share a number that is no larger.
    """
    return (5,) if n >= 10 else {9: (4, 5), 8: (3, 4, 5), 7: (3,), 6: (3,), 5: (2, 3)}.get(n, (2,))


def meeting_keys(w1: str, w2: str) -> Iterator[tuple[str, str, str, int]]:
    """(key, m, o, mark): starts and ends of words, of which two spellings alike share at least one.

    ``m`` is the word that gives the key, ``o`` the other. Of two and two words the
    closer pair has one changed letter up to nine letters, so its first or last half
    stays; of two words of ten letters or more four letters serve for two changes. A spelling run together gives all its stretches of five letters, of two to
    four as well if short, as it does not tell where its words part. Not guaranteed:
    spellings with two or more changed letters in each word, none of which begins or
    ends alike, and runs of 19 letters with three changes spread evenly.

    ``mark`` has ``OLD`` if the word gives a shorter such key as well, and ``END`` for an
    end. Two that are old in a block both give the same shorter key, whose block compares them.
    """
    if not w2:
        hs = (5,) if len(w1) > 14 else (2, 3, 4, 5)
        for h in hs:
            old = OLD * (h > hs[0])
            for stretch in {w1[i : i + h] for i in range(max(1, len(w1) - h + 1))}:
                yield "^" + stretch, w1, w2, old
                yield "$" + stretch, w1, w2, old | END
        return
    long = min(len(w1), len(w2)) >= 10  # such may have two changes in each word
    for m, o in ((w1, w2), (w2, w1)):
        hs = (4, 5) if long else word_ends(len(m))
        for h in hs:
            old = OLD * (h > hs[0])
            yield "^" + m[:h], m, o, old
            yield "$" + m[-h:], m, o, old | END


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, w1, w2) to (key, m, o, mark), a key being the label with a start or an end."""
    for batch in batches:
        keys, ms, os, marks = [], [], [], []
        for label, w1, w2 in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for key, m, o, mark in meeting_keys(w1, w2):
                keys.append(label + key)
                ms.append(m)
                os.append(o)
                marks.append(mark)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ms, pa.string()), pa.array(os, pa.string()), pa.array(marks, pa.int8())], ["key", "m", "o", "mark"])


class Signed(NamedTuple):
    """Of each row: two 64-bit words of either word's signature, most changes, whether it is run together and most bits then; a number of its first word, most changes of that alone, the letters of that and of both, the signature of both."""

    first: np.ndarray
    second: np.ndarray
    most: np.ndarray
    single: np.ndarray
    bits: np.ndarray
    word: np.ndarray
    alone: np.ndarray
    letters: np.ndarray
    together: np.ndarray
    whole: np.ndarray


def signature(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(2 x n signature of the letter pairs, lengths) of lower-case words; an empty word has no pairs."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    sizes = np.diff(offsets)
    out, some = np.zeros((2, len(words)), np.uint64), sizes > 0
    if some.any():
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts = (offsets[:-1] - offsets[0])[some]
        pair = np.zeros(len(data), np.uint32)
        pair[:-1] = data[:-1].astype(np.uint32) * np.uint32(26) + data[1:]
        spot = (pair * np.uint32(2654435761)) >> np.uint32(25)
        bit = np.uint64(1) << (spot & np.uint32(63)).astype(np.uint64)
        bit[starts + sizes[some] - 1] = 0  # the last letter begins no pair
        for k in (0, 1):
            out[k][some] = np.bitwise_or.reduceat(np.where((spot >> np.uint32(6)) == k, bit, np.uint64(0)), starts)
    return out, sizes


def signatures(m: pa.Array, o: pa.Array, share: float) -> Signed:
    """Of spellings of the words ``m`` and ``o``; ``share`` of their letters may change."""
    (first, a), (second, b) = signature(m), signature(o)
    # of words run together three quarters of that share, as each change counts double; where they meet is a pair more
    most, bits = (np.minimum(x, 120).astype(np.uint8) for x in (np.floor(share * (a + b + 1) + 1e-9), 4 * np.floor(0.75 * share * (a + b) + 1e-9) + 1))
    # the closer word may change by that share, and finds its like by its own ends if one letter changes; if two or more do,
    # what is left for the other one, at most half as much above one and a half times that share
    rest = 1.5 * share - (1 - share) / np.maximum(b, 1)
    alone = np.minimum(np.floor(np.maximum(share, rest) * a + 1e-9), 60).astype(np.uint8)
    word = pc.fill_null(m, "").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    counts = [letter_counts(w) for w in (m, o)]
    return Signed(first, second, most, b == 0, bits, word, alone, _letters(counts[0]), _letters(counts[0] + counts[1]), first | second)


def letter_counts(words: pa.Array) -> np.ndarray:
    """(n x 26) how often each letter stands in a word; digits count with some letter."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(len(words)), np.diff(offsets))
    return np.bincount(row * 26 + (data.astype(np.int64) + 7) % 26, minlength=26 * len(words)).reshape(len(words), 26)


def _letters(counts: np.ndarray) -> np.ndarray:
    """A bit for each letter that occurs, one for each that occurs twice, one for each of twelve that occurs three times: a change touches at most two."""
    bits = np.concatenate([counts > 0, counts > 1, counts[:, ODDS] > 2], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[0] ^ y[0]) + np.bitwise_count(x[1] ^ y[1])


def _changes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least number of changes between words of these signatures."""
    return (_bits(x, y) + np.uint8(3)) >> np.uint8(2)


def _near(sig: Signed, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of rows may be alike."""
    near = _changes(sig.first[:, p], sig.first[:, q]) + _changes(sig.second[:, p], sig.second[:, q]) <= np.maximum(sig.most[p], sig.most[q])
    joined = sig.single[p] | sig.single[q]  # one of them run together: both as a whole
    if joined.any():
        near = np.where(joined, _bits(sig.whole[:, p], sig.whole[:, q]) <= np.maximum(sig.bits[p], sig.bits[q]), near)
    return near


def _close(letters: np.ndarray, theirs: np.ndarray, most: np.ndarray, limits: np.ndarray, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in the first list, in the second) whose letters differ by no more than the larger of both limits; ``within`` one list, no place with an earlier one."""
    i = 0
    while i < len(letters):
        lo = i if within else 0
        hi = min(len(letters), i + max(1, PAIRS_AT_ONCE // max(1, len(theirs) - lo)))
        u, w = np.nonzero(np.bitwise_count(letters[i:hi, None] ^ theirs[None, lo:]) <= np.maximum(most[i:hi, None], limits[None, lo:]))
        u, w = u + i, w + lo
        i = hi
        if within:
            u, w = u[u <= w], w[u <= w]
        if len(u):
            yield u, w


def _grid(sig: Signed, left: np.ndarray, right: np.ndarray, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of two lists of rows of which one is run together, or, ``within`` one, of those before and after each other."""
    if not len(left) or not len(right):
        return
    most = sig.bits >> np.uint8(1)  # two of letters for each change
    for u, w in _close(sig.together[left], sig.together[right], most[left], most[right], within):
        p, q = left[u], right[w]
        near = _bits(sig.whole[:, p], sig.whole[:, q]) <= np.maximum(sig.bits[p], sig.bits[q])
        if within:
            near &= p != q
        if near.any():
            yield p[near], q[near]


def _by_word(sig: Signed, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(``rows`` sorted by first word; where each word's rows begin; how many they are; its first row)."""
    rows = rows[np.argsort(sig.word[rows], kind="stable")]
    word = sig.word[rows]
    at = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    return rows, at, np.diff(np.append(at, len(rows))), rows[at]


def _words(sig: Signed, left: np.ndarray, right: np.ndarray, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_grid`` of spellings of two words: first words are compared once each, then the rows of those that are near."""
    if not len(left) or not len(right):
        return
    one, at, n, words = _by_word(sig, left)
    two, at2, n2, words2 = (one, at, n, words) if within else _by_word(sig, right)
    for u, w in _close(sig.letters[words], sig.letters[words2], 2 * sig.alone[words], 2 * sig.alone[words2], within):
        p, q = words[u], words2[w]
        near = _changes(sig.first[:, p], sig.first[:, q]) <= np.maximum(sig.alone[p], sig.alone[q])
        u, w = u[near], w[near]
        total = np.cumsum(n[u] * n2[w])
        if not len(total):
            continue
        stops = np.unique(np.append(np.searchsorted(total, np.arange(4 * PAIRS_AT_ONCE, total[-1], 4 * PAIRS_AT_ONCE)), len(u) - 1)) + 1
        begin = 0
        for stop in stops:
            x, y = u[begin:stop], w[begin:stop]
            begin = stop
            each = n[x] * n2[y]
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            wide = np.repeat(n2[y], each)
            p, q = one[np.repeat(at[x], each) + k // wide], two[np.repeat(at2[y], each) + k % wide]
            some = np.bitwise_count(sig.together[p] ^ sig.together[q]) <= 2 * np.maximum(sig.most[p], sig.most[q])
            if within:
                some &= (p < q) | np.repeat(x != y, each)
            p, q = p[some], q[some]
            near = _changes(sig.first[:, p], sig.first[:, q]) + _changes(sig.second[:, p], sig.second[:, q]) <= np.maximum(sig.most[p], sig.most[q])
            if near.any():
                yield p[near], q[near]


def _block(sig: Signed, side: np.ndarray, old: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows lo..hi, but for two that are old: of each other, or of the two sides where a block is dealt into parts."""
    rows = np.arange(lo, hi)
    single, old = sig.single[lo:hi], old[lo:hi]
    if side[lo] == 0:
        two, one = rows[~single & ~old], rows[single & ~old]
        two_old, one_old = rows[~single & old], rows[single & old]
        yield from _words(sig, two, two, True)
        yield from _words(sig, two, two_old, False)
        yield from _grid(sig, one, one, True)
        yield from _grid(sig, one, one_old, False)
        yield from _grid(sig, one, rows[~single], False)
        yield from _grid(sig, one_old, two, False)
    else:
        left = side[lo:hi] == 1
        for mine, theirs in ((left & ~old, ~left), (left & old, ~left & ~old)):
            yield from _words(sig, rows[mine & ~single], rows[theirs & ~single], False)
            for a, b in ((True, True), (True, False), (False, True)):
                yield from _grid(sig, rows[mine & (single == a)], rows[theirs & (single == b)], False)


def _small(sig: Signed, end: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for rows of many small blocks at once, in which the old ones, not among ``rows``, come last; ``end`` is where a row's block ends."""
    after = end[rows] - rows - 1
    rows, after = rows[after > 0], after[after > 0]
    if not len(rows):
        return
    total = np.cumsum(after)
    stops = np.unique(np.append(np.searchsorted(total, np.arange(PAIRS_AT_ONCE, total[-1], PAIRS_AT_ONCE)), len(rows) - 1)) + 1
    at = 0
    for stop in stops:
        part, n = rows[at:stop], after[at:stop]
        at = stop
        p = np.repeat(part, n)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        # few letters apart, which is soonest told
        some = np.flatnonzero(np.bitwise_count(sig.together[p] ^ sig.together[q]) <= 2 * np.maximum(sig.most[p], sig.most[q]))
        p, q = p[some], q[some]
        near = _near(sig, p, q)
        yield p[near], q[near]


def _matrix(words: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x width letters, 0 beyond a word's end; lengths)."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    sizes = np.diff(offsets)
    out = np.zeros((len(words), width), np.uint8)
    if width and offsets[-1] > offsets[0]:
        out[np.arange(width) < sizes[:, None]] = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return out, sizes


def _plain_changes(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def changes(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Letters to insert, drop or change between the words of each row, by bit-parallel columns over many rows at once."""
    out = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 1 << 12):
        xs, ys = x.slice(lo, 1 << 12), y.slice(lo, 1 << 12)
        a, b = _matrix(xs, 0)[1], _matrix(ys, 0)[1]
        if max(a.max(), b.max()) > 32:
            out[lo : lo + len(xs)] = [_plain_changes((v or "").encode(), (w or "").encode()) for v, w in zip(xs.to_pylist(), ys.to_pylist())]
            continue
        kind = np.uint16 if a.max() <= 16 else np.uint32
        width, steps = kind(0).itemsize * 8, int(b.max())
        left, right = _matrix(xs, width)[0], np.ascontiguousarray(_matrix(ys, max(steps, 1))[0].T)
        one, top = kind(1), np.maximum(a - 1, 0).astype(kind)
        up, down, score = np.full(len(xs), ~kind(0)), np.zeros(len(xs), kind), a.astype(np.int16)
        for j in range(steps):
            eq = np.packbits(left == right[j][:, None], axis=1, bitorder="little").view(kind)[:, 0]
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | ~(xh | up), up & xh
            step = ((ph >> top) & one).astype(np.int16) - ((mh >> top) & one).astype(np.int16)
            score += step * (j < b)
            ph, mh = (ph << one) | one, mh << one
            up, down = mh | ~(xv | ph), ph & xv
        out[lo : lo + len(xs)] = np.where(a == 0, b, score)
    return out


def _share(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Share of letters to change; more than ``MOST_CHANGES`` count as all."""
    c = changes(x, y)
    longest = np.maximum(np.maximum(pc.binary_length(x.cast(pa.binary())).to_numpy(zero_copy_only=False), pc.binary_length(y.cast(pa.binary())).to_numpy(zero_copy_only=False)), 1)
    return np.where(c > MOST_CHANGES, 1.0, c / longest)


def _likeness(m: pa.Array, o: pa.Array, m2: pa.Array, o2: pa.Array, least: float = 0.0) -> np.ndarray:
    """1 less the share of letters to change, in full for the word that differs more, by half for the other; ``m`` with ``m2``.

    It is exact from ``least`` on. Where one is run together both are, in either order, and a change counts double, as it concerns one of two words.
    """
    single = (pc.binary_length(o.cast(pa.binary())).to_numpy(zero_copy_only=False) == 0) | (pc.binary_length(o2.cast(pa.binary())).to_numpy(zero_copy_only=False) == 0)
    out = np.zeros(len(m))
    for which, whole in ((np.flatnonzero(~single), False), (np.flatnonzero(single), True)):
        if not len(which):
            continue
        a, b, c, d = (v.take(pa.array(which)) for v in (m, o, m2, o2))
        if whole:
            ab, ba, cd, dc = (pc.binary_join_element_wise(p, q, "") for p, q in ((a, b), (b, a), (c, d), (d, c)))
            out[which] = 1 - 2 * np.minimum(np.minimum(_share(ab, cd), _share(ab, dc)), _share(ba, cd))
        else:
            x = _share(a, c)
            y = np.ones(len(x))
            some = np.flatnonzero(x <= 1 - least + 1e-9)
            y[some] = _share(b.take(pa.array(some)), d.take(pa.array(some)))
            out[which] = 1 - (np.maximum(x, y) + 0.5 * np.minimum(x, y))
    return np.maximum(out, 0.0)


@arrow_udf(DoubleType())
def name_likeness(a1: pa.Array, a2: pa.Array, b1: pa.Array, b2: pa.Array) -> pa.Array:
    """Likeness of two spellings of up to two words each, their words taken in either order; of equal ones 1."""
    same = pc.and_(pc.equal(a1, b1), pc.equal(a2, b2)).fill_null(False).to_numpy(zero_copy_only=False)
    out = np.ones(len(a1))
    rest = pa.array(np.flatnonzero(~same))
    if len(rest):
        a, b, c, d = (v.take(rest).fill_null("") for v in (a1, a2, b1, b2))
        out[~same] = np.maximum(_likeness(a, b, c, d), _likeness(a, b, d, c))
    return pa.array(out)


SMALL = 128


def _meet(like: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            packed = batch.column(0).to_numpy()
            parts = [pa.array(packed & ~np.int64(15)), pa.array((packed >> 2 & 3).astype(np.int8)), batch.column(1), batch.column(2), pa.array((packed & 3).astype(np.int8))]
            batch = pa.RecordBatch.from_arrays(parts, ["key", "side", "m", "o", "mark"])
            held = batch if held is None else pa.concat_batches([held, batch])
            key = held.column(0).to_numpy()
            # the last block may go on in the next batch
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if whole:
                yield from _pairs(held.slice(0, whole), like)
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from _pairs(held, like)

    return run


def _pairs(rows: pa.RecordBatch, least: float) -> Iterator[pa.RecordBatch]:
    """``xm, xo, ym, yo, like`` of the like pairs of whole blocks; ``rows`` has key, side and the two words, sorted by the first two, and may have a mark, by which they are sorted next."""
    key, side, m, o = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2), rows.column(3)
    mark = rows.column(4).to_numpy() if rows.num_columns > 4 else np.zeros(len(key), np.int8)
    old = (mark & OLD) > 0
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ends = np.append(starts[1:], len(key))
    size = ends - starts
    if not (size > 1).any():
        return
    sig = signatures(m, o, (1 - least) * 2 / 3)
    few = (side[starts] == 0) & (size <= SMALL)
    shortest, opening = (_key_lengths(m, o), _openings(m)) if (mark & END).any() else (None, None)

    def fresh(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without pairs that meet by an end although the same words begin alike, in whose block they are found for certain."""
        if shortest is None or not len(p):
            return p, q
        both = shortest[p] & shortest[q]
        begin = ((opening[p] ^ opening[q]) & _FIRST[both & -both]) == 0
        most = np.maximum(sig.alone[p], sig.alone[q])
        sure = (np.bitwise_count(sig.letters[p] ^ sig.letters[q]) <= 2 * most) & (_changes(sig.first[:, p], sig.first[:, q]) <= most)
        kept = ~(begin & sure & ((mark[p] & END) > 0) & ~sig.single[p] & ~sig.single[q])
        return p[kept], q[kept]

    found = list(_small(sig, np.repeat(ends, size), np.flatnonzero(np.repeat(few, size) & ~old)))
    n = 0
    for lo, hi in zip(starts[~few], ends[~few]):
        for pair in _block(sig, side, old, int(lo), int(hi)):
            found.append(pair)
            n += len(pair[0])
            if n > 50_000:
                yield _taken(m, o, fresh(*map(np.concatenate, zip(*found))), least)
                found, n = [], 0
    if found:
        yield _taken(m, o, fresh(*map(np.concatenate, zip(*found))), least)


_FIRST = np.zeros(64, np.uint64)  # of the letters of a word, by the bit of a number: so many from its beginning
for _h in (2, 3, 4, 5):
    _FIRST[1 << _h] = (1 << 8 * _h) - 1


def _key_lengths(m: pa.Array, o: pa.Array) -> np.ndarray:
    """A bit for each number of letters of which ``m`` gives a key; see ``meeting_keys``."""
    a, b = (pc.binary_length(w.cast(pa.binary())).to_numpy(zero_copy_only=False) for w in (m, o))
    of = np.array([sum(1 << h for h in word_ends(n)) for n in range(11)])
    return np.where(np.minimum(a, b) >= 10, (1 << 4) | (1 << 5), of[np.minimum(a, 10)])


def _openings(m: pa.Array) -> np.ndarray:
    """The first eight letters of each word as one number, the first one lowest."""
    words = m.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.concatenate([np.frombuffer(words.buffers()[2], np.uint8), np.zeros(8, np.uint8)])
    at = np.arange(8)
    letters = data[offsets[:-1, None] + at]
    letters[at >= np.diff(offsets)[:, None]] = 0
    return np.ascontiguousarray(letters).view(np.uint64)[:, 0]


def _taken(m: pa.Array, o: pa.Array, found: tuple[np.ndarray, np.ndarray], least: float) -> pa.RecordBatch:
    p, q = map(pa.array, found)
    four = [m.take(p), o.take(p), m.take(q), o.take(q)]
    like = _likeness(*four, least)
    kept = pa.array(np.flatnonzero(like >= least))
    return pa.RecordBatch.from_arrays([*(v.take(kept) for v in four), pa.array(like).take(kept)], ["xm", "xo", "ym", "yo", "like"])


def _crowded(told: DataFrame, held: dict[str, int], most: int) -> list[str]:
    """The labels that may have a block of more than ``most``; ``held`` are their numbers of spellings.

    A spelling stands in a block twice at most, once with either word, so only labels of
    many spellings can. Of these the words are counted by their first and last two
    letters, of which each block has its own; one run together may stand in any, by up to four lengths.
    """
    many = [v for v, n in held.items() if n > most // 2]
    if not many:
        return many
    some, one = told.where(F.col("label").isin(many)), F.col("w2") == ""
    starts = [F.concat(F.lit("^"), F.substring(w, 1, 2)) for w in ("w1", "w2")]
    ends = [F.concat(F.lit("$"), F.substring(w, -2, 2)) for w in ("w1", "w2")]
    of = F.when(one, F.array(F.lit(""))).otherwise(F.array(*starts, *ends))
    counts = some.select("label", F.explode(of).alias("at")).groupBy("label", "at").count()
    lone = F.coalesce(F.max(F.when(F.col("at") == "", F.col("count"))), F.lit(0))
    fullest = F.coalesce(F.max(F.when(F.col("at") != "", F.col("count"))), F.lit(0))
    return [r[0] for r in counts.groupBy("label").agg((4 * lone + fullest).alias("most")).where(F.col("most") > most).select("label").collect()]


def like_spellings(rows: DataFrame, like: float, most: int = MOST_IN_PART) -> DataFrame:
    """``s, t`` (s < t) and ``like`` of different spellings that are alike, each pair once, by ``xxhash64`` of their words.

    ``rows`` has ``sid`` (null: no spelling), ``w1``, ``w2`` and, if it knows them,
    ``state``: spellings of different states are not compared, those without a state
    with all. Every pair of a block is compared: blocks of more than ``most``
    spellings are dealt into parts, each of which meets itself and every other.
    """
    label = state_label(F.col("state")) if "state" in rows.columns else F.lit("-")
    some = rows.where("sid IS NOT NULL")
    known = F.when(F.col("state").isNotNull(), label) if "state" in rows.columns else label
    spelled = cut(some.select("w1", "w2", known.alias("label")).distinct(), "spellings")
    held = {r[0]: r[1] for r in spelled.groupBy("label").count().collect()}  # at most 740 and those without
    alone, labels = held.pop(None, 0), sorted(held)
    every = F.array(*[F.lit(v) for v in [*labels, "-"]])
    told = spelled.select("w1", "w2", F.explode(F.when(F.col("label").isNull(), every).otherwise(F.array("label"))).alias("label"))
    shape = "key string, m string, o string, mark byte"
    keyed = told.select("label", "w1", "w2").mapInArrow(_keyed, shape).select(F.xxhash64("key").alias("key"), "m", "o", "mark")
    many = _crowded(told, {**{v: n + alone for v, n in held.items()}, "-": held.get("-", 0) + alone}, most)
    sizes, large = None, 0
    if many:
        counted = told.where(F.col("label").isin(many)).mapInArrow(_keyed, shape).groupBy(F.xxhash64("key").alias("key")).count()
        sizes = cut(counted.where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("n")), "large-blocks")
        large = sizes.agg(F.sum("n")).first()[0]
    blocks = keyed.select("key", F.lit(0).cast("byte").alias("side"), "m", "o", "mark")
    if large:
        hinted = F.broadcast(sizes) if large < 100_000 else sizes
        rest = blocks.join(hinted, "key", "left_anti")
        dealt = keyed.join(hinted, "key").withColumn("p", F.pmod(F.xxhash64("m", "o"), F.col("n")).cast("int"))
        both = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least(j, "p").alias("i"), F.greatest(j, "p").alias("j")))
        parts = dealt.select("key", "m", "o", "mark", "p", F.explode(both).alias("at"))
        side = F.when(F.col("at.i") == F.col("at.j"), 0).when(F.col("p") == F.col("at.i"), 1).otherwise(2).cast("byte")
        blocks = rest.unionByName(parts.select(F.xxhash64("key", "at.i", "at.j").alias("key"), side.alias("side"), "m", "o", "mark"))
    # one number, whose last bits are side and mark: it is sorted faster than three
    key = F.col("key").bitwiseAND(F.lit(-16))
    packed = blocks.select(key.bitwiseOR(F.col("side") * 4 + F.col("mark")).alias("key"), "m", "o")
    laid = packed.repartition(key).sortWithinPartitions("key")
    met = laid.mapInArrow(_meet(like), "xm string, xo string, ym string, yo string, like double")

    ids = met.select(spelling_id(F.col("xm"), F.col("xo")).alias("s"), spelling_id(F.col("ym"), F.col("yo")).alias("t"), "like").where("s <> t")
    found = cut(ids.groupBy(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).agg(F.max("like").alias("like")), "like-spellings")
    del met, ids, laid, packed, blocks, keyed
    drop(spelled, *([] if sizes is None else [sizes]), now=True)
    return found
