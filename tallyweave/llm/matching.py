"""Which records of different feeds describe one company, without a shared key or labels.

1. Candidates: records with like names, or with the same line, site or holding
   company, in blocks of bounded size.
2. Each candidate pair gets a similarity vector of name, line, site and place.
   The values are coarse, so all pairs of any corpus fall into some hundred cells;
   their counts, taken over all pairs, are all that reaches the driver.
3. A mixture of two regularised Gaussians is fitted to the counted cells by
   expectation-maximisation; a missing value leaves its dimension out.
4. Transitivity belongs to the expectation step, pair by pair. Records that say
   everything (name, trade, state) are joined by their matches; a record that says
   less follows the side with the larger sum of log odds, and its other matches
   keep their share of the claims. Two records of one group whose own pair is no
   match violate transitivity: in each triangle with a common match either that pair
   is raised to the product of the two matches, or, if it speaks against them more
   than the weaker match speaks for them, that match is lowered to what the pair
   allows, and the groups are formed again. The posteriors so corrected enter the
   maximisation step; both steps are repeated until the matches stay the same.
   Groups and posteriors returned are of one and the same fit.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm import spelled
from tallyweave.llm.blocking import MOST_IN_BLOCK, bounded_pairs, heavy, parted_pairs, sendable, whole_pairs
from tallyweave.llm.components import components
from tallyweave.llm.names import parsed_records
from tallyweave.llm.settling import SHAPE, settling
from tallyweave.llm.spelled import name_likeness
from tallyweave.session import cut, drop

LIKE = 0.68  # names less alike are no candidates by name
STEPS = 20  # steps of the name dimension
CLASH = STEPS + 1  # stands for the name dimension when the names tell different trades
CLASH_VALUE = -0.6
STATES = 3  # a line or site that records of so many states state is nobody's own unless their names agree
FACTS = ("id", "sid", "fam", "state", "zip5", "phone", "host", "hold")
PART = ("fam", "state", "zip5")
FITS = "(a.fam = b.fam OR a.fam = 0 OR b.fam = 0) AND (a.state = b.state OR a.state IS NULL OR b.state IS NULL)"  # neither trade nor state excludes it
EDGES_PER_TASK = 1_500_000
MOST_IN_TASK = 100_000  # pairs of a component that one task settles


class Mixture(NamedTuple):
    """Share of matches, means and variances of (matched, unmatched)."""

    share: float
    mean: np.ndarray
    var: np.ndarray


def prepared(records: DataFrame) -> DataFrame:
    """One row per record with what it says and a number ``id``; a state left out is read off the postal code.

    The state of a three-digit postal area is the one most records of that area
    name (at most 1,000 areas, counted over all records).
    """
    parsed = parsed_records(records).where("rid IS NOT NULL")
    # only equality of these counts from here on, so they travel as numbers
    long = {"phone": F.col("phone").cast("bigint"), "host": F.xxhash64("host"), "hold": F.xxhash64("hold")}
    parsed = parsed.withColumns({k: F.when(F.col(k).isNotNull(), v) for k, v in long.items()})
    # the row before within an id, not a rank, which would sort all rows before the shuffle as well
    again = F.lag("rid").over(Window.partitionBy("rid").orderBy("rid"))
    once = parsed.withColumn("_again", again).where("_again IS NULL").drop("_again")
    once = once.withColumn("sid", F.when(F.col("w1") != "", F.xxhash64("w1", "w2"))).withColumn("id", F.monotonically_increasing_id())
    parsed = cut(once, "match-records")
    area = F.substring("zip5", 1, 3)
    counts = parsed.where("state IS NOT NULL AND zip5 IS NOT NULL").groupBy(area.alias("area"), "state").count()
    states = counts.groupBy("area").agg(F.max(F.struct("count", "state")).alias("s")).select("area", F.col("s.state").alias("_state"))
    table = {r.area: r._state for r in states.limit(1001).collect()}
    told = F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), area) if table else F.lit(None).cast("string")
    return parsed.withColumn("state", F.coalesce("state", told))


def like_spellings(rows: DataFrame, like: float = LIKE) -> DataFrame:
    """``s, t, like`` (s < t by their ``sid``) of different spellings that are alike, whatever numbers ``sid`` are."""
    ids = rows.where("sid IS NOT NULL").select(spelled.spelling_id(F.col("w1"), F.col("w2")).alias("h"), "sid").distinct()
    one, two = (ids.select(F.col("h").alias(h), F.col("sid").alias(i)) for h, i in (("s", "i"), ("t", "j")))
    return spelled.like_spellings(rows, like).join(one, "s").join(two, "t").select(F.least("i", "j").alias("s"), F.greatest("i", "j").alias("t"), "like")


def _vector(a: str, b: str, like: Column) -> Column:
    """The coarse similarity vector of two records as one number; ``like`` is the likeness of their names."""

    def both(f: str) -> tuple[Column, Column]:
        return F.col(f"{a}.{f}"), F.col(f"{b}.{f}")

    (ia, ib), (fa, fb), (sa, sb), (za, zb), (pa, pb), (ha, hb), (oa, ob) = (both(f) for f in ("sid", "fam", "state", "zip5", "phone", "host", "hold"))
    named = ia.isNotNull() & ib.isNotNull()
    name = F.when(named & (fa != 0) & (fb != 0) & (fa != fb), F.lit(CLASH)).when(named, F.floor(like * STEPS + 0.5)).when(oa == ob, F.lit(STEPS - 2)).otherwise(-1)
    place = F.when(sa != sb, 0).when(za == zb, 3).when(sa == sb, 2).when(F.substring(za, 1, 3) == F.substring(zb, 1, 3), 2).otherwise(-1)
    line = F.when(pa == pb, 2).when(pa % 1_000_000 == pb % 1_000_000, 1).when(pa != pb, 0).otherwise(-1)
    site = F.when(ha == hb, 1).when(ha != hb, 0).otherwise(-1)
    packed = F.lit(0)
    for c, n in zip((name, line, site, place), SIZES):
        packed = packed * n + F.coalesce(c, F.lit(-1)) + 1
    return packed.cast("int")


SIZES = (STEPS + 3, 4, 3, 5)  # values of name, line, site and place, the first of each: not known


def unpacked(v: np.ndarray) -> np.ndarray:
    """The vectors (name, line, site, place) of packed numbers; -1 where a value is missing."""
    out = []
    for n in reversed(SIZES):
        out.append(v % n - 1)
        v = v // n
    return np.stack(out[::-1], axis=1)


def _shared_contacts(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(``k, v``: lines and sites that are nobody's own; whether one on more than ``most`` records is left).

    Suspect are those on more than ``most`` records or on records of three states. Whose
    they are is told by the names, whatever their number: a suspect one is somebody's own
    if more than half of its records that name themselves, and two at least, have a word in common.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("phone", "host")])
    held = rows.select(F.explode(kinds).alias("c"), "state").select("c.k", "c.v", "state").where("v IS NOT NULL")
    by_state = held.groupBy("k", "v", "state").agg(F.count(F.lit(1)).alias("n"))
    sizes = by_state.groupBy("k", "v").agg(F.sum("n").alias("n"), F.count("state").alias("s")).where((F.col("n") > most) | (F.col("s") >= STATES))
    suspects = sendable(sizes.select("k", "v", "n"))
    words = F.array_distinct(F.filter(F.array("w1", "w2"), lambda w: w != ""))
    # by kind, so that only rows of suspect ones are unfolded
    of_kind = [rows.select(F.lit(k).alias("k"), F.col(k).alias("v"), "w1", "w2").join(suspects.where(F.col("k") == k).select("v"), "v", "left_semi") for k in ("phone", "host")]
    named = of_kind[0].unionByName(of_kind[1]).select("k", "v", words.alias("w")).where(F.size("w") > 0)
    # the blank word counts each naming record once
    counts = named.select("k", "v", F.explode(F.concat(F.array(F.lit("")), "w")).alias("w")).groupBy("k", "v", "w").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("k", "v").agg(F.max(F.when(F.col("w") == "", F.col("c"))).alias("all"), F.max(F.when(F.col("w") != "", F.col("c"))).alias("top"))
    judged = cut(suspects.join(top.where((F.col("top") > 1) & (F.col("top") * 2 > F.col("all"))).select("k", "v", F.lit(True).alias("own")), ["k", "v"], "left"), "suspect-contacts")
    drop(suspects, now=True)
    large = bool(judged.where(F.col("own") & (F.col("n") > most)).take(1))
    return judged.where("own IS NULL").select("k", "v"), large


def _without_contacts(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` with the ``shared`` lines and sites counted as missing."""
    for k in ("phone", "host"):
        mine = sendable(shared.where(F.col("k") == k).select(F.col("v").alias(k), F.lit(True).alias("_shared")))
        rows = rows.join(mine, k, "left").withColumn(k, F.when(F.col("_shared").isNull(), F.col(k))).drop("_shared")
    return rows


def id_pairs(rows: DataFrame, most: int = MOST_IN_BLOCK) -> DataFrame:
    """``a, b`` (numbers, a < b), the vector ``v`` and what both say (``f``) of every candidate pair, each once."""
    shared, large = _shared_contacts(rows, most)
    rows = cut(_without_contacts(rows.select("w1", "w2", *FACTS), shared), "match-rows")
    named = rows.where("sid IS NOT NULL")

    def full(side: str) -> Column:
        return F.col(f"{side}.sid").isNotNull() & (F.col(f"{side}.fam") != 0) & F.col(f"{side}.state").isNotNull()

    def told(pairs: DataFrame, like: Column) -> DataFrame:
        swap = F.col("a.id") > F.col("b.id")
        flags = full("a").cast("int"), full("b").cast("int")
        f = F.when(swap, flags[1] * 2 + flags[0]).otherwise(flags[0] * 2 + flags[1]).cast("byte")
        return pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), _vector("a", "b", like).alias("v"), f.alias("f"))

    # of one spelling, and of like ones: of a frequent spelling one record of each trade, state and postal code
    sizes = sendable(heavy(named, "sid", most))
    equal = parted_pairs(named, "sid", PART, FACTS, most, FITS, sizes)
    alike = spelled.like_spellings(named, LIKE)
    usual = named.join(sizes, "sid", "left_anti").select("sid", F.struct(*FACTS).alias("r"))
    heads = named.join(sizes, "sid", "left_semi").groupBy("sid", *PART).agg(F.min(F.struct(*FACTS)).alias("r")).select("sid", "r")
    sides = usual.unionByName(heads)
    crossed = alike.join(sides.select(F.col("sid").alias("s"), F.col("r").alias("a")), "s").join(sides.select(F.col("sid").alias("t"), F.col("r").alias("b")), "t")
    crossed = crossed.where("a.state = b.state OR a.state IS NULL OR b.state IS NULL")
    # of one line, site or holding company
    fields = ("id", "w1", "w2", *FACTS[1:])
    contacts = F.array(*[F.xxhash64(F.lit(k), F.col(k)) for k in ("phone", "host")])
    kept = F.filter(F.arrays_zip(contacts.alias("h"), F.array("phone", "host").alias("v")), lambda c: c["v"].isNotNull())
    at = rows.select(*fields, F.explode(kept).alias("_c")).select(*fields, F.col("_c.h").alias("_key"))
    met = whole_pairs(at, "_key", fields, most) if large else bounded_pairs(at, "_key", fields)
    evident = met.unionByName(parted_pairs(rows.select(*fields), "hold", PART, fields, most, FITS))
    likeness = name_likeness(F.col("a.w1"), F.col("a.w2"), F.col("b.w1"), F.col("b.w2"))
    evident = evident.where("a.id <> b.id").select("a", "b", likeness.alias("like"))
    found = [told(equal, F.lit(1.0)), told(crossed, F.col("like")), told(evident, F.col("like"))]
    pairs = reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.max("v").alias("v"), F.max("f").alias("f"))
    kept = cut(pairs, "match-pairs")
    drop(rows, alike, now=True)
    return kept


def _named_ends(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` with record ids instead of numbers, the smaller first."""
    one, two = (rows.select(F.col("id").alias(e), F.col("rid").alias(f"r{e}")) for e in "ab")
    both = pairs.join(one, "a").join(two, "b")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), *rest)


def candidates(rows: DataFrame, most: int = MOST_IN_BLOCK) -> DataFrame:
    """``a, b`` (record ids, a < b) and the vector of every candidate pair, each once.

    A line or a site on more than ``most`` records, or on records of three states, whose
    names have no word in common is nobody's own: it counts as missing. So many records
    of one spelling or holding company are paired by trade, state and zip, and one of each such part with those
    of all other parts that neither trade nor state excludes. Like spellings are paired where the states don't differ.
    """
    return _named_ends(id_pairs(rows, most).drop("f"), rows)


def _values(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    name = np.where(cells[:, 0] < 0, 0.0, np.where(cells[:, 0] == CLASH, CLASH_VALUE, cells[:, 0] / STEPS))
    line = np.array([0.0, 0.8, 1.0, 0.0])[cells[:, 1]]  # a missing value, -1, is left out below
    site = np.clip(cells[:, 2], 0, None)
    place = np.array([-1.0, 0.5, 0.75, 1.0, 0.0])[cells[:, 3]]
    return np.stack([name, line, site, place], axis=1).astype(float), cells >= 0


def _log_density(x: np.ndarray, known: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return np.where(known, -0.5 * np.log(2 * np.pi * var) - 0.5 * (x - mean) ** 2 / var, 0.0).sum(axis=1)


def fit_mixture(cells: np.ndarray, counts: np.ndarray, keep: np.ndarray | None = None, extra: np.ndarray | None = None, ridge: float = 0.03, rounds: int = 200) -> tuple[Mixture, np.ndarray]:
    """EM over counted cells.

    ``keep`` is the share of each cell's posterior that stays, ``extra`` what
    transitivity adds to it or takes off, as a mean over the cell's pairs. Begins
    with pairs that agree on the mean of their known dimensions. ``ridge`` is added
    to every variance. Returns the mixture and the posterior of each cell.
    """
    x, known = _values(cells)
    keep = np.ones(len(cells)) if keep is None else keep
    extra = np.zeros(len(cells)) if extra is None else extra
    level = (x * known).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
    clash = ((cells[:, 0] >= 0) & (x[:, 0] < 0.75)) | (cells[:, 3] == 0)
    post = np.where((level > 0.6) & ~clash, 0.95, 0.05)
    mix = Mixture(0.5, np.zeros((2, x.shape[1])), np.ones((2, x.shape[1])))
    for _ in range(rounds):
        held = np.clip(post * keep + extra, 0, 1)
        weights = np.stack([held, 1 - held]) * counts
        mean, var = np.zeros((2, x.shape[1])), np.zeros((2, x.shape[1]))
        for k in (0, 1):
            w = weights[k][:, None] * known
            n = np.maximum(w.sum(axis=0), 1e-9)
            mean[k] = (w * x).sum(axis=0) / n
            var[k] = (w * (x - mean[k]) ** 2).sum(axis=0) / n + ridge
        share = float(np.clip(weights[0].sum() / max(weights.sum(), 1e-9), 1e-4, 1 - 1e-4))
        mix = Mixture(share, mean, var)
        odds = np.log(share / (1 - share)) + _log_density(x, known, mean[0], var[0]) - _log_density(x, known, mean[1], var[1])
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return mix, post * keep


def _scored(spark: SparkSession, pairs: DataFrame, v: list[int], post: np.ndarray) -> DataFrame:
    """Pairs with their cell's posterior ``p``; the table of cells is bounded by the steps of the vector."""
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(v, post)], "v int, p double")
    return pairs.join(F.broadcast(table), "v")


def _odds(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))


def _labels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``rid, root`` of every record in a group of two or more, matches with an end that says less).

    No two records that exclude each other meet: records that name themselves,
    their trade and their state (``fa``, ``fb``) are joined by their own matches.
    Every other record goes, step by step until none is added, to the one group its
    matches speak for most (equal claims: to none); the rest join each other.
    """
    sure = components(edges.where("fa AND fb"), "a", "b", EDGES_PER_TASK)
    groups = cut(sure.select(F.col("node").alias("rid"), "root"), "match-labels")
    half = cut(edges.where("NOT (fa AND fb)"), "match-edges")
    loose = half.where("NOT fa").select("a", "b", "fb", "w").unionByName(half.where("NOT fb").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("fa").alias("fb"), "w"))
    told = groups.select(F.col("rid").alias("b"), "root")
    claims = loose.where("fb").join(told, "b", "left").select("a", F.coalesce("root", "b").alias("root"), "w")
    placed = cut(_best_claims(claims), "match-placed")
    # only lesser records that no full one took, and their matches, go on
    open_ = cut(loose.where("NOT fb").join(placed.select(F.col("rid").alias("a")), "a", "left_anti").select("a", "b", "w"), "match-open")
    fresh, steps = placed, [placed]
    while True:
        claims = open_.join(fresh.select(F.col("rid").alias("b"), "root"), "b").select("a", "root", "w")
        # all claims of a record that some fresh one claims count, those of earlier steps were none or equal
        touched = claims.select("a").distinct()
        earlier = reduce(DataFrame.unionByName, steps)
        every = open_.join(touched, "a", "left_semi").join(earlier.select(F.col("rid").alias("b"), "root"), "b").select("a", "root", "w")
        more = cut(_best_claims(every), "match-placed")
        if not more.take(1):
            break
        steps.append(more)
        fresh = more
        rest = cut(open_.join(more.select(F.col("rid").alias("a")), "a", "left_anti"), "match-open")
        drop(open_)
        open_ = rest
    placed = reduce(DataFrame.unionByName, steps)
    left = half.where("NOT fa AND NOT fb").select("a", "b").join(placed.select(F.col("rid").alias("a")), "a", "left_anti").join(placed.select(F.col("rid").alias("b")), "b", "left_anti")
    rest = components(left, "a", "b", EDGES_PER_TASK).select(F.col("node").alias("rid"), "root")
    # a full record that was alone so far belongs to the group that others joined
    alone = placed.select(F.col("root").alias("rid")).distinct().join(groups.select("rid"), "rid", "left_anti").select("rid", F.col("rid").alias("root"))
    out = cut(groups.unionByName(placed).unionByName(rest).unionByName(alone.join(rest.select("rid"), "rid", "left_anti")).distinct(), "match-groups")
    drop(groups, open_, *steps)
    return out, half


def _best_claims(claims: DataFrame) -> DataFrame:
    """``rid, root``: the group with the largest sum of log odds; none if two are equal."""
    sums = claims.groupBy("a", "root").agg(F.round(F.sum("w"), 6).alias("w"))
    best = sums.groupBy("a").agg(F.max(F.struct("w", "root")).alias("hi"), F.min(F.struct((-F.col("w")).alias("w"), "root")).alias("lo"))
    return best.where("hi.root = lo.root").select(F.col("a").alias("rid"), F.col("hi.root").alias("root"))


def _with_roots(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    for e in "ab":
        pairs = pairs.join(labels.select(F.col("rid").alias(e), F.col("root").alias(f"r{e}")), e, "left")
    return pairs


def transitive(scored: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The groups (``rid, root``) of the scored pairs and the pairs (``a, b, v, p, q``) whose posterior ``p`` becomes ``q``.

    ``scored`` has ``a, b, v, p`` and ``fa, fb``: whether the ends say everything.
    Every pair of one group then has a posterior of ``threshold`` or more, every
    other one less. Each round but the last lowers at least one match, so it ends.
    """
    near = 1 - 1e-9
    lowered: DataFrame | None = None
    labels = half = None
    while True:
        now = scored if lowered is None else scored.join(lowered.select("a", "b", F.col("q").alias("_q")), ["a", "b"], "left").withColumn("p", F.coalesce("_q", "p")).drop("_q")
        edges = now.where(F.col("p") >= threshold).withColumn("w", _odds(F.col("p")))
        if lowered is None:
            labels, half = _labels(edges)
        else:
            # only groups that lost a match are formed again, each from the matches between its records
            torn = sendable(_with_roots(drops.select("a", "b"), labels).select(F.explode(F.array("ra", "rb")).alias("root")).dropna().distinct())
            nodes = sendable(labels.join(torn, "root", "left_semi").select(F.col("rid").alias("a")))
            inner = cut(edges.join(nodes, "a", "left_semi").join(nodes.withColumnRenamed("a", "b"), "b", "left_semi"), "match-edges")
            again, half_again = _labels(inner)
            gone = inner.select("a", "b").unionByName(drops.select("a", "b"))
            old = labels, half
            labels = cut(labels.join(torn, "root", "left_anti").select("rid", "root").unionByName(again), "match-groups")
            half = cut(half.join(gone, ["a", "b"], "left_anti").unionByName(half_again.select(half.columns)), "match-edges")
            drop(*old, again, half_again, inner, drops)
        # a match once lowered is no new violation where other matches keep its ends together
        inside = cut(_with_roots(now.where(F.col("p") < threshold), labels).where("ra = rb").select("a", "b", "v", "p"), "match-conflicts")
        fresh = inside if lowered is None else inside.join(lowered, ["a", "b"], "left_anti")
        nodes = sendable(fresh.select(F.explode(F.array("a", "b")).alias("x")).distinct())
        one = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "p").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "p")).join(nodes, "x", "left_semi")
        one = cut(one, "match-sides")
        left = one.select(F.col("x").alias("a"), F.col("y").alias("m"), F.col("p").alias("pa"))
        right = one.select(F.col("x").alias("b"), F.col("y").alias("m"), F.col("p").alias("pb"))
        triangles = fresh.join(left, "a").join(right, ["b", "m"])
        against = -_odds(F.col("p")) > F.least(_odds(F.col("pa")), _odds(F.col("pb")))
        judged = cut(triangles.select("a", "b", "v", "m", "p", "pa", "pb", against.alias("against")), "match-triangles")
        weaker = F.col("pa") <= F.col("pb")
        end = F.when(weaker, F.col("a")).otherwise(F.col("b"))
        drops = judged.where("against").select(F.least(end, "m").alias("a"), F.greatest(end, "m").alias("b"), F.least(F.col("p") / F.greatest("pa", "pb"), F.lit(threshold * near)).alias("q"))
        drops = cut(drops.groupBy("a", "b").agg(F.min("q").alias("q")), "match-lowered")
        if not drops.take(1):
            break
        more = drops if lowered is None else drops.unionByName(lowered)
        kept = cut(more.groupBy("a", "b").agg(F.min("q").alias("q")), "match-lowered")
        drop(inside, one, judged, *([] if lowered is None else [lowered]))
        lowered = kept
    best = judged.groupBy("a", "b").agg(F.max(F.col("pa") * F.col("pb")).alias("best"))
    raised = inside.join(best, ["a", "b"], "left").select("a", "b", F.greatest(F.coalesce("best", F.lit(threshold)), F.lit(threshold)).alias("q"))
    # matches whose ends came into different groups keep the share that their group has of the record's claims
    lost = cut(_with_roots(half, labels).where("ra IS NULL OR rb IS NULL OR ra <> rb").select("a", "b", "fa", "fb", "p"), "match-lost")
    torn = sendable(lost.where("NOT fa").select(F.col("a").alias("x")).unionByName(lost.where("NOT fb").select(F.col("b").alias("x"))).distinct())
    loose = half.where("NOT fa").select(F.col("a").alias("x"), F.col("b").alias("y"), "w").unionByName(half.where("NOT fb").select(F.col("b").alias("x"), F.col("a").alias("y"), "w")).join(torn, "x", "left_semi")
    claims = loose.join(labels.select(F.col("rid").alias("y"), "root"), "y", "left").withColumn("root", F.coalesce("root", "y"))
    sums = claims.groupBy("x", "root").agg(F.sum("w").alias("w"))
    top = sums.groupBy("x").agg(F.max("w").alias("top"))
    sums = sums.join(top, "x").withColumn("e", F.exp(F.col("w") - F.col("top")))
    share = sums.join(sums.groupBy("x").agg(F.sum("e").alias("all")), "x").select("x", "root", (F.col("e") / F.col("all")).alias("share"))
    of_pair = claims.join(share, ["x", "root"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "share").groupBy("a", "b").agg(F.min("share").alias("share"))
    torn_pairs = lost.join(of_pair, ["a", "b"]).select("a", "b", F.least(F.col("p") * F.col("share"), F.lit(threshold * near)).alias("q"))
    parts = [raised, torn_pairs] + ([] if lowered is None else [lowered])
    # a lowered match between records that other matches keep together is raised again like any pair of a group
    changed = reduce(DataFrame.unionByName, [p.withColumn("rank", F.lit(k)) for k, p in enumerate(parts)]).groupBy("a", "b").agg(F.min(F.struct("rank", "q")).alias("r")).select("a", "b", F.col("r.q").alias("q"))
    corrections = cut(changed.join(scored.select("a", "b", "v", "p"), ["a", "b"]).select("a", "b", "v", "p", "q"), "match-corrections")
    drop(half, inside, one, judged, drops, lost, *([] if lowered is None else [lowered]))
    return labels, corrections


def settle(scored: DataFrame, threshold: float = 0.5, most: int = MOST_IN_TASK) -> tuple[DataFrame, DataFrame]:
    """The same as ``transitive``: components of up to ``most`` pairs are settled whole inside a task, larger ones by joins.

    No step of it leaves the records that matches connect, so a component's own pairs are all it needs.
    """
    edges = scored.where(F.col("p") >= threshold)
    whole = cut(components(edges, "a", "b", EDGES_PER_TASK), "match-components")
    of_a = scored.join(whole.select(F.col("node").alias("a"), "root"), "a")
    apart = of_a.where(F.col("p") < threshold).join(whole.select(F.col("node").alias("b"), F.col("root").alias("_r")), "b").where("root = _r")
    inner = of_a.where(F.col("p") >= threshold).unionByName(apart.drop("_r"))
    inner = cut(inner.select("root", "a", "b", "v", "p", "fa", "fb"), "match-inner")
    large = sendable(heavy(inner, "root", most))
    some = bool(large.take(1))
    usual = inner.join(large, "root", "left_anti") if some else inner
    laid = usual.repartition("root").sortWithinPartitions("root")
    out = cut(laid.mapInArrow(settling(threshold), SHAPE), "match-settled")
    labels, corrections = out.where("v IS NULL").select(F.col("a").alias("rid"), F.col("b").alias("root")), out.where("v IS NOT NULL")
    done = [out]
    if some:
        more, fixed = transitive(inner.join(large, "root", "left_semi").drop("root"), threshold)
        labels, corrections = labels.unionByName(more), corrections.unionByName(fixed)
        done += [more, fixed]
    drop(whole, inner, large)
    labels._settled = done
    return labels, corrections


class Match(NamedTuple):
    """Outcome: record groups, scored pairs, the fitted mixture."""

    groups: DataFrame
    pairs: DataFrame
    mixture: Mixture | None


def match_records(records: DataFrame, most: int = MOST_IN_BLOCK, threshold: float = 0.5) -> Match:
    """Groups of records of one company (``rid, feed, root``) and the scored candidate pairs (``a, b, posterior``).

    Redelivered rows count once; rows without an id not at all. A null, blank or
    stand-in value says nothing. ``groups`` leaves out records that stay alone. A
    pair's posterior is ``threshold`` or more exactly if both records are in one
    group. An empty table gives empty results.
    """
    spark = records.sparkSession
    rows = prepared(records)
    pairs = id_pairs(rows, most)
    counted = pairs.groupBy("v").count().collect()  # at most the product of SIZES
    if not counted:
        empty = _named_ends(pairs.select("a", "b"), rows).withColumn("posterior", F.lit(0.0))
        return Match(rows.select("rid", "feed", F.col("id").alias("root")).limit(0), empty, None)
    counted.sort(key=lambda r: r.v)
    v = [r.v for r in counted]
    cells, counts = unpacked(np.array(v)), np.array([r["count"] for r in counted], dtype=float)
    mix, post = fit_mixture(cells, counts)
    tried: set[bytes] = set()  # sets of matching cells; one that comes again ends the loop, as it would repeat itself
    while True:
        tried.add((post >= threshold).tobytes())
        scored = _scored(spark, pairs, v, post).select("a", "b", "v", "p", (F.col("f") >= 2).alias("fa"), (F.col("f") % 2 == 1).alias("fb"))
        labels, corrections = settle(scored, threshold)
        moved = {r.v: r.d for r in corrections.groupBy("v").agg(F.sum(F.col("q") - F.col("p")).alias("d")).collect()}
        extra = np.array([moved.get(c, 0.0) / n for c, n in zip(v, counts)])
        next_mix, next_post = fit_mixture(cells, counts, None, extra)
        if (next_post >= threshold).tobytes() in tried:
            break
        mix, post = next_mix, next_post
        drop(*labels._settled)
    groups = rows.select("id", "rid", "feed").join(labels.withColumnRenamed("rid", "id"), "id").select("rid", "feed", "root")
    final = scored.select("a", "b", "p").join(corrections.select("a", "b", "q"), ["a", "b"], "left").select("a", "b", F.coalesce("q", "p").alias("posterior"))
    return Match(groups, _named_ends(final, rows), mix)


def found_pairs(groups: DataFrame) -> DataFrame:
    """``record_a, record_b``: pairs of one group from different feeds."""
    left = groups.select("root", F.col("rid").alias("record_a"), F.col("feed").alias("fa"))
    right = groups.select("root", F.col("rid").alias("record_b"), F.col("feed").alias("fb"))
    return left.join(right, "root").where("record_a < record_b AND fa <> fb").select("record_a", "record_b")
