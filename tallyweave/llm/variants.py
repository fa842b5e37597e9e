"""Spellings of names typed by people, linked by merging and matching again.

Records start as profiles of one spelling, one trade and one state. Profiles are
blocked on their spellings, lines and sites and scored; what matches is merged, and
a merged profile unions spellings, initials, lines, sites and facts, so it stands in
all blocks of its parts and meets every partner that any of them met, with the
best likeness of all their spellings. Rounds go on until nothing merges.

A block never changes but for the profiles that stand in it, so the pairs of all
blocks are laid out once, between first profiles; a round puts merged profiles in
the place of their parts, joins pairs that have become one, and measures spellings
of merged profiles with a common line or site anew.

A profile that tells its trade and its state merges with every like profile of
the same trade and state. One that tells less joins a single partner: the one
its likeness speaks for most; with equal claims it waits for a later round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.blocking import MOST_IN_BLOCK, bounded_pairs, heavy, parted_pairs, sendable, whole_pairs
from tallyweave.llm.components import components
from tallyweave.llm.matching import EDGES_PER_TASK, LIKE, _shared_contacts, _without_contacts, prepared
from tallyweave.llm.names import parsed_spellings
from tallyweave.llm.spelled import like_spellings, name_likeness
from tallyweave.session import cut, drop

ALIKE = LIKE  # score from which profiles merge
CANDIDATE = ALIKE - 0.0001  # likeness from which names alone may do (scores are rounded); with a line or site the score itself decides
LINE, SITE = 0.1, 0.15  # what a common line or site adds
ODD = 0.15  # what given names without a common initial take off
FACTS = ("fam", "state", "ini")


def spellings(records: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Prepared records that name themselves; further spellings of them from the review queue).

    The first has the spelling of ``name`` or ``dba``. Names in the queue are parsed
    only where they differ from the record's own, told by two hashes of 96 bits.
    """
    rows = prepared(records).where("sid IS NOT NULL")
    sides = [queue.select(F.col(f"record_{s}").alias("rid"), F.col(f"name_{s}").alias("name")) for s in "ab"]
    typed = sides[0].unionByName(sides[1]).dropna().distinct()

    def marks(rid: str, name: str) -> list[Column]:
        return [F.xxhash64(rid, name).alias("_h"), F.hash(rid, name).alias("_g")]

    typed = typed.select("rid", "name", *marks("rid", "name")).join(records.select(*marks("record_id", "name")), ["_h", "_g"], "left_anti")
    more = parsed_spellings(typed.select("rid", "name")).where("w1 <> ''").withColumn("sid", F.xxhash64("w1", "w2"))
    return rows, cut(more.join(rows.select("rid", "id", F.col("state")), "rid").select("id", "sid", "w1", "w2", "fam", "ini", "state"), "typed-names")


def _facts() -> list[Column]:
    return [F.max("fam").alias("fam"), F.max("state").alias("state"), F.bit_or("ini").alias("ini")]


def _compatible(a: str, b: str) -> Column:
    """Neither the trades nor the states of two profiles exclude each other."""
    fa, fb, sa, sb = (F.col(f"{s}.{f}") for f in ("fam", "state") for s in (a, b))
    return ((fa == fb) | (fa == 0) | (fb == 0)) & (sa.isNull() | sb.isNull() | (sa == sb))


def _told(pairs: DataFrame, like: Column, line: Column, site: Column) -> DataFrame:
    """Pairs ``a, b`` of profile structs as ``p, q`` (p < q) with the facts ``x, y`` of both."""
    swap = F.col("a.pid") > F.col("b.pid")
    facts = [F.struct(*[F.col(f"{s}.{f}").alias(f) for f in FACTS]) for s in "ab"]
    some = pairs.where((F.col("a.pid") != F.col("b.pid")) & _compatible("a", "b"))
    return some.select(
        F.least("a.pid", "b.pid").alias("p"), F.greatest("a.pid", "b.pid").alias("q"), F.when(swap, facts[1]).otherwise(facts[0]).alias("x"), F.when(swap, facts[0]).otherwise(facts[1]).alias("y"),
        like.cast("double").alias("like"), line.cast("int").alias("line"), site.cast("int").alias("site"),
    )


def _joined(pairs: DataFrame) -> DataFrame:
    """Pairs met several times as one, with the best likeness and all that they share."""
    return pairs.groupBy("p", "q").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("like").alias("like"), F.max("line").alias("line"), F.max("site").alias("site"))


def _measured(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``pairs`` with the best likeness over all spellings of both profiles; ``names`` has ``pid, w1, w2``."""
    one, two = (names.select(F.col("pid").alias(p), F.struct("w1", "w2").alias(u)) for p, u in (("p", "u"), ("q", "v")))
    each = pairs.select("p", "q").join(one, "p").join(two, "q")
    best = each.select("p", "q", name_likeness(F.col("u.w1"), F.col("u.w2"), F.col("v.w1"), F.col("v.w2")).alias("_like")).groupBy("p", "q").agg(F.max("_like").alias("_like"))
    return pairs.join(best, ["p", "q"], "left").withColumn("like", F.greatest("like", "_like")).drop("_like")


def _scored(pairs: DataFrame) -> DataFrame:
    """``p, q, score, fp, fq`` of compatible profile pairs that may merge."""
    both = pairs.where(_compatible("x", "y") & F.col("like").isNotNull())
    odd = (F.col("x.ini") != 0) & (F.col("y.ini") != 0) & (F.col("x.ini").bitwiseAND(F.col("y.ini")) == 0)
    score = F.col("like") + LINE * F.col("line") + SITE * F.col("site") - F.when(odd & (F.col("like") < 1), F.lit(ODD)).otherwise(F.lit(0.0))
    full = [(F.col(f"{s}.fam") != 0) & F.col(f"{s}.state").isNotNull() for s in "xy"]
    return both.select("p", "q", F.round(score, 4).alias("score"), full[0].alias("fp"), full[1].alias("fq")).where(F.col("score") >= ALIKE)


def _first_pairs(profiles: DataFrame, names: DataFrame, held: DataFrame, words: DataFrame, alike: DataFrame, most: int, large: bool) -> DataFrame:
    """The pairs of all blocks of first profiles; ``profiles`` has ``pid`` and facts, ``held`` ``h, kind, pid``.

    ``large``: a line or site may be on more than ``most`` profiles.

    A spelling of very many profiles meets others through its smallest profile of
    each trade and state only, and its profiles of different trade or state meet each
    other through these as well.
    """
    fields = ("pid", *FACTS)
    said = cut(names.join(profiles, "pid").select("sid", *fields), "said")
    big = sendable(heavy(said, "sid", most))
    equal = _told(parted_pairs(said, "sid", ("fam", "state"), fields, most, frequent=big), F.lit(1.0), F.lit(0), F.lit(0))
    heads = said.join(big, "sid", "left_semi").groupBy("sid", "fam", "state").agg(F.min(F.struct(*fields)).alias("r")).select("sid", "r")
    sides = said.join(big, "sid", "left_anti").select("sid", F.struct(*fields).alias("r")).unionByName(heads)
    crossed = alike.join(sides.select(F.col("sid").alias("s"), F.col("r").alias("a")), "s").join(sides.select(F.col("sid").alias("t"), F.col("r").alias("b")), "t")
    like = _told(crossed, F.col("like"), F.lit(0), F.lit(0))
    at = held.join(profiles, "pid").select("h", "kind", *fields)
    met = whole_pairs(at, "h", ("pid", "kind", *FACTS), most) if large else bounded_pairs(at, "h", ("pid", "kind", *FACTS))
    shared = _told(met.select("a", "b"), F.lit(None), F.col("a.kind") == 0, F.col("a.kind") == 1)
    pairs = cut(_joined(equal.unionByName(like).unionByName(shared)), "profile-pairs")
    bare = pairs.where("like IS NULL")
    out = cut(pairs.where("like IS NOT NULL").unionByName(_measured(bare, words)), "profile-pairs")
    drop(pairs, said)
    return out


def link_spellings(records: DataFrame, queue: DataFrame, most: int = MOST_IN_BLOCK) -> DataFrame:
    """``rid, feed, root``: the records that print a spelling of their trading name, by entity.

    Stand-ins, blanks, generic names and names of a holding company alone are no
    spellings; such records are left out. Redelivered rows count once, rows without
    an id not at all. Empty tables give an empty result.
    """
    rows, typed = spellings(records, queue)
    said = sendable(typed.groupBy("id").agg(F.max("fam").alias("_f"), F.bit_or("ini").alias("_i")))
    fam = F.when(F.col("fam") != 0, F.col("fam")).otherwise(F.coalesce("_f", F.col("fam")))
    facts = rows.join(said, "id", "left").withColumn("fam", fam).withColumn("ini", F.col("ini").bitwiseOR(F.coalesce("_i", F.lit(0))))
    facts = cut(facts.select("id", "sid", "w1", "w2", *FACTS, "phone", "host", F.xxhash64("sid", "fam", F.coalesce("state", F.lit(""))).alias("seed")), "name-facts")
    first = cut(facts.groupBy("seed").agg(F.min("id").alias("pid"), F.min("sid").alias("sid"), *_facts()), "first-profiles")
    members = cut(facts.select("id", "seed", "phone", "host", "state").join(first.select("seed", "pid"), "seed").drop("seed"), "profile-members")
    names = cut(first.select("pid", "sid").unionByName(typed.join(members.select("id", "pid"), "id").select("pid", "sid")).distinct(), "profile-names")
    words = facts.select("sid", "w1", "w2", "state").unionByName(typed.select("sid", "w1", "w2", "state"))
    alike = like_spellings(words, CANDIDATE)
    spelled = cut(words.groupBy("sid").agg(F.min(F.struct("w1", "w2")).alias("w")).select("sid", "w.w1", "w.w2"), "spelled")
    shared, large = _shared_contacts(facts, most)
    own = _without_contacts(members, shared)
    kinds = F.array(*[F.struct(F.xxhash64(F.lit(k), F.col(k)).alias("h"), F.lit(i).alias("kind"), F.col(k).alias("v")) for i, k in enumerate(("phone", "host"))])
    held = own.select("pid", F.explode(kinds).alias("c")).where("c.v IS NOT NULL").select("c.h", "c.kind", "pid").distinct()
    profiles = cut(first.select(F.col("pid").alias("part"), "pid", *FACTS), "profiles")
    pairs = _first_pairs(profiles.drop("part"), names, held, names.join(spelled, "sid"), alike, most, large)
    drop(facts, first, alike)
    while True:  # ends, as every round but the last leaves fewer profiles
        scored = cut(_scored(pairs), "profile-scores")
        joins = _joins(scored, final=False)
        if not joins.take(1):
            joins = _joins(scored, final=True)
        moves = cut(components(joins, "p", "q", EDGES_PER_TASK).select(F.col("node").alias("pid"), "root"), "profile-moves")
        if not moves.take(1):
            break
        sent = sendable(moves)
        moved = cut(profiles.join(sent, "pid", "left").select("part", F.coalesce("root", "pid").alias("pid"), *FACTS, F.col("root").isNotNull().alias("grown")), "profiles")
        grown = moved.where("grown").groupBy("pid").agg(*_facts()).select(F.col("pid").alias("root"), F.struct(*FACTS).alias("facts"))
        changes = sendable(moves.join(grown, "root"))
        for e, facts_of in (("p", "x"), ("q", "y")):
            mine = changes.select(F.col("pid").alias(e), F.col("root").alias(f"r{e}"), F.col("facts").alias(f"f{e}"))
            pairs_now = (pairs if e == "p" else pairs_now).join(mine, e, "left").withColumn(e, F.coalesce(f"r{e}", e)).withColumn(facts_of, F.coalesce(f"f{e}", facts_of))
        swap = F.col("p") > F.col("q")
        placed = pairs_now.where("p <> q").select(
            F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"),
            "like", "line", "site", (F.col("rp").isNotNull() | F.col("rq").isNotNull()).alias("new"),
        )
        joined = placed.where(_compatible("x", "y")).groupBy("p", "q").agg(*[F.max(c).alias(c) for c in ("x", "y", "like", "line", "site", "new")])
        joined = cut(joined, "profile-pairs")
        again = F.col("new") & (F.col("line") + F.col("site") > 0) & (F.coalesce("like", F.lit(0.0)) < CANDIDATE)
        some = cut(joined.where(again).drop("new"), "measured-again")
        if some.take(1):
            who = sendable(some.select(F.explode(F.array("p", "q")).alias("pid")).distinct())
            theirs = moved.join(who, "pid", "left_semi").select("part", "pid").join(names.withColumnRenamed("pid", "part"), "part").join(spelled, "sid").select("pid", "w1", "w2").distinct()
            after = cut(joined.where(~again).drop("new").unionByName(_measured(some, theirs)), "profile-pairs")
            drop(joined)
        else:
            after = joined.drop("new")
            after._cut_path = joined.__dict__.pop("_cut_path")
        drop(pairs, profiles, scored, moves, some)
        pairs, profiles = after, moved
    labels = members.select("id", F.col("pid").alias("part")).join(profiles.select("part", F.col("pid").alias("root")), "part").select("id", "root")
    return rows.select("id", "rid", "feed").join(labels, "id").select("rid", "feed", "root")


def _joins(scored: DataFrame, final: bool) -> DataFrame:
    """Pairs to merge: all between full profiles; each other profile with its one best full partner.

    At last, profiles that tell less join each other too, where no full partner is left.
    """
    full = scored.where("fp AND fq").select("p", "q")
    half = scored.where("fp <> fq").select(F.when(F.col("fp"), F.col("q")).otherwise(F.col("p")).alias("lesser"), F.when(F.col("fp"), F.col("p")).otherwise(F.col("q")).alias("fuller"), "score")
    best = half.groupBy("lesser").agg(F.max(F.struct("score", "fuller")).alias("hi"), F.min(F.struct((-F.col("score")).alias("score"), "fuller")).alias("lo"))
    clear = best.where("hi.fuller = lo.fuller").select(F.col("lesser").alias("p"), F.col("hi.fuller").alias("q"))
    out = [full, clear]
    if final:
        taken = half.select(F.col("lesser").alias("pid")).distinct()
        loose = scored.where("NOT fp AND NOT fq").join(taken.withColumnRenamed("pid", "p"), "p", "left_anti").join(taken.withColumnRenamed("pid", "q"), "q", "left_anti")
        out.append(loose.select("p", "q"))
    return reduce(DataFrame.unionByName, out)


def found_variants(linked: DataFrame, queue: DataFrame) -> DataFrame:
    """``record_a, record_b``: records of one entity that are of the same feed or side by side in the queue."""
    left = linked.select("root", "feed", F.col("rid").alias("record_a"))
    right = linked.select("root", "feed", F.col("rid").alias("record_b"))
    of_feed = left.join(right, ["root", "feed"]).where("record_a < record_b").select("record_a", "record_b")
    shown = queue.where("record_a <> record_b").select(F.least("record_a", "record_b").alias("record_a"), F.greatest("record_a", "record_b").alias("record_b")).distinct()
    beside = shown.join(left.select("record_a", F.col("root").alias("ra"), F.col("feed").alias("fa")), "record_a").join(right.select("record_b", F.col("root").alias("rb"), F.col("feed").alias("fb")), "record_b")
    return of_feed.unionByName(beside.where("ra = rb AND fa <> fb").select("record_a", "record_b"))
