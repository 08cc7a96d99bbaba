"""Linking rows inside buckets and finding connected components, in DataFrame functions.

Neither function collects rows to the driver; each step is an aggregation or a join
by key whose one side holds each key once, so that Spark may split hot keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import discard, stash

#: A bucket of at most so many members is compared exhaustively.
SMALL = 24
MAX_ROUNDS = 40
#: Members of a family that meet their centre's set in one group.
BLOCK = 256
#: Longs of a sketch.
WORDS = 16
#: Buckets of at most so many members cost less to verify than to sketch.
PLAIN = 8
#: Rounds of stars around members that a centre leaves apart, and hubs that a member meets in each if its group is uniform.
STAR_ROUNDS, HUBS = 3, 4


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), two columns of one ordered type.

    Returns (id, component) for every id that stands in an edge; component is the
    least id. Alternates large-star and small-star (Kiveris et al., 2014) on written
    tables until the edges are stars, or raises after MAX_ROUNDS; repeated edges and loops are harmless."""
    current = stash(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name="edges"
    )
    for _ in range(MAX_ROUNDS):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stash(large, name="edges")
        discard(current)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        current = stash(small, name="edges")
        discard(large)
        if _are_stars(current):
            break
    else:
        raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or out = 1 and in = 1").isEmpty()


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after further links (a, b): only components are joined."""
    name = found.select(F.col("id").alias("x"), F.col("component").alias("cx"))
    left = links.join(name.withColumnsRenamed({"x": "a", "cx": "ca"}), "a", "left")
    both = left.join(name.withColumnsRenamed({"x": "b", "cx": "cb"}), "b", "left")
    ends = both.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnsRenamed({"id": "old", "component": "new"})
    every = found.union(ends.select("a", "ca")).union(ends.select("b", "cb")).distinct()
    known = every.join(joined, every["component"] == joined["old"], "left")
    return known.select("id", F.coalesce("new", "component").alias("component"))


def spokes(sized: DataFrame) -> DataFrame:
    """(bucket, center, id, n, rank) of members, with sa and sb where they have a sign: a star in
    every bucket; rank is the centre's. Its centre is the member that stands in most buckets (``seen``), so the
    most typical one (ties: the heaviest, then the greatest id)."""
    carried = [c for c in ("id", "sign") if c in sized.columns]
    typical = sized.groupBy("bucket").agg(F.max(F.struct("seen", "weight", *carried)).alias("c"))
    signs = [F.col("c.sign").alias("sa"), F.col("sign").alias("sb")] if "sign" in carried else []
    return sized.join(typical, "bucket").select("bucket", F.col("c.id").alias("center"), "id", "n", F.struct("c.seen", "c.weight").alias("rank"), *signs)


def sketches(sets: DataFrame) -> DataFrame:
    """(id, k, odd) of sets (id, s), ids once: a set's size and, for each of 64 * WORDS bits,
    whether an odd number of its elements falls there (odd sketches, Mitzenmacher et al.,
    2014). What two sets share cancels out: their sketches differ in at most as many bits
    as there are elements in one of the sets only."""
    each = sets.select("id", F.explode("s").alias("x"))
    bit = F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit")
    placed = each.select("id", bit, F.shiftrightunsigned("x", 6).bitwiseAND(F.lit(WORDS - 1)).cast("int").alias("word"))
    odd = [F.expr(f"bit_xor(bit) FILTER (WHERE word = {w})").alias(f"w{w}") for w in range(WORDS)]
    made = placed.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("k"), *odd)
    return made.select("id", "k", F.struct(*(F.coalesce(f"w{w}", F.lit(0).cast("long")).alias(f"w{w}") for w in range(WORDS))).alias("odd"))


def may_link(k: Column, odd: Column, k2: Column, odd2: Column, percent: int) -> Column:
    """False only where two sets cannot link: J >= t needs that at most (1 - t) / (1 + t) of
    the elements of both stand in one set only, and sketches never show more than that."""
    apart = F.lit(0)
    for w in range(WORDS):
        apart = apart + F.bit_count(odd[f"w{w}"].bitwiseXOR(odd2[f"w{w}"]))
    return apart * (100 + percent) <= (k + k2) * (100 - percent)


def bucket_components(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    sets_of: Callable[[DataFrame], DataFrame],
    *,
    percent: int,
    small: int = SMALL,
    agree: Callable[[Column, Column], Column] | None = None,
    sketched: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Components of the links that ``verify`` (pairs (a, b) in, links (a, b) out)
    confirms among members of shared buckets, ids once per bucket: (bucket, id, weight, n,
    seen), n being the bucket's members and seen the buckets that an id stands in. They
    are read several times, so hand over a written table. Returns (components, links), the
    links being those that were looked for: enough to tell components.

    1. Every bucket gives a star, which joins a group of near copies with as many pairs as
       it has members.
    2. Buckets of up to ``small`` members give all pairs that are still in two components.
    3. In larger ones ``beyond_centers`` names all pairs that can link from the members'
       sets (``sets_of``: ids (id) in, (id, s) out, s an array of distinct longs), so no
       link of a bucket is lost, however large it is. Buckets whose centres are of one
       component are taken together, with the most typical centre.

    ``agree`` tells by two values of the column ``sign`` whether a pair is worth
    comparing; it is asked inside the joins, so no other pair is written. With ``sketched``
    the pairs of step 2 are also held against ``sketches`` of their sets there (buckets over
    ``PLAIN`` members), which leaves out most pairs below the threshold and none above."""
    star = spokes(members)
    pairs = star.filter("id <> center")
    if agree is not None:
        pairs = pairs.filter(agree(F.col("sa"), F.col("sb")))
    links = stash(verify(pairs.select(F.least("id", "center").alias("a"), F.greatest("id", "center").alias("b")).distinct()), name="links")
    found = stash(components(links), name="components")

    labelled = members.filter("n > 2").join(found, "id", "left").withColumn("own", F.coalesce("component", "id")).drop("component", "weight", "seen")
    labelled = stash(labelled, name="labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo <> hi").select("bucket")
    few = labelled.filter(F.col("n") <= small).join(open_, "bucket")
    if sketched:
        if agree is not None:
            # sketches are made of members only that have someone to be compared with
            partner = few.select(*(F.col(c).alias(f"{c}_2") for c in ("bucket", "id", "own", "sign")))
            meets = (F.col("bucket") == F.col("bucket_2")) & (F.col("id") != F.col("id_2")) & (F.col("own") != F.col("own_2"))
            few = few.join(partner, meets & agree(F.col("sign"), F.col("sign_2")), "left_semi")
        few = stash(few, name="few")
        wanted = few.filter(F.col("n") > PLAIN).select("id").distinct()
        few = few.join(stash(sketches(sets_of(wanted)), name="sketches"), "id", "left")
    names = [c for c in ("id", "own", "sign", "k", "odd") if c in few.columns]
    one = few.select("bucket", *(F.col(c).alias(f"{c}_a") for c in names))
    two = few.select("bucket", *(F.col(c).alias(f"{c}_b") for c in names))
    met = one.join(two, "bucket").filter("id_a < id_b and own_a <> own_b")
    if agree is not None:
        met = met.filter(agree(F.col("sign_a"), F.col("sign_b")))
    if sketched:
        ruled = may_link(F.col("k_a"), F.col("odd_a"), F.col("k_b"), F.col("odd_b"), percent)
        met = met.filter(F.coalesce(ruled, F.lit(True)))
    more = met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()

    large = labelled.filter(F.col("n") > small)
    if not large.isEmpty():
        family = spokes(members.filter(F.col("n") > small)).select("center", "id", "rank").distinct()
        own = family.join(found, "id", "left").select("center", "id", "rank", F.coalesce("component", "id").alias("own"))
        own = stash(own, name="family")
        # centres of one component stand for one group: the most typical of them takes all
        homes = found.select(F.col("id").alias("center"), F.col("component").alias("home"))
        centers = own.groupBy("center").agg(F.max("rank").alias("rank")).join(homes, "center", "left").withColumn("home", F.coalesce("home", "center"))
        heads = centers.groupBy("home").agg(F.max(F.struct("rank", "center"))["center"].alias("head"))
        named = centers.join(heads, "home").select("center", "home", "head")
        placed = own.join(named, "center").select(F.col("head").alias("center"), "id", "own", (F.col("own") != F.col("home")).alias("apart")).distinct()
        placed = stash(placed, name="placed")
        placed = stash(placed.join(placed.filter("apart").select("center").distinct(), "center"), name="open")
        if not placed.isEmpty():
            wanted = placed.select("id").union(placed.select(F.col("center").alias("id"))).distinct()
            more = more.union(beyond_centers(placed, stash(sets_of(wanted), name="sets"), percent)).distinct()
    late = stash(verify(more), name="links")
    return (found if late.isEmpty() else merged(found, late)), links.union(late)


def beyond_centers(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of one family that could link, are in two components and of which
    one at least is ``apart``. placed: (center, id, own, apart); sets: (id, s).

    Write i, o and m for how many elements of a member stand inside its centre's set,
    outside it, and are missing of it, t for the threshold. A link needs t of the larger
    of both sets in common, hence

    * either an outside element in common: then at least t (i + o) - i of them;
    * or none: then i + i' - n + (missing ones in common) >= t (n + o + o' - missing ones
      in common), n being the centre's size, so at least n + o - i / t missing ones in
      common, for either of the two.

    In both cases a member needs only its first elements in one order of all (rarest
    first) to meet every partner. Elements that no pair of two components shares come
    first and are left out, so members that differ by edits of their own bring nothing.

    A group that is linked within itself but not with the centre would still give all its
    pairs: ``_absorbed`` joins it by stars first, so the pairs are those of what is left."""
    blocks = placed.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    dealt = placed.join(blocks, "center").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), "n").cast("int")).drop("n")
    centers = blocks.join(sets.select(F.col("id").alias("center"), F.col("s").alias("cs")), "center")
    centers = centers.select("center", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), "cs")
    both = dealt.join(sets, "id").join(centers, ["center", "block"])
    split = both.select("center", "id", "own", "apart", F.size("cs").alias("nc"), F.array_except("s", "cs").alias("out"), F.array_except("cs", "s").alias("miss"))
    split = split.withColumns({"o": F.size("out"), "m": F.size("miss"), "i": F.col("nc") - F.size("miss")})
    shared = F.ceil(F.lit(percent) * (F.col("i") + F.col("o")) / 100).cast("int") - F.col("i")
    absent = F.ceil((F.lit(percent) * (F.col("nc") + F.col("o")) - 100 * F.col("i")) / percent).cast("int")
    needs = {"need_out": F.greatest(F.lit(1), shared), "need_miss": F.greatest(F.lit(1), absent)}
    rows = _leading(stash(split.withColumns(needs), name="split"))
    rows, joined = _absorbed(rows, sets, percent)
    return joined.union(_meet(rows, stash(sketches(sets), name="sketches"), percent)).distinct()


def _leading(split: DataFrame) -> DataFrame:
    """A row per element that a member has to be met by: of the outside ones, and of the
    missing ones, that two components share all but need - 1, the rarest first. ``outer``
    tells which; no element is both for one centre."""
    ways = F.array(
        F.struct(F.lit(True).alias("outer"), F.col("need_out").alias("need"), F.col("out").alias("xs")),
        F.struct(F.lit(False).alias("outer"), F.col("need_miss").alias("need"), F.when(F.col("need_miss") <= F.col("m"), F.col("miss")).alias("xs")),
    )
    kinds = split.select("center", "id", "own", "apart", "nc", "i", "o", "m", F.explode(ways).alias("way"))
    each = kinds.select("center", "id", "own", "apart", "nc", "i", "o", "m", "way.outer", "way.need", F.explode("way.xs").alias("x"))
    worth = each.groupBy("center", "x").agg(
        F.count(F.lit(1)).alias("f"), F.bool_or("apart").alias("any_apart"), F.min("own").alias("lo"), F.max("own").alias("hi")
    )
    worth = worth.filter("any_apart and lo <> hi").select("center", "x", "f")
    member = Window.partitionBy("center", "id", "outer")
    ranked = each.join(worth, ["center", "x"]).withColumns({"at": F.row_number().over(member.orderBy("f", "x")), "of": F.count(F.lit(1)).over(member)})
    return stash(ranked.filter("at <= of - need + 1").drop("at", "of", "need", "f"), name="leading")


def _possible(percent: int) -> Column:
    """Whether sizes (i, o, m and i2, o2, m2) allow a link by an element in common."""
    most = F.least("i", "i2") + F.least("o", "o2")
    outside = most * 100 >= (F.col("i") + F.col("o") + F.col("i2") + F.col("o2") - most) * percent
    fewest = F.lit(percent) * (F.col("nc") + F.col("o") + F.col("o2")) - 100 * (F.col("nc") - F.col("m") - F.col("m2"))
    return F.when(F.col("outer"), outside).otherwise(F.least("m", "m2") * (100 + percent) >= fewest)


def _absorbed(rows: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``_leading`` with ``own`` after some links, and these links (a, b). In each
    round every element's members meet one hub, so pairs grow with the rows; they are
    narrow until each is there once, and links are confirmed on the full sets (id, s).
    Later rounds choose other hubs; what they leave apart, ``_meet`` still finds. Rows
    stay good as components only grow."""
    links = rows.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    for turn in range(STAR_ROUNDS):
        order = F.xxhash64("id", F.pmod("x", F.lit(HUBS)), F.lit(turn))
        hub = F.max(F.struct(order.alias("order"), *(F.col(c).alias(f"{c}2") for c in ("id", "own", "i", "o", "m"))))
        hubs = rows.filter("apart").groupBy("center", "x").agg(hub.alias("hub")).select("center", "x", "hub.*")
        met = rows.join(hubs, ["center", "x"]).filter((F.col("own") != F.col("own2")) & _possible(percent))
        met = stash(met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), name="met")
        one, two = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
        linked = F.size(F.array_intersect("sa", "sb")) * 100 >= F.size(F.array_union("sa", "sb")) * percent
        new = stash(met.join(one, "a").join(two, "b").filter(linked).select("a", "b"), name="links")
        discard(met)
        if new.isEmpty():
            break
        links = links.union(new)
        name = rows.select("id", "own").distinct()
        ends = new.join(name.withColumnsRenamed({"id": "a", "own": "oa"}), "a").join(name.withColumnsRenamed({"id": "b", "own": "ob"}), "b")
        grown = stash(components(ends.select(F.col("oa").alias("a"), F.col("ob").alias("b"))).withColumnsRenamed({"id": "own", "component": "grown"}), name="grown")
        kept = [c for c in rows.columns if c != "own"]
        rows = stash(rows.join(grown, "own", "left").select(*kept, F.coalesce("grown", "own").alias("own")), name="leading")
    return rows, links


def _meet(rows: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with an element in common, one of them apart, in two components, that
    neither their sizes nor their sketches (``drawn``: id, k, odd) rule out. Both sides of
    the join are one plan, so their rows are dealt out once."""
    rows = rows.join(drawn, "id")
    other = rows.select("center", "x", *(F.col(c).alias(f"{c}2") for c in ("id", "own", "apart", "i", "o", "m", "k", "odd")))
    linked = may_link(F.col("k"), F.col("odd"), F.col("k2"), F.col("odd2"), percent)
    met = rows.join(other, ["center", "x"]).filter("id < id2 and own <> own2 and (apart or apart2)").filter(_possible(percent) & linked)
    return met.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
