"""What operators hand on while they work: tables left behind, pairs, rows sent to the driver."""

import os
import random

from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import line_dedup, links, near_dedup, rp_forest


def _left(spark) -> set[str]:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return {x for x in os.listdir(folder) if x.startswith("stash-")}


def test_operators_leave_only_what_their_result_reads(spark, docs):
    texts = docs([f"the same line in all of them\nand line {i} of its own, with some more words" for i in range(40)])
    before = _left(spark)
    cleaned = corpus_pipeline.clean(spark, texts, "")
    assert _left(spark) == before
    cleaned.count()
    line_dedup.dedup_lines(texts).count()
    assert {x.rsplit("-", 1)[0] for x in _left(spark) - before} == {"stash-classes"}
    before = _left(spark)
    near_dedup.near_duplicates(texts).count()
    assert {x.rsplit("-", 1)[0] for x in _left(spark) - before} == {"stash-signatures", "stash-named"}


def test_sketches_rule_out_no_link_and_most_others(spark):
    rng = random.Random(3)
    sets = []
    for i in range(60):
        size, out = rng.randint(1, 400), rng.randint(0, 200)
        base = [x * 7919 for x in range(size)]
        kept = [x for x in base if rng.random() > rng.choice((0, 0.02, 0.2))]
        sets.append((i, [hash_(x) for x in (kept or base[:1]) + [10**9 + i * 1000 + k for k in range(out // rng.choice((1, 40)))]]))
    drawn = links.sketches(spark.createDataFrame(sets, "id long, s array<long>"))
    one, two = drawn.select(*(F.col(c).alias(f"{c}1") for c in drawn.columns)), drawn.select(*(F.col(c).alias(f"{c}2") for c in drawn.columns))
    open_ = links.may_link(F.col("k1"), F.col("odd1"), F.col("k2"), F.col("odd2"), 80)
    got = {(r["id1"], r["id2"]) for r in one.join(two, F.col("id1") < F.col("id2")).filter(open_).select("id1", "id2").collect()}
    whole = {i: set(s) for i, s in sets}
    link = {(a, b) for a in whole for b in whole if a < b and 100 * len(whole[a] & whole[b]) >= 80 * len(whole[a] | whole[b])}
    assert link and link <= got
    assert len(got) < 0.5 * len(whole) * (len(whole) - 1) / 2


def hash_(x: int) -> int:
    """A long that looks random."""
    return random.Random(x).getrandbits(64) - 2**63


def test_line_dedup_verifies_few_pairs_of_a_family(spark, docs, monkeypatch):
    """Variants of one line at about 0.6 of each other share buckets; few of their pairs are read whole."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(60)]
    lines = [" ".join(word() if rng.random() < 0.13 else w for w in base) for _ in range(80)]
    lines += [lines[0] + " again", lines[7] + " again"]
    asked = []
    inner = links.bucket_components

    def watched(members, verify, sets_of, **more):
        def counted(pairs):
            asked.append(pairs.count())
            return verify(pairs)

        return inner(members, counted, sets_of, **more)

    monkeypatch.setattr(line_dedup, "bucket_components", watched)
    gone = {r["doc_id"] for r in line_dedup.dedup_lines(docs(lines)).collect() if r["n_removed"]}
    assert {80, 81} <= gone
    assert asked[1] < 100


def test_group_apart_from_its_centre_gives_few_pairs(spark):
    """Members that link with each other and not with the centre: as many pairs as members, not their square."""
    rng, n = random.Random(9), 300
    centre = [hash_(k) for k in range(200)]
    common = [hash_(1000 + k) for k in range(25)]
    sets = {0: set(centre)}
    for i in range(1, n + 1):
        sets[i] = set(centre[:180]) - {rng.choice(centre[:180])} | set(rng.sample(common, 24)) | {hash_(10_000 + i)}
    # two that link with each other only, and one that links with nothing
    alone = [hash_(50_000 + k) for k in range(40)]
    sets[n + 1], sets[n + 2] = set(centre[:150]) | set(alone), set(centre[:150]) | set(alone[:38])
    sets[n + 3] = set(centre[:150]) | {hash_(60_000 + k) for k in range(40)}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    assert not any(link(0, i) for i in range(1, n + 4)) and sum(link(1, i) for i in range(2, n + 1)) > 0.9 * n
    placed = spark.createDataFrame([(0, i, i, i != 0) for i in sets], "center long, id long, own long, apart boolean")
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")
    rows = links.beyond_centers(placed, frame, 85)
    pairs = {(r["a"], r["b"]) for r in rows.collect()}
    near = {i: {j for j in sets if j != i and link(i, j)} for i in sets}

    def reach(step):
        groups, seen = set(), set()
        for i in sets:
            todo, group = [i], set()
            while todo:
                if (x := todo.pop()) not in group:
                    group.add(x)
                    todo.extend(step[x])
            if i not in seen:
                groups.add(frozenset(group))
                seen |= group
        return groups

    got = {i: set() for i in sets}
    for a, b in pairs:
        if link(a, b):
            got[a].add(b)
            got[b].add(a)
    assert reach(got) == reach(near)
    assert len(pairs) < 3 * links.HUBS * n


def test_forest_sample_is_filtered_before_it_is_sorted(spark):
    vectors = spark.range(20_000, numPartitions=8).select(F.array(F.col("id").cast("double")).alias("v"))
    plain = [r["v"] for r in vectors.orderBy(F.xxhash64("v")).limit(300).collect()]
    sample = rp_forest.least_hashed(vectors, 20_000, 300)
    assert [r["v"] for r in sample.collect()] == plain
    assert "< -" in sample._jdf.queryExecution().optimizedPlan().toString()
    assert [r["v"] for r in rp_forest.least_hashed(vectors.limit(5), 5, 300).collect()] != []


def test_elements_meet_without_the_differences_of_their_members(spark, monkeypatch):
    """A row per element is narrow: no join puts a member's differences to each of its elements."""
    rng, plans = random.Random(4), []
    centre, common = [hash_(k) for k in range(100)], [hash_(1000 + k) for k in range(20)]
    sets = {0: set(centre)} | {i: set(centre[:85]) | set(common) - {rng.choice(common)} | {hash_(5000 + i)} for i in range(1, 40)}
    stash = links.stash

    def watched(df, *, name="table"):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return stash(df, name=name)

    monkeypatch.setattr(links, "stash", watched)
    placed = spark.createDataFrame([(0, i, i, i != 0) for i in sets], "center long, id long, own long, apart boolean")
    pairs = links.beyond_centers(placed, spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>"), 85)
    met = [p for name, p in plans if name == "met"] + [pairs._jdf.queryExecution().optimizedPlan().toString()]
    assert len(met) > 1 and not any("LeftOuter" in p or "miss#" in p for p in met)
    assert {x for p in pairs.collect() for x in (p["a"], p["b"])} == set(range(1, 40))
