"""Time-varying curriculum: mix sources to target weights.

1. Targets. Sources in code-point order (null last) get the weights in turn and
   share ``epochs`` times all sizes. A target stops at ``max_repeats`` times its
   source's size; the excess is shared again by weight until none is above. That
   fixed point is a water level L with target = min(cap, L * weight), found in one
   pass over the sources by running sums in the order of cap / weight.
2. Order. Inside a source documents follow a hash of their id. Running sizes are
   summed in two steps: over hash ranges of a source (as many as its rows ask for),
   then inside each range, so a source with a third of all rows is spread out.
3. Positions. A source's weight schedule is piecewise linear over training time
   [0, 1]; its integral is the source's cumulative demand. A copy that starts at c
   of the source's target words is due when the demand reaches c: the integral is
   inverted (a quadratic in each piece). Documents are range-sorted by position.

The demand ends inside a document at most once per source: ``taken`` counts exactly
the words up to there, so a source's taken words equal its rounded target.

Defined results: a null text has size 0; documents of size 0 take 0 words and stand
at their place in the order; an empty table gives no rows; repeated rows are
separate documents; a null doc_id hashes as an empty one. Computed names replace
columns of the same name, other columns pass through. A very long text is counted whole.
The table of sources (one row per source, not per document) is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import WORD, let, table

WEIGHTS = (3, 1, 2)
EPOCHS = 1.5
MAX_REPEATS = 2
#: Schedules in turn, as (time, weight) knots: early, steady, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
#: Rows of a source to a hash range.
RANGE_ROWS = 4096


def source_targets(sized: DataFrame, *, weights=WEIGHTS, epochs: float = EPOCHS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source of (source, size): source_size, source_rows, place (from 0) and target."""
    groups = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    placed = groups.withColumns(
        {"place": F.row_number().over(by_name) - 1, "total": F.sum("source_size").over(everything)}
    ).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int")))
    # in the order of cap / weight the capped sources come first
    capped = placed.withColumn("cap", F.col("source_size") * float(max_repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "place")
    before = capped.withColumns(
        {
            "caps_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights_from": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") * float(epochs) - F.col("caps_before")) / F.col("weights_from")
    # the level is right where it first stays below the ratio; from there on it only falls
    found = before.withColumn("own", level).withColumn(
        "level", F.max(F.when(F.col("own") <= F.col("ratio"), F.col("own"))).over(everything)
    )
    shared = F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return found.select("source", "source_size", "source_rows", "place", F.least(shared, F.col("cap")).alias("target"))


def due(share: Column, knots: Column) -> Column:
    """The time in [0, 1] at which the integral of a piecewise linear schedule reaches
    ``share`` of its whole. ``knots``: array of (t, w), times rising from 0 to 1."""

    def pieces(k: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(k) - 1),
            lambda i: F.struct(
                F.get(k, i - 1)["t"].alias("t"),
                (F.get(k, i)["t"] - F.get(k, i - 1)["t"]).alias("dt"),
                F.get(k, i - 1)["w"].alias("a"),
                F.get(k, i)["w"].alias("b"),
                ((F.get(k, i)["t"] - F.get(k, i - 1)["t"]) * (F.get(k, i - 1)["w"] + F.get(k, i)["w"]) / 2).alias("area"),
            ),
        )

    def inverted(ps: Column) -> Column:
        whole = F.aggregate(ps, F.lit(0.0), lambda acc, p: acc + p["area"])
        start = F.struct((share * whole).alias("left"), F.lit(None).cast("double").alias("at"))

        def step(acc: Column, p: Column) -> Column:
            # area up to u of the piece (0..1): dt * (a u + (b - a) u^2 / 2)
            need = acc["left"] / p["dt"]
            flat = F.abs(p["b"] - p["a"]) < 1e-12
            root = (F.sqrt(F.greatest(F.lit(0.0), p["a"] * p["a"] + (p["b"] - p["a"]) * need * 2)) - p["a"]) / F.when(flat, F.lit(1.0)).otherwise(p["b"] - p["a"])
            u = F.least(F.lit(1.0), F.when(flat, need / F.greatest(p["a"], F.lit(1e-300))).otherwise(root))
            inside = acc["at"].isNull() & (acc["left"] <= p["area"])
            return F.struct(
                (acc["left"] - p["area"]).alias("left"),
                F.when(inside, p["t"] + p["dt"] * u).otherwise(acc["at"]).alias("at"),
            )

        return F.coalesce(F.aggregate(ps, start, step, lambda acc: acc["at"]), F.lit(1.0))

    return let(pieces(knots), inverted)


def _knots(place: Column, schedules) -> Column:
    rows = [F.array(*(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in s)) for s in schedules]
    pick = rows[-1]
    for i in range(len(rows) - 2, -1, -1):
        pick = F.when(place % len(rows) == i, rows[i]).otherwise(pick)
    return pick


#: Columns that exist while a mix is worked out; columns of the input by these names go.
INNER = ("_key", "_source", "_nth", "_ranges", "_range", "_sum", "_run", "_place", "_at", "_start", "_before", "_demand", "_copy")


def mix(df: DataFrame, *, text_col: str = "text", weights=WEIGHTS, schedules=SCHEDULES, epochs: float = EPOCHS, max_repeats: int = MAX_REPEATS, seed: str = "mix-1") -> DataFrame:
    """Add size, source_size, target, taken, copies (struct of copy, words, position:
    what is taken of each copy, and when), and position (of the first copy taken, null
    if none is). Needs doc_id and source; rows come unsorted (see ``in_order``)."""
    made = ["size", "source_size", "target", "taken", "copies", "position"]
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))
    sized = df.drop(*made, *INNER).withColumns(
        {"size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"), "_key": key}
    )
    targets = source_targets(sized.select("source", "size"), weights=weights, epochs=epochs, max_repeats=max_repeats)
    named = targets.select(
        F.col("source").alias("_source"), "source_size", "target", F.col("place").alias("_nth"), (F.floor(F.col("source_rows") / RANGE_ROWS) + 1).alias("_ranges")
    )
    # one row per source: small by kind, but its size is not assumed; the join adapts
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    head = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    ranged = rows.withColumn("_range", F.floor(head * F.col("_ranges") / F.lit(2**32)))
    sums = ranged.groupBy("_nth", "_range").agg(F.sum("size").alias("_sum"))
    starts = sums.select(
        F.col("_nth").alias("_place"),
        F.col("_range").alias("_at"),
        (F.sum("_sum").over(Window.partitionBy("_nth").orderBy("_range")) - F.col("_sum")).alias("_start"),
    )
    inside = Window.partitionBy("_nth", "_range").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size")
    placed = ranged.withColumn("_run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    summed = placed.join(starts, (F.col("_nth") == F.col("_place")) & (F.col("_range") == F.col("_at")))
    before = F.col("_start") + F.col("_run")
    demand = F.round("target").cast("long")
    knots = _knots(F.col("_nth"), schedules)
    copy = F.transform(
        F.sequence(F.lit(0), F.lit(max_repeats - 1)),
        lambda k: F.struct(
            k.alias("copy"),
            F.greatest(F.lit(0), F.least(F.col("size"), F.col("_demand") - (k * F.col("source_size") + F.col("_before")))).cast("long").alias("words"),
            (k * F.col("source_size") + F.col("_before")).alias("start"),
        ),
    )
    timed = F.transform(
        F.filter(copy, lambda c: c["words"] > 0),
        lambda c: F.struct(c["copy"].alias("copy"), c["words"].alias("words"), due(c["start"] / F.col("target"), knots).alias("position")),
    )
    out = summed.withColumns({"_before": before, "_demand": demand}).withColumn("copies", timed)
    return out.withColumns(
        {
            "taken": F.aggregate("copies", F.lit(0).cast("long"), lambda acc, c: acc + c["words"]),
            "position": F.get("copies", 0)["position"],
        }
    ).drop(*INNER)


def in_order(mixed: DataFrame) -> DataFrame:
    """One row per copy of which at least half is taken, range-sorted by position."""
    each = mixed.withColumn("_copy", F.explode("copies"))
    whole = each.filter(F.col("_copy.words") * 2 >= F.col("size"))
    return whole.withColumns({"position": F.col("_copy.position"), "copy": F.col("_copy.copy")}).orderBy("position", "doc_id", "copy").drop("_copy", "copies")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def targets_sql() -> str:
    """Common table expressions d (doc_id, source, size) and s (targets) in DuckDB SQL."""
    return rf"""
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
s1 AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s0),
s2 AS (SELECT *, cap / weight AS ratio FROM s1),
s3 AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM s2),
s4 AS (SELECT *, max(CASE WHEN own <= ratio THEN own END) OVER () AS level FROM s3),
s AS (SELECT source, source_size, place, CASE WHEN level IS NULL OR ratio < level THEN cap ELSE least(level * weight, cap) END AS target FROM s4)"""


def oracle() -> str:
    return rf"""
WITH {targets_sql()},
o AS (SELECT d.doc_id, d.size, s.source_size, s.place, s.target, sum(d.size) OVER (PARTITION BY s.place
    ORDER BY md5(coalesce(d.doc_id::VARCHAR, '') || 'mix-1'), d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS before
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t AS (SELECT *, greatest(0, least(size, round(target)::BIGINT - before)) AS first_words,
    greatest(0, least(size, round(target)::BIGINT - source_size - before)) AS second_words FROM o),
u AS (SELECT *, CASE WHEN first_words > 0 THEN before / target WHEN second_words > 0 THEN (before + source_size) / target END AS share FROM t)
SELECT doc_id, size, source_size, target, (first_words + second_words)::BIGINT AS taken,
  round(CASE place % 3 WHEN 0 THEN (sqrt(2.25 - share * 2) - 1.5) / -1.0
    WHEN 1 THEN share
    ELSE CASE WHEN share * 0.875 <= 0.25 THEN share * 0.875 / 0.5
      ELSE 0.5 + 0.5 * (sqrt(0.25 + 1.5 * ((share * 0.875 - 0.25) / 0.5) * 2) - 0.5) / 1.5 END END, 6) AS position
FROM u"""
