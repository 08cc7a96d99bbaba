"""Scoring and exact explanation of rows: one select over any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.additive import AdditiveModel, term_scores, with_bins
from lumenframe.operators.profile import col

#: Fixed value: the additivity check's tolerance.
TOLERANCE = 1e-3


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softmax(z: Column) -> Column:
    """Of an array column, shifted by its largest value."""
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def argmax(p: Column) -> Column:
    """0-based place of the first largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def _labels(model: AdditiveModel) -> Column:
    return F.array(*(F.lit(str(c)) for c in model.classes))


def score(model: AdditiveModel, df: DataFrame) -> DataFrame:
    """Add raw (array of scores, one for binary), probability (array by class),
    predicted (code) and predicted_class (label as text)."""
    binned = with_bins(model, df)
    by_term = term_scores(model)
    raw = F.array(*(sum((t[k] for t in by_term), F.lit(base)) for k, base in enumerate(model.intercept)))
    out = binned.withColumn("raw", raw)
    if model.n_scores == 1:
        p = sigmoid(F.col("raw")[0])
        out = out.withColumn("probability", F.array(1 - p, p))
    else:
        out = out.withColumn("probability", softmax(F.col("raw")))
    out = out.withColumn("predicted", argmax(F.col("probability")))
    out = out.withColumn("predicted_class", F.element_at(_labels(model), F.col("predicted") + 1))
    return out.drop(*(c for c in out.columns if c.startswith(("b_", "p_")) and c not in df.columns))


def explain(model: AdditiveModel, df: DataFrame, *, top_n: int = 10, values: dict[str, Column] | None = None, categorical: frozenset = frozenset()) -> DataFrame:
    """Add contributions (array of term, is_interaction, value, scores, score, direction;
    by falling size, at most ``top_n``), base (intercepts), reconstructed (probabilities
    from all terms and the base), probability, predicted_class and additivity_verified.

    Binary: score is for the second class and the direction is the class it favours.
    More classes: scores by class, score the largest by size, direction its class."""
    scored = score(model, df)
    binned = with_bins(model, scored)
    by_term = term_scores(model)
    labels = _labels(model)
    items = []
    for t, s in zip(model.terms, by_term, strict=True):
        shown = [(values or {}).get(f, col(f)).cast("string") for f in t.features]
        value = shown[0] if len(shown) == 1 else F.concat_ws(" & ", *(F.coalesce(v, F.lit("null")) for v in shown))
        scores = F.array(*s)
        if model.n_scores == 1:
            one, toward = s[0], F.when(s[0] > 0, labels[1]).otherwise(labels[0])
        else:
            one, toward = F.array_max(F.transform(scores, F.abs)), F.element_at(labels, argmax(scores) + 1)
        items.append(
            F.struct(
                F.lit(t.name).alias("term"), F.lit(t.is_interaction).alias("is_interaction"), value.alias("value"),
                scores.alias("scores"), one.alias("score"), toward.alias("direction"),
            )
        )
    # all terms are kept until the sum is checked, then the largest are cut out
    every = binned.withColumn("_all", F.array(*items))
    base = F.array(*(F.lit(v) for v in model.intercept))
    total = F.transform(F.sequence(F.lit(0), F.lit(model.n_scores - 1)), lambda k: F.aggregate("_all", F.get(base, k), lambda a, t: a + F.get(t["scores"], k)))
    summed = every.withColumn("_sum", total)
    again = F.array(1 - sigmoid(F.col("_sum")[0]), sigmoid(F.col("_sum")[0])) if model.n_scores == 1 else softmax(F.col("_sum"))
    by_size = F.array_sort("_all", lambda a, b: F.when(F.abs(a["score"]) > F.abs(b["score"]), -1).when(F.abs(a["score"]) < F.abs(b["score"]), 1).otherwise(0))
    done = summed.withColumns({"base": base, "reconstructed": again, "contributions": F.slice(by_size, 1, top_n)})
    close = F.forall(F.zip_with("reconstructed", "probability", lambda a, b: F.abs(a - b)), lambda d: d < TOLERANCE)
    done = done.withColumn("additivity_verified", close).drop("_all", "_sum")
    return done.drop(*(c for c in done.columns if c.startswith(("b_", "p_")) and c not in df.columns))


def probability_map(model: AdditiveModel, p: Column) -> Column:
    return F.map_from_arrays(_labels(model), p)
