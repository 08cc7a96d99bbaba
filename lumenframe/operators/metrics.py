"""Classification metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.profile import col

EPSILON = 1e-15


def log_loss(y: Column, probability: Column) -> Column:
    """Aggregate: mean negative log of the true class's probability, clipped."""
    p = F.element_at(probability, y + 1)
    return -F.avg(F.log(F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))))


def accuracy(y: Column, predicted: Column) -> Column:
    return F.avg((y == predicted).cast("double"))


def roc_auc(df: DataFrame, score: Column, positive: Column) -> float | None:
    """Mann-Whitney with average ranks; None if a class is absent.

    Ties are merged first, so the ranks come from a running sum over distinct scores;
    these are summed in ranges of the score, not in one task: each range's start is
    known from the (few) range totals."""
    tied = df.select(score.alias("s"), positive.cast("int").alias("p")).groupBy("s").agg(F.sum("p").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    row = tied.agg(F.sum("pos").alias("p"), F.sum("n").alias("n")).first()
    if not row["n"] or not row["p"] or row["p"] == row["n"]:
        return None
    parts = tied.withColumn("r", F.floor(F.least(F.greatest(F.col("s"), F.lit(0.0)), F.lit(1.0)) * 1024))
    totals = parts.groupBy("r").agg(F.sum("n").alias("t"))
    starts = totals.withColumn("start", F.sum("t").over(Window.orderBy("r")) - F.col("t")).drop("t")  # at most 1025 rows
    inside = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0.0))).join(starts, "r")
    rank = F.col("start") + F.col("before") + (F.col("n") + 1) / 2
    total = ranked.agg(F.sum(rank * F.col("pos"))).first()[0]
    p, n = row["p"], row["n"] - row["p"]
    return (total - p * (p + 1) / 2) / (p * n)


def evaluate(df: DataFrame, prior: list[float], *, y: str = "y") -> dict:
    """log_loss, baseline_log_loss (training shares), accuracy, balanced_accuracy, roc_auc
    (macro one-vs-rest for more than two classes) of a scored frame."""
    base = F.array(*(F.lit(float(p)) for p in prior))
    row = df.agg(log_loss(col(y), F.col("probability")).alias("l"), log_loss(col(y), base).alias("b"), accuracy(col(y), F.col("predicted")).alias("a")).first()
    recall = df.groupBy(col(y)).agg(accuracy(col(y), F.col("predicted")).alias("r")).agg(F.avg("r")).first()[0]
    if len(prior) == 2:
        auc = roc_auc(df, F.col("probability")[1], col(y) == 1)
    else:
        each = [roc_auc(df, F.col("probability")[k], col(y) == k) for k in range(len(prior))]
        auc = None if any(a is None for a in each) else sum(each) / len(each)
    return {"log_loss": row["l"], "baseline_log_loss": row["b"], "accuracy": row["a"], "balanced_accuracy": recall, "roc_auc": auc}
