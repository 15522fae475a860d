"""Evaluation: rank correlation, retrieval quality, staged means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tau_b(ranks: DataFrame, key: str) -> DataFrame:
    """(key, n, tau, tau_norm): Kendall's tau-b of columns x and y per key, pairs by a self-join on the key; tau is 0 where one
    side is all ties."""
    a, b = ranks.alias("a"), ranks.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.item") < F.col("b.item")))
    sx, sy = F.signum(F.col("a.x") - F.col("b.x")), F.signum(F.col("a.y") - F.col("b.y"))
    sums = pairs.groupBy(F.col(f"a.{key}").alias(key)).agg(F.sum(sx * sy).alias("s"), F.sum(sx * sx).alias("ux"), F.sum(sy * sy).alias("uy"))
    tau = F.when((F.col("ux") == 0) | (F.col("uy") == 0), 0.0).otherwise(F.col("s") / F.sqrt(F.col("ux") * F.col("uy")))
    return sums.select(key, F.round(tau, 6).alias("tau"), F.round((tau + 1) / 2, 6).alias("tau_norm"))


def staged_means(rows: DataFrame) -> DataFrame:
    """(category, score) of (conversation, category, score): means per conversation, then over conversations; `average` is the
    unweighted mean over categories."""
    per = rows.groupBy("conversation", "category").agg(F.avg("score").alias("s")).groupBy("category").agg(F.avg("s").alias("score"))
    return per.union(per.agg(F.avg("score").alias("score")).select(F.lit("average"), "score")).select("category", F.round("score", 6).alias("score"))


def accuracy(rows: DataFrame, by: str, passing: float = 0.7) -> DataFrame:
    """(by, n, accuracy, mean_score) per group and, with NULL, overall."""
    right = F.when(F.col("score") >= passing, 1.0).otherwise(0.0)
    return rows.rollup(by).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg("score"), 6).alias("mean_score"))
