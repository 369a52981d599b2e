"""Evaluation of scored examples.  Ranks over all rows come from bucket counts plus a rank inside each bucket, so no
task sorts all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, score: str, buckets: int = 4096, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their descending rank (1, 2, ...) by a score in [0, 1] and `n`, the number of rows."""
    d = df.withColumn("bucket", F.least(F.floor(F.col(score) * buckets), F.lit(buckets)).cast("int"))
    c = d.groupBy("bucket").agg(F.count("*").alias("c"))
    w = Window.orderBy(F.col("bucket").desc())
    c = c.select("bucket", (F.sum("c").over(w) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col(score).desc(), *order))
    return d.withColumn("inside", inside).join(c, "bucket").withColumn("rank", F.col("before") + F.col("inside")).drop("bucket", "inside", "before")


def rate_thresholds(noise: DataFrame, score: str, seconds: float, rates: list[float]) -> DataFrame:
    """(far, threshold): score at each false alarm rate, linear between ranks; 1.1 below the least rate that the rows
    can show, the lowest score above the highest."""
    spark = noise.sparkSession
    wanted = spark.createDataFrame([(float(r),) for r in rates], "far double")
    seconds = max(seconds, 1e-9)
    r = ranked(noise.select(score), score)
    size = noise.agg(F.count("*").alias("n"), F.min(score).alias("lowest"))
    w = wanted.join(F.broadcast(size)).withColumn("place", F.col("far") * F.col("n") * seconds)
    w = w.withColumn("lo", F.greatest(F.floor("place"), F.lit(1))).select("far", "n", "lowest", "place", F.explode(F.array("lo", F.col("lo") + 1)).alias("rank"))
    hit = r.select("rank", F.col(score).alias("s")).join(F.broadcast(w), "rank", "right")
    g = hit.groupBy("far", "n", "lowest", "place").agg(F.min_by("s", "rank").alias("upper"), F.max_by("s", "rank").alias("lower"), F.max(F.when(F.col("s").isNotNull(), F.col("rank"))).alias("last"))
    share = F.col("place") - F.floor("place")
    inside = F.col("upper") + F.when(F.col("lower").isNull(), 0.0).otherwise(share * (F.col("lower") - F.col("upper")))
    return g.select("far", F.when(F.col("place") < 1, 1.1).when(F.col("place") > F.col("n"), F.col("lowest")).otherwise(inside).alias("threshold"))


def roc_fixed(df: DataFrame, points: int = 512) -> DataFrame:
    """(threshold, tpr, fpr) at thresholds 1 - exp(-6 i / (points - 1)): one histogram over the gaps between them."""
    edges = [1 - math.exp(-6 * i / (points - 1)) for i in range(points)]
    t = F.array(*map(F.lit, edges))
    near = F.floor(-F.ln(F.greatest(1 - F.col("score"), F.lit(1e-12))) * (points - 1) / 6).cast("int")
    k = F.greatest(F.lit(0), F.least(near, F.lit(points - 1)))
    k = F.when((k < points - 1) & (F.element_at(t, F.least(k + 2, F.lit(points))) <= F.col("score")), k + 1).when(F.element_at(t, k + 1) > F.col("score"), k - 1).otherwise(k)
    h = df.groupBy(k.alias("k")).agg(F.sum("truth").alias("p"), F.sum(1 - F.col("truth")).alias("n"))
    every = df.sparkSession.range(-1, points).select(F.col("id").cast("int").alias("k")).join(h, "k", "left").na.fill(0, ["p", "n"])
    w, whole = Window.orderBy(F.col("k").desc()), Window.partitionBy()
    d = every.select("k", *[f.over(v).alias(a) for f, v, a in ((F.sum("p"), w, "tp"), (F.sum("n"), w, "fp"), (F.sum("p"), whole, "ps"), (F.sum("n"), whole, "ns"))]).where("k >= 0")
    return d.select("k", F.element_at(t, F.col("k") + 1).alias("threshold"), (F.col("tp") / (F.col("ps") + 1e-10)).alias("tpr"), (F.col("fp") / (F.col("ns") + 1e-10)).alias("fpr"))


def area(curve: DataFrame) -> DataFrame:
    """Area under a curve of roc_fixed by the trapezoid rule."""
    w = Window.orderBy("k")
    d = curve.select("tpr", "fpr", F.lead("tpr").over(w).alias("t2"), F.lead("fpr").over(w).alias("f2"))
    return d.agg(F.sum((F.col("fpr") - F.col("f2")) * (F.col("tpr") + F.col("t2")) / 2).alias("auc"))


def rolling_recall(df: DataFrame, threshold: float, centres: int = 50, half: float = 0.5, least: int = 20) -> DataFrame:
    """(centre, n, recall): share of scores over the threshold around evenly spaced ratios.  Rows meet centres by
    whole-number buckets; empty with a threshold of 1 or more, or fewer than five centres."""
    edge = df.agg((F.floor(F.min("snr")) + half).alias("a"), (F.ceil(F.max("snr")) - half).alias("b"))
    c = edge.select(F.explode(F.sequence(F.lit(0), F.lit(centres - 1))).alias("i"), "a", "b").select((F.col("a") + F.col("i") * (F.col("b") - F.col("a")) / (centres - 1)).alias("centre"))
    c = c.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("centre") - half), F.floor(F.col("centre") + half))))
    d = df.select("snr", "score", F.floor("snr").alias("bucket")).join(F.broadcast(c), "bucket").where((F.col("snr") >= F.col("centre") - half) & (F.col("snr") < F.col("centre") + half))
    g = d.groupBy("centre").agg(F.count("*").alias("n"), F.avg((F.col("score") > threshold).cast("int")).alias("recall")).where((F.col("n") >= least) & F.lit(threshold < 1))
    return g.withColumn("valid", F.count("*").over(Window.partitionBy())).where("valid >= 5").drop("valid")


def fitness(df: DataFrame, score: Column, threshold: float, least_loss: float) -> DataFrame:
    """1 / (1 - share of scores over the threshold + loss); 0 where a term is not finite."""
    share = F.try_divide(F.sum((score > threshold).cast("int")), F.count("*"))
    value = 1.0 / (1.0 - share + F.lit(float(least_loss)) + 1e-8)
    return df.agg(F.when(F.lit(math.isfinite(least_loss)) & share.isNotNull(), value).otherwise(0.0).alias("fitness"))


def density(df: DataFrame, x: Column, y: Column, cells: int = 400) -> DataFrame:
    """Counts on a grid over the range of two columns; values on the upper edge fall in the last cell."""
    d = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"))
    e = d.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda v, a, b: F.least(F.floor(F.try_divide(F.col(v) - F.col(a), F.col(b) - F.col(a)) * cells), F.lit(cells - 1)).cast("int")
    return d.join(F.broadcast(e)).groupBy(cell("x", "x0", "x1").alias("i"), cell("y", "y0", "y1").alias("j")).agg(F.count("*").alias("n"))


def sigmoid_fit(bins: list[tuple[float, float]], rounds: int = 200) -> tuple[float, float, float, float]:
    """(x0, k, L, b) of L / (1 + exp(-k (x - x0))) + b by damped least squares within fixed bounds; few bins, on the driver."""
    import numpy as np

    x, y = np.array(bins, dtype=float).T
    low, high = np.array([0, 0.01, 0, 0]), np.array([30, 5, 1, 0.5])
    f = lambda p: p[2] / (1 + np.exp(-p[1] * (x - p[0]))) + p[3]
    p, damp = np.array([10.0, 0.5, 0.8, 0.1]), 1e-2
    for _ in range(rounds):
        r = y - f(p)
        j = np.stack([(f(p + h) - f(p - h)) / 2e-6 for h in np.eye(4) * 1e-6], 1)
        new = np.clip(p + np.linalg.solve(j.T @ j + damp * np.eye(4), j.T @ r), low, high)
        p, damp = (new, damp / 3) if ((y - f(new)) ** 2).sum() < (r**2).sum() else (p, min(damp * 4, 1e6))
    return tuple(float(v) for v in p)
