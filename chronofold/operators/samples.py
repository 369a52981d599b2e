"""Selection, dedupe, splits, balance and evaluation over typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.expressions import split_name, uniform
from chronofold.operators.intervals import HOUR, numbered_runs


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by an ingest rank, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def assigned(df: DataFrame, key: str, shares: dict[str, float], seed: str) -> DataFrame:
    return df.withColumn("grp", split_name(uniform(F.col(key), seed), shares))


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Class weights: largest class over own class.  Classes are few; their counts join back."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    top = n.agg(F.max("n").alias("top"))
    return df.join(n.join(top).select(label, (F.col("top") / F.col("n")).alias("weight")), label)


def entropy(df: DataFrame, label: str) -> DataFrame:
    """Label entropy over its maximum; 0 with one label."""
    n = df.groupBy(label).agg(F.count("*").cast("double").alias("n"))
    s = n.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"), F.count("*").alias("k"))
    h = F.ln("t") - F.col("s") / F.col("t")
    return s.select(F.when(F.col("k") > 1, h / F.ln("k")).otherwise(0.0).alias("diversity"))


def balanced(df: DataFrame, label: str, key: str, seed: str) -> DataFrame:
    """As many rows of each label as the rarest has, by least draw."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    u = uniform(F.col(key), seed)
    ranked = df.withColumn("u", u).withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy("u", key)))
    return ranked.join(least).where("rank <= least").drop("u", "rank", "least")


def gaps(df: DataFrame, keys: list[str], at: str, gap: int, bucket: int = 24 * HOUR) -> DataFrame:
    """Clusters (from 0) of rows whose neighbours are at most `gap` apart."""
    d = numbered_runs(df, keys, [at], at, lambda top: F.col(at) - top > gap, bucket)
    return d.groupBy(*keys, F.col("run").alias("cluster")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def nearest_after(left: DataFrame, right: DataFrame, key: str, tolerance: int) -> DataFrame:
    """Each left row with the first right row of its key at most `tolerance` later: equi-join on time buckets."""
    a = left.withColumn("b", F.explode(F.array(F.floor(F.col("us") / tolerance), F.floor(F.col("us") / tolerance) + 1)))
    b = right.select(key, F.col("us").alias("r_us"), F.floor(F.col("us") / tolerance).alias("b"))
    j = a.join(b, [key, "b"]).where((F.col("r_us") >= F.col("us")) & (F.col("r_us") - F.col("us") <= tolerance))
    return j.groupBy(*[c for c in left.columns]).agg(F.min("r_us").alias("r_us"))


def first_within(left: DataFrame, right: DataFrame, keys: list[str], order: str, tolerance: int) -> DataFrame:
    """Each left row with the first right row, by `order`, less than `tolerance` away on either side."""
    b = F.floor(F.col("us") / tolerance)
    a = left.withColumn("b", F.explode(F.array(b - 1, b, b + 1)))
    r = right.select(*keys, b.alias("b"), F.col("us").alias("r_us"), F.col(order).alias("r_order"))
    j = a.join(r, [*keys, "b"]).where(F.abs(F.col("us") - F.col("r_us")) < tolerance)
    return j.groupBy(*left.columns).agg(F.min_by("r_us", "r_order").alias("r_us"), F.min("r_order").alias("r_order"))


def false_alarm_rates(noise: DataFrame, score: Column, seconds: float) -> DataFrame:
    """(score, rate): rows at or above each distinct score, per second of all noise."""
    n = noise.groupBy(score.alias("score")).agg(F.count("*").alias("n"))
    total = noise.agg(F.count("*").alias("total"))
    w = Window.orderBy(F.col("score").desc())
    return n.withColumn("above", F.sum("n").over(w)).join(total).select("score", (F.col("above") / (F.col("total") * seconds)).alias("rate"))


def roc(df: DataFrame, bins: int = 512) -> DataFrame:
    """(threshold, tpr, fpr) at fixed thresholds from one histogram: rows never meet, only `bins` counts do."""
    h = df.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("k")).agg(F.sum(F.col("truth")).alias("p"), F.sum(1 - F.col("truth")).alias("n"))
    w = Window.orderBy(F.col("k").desc())
    every = Window.partitionBy()
    d = h.select("k", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.sum("p").over(every).alias("ps"), F.sum("n").over(every).alias("ns"))
    return d.select((F.col("k") / bins).alias("threshold"), F.try_divide(F.col("tp"), F.col("ps")).alias("tpr"), F.try_divide(F.col("fp"), F.col("ns")).alias("fpr"))
