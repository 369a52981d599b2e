"""Window store: Parquet rows (gps_key, gps, label, ifo, windows), one per key, with transactional appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.expressions import gps_key

#: Values of optional columns that an append leaves out.
DEFAULTS = {"label": -1, "kind": "unknown", "snr": float("nan")}


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with their key and default metadata; of rows with one key the latest time, then largest label, stays."""
    d = rows if "gps_key" in rows.columns else rows.withColumn("gps_key", gps_key(F.col("gps")))
    for name, value in DEFAULTS.items():
        d = d.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in d.columns else F.lit(value))
    rest = [c for c in d.columns if c != "gps_key"]
    return d.groupBy("gps_key").agg(F.max_by(F.struct(*rest), F.struct("gps", "label")).alias("r")).select("gps_key", "r.*")


def append(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Adds rows whose key the store lacks.  A failed write leaves the store as it was: Spark commits files at the end."""
    d = keyed(rows)
    try:
        old = spark.read.parquet(path).select("gps_key")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        d = d.join(old, "gps_key", "left_anti")
    d.write.mode("append").parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def looked_up(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted rows with what the store holds and `hit`; misses keep null columns."""
    s = stored.select(F.col("gps_key").alias("stored_key"), *[c for c in stored.columns if c not in wanted.columns])
    return wanted.join(s, wanted["gps_key"] == s["stored_key"], "left").withColumn("hit", F.col("stored_key").isNotNull()).drop("stored_key")


def sound(x: Column, least: int = 0) -> Column:
    """More than `least` samples, all finite."""
    return (F.size(x) > least) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def integrity(df: DataFrame, windows: str = "samples", label: str = "label") -> DataFrame:
    """By label: rows, windows with NaN, infinities or only zeros, and moments of all finite samples."""
    x = F.col(windows)
    good = F.filter(x, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    s = df.select(
        F.col(label).alias("label"), F.exists(x, lambda v: F.isnan(v)).cast("long").alias("nan"), F.exists(x, lambda v: F.abs(v) == float("inf")).cast("long").alias("inf"),
        F.forall(x, lambda v: v == 0).cast("long").alias("zero"), F.array_min(good).alias("lo"), F.array_max(good).alias("hi"), F.size(good).alias("m"),
        F.aggregate(good, F.lit(0.0), lambda a, v: a + v).alias("s"), F.aggregate(good, F.lit(0.0), lambda a, v: a + v * v).alias("q"),
    )
    g = s.groupBy("label").agg(F.count("*").alias("n"), F.sum("nan").alias("n_nan"), F.sum("inf").alias("n_inf"), F.sum("zero").alias("n_zero"), F.min("lo").alias("low"), F.max("hi").alias("high"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("m").alias("m"))
    mean = F.try_divide(F.col("s"), F.col("m"))
    return g.select("label", "n", "n_nan", "n_inf", "n_zero", "low", "high", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide(F.col("q"), F.col("m")) - mean * mean, F.lit(0.0))).alias("std"))
