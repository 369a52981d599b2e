"""Interval algebra over (ifo, start_us, end_us), half-open, in whole microseconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def numbered_runs(df: DataFrame, keys: list[str], order: list[str], top: str, begins: Callable[[Column], Column], bucket: int) -> DataFrame:
    """Rows with the number (`run`, from 1 where the first row begins one) of the run that they are in.

    A run begins where begins(greatest `top` of all earlier rows) says so.  Rows of a key meet within buckets of the
    first order column only; of each bucket one row, with its greatest `top` and its number of runs, meets the others.
    """
    d = df.withColumn("b", F.floor(F.col(order[0]) / bucket))
    near, past = Window.partitionBy(*keys, "b").orderBy(*order), Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    reach = d.groupBy(*keys, "b").agg(F.max(top).alias("reach")).select(*keys, "b", F.max("reach").over(past).alias("reach"))
    d = d.join(reach, [*keys, "b"]).withColumn("reach", F.greatest(F.max(top).over(near.rowsBetween(Window.unboundedPreceding, -1)), "reach"))
    d = d.withColumn("begins", F.coalesce(begins(F.col("reach")).cast("long"), F.lit(0)))
    base = d.groupBy(*keys, "b").agg(F.sum("begins").alias("base")).select(*keys, "b", F.coalesce(F.sum("base").over(past), F.lit(0)).alias("base"))
    inside = F.sum("begins").over(near.rowsBetween(Window.unboundedPreceding, 0))
    return d.join(base, [*keys, "b"]).withColumn("run", F.col("base") + inside).drop("b", "reach", "begins", "base")


def merge(df: DataFrame, bucket: int = 24 * HOUR) -> DataFrame:
    """Union of intervals; touching ones join.  Few rows of a detector meet: see numbered_runs."""
    d = df.where("end_us > start_us").select("ifo", "start_us", "end_us")
    d = numbered_runs(d, ["ifo"], ["start_us", "end_us"], "end_us", lambda top: top.isNull() | (F.col("start_us") > top), bucket)
    return d.groupBy("ifo", "run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("run")


def _bucketed(df: DataFrame, bucket: int) -> DataFrame:
    last = F.floor((F.col("end_us") - 1) / bucket)
    return df.withColumn("b", F.explode(F.sequence(F.floor(F.col("start_us") / bucket), last)))


def overlaps(a: DataFrame, b: DataFrame, bucket: int = HOUR, keys: tuple[str, ...] = ("ifo",)) -> DataFrame:
    """Overlapping pairs by equi-join on time buckets; a pair shows in the bucket where the overlap starts only."""
    x = _bucketed(a, bucket)
    y = _bucketed(b.select(*keys, F.col("start_us").alias("v_start"), F.col("end_us").alias("v_end"), "start_us", "end_us"), bucket).drop("start_us", "end_us")
    start = F.greatest("start_us", "v_start")
    return x.join(y, [*keys, "b"]).where((F.col("v_start") < F.col("end_us")) & (F.col("start_us") < F.col("v_end")) & (F.floor(start / bucket) == F.col("b"))).drop("b")


def subtract(segments: DataFrame, vetoes: DataFrame, bucket: int = HOUR) -> DataFrame:
    """Parts of merged segments outside all vetoes."""
    s, v = merge(segments), merge(vetoes)
    hit = overlaps(s, v, bucket).groupBy("ifo", "start_us", "end_us").agg(F.array_sort(F.collect_list(F.struct("v_start", "v_end"))).alias("cuts"))
    d = s.join(hit, ["ifo", "start_us", "end_us"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<v_start:bigint,v_end:bigint>>")))
    starts = F.concat(F.array("start_us"), F.transform("cuts", lambda c: c["v_end"]))
    ends = F.concat(F.transform("cuts", lambda c: c["v_start"]), F.array("end_us"))
    pieces = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: p["e"] > p["s"])
    return d.select("ifo", F.explode(pieces).alias("p")).select("ifo", F.col("p.s").alias("start_us"), F.col("p.e").alias("end_us"))


def intersect(a: DataFrame, b: DataFrame, bucket: int = HOUR) -> DataFrame:
    """Common parts of two sets whose detectors need not agree."""
    p = overlaps(a.select("start_us", "end_us"), b.select("start_us", "end_us"), bucket, ())
    return p.select(F.greatest("start_us", "v_start").alias("start_us"), F.least("end_us", "v_end").alias("end_us"))


def split(df: DataFrame, length: int) -> DataFrame:
    """Cut at multiples of `length`."""
    k = F.explode(F.sequence(F.floor(F.col("start_us") / length), F.floor((F.col("end_us") - 1) / length)))
    d = df.withColumn("k", k)
    return d.select("ifo", F.greatest("start_us", F.col("k") * length).alias("start_us"), F.least("end_us", (F.col("k") + 1) * length).alias("end_us"))


def pad(df: DataFrame, before: int, after: int) -> DataFrame:
    return df.select("ifo", (F.col("start_us") - before).alias("start_us"), (F.col("end_us") + after).alias("end_us"))


def at_least(df: DataFrame, length: int) -> DataFrame:
    return df.where(F.col("end_us") - F.col("start_us") >= length)


def covered(points: DataFrame, at: Column, segments: DataFrame, bucket: int = HOUR, closed: bool = False) -> DataFrame:
    """Points inside a segment of their detector (range semi-join); closed: the end counts as inside."""
    p = points.withColumn("at", at).withColumn("b", F.floor(at / bucket))
    s = _bucketed(segments.withColumn("end_us", F.col("end_us") + int(closed)), bucket).select("ifo", "b", "start_us", "end_us")
    hit = p["ifo"].eqNullSafe(s["ifo"]) & (p["b"] == s["b"]) & (p["at"] >= s["start_us"]) & (p["at"] < s["end_us"])
    return p.join(s, hit, "left_semi").drop("at", "b")


def largest_per_bin(df: DataFrame, length: int) -> DataFrame:
    """The longest piece of each (bin, detector); earliest among equals."""
    d = split(df, length).withColumn("bin", F.floor(F.col("start_us") / length))
    best = F.max_by(F.struct("start_us", "end_us"), F.struct(F.col("end_us") - F.col("start_us"), -F.col("start_us")))
    return d.groupBy("bin", "ifo").agg(best.alias("x")).select("bin", "ifo", "x.start_us", "x.end_us")


def aligned(df: DataFrame, length: int, ifos: tuple[str, ...]) -> DataFrame:
    """Bins that all given detectors have, with the common part of their largest pieces."""
    d = largest_per_bin(df, length).where(F.col("ifo").isin(*ifos))
    g = d.groupBy("bin").agg(F.count("*").alias("n"), F.max("start_us").alias("start_us"), F.min("end_us").alias("end_us"))
    return g.where((F.col("n") == len(ifos)) & (F.col("end_us") > F.col("start_us"))).drop("n")
