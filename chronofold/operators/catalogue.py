"""Catalogue rows: run tags, events with parameters, unions, compressed rows, balance and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.expressions import ifos_of, mask_of, uniform
from chronofold.operators import intervals as I

#: Bounds of the observing runs by which catalogue events are tagged, in GPS seconds.
EVENT_RUNS = {"O1": (1126051217, 1137254417), "O2": (1164556817, 1187733618), "O3": (1238166018, 1269363618), "O4": (1368000000, 1400000000)}

#: Start and end of each run, as seconds since 1970 in UTC.
RUN_TIMES = {"O1": (1442016000, 1453161600), "O2": (1480464000, 1503619200), "O3": (1554076800, 1585267200), "O4": (1684940400, 1763481600)}

#: GPS time of 1970-01-01 and the leap seconds that reports assume.
GPS_EPOCH, LEAP = 315964800, 18


def gps_of(unix: Column) -> Column:
    """GPS seconds of UTC seconds, 18 leap seconds taken off."""
    return unix - (GPS_EPOCH + LEAP)


def unix_of(gps: Column) -> Column:
    return gps + (GPS_EPOCH + LEAP)


def run_of(gps: Column, runs: dict[str, tuple] = EVENT_RUNS, default: str = "Unknown") -> Column:
    """Run whose bounds, both included, hold a time."""
    out = None
    for name, (a, b) in runs.items():
        out = F.when(gps.between(a, b), name) if out is None else out.when(gps.between(a, b), name)
    return out.otherwise(default)


def in_ranges(ranges: dict[str, tuple | None]) -> Column:
    """Conjunction of optional closed ranges by column name; null never matches a given range."""
    out = F.lit(True)
    for name, bounds in ranges.items():
        if bounds is not None:
            out = out & F.coalesce(F.col(name).between(*bounds), F.lit(False))
    return out


def distinct_events(df: DataFrame, at: str, order: list[str], per_second: int = 10) -> DataFrame:
    """The first row in order of each tenth of a second."""
    d = df.withColumn("event_key", F.rint(F.col(at) * per_second).cast("long"))
    rest = [c for c in df.columns]
    return d.groupBy("event_key").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select("event_key", "r.*")


def compressed(df: DataFrame, kinds: list[str], runs: list[str]) -> DataFrame:
    """Packed rows: detector mask, kind and run as small numbers, -1 for null or unknown."""
    place = lambda c, names: F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(c)).cast("int") - 1, F.lit(-1))
    return df.select("gps_key", place("kind", kinds).cast("byte").alias("kind"), place("run", runs).cast("byte").alias("run"), mask_of(F.col("seen")).cast("short").alias("mask"), F.coalesce("label", F.lit(-1)).cast("short").alias("label"))


def expanded(df: DataFrame, kinds: list[str], runs: list[str]) -> DataFrame:
    """Inverse of `compressed`; numbers outside the lists give null."""
    name = lambda c, names: F.when(F.col(c) >= 0, F.get(F.array(*map(F.lit, names)), F.col(c).cast("int")))
    return df.select("gps_key", name("kind", kinds).alias("kind"), name("run", runs).alias("run"), ifos_of(F.col("mask").cast("int")).alias("seen"), F.when(F.col("label") >= 0, F.col("label")).cast("int").alias("label"))


def feature_index(glitches: DataFrame, events: DataFrame) -> DataFrame:
    """Union of both kinds of rows; columns of one alone are null in the other."""
    return glitches.withColumn("source", F.lit("glitch")).unionByName(events.withColumn("source", F.lit("event")), allowMissingColumns=True)


def oversampled(df: DataFrame, label: str, key: str, seed: str) -> DataFrame:
    """Every class as large as the largest: whole copies of all its rows, then those with the least draws."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    n = n.join(F.broadcast(n.agg(F.max("n").alias("top"))))
    d = df.withColumn("u", uniform(F.col(key), seed)).join(F.broadcast(n), label)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("u", key))
    d = d.withColumn("copies", F.floor(F.col("top") / F.col("n")) + (rank <= F.col("top") % F.col("n")).cast("long"))
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("u", "n", "top", "copies")


def weighted_draws(df: DataFrame, key: str, weight: str, draws: int, seed: str, buckets: int = 1024) -> DataFrame:
    """(draw, key): rows drawn with replacement by weight, the roulette wheel.  Only bucket sums are added in order over
    all rows; a draw finds its bucket, then its row."""
    d = df.select(key, F.col(weight).cast("double").alias("w"), F.pmod(F.col(key), F.lit(buckets)).cast("int").alias("bucket")).where("w > 0")
    b = d.groupBy("bucket").agg(F.sum("w").alias("size"))
    o = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("top", F.sum("size").over(o)).withColumn("all", F.sum("size").over(Window.partitionBy()))
    r = df.sparkSession.range(draws).select(F.col("id").alias("draw"), uniform(F.col("id"), seed).alias("u"))
    at = r.join(F.broadcast(b), (F.col("u") * F.col("all") >= F.col("top") - F.col("size")) & (F.col("u") * F.col("all") < F.col("top")))
    at = at.select("draw", "bucket", (F.col("u") * F.col("all") - (F.col("top") - F.col("size"))).alias("left"))
    inside = d.withColumn("high", F.sum("w").over(Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))
    hit = at.join(inside, "bucket").where((F.col("left") >= F.col("high") - F.col("w")) & (F.col("left") < F.col("high")))
    return hit.groupBy("draw").agg(F.min(key).alias(key))


def long_everywhere(df: DataFrame, bin_column: str, least: int) -> DataFrame:
    """Rows of bins in which no detector's segment is shorter than `least`."""
    short = df.where(F.col("end_us") - F.col("start_us") < least).select(bin_column).distinct()
    return df.join(short, bin_column, "left_anti")


def best_intersections(a: DataFrame, b: DataFrame, bucket: int = I.HOUR) -> DataFrame:
    """For each left segment the common part with the right one that it shares most time with; first of equals."""
    p = I.overlaps(a.select("start_us", "end_us"), b.select("start_us", "end_us"), bucket, ())
    start, end = F.greatest("start_us", "v_start"), F.least("end_us", "v_end")
    best = F.max_by(F.struct(start.alias("s"), end.alias("e")), F.struct(end - start, -F.col("v_start")))
    return p.groupBy("start_us", "end_us").agg(best.alias("x")).select(F.col("x.s").alias("start_us"), F.col("x.e").alias("end_us"))


def ordered(df: DataFrame, how: str, key: str = "start_us", seed: str = "order") -> DataFrame:
    """Segments in the order of time, of duration, or of a draw."""
    columns = {"chronological": [key], "shortest": [F.col("end_us") - F.col("start_us"), key], "random": [uniform(F.col(key), seed), key]}
    return df.orderBy(*columns[how])


def batched(df: DataFrame, order: str, size: int, groups: list[str]) -> DataFrame:
    """Batch number of each row within its group; an incomplete last batch is dropped."""
    w = Window.partitionBy(*groups)
    d = df.withColumn("place", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    d = d.withColumn("batch", F.floor(F.col("place") / size)).where((F.col("batch") + 1) * size <= F.col("n"))
    return d.withColumn("position", (F.col("place") % size).cast("int")).drop("place", "n")


def stored_windows(df: DataFrame, rate: int, to: int, on: int) -> DataFrame:
    """Windows read at a lower rate: every (rate / to)-th sample, then the centre; a higher rate is an error."""
    if rate % to:
        raise ValueError(f"rate {to} does not divide the stored rate {rate}")
    from chronofold.functions import arrays as A

    return df.withColumn("samples", A.centre_crop(A.decimated(F.col("samples"), rate // to), on))
