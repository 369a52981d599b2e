"""Stateful clustering: download clusters with a length cap, and triggers in a series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators import intervals as I

SECOND = 1_000_000


def _scan(gap: int, cap: int):
    """Folds rows sorted by (ifo, island, start_us, end_us); the state is one open cluster, so memory is one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, start, end, n = None, 0, 0, 0
        for batch in batches:
            out = []
            for ifo, island, s, e in batch.itertuples(index=False):
                if at == (ifo, island) and s - end <= gap and end - start < cap:
                    end, n = max(end, e), n + 1
                    continue
                if at is not None:
                    out.append((at[0], start, end, n))
                at, start, end, n = (ifo, island), s, e, 1
            yield pd.DataFrame(out, columns=["ifo", "start_us", "end_us", "n"])
        if at is not None:
            yield pd.DataFrame([(at[0], start, end, n)], columns=["ifo", "start_us", "end_us", "n"])

    return run


def capped(spans: DataFrame, gap: int = 1500 * SECOND, cap: int = 512 * SECOND, bucket: int = I.HOUR) -> DataFrame:
    """Greedy clusters: a span joins while it starts at most `gap` after the cluster's end and the cluster is shorter
    than `cap`.  Spans over `gap` apart never meet, so islands of padded spans are scanned apart, in parallel."""
    s = spans.select("ifo", "start_us", "end_us")
    islands = I.merge(s.select("ifo", "start_us", (F.col("end_us") + gap + 1).alias("end_us"))).select("ifo", F.col("start_us").alias("island"), "end_us")
    parts = I._bucketed(islands.withColumn("start_us", F.col("island")), bucket).select("ifo", "b", "island", F.col("end_us").alias("island_end"))
    j = s.withColumn("b", F.floor(F.col("start_us") / bucket)).join(parts, ["ifo", "b"]).where((F.col("start_us") >= F.col("island")) & (F.col("start_us") < F.col("island_end")))
    rows = j.select("ifo", "island", "start_us", "end_us").repartition("ifo", "island").sortWithinPartitions("ifo", "island", "start_us", "end_us")
    return rows.mapInPandas(_scan(gap, cap), "ifo string, start_us long, end_us long, n long")


def triggers(series: Column, threshold: float, window: int) -> Column:
    """Array of (snr, time_index): values over the threshold, clustered while closer than `window` samples to the first
    of the cluster; the first largest value stands for it."""
    kind = "struct<anchor:int,snr:double,time_index:int,done:array<struct<snr:double,time_index:int>>>"
    zero = F.struct(F.lit(-1).alias("anchor"), F.lit(0.0).alias("snr"), F.lit(-1).alias("time_index"), F.array().cast("array<struct<snr:double,time_index:int>>").alias("done")).cast(kind)
    points = F.filter(F.transform(series, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda p: p["v"] > threshold)
    closed = lambda a: F.when(a["anchor"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["snr"].alias("snr"), a["time_index"].alias("time_index")))))

    def step(a, p):
        same = (a["anchor"] >= 0) & (p["i"] - a["anchor"] < window)
        better = ~same | (p["v"] > a["snr"])
        return F.struct(
            F.when(same, a["anchor"]).otherwise(p["i"]).alias("anchor"), F.when(better, p["v"]).otherwise(a["snr"]).alias("snr"),
            F.when(better, p["i"]).otherwise(a["time_index"]).alias("time_index"), F.when(same, a["done"]).otherwise(closed(a)).alias("done"),
        ).cast(kind)

    return F.aggregate(points, zero, step, closed)
