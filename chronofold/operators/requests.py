"""Scans of segments and events, and the parts of window requests: positions, missing detectors, validity, pools."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions import arrays as A
from chronofold.functions.expressions import uniform


def segments_between(df: DataFrame, start: int, stop: int, flag: str) -> DataFrame:
    """Segments of a state flag within [start, stop], cut at its ends."""
    d = df.where((F.col("flag") == flag) & (F.col("end_us") > start) & (F.col("start_us") < stop))
    return d.select("ifo", F.greatest("start_us", F.lit(start)).alias("start_us"), F.least("end_us", F.lit(stop)).alias("end_us"))


def over_runs(df: DataFrame, runs: dict[str, tuple], flag: str) -> DataFrame:
    """Segments of a state flag in each run, cut at its bounds; the runs are parameters, a handful of rows."""
    d = df.where(F.col("flag") == flag)
    every = F.array(*[F.struct(F.lit(n).alias("run"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in runs.items()])
    d = d.withColumn("r", F.explode(F.filter(every, lambda r: (r["a"] < F.col("end_us")) & (F.col("start_us") < r["b"]))))
    return d.select(F.col("r.run").alias("run"), "ifo", F.greatest("start_us", "r.a").alias("start_us"), F.least("end_us", "r.b").alias("end_us"))


def by_run(at: Column, runs: dict[str, tuple], values: dict[str, str]) -> Column:
    """The value of the run that holds a time, both bounds included; that of the first run elsewhere."""
    out = F.when(F.lit(False), F.lit(None))
    for name, (a, b) in runs.items():
        out = out.when(at.between(a, b), values[name])
    return out.otherwise(values[next(iter(runs))])


def times_of(df: DataFrame, ifo: str, start: int, stop: int, kinds: list[str] | None = None) -> DataFrame:
    """Times of one detector: of the given kinds with both bounds included, or of all kinds strictly between them."""
    at, d = F.col("us"), df.where(F.col("ifo") == ifo)
    return d.where((at > start) & (at < stop)) if kinds is None else d.where(at.between(start, stop) & F.col("kind").isin(*kinds))


def listed_events(df: DataFrame, catalogues: dict[str, list[str]], column: str = "catalog") -> DataFrame:
    """Events of each list of catalogues, lists one after the other (`place`); an event in two lists comes twice."""
    parts = [df.where(F.col(column).isin(*names)).withColumn("list", F.lit(name)).withColumn("place", F.lit(k)) for k, (name, names) in enumerate(catalogues.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def complete_network(examples: DataFrame, windows: DataFrame, ifos: tuple[str, ...], samples: int) -> DataFrame:
    """A window for each example and detector; zeros, and `missing`, where a detector has none."""
    wanted = examples.withColumn("ifo", F.explode(F.array(*map(F.lit, ifos))))
    d = wanted.join(windows.where(F.col("ifo").isin(*ifos)), ["example_id", "ifo"], "left")
    return d.select("example_id", "ifo", F.coalesce("samples", F.array_repeat(F.lit(0.0), samples)).alias("samples"), F.col("samples").isNull().alias("missing"))


def validity(x: Column, samples: int) -> Column:
    """Whether a window can be used, and what is wrong with it."""
    bad, zero, long = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == math.inf)), F.forall(x, lambda v: v == 0), F.size(x) == samples
    message = F.when(~long, "wrong size").when(bad, "not finite").when(zero, "all zeros").otherwise("")
    return F.struct((message == "").alias("is_valid"), bad.alias("has_nan"), zero.alias("has_all_zeros"), message.alias("message"))


def contract(df: DataFrame, samples: int, column: str = "samples") -> DataFrame:
    """The same rows; a window of another size stops the query."""
    wrong = F.raise_error(F.concat(F.lit(f"{column} must have {samples} samples, not "), F.size(column).cast("string"))).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(F.size(column) == samples, F.col(column)).otherwise(wrong))


def seen_everywhere(df: DataFrame, windows: DataFrame, wanted: int) -> DataFrame:
    """Examples whose `wanted` detectors all have a window that is not all zeros."""
    good = windows.where(F.exists("samples", lambda v: v != 0)).groupBy("example_id").agg(F.count_distinct("ifo").alias("n")).where(F.col("n") >= wanted)
    return df.join(good.select("example_id"), "example_id", "left_semi")


def available(network: Column, wanted: str) -> Column:
    """All wanted detector letters are in a network; an unknown network counts as available."""
    out = F.lit(True)
    for letter in wanted:
        out = out & network.contains(letter)
    return F.coalesce(out, F.lit(True))


def grid(df: DataFrame, unit: int, on: int, off: int, clamped: bool = False) -> DataFrame:
    """Grid windows of each segment: onsource starts every `on` after the first `off`, all inside the segment.

    clamped: each detector begins a share of the segment later and wraps; starts in the first `off` move up to it.
    """
    length = F.floor((F.col("end_us") - F.col("start_us")) / unit)
    d = df.withColumn("room", length - on - off).where("room > 0" if clamped else "room >= 0")
    if not clamped:
        at = F.sequence(F.lit(off).cast("long"), length - on, F.lit(on).cast("long"))
        return d.withColumn("position", F.explode(at)).drop("room")
    shift = F.col("ifo_index") * F.floor(length / F.col("n_ifos"))
    d = d.withColumn("shift", shift).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("room") - 1) / on))))
    return d.withColumn("position", F.greatest((F.col("k") * on + F.col("shift")) % F.col("room"), F.lit(off))).drop("room", "shift", "k")


def gathered(places: DataFrame, pools: DataFrame) -> DataFrame:
    """Examples back at the batch positions that drew their pool: the n-th position of a pool gets its n-th example."""
    w = Window.partitionBy("batch", "pool").orderBy("position")
    return places.withColumn("nth", F.row_number().over(w)).join(pools, ["batch", "pool", "nth"])


def common_size(df: DataFrame, column: str = "samples") -> DataFrame:
    """Rows whose arrays have the most common size; the smaller of two equally common ones."""
    n = df.groupBy(F.size(column).alias("size")).agg(F.count("*").alias("n")).agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("size"))
    return df.join(n, F.size(column) == F.col("size")).drop("size")


def downsampled(curve: DataFrame, x: str, y: str, points: int) -> DataFrame:
    """(k, x, y): a curve read at evenly spaced x by linear interpolation; non-finite rows and repeated x (after the
    first by y) do not count.  The curve is an aggregate: its rows, not those behind it, meet in one task."""
    ok = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < math.inf) & (F.abs(y) < math.inf)
    d = curve.where(ok).groupBy(F.col(x).alias("x0")).agg(F.min(y).alias("y0"))
    w, every = Window.orderBy("x0"), Window.partitionBy()
    d = d.select("x0", "y0", F.lead("x0").over(w).alias("x1"), F.lead("y0").over(w).alias("y1"), F.min("x0").over(every).alias("lo"), F.max("x0").over(every).alias("hi"))
    k = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    d = d.withColumn("k", k).withColumn("x", F.col("lo") + F.col("k") * ((F.col("hi") - F.col("lo")) / (points - 1)))
    last = (F.col("k") == points - 1) & F.col("x1").isNull()
    inside = (F.col("k") < points - 1) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    y_at = F.when(last, F.col("y0")).otherwise(F.col("y0") + (F.col("x") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    return d.where(last | inside).select("k", F.when(last, F.col("hi")).otherwise(F.col("x")).alias("x"), y_at.alias("y"))


def sample_count(seconds: Column, rate: Column) -> Column:
    """Whole samples of a duration, one less where their number is odd."""
    n = (seconds * rate).cast("long")
    return n - n % 2


def tier(value: Column, steps: tuple) -> Column:
    """The least step that holds the value; the value itself beyond the last."""
    out = F.when(F.lit(False), value)
    for s in steps:
        out = out.when(value <= s, F.lit(s))
    return out.otherwise(value)


def shifted_slice(x: Column, shift: Column, samples: int) -> Column:
    """`samples` samples about the centre of a longer window, moved so that its centre lies `shift` samples later."""
    start = F.floor((F.size(x) - samples) / 2) - shift
    return F.slice(x, F.least(F.greatest(start, F.lit(0)), F.size(x) - samples).cast("int") + 1, samples)


def spread(mask: Column, size: int, values: Column) -> Column:
    """A row of `size` values for each place of a mask: the next ones of `values` where it is true, zeros elsewhere."""
    before = lambda m, i: F.size(F.filter(F.slice(m, 1, i), lambda v: v))
    return A.bound(mask, lambda m: F.transform(m, lambda v, i: F.when(v, F.slice(values, before(m, i) * size + 1, size)).otherwise(F.array_repeat(F.lit(0.0), size))))


def log_gamma_density(x: Column, shape: float, scale: float) -> Column:
    return F.when(x > 0, (shape - 1) * F.ln(x) - x / scale - (math.lgamma(shape) + shape * math.log(scale)))


def log_folded_normal(x: Column, loc: float, scale: float) -> Column:
    kernel = lambda sign: F.exp(-((x + sign * loc) ** 2) / (2 * scale * scale))
    return F.when(x >= 0, F.ln(kernel(1) + kernel(-1)) - math.log(scale * math.sqrt(2 * math.pi)))


def log_truncated_normal(x: Column, loc: float, scale: float, low: float, high: float) -> Column:
    cdf = lambda v: 0.5 * (1 + math.erf((v - loc) / (scale * math.sqrt(2))))
    inside = math.log(cdf(high) - cdf(low)) + math.log(scale * math.sqrt(2 * math.pi))
    return F.when(x.between(low, high), -((x - loc) ** 2) / (2 * scale * scale) - inside)


def log_beta_prime(x: Column, a: float, b: float) -> Column:
    return F.when(x > 0, (a - 1) * F.ln(x) - (a + b) * F.ln(1 + x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))


def detector_table(spark: SparkSession, places: dict[str, tuple]) -> DataFrame:
    """One row per detector of a network; a network holds a handful."""
    return spark.createDataFrame([(n, *map(float, p)) for n, p in places.items()], "ifo string, x double, y double, z double")


def drawn(df: DataFrame, key: str, draws: int, seed: str, buckets: int = 1024) -> DataFrame:
    """(draw, key): rows drawn with replacement, all alike.  Ranks are counted within buckets of the key."""
    from chronofold.operators.catalogue import weighted_draws

    return weighted_draws(df.withColumn("weight", F.lit(1.0)), key, "weight", draws, seed, buckets)


def flipped_and_turned(x: Column, key: Column) -> Column:
    """Sign flip and time reversal, one draw each for a whole example."""
    flips, turns = uniform(key, "flip") < 0.5, uniform(key, "turn") < 0.5
    signed = A.bound(F.when(flips, F.lit(-1.0)).otherwise(F.lit(1.0)), lambda k: F.transform(x, lambda v: v * k))
    return A.bound(signed, lambda w: F.when(turns, F.reverse(w)).otherwise(w))
