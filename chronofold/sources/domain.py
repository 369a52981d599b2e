"""Domain tables as views over the given tables.  Only named columns are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.expressions import IFOS, gps_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ifo(key):
    return F.element_at(F.array(*map(F.lit, IFOS)), (F.pmod(key, F.lit(3)) + 1).cast("int"))


def transients(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"), "user_id", "event_type", "value")
    gps = F.col("us") / 1e6
    return e.select("event_id", "us", gps.alias("gps"), gps_key(gps).alias("gps_key"), _ifo(F.col("user_id")).alias("ifo"), F.col("event_type").alias("kind"), F.col("value").alias("snr"))


def spans(spark: SparkSession, sf_dir: str, kind: str, scale: float) -> DataFrame:
    """(ifo, start_us, end_us): events of a kind, each `snr * scale` seconds long.  Whole microseconds compare exactly."""
    t = transients(spark, sf_dir).where(F.col("kind") == kind)
    return t.select("ifo", F.col("us").alias("start_us"), (F.col("us") + F.floor(F.col("snr") * scale * 1e6)).cast("long").alias("end_us"))


def event_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("mass1"), (F.col("p_size") * 0.8).alias("mass2"), F.col("p_retailprice").alias("distance"), F.col("p_brand").alias("catalog"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, ifo, samples): strain windows of 64 samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.floor(F.col("vec_id") / 3).cast("long").alias("example_id"), _ifo(F.col("vec_id")).alias("ifo"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"), "label")


def window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, pair, x, y): the windows of every two detectors of an example, in the detectors' order."""
    w = windows(spark, sf_dir).select("example_id", "ifo", (F.col("vec_id") % 3).alias("k"), "samples")
    x, y = (w.select("example_id", *[F.col(c).alias(f"{c}_{n}") for c in ("ifo", "k", "samples")]) for n in "xy")
    both = x.join(y, "example_id").where("k_x < k_y")
    return both.select("example_id", F.concat_ws("-", "ifo_x", "ifo_y").alias("pair"), F.col("samples_x").alias("x"), F.col("samples_y").alias("y"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, truth, snr, score): labelled examples; the text column is never read."""
    from chronofold.functions.expressions import uniform

    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth")).join(d, "doc_id")
    u = uniform(F.col("doc_id"), "score")
    return j.select("doc_id", "truth", (F.col("n_chars") / 1000.0).alias("snr"), F.when(F.col("truth") == 1, F.sqrt(u)).otherwise(u * u).alias("score"))
