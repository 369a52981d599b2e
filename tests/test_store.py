"""Window store, clusters, ranks and streams."""

import numpy as np
from pyspark.sql import functions as F

from chronofold.operators import clusters as C
from chronofold.operators import scoring as E
from chronofold.sources import store
from chronofold.streaming import windows as W


def test_append_keeps_first_of_each_key(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "gps double, label int, samples array<double>")
    store.append(spark, path, frame([(10.0, 1, [1.0]), (10.001, 2, [2.0]), (11.0, None, [3.0])]))
    store.append(spark, path, frame([(11.0, 5, [9.0]), (12.0, 6, [4.0])]))
    rows = {r.gps_key: (r.label, r.samples, r.kind) for r in store.scan(spark, path).collect()}
    assert rows == {1000: (2, [2.0], "unknown"), 1100: (-1, [3.0], "unknown"), 1200: (6, [4.0], "unknown")}
    hits = store.looked_up(spark.createDataFrame([(1000,), (1300,)], "gps_key long"), store.scan(spark, path).select("gps_key", "label"))
    assert {(r.gps_key, r.label, r.hit) for r in hits.collect()} == {(1000, 2, True), (1300, None, False)}


def test_integrity_counts(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [1.0, nan]), (1, [0.0, 0.0]), (1, [inf, 3.0]), (2, [])], "label int, samples array<double>")
    rows = {r.label: r for r in store.integrity(df).collect()}
    assert (rows[1].n, rows[1].n_nan, rows[1].n_inf, rows[1].n_zero, rows[1].low, rows[1].high, rows[1]["mean"]) == (3, 1, 1, 1, 0.0, 3.0, 1.0)
    assert rows[2].n == 1 and rows[2]["mean"] is None


def test_capped_clusters_against_a_scan(spark):
    rng = np.random.default_rng(5)
    spans = [(f"D{k}", int(s), int(s + e)) for k in range(2) for s, e in zip(np.sort(rng.integers(0, 4000, 150)), rng.integers(1, 40, 150), strict=True)]
    spans += [("D9", 0, 1)]
    want = []
    for ifo in ("D0", "D1", "D9"):
        rows = sorted((s, e) for i, s, e in spans if i == ifo)
        a, b, n = rows[0][0], rows[0][1], 1
        for s, e in rows[1:]:
            if s - b <= 20 and b - a < 100:
                b, n = max(b, e), n + 1
            else:
                want.append((ifo, a, b, n))
                a, b, n = s, e, 1
        want.append((ifo, a, b, n))
    df = spark.createDataFrame(spans, "ifo string, start_us long, end_us long")
    assert sorted(tuple(r) for r in C.capped(df, 20, 100, 500).collect()) == sorted(want)
    assert C.capped(df.limit(0)).collect() == []


def test_triggers_anchor_at_the_first(spark):
    x = [0.0, 5.0, 6.0, 6.0, 4.0, 7.0, 0.0, 9.0]
    df = spark.createDataFrame([(x,), ([],), ([1.0],)], "x array<double>")
    got = [[(t.time_index, t.snr) for t in r.t] for r in df.select(C.triggers(F.col("x"), 3.0, 3).alias("t")).collect()]
    assert got == [[(2, 6.0), (5, 7.0), (7, 9.0)], [], []]


def test_rank_over_all_rows_and_ties(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.5, 1.0, 0.5, 0.0, 0.99, 0.5])], "id int, s double")
    rows = {r.id: (r["rank"], r.n) for r in E.ranked(df, "s", 4, ("id",)).collect()}
    assert rows == {1: (1, 6), 4: (2, 6), 0: (3, 6), 2: (4, 6), 5: (5, 6), 3: (6, 6)}


def test_sigmoid_fit():
    x = np.linspace(0, 25, 40)
    y = 0.7 / (1 + np.exp(-0.8 * (x - 11))) + 0.2
    assert np.allclose(E.sigmoid_fit(list(zip(x, y, strict=True))), (11, 0.8, 0.7, 0.2), atol=1e-3)


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value", "event_id")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "store")
    rows = live.select(F.unix_micros("ts").alias("us"), (F.unix_micros("ts") / 1e6).alias("gps"), F.col("event_id").cast("int").alias("label"))
    W.append_misses(rows, path, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    keys = store.keyed(events.select((F.unix_micros("ts") / 1e6).alias("gps")))
    assert store.scan(spark, path).count() == keys.count()
    once = W.first_by_key(live, ["event_id"], "60 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == W.first_by_key(events, ["event_id"]).count() == events.select("event_id").distinct().count()
