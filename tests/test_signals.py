"""Spectral kernels against direct sums, geometry against known properties, and expressions on small windows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.functions import arrays as A
from chronofold.functions import geometry as G
from chronofold.functions import spectral as P
from chronofold.plans import catalog, signals

SF = "/root/testdata/sf0.001"


def dft(x):
    n = len(x)
    return np.array([sum(x[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n)) for k in range(n // 2 + 1)])


def inverse(s, n):
    w = np.full(len(s), 2.0)
    w[0] = w[-1] = 1
    return np.array([(w * (s.real * np.cos(2 * np.pi * np.arange(len(s)) * i / n) - s.imag * np.sin(2 * np.pi * np.arange(len(s)) * i / n))).sum() / n for i in range(n)])


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(7).normal(size=(3, 64))


def test_welch_constants_and_modes(noise):
    assert np.allclose(P.welch(np.full((1, 64), 3.0), 64.0, 16), 0)
    frames = [noise[0][k : k + 16] - noise[0].mean() for k in range(0, 49, 8)]
    hann = np.hanning(16)
    power = np.array([np.abs(dft(f * hann)) ** 2 / (hann**2).sum() for f in frames])
    scale = np.array([1, *[2] * 7, 1]) / 64
    assert np.allclose(P.welch(noise, 64.0, 16)[0], power.mean(0) * scale)
    assert np.allclose(P.welch(noise, 64.0, 16, mode="median")[0], np.median(power, 0) * scale)


def test_snr_by_direct_sum(noise):
    h, b = noise[:1], np.random.default_rng(8).normal(size=(1, 256))
    s, x = P.welch(b, 64.0, 64, 32)[0], dft(h[0]) / 64
    want = math.sqrt(4 * sum(abs(x[k]) ** 2 / (s[k] + 1e-10) for k in range(20, 32)))
    assert P.injection_snr(h, b, 64.0, 64, 32)[0] == pytest.approx(want)
    assert P.injection_snr(h * 0, b, 64.0, 64, 32)[0] == 0


def test_whitening_gives_unit_variance():
    x = np.random.default_rng(9).normal(size=(4, 4096)) * 5
    y = P.whitening(x, x, 256.0)[:, 512:-512]
    assert np.allclose(y.std(-1), 1, atol=0.15)
    shaped = P.coloured(x, 256.0, np.array([0.0, 128.0]), np.array([1.0, 9.0]))
    flat = P.welch(P.whitening(shaped, shaped, 256.0)[:, 512:-512], 256.0, 256).mean(0)[10:-10]
    assert flat.max() / flat.min() < 2


def test_fir_by_direct_form():
    t = np.random.default_rng(3).uniform(1, 2, 33)
    soft, hard = [1 / (math.exp(-k / 4) + 1) for k in range(5)], [1 / (math.exp(k / 4) + 1) for k in range(5)]
    s = t.copy()
    s[:3] = 0
    s[3:8] *= soft
    s[-5:] *= hard
    h, w = inverse(s.astype(complex), 64), np.hanning(16)
    kept = np.zeros(64)
    for i in range(8):
        kept[i], kept[56 + i] = h[i] * w[8 + i], h[56 + i] * w[i]
    want = [kept[(i - 7) % 64] for i in range(16)]
    assert np.allclose(P.fir(t[None], 16, 3)[0], want)


def test_convolution_modes(noise):
    taps = np.array([1.0, -2.0, 0.5])
    for mode in ("full", "same", "valid"):
        assert np.allclose(P.convolved(noise, taps)[0] if mode == "same" else P.convolved(noise, taps, mode)[0], np.convolve(noise[0], taps, mode))


def test_delay_and_resampling(noise):
    x = np.zeros((1, 64))
    x[0, 30] = 1
    assert P.delayed(x, np.array([4 / 64]), 64.0)[0].argmax() == 34
    tone = np.sin(2 * np.pi * 3 * np.arange(64) / 64)[None]
    assert np.allclose(P.resampling(tone, 0.5)[0], tone[0][::2])
    assert P.resampling(tone, 2.0).shape == (1, 128) and np.allclose(P.resampling(tone, 2.0)[0][::2], tone[0])
    assert P.resampling(noise, 0.8).shape[1] % 2 == 0


def test_matched_filter_finds_its_template():
    h = np.hanning(32) * np.sin(np.arange(32))
    d = np.zeros(64)
    d[20:52] = 3 * h
    t = np.concatenate([h, np.zeros(32)])
    s = P.filter_series(d[None], t, 64.0)[0]
    assert s.argmax() == 20
    assert s.max() == pytest.approx(abs(2 / 64 * (d * np.roll(t, 20)).sum() / P.template_sigma(t, 64.0)))


def test_burst_stays_in_band_and_time(noise):
    b = P.burst(noise, 64.0, np.full(3, 0.5), np.full(3, 20.0), np.full(3, 10.0))
    assert np.all(b[:, :16] == 0) and np.all(b[:, 48:] == 0) and np.abs(b).max() > 0


def test_patterns_and_places():
    net = G.network(G.SITES)
    for d in net.values():
        assert np.allclose(d.response, d.response.T) and abs(np.trace(d.response)) < 1e-6
        assert 6.35e6 < np.linalg.norm(d.location) < 6.39e6
    assert G.longest_arrival_difference({k: net[k] for k in ("L1", "H1")}) == pytest.approx(0.01001, abs=1e-4)
    assert G.longest_arrival_difference({}) == 0.01


def test_vectorized_ragged_and_null(spark):
    df = spark.createDataFrame([(1, [1.0] * 32), (2, None), (3, [2.0, 1.0] * 32), (4, [0.0, 1.0, 3.0, 1.0] * 8)], "id int, x array<double>")
    got = {r.id: r.p for r in df.select("id", P.psd(F.col("x"), 32.0, 16).alias("p")).collect()}
    assert got[2] is None and len(got[3]) == 9 and np.allclose(got[1], 0)
    assert np.allclose(got[4], P.welch(np.array([[0.0, 1.0, 3.0, 1.0] * 8]), 32.0, 16)[0])


def test_windows_edges(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(10)]), (2, [1.0]), (3, [])], "id int, x array<double>")
    x = F.col("x")
    rows = {r.id: r for r in df.select("id", A.around_centre(x, 4, 2).alias("c"), A.around_centre(x, 4, 5).alias("e"), A.moved(x, F.lit(3)).alias("m"), A.moved(x, F.lit(-3)).alias("n"), A.even(x).alias("v"), A.subsection(x, F.lit(0.5), 2, 2, 1).alias("s")).collect()}
    assert rows[1].c.onsource == [3, 4, 5, 6] and rows[1].c.offsource == [1, 2] and rows[1].e.offsource == [0, 0, 0, 1, 2]
    assert rows[1].m == [0, 0, 0, 0, 1, 2, 3, 4, 5, 6] and rows[1].n == [3, 4, 5, 6, 7, 8, 9, 0, 0, 0]
    assert rows[2].c is None and rows[2].m == [0.0] and rows[2].v == [] and rows[2].s is None and rows[3].c is None
    assert rows[1].s.start == 4 and rows[1].s.onsource == [4, 5] and rows[1].s.offsource == [2, 3]


@pytest.mark.parametrize("name", [q.__name__ for q in signals.QUERIES if q.__name__ not in catalog.oracle_sql()])
def test_rows_of_queries_without_sql(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    assert len(rows) in (200, 500) and all(v is not None and math.isfinite(v) for r in rows for v in r)


def test_long_windows_and_odd_samples(spark):
    """4,096 samples; NaN and infinite samples become 0; a line goes; shifts and pairs agree with NumPy."""
    import numpy as np
    from pyspark.sql import functions as F

    from chronofold.functions import arrays as A

    g = np.random.default_rng(5)
    x, y = g.normal(size=4096) + 0.001 * np.arange(4096), g.normal(size=4096)
    bad = x.copy()
    bad[[3, 70, 4000]] = np.nan, np.inf, -np.inf
    d = spark.createDataFrame([(x.tolist(), y.tolist(), bad.tolist())], "x array<double>, y array<double>, bad array<double>")
    X, Y = F.col("x"), F.col("y")
    r = d.select(A.line_detrended(X).alias("line"), A.detrended(X).alias("flat"), A.pearson(X, Y).alias("r"), A.rolling_pearson(X, Y, 4).alias("rolled"), A.finite(F.col("bad")).alias("clean"), A.scaled_to(X, A.peak(X), 2.0).alias("scaled")).first()
    t = np.arange(4096)
    assert np.allclose(r.line, x - np.polyval(np.polyfit(t, x, 1), t), atol=1e-9) and np.allclose(r.flat, x - x.mean())
    assert abs(r.r - np.corrcoef(x, y)[0, 1]) < 1e-9 and len(r.rolled) == 8
    want = [np.corrcoef(x, np.roll(y, s))[0, 1] for s in (4, 3, 2, 1, 0, -1, -2, -3)]
    assert np.allclose(r.rolled, want, atol=1e-6)
    assert np.array_equal(r.clean, np.where(np.isfinite(bad), bad, 0)) and abs(max(map(abs, r.scaled)) - 2) < 1e-6


def test_labelled_examples_move_no_waves(spark, tmp_path):
    """With a catalogue larger than the planner takes it for, rows are as by SQL, and the join exchanges windows, keys
    and masses, but no bursts."""
    import duckdb

    for name, key, shift, copies in (("part", "p_partkey", 200, 40), ("embeddings", "vec_id", 500, 2)):
        df = spark.read.parquet(f"{SF}/{name}.parquet").crossJoin(spark.range(copies))
        assert df.agg(F.max(key)).first()[0] < shift
        df.withColumn(key, F.col(key) + F.col("id") * shift).drop("id").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name, file in (("part", f"{tmp_path}/part.parquet/*.parquet"), ("embeddings", f"{tmp_path}/embeddings.parquet/*.parquet"), ("events", f"{SF}/events.parquet")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = catalog.queries()["labelled_examples"](spark, str(tmp_path))
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = con.execute(catalog.oracle_sql()["labelled_examples"])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(want.fetchall()) and len(rows) == 1000
    nodes, moved = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        moved += node.metrics().apply("dataSize").value() if node.metrics().contains("dataSize") else 0
    assert 0 < moved < 1000 * 700 + 8000 * 100
