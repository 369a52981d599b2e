"""Named queries on waveforms, windows, spectra and detector geometry, each with its DuckDB form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chronofold.functions import arrays as A
from chronofold.functions import draws as R
from chronofold.functions import geometry as G
from chronofold.functions import spectral as P
from chronofold.functions import waveforms as V
from chronofold.functions.expressions import IFOS, uniform
from chronofold.operators import clusters as C
from chronofold.sources import domain as D

#: Query parameters: samples of a window, its rate, and a matched-filter bank of Hann-enveloped tones.
N, RATE = 64, 64.0
BANK = np.array([np.hanning(N) * np.sin(2 * np.pi * (4 + 3 * t) * np.arange(N) / N) for t in range(4)])


def _sum(x, digits: int = 5):
    """Sum weighted by place: one number that tells whether all samples agree."""
    return F.round(A.total(F.transform(x, lambda v, i: v * (i + 1))), digits)


def _bins(df, key: str, values: str, name: str = "bin"):
    return df.select(key, F.posexplode(values).alias(name, "v"))


def _parts(spark, d):
    p = D.event_catalogue(spark, d)
    return p.select("p_partkey", "mass1", "mass2", (2 + F.col("mass1") / 4).alias("f"), (1 + F.col("mass2") / 40).alias("amp"), (uniform(F.col("p_partkey"), "phase") * V.TWO_PI).alias("phase"), (F.col("p_partkey") % 40 + 16).alias("count"))


def periodic_waves(spark, d):
    f, a, p, c = (F.col(x) for x in ("f", "amp", "phase", "count"))
    return _parts(spark, d).select("p_partkey", *[_sum(V.periodic(s, N, 1.0, f, a, p, c)).alias(s) for s in ("sine", "square", "sawtooth", "triangle")])


def pulse_waves(spark, d):
    f, a, p, c = (F.col(x) for x in ("f", "amp", "phase", "count"))
    return _parts(spark, d).select(
        "p_partkey", _sum(V.sine_gaussian(N, 1.0, f, F.lit(9.0), a, p)).alias("sine_gaussian"), _sum(V.chirplet(N, 1.0, f, f * 2, F.lit(0.5), a, p, c)).alias("chirplet"),
        _sum(V.ringdown(N, 1.0, f, F.lit(0.25), a, p)).alias("ringdown"), _sum(V.envelope(N, c)).alias("envelope"),
    )


def inspiral_limits(spark, d):
    m1, m2 = F.col("mass1"), F.col("mass2")
    f = V.least_frequency(m1, m2, F.lit(4.0))
    return _parts(spark, d).select("p_partkey", F.round(f, 6).alias("least_hz"), F.round(V.inspiral_seconds(m1, m2, f), 6).alias("seconds"))


def inspiral_waves(spark, d):
    w = V.inspiral(N, RATE, F.col("mass1"), F.col("mass2"), F.col("phase"))
    return _parts(spark, d).select("p_partkey", F.round(A.total(F.transform(w, lambda v, i: v * (i + 1))) * 1e4, 5).alias("plus"))


def white_windows(spark, d):
    return D.windows(spark, d).select("vec_id", _sum(V.white_noise(N, F.col("vec_id"), "white")).alias("white"))


def welch_density(spark, d):
    w = D.windows(spark, d).select("vec_id", P.psd(F.col("samples"), RATE, 16).alias("p"))
    return _bins(w, "vec_id", "p").select("vec_id", "bin", F.round("v", 8).alias("power"))


def spectrogram_frames(spark, d):
    w = D.windows(spark, d).select("vec_id", P.spectrogram(F.col("samples"), 32, 16).alias("p"))
    f = w.select("vec_id", F.posexplode("p").alias("frame", "q"))
    return f.select("vec_id", "frame", F.posexplode("q").alias("bin", "v")).select("vec_id", "frame", "bin", F.round("v", 7).alias("power"))


def resampled_windows(spark, d):
    w = D.windows(spark, d)
    return w.select("vec_id", _sum(P.resampled(F.col("samples"), 0.5)).alias("half"))


def matched_filter(spark, d):
    w = D.windows(spark, d).select("vec_id", P.best_match(F.col("samples"), BANK, RATE).alias("m"))
    m = F.col("m")
    return w.select("vec_id", F.round(m[0], 6).alias("snr"), m[1].cast("int").alias("template"), m[2].cast("int").alias("sample"))


def series_triggers(spark, d):
    t = D.windows(spark, d).select("vec_id", F.explode(C.triggers(F.transform("samples", lambda v: F.abs(v)), 0.15, 8)).alias("t"))
    return t.select("vec_id", "t.time_index", F.round("t.snr", 9).alias("snr"))


def shift_correlation(spark, d):
    r = D.window_pairs(spark, d).select("example_id", "pair", F.posexplode(A.rolling_pearson(F.col("x"), F.col("y"), 4)).alias("shift", "v"))
    return r.select("example_id", "pair", "shift", F.round("v", 6).alias("r"))


def line_residuals(spark, d):
    return D.windows(spark, d).select("vec_id", _sum(F.transform(A.line_detrended(F.col("samples")), lambda v, i: v * i)).alias("residual"))


def scaled_windows(spark, d):
    x = F.col("samples")
    return D.windows(spark, d).select("vec_id", _sum(A.scaled_to(x, A.root_sum_square(x, RATE), 2.0)).alias("hrss"), _sum(A.scaled_to(x, A.peak(x), 2.0)).alias("hpeak"))


def window_extraction(spark, d):
    w = D.windows(spark, d).select("vec_id", A.around_centre(F.col("samples"), 16, 32).alias("p"), A.around_centre(F.col("samples"), 48, 16).alias("q"))
    return w.select("vec_id", _sum(F.col("p.onsource")).alias("on"), _sum(F.col("p.offsource")).alias("off"), _sum(F.col("q.offsource")).alias("padded"))


def drawn_subsections(spark, d):
    w = D.windows(spark, d).select("vec_id", A.subsection(F.col("samples"), uniform(F.col("vec_id"), "sub"), 8, 16).alias("p"))
    return w.select("vec_id", F.col("p.start").alias("start"), _sum(F.col("p.onsource")).alias("on"), _sum(F.col("p.offsource")).alias("off"))


def augmented_windows(spark, d):
    """Sign flip, time reversal and circular shift by draws of the example."""
    x, k = F.col("samples"), F.col("vec_id")
    flipped = F.when(uniform(k, "flip") < 0.5, F.transform(x, lambda v: -v)).otherwise(x)
    turned = F.when(uniform(k, "turn") < 0.5, F.reverse(flipped)).otherwise(flipped)
    by = F.floor(uniform(k, "roll") * N).cast("int")
    w = D.windows(spark, d).select("vec_id", turned.alias("x"), by.alias("by"))
    return w.select("vec_id", _sum(A.rolled(F.col("x"), F.col("by"))).alias("augmented"), _sum(A.moved(F.col("x"), F.col("by") - 32)).alias("moved"))


def injected_windows(spark, d):
    """Window plus a sine-Gaussian scaled to an hrss of 1, for the half of examples that a draw selects."""
    k = F.col("vec_id")
    s = V.sine_gaussian(N, 1.0, 4 + uniform(k, "f") * 8, F.lit(9.0), F.lit(1.0), uniform(k, "p") * V.TWO_PI)
    w = D.windows(spark, d).select("vec_id", "samples", s.alias("s"), (uniform(k, "chance") < 0.5).alias("hit"))
    scaled = A.scaled_to(F.col("s"), A.root_sum_square(F.col("s"), RATE), 1.0)
    return w.select("vec_id", "hit", _sum(F.when(F.col("hit"), F.zip_with("samples", scaled, lambda a, b: a + b)).otherwise(F.col("samples"))).alias("mixed"))


def antenna_patterns(spark, d):
    net, k = G.network({i: G.SITES[i] for i in IFOS}), F.col("event_id")
    ra, dec = G.sky(k, "sky")
    t = D.transients(spark, d).select("event_id", ra.alias("ra"), dec.alias("dec"), (uniform(k, "psi") * V.TWO_PI).alias("psi"))
    cols = []
    for i, det in net.items():
        plus, cross = G.antenna(det, F.col("ra"), F.col("dec"), F.col("psi"))
        cols += [F.round(plus, 6).alias(f"{i}_plus"), F.round(cross, 6).alias(f"{i}_cross"), F.round(G.delay(det, F.col("ra"), F.col("dec")) * 1000, 6).alias(f"{i}_ms")]
    return t.select("event_id", *cols)


def distribution_draws(spark, d):
    k = F.col("event_id")
    u = lambda s: uniform(k, s)
    return D.transients(spark, d).select(
        "event_id", F.round(R.uniform_between(u("a"), 5, 9), 9).alias("uniform"), F.round(R.log_uniform(u("b"), -1, 2), 6).alias("log10"), R.choice(u("c"), ["sine", "square", "saw"]).alias("choice"),
        R.power_of_two(u("d"), 3, 6).alias("power"), F.round(R.truncated_normal(u("e"), 10.0, 2.0, 7.0, 15.0), 6).alias("normal"),
    )


def curriculum_table(spark, d):
    """Share and interpolated bounds of every schedule by epoch; the number of epochs is a parameter."""
    e = spark.range(0, 25).select(F.col("id").alias("epoch"))
    x = e.select("epoch", *[R.progress(F.col("epoch"), 20, s).alias(s) for s in ("linear", "exponential", "cosine", "step")])
    return x.select("epoch", *[F.round(R.between(F.col(s), 8.0, 20.0), 6).alias(s) for s in ("linear", "exponential", "cosine", "step")])


def _noisy(spark, d):
    """Windows with a background of 256 samples of white noise."""
    k = F.col("vec_id")
    return D.windows(spark, d).select("vec_id", "samples", V.white_noise(256, k, "background").alias("background"))


def whitened_windows(spark, d):
    w = _noisy(spark, d).select("vec_id", P.whitened(F.col("background"), F.col("background"), RATE, highpass=4.0).alias("w"))
    return w.select("vec_id", _sum(A.centre_crop(F.col("w"), 128), 4).alias("whitened"), F.round(A.root_sum_square(F.col("w"), RATE), 6).alias("hrss"))


def injection_snrs(spark, d):
    return _noisy(spark, d).select("vec_id", F.round(P.snr(F.col("samples"), F.col("background"), RATE, 64, 32), 6).alias("snr"))


def projected_waves(spark, d):
    """A wave seen by each detector: antenna pattern times polarisations, later by its delay."""
    net, k = G.network({i: G.SITES[i] for i in IFOS}), F.col("p_partkey")
    ra, dec = G.sky(k, "sky")
    h = V.sine_gaussian(N, 1.0, F.col("f"), F.lit(9.0), F.lit(1.0), F.col("phase"))
    w = _parts(spark, d).select("p_partkey", h.alias("h"), ra.alias("ra"), dec.alias("dec"), F.col("phase").alias("psi"))
    cols = []
    for i, det in net.items():
        plus, _ = G.antenna(det, F.col("ra"), F.col("dec"), F.col("psi"))
        cols.append(P.shifted(F.transform("h", lambda v, g=plus: v * g), G.delay(det, F.col("ra"), F.col("dec")), RATE).alias(i))
    return w.select("p_partkey", *cols).select("p_partkey", *[_sum(F.col(i)).alias(i) for i in IFOS])


def coloured_windows(spark, d):
    """White noise with the spectrum of another window."""
    w = D.windows(spark, d).select("vec_id", P.pseudo_real(V.white_noise(N, F.col("vec_id"), "colour"), F.col("samples"), RATE, 32).alias("c"))
    return w.select("vec_id", _sum("c").alias("coloured"))


def noise_bursts(spark, d):
    k = F.col("p_partkey")
    w = _parts(spark, d).select("p_partkey", P.bursts(V.white_noise(N, k, "burst"), RATE, F.col("count") / RATE, F.col("f"), F.col("f") + 8).alias("b"))
    return w.select("p_partkey", _sum("b").alias("burst"))


#: The last five have no SQL form; tests hold their kernels against direct sums.
QUERIES = (
    periodic_waves, pulse_waves, inspiral_limits, inspiral_waves, white_windows, welch_density, spectrogram_frames, resampled_windows, matched_filter, series_triggers, shift_correlation, line_residuals,
    scaled_windows, window_extraction, drawn_subsections, augmented_windows, injected_windows, antenna_patterns, distribution_draws, curriculum_table,
    whitened_windows, injection_snrs, projected_waves, coloured_windows, noise_bursts,
)


def oracle_sql() -> dict[str, str]:
    from chronofold.plans.catalog import CAT, DRAW, WIN, T

    u = lambda key, salt: DRAW.format(key=key, salt=salt)
    tau = "2 * pi()"
    dot = lambda e, n=64: f"list_sum(list_transform(range({n}), lambda i: CAST(({e}) * (i + 1) AS DOUBLE)))"
    of = lambda a: f"list_sum(list_transform({a}, lambda v, i: v * i))"
    parts = f"""{CAT}, p AS (SELECT p_partkey, mass1, mass2, 2 + mass1 / 4 AS f, 1 + mass2 / 40 AS amp, {u('p_partkey', 'phase')} * {tau} AS phase, p_partkey % 40 + 16 AS c, (64 - (p_partkey % 40 + 16)) // 2 AS s FROM c)"""
    env = f"(CASE WHEN i >= s AND i < s + c THEN 0.5 - 0.5 * cos({tau} * (i - s) / greatest(c - 1, 1)) ELSE 0 END)"
    t, phi = "(CAST(i AS DOUBLE) / 63)", f"({tau} * f * (CAST(i AS DOUBLE) / 63) + phase)"
    turn = f"(f * {t} + phase / ({tau}))"
    saw = f"(2 * ({turn} - floor({turn})) - 1)"
    left = "(CAST(0.9 AS DOUBLE) - CAST(i AS DOUBLE) / 64)"
    mcs = f"({V.G_SI * V.SOLAR_SI / V.C_SI**3!r}::DOUBLE * pow(pow(mass1 * mass2, 3) / (mass1 + mass2), 0.2))"
    dft = lambda rows, width: f"""(SELECT {{keys}}, k, sum(v * cos({tau} * k * i / {width})) AS re, sum(v * sin({tau} * k * i / {width})) AS im FROM {rows}, range({width // 2 + 1}) kk(k) GROUP BY ALL)"""
    points = "e AS (SELECT vec_id, i, x[i + 1] AS v FROM w, range(64) t(i))"
    bank = "bank AS (SELECT t, list_transform(range(64), lambda i: (0.5 - 0.5 * cos(2 * pi() * i / 63)) * sin(2 * pi() * (4 + 3 * t) * i / 64)) AS h FROM range(4) b(t))"
    net = G.network({i: G.SITES[i] for i in IFOS})
    X = ["(-cos(psi)*sin(ra) - sin(psi)*cos(ra)*sin(de))", "(-cos(psi)*cos(ra) + sin(psi)*sin(ra)*sin(de))", "(sin(psi)*cos(de))"]
    Y = ["(sin(psi)*sin(ra) - cos(psi)*cos(ra)*sin(de))", "(sin(psi)*cos(ra) + cos(psi)*sin(ra)*sin(de))", "(cos(psi)*cos(de))"]
    form = lambda r, a, b: " + ".join(f"({float(r[i][j])!r}::DOUBLE) * {a[i]} * {b[j]}" for i in range(3) for j in range(3))
    pattern = ", ".join(
        f"round({form(x.response, X, X)} - ({form(x.response, Y, Y)}), 6) AS \"{n}_plus\", round({form(x.response, X, Y)} + {form(x.response, Y, X)}, 6) AS \"{n}_cross\", "
        f"round(({float(x.location[0])!r}::DOUBLE * cos(de)*cos(ra) - {float(x.location[1])!r}::DOUBLE * cos(de)*sin(ra) + {float(x.location[2])!r}::DOUBLE * sin(de)) / 299792458.0 * 1000, 6) AS \"{n}_ms\""
        for n, x in net.items()
    )
    horner = lambda x, terms: "(" * (len(terms) - 1) + f"{terms[0]!r}::DOUBLE" + "".join(f" * {x} + {v!r}::DOUBLE)" for v in terms[1:])
    tail = lambda q: f"({horner(q, R.ACKLAM_C)} / ({horner(q, R.ACKLAM_D)} * {q} + 1))"
    normal = f"""CASE WHEN p < 0.02425 THEN {tail('sqrt(-2 * ln(p))')} WHEN p > 0.97575 THEN -{tail('sqrt(-2 * ln(1 - p))')} ELSE {horner('((p - 0.5) * (p - 0.5))', R.ACKLAM_A)} * (p - 0.5) / ({horner('((p - 0.5) * (p - 0.5))', R.ACKLAM_B)} * ((p - 0.5) * (p - 0.5)) + 1) END"""
    lo, hi = (R.NormalDist().cdf(z) for z in (-1.5, 2.5))
    return {
        "periodic_waves": f"""WITH {parts} SELECT p_partkey, round({dot(f'amp * sin({phi}) * {env}')}, 5) + 0.0 AS sine, round({dot(f'amp * sign(sin({phi})) * {env}')}, 5) + 0.0 AS square,
            round({dot(f'amp * {saw} * {env}')}, 5) + 0.0 AS sawtooth, round({dot(f'amp * (2 * abs({saw}) - 1) * {env}')}, 5) + 0.0 AS triangle FROM p""",
        "pulse_waves": f"""WITH {parts}, q AS (SELECT *, 9.0 / (f * sqrt(2) * pi()) AS w FROM p) SELECT p_partkey,
            round({dot(f'amp * sin({tau} * f * ({t} - 0.5) + phase) * exp(-pow({t} - 0.5, 2) / (2 * w * w))')}, 5) AS sine_gaussian, round({dot(f'amp * sin({tau} * (f * {t} + f * {t} * {t}) + phase) * {env}')}, 5) AS chirplet,
            round({dot(f'amp * sin({phi}) * exp(-{t} / 0.25)')}, 5) AS ringdown, round({dot(env)}, 5) AS envelope FROM q""",
        "inspiral_limits": f"""WITH {parts}, q AS (SELECT p_partkey, {mcs} AS m FROM p), r AS (SELECT *, greatest(1.0::DOUBLE, pow(4.0 / 5, -0.375) * pow(m, -0.625) / (8 * pi())) AS g FROM q)
            SELECT p_partkey, round(g, 6) AS least_hz, round(5 * pow(8 * pi() * g * pow(m, 0.625), -8.0::DOUBLE / 3), 6) AS seconds FROM r""",
        "inspiral_waves": f"""WITH {parts}, q AS (SELECT p_partkey, phase, {mcs} AS m FROM p)
            SELECT p_partkey, round(10000 * {dot(f'CASE WHEN {left} > 0 THEN pow(m, 1.25) * (1 + pow(cos(phase), 2)) / 2 * pow(5 / {left}, 0.25) * cos(-2 * pow({left} / (5 * m), 0.625)) ELSE 0 END')}, 5) AS plus FROM q""",
        "white_windows": f"""WITH n AS (SELECT vec_id, i, md5(vec_id || ':white:' || i) AS h FROM embeddings, range(64) t(i)), z AS (SELECT vec_id, i, CAST('0x' || substr(h, 1, 13) AS BIGINT) / 4503599627370496.0 AS u, CAST('0x' || substr(h, 14, 13) AS BIGINT) / 4503599627370496.0 AS v FROM n)
            SELECT vec_id, round(sum(sqrt(-2 * ln(1 - u)) * cos({tau} * v) * (i + 1)), 5) AS white FROM z GROUP BY vec_id""",
        "welch_density": f"""WITH {WIN}, f AS (SELECT vec_id, fr, i, (x[fr * 8 + i + 1] - list_sum(x) / 64) * (0.5 - 0.5 * cos({tau} * i / 15)) AS v FROM w, range(7) a(fr), range(16) b(i)),
            t AS {dft('f', 16).format(keys='vec_id, fr')} SELECT vec_id, CAST(k AS INTEGER) AS bin, round(avg(re * re + im * im) / (SELECT sum(pow(0.5 - 0.5 * cos({tau} * i / 15), 2)) FROM range(16) b(i)) * (CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) / 64, 8) AS power FROM t GROUP BY vec_id, k""",
        "spectrogram_frames": f"""WITH {WIN}, f AS (SELECT vec_id, fr, i, x[fr * 16 + i + 1] * (0.5 - 0.5 * cos({tau} * i / 31)) AS v FROM w, range(3) a(fr), range(32) b(i)),
            t AS {dft('f', 32).format(keys='vec_id, fr')} SELECT vec_id, CAST(fr AS INTEGER) AS frame, CAST(k AS INTEGER) AS bin, round(re * re + im * im, 7) AS power FROM t""",
        "resampled_windows": f"""WITH {WIN}, {points}, t AS {dft('e', 64).format(keys='vec_id')}, y AS (SELECT vec_id, m, sum((CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) * (re * cos({tau} * k * m / 32) + (CASE WHEN k = 16 THEN 0 ELSE im END) * sin({tau} * k * m / 32))) / 32 / 2 AS v FROM t, range(32) q(m) WHERE k <= 16 GROUP BY ALL)
            SELECT vec_id, round(sum(v * (m + 1)), 5) AS half FROM y GROUP BY vec_id""",
        "matched_filter": f"""WITH {WIN}, {bank}, s AS (SELECT t, h, sqrt(4 / (64 * 64.0) * ((64 * list_sum(list_transform(h, lambda v: v * v)) + pow(list_sum(h), 2) + pow(list_sum(list_transform(range(64), lambda i: h[i + 1] * (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END))), 2)) / 2)) AS sigma FROM bank),
            c AS (SELECT vec_id, t, n, abs(2 * list_sum(list_transform(range(64), lambda i: x[(i + n) % 64 + 1] * h[i + 1])) / 64 / sigma) AS r FROM w, s, range(64) l(n)),
            b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC) AS place FROM c) SELECT vec_id, round(r, 6) AS snr, CAST(t AS INTEGER) AS template, CAST(n AS INTEGER) AS sample FROM b WHERE place = 1""",
        "series_triggers": f"""WITH RECURSIVE {WIN}, p AS (SELECT vec_id, i, abs(x[i + 1]) AS v FROM w, range(64) t(i) WHERE abs(x[i + 1]) > 0.15), a AS (SELECT vec_id, min(i) AS i FROM p GROUP BY vec_id UNION ALL SELECT a.vec_id, min(p.i) FROM a JOIN p ON p.vec_id = a.vec_id AND p.i >= a.i + 8 GROUP BY a.vec_id),
            g AS (SELECT a.vec_id, p.i, p.v, row_number() OVER (PARTITION BY a.vec_id, a.i ORDER BY p.v DESC, p.i) AS place FROM a JOIN p ON p.vec_id = a.vec_id AND p.i >= a.i AND p.i < a.i + 8) SELECT vec_id, CAST(i AS INTEGER) AS time_index, round(v, 9) AS snr FROM g WHERE place = 1""",
        "shift_correlation": f"""
            WITH {WIN},
                 m AS (SELECT vec_id, example_id, ifo, list_transform(x, lambda v: v - list_sum(x) / 64) AS x FROM w),
                 p AS (SELECT l.example_id, l.ifo || '-' || h.ifo AS pair, l.x AS a, h.x AS b
                       FROM m l JOIN m h ON l.example_id = h.example_id AND l.vec_id % 3 < h.vec_id % 3),
                 s AS (SELECT *, sqrt(list_sum(list_transform(a, lambda v: v * v)) * list_sum(list_transform(b, lambda v: v * v))) + 1e-5 AS size FROM p)
            SELECT example_id, pair, CAST(o AS INTEGER) AS shift,
                   round(list_sum(list_transform(range(64), lambda i: a[i + 1] * b[(i - 4 + o + 64) % 64 + 1])) / size, 6) AS r
            FROM s, range(8) t(o)""",
        "line_residuals": f"WITH {WIN}, {points}, f AS (SELECT vec_id, regr_slope(v, i) AS s, regr_intercept(v, i) AS c FROM e GROUP BY vec_id) SELECT e.vec_id, round(sum((v - c - s * i) * i * (i + 1)), 5) AS residual FROM e JOIN f ON e.vec_id = f.vec_id GROUP BY e.vec_id",
        "scaled_windows": f"WITH {WIN}, m AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) AS a, list_max(list_transform(x, lambda v: abs(v))) AS b FROM w) SELECT vec_id, round({of('x')} * 2 / (a + 1e-7), 5) AS hrss, round({of('x')} * 2 / (b + 1e-7), 5) AS hpeak FROM m",
        "window_extraction": f"WITH {WIN} SELECT vec_id, round({of('x[25:40]')}, 5) AS on, round({of('list_concat(list_transform(range(8), lambda q: x[1]), x[1:24])')}, 5) AS off, round({of('list_concat(list_transform(range(8), lambda q: x[1]), x[1:8])')}, 5) AS padded FROM w",
        "drawn_subsections": f"WITH {WIN}, s AS (SELECT vec_id, x, CAST(16 + floor({u('vec_id', 'sub')} * 24) AS INTEGER) AS start FROM w) SELECT vec_id, start, round({of('x[start + 1:start + 8]')}, 5) AS on, round({of('x[start - 15:start]')}, 5) AS off FROM s",
        "augmented_windows": f"""WITH {WIN}, a AS (SELECT vec_id, CASE WHEN {u('vec_id', 'flip')} < 0.5 THEN list_transform(x, lambda v: -v) ELSE x END AS x FROM w), b AS (SELECT vec_id, CASE WHEN {u('vec_id', 'turn')} < 0.5 THEN list_reverse(x) ELSE x END AS x, CAST(floor({u('vec_id', 'roll')} * 64) AS INTEGER) AS k FROM a)
            SELECT vec_id, round({dot('x[(i - k + 64) % 64 + 1]')}, 5) AS augmented, round({dot('CASE WHEN i - (k - 32) BETWEEN 0 AND 63 THEN x[i - (k - 32) + 1] ELSE 0 END')}, 5) AS moved FROM b""",
        "injected_windows": f"""WITH {WIN}, a AS (SELECT vec_id, x, {u('vec_id', 'chance')} < 0.5 AS hit, 4 + {u('vec_id', 'f')} * 8 AS f, {u('vec_id', 'p')} * {tau} AS phase FROM w), b AS (SELECT *, 9.0 / (f * sqrt(2) * pi()) AS q FROM a),
            s AS (SELECT vec_id, x, hit, list_transform(range(64), lambda i: sin({tau} * f * ({t} - 0.5) + phase) * exp(-pow({t} - 0.5, 2) / (2 * q * q))) AS s FROM b)
            SELECT vec_id, hit, round({of('x')} + CASE WHEN hit THEN {of('s')} / (sqrt(list_sum(list_transform(s, lambda v: v * v)) / 64) + 1e-7) ELSE 0 END, 5) AS mixed FROM s""",
        "antenna_patterns": f"WITH t AS (SELECT event_id, 2 * pi() * {u('event_id', 'skya')} AS ra, asin(2 * {u('event_id', 'skyd')} - 1) AS de, {u('event_id', 'psi')} * {tau} AS psi FROM events) SELECT event_id, {pattern} FROM t",
        "distribution_draws": f"""WITH t AS (SELECT event_id, {u('event_id', 'a')} AS a, {u('event_id', 'b')} AS b, {u('event_id', 'c')} AS c, {u('event_id', 'd')} AS d, {lo!r}::DOUBLE + {u('event_id', 'e')} * ({hi - lo!r}::DOUBLE) AS p FROM events)
            SELECT event_id, round(5 + a * 4, 9) AS uniform, round(pow(10, -1 + b * 3), 6) AS log10, CASE floor(c * 3) WHEN 0 THEN 'sine' WHEN 1 THEN 'square' ELSE 'saw' END AS choice, pow(2, floor(d * 4) + 3) AS power, round(10 + 2 * ({normal}), 6) AS normal FROM t""",
        "curriculum_table": """WITH e AS (SELECT epoch, least(epoch / 19, 1.0::DOUBLE) AS t FROM range(25) r(epoch))
            SELECT epoch, round(8 + 12 * t, 6) AS linear, round(8 + 12 * (1 - exp(-5 * t)), 6) AS exponential, round(8 + 6 * (1 - cos(pi() * t)), 6) AS cosine, CASE WHEN t < 0.5 THEN 8.0::DOUBLE ELSE 20.0::DOUBLE END AS step FROM e""",
    }
