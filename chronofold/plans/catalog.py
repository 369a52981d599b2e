"""Named queries over the given tables, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import arrays as A
from chronofold.functions import expressions as X
from chronofold.operators import intervals as I
from chronofold.operators import samples as S
from chronofold.sources import domain as D
from chronofold.streaming import windows as W

SHARES = {"train": 0.8, "validate": 0.1, "test": 0.1}
SECOND = 1_000_000

T = """t AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS gps, CAST(round_even(epoch_us(ts) / 1e6 * 100, 0) AS BIGINT) AS gps_key,
  CASE user_id % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'H1' ELSE 'V1' END AS ifo, event_type AS kind, value AS snr FROM events)"""
DRAW = "(CAST('0x' || substr(md5({key} || ':{salt}'), 1, 13) AS BIGINT) / 4503599627370496.0)"
SCORES = "s AS (SELECT l.doc_id, quality AS truth, n_chars / 1000.0 AS snr, CASE WHEN quality = 1 THEN sqrt(u) ELSE u * u END AS score FROM (SELECT *, " + DRAW.format(key="doc_id", salt="score") + " AS u FROM labels) l JOIN documents d ON d.doc_id = l.doc_id)"


def _spans(name: str, kind: str, scale: float) -> str:
    return f"{name} AS (SELECT ifo, us AS start_us, us + CAST(floor(snr * {scale} * 1e6) AS BIGINT) AS end_us FROM t WHERE kind = '{kind}')"


def _merged(out: str, source: str) -> str:
    return f"""{out}_1 AS (SELECT *, max(end_us) OVER (PARTITION BY ifo ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {source} WHERE end_us > start_us),
      {out}_2 AS (SELECT *, sum(CASE WHEN top IS NULL OR start_us > top THEN 1 ELSE 0 END) OVER (PARTITION BY ifo ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM {out}_1),
      {out} AS (SELECT ifo, min(start_us) AS start_us, max(end_us) AS end_us FROM {out}_2 GROUP BY ifo, island)"""


BASE = f"WITH {T}, {_spans('a', 'click', 20)}, {_spans('v', 'error', 5)}, {_merged('ma', 'a')}, {_merged('mv', 'v')}"
SPLIT = "(SELECT ifo, greatest(start_us, k * {n}) AS start_us, least(end_us, (k + 1) * {n}) AS end_us, k AS bin FROM ma, LATERAL (SELECT unnest(range(start_us // {n}, (end_us - 1) // {n} + 1)) AS k))"


def _segments(spark, d):
    return D.spans(spark, d, "click", 20)


def _vetoes(spark, d):
    return D.spans(spark, d, "error", 5)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Dedupe, hash split, class weights and counts of the transient index."""
    t = S.first_of(D.transients(spark, d).select("event_id", "gps_key", "kind", "ifo"), ["gps_key", "kind", "ifo"], "event_id")
    w = S.weighted(S.assigned(t, "gps_key", SHARES, "42"), "kind")
    return w.groupBy("grp", "kind").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def catalogue_search(spark, d):
    c = D.event_catalogue(spark, d)
    c = c.where(F.col("mass1").between(10, 40) & F.col("mass2").between(5, 30) & F.col("distance").between(900, 1500) & F.lower("name").contains("ring"))
    return c.select("p_partkey", "name", "mass1", F.round("mass2", 6).alias("mass2"), X.source_type(F.col("mass1"), F.col("mass2")).alias("source"))


def mass_functions(spark, d):
    c = D.event_catalogue(spark, d)
    m1, m2 = F.col("mass1"), F.col("mass2")
    return c.select("p_partkey", F.round(X.chirp_mass(m1, m2), 6).alias("chirp"), F.round(m2 / m1, 6).alias("ratio"), F.round(m1 + m2, 6).alias("total"), X.source_type(m1, m2).alias("source"))


def detection_probability(spark, d):
    t = D.transients(spark, d)
    return t.select("event_id", F.round(X.detection_probability(F.col("snr"), 50.0, 10.0), 9).alias("p"))


def transient_split(spark, d):
    return S.assigned(D.transients(spark, d).select("event_id", "gps_key"), "gps_key", SHARES, "7")


def noise_split(spark, d):
    """Groups of 8192-second chunks of merged segments."""
    s = I.split(I.merge(_segments(spark, d)), 8192 * SECOND).withColumn("chunk", F.floor(F.col("start_us") / (8192 * SECOND)))
    return S.assigned(s, "chunk", SHARES, "noise").groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("us"))


def index_filter(spark, d):
    t = S.assigned(D.transients(spark, d), "gps_key", SHARES, "42")
    return t.where((F.col("grp") == "train") & F.col("kind").isin("click", "view") & F.col("ifo").isin("L1", "H1")).select("event_id", "gps_key", "kind", "ifo")


def detector_masks(spark, d):
    t = D.transients(spark, d).groupBy("gps_key").agg(F.array_sort(F.collect_set("ifo")).alias("seen"))
    m = X.mask_of(F.col("seen"))
    return t.select("gps_key", m.alias("mask"), F.concat_ws(",", F.array_sort(X.ifos_of(m))).alias("seen"))


def interval_merge(spark, d):
    return I.merge(_segments(spark, d))


def interval_subtract(spark, d):
    return I.subtract(_segments(spark, d), _vetoes(spark, d))


def interval_intersect(spark, d):
    m = I.merge(_segments(spark, d))
    return I.intersect(m.where("ifo = 'L1'"), m.where("ifo = 'H1'"))


def interval_split(spark, d):
    return I.split(I.merge(_segments(spark, d)), 1024 * SECOND)


def interval_align(spark, d):
    return I.aligned(I.merge(_segments(spark, d)), 4096 * SECOND, ("L1", "H1"))


def largest_per_bin(spark, d):
    return I.largest_per_bin(I.merge(_segments(spark, d)), 4096 * SECOND)


def veto_padding(spark, d):
    return I.at_least(I.merge(I.pad(_vetoes(spark, d), 2 * SECOND, 2 * SECOND)), 60 * SECOND)


def allowed_members(spark, d):
    t = D.transients(spark, d).where("kind = 'view'").select("event_id", "ifo", "us")
    return I.covered(t, F.col("us"), I.merge(_segments(spark, d))).select("event_id", "ifo")


def grid_windows(spark, d):
    """Batches and windows on a grid in each merged segment: 1 s onsource after 16 s offsource."""
    s = I.merge(_segments(spark, d)).withColumn("seconds", F.floor((F.col("end_us") - F.col("start_us")) / SECOND))
    return s.select("ifo", "start_us", F.greatest(F.lit(1), F.floor(F.col("seconds") / 32)).cast("long").alias("batches"), F.greatest(F.lit(0), F.col("seconds") - 16).cast("long").alias("windows"))


def gap_clusters(spark, d):
    return S.gaps(D.transients(spark, d).select("ifo", "us"), ["ifo"], "us", 600 * SECOND)


def tolerance_match(spark, d):
    t = D.transients(spark, d)
    return S.nearest_after(t.where("kind = 'error'").select("event_id", "ifo", "us"), t.where("kind = 'purchase'").select("ifo", "us"), "ifo", 1800 * SECOND)


def class_weights(spark, d):
    return S.weighted(D.windows(spark, d).select("vec_id", "label"), "label").select("vec_id", "label", F.round("weight", 9).alias("weight"))


def label_entropy(spark, d):
    return S.entropy(D.transients(spark, d).select("kind"), "kind").select(F.round("diversity", 9).alias("diversity"))


def balanced_subsample(spark, d):
    return S.balanced(D.windows(spark, d).select("vec_id", "label"), "label", "vec_id", "bal")


def efficiency_bins(spark, d):
    s = D.scores(spark, d).where("truth = 1").withColumn("bin", F.floor("snr").cast("long"))
    g = s.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("score"), 8).alias("mean"), F.round(F.stddev_pop("score"), 8).alias("std"))
    return g.where("n > 10")


def false_alarm_curve(spark, d):
    r = S.false_alarm_rates(D.scores(spark, d).where("truth = 0"), F.round("score", 3), 2.0)
    return r.select("score", F.round("rate", 9).alias("rate"))


def roc_curve(spark, d):
    return S.roc(D.scores(spark, d)).select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


def worst_noise(spark, d):
    s = D.scores(spark, d).where("truth = 0").select("doc_id", F.round("score", 9).alias("score"))
    return s.orderBy(F.desc("score"), "doc_id").limit(25)


def worst_per_bin(spark, d):
    from pyspark.sql import Window

    s = D.scores(spark, d).where("truth = 1").select("doc_id", F.round("score", 9).alias("score"), F.least(F.floor("snr"), F.lit(9)).cast("long").alias("bin"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy("score", "doc_id"))).where("rank <= 3").select("bin", "rank", "doc_id", "score")


def pool_draws(spark, d):
    p = X.split_name(X.uniform(F.col("event_id"), "pool"), {"noise": 0.5, "signal": 0.3, "glitch": 0.2})
    return D.transients(spark, d).groupBy(p.alias("pool")).agg(F.count("*").alias("n"))


def window_amplitudes(spark, d):
    w, x = D.windows(spark, d), F.col("samples")
    return w.select("vec_id", F.round(A.root_sum_square(x, 64.0), 6).alias("hrss"), F.round(A.peak(x), 6).alias("hpeak"), F.round(A.mean(x), 6).alias("mean"), F.round(F.array_max(x), 6).alias("high"), F.round(F.array_min(x), 6).alias("low"))


def window_shapes(spark, d):
    """Detrend, crop, decimate, reverse and frame; their sums identify the arrays."""
    w, x = D.windows(spark, d), A.finite(F.col("samples"))
    dot = lambda a: F.round(A.total(F.transform(a, lambda v, i: v * (i + 1))), 5)
    return w.select("vec_id", dot(A.detrended(x)).alias("detrended"), dot(A.centre_crop(x, 32)).alias("cropped"), dot(A.decimated(x, 4)).alias("decimated"), dot(F.reverse(x)).alias("reversed"), F.size(A.frames(x, 16, 8)).alias("frames"))


def pair_correlation(spark, d):
    return D.window_pairs(spark, d).select("example_id", "pair", F.round(A.pearson(F.col("x"), F.col("y")), 6).alias("r"))


def network_snr(spark, d):
    w = D.windows(spark, d).select("example_id", A.total(F.transform("samples", lambda v: v * v)).alias("p"))
    return w.groupBy("example_id").agg(F.round(F.sqrt(F.sum("p")), 6).alias("snr"))


def mass_grid(spark, d):
    """Template masses with m1 >= m2; its size is set by two parameters, not by data."""
    m = spark.range(5, 41).select((F.col("id") * 1.0).alias("m1")).withColumn("m2", F.explode(F.transform(F.sequence(F.lit(5), F.col("m1").cast("int")), lambda v: v * 1.0)))
    return m.select("m1", "m2", F.round(X.chirp_mass(F.col("m1"), F.col("m2")), 6).alias("chirp"))


def event_windows(spark, d):
    return W.counted(D.table(spark, d, "events").select("ts", "event_type", "value"))


QUERIES = (
    flagship, catalogue_search, mass_functions, detection_probability, transient_split, noise_split, index_filter, detector_masks, interval_merge, interval_subtract, interval_intersect, interval_split, interval_align,
    largest_per_bin, veto_padding, allowed_members, grid_windows, gap_clusters, tolerance_match, class_weights, label_entropy, balanced_subsample, efficiency_bins, false_alarm_curve, roc_curve, worst_noise, worst_per_bin,
    pool_draws, window_amplitudes, window_shapes, pair_correlation, network_snr, mass_grid, event_windows,
)


def queries() -> dict:
    from chronofold.plans import composed, selection, signals

    return {f.__name__: f for f in (*QUERIES, *signals.QUERIES, *selection.QUERIES, *composed.QUERIES)}


def _grp(key: str, salt: str) -> str:
    u = DRAW.format(key=key, salt=salt)
    return f"CASE WHEN {u} < 0.8 THEN 'train' WHEN {u} < 0.9 THEN 'validate' ELSE 'test' END"


CAT = "c AS (SELECT p_partkey, p_name AS name, CAST(p_size AS DOUBLE) AS mass1, p_size * CAST(0.8 AS DOUBLE) AS mass2, p_retailprice AS distance FROM part)"
TYPE = "CASE WHEN mass1 >= 3 AND mass2 >= 3 THEN 'BBH' WHEN mass1 < 3 AND mass2 < 3 THEN 'BNS' ELSE 'NSBH' END AS source"
WIN = "w AS (SELECT vec_id, vec_id // 3 AS example_id, CASE vec_id % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'H1' ELSE 'V1' END AS ifo, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
SUM = "list_sum(list_transform({a}, lambda v, i: v * i))"


def oracle_sql() -> dict[str, str]:
    from chronofold.plans import composed, selection, signals

    return signals.oracle_sql() | selection.oracle_sql() | composed.SQL | {
        "flagship": f"""WITH {T}, d AS (SELECT DISTINCT gps_key, kind, ifo FROM t), g AS (SELECT *, {_grp('gps_key', '42')} AS grp, count(*) OVER (PARTITION BY kind) AS c FROM d), m AS (SELECT *, max(c) OVER () AS top FROM g)
            SELECT grp, kind, count(*) AS n, round(sum(top / c), 6) AS weight FROM m GROUP BY grp, kind""",
        "catalogue_search": f"WITH {CAT} SELECT p_partkey, name, mass1, round(mass2, 6) AS mass2, {TYPE} FROM c WHERE mass1 BETWEEN 10 AND 40 AND mass2 BETWEEN 5 AND 30 AND distance BETWEEN 900 AND 1500 AND name ILIKE '%ring%'",
        "mass_functions": f"WITH {CAT} SELECT p_partkey, round(pow(mass1 * mass2, 0.6) / pow(mass1 + mass2, 0.2), 6) AS chirp, round(mass2 / mass1, 6) AS ratio, round(mass1 + mass2, 6) AS total, {TYPE} FROM c",
        "detection_probability": f"WITH {T} SELECT event_id, round(1 / (1 + exp(-(snr - 50) / 10)), 9) AS p FROM t",
        "transient_split": f"WITH {T} SELECT event_id, gps_key, {_grp('gps_key', '7')} AS grp FROM t",
        "noise_split": f"{BASE}, p AS {SPLIT.format(n=8192 * SECOND)} SELECT {_grp('bin', 'noise')} AS grp, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS us FROM p GROUP BY 1",
        "index_filter": f"WITH {T} SELECT event_id, gps_key, kind, ifo FROM t WHERE {_grp('gps_key', '42')} = 'train' AND kind IN ('click', 'view') AND ifo IN ('L1', 'H1')",
        "detector_masks": f"WITH {T}, d AS (SELECT DISTINCT gps_key, ifo FROM t) SELECT gps_key, CAST(sum(CASE ifo WHEN 'L1' THEN 1 WHEN 'H1' THEN 2 ELSE 4 END) AS INTEGER) AS mask, string_agg(ifo, ',' ORDER BY ifo) AS seen FROM d GROUP BY gps_key",
        "interval_merge": f"{BASE} SELECT * FROM ma",
        "interval_subtract": f"""{BASE}, cuts AS (SELECT ma.ifo, ma.start_us AS s, ma.end_us AS e, mv.start_us AS vs, mv.end_us AS ve FROM ma JOIN mv ON ma.ifo = mv.ifo AND mv.start_us < ma.end_us AND ma.start_us < mv.end_us),
            f AS (SELECT ifo, coalesce(lag(ve) OVER (PARTITION BY ifo, s ORDER BY vs), s) AS start_us, vs AS end_us FROM cuts UNION ALL SELECT ifo, max(ve), e FROM cuts GROUP BY ifo, s, e
                  UNION ALL SELECT ifo, start_us, end_us FROM ma WHERE NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.ifo = ma.ifo AND cuts.s = ma.start_us)) SELECT * FROM f WHERE end_us > start_us""",
        "interval_intersect": f"{BASE} SELECT greatest(x.start_us, y.start_us) AS start_us, least(x.end_us, y.end_us) AS end_us FROM ma x JOIN ma y ON x.ifo = 'L1' AND y.ifo = 'H1' AND x.start_us < y.end_us AND y.start_us < x.end_us",
        "interval_split": f"{BASE} SELECT ifo, start_us, end_us FROM {SPLIT.format(n=1024 * SECOND)}",
        "interval_align": f"""{BASE}, p AS {SPLIT.format(n=4096 * SECOND)}, r AS (SELECT *, row_number() OVER (PARTITION BY bin, ifo ORDER BY end_us - start_us DESC, start_us) AS k FROM p WHERE ifo IN ('L1', 'H1')),
            g AS (SELECT bin, count(*) AS n, max(start_us) AS start_us, min(end_us) AS end_us FROM r WHERE k = 1 GROUP BY bin) SELECT bin, start_us, end_us FROM g WHERE n = 2 AND end_us > start_us""",
        "largest_per_bin": f"{BASE}, p AS {SPLIT.format(n=4096 * SECOND)}, r AS (SELECT *, row_number() OVER (PARTITION BY bin, ifo ORDER BY end_us - start_us DESC, start_us) AS k FROM p) SELECT bin, ifo, start_us, end_us FROM r WHERE k = 1",
        "veto_padding": f"WITH {T}, {_spans('v', 'error', 5)}, q AS (SELECT ifo, start_us - 2000000 AS start_us, end_us + 2000000 AS end_us FROM v), {_merged('mq', 'q')} SELECT * FROM mq WHERE end_us - start_us >= 60000000",
        "allowed_members": f"{BASE} SELECT event_id, ifo FROM t WHERE kind = 'view' AND EXISTS (SELECT 1 FROM ma WHERE ma.ifo = t.ifo AND t.us >= ma.start_us AND t.us < ma.end_us)",
        "grid_windows": f"{BASE} SELECT ifo, start_us, greatest(1, ((end_us - start_us) // 1000000) // 32) AS batches, greatest(0, (end_us - start_us) // 1000000 - 16) AS windows FROM ma",
        "gap_clusters": f"""WITH {T}, g AS (SELECT ifo, us, CASE WHEN us - lag(us) OVER (PARTITION BY ifo ORDER BY us) > 600000000 THEN 1 ELSE 0 END AS new FROM t), k AS (SELECT *, CAST(sum(new) OVER (PARTITION BY ifo ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g)
            SELECT ifo, cluster, count(*) AS n, min(us) AS first, max(us) AS last FROM k GROUP BY ifo, cluster""",
        "tolerance_match": f"WITH {T} SELECT e.event_id, e.ifo, e.us, min(p.us) AS r_us FROM t e JOIN t p ON e.kind = 'error' AND p.kind = 'purchase' AND p.ifo = e.ifo AND p.us >= e.us AND p.us - e.us <= 1800000000 GROUP BY 1, 2, 3",
        "class_weights": "WITH c AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label, round(max(n) OVER () / n, 9) AS weight FROM c",
        "label_entropy": f"WITH {T}, c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY kind) SELECT round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)), 9) AS diversity FROM c",
        "balanced_subsample": f"WITH c AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {DRAW.format(key='vec_id', salt='bal')}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings), m AS (SELECT *, min(n) OVER () AS least FROM c) SELECT vec_id, label FROM m WHERE r <= least",
        "efficiency_bins": f"WITH {SCORES} SELECT CAST(floor(snr) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 8) AS mean, round(stddev_pop(score), 8) AS std FROM s WHERE truth = 1 GROUP BY 1 HAVING count(*) > 10",
        "false_alarm_curve": f"WITH {SCORES}, n AS (SELECT round(score, 3) AS score, count(*) AS n FROM s WHERE truth = 0 GROUP BY 1) SELECT score, round(sum(n) OVER (ORDER BY score DESC) / ((SELECT sum(n) FROM n) * 2.0), 9) AS rate FROM n",
        "roc_curve": f"""WITH {SCORES}, h AS (SELECT least(CAST(floor(score * 512) AS INTEGER), 511) AS k, sum(truth) AS p, sum(1 - truth) AS n FROM s GROUP BY 1)
            SELECT k / 512 AS threshold, round(sum(p) OVER (ORDER BY k DESC) / sum(p) OVER (), 9) AS tpr, round(sum(n) OVER (ORDER BY k DESC) / sum(n) OVER (), 9) AS fpr FROM h""",
        "worst_noise": f"WITH {SCORES} SELECT doc_id, round(score, 9) AS score FROM s WHERE truth = 0 ORDER BY score DESC, doc_id LIMIT 25",
        "worst_per_bin": f"WITH {SCORES}, b AS (SELECT doc_id, round(score, 9) AS score, least(CAST(floor(snr) AS BIGINT), 9) AS bin FROM s WHERE truth = 1), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY score, doc_id) AS rank FROM b) SELECT bin, rank, doc_id, score FROM r WHERE rank <= 3",
        "pool_draws": f"WITH p AS (SELECT {DRAW.format(key='event_id', salt='pool')} AS u FROM events) SELECT CASE WHEN u < 0.5 THEN 'noise' WHEN u < 0.8 THEN 'signal' ELSE 'glitch' END AS pool, count(*) AS n FROM p GROUP BY 1",
        "window_amplitudes": f"WITH {WIN} SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64), 6) AS hrss, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS hpeak, round(list_sum(x) / len(x), 6) AS mean, round(list_max(x), 6) AS high, round(list_min(x), 6) AS low FROM w",
        "window_shapes": f"""WITH {WIN}, m AS (SELECT *, list_sum(x) / len(x) AS a FROM w) SELECT vec_id, round({SUM.format(a='list_transform(x, lambda q: q - a)')}, 5) AS detrended, round({SUM.format(a='x[17:48]')}, 5) AS cropped,
            round({SUM.format(a='x[1:64:4]')}, 5) AS decimated, round({SUM.format(a='list_reverse(x)')}, 5) AS reversed, (len(x) - 16) // 8 + 1 AS frames FROM m""",
        "pair_correlation": f"""
            WITH {WIN},
                 p AS (SELECT l.example_id, l.ifo || '-' || h.ifo AS pair, unnest(l.x) AS a, unnest(h.x) AS b
                       FROM w l JOIN w h ON l.example_id = h.example_id AND l.vec_id % 3 < h.vec_id % 3)
            SELECT example_id, pair, round(corr(a, b), 6) AS r FROM p GROUP BY 1, 2""",
        "network_snr": f"WITH {WIN} SELECT example_id, round(sqrt(sum(list_sum(list_transform(x, lambda v: v * v)))), 6) AS snr FROM w GROUP BY 1",
        "mass_grid": "SELECT CAST(a AS DOUBLE) AS m1, CAST(b AS DOUBLE) AS m2, round(pow(CAST(a * b AS DOUBLE), 0.6) / pow(CAST(a + b AS DOUBLE), 0.2), 6) AS chirp FROM range(5, 41) x(a), range(5, 41) y(b) WHERE a >= b",
        "event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2",
    }
