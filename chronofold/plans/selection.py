"""Named queries on evaluation, catalogues, clusters and the window store, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.functions import arrays as A
from chronofold.functions.expressions import gps_key, uniform
from chronofold.operators import catalogue as K
from chronofold.operators import clusters as C
from chronofold.operators import intervals as I
from chronofold.operators import samples as S
from chronofold.operators import scoring as E
from chronofold.sources import domain as D
from chronofold.sources import store

SECOND = 1_000_000
KINDS = ["click", "error", "login", "purchase", "view"]
RATES = [0.0001, 0.05, 0.1, 0.25, 0.5, 2.0]


def rate_thresholds(spark, d):
    t = E.rate_thresholds(D.scores(spark, d).where("truth = 0"), "score", 2.0, RATES)
    return t.select("far", F.round("threshold", 9).alias("threshold"))


def least_rates(spark, d):
    """Lowest rate whose threshold an event's score reaches; null where none does."""
    s = D.scores(spark, d)
    t = E.rate_thresholds(s.where("truth = 0"), "score", 2.0, RATES)
    j = s.where("truth = 1").join(F.broadcast(t), F.col("score") >= F.col("threshold"), "left")
    return j.groupBy("doc_id").agg(F.min("far").alias("far"))


def roc_fixed(spark, d):
    return E.roc_fixed(D.scores(spark, d)).select("k", F.round("threshold", 9).alias("threshold"), F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


def roc_area(spark, d):
    return E.area(E.roc_fixed(D.scores(spark, d))).select(F.round("auc", 9).alias("auc"))


def rolling_recall(spark, d):
    r = E.rolling_recall(D.scores(spark, d).where("truth = 1"), 0.6, centres=50)
    return r.select(F.round("centre", 9).alias("centre"), "n", F.round("recall", 9).alias("recall"))


def model_fitness(spark, d):
    return E.fitness(D.scores(spark, d).where("truth = 1"), F.col("score"), 0.5, 0.125).select(F.round("fitness", 8).alias("fitness"))


def score_density(spark, d):
    return E.density(D.scores(spark, d), F.col("snr"), F.col("score"), 40)


def download_clusters(spark, d):
    return C.capped(D.spans(spark, d, "error", 5))


def run_tags(spark, d):
    """Event times moved into the years of the runs, tagged by both tables of bounds."""
    o = D.table(spark, d, "orders").select("o_orderkey", (F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)") + 660_000_000).alias("unix"))
    g = K.gps_of(F.col("unix"))
    return o.select("o_orderkey", g.alias("gps"), K.run_of(g).alias("event_run"), K.run_of(F.col("unix"), K.RUN_TIMES).alias("run"))


def distinct_events(spark, d):
    t = D.transients(spark, d).select("event_id", "gps", "kind", (F.rint(F.col("gps") / 60) * 60).alias("minute"))
    return K.distinct_events(t, "minute", ["kind", "event_id"]).select("event_key", "event_id", "kind")


def packed_rows(spark, d):
    """Rows packed and unpacked again, next to the packed numbers."""
    t = D.transients(spark, d).select("event_id", "gps_key", "kind", "ifo")
    g = t.groupBy("gps_key").agg(F.min("kind").alias("kind"), F.array_sort(F.collect_set("ifo")).alias("seen"))
    g = g.withColumn("run", F.when(F.col("gps_key") % 3 > 0, F.when(F.col("gps_key") % 3 == 1, "O1").otherwise("O9"))).withColumn("label", F.when(F.col("gps_key") % 2 == 0, 7))
    p = K.compressed(g, KINDS, ["O1", "O2"])
    x = K.expanded(p, KINDS, ["O1", "O2"]).select("gps_key", F.col("kind").alias("kind_name"), F.col("run").alias("run_name"), F.concat_ws(",", F.array_sort("seen")).alias("seen"), F.col("label").alias("label_or_null"))
    return p.select("gps_key", F.col("kind").cast("int"), F.col("run").cast("int"), F.col("mask").cast("int"), F.col("label").cast("int")).join(x, "gps_key")


def feature_index(spark, d):
    t = D.transients(spark, d)
    g = t.where("kind = 'error'").select("event_id", "gps_key", "snr")
    return K.feature_index(g, t.where("kind = 'purchase'").select("event_id", "gps_key", "ifo"))


def oversampled_classes(spark, d):
    return K.oversampled(D.transients(spark, d).select("event_id", "kind"), "kind", "event_id", "over").groupBy("kind", "event_id").agg(F.count("*").alias("copies"))


def weighted_draws(spark, d):
    """Draws by a whole-number weight, so that sums agree exactly in any order."""
    t = D.transients(spark, d).select("event_id", F.floor("snr").alias("w"))
    return K.weighted_draws(t, "event_id", "w", 500, "wheel")


def long_bins(spark, d):
    b = I.largest_per_bin(I.merge(D.spans(spark, d, "click", 20)), 4096 * SECOND)
    return K.long_everywhere(b, "bin", 900 * SECOND)


def best_intersections(spark, d):
    m = I.merge(D.spans(spark, d, "click", 20))
    return K.best_intersections(m.where("ifo = 'L1'"), m.where("ifo = 'H1'"))


def shortest_first(spark, d):
    return K.ordered(I.merge(D.spans(spark, d, "click", 20)), "shortest")


def full_batches(spark, d):
    return K.batched(D.windows(spark, d).select("vec_id", "label"), "vec_id", 8, ["label"])


def pool_positions(spark, d):
    """Pool of each position of a batch, with the place among the pool's examples."""
    e = D.windows(spark, d).select((F.floor(F.col("vec_id") / 32)).alias("batch"), (F.col("vec_id") % 32).alias("position"), "vec_id")
    u = uniform(F.col("vec_id"), "pools")
    p = e.withColumn("pool", F.when(u < 0.7, "noise").otherwise("signal"))
    from pyspark.sql import Window

    return p.withColumn("place", F.row_number().over(Window.partitionBy("batch", "pool").orderBy("position"))).drop("vec_id")


def valid_noise_segments(spark, d):
    """Segments without padded vetoes, split into chunks, of one group, in pieces long enough."""
    v = I.pad(D.spans(spark, d, "error", 5), 2 * SECOND, 2 * SECOND).unionByName(D.spans(spark, d, "purchase", 2))
    s = I.subtract(D.spans(spark, d, "click", 20), v)
    c = I.split(s, 8192 * SECOND).withColumn("chunk", F.floor(F.col("start_us") / (8192 * SECOND)))
    g = S.assigned(c, "chunk", {"train": 0.8, "validate": 0.1, "test": 0.1}, "noise").where("grp = 'train'")
    return I.at_least(I.split(g, 2048 * SECOND), 64 * SECOND)


def store_report(spark, d):
    w = D.windows(spark, d).withColumn("samples", F.when(F.col("vec_id") % 11 == 0, F.transform("samples", lambda v: F.lit(0.0))).otherwise(F.col("samples")))
    return store.integrity(w).select("label", "n", "n_nan", "n_inf", "n_zero", "low", "high", F.round("mean", 9).alias("mean"), F.round("std", 8).alias("std"))


def store_lookup(spark, d):
    """Times looked up in keyed rows of one kind, misses marked."""
    t = D.transients(spark, d)
    kept = store.keyed(t.where("kind = 'view'").select("gps", F.col("event_id").alias("label")))
    return store.looked_up(t.where("kind <> 'error'").select("event_id", "gps_key"), kept.select("gps_key", "label")).select("event_id", F.col("label").alias("stored"), "hit")


def stored_windows(spark, d):
    w = K.stored_windows(D.windows(spark, d).select("vec_id", "samples"), 64, 16, 8)
    return w.select("vec_id", F.round(A.total(F.transform("samples", lambda v, i: v * (i + 1))), 6).alias("window"), store.sound(F.col("samples"), 4).alias("sound"))


def session_groups(spark, d):
    """Sessions of one detector: rows at most 100 seconds apart."""
    from chronofold.streaming import windows as W

    return W.sessions(D.table(spark, d, "events").select("ts", "event_type"))


def diversity_by_window(spark, d):
    """Label diversity of each hour."""
    t = D.transients(spark, d).select(F.floor(F.col("us") / I.HOUR).alias("hour"), "kind").groupBy("hour", "kind").agg(F.count("*").cast("double").alias("n"))
    g = t.groupBy("hour").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"), F.count("*").alias("k"))
    return g.select("hour", F.round(F.when(F.col("k") > 1, (F.ln("t") - F.col("s") / F.col("t")) / F.ln("k")).otherwise(0.0), 8).alias("diversity"))


def key_round_trip(spark, d):
    return D.transients(spark, d).select("event_id", gps_key(F.col("gps_key") / 100.0).alias("again"), K.unix_of(K.gps_of(F.floor("gps"))).alias("unix"))


QUERIES = (
    rate_thresholds, least_rates, roc_fixed, roc_area, rolling_recall, model_fitness, score_density, download_clusters, run_tags, distinct_events, packed_rows, feature_index, oversampled_classes, weighted_draws,
    long_bins, best_intersections, shortest_first, full_batches, pool_positions, valid_noise_segments, store_report, store_lookup, stored_windows, session_groups, diversity_by_window, key_round_trip,
)


def oracle_sql() -> dict[str, str]:
    from chronofold.plans.catalog import BASE, DRAW, SCORES, SPLIT, WIN, T, _grp, _merged, _spans

    u = lambda key, salt: DRAW.format(key=key, salt=salt)
    cases = lambda x, runs: "CASE " + " ".join(f"WHEN {x} BETWEEN {a} AND {b} THEN '{n}'" for n, (a, b) in runs.items()) + " ELSE 'Unknown' END"
    far = f"""{SCORES}, z AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n, min(score) OVER () AS low FROM s WHERE truth = 0),
        q AS (SELECT CAST(far AS DOUBLE) AS far, far * 2.0 * (SELECT max(n) FROM z) AS place FROM (VALUES {', '.join(f'({r}::DOUBLE)' for r in RATES)}) v(far)),
        thr AS (SELECT far, CASE WHEN place < 1 THEN 1.1::DOUBLE WHEN place > (SELECT max(n) FROM z) THEN (SELECT min(low) FROM z) ELSE a.score + coalesce((place - floor(place)) * (b.score - a.score), 0) END AS threshold
          FROM q LEFT JOIN z a ON a.r = floor(place) LEFT JOIN z b ON b.r = floor(place) + 1)"""
    roc = f"{SCORES}, h AS (SELECT i, 1 - exp(CAST(-6 * i AS DOUBLE) / 511) AS t FROM range(512) r(i)), c AS (SELECT i, t, sum(CASE WHEN score >= t THEN truth ELSE 0 END) AS tp, sum(CASE WHEN score >= t THEN 1 - truth ELSE 0 END) AS fp, sum(truth) AS p, sum(1 - truth) AS n FROM h, s GROUP BY i, t), o AS (SELECT i, t, tp / (p + 1e-10) AS tpr, fp / (n + 1e-10) AS fpr FROM c)"
    bins = f"p AS {SPLIT.format(n=4096 * SECOND)}, r AS (SELECT *, row_number() OVER (PARTITION BY bin, ifo ORDER BY end_us - start_us DESC, start_us) AS k FROM p)"
    cut = lambda src, n: f"(SELECT ifo, greatest(start_us, k * {n}) AS start_us, least(end_us, (k + 1) * {n}) AS end_us, k AS bin FROM {src}, LATERAL (SELECT unnest(range(start_us // {n}, (end_us - 1) // {n} + 1)) AS k))"
    return {
        "rate_thresholds": f"WITH {far} SELECT far, round(threshold, 9) AS threshold FROM thr",
        "least_rates": f"WITH {far} SELECT doc_id, min(far) AS far FROM s LEFT JOIN thr ON score >= threshold WHERE truth = 1 GROUP BY doc_id",
        "roc_fixed": f"WITH {roc} SELECT CAST(i AS INTEGER) AS k, round(t, 9) AS threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM o",
        "roc_area": f"WITH {roc}, l AS (SELECT tpr, fpr, lead(tpr) OVER (ORDER BY i) AS t2, lead(fpr) OVER (ORDER BY i) AS f2 FROM o) SELECT round(sum((fpr - f2) * (tpr + t2) / 2), 9) AS auc FROM l",
        "rolling_recall": f"""WITH {SCORES}, x AS (SELECT * FROM s WHERE truth = 1), e AS (SELECT floor(min(snr)) + 0.5 AS a, ceil(max(snr)) - 0.5 AS b FROM x), c AS (SELECT a + i * (b - a) / 49 AS centre FROM e, range(50) r(i)),
            g AS (SELECT centre, count(*) AS n, avg(CASE WHEN score > 0.6 THEN 1 ELSE 0 END) AS recall FROM c JOIN x ON snr >= centre - 0.5 AND snr < centre + 0.5 GROUP BY centre HAVING count(*) >= 20) SELECT round(centre, 9) AS centre, n, round(recall, 9) AS recall FROM g WHERE (SELECT count(*) FROM g) >= 5""",
        "model_fitness": f"WITH {SCORES} SELECT round(1 / (1 - avg(CASE WHEN score > 0.5 THEN 1 ELSE 0 END) + 0.125::DOUBLE + 1e-8::DOUBLE), 8) AS fitness FROM s WHERE truth = 1",
        "score_density": f"WITH {SCORES}, e AS (SELECT min(snr) AS a, max(snr) AS b, min(score) AS c, max(score) AS d FROM s) SELECT CAST(least(floor((snr - a) / (b - a) * 40), 39) AS INTEGER) AS i, CAST(least(floor((score - c) / (d - c) * 40), 39) AS INTEGER) AS j, count(*) AS n FROM s, e GROUP BY 1, 2",
        "download_clusters": f"""WITH RECURSIVE {T}, {_spans('v', 'error', 5)}, o AS (SELECT *, row_number() OVER (PARTITION BY ifo ORDER BY start_us, end_us) AS k FROM v),
            g AS (SELECT ifo, k, start_us AS s, end_us AS e FROM o WHERE k = 1 UNION ALL SELECT o.ifo, o.k, CASE WHEN o.start_us - g.e <= 1500000000 AND g.e - g.s < 512000000 THEN g.s ELSE o.start_us END,
              CASE WHEN o.start_us - g.e <= 1500000000 AND g.e - g.s < 512000000 THEN greatest(g.e, o.end_us) ELSE o.end_us END FROM g JOIN o ON o.ifo = g.ifo AND o.k = g.k + 1),
            m AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY ifo ORDER BY k) AS c FROM (SELECT *, s <> coalesce(lag(s) OVER (PARTITION BY ifo ORDER BY k), -1) AS new FROM g)) SELECT ifo, min(s) AS start_us, max(e) AS end_us, count(*) AS n FROM m GROUP BY ifo, c""",
        "run_tags": f"WITH o AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + 660000000 AS unix FROM orders) SELECT o_orderkey, unix - 315964818 AS gps, {cases('unix - 315964818', K.EVENT_RUNS)} AS event_run, {cases('unix', K.RUN_TIMES)} AS run FROM o",
        "distinct_events": f"WITH {T}, k AS (SELECT event_id, kind, CAST(round_even(gps / 60, 0) * 600 AS BIGINT) AS event_key FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY kind, event_id) AS place FROM k) SELECT event_key, event_id, kind FROM r WHERE place = 1",
        "packed_rows": f"""WITH {T}, g AS (SELECT gps_key, min(kind) AS k, list_sort(list(DISTINCT ifo)) AS s FROM t GROUP BY gps_key)
            SELECT gps_key, CASE k WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'login' THEN 2 WHEN 'purchase' THEN 3 WHEN 'view' THEN 4 ELSE -1 END AS kind, CASE WHEN gps_key % 3 = 1 THEN 0 ELSE -1 END AS run,
              CAST(list_sum(list_transform(s, lambda v: CASE v WHEN 'L1' THEN 1 WHEN 'H1' THEN 2 ELSE 4 END)) AS INTEGER) AS mask, CASE WHEN gps_key % 2 = 0 THEN 7 ELSE -1 END AS label,
              CASE WHEN k IN ('click', 'error', 'login', 'purchase', 'view') THEN k END AS kind_name, CASE WHEN gps_key % 3 = 1 THEN 'O1' END AS run_name, array_to_string(s, ',') AS seen, CASE WHEN gps_key % 2 = 0 THEN 7 END AS label_or_null FROM g""",
        "feature_index": f"WITH {T} SELECT event_id, gps_key, CASE WHEN kind = 'error' THEN snr END AS snr, CASE WHEN kind = 'purchase' THEN ifo END AS ifo, CASE WHEN kind = 'error' THEN 'glitch' ELSE 'event' END AS source FROM t WHERE kind IN ('error', 'purchase')",
        "oversampled_classes": f"""WITH c AS (SELECT event_id, event_type AS kind, row_number() OVER (PARTITION BY event_type ORDER BY {u('event_id', 'over')}, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events), m AS (SELECT *, max(n) OVER () AS top FROM c)
            SELECT kind, event_id, top // n + CASE WHEN r <= top % n THEN 1 ELSE 0 END AS copies FROM m""",
        "weighted_draws": f"""WITH e AS (SELECT event_id, floor(value) AS w, event_id % 1024 AS b FROM events WHERE floor(value) > 0), c AS (SELECT event_id, w, sum(w) OVER (ORDER BY b, event_id ROWS UNBOUNDED PRECEDING) AS high, sum(w) OVER () AS every FROM e),
            d AS (SELECT id AS draw, {u('id', 'wheel')} AS u FROM range(500) r(id)) SELECT draw, event_id FROM d JOIN c ON u * every >= high - w AND u * every < high""",
        "long_bins": f"{BASE}, {bins} SELECT bin, ifo, start_us, end_us FROM r WHERE k = 1 AND bin NOT IN (SELECT bin FROM r WHERE k = 1 AND end_us - start_us < 900000000)",
        "best_intersections": f"""{BASE}, o AS (SELECT x.start_us AS a, greatest(x.start_us, y.start_us) AS s, least(x.end_us, y.end_us) AS e, y.start_us AS v FROM ma x JOIN ma y ON x.ifo = 'L1' AND y.ifo = 'H1' AND x.start_us < y.end_us AND y.start_us < x.end_us),
            r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY e - s DESC, v) AS k FROM o) SELECT s AS start_us, e AS end_us FROM r WHERE k = 1""",
        "shortest_first": f"{BASE} SELECT * FROM ma ORDER BY end_us - start_us, start_us",
        "full_batches": "WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT vec_id, label, p // 8 AS batch, CAST(p % 8 AS INTEGER) AS position FROM r WHERE (p // 8 + 1) * 8 <= n",
        "pool_positions": f"WITH p AS (SELECT vec_id // 32 AS batch, vec_id % 32 AS position, CASE WHEN {u('vec_id', 'pools')} < 0.7 THEN 'noise' ELSE 'signal' END AS pool FROM embeddings) SELECT *, row_number() OVER (PARTITION BY batch, pool ORDER BY position) AS place FROM p",
        "valid_noise_segments": f"""WITH {T}, {_spans('a', 'click', 20)}, {_spans('b', 'error', 5)}, {_spans('c', 'purchase', 2)}, v AS (SELECT ifo, start_us - 2000000 AS start_us, end_us + 2000000 AS end_us FROM b UNION ALL SELECT * FROM c), {_merged('ma', 'a')}, {_merged('mv', 'v')},
            cuts AS (SELECT ma.ifo, ma.start_us AS s, ma.end_us AS e, mv.start_us AS vs, mv.end_us AS ve FROM ma JOIN mv ON ma.ifo = mv.ifo AND mv.start_us < ma.end_us AND ma.start_us < mv.end_us),
            f AS (SELECT ifo, coalesce(lag(ve) OVER (PARTITION BY ifo, s ORDER BY vs), s) AS start_us, vs AS end_us FROM cuts UNION ALL SELECT ifo, max(ve), e FROM cuts GROUP BY ifo, s, e UNION ALL SELECT ifo, start_us, end_us FROM ma WHERE NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.ifo = ma.ifo AND cuts.s = ma.start_us)),
            g AS (SELECT * FROM f WHERE end_us > start_us), p AS (SELECT * FROM {cut('g', 8192 * SECOND)}), q AS (SELECT ifo, start_us, end_us FROM p WHERE {_grp('bin', 'noise')} = 'train') SELECT ifo, start_us, end_us FROM {cut('q', 2048 * SECOND)} WHERE end_us - start_us >= 64000000""",
        "store_report": f"""WITH {WIN}, z AS (SELECT vec_id, label, CASE WHEN vec_id % 11 = 0 THEN list_transform(x, lambda v: 0.0::DOUBLE) ELSE x END AS x FROM w), e AS (SELECT label, unnest(x) AS v FROM z), m AS (SELECT label, min(v) AS low, max(v) AS high, avg(v) AS mean, stddev_pop(v) AS std FROM e GROUP BY label)
            SELECT label, count(*) AS n, CAST(0 AS BIGINT) AS n_nan, CAST(0 AS BIGINT) AS n_inf, count(*) FILTER (WHERE vec_id % 11 = 0) AS n_zero, any_value(low) AS low, any_value(high) AS high, round(any_value(mean), 9) AS mean, round(any_value(std), 8) AS std FROM z JOIN m USING (label) GROUP BY label""",
        "store_lookup": f"WITH {T}, k AS (SELECT gps_key, arg_max(event_id, (us, event_id)) AS stored FROM t WHERE kind = 'view' GROUP BY gps_key) SELECT event_id, stored, stored IS NOT NULL AS hit FROM t LEFT JOIN k USING (gps_key) WHERE kind <> 'error'",
        "stored_windows": f"WITH {WIN} SELECT vec_id, round(list_sum(list_transform(x[17:45:4], lambda v, i: v * i)), 6) AS window, true AS sound FROM w",
        "session_groups": """WITH g AS (SELECT event_type, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) > 100000000 THEN 1 ELSE 0 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM g)
            SELECT event_type, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM k GROUP BY event_type, s""",
        "diversity_by_window": f"WITH {T}, c AS (SELECT us // 3600000000 AS hour, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY 1, kind) SELECT hour, round(CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 0 END, 8) AS diversity FROM c GROUP BY hour",
        "key_round_trip": f"WITH {T} SELECT event_id, gps_key AS again, us // 1000000 AS unix FROM t",
    }
