"""Named queries on scans, requests for windows, labelled examples and evaluation.  Each stands beside its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.functions import arrays as A
from chronofold.functions import draws as U
from chronofold.functions import expressions as X
from chronofold.functions import geometry as G
from chronofold.functions import waveforms as V
from chronofold.operators import catalogue as K
from chronofold.operators import intervals as I
from chronofold.operators import requests as R
from chronofold.operators import samples as S
from chronofold.plans.catalog import CAT, DRAW, SCORES, SHARES, WIN, T, _grp, _merged, _spans
from chronofold.sources import domain as D

SECOND = 1_000_000
DAY0 = 1_704_067_200 * SECOND
HOUR = 3600 * SECOND
RUNS = {"R1": (DAY0, DAY0 + 150 * HOUR), "R2": (DAY0 + 200 * HOUR, DAY0 + 400 * HOUR), "R3": (DAY0 + 380 * HOUR, DAY0 + 600 * HOUR)}
FRAMES = {"R1": "F1_HOFT:STRAIN", "R2": "F2_HOFT:STRAIN_C01", "R3": "F3_HOFT:STRAIN_C02"}
LISTS = {"confident": ["Brand#1", "Brand#2", "Brand#3"], "marginal": ["Brand#3", "Brand#4"]}

QUERIES: list = []
SQL: dict[str, str] = {}

SEG = """seg AS (SELECT ifo, CASE WHEN event_id % 4 = 0 THEN 'setup' ELSE 'science' END AS flag, us AS start_us,
    us + CAST(floor(snr * 20 * 1e6) AS BIGINT) AS end_us FROM t WHERE kind = 'click')"""


def query(sql: str) -> Callable:
    def named(f: Callable) -> Callable:
        QUERIES.append(f)
        SQL[f.__name__] = sql
        return f

    return named


def u(key: str, salt: str) -> str:
    return DRAW.format(key=key, salt=salt)


def dot(array: str, digits: int = 5) -> str:
    return f"round(list_sum(list_transform({array}, lambda v, i: v * i)), {digits})"


def _dot(x, digits: int = 5):
    return F.round(A.total(F.transform(x, lambda v, i: v * (i + 1))), digits)


def _segments(spark, d):
    t = D.transients(spark, d).where("kind = 'click'")
    return t.select("ifo", F.when(F.col("event_id") % 4 == 0, "setup").otherwise("science").alias("flag"), F.col("us").alias("start_us"), (F.col("us") + F.floor(F.col("snr") * 20 * 1e6)).cast("long").alias("end_us"))


# scans


@query(f"""WITH {T}, {SEG} SELECT ifo, greatest(start_us, {DAY0 + 100 * HOUR}) AS start_us, least(end_us, {DAY0 + 300 * HOUR}) AS end_us
    FROM seg WHERE flag = 'science' AND end_us > {DAY0 + 100 * HOUR} AND start_us < {DAY0 + 300 * HOUR}""")
def segment_scan(spark, d):
    return R.segments_between(_segments(spark, d), DAY0 + 100 * HOUR, DAY0 + 300 * HOUR, "science")


@query(f"""WITH {T}, {SEG}, r AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}, {b})" for n, (a, b) in RUNS.items())}) v(run, a, b))
    SELECT run, ifo, greatest(start_us, a) AS start_us, least(end_us, b) AS end_us FROM seg JOIN r ON a < end_us AND start_us < b WHERE flag = 'science'""")
def run_scan(spark, d):
    return R.over_runs(_segments(spark, d), RUNS, "science")


@query(f"""WITH {T} SELECT event_id, CASE {' '.join(f"WHEN us BETWEEN {a} AND {b} THEN '{FRAMES[n]}'" for n, (a, b) in RUNS.items())}
    ELSE '{FRAMES['R1']}' END AS frame FROM t""")
def frame_channels(spark, d):
    return D.transients(spark, d).select("event_id", R.by_run(F.col("us"), RUNS, FRAMES).alias("frame"))


@query(f"""WITH {T} SELECT event_id, true AS typed FROM t WHERE ifo = 'H1' AND kind IN ('error', 'signup') AND us BETWEEN {RUNS['R1'][0]} AND {RUNS['R1'][1]}
    UNION ALL SELECT event_id, false FROM t WHERE ifo = 'H1' AND us > {RUNS['R1'][0]} AND us < {RUNS['R1'][1]}""")
def glitch_times(spark, d):
    t, (a, b) = D.transients(spark, d), RUNS["R1"]
    typed = R.times_of(t, "H1", a, b, ["error", "signup"]).select("event_id", F.lit(True).alias("typed"))
    return typed.union(R.times_of(t, "H1", a, b).select("event_id", F.lit(False)))


@query(f"WITH {T} SELECT event_id, gps_key FROM t WHERE snr > 60 AND kind <> 'view' AND ifo = 'L1'")
def glitch_scan(spark, d):
    """A selection given as a filter string."""
    return D.transients(spark, d).where(F.expr("snr > 60 and kind <> 'view' and ifo = 'L1'")).select("event_id", "gps_key")


def _in_lists(column: str) -> str:
    parts = [f"SELECT p_partkey, '{n}' AS list, {k} AS place FROM part WHERE {column} IN ({', '.join(map(repr, c))})" for k, (n, c) in enumerate(LISTS.items())]
    return " UNION ALL ".join(parts)


@query(_in_lists("p_brand"))
def listed_events(spark, d):
    """Events of the confident list, then of the marginal one; an event in both comes twice."""
    return R.listed_events(D.event_catalogue(spark, d), LISTS).select("p_partkey", "list", "place")


@query(f"""WITH {T}, c AS (SELECT *, CASE {' '.join(f"WHEN us BETWEEN {a} AND {b} THEN '{n}'" for n, (a, b) in RUNS.items())} ELSE 'Unknown' END AS run,
    list_position(['purchase', 'view', 'signup'], kind) AS rank, CAST(round_even(us / 1e6 * 10, 0) AS BIGINT) AS event_key FROM t WHERE kind IN ('purchase', 'view', 'signup') AND snr >= 5),
    f AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY rank, event_id) AS k FROM c WHERE run IN ('R1', 'R3')) SELECT event_key, event_id, run, kind FROM f WHERE k = 1""")
def events_with_parameters(spark, d):
    """Tagged by run, filtered, and the first of each tenth of a second by rank of its catalogue."""
    t = D.transients(spark, d).where(F.col("kind").isin("purchase", "view", "signup") & (F.col("snr") >= 5))
    t = t.withColumn("run", K.run_of(F.col("us"), RUNS)).where(F.col("run").isin("R1", "R3"))
    t = t.withColumn("rank", F.array_position(F.array(*map(F.lit, ("purchase", "view", "signup"))), F.col("kind")))
    return K.distinct_events(t.select("event_id", "gps", "run", "kind", "rank"), "gps", ["rank", "event_id"]).select("event_key", "event_id", "run", "kind")


@query(f"""WITH {T} SELECT event_id, ifo, kind, us - 500000 AS start_us, us + 1500000 AS end_us, {' '.join(['CASE', *[f"WHEN us BETWEEN {a} AND {b} THEN '{n}'" for n, (a, b) in RUNS.items()], "ELSE 'Unknown' END"])} AS run
    FROM t WHERE kind IN ('error', 'signup')""")
def glitch_segments(spark, d):
    t = D.transients(spark, d).where(F.col("kind").isin("error", "signup"))
    return t.select("event_id", "ifo", "kind", (F.col("us") - 500_000).alias("start_us"), (F.col("us") + 1_500_000).alias("end_us"), K.run_of(F.col("us"), RUNS).alias("run"))


TYPES = ("BBH", "BNS", "NSBH")


@query(f"""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE {u('p_partkey', 'BBH')} END AS a, CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE {u('p_partkey', 'BNS')} END AS b, {u('p_partkey', 'NSBH')} AS c FROM part)
    SELECT p_partkey, CASE WHEN a >= b AND a >= c THEN 'BBH' WHEN b >= c THEN 'BNS' ELSE 'NSBH' END AS type, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS confident, ['H1', 'L1'] AS seen FROM p""".replace("['H1', 'L1'] AS seen", "'H1,L1' AS seen"))
def event_segments(spark, d):
    """Type of the largest probability (a missing one counts as 0), confidence by catalogue, default detectors."""
    c = D.event_catalogue(spark, d)
    key = F.col("p_partkey")
    of = {t: F.coalesce(F.when(key % m != 0, X.uniform(key, t)), F.lit(0.0)) if m else X.uniform(key, t) for t, m in zip(TYPES, (7, 5, 0))}
    kind = F.when((of["BBH"] >= of["BNS"]) & (of["BBH"] >= of["NSBH"]), "BBH").when(of["BNS"] >= of["NSBH"], "BNS").otherwise("NSBH")
    return c.select("p_partkey", kind.alias("type"), F.col("catalog").isin(*LISTS["confident"]).alias("confident"), F.lit("H1,L1").alias("seen"))


@query(f"""WITH {T}, {SEG}, {_merged('ma', 'seg')}, a AS (SELECT event_id, row_number() OVER (ORDER BY event_id % 1024, event_id) - 1 AS place, count(*) OVER () AS n FROM t
        WHERE kind = 'view' AND EXISTS (SELECT 1 FROM ma WHERE ma.ifo = t.ifo AND t.us BETWEEN ma.start_us AND ma.end_us)),
    r AS (SELECT range AS draw, {u('range', 'store')} AS v FROM range(500)) SELECT draw, event_id FROM r JOIN a ON a.place = floor(v * n)""")
def store_draws(spark, d):
    """Draws with replacement from stored rows inside allowed segments, both ends included."""
    t = D.transients(spark, d).where("kind = 'view'").select("event_id", "ifo", "us")
    inside = I.covered(t, F.col("us"), I.merge(_segments(spark, d)), closed=True)
    return R.drawn(inside, "event_id", 500, "store")


# filters


@query(f"""WITH {T}, d AS (SELECT gps_key, CAST(sum(DISTINCT CASE ifo WHEN 'L1' THEN 1 WHEN 'H1' THEN 2 ELSE 4 END) AS INTEGER) AS mask, min(kind) AS kind FROM t GROUP BY 1)
    SELECT gps_key, mask, round({u('gps_key', 'order')}, 9) AS turn FROM d WHERE {_grp('gps_key', '42')} = 'train' AND kind IN ('click', 'error') AND mask & 5 <> 0""")
def index_scan(spark, d):
    """Rows of a group and label that share a detector with a mask, in the order of a draw."""
    t = D.transients(spark, d).groupBy("gps_key").agg(X.mask_of(F.collect_set("ifo")).alias("mask"), F.min("kind").alias("kind"))
    t = S.assigned(t, "gps_key", SHARES, "42").where((F.col("grp") == "train") & F.col("kind").isin("click", "error") & (F.col("mask").bitwiseAND(5) != 0))
    return t.select("gps_key", "mask", F.round(X.uniform(F.col("gps_key"), "order"), 9).alias("turn")).sortWithinPartitions("turn")


@query(f"WITH {CAT} SELECT p_partkey, name, {_grp('p_partkey', 'names')} AS grp FROM c WHERE name IN ('small ring', 'red widget', 'no such name')")
def named_events(spark, d):
    """Events by name, each still in the group that it had among all."""
    c = S.assigned(D.event_catalogue(spark, d), "p_partkey", SHARES, "names")
    return c.where(F.col("name").isin("small ring", "red widget", "no such name")).select("p_partkey", "name", "grp")


def _gappy(spark, d):
    """Windows of which some are missing, zero or not finite."""
    w = D.windows(spark, d).where("label <> 3")
    x = F.when(F.col("label") == 5, F.transform("samples", lambda v: v * 0)).otherwise(F.col("samples"))
    return w.select("vec_id", "example_id", "ifo", "label", F.when(F.col("label") == 7, F.concat(F.array(F.lit(float("nan"))), F.slice(x, 2, 63))).otherwise(x).alias("samples"))


GAPPY = f"{WIN}, g AS (SELECT vec_id, example_id, ifo, label, CASE label WHEN 5 THEN list_transform(x, lambda v: 0.0::DOUBLE) WHEN 7 THEN list_concat(['nan'::DOUBLE], x[2:64]) ELSE x END AS x FROM w WHERE label <> 3)"


@query(f"""WITH {GAPPY}, e AS (SELECT DISTINCT vec_id // 3 AS example_id, ifo FROM embeddings, (VALUES ('L1'), ('H1'), ('V1')) i(ifo))
    SELECT example_id, ifo, CASE WHEN x IS NULL THEN 0.0 ELSE {dot('list_transform(x, lambda v: CASE WHEN isnan(v) THEN 0.0::DOUBLE ELSE v END)')} END AS total, x IS NULL AS missing FROM e LEFT JOIN g USING (example_id, ifo)""")
def network_windows(spark, d):
    """A window for each example and detector, zeros where it is missing."""
    every = D.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).cast("long").alias("example_id")).distinct()
    n = R.complete_network(every, _gappy(spark, d).select("example_id", "ifo", "samples"), X.IFOS, 64)
    return n.select("example_id", "ifo", _dot(A.finite(F.col("samples"))).alias("total"), "missing")


@query(f"""WITH {GAPPY}, m AS (SELECT vec_id, len(list_filter(x, lambda v: isnan(v))) > 0 AS has_nan, len(list_filter(x, lambda v: v <> 0)) = 0 AS has_all_zeros FROM g)
    SELECT vec_id, has_nan, has_all_zeros, NOT has_nan AND NOT has_all_zeros AS is_valid, CASE WHEN has_nan THEN 'not finite' WHEN has_all_zeros THEN 'all zeros' ELSE '' END AS message FROM m""")
def window_validity(spark, d):
    """Validity of windows that keep the contract of 64 samples."""
    w = R.contract(_gappy(spark, d), 64).select("vec_id", R.validity(F.col("samples"), 64).alias("v"))
    return w.select("vec_id", "v.has_nan", "v.has_all_zeros", "v.is_valid", "v.message")


@query(f"""WITH {GAPPY} SELECT example_id FROM g GROUP BY 1 HAVING count(DISTINCT CASE WHEN len(list_filter(x, lambda v: v <> 0)) > 0 THEN ifo END) >= 2""")
def primary_windows(spark, d):
    """Examples whose detectors, two at least, all have samples."""
    w = _gappy(spark, d).select("example_id", "ifo", "samples")
    return R.seen_everywhere(w.select("example_id").distinct(), w, 2)


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'HL' WHEN 1 THEN 'HLV' WHEN 2 THEN 'LV' END AS network FROM part)
    SELECT p_partkey, network FROM n WHERE network IS NULL OR (contains(network, 'H') AND contains(network, 'L'))""")
def available_networks(spark, d):
    k = F.col("p_partkey") % 4
    c = D.event_catalogue(spark, d).select("p_partkey", F.when(k == 0, "HL").when(k == 1, "HLV").when(k == 2, "LV").alias("network"))
    return c.where(R.available(F.col("network"), "HL"))


# joins


@query(f"""WITH {T}, j AS (SELECT e.event_id, e.us, p.us AS r_us, p.event_id AS r_order, row_number() OVER (PARTITION BY e.event_id ORDER BY p.event_id) AS k
    FROM t e JOIN t p ON e.kind = 'error' AND p.kind = 'purchase' AND abs(e.us - p.us) < 20000000) SELECT event_id, us, r_us, r_order FROM j WHERE k = 1""")
def event_match(spark, d):
    """Scored windows with the first event of the list less than 20 seconds away."""
    t = D.transients(spark, d).select("event_id", "us", "kind")
    return S.first_within(t.where("kind = 'error'").select("event_id", "us"), t.where("kind = 'purchase'"), [], "event_id", 20 * SECOND)


@query(f"WITH {T}, {SEG}, {_merged('ma', 'seg')} SELECT event_id FROM t WHERE kind = 'signup' AND EXISTS (SELECT 1 FROM ma WHERE ma.ifo = t.ifo AND t.us BETWEEN ma.start_us AND ma.end_us)")
def allowed_closed(spark, d):
    t = D.transients(spark, d).where("kind = 'signup'").select("event_id", "ifo", "us")
    return I.covered(t, F.col("us"), I.merge(_segments(spark, d)), closed=True).select("event_id")


@query(f"""WITH {WIN}, o AS (SELECT *, list_position(['L1', 'H1', 'V1'], ifo) AS k FROM w), p AS (SELECT a.example_id, a.ifo AS first, b.ifo AS second, unnest(a.x) AS v, unnest(b.x) AS y FROM o a JOIN o b ON a.example_id = b.example_id AND a.k < b.k)
    SELECT example_id, first, second, round(corr(v, y), 6) AS r FROM p GROUP BY ALL""")
def network_correlation(spark, d):
    """Correlation of every detector pair of an example."""
    w = D.windows(spark, d).select("example_id", "ifo", "samples", F.array_position(F.array(*map(F.lit, X.IFOS)), F.col("ifo")).alias("k"))
    a, b = w.select("example_id", F.col("ifo").alias("first"), F.col("samples").alias("x"), F.col("k").alias("i")), w.select("example_id", F.col("ifo").alias("second"), F.col("samples").alias("y"), F.col("k").alias("j"))
    return a.join(b, "example_id").where("i < j").select("example_id", "first", "second", F.round(A.pearson(F.col("x"), F.col("y")), 6).alias("r"))


POOL = f"CASE WHEN {u('vec_id', 'pools')} < 0.7 THEN 'noise' ELSE 'signal' END"


@query(f"""WITH p AS (SELECT vec_id // 32 AS batch, vec_id % 32 AS position, {POOL} AS pool FROM embeddings), q AS (SELECT *, row_number() OVER (PARTITION BY batch, pool ORDER BY position) AS nth FROM p)
    SELECT batch, position, pool, nth, batch * 1000 + nth * 10 + CASE pool WHEN 'noise' THEN 0 ELSE 1 END AS example FROM q""")
def pool_gather(spark, d):
    """Batch positions with the example that their pool made for them."""
    e = D.windows(spark, d).select(F.floor(F.col("vec_id") / 32).alias("batch"), (F.col("vec_id") % 32).alias("position"), F.when(X.uniform(F.col("vec_id"), "pools") < 0.7, "noise").otherwise("signal").alias("pool"))
    made = e.select("batch").distinct().withColumn("pool", F.explode(F.array(F.lit("noise"), F.lit("signal")))).withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(32))))
    made = made.withColumn("example", F.col("batch") * 1000 + F.col("nth") * 10 + (F.col("pool") == "signal").cast("int"))
    return R.gathered(e, made).select("batch", "position", "pool", "nth", "example")


# groups


RANGES = {"low": (0.0, 1.0), "middle": (1.0, 3.0), "high": (3.0, 1e9)}


@query(f"""WITH {SCORES}, c AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY {u('doc_id', 'roc')}, doc_id) AS k, count(*) OVER (PARTITION BY truth) AS n FROM s), m AS (SELECT *, min(n) OVER () AS least FROM c),
    p AS (SELECT 'default' AS pool, truth, score FROM m WHERE k <= least UNION ALL {' UNION ALL '.join(f"SELECT '{n}', truth, score FROM s WHERE truth = 0 OR (snr >= {a} AND snr < {b})" for n, (a, b) in RANGES.items())}),
    h AS (SELECT pool, least(CAST(floor(score * 64) AS INTEGER), 63) AS k, sum(truth) AS p, sum(1 - truth) AS n FROM p GROUP BY 1, 2)
    SELECT pool, k / 64 AS threshold, round(sum(p) OVER (PARTITION BY pool ORDER BY k DESC) / nullif(sum(p) OVER (PARTITION BY pool), 0), 9) AS tpr,
        round(sum(n) OVER (PARTITION BY pool ORDER BY k DESC) / nullif(sum(n) OVER (PARTITION BY pool), 0), 9) AS fpr FROM h""")
def roc_pools(spark, d):
    """ROC of a balanced default pool and of ranges of signal strength, each against all noise."""
    s = D.scores(spark, d)
    pools = S.balanced(s, "truth", "doc_id", "roc").select(F.lit("default").alias("pool"), "truth", "score")
    for name, (a, b) in RANGES.items():
        pools = pools.unionByName(s.where((F.col("truth") == 0) | ((F.col("snr") >= a) & (F.col("snr") < b))).select(F.lit(name).alias("pool"), "truth", "score"))
    h = pools.groupBy("pool", F.least(F.floor(F.col("score") * 64), F.lit(63)).cast("int").alias("k")).agg(F.sum("truth").alias("p"), F.sum(1 - F.col("truth")).alias("n"))
    w, every = Window.partitionBy("pool").orderBy(F.col("k").desc()), Window.partitionBy("pool")
    share = lambda c: F.round(F.try_divide(F.sum(c).over(w), F.sum(c).over(every)), 9)
    return h.select("pool", (F.col("k") / 64).alias("threshold"), share("p").alias("tpr"), share("n").alias("fpr"))


PLACES = {n: tuple(float(v) for v in x.location) for n, x in G.network(G.SITES).items()}


@query(f"""WITH p AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for n, (x, y, z) in PLACES.items())}) v(ifo, x, y, z))
    SELECT round(max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) / {G.C_SI} * 1000, 6) AS longest_ms FROM p a JOIN p b ON a.ifo < b.ifo""")
def longest_baseline(spark, d):
    """Longest light time between two detectors of the network."""
    p = R.detector_table(spark, PLACES)
    a, b = p.alias("a"), F.broadcast(p).alias("b")  # a handful of rows
    size = F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "xyz"))
    return a.join(b, F.col("a.ifo") < F.col("b.ifo")).agg(F.round(F.max(size) / G.C_SI * 1000, 6).alias("longest_ms"))


@query(f"""WITH {T}, k AS (SELECT DISTINCT gps_key FROM t WHERE kind = 'click') SELECT ifo, count(*) AS requests, count(k.gps_key) AS hits, count(*) - count(k.gps_key) AS misses FROM t LEFT JOIN k USING (gps_key) GROUP BY ifo""")
def acquisition_counts(spark, d):
    """Requests of each detector, and those that the store has."""
    t = D.transients(spark, d).select("ifo", "gps_key", "kind")
    stored = t.where("kind = 'click'").select("gps_key").distinct().withColumn("hit", F.lit(True))
    return t.join(stored, "gps_key", "left").groupBy("ifo").agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


@query("""WITH n AS (SELECT vec_id, 64 - vec_id % 5 % 3 AS size FROM embeddings), c AS (SELECT size, count(*) AS n FROM n GROUP BY 1), m AS (SELECT arg_max(size, (n, -size)) AS size FROM c) SELECT vec_id, size FROM n JOIN m USING (size)""")
def common_sizes(spark, d):
    """Windows of the most common size."""
    w = D.windows(spark, d).withColumn("samples", F.slice("samples", F.lit(1), (64 - F.col("vec_id") % 5 % 3).cast("int")))
    return R.common_size(w).select("vec_id", F.size("samples").cast("long").alias("size"))


@query(f"WITH {SCORES} SELECT doc_id, round(score * (1 / (1 + exp(-(snr - 2)))), 9) AS combined FROM s")
def combined_scores(spark, d):
    return D.scores(spark, d).select("doc_id", F.round(F.col("score") * X.detection_probability(F.col("snr"), 2.0, 1.0), 9).alias("combined"))


# windows, curves, order


@query(f"""WITH {T}, {SEG}, {_merged('ma', 'seg')} SELECT ifo, start_us, CAST(floor((start_us - {DAY0}) / {HOUR}) AS BIGINT) AS first_bin, CAST(ceil((end_us - {DAY0}) / {HOUR}) AS BIGINT) AS end_bin FROM ma""")
def bin_indices(spark, d):
    """First and one past the last hour that a segment touches, from the start of the period."""
    s = I.merge(_segments(spark, d))
    return s.select("ifo", "start_us", F.floor((F.col("start_us") - DAY0) / HOUR).alias("first_bin"), F.ceil((F.col("end_us") - DAY0) / HOUR).alias("end_bin"))


@query(f"""WITH {SCORES}, n AS (SELECT round(score, 3) AS x, count(*) AS n FROM s WHERE truth = 0 GROUP BY 1), c AS (SELECT x, sum(n) OVER (ORDER BY x DESC) / ((SELECT sum(n) FROM n) * 2.0) AS y FROM n),
    l AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1, min(x) OVER () AS lo, max(x) OVER () AS hi FROM c),
    p AS (SELECT k, lo + k * ((hi - lo) / 199) AS x, hi, x0, y0, x1, y1 FROM l, range(200) r(k))
    SELECT k, round(CASE WHEN k = 199 THEN hi ELSE x END, 9) AS score, round(CASE WHEN k = 199 THEN y0 ELSE y0 + (x - x0) * (y1 - y0) / (x1 - x0) END, 7) AS rate
    FROM p WHERE (k = 199 AND x1 IS NULL) OR (k < 199 AND x >= x0 AND x < x1)""")
def downsampled_curve(spark, d):
    """The false-alarm curve at 200 evenly spaced scores."""
    r = S.false_alarm_rates(D.scores(spark, d).where("truth = 0"), F.round("score", 3), 2.0)
    return R.downsampled(r, "score", "rate", 200).select("k", F.round("x", 9).alias("score"), F.round("y", 7).alias("rate"))


@query(f"""WITH {SCORES}, a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 1024, doc_id) - 1 AS place, count(*) OVER () AS n FROM s WHERE truth = 0),
    r AS (SELECT range AS draw, {u('range', 'rank')} AS v FROM range((SELECT count(*) FROM s WHERE truth = 1))) SELECT draw, doc_id FROM r JOIN a ON a.place = floor(v * n)""")
def rank_padding(spark, d):
    """The shorter list of scores drawn with replacement to the length of the longer one."""
    s = D.scores(spark, d).select("doc_id", "truth")
    return R.drawn(s.where("truth = 0"), "doc_id", s.where("truth = 1").count(), "rank")


@query(f"WITH {T} SELECT event_id, kind, us FROM t WHERE kind IN ('purchase', 'view') ORDER BY kind, us, event_id LIMIT 40")
def confident_first(spark, d):
    """The first rows of a report: confident events by time, then marginal ones."""
    t = D.transients(spark, d).where(F.col("kind").isin("purchase", "view")).select("event_id", "kind", "us")
    return t.orderBy("kind", "us", "event_id").limit(40)


@query(f"""WITH {T}, {SEG}, {_merged('ma', 'seg')}, g AS (SELECT ifo, start_us, (end_us - start_us) // 1000000 AS n FROM ma)
    SELECT ifo, start_us, 'plain' AS rule, unnest(range(64, n - 32 + 1, 32)) AS position FROM g WHERE n - 96 >= 0
    UNION ALL SELECT ifo, start_us, 'clamped', greatest((k * 32 + s) % (n - 96), 64) FROM (SELECT *, (list_position(['L1', 'H1', 'V1'], ifo) - 1) * (n // 3) AS s, unnest(range(0, (n - 97) // 32 + 1)) AS k FROM g WHERE n - 96 > 0)""")
def grid_positions(spark, d):
    """Onsource starts on a grid, by both rules."""
    s = I.merge(_segments(spark, d)).withColumn("ifo_index", F.array_position(F.array(*map(F.lit, X.IFOS)), F.col("ifo")) - 1).withColumn("n_ifos", F.lit(3))
    plain, clamped = (R.grid(s, SECOND, 32, 64, c).select("ifo", "start_us", F.lit(n).alias("rule"), "position") for n, c in (("plain", False), ("clamped", True)))
    return plain.union(clamped)


@query(f"""WITH {T}, {SEG}, {_merged('ma', 'seg')}, p AS (SELECT ifo, start_us, {u('start_us', 'order')} AS v FROM ma) SELECT ifo, start_us, row_number() OVER (PARTITION BY ifo, start_us // {24 * HOUR} ORDER BY v, start_us) AS turn FROM p""")
def shuffled_segments(spark, d):
    """Segments of each day and detector in the order of a draw."""
    s = I.merge(_segments(spark, d)).withColumn("v", X.uniform(F.col("start_us"), "order"))
    w = Window.partitionBy("ifo", F.floor(F.col("start_us") / (24 * HOUR))).orderBy("v", "start_us")
    return s.select("ifo", "start_us", F.row_number().over(w).cast("long").alias("turn"))


# unions


@query(f"""WITH {T} SELECT event_id, 'noise' AS pool, 0 AS label, -1.0 AS snr, -1.0 AS mass FROM t WHERE kind = 'view' UNION ALL SELECT event_id, 'glitch', 2, round(snr, 6), -1.0 FROM t WHERE kind = 'error'
    UNION ALL SELECT p_partkey, 'signal', 1, -1.0, CAST(p_size AS DOUBLE) FROM part""")
def labelled_pools(spark, d):
    """Examples of three pools with their label; a pool's missing parameters are -1."""
    t, c = D.transients(spark, d), D.event_catalogue(spark, d)
    noise = t.where("kind = 'view'").select("event_id", F.lit("noise").alias("pool"), F.lit(0).alias("label"))
    glitch = t.where("kind = 'error'").select("event_id", F.lit("glitch").alias("pool"), F.lit(2).alias("label"), F.round("snr", 6).alias("snr"))
    signal = c.select(F.col("p_partkey").alias("event_id"), F.lit("signal").alias("pool"), F.lit(1).alias("label"), F.col("mass1").alias("mass"))
    every = noise.unionByName(glitch, allowMissingColumns=True).unionByName(signal, allowMissingColumns=True)
    return every.fillna(-1.0, ["snr", "mass"])


@query(f"""WITH {CAT} SELECT p_partkey, 'binary' AS generator, mass1, round(mass2, 6) AS mass2, NULL::DOUBLE AS duration FROM c WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'burst', NULL, NULL, round(0.1 + {u('p_partkey', 'dur')} * 0.9, 9) FROM c WHERE p_partkey % 2 = 1""")
def parameter_union(spark, d):
    """Parameters of two generators in one table; those that one lacks are null."""
    c, key = D.event_catalogue(spark, d), F.col("p_partkey")
    binary = c.where(key % 2 == 0).select("p_partkey", F.lit("binary").alias("generator"), "mass1", F.round("mass2", 6).alias("mass2"))
    burst = c.where(key % 2 == 1).select("p_partkey", F.lit("burst").alias("generator"), F.round(U.uniform_between(X.uniform(key, "dur"), 0.1, 1.0), 9).alias("duration"))
    return binary.unionByName(burst, allowMissingColumns=True)


@query(f"""WITH {WIN} SELECT example_id, 'L1' AS ifo, 0 AS component, {dot('x')} AS total FROM w WHERE ifo = 'V1' UNION ALL SELECT example_id, 'H1', 1, {dot('list_transform(x, lambda v: -v)')} FROM w WHERE ifo = 'V1'
    UNION ALL SELECT example_id, 'V1', 2, {dot('list_reverse(x)')} FROM w WHERE ifo = 'V1'""")
def incoherent_components(spark, d):
    """Each component of a generator in a detector of its own."""
    w, x = D.windows(spark, d).where("ifo = 'V1'"), F.col("samples")
    parts = [w.select("example_id", F.lit(i).alias("ifo"), F.lit(k).alias("component"), _dot(y).alias("total")) for k, (i, y) in enumerate(zip(X.IFOS, (x, F.transform(x, lambda v: -v), F.reverse(x))))]
    return parts[0].union(parts[1]).union(parts[2])


# scalars


STEPS = (1.0, 4.0, 16.0, 64.0, 256.0)


@query(f"""WITH {T}, n AS (SELECT event_id, snr AS seconds, CAST(floor((snr + 2) * 64) AS BIGINT) AS n FROM t) SELECT event_id, n - n % 2 AS samples, CASE {' '.join(f'WHEN seconds <= {s} THEN {s}' for s in STEPS)} ELSE round(seconds, 6) END AS tier FROM n""")
def window_sizes(spark, d):
    """Even sample counts with a second of margin at both ends; durations rounded up to a standard one."""
    t = D.transients(spark, d)
    return t.select("event_id", R.sample_count(F.col("snr") + 2, F.lit(64.0)).alias("samples"), F.round(R.tier(F.col("snr"), STEPS), 6).alias("tier"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name || '_of_' || p_type, '_', ' '), ' '), lambda s: upper(s[1]) || lower(s[2:])), ' ') AS title FROM part""")
def pretty_names(spark, d):
    name = F.concat(F.col("p_name"), F.lit("_of_"), F.col("p_type"))
    return D.table(spark, d, "part").select("p_partkey", F.initcap(F.replace(name, F.lit("_"), F.lit(" "))).alias("title"))


@query(f"""WITH {T} SELECT event_id, strftime(make_timestamp(CAST(floor(gps - 630720000) AS BIGINT) * 1000000 + {(K.GPS_EPOCH + K.LEAP) * SECOND}), '%Y-%m-%d %H:%M:%S') AS date FROM t""")
def report_dates(spark, d):
    """Calendar dates of GPS times (shifted by twenty years of 365 days)."""
    at = F.timestamp_seconds(F.floor(K.unix_of(F.col("gps") - 630_720_000)))
    return D.transients(spark, d).select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("date"))


@query(f"""WITH {T} SELECT event_id, CASE WHEN snr > 0 THEN round(1.5 * ln(snr) - snr / 20 - (lgamma(2.5) + 2.5 * ln(20)), 8) END AS gamma,
    round(ln(exp(-pow(snr + 3, 2) / 1250) + exp(-pow(snr - 3, 2) / 1250)) - ln(25 * sqrt(2 * pi())), 8) AS folded,
    CASE WHEN snr BETWEEN 10 AND 100 THEN round(-pow(snr - 50, 2) / 1800 - ln({0.5 * (__import__('math').erf(50 / (30 * 2**0.5)) - __import__('math').erf(-40 / (30 * 2**0.5)))!r}::DOUBLE) - ln(30 * sqrt(2 * pi())), 8) END AS truncated,
    CASE WHEN snr > 0 THEN round(ln(snr) - 5 * ln(1 + snr) - (lgamma(2) + lgamma(3) - lgamma(5)), 8) END AS beta_prime FROM t WHERE snr < 200""")
def log_probabilities(spark, d):
    x = F.col("snr")
    t = D.transients(spark, d).where("snr < 200")
    return t.select(
        "event_id", F.round(R.log_gamma_density(x, 2.5, 20.0), 8).alias("gamma"), F.round(R.log_folded_normal(x, 3.0, 25.0), 8).alias("folded"),
        F.round(R.log_truncated_normal(x, 50.0, 30.0, 10.0, 100.0), 8).alias("truncated"), F.round(R.log_beta_prime(x, 2.0, 3.0), 8).alias("beta_prime"),
    )


# arrays


@query(f"""WITH {WIN}, m AS (SELECT vec_id, list_transform(x, lambda v: abs(v - 0.05)) AS e FROM w) SELECT vec_id, list_position(e, list_min(e)) - 1 AS nearest, round((list_position(e, list_min(e)) - 1) / 2.0, 6) AS hertz FROM m""")
def nearest_samples(spark, d):
    """Place of the sample nearest to a value, and its frequency on the axis of a 32-Hz, 64-sample transform."""
    w = D.windows(spark, d).select("vec_id", F.transform("samples", lambda v: F.abs(v - 0.05)).alias("e"))
    at = F.array_position("e", F.array_min("e")) - 1
    axis = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: k / (64 * (1 / 32)))
    return w.select("vec_id", at.alias("nearest"), F.round(F.get(axis, at.cast("int")), 6).alias("hertz"))


@query(f"WITH {GAPPY} SELECT vec_id, CAST(len(list_filter(x, lambda v: v <> 0 AND NOT isnan(v))) > 0 AS INTEGER) AS flag FROM g")
def nonzero_flags(spark, d):
    return _gappy(spark, d).select("vec_id", F.exists("samples", lambda v: (v != 0) & ~F.isnan(v)).cast("int").alias("flag"))


@query(f"""WITH {WIN}, s AS (SELECT vec_id, x, ifo, CAST(floor({u('vec_id', 'shift')} * 17) AS INTEGER) - 8 AS shift FROM w)
    SELECT vec_id, shift, {dot('x[17 - shift:48 - shift]')} AS total, round((0.5 + shift / 32.0 + CASE ifo WHEN 'L1' THEN 0.0 WHEN 'H1' THEN 0.01 ELSE 0.02 END) / 1.0, 9) AS centre FROM s""")
def injection_slices(spark, d):
    """Windows cut from longer ones by a drawn shift, and where their centre then lies as a share of the window."""
    w = D.windows(spark, d).withColumn("shift", F.floor(X.uniform(F.col("vec_id"), "shift") * 17).cast("int") - 8)
    late = F.element_at(F.create_map(*[F.lit(v) for i, t in zip(X.IFOS, (0.0, 0.01, 0.02)) for v in (i, t)]), F.col("ifo"))
    return w.select("vec_id", "shift", _dot(R.shifted_slice(F.col("samples"), F.col("shift"), 32)).alias("total"), F.round((0.5 + F.col("shift") / 32 + late) / 1.0, 9).alias("centre"))


@query(f"""WITH {WIN}, m AS (SELECT vec_id, x, list_transform(range(8), lambda i: (vec_id >> CAST(i AS INTEGER)) & 1 = 1) AS m FROM w)
    SELECT vec_id, unnest(range(8)) AS place, unnest(list_transform(range(8), lambda i: CASE WHEN m[i + 1] THEN list_sum(x[len(list_filter(m[1:i], lambda v: v)) * 4 + 1:len(list_filter(m[1:i], lambda v: v)) * 4 + 4]) ELSE 0 END)) AS total FROM m""".replace("AS total FROM m", "AS total0 FROM m").replace("SELECT vec_id, unnest(range(8)) AS place", "SELECT vec_id, place, round(total0, 6) AS total FROM (SELECT vec_id, unnest(range(8)) AS place", 1) + ")")
def mask_expansion(spark, d):
    """Groups of four samples at the places where a mask is true, zeros elsewhere."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", F.col("vec_id"), i).bitwiseAND(1) == 1)
    w = D.windows(spark, d).select("vec_id", mask.alias("m"), "samples")
    w = w.select("vec_id", F.posexplode(R.spread(F.col("m"), 4, F.col("samples"))).alias("place", "x"))
    return w.select("vec_id", F.col("place").cast("long").alias("place"), F.round(A.total(F.col("x")), 6).alias("total"))


@query(f"""WITH {WIN}, m AS (SELECT example_id, ifo, list_max(list_transform(x, lambda v: abs(v))) * 20 AS top FROM w), a AS (SELECT example_id, avg(top) AS snr FROM m GROUP BY 1)
    SELECT example_id, round(1 / (1 + exp(-(snr - 6))), 8) AS score, round(1 - 1 / (1 + exp(-(snr - 6))), 8) AS other FROM a""")
def score_pairs(spark, d):
    """Mean over detectors of the largest ratio, as a pair of complementary scores; the second column is the score."""
    w = D.windows(spark, d).groupBy("example_id").agg(F.avg(A.peak(F.col("samples")) * 20).alias("snr"))
    p = X.detection_probability(F.col("snr"), 6.0, 1.0)
    w = w.select("example_id", F.array(1 - p, p).alias("scores"))
    score = F.when(F.size("scores") == 2, F.get("scores", 1)).otherwise(F.get("scores", 0))
    return w.select("example_id", F.round(score, 8).alias("score"), F.round(F.get("scores", 0), 8).alias("other"))


# compositions


TRANSIENTS = f"""d AS (SELECT gps_key, kind, ifo, min(event_id) AS event_id, min(us) AS us FROM t WHERE kind IN ('error', 'signup', 'purchase') GROUP BY 1, 2, 3),
    k AS (SELECT *, {_grp('gps_key', '42')} AS grp FROM d), c AS (SELECT event_id, ifo, kind, us FROM k WHERE grp = 'train' AND (kind <> 'purchase' OR event_id % 3 = 0))"""


def _transient_segments(spark, d):
    t = D.transients(spark, d)
    glitch, event = t.where(F.col("kind").isin("error", "signup")), t.where("kind = 'purchase'")
    both = K.feature_index(glitch.select("event_id", "gps_key", "ifo", "kind", "us"), event.select("event_id", "gps_key", "ifo", "kind", "us"))
    first = both.groupBy("gps_key", "kind", "ifo").agg(F.min("event_id").alias("event_id"), F.min("us").alias("us"))
    chosen = S.assigned(first, "gps_key", SHARES, "42").where("grp = 'train' and (kind <> 'purchase' or event_id % 3 = 0)")
    return chosen.select("event_id", "ifo", "kind", "us")


@query(f"WITH {T}, {TRANSIENTS} SELECT event_id, ifo, kind, us - 16000000 AS start_us, us + 16000000 AS end_us FROM c")
def valid_transient_segments(spark, d):
    """Union of glitches and events, deduplicated, of one group, events by name, with padded bounds."""
    s = _transient_segments(spark, d)
    return s.select("event_id", "ifo", "kind", (F.col("us") - 16 * SECOND).alias("start_us"), (F.col("us") + 16 * SECOND).alias("end_us")).sortWithinPartitions("start_us")


AUGMENTED = f"CASE WHEN {{t}} < 0.5 THEN list_reverse(CASE WHEN {{f}} < 0.5 THEN list_transform({{x}}, lambda v: -v) ELSE {{x}} END) WHEN {{f}} < 0.5 THEN list_transform({{x}}, lambda v: -v) ELSE {{x}} END"
NOISE = f"""{SEG}, {_merged('ma', 'seg')}, g AS (SELECT ifo, start_us, (end_us - start_us) // 1000000 AS n FROM ma), p AS (SELECT ifo, start_us + unnest(range(64, n - 32 + 1, 32)) * 1000000 AS at_us FROM g WHERE n >= 192),
    m AS (SELECT count(*) AS n FROM embeddings), o AS (SELECT p.ifo, at_us, CAST(floor({u('at_us', 'strain')} * m.n) AS BIGINT) AS vec_id FROM p, m),
    z AS (SELECT ifo, at_us, {AUGMENTED.format(t=u('at_us', 'turn'), f=u('at_us', 'flip'), x='x')} AS x FROM o LEFT JOIN (SELECT vec_id, x FROM w) q USING (vec_id))"""


def _noise_windows(spark, d):
    """(ifo, at_us, samples): grid positions in valid segments with their strain, augmented by draws of the example."""
    s = I.at_least(I.merge(_segments(spark, d)), 192 * SECOND)
    p = R.grid(s, SECOND, 32, 64).select("ifo", (F.col("start_us") + F.col("position") * SECOND).alias("at_us"))
    w = D.windows(spark, d).select("vec_id", "samples")
    n = w.agg(F.count("*").alias("n"))
    p = p.join(F.broadcast(n)).withColumn("vec_id", F.floor(X.uniform(F.col("at_us"), "strain") * F.col("n"))).drop("n")
    x = F.coalesce(F.col("samples"), F.array_repeat(F.lit(0.0), 64))
    return p.join(w, "vec_id", "left").select("ifo", "at_us", R.flipped_and_turned(x, F.col("at_us")).alias("samples"))


@query(f"WITH {T}, {WIN}, {NOISE} SELECT ifo, at_us, {dot('list_transform(x[33:64], lambda v: v * 1e3)', 3)} AS onsource, {dot('x[1:32]')} AS offsource FROM z")
def noise_windows(spark, d):
    """Noise request: valid segments, grid, strain or zeros, augmentation, then onsource (scaled) after offsource."""
    w = _noise_windows(spark, d)
    return w.select("ifo", "at_us", _dot(F.transform(F.slice("samples", 33, 32), lambda v: v * 1e3), 3).alias("onsource"), _dot(F.slice("samples", 1, 32)).alias("offsource"))


@query(f"""WITH {T}, {TRANSIENTS}, {WIN}, s AS (SELECT c.*, w.x FROM c LEFT JOIN w ON w.vec_id = c.event_id % 1000 AND w.ifo = c.ifo)
    SELECT event_id, ifo, kind, x IS NOT NULL AS hit, CASE WHEN x IS NULL THEN 0.0 ELSE {dot(AUGMENTED.format(t=u('event_id', 'turn'), f=u('event_id', 'flip'), x='x[17:45:4]'))} END AS window FROM s""")
def transient_windows(spark, d):
    """Transient request: chosen rows, the store's window or a miss, centre of it at a quarter of the rate, augmented."""
    c = _transient_segments(spark, d).withColumn("vec_id", F.col("event_id") % 1000)
    w = D.windows(spark, d).select("vec_id", "ifo", "samples")
    j = c.join(w, ["vec_id", "ifo"], "left")
    x = R.flipped_and_turned(A.decimated(A.centre_crop(F.col("samples"), 32), 4), F.col("event_id"))
    return j.select("event_id", "ifo", "kind", F.col("samples").isNotNull().alias("hit"), F.coalesce(_dot(x), F.lit(0.0)).alias("window"))


BURST = f"""b AS (SELECT p_partkey, 4 + {u('p_partkey', 'f')} * 8 AS f, {u('p_partkey', 'ph')} * 2 * pi() AS ph, CAST(floor({u('p_partkey', 'shift')} * 17) AS INTEGER) - 8 AS shift, {u('p_partkey', 'chance')} < 0.5 AS hit FROM part),
    q AS (SELECT *, 9.0 / (f * sqrt(2) * pi()) AS tau FROM b),
    s AS (SELECT p_partkey, shift, hit, list_transform(range(96), lambda i: sin(2 * pi() * f * (CAST(i AS DOUBLE) / 95 * 1.5 - 0.75) + ph) * exp(-pow(CAST(i AS DOUBLE) / 95 * 1.5 - 0.75, 2) / (2 * tau * tau))) AS y FROM q),
    v AS (SELECT p_partkey, shift, hit, list_transform(y[17 - shift:80 - shift], lambda v: CASE WHEN hit THEN v ELSE 0.0 END) AS y FROM s), a AS (SELECT *, sqrt(list_sum(list_transform(y, lambda v: v * v))) AS snr FROM v)"""


def _injections(c):
    """Rows by p_partkey with (y, shift, hit, snr, x): bursts scaled to a ratio of 8 in white noise, for half of the examples."""
    k = F.col("p_partkey")
    long = V.sine_gaussian(96, 1.5, 4 + X.uniform(k, "f") * 8, F.lit(9.0), F.lit(1.0), X.uniform(k, "ph") * V.TWO_PI)
    c = c.select("*", long.alias("y"), (F.floor(X.uniform(k, "shift") * 17).cast("int") - 8).alias("shift"), (X.uniform(k, "chance") < 0.5).alias("hit"))
    c = c.withColumn("y", R.shifted_slice(F.col("y"), F.col("shift"), 64))
    c = c.withColumn("y", F.when(F.col("hit"), F.col("y")).otherwise(F.transform("y", lambda v: v * 0)))
    c = c.withColumn("snr", F.sqrt(A.total(F.transform("y", lambda v: v * v))))
    return c.withColumn("x", A.scaled_to(F.col("y"), F.col("snr"), 8.0))


@query(f"""WITH {BURST} SELECT p_partkey, shift, CAST(len(list_filter(y, lambda v: v <> 0)) > 0 AS INTEGER) AS mask, round(snr * 8 / (snr + 1e-7), 6) AS ratio, round((0.5 + shift / 64.0) / 1.0, 9) AS centre,
    {dot('list_transform(y, lambda v: v * (8 / (snr + 1e-7)))', 4)} AS total FROM a""")
def injection_stream(spark, d):
    """Draws, waveforms longer than the window, shifted slices, masks, scaling to a target ratio, central times."""
    c = _injections(D.event_catalogue(spark, d).select("p_partkey"))
    flag = F.exists("y", lambda v: (v != 0) & ~F.isnan(v)).cast("int")
    return c.select("p_partkey", "shift", flag.alias("mask"), F.round(F.sqrt(A.total(F.transform("x", lambda v: v * v))), 6).alias("ratio"), F.round((0.5 + F.col("shift") / 64) / 1.0, 9).alias("centre"), _dot(F.col("x"), 4).alias("total"))


@query(f"""WITH {T}, {WIN}, {BURST}, e AS (SELECT vec_id, ifo, x, hit, shift, mass1, list_transform(y, lambda v: v * (8 / (snr + 1e-7))) AS y FROM w JOIN a ON p_partkey = vec_id JOIN (SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS mass1 FROM part) c ON key = vec_id)
    SELECT vec_id, CASE WHEN hit THEN 1 ELSE 0 END AS label, round(sqrt(list_sum(list_transform(y, lambda v: v * v))), 6) AS snr, CASE WHEN hit THEN mass1 ELSE -1.0 END AS mass, {dot('list_transform(range(1, 65), lambda i: x[i] + y[i])', 4)} AS onsource,
    round(list_max(list_transform(x[1:32], lambda v: abs(v))), 6) AS offsource_peak FROM e""")
def labelled_examples(spark, d):
    """Windows with and without injections, their label, and the requested variables.  Windows meet keys and masses
    before bursts are computed, by a merge: from the size of its file, the planner takes the catalogue for far smaller
    than its rows are and would broadcast it."""
    c = D.event_catalogue(spark, d).select("p_partkey", "mass1").hint("merge")
    w = D.windows(spark, d).select(F.col("vec_id").alias("p_partkey"), "samples").join(c, "p_partkey")
    w = _injections(w).withColumnRenamed("p_partkey", "vec_id")
    variables = {
        "label": F.when(F.col("hit"), 1).otherwise(0), "snr": F.round(F.sqrt(A.total(F.transform("x", lambda v: v * v))), 6), "mass": F.when(F.col("hit"), F.col("mass1")).otherwise(-1.0),
        "onsource": _dot(F.zip_with("samples", "x", lambda a, b: a + b), 4), "offsource_peak": F.round(A.peak(F.slice("samples", 1, 32)), 6), "shift": F.col("shift"),
    }
    wanted = ("label", "snr", "mass", "onsource", "offsource_peak")
    return w.select("vec_id", *[variables[v].alias(v) for v in wanted])


@query(f"""WITH {SCORES}, n AS (SELECT score FROM s WHERE truth = 0), th AS (SELECT far, (SELECT min(score) FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS k, count(*) OVER () AS c FROM n) WHERE k <= greatest(1, floor(far * c * 2.0))) AS threshold FROM (VALUES (0.01), (0.1), (0.25)) f(far))
    SELECT CAST(far AS DOUBLE) AS far, round(threshold, 9) AS threshold, count(*) AS n, count(*) FILTER (WHERE score >= threshold) AS found, round(count(*) FILTER (WHERE score >= threshold) / count(*), 9) AS recall FROM th, s WHERE truth = 1 GROUP BY far, threshold""")
def evaluation(spark, d):
    """Thresholds at three false-alarm rates from the noise scores, and the share of signals that reach them."""
    s = D.scores(spark, d)
    noise = s.where("truth = 0").select("score")
    n = noise.count()
    rates = (0.01, 0.1, 0.25)
    places = {far: max(1, int(far * n * 2.0)) for far in rates}
    top = noise.orderBy(F.desc("score")).limit(max(places.values()))  # as many rows as the highest rate asks for
    ranked = top.groupBy().agg(F.sort_array(F.collect_list("score"), asc=False).alias("x")) if n <= 1 << 20 else None
    if ranked is None:
        raise ValueError("use scoring.rate_thresholds for more than 2**20 noise scores")
    th = ranked.select(F.explode(F.array(*[F.struct(F.lit(far).alias("far"), F.get("x", k - 1).alias("threshold")) for far, k in places.items()])).alias("t")).select("t.*")
    j = s.where("truth = 1").join(F.broadcast(th))
    hit = F.count_if(F.col("score") >= F.col("threshold"))
    return j.groupBy("far", "threshold").agg(F.count("*").alias("n"), hit.alias("found"), F.round(hit / F.count("*"), 9).alias("recall")).withColumn("threshold", F.round("threshold", 9))


# views


@query(f"""WITH {T}, {SEG}, {_merged('ma', 'seg')} SELECT ifo, start_us, end_us - start_us AS duration, CAST(round_even(start_us / 1e6 * 100, 0) AS BIGINT) AS key, 'noise' AS kind FROM ma""")
def segment_properties(spark, d):
    s = I.merge(_segments(spark, d))
    return s.select("ifo", "start_us", (F.col("end_us") - F.col("start_us")).alias("duration"), X.gps_key(F.col("start_us") / 1e6).alias("key"), F.lit("noise").alias("kind"))


@query(f"""WITH {T}, g AS (SELECT gps_key, min(us) AS us, string_agg(DISTINCT ifo, ',' ORDER BY ifo) AS seen FROM t WHERE kind IN ('error', 'purchase') GROUP BY 1)
    SELECT gps_key, ifo, us - 1000000 AS start_us, us + 1000000 AS end_us, contains(seen, ifo) AS seen FROM g, (VALUES ('L1'), ('H1'), ('V1')) i(ifo)""")
def segment_views(spark, d):
    """Padded bounds of a transient for each detector of the network."""
    t = D.transients(spark, d).where(F.col("kind").isin("error", "purchase")).groupBy("gps_key").agg(F.min("us").alias("us"), F.collect_set("ifo").alias("seen"))
    t = t.withColumn("ifo", F.explode(F.array(*map(F.lit, X.IFOS))))
    return t.select("gps_key", "ifo", (F.col("us") - SECOND).alias("start_us"), (F.col("us") + SECOND).alias("end_us"), F.array_contains("seen", F.col("ifo")).alias("seen"))


@query(f"WITH {T} SELECT ifo, count(*) AS n, arg_max(gps_key, event_id) AS last, min(gps_key) AS first FROM t WHERE kind = 'view' GROUP BY ifo")
def store_listing(spark, d):
    """Rows of the store by detector: how many, the key appended last, the earliest key."""
    t = D.transients(spark, d).where("kind = 'view'")
    return t.groupBy("ifo").agg(F.count("*").alias("n"), F.max_by("gps_key", "event_id").alias("last"), F.min("gps_key").alias("first"))


@query(f"""WITH {SCORES} SELECT s.doc_id, round(score, 9) AS score, round(snr, 6) AS snr, d.lang, d.source FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE truth = 1 ORDER BY score, s.doc_id LIMIT 10""")
def worst_examples(spark, d):
    """The ten signals with the least scores, with all that is known of them."""
    worst = D.scores(spark, d).where("truth = 1").orderBy("score", "doc_id").limit(10)
    return worst.join(D.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", F.round("score", 9).alias("score"), F.round("snr", 6).alias("snr"), "lang", "source")


@query(f"""WITH e AS (SELECT range AS epoch, least(CAST(range AS DOUBLE) / 40, 1) AS p FROM range(50)) SELECT epoch, round(30 + (8 - 30) * p, 9) AS low, round(60 + (15 - 60) * p, 9) AS high, round(30 + (8 - 30) * p + {u('epoch', 'cur')} * (60 + (15 - 60) * p - (30 + (8 - 30) * p)), 8) AS value FROM e""")
def curriculum_state(spark, d):
    """Bounds of a distribution as epochs pass, and a value drawn for each epoch."""
    p = U.progress(F.col("epoch"), 41)
    e = spark.range(50).select(F.col("id").alias("epoch")).select("epoch", U.between(p, 30.0, 8.0).alias("low"), U.between(p, 60.0, 15.0).alias("high"))
    value = F.col("low") + X.uniform(F.col("epoch"), "cur") * (F.col("high") - F.col("low"))
    return e.select("epoch", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), F.round(value, 8).alias("value"))
