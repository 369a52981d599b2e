"""Quality rules [native]: word statistics as SQL expressions and learned decision lists.

Everything that touches documents is a built-in function.  Learning is sequential covering on the driver over the
statistics of a bounded sample of labelled rows: each rule is grown by FOIL gain on two thirds of the sample, pruned
on the other third, and kept while it is precise there.  The list comes out as one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, SPACE_CHARS, Tables, carried

#: Below 2**20 words a window's hash and place share one long, which sorts as a primitive.
_PACK = 20


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order."""
    core = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, f"{SPACE}+", -1))


def _covered(places: Column) -> Column:
    """How many words the 3-word windows at these ascending places cover."""
    steps = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1), x + 3) - x))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeats(w: Column) -> Column:
    """Places of the 3-word windows found twice or more: equal hashes side by side once sorted, then equal words.

    Where neighbours of one hash differ in words, or a text has 2**20 words or more, windows are sorted by hash and
    words, so that equal ones are side by side whatever their hashes.
    """
    at = F.sequence(F.lit(0), F.size(w) - 3)
    same = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
    hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    mask = (1 << _PACK) - 1
    packed = F.sort_array(F.transform(at, lambda i: F.shiftleft(hashed(i), _PACK).bitwiseOR(i.cast("long"))))
    place = lambda x: x.bitwiseAND(F.lit(mask).cast("long")).cast("int")
    top = lambda x: F.shiftright(x, _PACK)
    near = lambda x, y, key, where: F.coalesce((key(x) == key(y)) & same(where(x), where(y)), F.lit(False))
    found = lambda s, key, where: F.filter(s, lambda x, k: F.when(k > 0, near(x, F.get(s, k - 1), key, where)).otherwise(F.lit(False)) | near(x, F.get(s, k + 1), key, where))
    mixed = lambda s: F.exists(F.transform(s, lambda x, k: (top(x) == top(F.get(s, k + 1))) & ~same(place(x), place(F.get(s, k + 1)))), lambda b: F.coalesce(b, F.lit(False)))
    full = lambda i: F.struct(hashed(i).alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
    by_words = F.transform(F.array(F.array_sort(F.transform(at, full))), lambda s: F.transform(found(s, lambda x: x["h"], lambda x: x["i"]), lambda x: x["i"]))
    by_hash = F.transform(
        F.array(packed), lambda s: F.when(mixed(s), F.get(by_words, F.lit(0))).otherwise(F.transform(found(s, top, place), place))
    )
    return (
        F.when(F.size(w) < 3, F.array().cast("array<int>"))
        .when(F.size(w) < (1 << _PACK), F.get(by_hash, F.lit(0)))
        .otherwise(F.get(by_words, F.lit(0)))
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the word statistics of each whole text; a null text has none of anything.  `keep`: as `__row`."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carried(keep))
    along = ["__row"] if keep else []
    d = d.select(
        *along, "doc_id", words(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length("text").cast("long").alias("n_chars"),
        F.length(F.regexp_replace("text", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^0-9]+", "")).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", "[^.,;:!?]+", "")).cast("long").alias("n_stops"),
    )
    d = d.select("*", F.sort_array(_repeats(F.col("w"))).alias("places"))
    return d.select(
        *along, "doc_id", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        "n_chars", "n_digits", "n_upper", "n_stops",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What the rules may test: each a SQL expression over the statistics.
FEATURES = {
    "n_words": "double(n_words)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0)",
    "symbol_share": "coalesce(try_divide(n_symbols, n_words), 0)",
    "dup_line_share": "coalesce(try_divide(n_dup_lines, n_lines), 0)",
    "repeat_share": "coalesce(try_divide(n_repeat_words, n_words), 0)",
    "distinct_share": "coalesce(try_divide(n_distinct, n_words), 0)",
    "digit_share": "coalesce(try_divide(n_digits, n_chars), 0)",
    "upper_share": "coalesce(try_divide(n_upper, n_chars), 0)",
    "stop_share": "coalesce(try_divide(n_stops, n_words), 0)",
    "words_per_line": "coalesce(try_divide(n_words, n_lines), 0)",
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    at: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.at if self.above else row[self.feature] <= self.at

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.at!r}"

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} double('{self.at!r}')"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    precision: float
    covered: int

    def holds(self, row: dict[str, float]) -> bool:
        return all(t.holds(row) for t in self.tests)


class _Counts:
    """Rows of one part of the sample as columns, so a candidate test is counted by one vector operation."""

    def __init__(self, rows: list[dict[str, float]], bad: list[bool]):
        import numpy as np

        self.bad = np.array(bad, bool)
        self.x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}

    def mask(self, tests):
        import numpy as np

        m = np.ones(len(self.bad), bool)
        for t in tests:
            m &= self.x[t.feature] > t.at if t.above else self.x[t.feature] <= t.at
        return m


def learn(rows: list[dict[str, float]], bad: list[bool], precision: float = 0.95, least: int = 8, max_rules: int = 12, max_tests: int = 4, cuts: int = 24) -> list[Rule]:
    """Sequential covering.  Rejecting rules only; rows that no rule covers are kept.  No or one-sided labels: no rules."""
    import numpy as np

    part = np.arange(len(rows)) % 3 == 2
    grow = _Counts([r for r, p in zip(rows, part) if not p], [b for b, p in zip(bad, part) if not p])
    prune = _Counts([r for r, p in zip(rows, part) if p], [b for b, p in zip(bad, part) if p])
    left, left2, rules = np.ones(len(grow.bad), bool), np.ones(len(prune.bad), bool), []
    while len(rules) < max_rules and (left & grow.bad).sum() >= least:
        tests, m = [], left.copy()
        while len(tests) < max_tests and (m & ~grow.bad).any():
            p0, n0 = (m & grow.bad).sum(), (m & ~grow.bad).sum()
            best = (0.0, None)
            for f, x in grow.x.items():
                for cut in np.unique(np.quantile(x[m], np.linspace(0, 1, cuts), method="lower")):
                    hit = m & (x > cut)
                    for above, c in ((True, hit), (False, m & ~hit)):
                        p1, n1 = (c & grow.bad).sum(), (c & ~grow.bad).sum()
                        if p1 >= least:
                            gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Test(f, above, float(cut)))
            if best[1] is None:
                break
            t = best[1]
            beyond = grow.x[t.feature][m]
            beyond = beyond[beyond > t.at]
            if len(beyond):  # half way to the next value, for rows between
                t = Test(t.feature, t.above, float((t.at + beyond.min()) / 2))
            tests.append(t)
            m = left & grow.mask(tests)

        def worth(ts):
            c = left2 & prune.mask(ts)
            p, n = (c & prune.bad).sum(), (c & ~prune.bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        if not tests:
            break
        held, grown = left2 & prune.mask(tests), left & grow.mask(tests)
        p, n = (held & prune.bad).sum() + (grown & grow.bad).sum(), (held & ~prune.bad).sum() + (grown & ~grow.bad).sum()
        ph, nh = (held & prune.bad).sum(), (held & ~prune.bad).sum()
        if p < least or p / (p + n) < precision or (ph + 1) / (ph + nh + 2) < min(precision, 0.8):
            break
        rules.append(Rule(tuple(tests), float(p / (p + n)), int(p + n)))
        left &= ~grow.mask(tests)
        left2 &= ~prune.mask(tests)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional: number of the first rule that holds, 0 where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        cond = F.expr(" AND ".join(t.sql() for t in rule.tests))
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return F.lit(0) if out is None else out.otherwise(0)


def sample_labels(stats: DataFrame, labels: DataFrame, most: int) -> tuple[list[dict[str, float]], list[bool]]:
    """Statistics of about `most` labelled documents at most, chosen by hash of their id; null labels don't count."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, 0.9 * most / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = stats.join(picked, "doc_id").select("doc_id", "quality", *[F.expr(e).alias(f) for f, e in FEATURES.items()]).limit(most).collect()
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % (1 << 32), r["doc_id"]))
    return [{f: r[f] for f in FEATURES} for r in rows], [r["quality"] == 0 for r in rows]


def quality_rules(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, precision: float = 0.95, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, statistics, base_failed, rule (0: none held), kept; `keep`: columns of the input
    row, as the struct `row`.

    most_labels bounds the labelled rows that the rules are learned from; statistics and verdicts cover every row.
    Null texts count as empty and fail the base rule; null or unlabelled ids take part in everything but learning;
    repeated rows each get their row; an empty table or no labels gives no rules; extra columns are ignored.
    """
    stats = Tables(docs.sparkSession).write(statistics(docs, keep=keep), "statistics")
    rules = learn(*sample_labels(stats, labels, most_labels), precision=precision)
    d = stats.select("*", base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    d = d.select("*", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
    return d.withColumnRenamed("__row", "row")
