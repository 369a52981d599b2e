"""Secret scans [native]: pattern spans and sliding-window entropy spans, built-in functions only.

Places come without a user function: splitting a text by a pattern and extracting the pattern's matches give the
pieces between and the matches; running lengths of both are the code-point offsets.  Candidate strings are what remains
when base spans are blanked.  Each window of a candidate is judged by the Shannon entropy of its own character class:
the sum of c*log2(c) and the class counts follow the two characters that change when the window moves by one.
Allow-listed parts of a candidate are in no window.  Work grows with a text's length and with the power 1.5 of its
number of matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import texts

#: The base patterns.  Kinds in order of rank for spans that start together.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"

#: Window length, and the bits that a window of a class must reach: hex digits with a letter, letters with digits, and
#: letters of both cases (at least MIXED of each) without digits.
WINDOW = 20
BITS = {"hex": 3.1, "mixed": 3.85, "letters": 3.9}
MIXED = 5
#: Parts of candidates that are no secrets: words of their own, UUIDs, plain sequences.
ALLOWED = (
    r"(?i)(?<![a-z0-9])(?:examples?|samples?|dummy|placeholder|changeme|lorem|tests?)(?![a-z0-9])"
    r"|(?<![a-z0-9])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![a-z0-9])"
    r"|abcdefgh[a-z]*|0?12345678?9?"
)
#: A counter of the window has five bits, so twelve share a long.
_PACKED = 12
#: Texts are rebuilt block by block, as a place in a string is found by walking to it.
_BLOCK = 16_384

_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, even where f names it within a lambda."""
    return F.get(F.transform(F.array(value), f), 0)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What op makes of 0 and all values before each one.  Chunks of about the square root of n are folded on their own
    and then joined, since appending to an array copies it."""

    def folded(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(op(F.element_at(a, -1), v))))

    def whole(v: Column) -> Column:
        chunk = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(v))).cast("int"))
        chunks = _let(chunk, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), n), lambda i: folded(F.slice(v, i + 1, n))))
        return _let(chunks, lambda c: _let(folded(F.transform(c, lambda x: F.element_at(x, -1))), lambda h: F.flatten(F.transform(c, lambda x, k: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: op(F.get(h, k), y))))))

    return _let(values, whole)


def _places(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has at least `least` characters."""
    between, whole, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def spans(rows: Column) -> Column:
        before = _running(F.transform(rows, lambda x: x["n"] + x["m"]), lambda a, b: a + b)
        full = F.transform(F.arrays_zip(rows.alias("r"), before.alias("at")), lambda x: F.struct((x["at"] + x["r"]["n"]).alias("start"), F.lit(kind).alias("kind"), (x["at"] + x["r"]["n"] + x["r"]["m"]).alias("stop"), x["r"]["v"].alias("value")))
        return F.filter(full, lambda x: F.length(x["value"]) >= least)

    def lengths(rows: Column) -> Column:
        return F.transform(rows, lambda x: F.struct(F.length(x["b"]).alias("n"), F.length(x["w"]).alias("m"), x["v"].alias("v")))

    zipped = _let(whole, lambda w: F.arrays_zip(F.slice(between, 1, F.size(w)).alias("b"), w.alias("w"), values.alias("v")))
    return _let(lengths(zipped), spans)


def suspicious(value: Column, window: int = WINDOW) -> Column:
    """Does a window outside allow-listed parts reach the bits of its class?"""
    table = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)])
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // _PACKED)).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("k"), *[F.lit(0).alias(c) for c in ("hexes", "digits", "uppers", "lowers")], F.lit(False).alias("hit"))
    # places in ALPHABET from 1; 0 elsewhere
    is_in = {"hexes": lambda x: x.between(1, 22), "digits": lambda x: x.between(1, 10), "uppers": lambda x: x.between(17, 22) | x.between(43, 62), "lowers": lambda x: x.between(11, 16) | x.between(23, 42)}

    def step(a: Column, came: Column, gone: Column) -> Column:
        slot = lambda x: F.floor((x - 1) / _PACKED).cast("int")
        shift = lambda x: F.lit(5) * ((x - 1) % _PACKED)
        one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), shift(x))
        count = lambda n, x: F.call_function("shiftright", F.get(n, slot(x)), shift(x)).bitwiseAND(F.lit(31).cast("long")).cast("int")
        up = count(a["n"], came)
        s1 = a["s"] + F.get(table, up + 1) - F.get(table, up)
        down = count(a["n"], gone) + (came == gone).cast("int")
        s2 = F.when(gone == 0, s1).otherwise(s1 + F.get(table, down - 1) - F.get(table, down))
        counts = F.transform(a["n"], lambda c, j: c + F.when(j == slot(came), one(came)).otherwise(F.lit(0)) - F.when((gone > 0) & (j == slot(gone)), one(gone)).otherwise(F.lit(0)))
        of = {c: a[c] + f(came).cast("int") - f(gone).cast("int") for c, f in is_in.items()}
        bits, letters = F.lit(math.log2(window)) - s2 / window, of["uppers"] + of["lowers"]
        both = (of["digits"] > 0) & (letters > 0)
        hit = F.when(both, bits >= F.when(of["hexes"] == window, F.lit(BITS["hex"])).otherwise(F.lit(BITS["mixed"])))
        hit = hit.otherwise((of["digits"] == 0) & (of["uppers"] >= MIXED) & (of["lowers"] >= MIXED) & (bits >= BITS["letters"]))
        moved = F.struct(counts.alias("n"), s2.alias("s"), (a["k"] + 1).alias("k"), *[v.alias(c) for c, v in of.items()], (a["hit"] | ((a["k"] + 1 >= window) & hit)).alias("hit"))
        return F.when(a["hit"], a).when(came == 0, zero).otherwise(moved)

    def walked(codes: Column) -> Column:
        gone = lambda a, i: F.when(a["k"] >= window, F.get(codes, i - window)).otherwise(F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, lambda a, i: step(a, F.get(codes, i), gone(a, i)), lambda a: a["hit"])

    return _let(F.transform(F.split(F.regexp_replace(value, ALLOWED, "~"), ""), lambda c: F.instr(F.lit(ALPHABET), c)), walked)


def _runs(spans: Column) -> Column:
    """Runs (start, stop) of overlapping spans; spans are ordered by start."""

    def heads(x: Column) -> Column:
        return F.filter(x, lambda s: s["start"] >= s["top"])

    def ends(x: Column) -> Column:
        # a run ends where all spans before the next run end
        return _let(heads(x), lambda h: F.transform(h, lambda s, k: F.struct(s["start"].alias("start"), F.coalesce(F.get(h, k + 1)["top"], F.greatest(F.element_at(x, -1)["top"], F.element_at(x, -1)["stop"])).alias("stop"))))

    tops = _running(F.transform(spans, lambda s: s["stop"]), F.greatest)
    zipped = F.transform(F.arrays_zip(spans.alias("s"), tops.alias("top")), lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["stop"].alias("stop"), x["top"].alias("top")))
    return _let(zipped, ends)


def _replaced(text: Column, runs: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """The text with fill(characters, whether the run starts here) instead of each run, or of its part in a block."""

    def block(b: Column, at: Column, r: Column) -> Column:
        local = F.transform(F.filter(r, lambda x: (x["start"] < at + _BLOCK) & (x["stop"] > at)), lambda x: F.struct(F.greatest(x["start"] - at, F.lit(0)).alias("s"), F.least(x["stop"] - at, F.lit(_BLOCK)).alias("e"), (x["start"] >= at).alias("first")))

        def joined(x: Column) -> Column:
            end = lambda k: F.when(k > 0, F.get(x, k - 1)["e"]).otherwise(F.lit(0))
            pieces = F.transform(x, lambda y, k: F.concat(F.substring(b, end(k) + 1, y["s"] - end(k)), fill(y["e"] - y["s"], y["first"])))
            return F.concat(F.array_join(pieces, ""), F.substring(b, F.element_at(x, -1)["e"] + 1, F.lit(_BLOCK)))

        return _let(local, lambda x: F.when(F.size(x) > 0, joined(x)).otherwise(b))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    return _let(runs, lambda r: F.array_join(F.transform(blocks, lambda b, k: block(b, k * _BLOCK, r)), ""))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and spans: array of (start, kind, stop, value), by start, then kind; `keep`: further columns.

    A null text counts as empty.  Cheap substring tests guard each pattern, so a text without the letters that a
    pattern needs is not matched against it.
    """
    kept = [F.col(c) for c in keep]
    d = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), F.struct(*kept, F.lit(0).alias("__")).alias("__row"))
    t, none = F.col("__text"), F.array().cast(_SPAN)
    d = d.select(
        "*",
        F.when(t.rlike("[:=]") & t.rlike(r"(?i:pass|secret|token|api)"), _places(t, ASSIGN, 0, 2, 6)).otherwise(none).alias("__a"),
        F.when(t.contains("AKIA"), _places(t, ACCESS, 1, 0, 20)).otherwise(none).alias("__k"),
        F.when(t.rlike(HEX), _places(t, HEX, 2, 0, 24)).otherwise(none).alias("__h"),
    )
    d = d.select("__id", "__text", "__row", F.array_sort(F.concat("__a", "__k", "__h")).alias("__base"))
    blank = F.when(F.size("__base") > 0, _replaced(t, _runs(F.col("__base")), lambda n, first: F.repeat(F.lit(" "), n))).otherwise(t)
    d = d.select("*", F.when(t.rlike(CANDIDATE), blank).alias("__blank"))
    found = F.when(F.col("__blank").rlike(CANDIDATE), _places(F.col("__blank"), CANDIDATE, 3, 0, WINDOW))
    d = d.select("__id", "__text", "__row", "__base", found.alias("__c"))
    added = F.filter("__c", lambda c: suspicious(c["value"]))
    spans = F.when(F.size("__c") > 0, F.array_sort(F.concat("__base", added))).otherwise(F.col("__base"))
    d = d.select("__id", "__text", "__row", spans.alias("__spans"))
    return d.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text"), F.col("__spans").alias("spans"), *[F.col(f"__row.`{c}`").alias(c) for c in keep])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    return F.when(F.size(spans) == 0, text).otherwise(_replaced(text, _runs(spans), lambda n, first: F.when(first, F.lit(mark)).otherwise(F.lit(""))))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null texts count as empty and have no spans; repeated rows each get their row; an empty table gives an empty
    result; extra columns are ignored.
    """
    d = scan(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
