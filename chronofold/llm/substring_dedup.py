"""Substring dedup on words by de Bruijn compaction.

Windows of 20 words are the edges of a de Bruijn graph whose nodes are 19 words.  Only edges that can repeat become
rows (minimizers that occur once are gone before).  An edge's label has 96 bits.  A segment keeps the first of its equal
edges, so one edge meets in one place with a row for each segment at most.  There each later occurrence is labelled with
the coordinates of the first.  Edges that follow each other in a document and whose labels advance together are a path,
and compact by coordinates in NumPy into one row (document, start, edges, source document, source start); nodes and
degrees are not formed, and branching is not tested.  Joins with digests of the words at both coordinates verify every
path.  Paths that fail, where labels collide, are taken apart, and their edges and sources meet by their full words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Tables
from ._repeats import by_segment, is_in, numbered, repeated_keys, runs, segments, slices, sliding
from .minhash import join_hashes, word_hashes

K = 8
PATH = "h long, g int, row long, pos int, n int, orow long, opos int"


def _grams(h, size: int):
    """Hashes of all runs of `size` words, by doubling."""
    if size == 1:
        return h
    half = size // 2
    x = _grams(h, half)
    y = x if size % 2 == 0 else _grams(h, size - half)
    n = max(0, len(h) - size + 1)
    return join_hashes(x[:n], y[half : half + n])


def _windows(h, off, span: int):
    """(k-word hashes, minimizer of each window, first windows, windows) of documents."""
    import numpy as np

    grams = _grams(h, K)
    m = sliding(grams, span - K + 1, True)
    return grams, m, off[:-1], np.maximum(0, np.diff(off) - span + 1)


def _keys(span: int):
    def keys_of(body: pa.Array):
        """Hashes of the chosen k-word strings, each place a tag of its own."""
        import numpy as np

        h, off = word_hashes(body.cast(pa.string()), False, True)
        h = h[:, 0]
        if len(h) < span:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        grams, m, starts, counts = _windows(h, off, span)
        w = span - K + 1
        valid = np.zeros(len(m) + 1, np.int8)
        real = counts > 0
        np.add.at(valid, starts[real], 1)
        np.add.at(valid, (starts + counts)[real], -1)
        top = np.where(np.cumsum(valid[:-1]) > 0, m, 0)
        pad = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([pad, top, pad]), w, False) == grams)
        return grams[at], at

    return keys_of


def _compact(row, pos, orow, opos):
    """Runs of places that follow each other while their labels do: first index and length."""
    import numpy as np

    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    go = (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1) & (orow[1:] == orow[:-1]) & (opos[1:] == opos[:-1] + 1)
    first = np.flatnonzero(np.r_[True, ~go])
    return first, np.diff(np.r_[first, len(row)])


def _path_batch(row, pos, n, orow, opos, h=None, g=None) -> pa.RecordBatch:
    import numpy as np

    h = np.zeros(len(row), np.int64) if h is None else h
    g = np.zeros(len(row), np.int32) if g is None else g
    cols = [pa.array(h, pa.int64()), pa.array(g, pa.int32()), pa.array(row, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(orow, pa.int64()), pa.array(opos, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, ["h", "g", "row", "pos", "n", "orow", "opos"])


def _edges(span: int, bits: int, most: int = 600_000):
    """First edges of each segment (n = 0), and paths of the others, labelled with the first of their segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, held, size = None, [], 0
        masks = [np.uint64((1 << max(0, min(most, bits - at))) - 1) for at, most in ((0, 64), (64, 32))]

        def flush():
            h, g, row, pos = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.argsort(h, kind="stable")
            new = lambda x: np.r_[True, x[order][1:] != x[order][:-1]]
            if (new(g) & ~new(h)).any():
                order = np.lexsort((g, h))
            lead = new(h) | new(g)
            owner = np.empty(len(h), np.int64)
            owner[order] = order[lead][np.cumsum(lead) - 1]
            first = owner == np.arange(len(h))
            zero = np.zeros(int(first.sum()), np.int64)
            yield _path_batch(row[first], pos[first], zero, zero, zero, h[first].view(np.int64), g[first].astype(np.uint32).view(np.int32))
            r, p, o, q = row[~first], pos[~first], row[owner[~first]], pos[owner[~first]]
            at, n = _compact(r, p, o, q)
            yield _path_batch(r[at], p[at], n, o[at], q[at])

        for segment, keys, rows, _, body in segments(batches):
            if (segment != now or size > most) and held:
                yield from flush()
                size = 0
            now = segment
            words, off = word_hashes(body.cast(pa.string()), False, True)
            if len(words) < span or not len(keys):
                continue
            h, g = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
            _, m, starts, counts = _windows(h, off, span)
            begin, n, doc = runs(m, starts, counts)
            ok = is_in(m[begin] & ~np.uint64(1), keys)
            begin, n, doc = begin[ok], n[ok], doc[ok]
            at = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            doc = np.repeat(doc, n)
            if len(at):
                held.append((_grams(h, span)[at] & masks[0], _grams(g, span)[at] & masks[1], rows[doc], at - starts[doc]))
                size += len(at)
        if held:
            yield from flush()

    return run


def _paths():
    """Labelled edges, by (row, pos), to paths.  A path may also end where a batch does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pos, orow, opos = (b[c].to_numpy() for c in ("row", "pos", "orow", "opos"))
            at, n = _compact(row, pos, orow, opos)
            yield _path_batch(row[at], pos[at], n, orow[at], opos[at])

    return run


FINAL = "row long, doc_id long, n_words long, n_removed long, text string, a long, b long, digest binary"


def _finish(span: int):
    """From by_segment(paths as kind 0, source requests as kind 1, documents as kind 2): results and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        spans, asked, now = [], [], None
        for whole in batches:
            for b in slices(whole, most=4 << 20):
                out = []
                for kind, row, x, n, doc, body in zip(*(b[c].to_pylist() for c in ("kind", "row", "a", "b", "doc_id", "body"))):
                    if row != now:
                        spans, asked, now = [], [], row
                    if kind == 0:
                        spans.append((x, n))
                    elif kind == 1:
                        asked.append((x, n))
                    else:
                        w = body.split()
                        for x, n in dict.fromkeys(spans + asked):
                            out.append((row, None, None, None, None, x, n, xxhash.xxh3_128_digest(b" ".join(w[x : x + n + span - 1]))))
                        kept = w
                        if spans:
                            gone = np.zeros(len(w), bool)
                            for x, n in spans:
                                gone[x : x + n + span - 1] = True
                            kept = [w[i] for i in np.flatnonzero(~gone).tolist()]
                        out.append((row, doc, len(w), len(w) - len(kept), b" ".join(kept).decode(), None, None, None))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["row", "doc_id", "n_words", "n_removed", "text", "a", "b", "digest"])

    return run


def _words_at(span: int):
    """From by_segment(edges as kind 0, documents as kind 1): edges with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, now = [], None
        for whole in batches:
            for b in slices(whole, most=4 << 20):
                for kind, row, x, body in zip(*(b[c].to_pylist() for c in ("kind", "row", "a", "body"))):
                    if row != now:
                        asked, now = [], row
                    if kind == 0:
                        asked.append(x)
                        continue
                    w = body.split()
                    for k in range(0, len(asked), 10_000):
                        part = asked[k : k + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array([row] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array([b" ".join(w[x : x + span]) for x in part], pa.binary())], ["row", "pos", "words"])

    return run


def _settled(wrong: DataFrame, bodies: DataFrame, span: int, parts: int | None) -> DataFrame:
    """Removed edges (row, pos, n = 1) among those of failed paths.

    All edges of one label but the first hang on another edge of that label.  So an edge whose words also start earlier
    finds such an earlier one among the edges and sources of failed paths, or its own path holds.
    """
    steps = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")
    each = wrong.select("row", "pos", "orow", "opos", steps)
    edges = each.select("row", (F.col("pos") + F.col("k")).alias("a")).union(each.select("orow", F.col("opos") + F.col("k"))).distinct()
    found = by_segment(parts, edges.select("row", F.lit(0).alias("kind"), "a"), bodies).mapInArrow(_words_at(span), "row long, pos long, words binary")
    first = found.groupBy("words").agg(F.min(F.struct("row", "pos")).alias("o"))
    return found.join(first, "words").where("row <> o.row or pos <> o.pos").select("row", "pos", F.lit(1).alias("n"))


def substring_dedup(docs: DataFrame, span: int = 20, id_col: str = "doc_id", text_col: str = "text", label_bits: int = 96) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, text (kept words joined by one space).

    Removed are words covered by a window of `span` words that also starts earlier: in a smaller doc_id, or earlier in
    the same document.  Null texts have no words; null ids come after all others, rows that repeat an id come one
    after the other; an empty table gives an empty result; extra columns are ignored.  Labels of fewer bits give the
    same result with more work.
    """
    tables = Tables(docs.sparkSession)
    rows = numbered(docs, tables, id_col, text_col)
    bodies = lambda kind: rows.select("row", F.lit(kind).alias("kind"), "doc_id", "body")
    keys = repeated_keys(rows, tables, _keys(span))
    inputs = by_segment(tables.parts, keys.select("segment", F.lit(0).alias("kind"), F.col("keys").alias("body")), bodies(1))
    found = tables.write(inputs.mapInArrow(_edges(span, label_bits), PATH), "edges")
    tables.drop("repeated")
    first = F.first(F.struct("row", "pos")).over(Window.partitionBy("h", "g").orderBy("row", "pos"))
    later = found.where("n = 0").select("h", "g", "row", "pos").withColumn("o", first).where("row <> o.row or pos <> o.pos").select("row", "pos", F.col("o.row").alias("orow"), F.col("o.pos").alias("opos"))
    later = later.repartition(F.shiftright("row", 33), F.pmod("row", F.lit(16))).sortWithinPartitions("row", "pos")
    columns = ("row", "pos", "n", "orow", "opos")
    paths = tables.write(later.mapInArrow(_paths(), PATH).union(found.where("n > 0")).select(*columns), "paths")
    tables.drop("edges")
    spans = lambda d: d.select("row", F.lit(0).alias("kind"), F.col("pos").alias("a"), F.col("n").alias("b")).distinct()
    source = paths.select(F.col("orow").alias("row"), F.lit(1).alias("kind"), F.col("opos").alias("a"), F.col("n").alias("b")).distinct()
    done = tables.write(by_segment(tables.parts, spans(paths), source, bodies(2)).mapInArrow(_finish(span), FINAL), "done")
    digests = done.where("digest is not null").select("row", "a", "b", "digest")
    sides = [digests.select(F.col("row").alias(r), F.col("a").cast("int").alias(p), F.col("b").cast("int").alias("n"), F.col("digest").alias(d)) for r, p, d in (("row", "pos", "own"), ("orow", "opos", "source"))]
    wrong = tables.write(paths.join(sides[0], ["row", "pos", "n"]).join(sides[1], ["orow", "opos", "n"]).where("own <> source").select(*columns), "wrong")
    if not wrong.isEmpty():
        held = paths.join(wrong, list(columns), "left_anti").select("row", "pos", "n")
        done = tables.write(by_segment(tables.parts, spans(held.union(_settled(wrong, bodies(1), span, tables.parts))), bodies(2)).mapInArrow(_finish(span), FINAL), "done")
    tables.drop("numbered", "paths", "wrong")
    return done.where("digest is null").select("doc_id", "n_words", "n_removed", "text")
