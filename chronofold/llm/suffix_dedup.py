"""Suffix-array dedup on bytes by deep-shallow sorting.

A byte goes if a string of 50 bytes over it also starts in a document with a smaller doc_id.  Runs of window starts
with one minimizer are pieces; a piece's content (its windows' bytes together) is the unit that travels.  Pieces whose
minimizer occurs once are gone before anything is shuffled.  Pieces of equal content are settled by the smallest
document that has them.  Only where one minimizer has several contents do the first copies of each travel whole, and
the suffixes that start at their windows are sorted: multikey quicksort by eight bytes at a time to a shallow depth,
then blind tries for groups that still share their prefix.  Neighbours that agree over all 50 bytes form classes, and
the smallest document of a class covers the others.  Where the contents of one minimizer have more bytes than one task
should sort (long runs of one symbol, say), its windows meet by their bytes: each block of a content sends a row for
each distinct window with all of its places, so a repetitive text sends few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Tables
from ._repeats import by_segment, is_in, numbered, repeated_keys, runs, segments, slices, sliding
from .minhash import mix

K = 16
#: Bytes that the vectorised quicksort orders before blind tries take over.
SHALLOW = 32
#: Bytes of different contents of one minimizer that one task sorts; beyond, the windows are dealt out by their bytes.
HOT = 8 << 20
#: A long text is cut into overlapping parts of this many bytes.
PART = 4 << 20


def _parts(bodies: list[bytes], span: int):
    """(buffer, start of part, bytes of part, document, place in document); windows of parts are those of the text."""
    import numpy as np

    out = [(d, p, b[p : p + PART + span - 1]) for d, b in enumerate(bodies) for p in range(0, max(1, len(b) - span + 1), PART)]
    sizes = np.array([len(x[2]) for x in out], np.int64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if len(out) else sizes
    return b"".join([x[2] for x in out]) + bytes(64), starts, sizes, np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)


def _minimizers(buffer: bytes, span: int, block: int = 1 << 17):
    """Least hash of the K-byte strings in each window, block by block."""
    import numpy as np

    c = np.uint64(0xC2B2AE3D27D4EB4F)
    n = len(buffer) - 64
    out = np.empty(max(0, n - span + 1), np.uint64)
    for i in range(0, len(out), block):
        size = min(block, len(out) - i) + span - K
        x, y = (np.ndarray((size,), "<u8", buffer, i + o, (1,)) for o in (0, 8))
        h = mix(mix(x * c) + y) * c
        out[i : i + size - (span - K)] = sliding(h ^ (h >> np.uint64(32)), span - K + 1, True)
    return out


def _pieces(bodies: list[bytes], span: int):
    """(buffer, minimizers, runs' first window, windows, part, part starts, documents, places)."""
    import numpy as np

    buffer, starts, sizes, doc, place = _parts(bodies, span)
    m = _minimizers(buffer, span)
    begin, n, part = runs(m, np.minimum(starts, len(m)), np.where(starts < len(m), np.maximum(0, sizes - span + 1), 0)) if len(m) else (np.zeros(0, np.int64),) * 3
    return buffer, m, begin, n, part, starts, doc, place


def _keys(span: int):
    def keys_of(body: pa.Array):
        _, m, begin, _, part, _, doc, _ = _pieces(body.to_pylist(), span)
        return m[begin], doc[part]

    return keys_of


PIECE = "m long, g long, rank long, row long, pos long, n int"


def _pieces_out(span: int, most: int = 400_000):
    """Repeated pieces: the first document's of each content in a segment; n = -bytes: covered bytes of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        now, held, size, last = None, [], 0, (None, None)

        def flush():
            m, g, rank, row, pos, n = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((g, m))
            lead = np.r_[True, (m[order][1:] != m[order][:-1]) | (g[order][1:] != g[order][:-1])]
            owner = np.empty(len(g), np.int64)
            owner[order] = order[lead][np.cumsum(lead) - 1]  # the sort is stable and rows come in order
            sent = rank[owner] == rank
            yield _piece_batch(m[sent], g[sent], rank[sent], row[sent], pos[sent], n[sent])
            r, s = row[~sent], pos[~sent]
            r, s, e = _united(r, s, s + n[~sent] + span - 1)
            z = np.zeros(len(r), np.int64)
            yield _piece_batch(z.view(np.uint64), z.view(np.uint64), z, r, s, s - e)

        for segment, keys, rows, docs, body in segments(batches):
            if (segment != now or size > most) and held:
                yield from flush()
                size = 0
            now = segment
            ranks = []
            for r, d in zip(rows.tolist(), docs):  # rows of one id share the rank of the first
                if d is None or d != last[0]:
                    last = (d, r)
                ranks.append(last[1])
            if not len(keys):
                continue
            buffer, m, begin, n, part, starts, doc, place = _pieces(body.to_pylist(), span)
            ok = is_in(m[begin] & ~np.uint64(1), keys)
            begin, n, part = begin[ok], n[ok], part[ok]
            if not len(begin):
                continue
            digest = xxhash.xxh3_64_intdigest
            g = np.array([digest(buffer[i:j]) for i, j in zip(begin.tolist(), (begin + n + span - 1).tolist())], np.uint64)
            held.append((m[begin], g, np.array(ranks, np.int64)[doc[part]], rows[doc[part]], begin - starts[part] + place[part], n))
            size += len(begin)
        if held:
            yield from flush()

    return run


def _piece_batch(m, g, rank, row, pos, n) -> pa.RecordBatch:
    import numpy as np

    cols = [m.view(np.int64), g.view(np.int64), rank, row, pos]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array(n, pa.int32())], ["m", "g", "rank", "row", "pos", "n"])


def _united(row, s, e):
    """Intervals ordered by (row, s) with those that touch joined."""
    import numpy as np

    if not len(row):
        return row, s, e
    order = np.lexsort((s, row))
    row, s, e = row[order], s[order], e[order]
    top = e.copy()
    new = np.r_[True, row[1:] != row[:-1]]
    # the running end within a row: rows are offset so that one cumulative maximum serves all
    width = int(e.max()) + 1
    shift = (np.cumsum(new) - 1) * width
    top = np.maximum.accumulate(e + shift) - shift
    new[1:] |= s[1:] > top[:-1]
    at = np.flatnonzero(new)
    return row[at], s[at], top[np.r_[at[1:], len(row)] - 1]


class BlindTrie:
    """Orders strings of one length that share a long prefix: inner nodes know only the byte place that they branch at."""

    def __init__(self):
        self.root = None

    def add(self, key: bytes, item: int) -> None:
        if self.root is None:
            self.root = (key, [item])
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(key[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == key:
            node[1].append(item)
            return
        at = next(i for i in range(len(key)) if key[i] != other[i])
        up, node = None, self.root
        while isinstance(node, list) and node[0] < at:
            up, node = node, node[1][key[node[0]]]
        if isinstance(node, list) and node[0] == at:
            node[1][key[at]] = (key, [item])
            return
        fork = [at, {other[at]: node, key[at]: (key, [item])}]
        if up is None:
            self.root = fork
        else:
            up[1][key[up[0]]] = fork

    def leaves(self) -> Iterator[list[int]]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def sorted_classes(buffer: bytes, at, span: int, within=None):
    """Class number of each suffix, in order of its first `span` bytes; equal prefixes share a class.  64 spare bytes end the buffer.

    within: for each suffix the number of the first one of its group, where only members of a group can be equal.
    """
    import numpy as np

    n = len(at)
    group, live = np.zeros(n, np.int64) if within is None else within.copy(), np.arange(n)
    deep: list = []
    # shallow: multikey quicksort, eight bytes as one character; lone suffixes drop out
    for depth in range(0, SHALLOW, 8):
        x = np.ndarray((len(buffer) - 8,), ">u8", buffer, 0, (1,))[at[live] + depth].astype(np.uint64)
        order = np.lexsort((x, group[live]))
        live, x = live[order], x[order]
        g = group[live]
        new = np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])]
        first = np.flatnonzero(new)
        sizes = np.diff(np.r_[first, len(live)])
        old = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        # a group's number is the place of its first member, so numbers stay in order
        base = np.repeat(old, np.diff(np.r_[old, len(live)]))
        group[live] = g + np.repeat(first, sizes) - base
        live = live[np.repeat(sizes > 1, sizes)]
        if not len(live):
            return group
    # deep: equal tails are joined at once; groups with several tails are ordered by a blind trie
    rest = span - SHALLOW
    tails = np.ndarray((len(buffer) - rest,), f"V{rest}", buffer, 0, (1,))[at[live] + SHALLOW]
    kept = tails.tobytes()
    g = group[live]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[first, len(live)])
    halves = [np.ascontiguousarray(np.ndarray((len(live),), "<u8", kept + bytes(8), o, (rest,))) for o in {0, 8, rest - 8}]
    lead = np.repeat(first, sizes)
    same = np.ones(len(live), bool)
    for h in halves:
        same &= h == h[lead]
    mixed = np.logical_or.reduceat(~same, first)
    for i, size in zip(first[mixed].tolist(), sizes[mixed].tolist()):
        trie = BlindTrie()
        for k in range(i, i + size):
            trie.add(kept[k * rest : (k + 1) * rest], k)
        done = 0
        for leaf in trie.leaves():
            deep.append((live[leaf], int(g[i]) + done))
            done += len(leaf)
    for members, number in deep:
        group[members] = number
    return group


CONTENT = "m long, rank long, row long, pos long, n int, content binary, hot boolean"


def _contents(span: int):
    """From by_segment(wanted pieces as kind 0 with (pos, n), documents as kind 1): pieces with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, now = [], None
        for whole in batches:
            for b in slices(whole, most=4 << 20):
                out = []
                for kind, row, x, n, extra, body in zip(*(b[c].to_pylist() for c in ("kind", "row", "a", "b", "doc_id", "body"))):
                    if row != now:
                        wanted, now = [], row
                    if kind == 0:
                        rank, hot = map(int, body.split())
                        wanted.append((extra, rank, x, n, bool(hot)))
                    else:
                        out += [(m, rank, row, x, n, body[x : x + n + span - 1], hot) for m, rank, x, n, hot in wanted]
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["m", "rank", "row", "pos", "n", "content", "hot"])

    return run


SPANS = "row long, s long, e long"


def _span_batch(row, s, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (row, s, e)], ["row", "s", "e"])


def _sorted_pieces(span: int, most: int = 3 << 20):
    """Whole minimizer groups, several at a time, to covered spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held, size = [], 0

        def settle(rows):
            m, rank, row, pos, n, content = (list(c) for c in zip(*rows))
            rank, row, pos, n = (np.array(c, np.int64) for c in (rank, row, pos, n))
            sizes = np.array([len(c) for c in content], np.int64)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            piece = np.repeat(np.arange(len(n)), n)
            inside = np.arange(int(n.sum())) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
            # equal windows have one minimizer, so each minimizer's suffixes are a group of their own
            m = np.array(m, np.int64)
            new = np.r_[True, m[1:] != m[:-1]]
            lead = np.r_[0, np.cumsum(n)[:-1]][new][np.cumsum(new) - 1]
            cls = sorted_classes(b"".join(content) + bytes(64), starts[piece] + inside, span, lead[piece])
            order = np.lexsort((rank[piece], cls))
            c = cls[order]
            lead = np.r_[True, c[1:] != c[:-1]]
            least = np.empty(len(cls), np.int64)
            least[order] = rank[piece][order[lead]][np.cumsum(lead) - 1]
            hit = least < rank[piece]
            s = (pos[piece] + inside)[hit]
            return _span_batch(*_united(row[piece][hit], s, s + span))

        for batch in batches:
            for r in zip(*(batch[c].to_pylist() for c in ("m", "rank", "row", "pos", "n", "content"))):
                if size > most and r[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield settle(held)

    return run


WINDOW = "rank long, row long, pos long, window binary, places binary"


def _windows(span: int, block: int = 1 << 16, rows: int = 10_000):
    """Distinct windows of each block of a content, with their places in the block as packed 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for rank, row, pos, n, content in zip(*(batch[c].to_pylist() for c in ("rank", "row", "pos", "n", "content"))):
                for at in range(0, n, block):
                    size = min(block, n - at)
                    every = np.ascontiguousarray(np.ndarray((size,), f"V{span}", content, at, (1,)))
                    order = np.argsort(every, kind="stable").astype(np.int32)
                    cut = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
                    ends = np.r_[cut[1:], size]
                    for k in range(0, len(cut), rows):
                        part = list(zip(cut[k : k + rows].tolist(), ends[k : k + rows].tolist()))
                        same = lambda v: pa.array([v] * len(part), pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [same(rank), same(row), same(pos + at), pa.array([every[order[i]].tobytes() for i, _ in part], pa.binary()), pa.array([order[i:j].tobytes() for i, j in part], pa.binary())],
                            ["rank", "row", "pos", "window", "places"],
                        )

    return run


def _placed(span: int):
    """Places of covered windows to spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row, pos, places in zip(*(batch[c].to_pylist() for c in ("row", "pos", "places"))):
                s = np.frombuffer(places, np.int32).astype(np.int64) + pos
                yield _span_batch(*_united(np.full(len(s), row, np.int64), s, s + span))

    return run


FINAL = "doc_id long, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary"


def _finish():
    """From by_segment(spans as kind 0 with (s, e), documents as kind 1): results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, now = [], None
        for whole in batches:
            for b in slices(whole, most=4 << 20):
                out = []
                for kind, row, s, e, doc, body in zip(*(b[c].to_pylist() for c in ("kind", "row", "a", "b", "doc_id", "body"))):
                    if row != now:
                        spans, now = [], row
                    if kind == 0:
                        if spans and s <= spans[-1]["e"]:
                            spans[-1]["e"] = max(e, spans[-1]["e"])
                        else:
                            spans.append({"s": s, "e": e})
                        continue
                    kept, end = [], 0
                    for x in spans:
                        kept.append(body[end : x["s"]])
                        end = x["e"]
                    kept.append(body[end:])
                    out.append((doc, len(body), sum(x["e"] - x["s"] for x in spans), spans, b"".join(kept)))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return run


def suffix_dedup(docs: DataFrame, span: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (removed runs of the UTF-8 bytes), kept (bytes).

    `span` is 41 to 64.  Null texts are empty; a null id comes after every other id and is a document of its own; rows
    that repeat an id are one document and don't cover each other; an empty table gives an empty result; extra columns
    are ignored.
    """
    if not SHALLOW + 8 < span <= 64:
        raise ValueError("span must be 41 to 64")
    tables = Tables(docs.sparkSession)
    rows = numbered(docs, tables, id_col, text_col)
    bodies = rows.select("row", F.lit(1).alias("kind"), "doc_id", "body")
    keys = repeated_keys(rows, tables, _keys(span))
    found = tables.write(by_segment(tables.parts, keys.select("segment", F.lit(0).alias("kind"), F.col("keys").alias("body")), bodies).mapInArrow(_pieces_out(span), PIECE), "pieces")
    tables.drop("repeated")
    pieces = found.where("n > 0")
    # the smallest document of each content; contents of each minimizer
    owners = tables.write(pieces.groupBy("m", "g").agg(F.min("rank").alias("least"), F.max("n").alias("windows")), "owners")
    several = owners.groupBy("m").agg(F.count("*").alias("contents"), F.sum(F.col("windows") + (span - 1)).alias("bytes")).where("contents > 1")
    owners = owners.drop("windows")
    owners = tables.write(owners.join(several, "m", "left"), "contents")
    tables.drop("owners")
    placed = pieces.join(owners, ["m", "g"])
    first = (F.col("rank") == F.col("least")) & F.col("contents").isNotNull()
    when = lambda c: F.when(first, c)
    columns = (when(F.col("m")).alias("m"), when(F.col("rank")).alias("rank"), "row", "pos", "n", when(F.col("bytes") > HOT).alias("hot"))
    settled = found.where("n < 0").select(F.lit(None).cast("long").alias("m"), F.lit(None).cast("long").alias("rank"), "row", "pos", "n", F.lit(None).cast("boolean").alias("hot"))
    placed = tables.write(placed.where((F.col("rank") > F.col("least")) | first).select(*columns).union(settled), "placed")
    tables.drop("pieces", "contents")
    end = F.when(F.col("n") > 0, F.col("pos") + F.col("n") + span - 1).otherwise(F.col("pos") - F.col("n"))
    copies = placed.where("m is null").select("row", F.col("pos").alias("s"), end.alias("e"))
    extra = F.concat_ws(" ", F.col("rank").cast("string"), F.col("hot").cast("int").cast("string")).cast("binary")
    wanted = placed.where("m is not null").select("row", F.lit(0).alias("kind"), F.col("pos").alias("a"), F.col("n").cast("long").alias("b"), F.col("m").alias("doc_id"), extra.alias("body"))
    whole = tables.write(by_segment(tables.parts, wanted, bodies).mapInArrow(_contents(span), CONTENT), "whole")
    usual = whole.where("not hot").drop("hot").repartition("m").sortWithinPartitions("m").mapInArrow(_sorted_pieces(span), SPANS)
    windows = tables.write(whole.where("hot").select("rank", "row", "pos", "n", "content").mapInArrow(_windows(span), WINDOW), "windows")
    least = windows.groupBy("window").agg(F.min("rank").alias("least"))
    many = windows.join(least, "window").where("rank > least").select("row", "pos", "places").mapInArrow(_placed(span), SPANS)
    covered = tables.write(usual.union(many), "covered")
    tables.drop("whole", "windows")
    spans = copies.union(covered).select("row", F.lit(0).alias("kind"), F.col("s").alias("a"), F.col("e").alias("b"))
    out = tables.write(by_segment(tables.parts, spans, bodies).mapInArrow(_finish(), FINAL), "kept")
    tables.drop("numbered", "placed", "covered")
    return out

