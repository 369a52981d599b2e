"""Which windows can repeat at all: minimizers of windows, counted across the corpus by packed exchanges.

A window of `span` symbols is represented by its minimizer, the least hash among its k-symbol strings, so equal
windows have equal minimizers.  Documents are written once, ordered by id and numbered, in segments.  Each segment
sends its distinct minimizers, packed by hash range; a range finds those that occur twice and answers each segment with
its own repeated ones.  A minimizer costs one entry for each segment however often it occurs, and answers are
joined with their segment only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Tables, dealt, hadoop, parts_for, texts


def numbered(docs: DataFrame, tables: Tables, id_col: str, text_col: str) -> DataFrame:
    """Written table (row, doc_id, body): row numbers follow doc_id, null ids last; row >> 33 is the segment.

    Segments are sized by the bytes of all texts, and by_segment deals as many partitions.
    """
    size = texts(docs, id_col, text_col).agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
    tables.parts = parts_for(tables.spark, size or 0)
    d = texts(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    order = F.col("doc_id").asc_nulls_last()
    d = dealt(d, tables.parts, order, ranges=True).sortWithinPartitions(order)
    return tables.write(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "body"), "numbered")


def buckets_for(tables: Tables) -> int:
    """A power of two of hash ranges, about 16 MB of written text each."""
    spark = tables.spark
    fs, p = hadoop(spark, tables.paths["numbered"])
    size = fs.getContentSummary(p).getLength()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 24, 1)
    return 1 << (n - 1).bit_length()


def sliding(h, w: int, least: bool):
    """Minimum (or maximum) of each w neighbours."""
    import numpy as np

    f = np.minimum if least else np.maximum
    done = 1
    while done < w:
        step = min(done, w - done)
        h = f(h[: len(h) - step], h[step:])
        done += step
    return h


def slices(batch: pa.RecordBatch, column: str = "body", most: int = 1 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes in the column, one row at least."""
    import numpy as np

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right"))
        end = min(max(end, at + 1), at + rows, n)
        yield batch.slice(at, end - at)
        at = end


def runs(m, starts, counts):
    """(first window, windows, document) of each maximal run of equal minimizers; starts, counts: windows of documents."""
    import numpy as np

    edge = np.zeros(len(m) + 1, np.int8)
    real = counts > 0
    edge[starts[real]] += 1
    edge[starts[real] + counts[real]] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    change = np.empty(len(m), bool)
    change[:1] = True
    np.not_equal(m[1:], m[:-1], out=change[1:])
    change[1:] |= ~valid[:-1]
    begin = np.flatnonzero(change & valid)
    last = np.empty(len(m), bool)
    last[-1:] = True
    last[:-1] = change[1:] | ~valid[1:]
    end = np.flatnonzero(last & valid)
    return begin, end - begin + 1, np.searchsorted(starts, begin, side="right") - 1


def packed_keys(keys, flags, bits: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, keys) of distinct keys; the lowest bit says that the key occurs twice where it was seen."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, flags = keys[order], flags[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    last = np.r_[new[1:], len(keys)] - 1
    twice = flags[new] != flags[last]
    keys = keys[new] | twice
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)]):
        yield int(bucket[i]), keys[i:j].tobytes()


def _seen(keys_of: Callable, bits: int, most: int):
    """keys_of(bodies) gives (keys, tag): a key with two tags repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        segment, held, size, base = None, [], 0, 0

        def flush():
            rows = [(b, segment, k) for b, k in packed_keys(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), bits)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "segment", "keys"])

        for whole in batches:
            for b in slices(whole):
                of = b["row"].to_numpy() >> 33
                for s in np.unique(of).tolist():
                    part = b.filter(pa.array(of == s)) if (of != s).any() else b
                    if s != segment or size > most:
                        if size:
                            yield flush()
                        segment, size = s, 0
                    keys, tags = keys_of(part["body"])
                    if len(keys):
                        held.append((keys & ~np.uint64(1), tags + base))
                        size += len(keys)
                        base += int(tags.max()) + 1
        if size:
            yield flush()

    return run


def _twice():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bucket, held = None, []

        def answer():
            where, raw = [s for s, _ in held], [np.frombuffer(k, np.uint64) for _, k in held]
            held.clear()
            keys = np.concatenate(raw)
            bare = keys & ~np.uint64(1)
            order = np.argsort(bare, kind="stable")
            ordered = bare[order]
            same = ordered[1:] == ordered[:-1]
            hit = np.zeros(len(keys), bool)
            hit[order] = np.r_[same, False] | np.r_[False, same]
            hit |= (keys & np.uint64(1)).astype(bool)
            out, i = [], 0
            for s, r in zip(where, raw):
                found = bare[i : i + len(r)][hit[i : i + len(r)]]
                i += len(r)
                if len(found):
                    out.append((s, found.tobytes()))
            cols = list(zip(*out)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], ["segment", "keys"])

        for b in batches:
            for k, s, keys in zip(*(b[c].to_pylist() for c in ("bucket", "segment", "keys"))):
                if k != bucket and held:
                    yield answer()
                bucket = k
                held.append((s, keys))
        if held:
            yield answer()

    return run


def repeated_keys(rows: DataFrame, tables: Tables, keys_of: Callable, most: int = 600_000) -> DataFrame:
    """Written table (segment, keys): each segment's minimizers that repeat somewhere."""
    n = buckets_for(tables)  # tasks; four ranges for each, so that hashing deals them evenly
    seen = rows.select("row", "body").mapInArrow(_seen(keys_of, n.bit_length() + 1, most), "bucket int, segment long, keys binary")
    ranges = seen.repartition(n, "bucket").sortWithinPartitions("bucket")
    return tables.write(ranges.mapInArrow(_twice(), "segment long, keys binary"), "repeated", "none")


def by_segment(parts: int | None, *frames: DataFrame) -> DataFrame:
    """Rows (segment, kind, row, a, b, doc_id, body) of all frames, each segment in one task, by row and kind.

    A frame without a row (answers for a whole segment) comes before all documents of its segment.
    """
    names = {"kind": "int", "row": "long", "a": "long", "b": "long", "doc_id": "long", "body": "binary"}
    out = None
    for f in frames:
        have = set(f.columns)
        segment = F.col("segment") if "segment" in have else F.shiftright("row", 33)
        d = f.select(segment.alias("segment"), *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in names.items()])
        out = d if out is None else out.unionByName(d)
    return dealt(out, parts, "segment").sortWithinPartitions("segment", F.col("row").asc_nulls_first(), "kind", "a", "b")


def is_in(values, keys):
    """Which values are among the sorted keys?"""
    import numpy as np

    if not len(keys):
        return np.zeros(len(values), bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From by_segment(answers as kind 0, documents as kind 1): (segment, its sorted keys, rows, doc_ids, bodies)."""
    import numpy as np

    segment, keys, raw = None, None, []
    for whole in batches:
        for b in slices(whole):
            seg, kind = b["segment"].to_numpy(), b["kind"].to_numpy()
            cut = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (kind[1:] != kind[:-1])])
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(seg)]):
                if seg[i] != segment:
                    segment, keys, raw = int(seg[i]), None, []
                part = b.slice(i, j - i)
                if kind[i] == 0:
                    raw += [np.frombuffer(x, np.uint64) for x in part["body"].to_pylist()]
                    continue
                if keys is None:
                    keys = np.unique(np.concatenate(raw)) if raw else np.zeros(0, np.uint64)
                    raw = []
                yield segment, keys, part["row"].to_numpy(), part["doc_id"].to_pylist(), part["body"]
