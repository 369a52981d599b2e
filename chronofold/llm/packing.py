"""Lexical retrieval packing: sequences of like documents, filled from a sharded BM25 index.

Documents become token ids once and are written.  Document frequencies of all documents are summed by id, so they are
bounded by the vocabulary.  A document's locality key is its two leading terms, drawn by BM25 weight.  A range exchange
on (key, doc_id) brings like documents together and deals equal keys out to any number of tasks.  A task takes its documents in
shards, builds an inverted index of each, and fills the window of each seed with its best unused neighbours; the last
one is cut, so windows come out full.  What is left at the end of a task is cut at powers of two.  A seed meets only
the documents of its own shard; README item 6 gives the recall of that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Tables, dealt, gathered, parts_for, texts
from .minhash import mix
from .word_bpe import tokenized

K1, B = 1.2, 0.75
#: Power of BM25 weights in the draw of leading terms.
FOCUS = 4


def _tokens(path: str, end_id: int, size: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        df, docs, total = np.zeros(size, np.int64), 0, 0
        tail = np.array([end_id], kind).tobytes()
        names = ["doc_id", "n", "tokens", "df"]
        for b in gathered(batches, "text", 12 << 20):
            packed = [x + tail for x in tokenized(path, b["text"], kind)]
            ns = []
            for p in packed:
                ids = np.frombuffer(p, kind)
                df[np.unique(ids)] += 1
                ns.append(len(ids))
            docs += len(ns)
            total += sum(ns)
            out = pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ns, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(ns), pa.list_(pa.int64()))], names)
            for at in range(0, len(ns), 1000):
                yield out.slice(at, 1000)
        stats = pa.array([[docs, total, *df.tolist()]], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), stats], names)

    return run


def weights(tf, idf, length, average: float):
    """BM25 weight of a term with this frequency and idf in a document of this length."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def locality(packed: list[bytes], kind: str, idf, average: float) -> list[int]:
    """Key of each document: its two leading terms, drawn by BM25 weight to the power FOCUS.

    A term leads where its weight times its own fixed random number is the largest (a weighted min-hash), so documents
    share a leading term the more often, the more weight they share.  Terms are hashed, so no end of the range collects
    the long documents.
    """
    import numpy as np

    raw = [np.frombuffer(p, kind) for p in packed]
    lengths = np.array([len(x) for x in raw], np.int64)
    both = (np.repeat(np.arange(len(raw), dtype=np.int64), lengths) << 32) | np.concatenate([*raw, np.zeros(0, kind)]).astype(np.int64)
    both.sort()
    new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]][: len(both)])
    tf, doc, term = np.diff(np.r_[new, len(both)]), both[new] >> 32, both[new] & 0xFFFFFFFF
    hashed = mix(np.arange(1, len(idf) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    draw = -np.log(-np.log(((hashed >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52))
    rank = draw[term] + FOCUS * np.log(np.maximum(weights(tf, idf[term], lengths[doc], average), 1e-12))
    order = np.lexsort((-rank, doc))
    starts = np.searchsorted(doc, np.arange(len(raw) + 1))
    name = (hashed >> np.uint64(33)).astype(np.int64)
    at, lone = starts[:-1], np.minimum(starts[:-1] + 1, starts[1:] - 1)
    return np.where(starts[1:] > at, (name[term[order[np.minimum(at, len(order) - 1)]]] << 31) | name[term[order[np.minimum(lone, len(order) - 1)]]], 0).tolist() if len(order) else [0] * len(raw)


def _keyed(idf_list: list[float], average: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        idf = np.array(idf_list)
        for b in batches:
            keys = locality(b["tokens"].to_pylist(), kind, idf, average)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b["doc_id"], b["tokens"]], ["key", "doc_id", "tokens"])

    return run


class Shard:
    """Inverted BM25 index over the ids of pool items."""

    def __init__(self, items: list, idf, average: float):
        import numpy as np

        lengths = np.array([len(x[2]) for x in items], np.int64)
        both = (np.repeat(np.arange(len(items), dtype=np.int64), lengths) << 32) | np.concatenate([x[2] for x in items]).astype(np.int64)
        both.sort()
        new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        tf = np.diff(np.r_[new, len(both)])
        item, term = both[new] >> 32, both[new] & 0xFFFFFFFF
        weight = weights(tf, idf[term], lengths[item], average)
        self.n, self.of_item = len(items), np.searchsorted(item, np.arange(len(items) + 1))
        self.term = term
        order = np.argsort(term, kind="stable")
        self.items, self.weights = item[order], weight[order].astype(np.float32)
        self.terms, self.starts = np.unique(term[order], return_index=True)
        self.stops = np.r_[self.starts[1:], len(order)]
        # terms of an eighth of the items or more also as rows over all items, which add up faster than lists
        common = np.flatnonzero(8 * (self.stops - self.starts) >= self.n)
        self.row, self.dense = np.full(len(self.terms), -1), np.zeros((len(common), self.n), np.float32)
        self.row[common] = np.arange(len(common))
        for k, c in enumerate(common):
            self.dense[k, self.items[self.starts[c] : self.stops[c]]] = self.weights[self.starts[c] : self.stops[c]]

    def scores(self, seed: int):
        """BM25 score of every item for all terms of the seed."""
        import numpy as np

        at = np.searchsorted(self.terms, self.term[self.of_item[seed] : self.of_item[seed + 1]])
        rows = self.row[at]
        score = self.dense[rows[rows >= 0]].sum(axis=0)
        spans = [slice(a, b) for a, b in zip(self.starts[at[rows < 0]].tolist(), self.stops[at[rows < 0]].tolist())]
        if spans:
            score = score + np.bincount(np.concatenate([self.items[x] for x in spans]), np.concatenate([self.weights[x] for x in spans]), minlength=self.n)
        return score

    def ranked(self, seed: int, free, first: int = 256) -> Iterator:
        """Free items with a term in common with the seed, best score first: the best `first` of them, then the others."""
        import numpy as np

        score = self.scores(seed)
        some = np.flatnonzero(free & (score > 0))
        low = -score[some]
        if len(some) > first:
            top = low <= np.partition(low, first)[first]
            yield some[top][np.argsort(low[top], kind="stable")]
            some, low = some[~top], low[~top]
        yield some[np.argsort(low, kind="stable")]

    def neighbours(self, seed: int):
        """All items with a term in common with the seed, best BM25 score over all of its terms first."""
        import numpy as np

        return np.concatenate(list(self.ranked(seed, np.ones(self.n, bool))))


def fill(items: list, idf, average: float, window: int, last: bool) -> tuple[list[list], list]:
    """(sequences of pieces, items left).  An item is [doc, start, ids, doc_tokens]; with `last` nothing is left."""
    import numpy as np

    out, index = [], Shard(items, idf, average)
    used = np.zeros(len(items), bool)
    sizes = np.array([len(x[2]) for x in items])
    left = int(sizes.sum())

    def others():  # where no neighbours are left: any unused item
        yield np.flatnonzero(~used)

    for seed in np.argsort(-sizes, kind="stable"):
        if used[seed]:
            continue
        if left < window:
            break
        pieces, room = [items[seed]], window - int(sizes[seed])
        used[seed] = True
        for group in chain(index.ranked(int(seed), ~used), others()):
            best = group
            while len(group := group[sizes[group] <= room]):  # in order, each that still has room
                fit = int(np.searchsorted(np.cumsum(sizes[group]), room, side="right"))
                pieces += [items[k] for k in group[:fit].tolist()]
                used[group[:fit]] = True
                room -= int(sizes[group[:fit]].sum())
                group = group[fit:]
            best = best[~used[best]]
            if room and len(best):
                k = best[0]
                doc, start, ids, n = items[k]
                pieces.append([doc, start, ids[:room], n])
                items[k] = [doc, start + int(room), ids[room:], n]
                sizes[k] -= room
                room = 0
            if not room:
                break
        left -= window - room
        out.append(pieces)
    rest = [items[k] for k in np.flatnonzero(~used)]
    if not last:
        return out, rest
    total = sum(len(x[2]) for x in rest)
    while total:
        size = min(window, 1 << (total.bit_length() - 1))
        pieces, room = [], size
        while room:
            doc, start, ids, n = rest.pop(0)
            pieces.append([doc, start, ids[:room], n])
            if len(ids) > room:
                rest.insert(0, [doc, start + room, ids[room:], n])
            room -= len(pieces[-1][2])
        total -= size
        out.append(pieces)
    return out, []


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packer(idf_list: list[float], average: float, window: int, kind: str, shard_docs: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        idf, seq = np.array(idf_list), TaskContext.get().partitionId() << 32
        pool, tokens, fresh = [], 0, False

        def rows(sequences: list[list]) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            cols: list[list] = [[] for _ in range(7)]
            for pieces in sequences:
                at = 0
                for doc, start, ids, n in pieces:
                    for c, v in zip(cols, (doc, start, len(ids), ids.astype("<u4").tobytes(), n, seq, at)):
                        c.append(v)
                    at += len(ids)
                seq += 1
            if cols[0]:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                full = []
                for doc, raw in zip(b["doc_id"].to_pylist(), b["tokens"].to_pylist()):
                    ids = np.frombuffer(raw, kind)
                    cut = len(ids) - len(ids) % window
                    full += [[[doc, i, ids[i : i + window], len(ids)]] for i in range(0, cut, window)]
                    if cut < len(ids):
                        pool.append([doc, cut, ids[cut:], len(ids)])
                        tokens += len(ids) - cut
                yield from rows(full)
                if len(pool) >= shard_docs or tokens >= shard_tokens:
                    done, pool = fill(pool, idf, average, window, False)
                    tokens = sum(len(x[2]) for x in pool)
                    yield from rows(done)
        if pool:
            yield from rows(fill(pool, idf, average, window, True)[0])

    return run


def pack(docs: DataFrame, tokenizer_file: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 4096, shard_tokens: int = 3_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    A null text counts as empty: its document is the end id alone.  Null ids and repeated rows are documents of their
    own; an empty table gives no pieces; extra columns are ignored.  The tokenizer must drop white space (no token
    crosses it), as the word-level vocabulary does.
    """
    import math

    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    schema = "doc_id long, n long, tokens binary, df array<bigint>"
    made = Tables(spark).write(texts(docs, id_col, text_col).mapInArrow(_tokens(tokenizer_file, end_id, size, kind), schema), "tokens")
    sums = made.where("n = -1").select(F.posexplode("df").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).where("c > 0").collect()
    counts = [0] * (size + 2)
    for r in sums:  # vocabulary-sized
        counts[r["i"]] = r["c"]
    n_docs, total = counts[0], counts[1]
    idf = [math.log(1 + (n_docs - c + 0.5) / (c + 0.5)) for c in counts[2:]]
    average = max(1.0, total / max(1, n_docs))
    keyed = made.where("n >= 0").select("doc_id", "tokens").mapInArrow(_keyed(idf, average, kind), "key long, doc_id long, tokens binary")
    parts = parts_for(spark, total * int(kind[-1]))
    rows = dealt(keyed, parts, "key", "doc_id", ranges=True).sortWithinPartitions("key", "doc_id").select("doc_id", "tokens")
    return rows.mapInArrow(_packer(idf, average, window, kind, shard_docs, shard_tokens), PIECES)
