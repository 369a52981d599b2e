"""Exact deduplication by Patricia-trie owners.

Texts are equal when identical after each run of ASCII white space becomes one space.  Each scan task inserts its
texts, by length and content hash, into compressed radix tries over the full byte strings; a terminal node stores the
smallest identifier.  Only one owner row of each distinct text leaves a task, so a text that fills a third of the table
meets in the next step as one row per task.  Those owners are dealt by (length, hash) and inserted again; tries over
budget spill by subtree.  Every row then takes the final owner of its local owner: a join whose keys hold at most one
task's rows.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import SPACE, Tables, carried


def common_prefix(a: bytes, i: int, b: bytes) -> int:
    """Length of the common prefix of a[i:] and b, by halving slice comparisons."""
    lo, hi = 0, min(len(a) - i, len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[i + lo : i + mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Terminal:
    """Smallest (is null, id, row) seen at a node, how many rows, and which local owners came."""

    __slots__ = ("least", "rows", "came")

    def __init__(self):
        self.least, self.rows, self.came = None, 0, []

    def add(self, key: tuple, rows: int, row: int) -> None:
        if self.least is None or key < self.least:
            self.least = key
        self.rows += rows
        self.came.append(row)


class _Node:
    __slots__ = ("label", "kids", "end")

    def __init__(self, label: bytes):
        self.label, self.kids, self.end = label, {}, None


class _Spilled:
    """A subtree that went to the task's own scratch file; its rows come back only to the same task."""

    __slots__ = ("file", "label")

    def __init__(self, label: bytes):
        self.label, self.file = label, tempfile.TemporaryFile()

    def put(self, rest: bytes, item: tuple) -> None:
        pickle.dump((rest, item), self.file, pickle.HIGHEST_PROTOCOL)

    def items(self) -> Iterator[tuple]:
        self.file.seek(0)
        while True:
            try:
                yield pickle.load(self.file)
            except EOFError:
                return


class Patricia:
    """Compressed radix trie over byte strings.  Labels held beyond `budget` bytes make the heaviest child spill."""

    def __init__(self, budget: int | None = None):
        self.root, self.budget, self.held, self.spills = _Node(b""), budget, 0, 0

    def insert(self, key: bytes, item: tuple) -> Terminal | None:
        """item: (least, rows, row).  The terminal, or None where the key's subtree is spilled."""
        node, i = self.root, 0
        while True:
            if i == len(key):
                return self._end(node, item)
            kid = node.kids.get(key[i])
            if kid is None:
                leaf = node.kids[key[i]] = _Node(key[i:])
                self.held += len(leaf.label) + 200
                got = self._end(leaf, item)
                if self.budget and self.held > self.budget:
                    self._spill()
                return got
            if key.startswith(kid.label, i):
                i += len(kid.label)
                if isinstance(kid, _Spilled):
                    kid.put(key[i:], item)
                    return None
                node = kid
                continue
            n = common_prefix(key, i, kid.label)
            fork = node.kids[key[i]] = _Node(kid.label[:n])
            kid.label = kid.label[n:]
            fork.kids[kid.label[0]] = kid
            node, i = fork, i + n

    def _end(self, node: _Node, item: tuple) -> Terminal:
        if node.end is None:
            node.end = Terminal()
        node.end.add(*item)
        return node.end

    def _weight(self, node) -> int:
        if isinstance(node, _Spilled):
            return 0
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + 200
            stack += [k for k in x.kids.values() if isinstance(k, _Node)]
        return total

    def _spill(self) -> None:
        """Move the heaviest subtree below the first branching node to a file, until half the budget is free."""
        while self.held > self.budget // 2:
            node = self.root
            while len(live := [k for k in node.kids.values() if isinstance(k, _Node)]) == 1 and live[0].kids:
                node = live[0]
            if not live:
                return
            heavy = max(live, key=self._weight)
            self.held -= self._weight(heavy)
            out, stack = _Spilled(heavy.label), [(heavy, b"")]
            while stack:
                x, path = stack.pop()
                if x.end:
                    for row in x.end.came[1:]:
                        out.put(path, (x.end.least, 0, row))
                    out.put(path, (x.end.least, x.end.rows, x.end.came[0]))
                for k in x.kids.values():
                    if isinstance(k, _Node):
                        stack.append((k, path + k.label))
                    else:
                        for rest, item in k.items():
                            out.put(path + k.label + rest, item)
                        k.file.close()
            node.kids[heavy.label[0]] = out
            self.spills += 1

    def terminals(self) -> Iterator[Terminal]:
        stack = [self.root]
        while stack:
            x = stack.pop()
            if isinstance(x, _Spilled):
                again = Patricia(self.budget)
                for rest, item in x.items():
                    again.insert(rest, item)
                x.file.close()
                yield from again.terminals()
                continue
            if x.end:
                yield x.end
            stack += x.kids.values()


_LOCAL = "row long, doc_id long, owner long, n long, h long, sha string, least long, rows long, body binary"


def _local(budget: int, along: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held, tries, size = [], {}, 0

        def flush():
            for batch, rows, ends in held:
                owner = [e.least[2] for e in ends]
                mine = pa.array([o == r for o, r in zip(owner, rows)])
                nulls = pa.nulls(len(rows), pa.large_binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, pa.int64()), batch["doc_id"], pa.array(owner, pa.int64()), batch["n"], batch["h"], batch["sha"],
                        pa.array([None if e.least[0] else e.least[1] for e in ends], pa.int64()), pa.array([e.rows for e in ends], pa.int64()),
                        pc.if_else(mine, batch["body"].cast(pa.large_binary()), nulls).cast(pa.binary()),
                        *(batch[c] for c in along),
                    ],
                    ["row", "doc_id", "owner", "n", "h", "sha", "least", "rows", "body", *along],
                )
            held.clear()
            tries.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = list(range(first, first + batch.num_rows))
                first += batch.num_rows
                ends = []
                for row, doc, n, h, body in zip(rows, *(batch[c].to_pylist() for c in ("doc_id", "n", "h", "body"))):
                    trie = tries.get((n, h))
                    if trie is None:
                        trie = tries[n, h] = Patricia()
                        size += n
                    ends.append(trie.insert(body, ((doc is None, doc or 0, row), 1, row)))
                size += batch.nbytes
                held.append((batch, rows, ends))
                if size > budget:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _owners(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(budget)
        for batch in batches:
            for row, doc, rows, body in zip(*(batch[c].to_pylist() for c in ("row", "least", "rows", "body"))):
                trie.insert(body, ((doc is None, doc or 0, row), rows, row))
        out: list[tuple] = []
        for end in trie.terminals():
            if end.rows > 1:
                out += [(row, end.least[2], None if end.least[0] else end.least[1], end.rows) for row in end.came]
            if len(out) > 20_000:
                yield _owner_batch(out)
                out = []
        yield _owner_batch(out)

    return run


def _owner_batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["owner", "keep_row", "keep_id", "group_size"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_mb: int = 48, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256; `keep`: columns of the input row, as the
    struct `row`.

    A null text counts as empty.  A null id sorts after every other id.  Of rows repeated with the same id and text one
    is kept (the first in scan order).  An empty table gives an empty result.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    body = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), f"{SPACE}+", " ")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"), *carried(keep))
    along = ["__row"] if keep else []
    source = source.select("doc_id", F.octet_length("body").cast("long").alias("n"), F.xxhash64("body").alias("h"), F.sha2("body", 256).alias("sha"), F.col("body").cast("binary").alias("body"), *along)
    schema = StructType([*StructType.fromDDL(_LOCAL), *(source.schema[c] for c in along)])
    local = tables.write(source.mapInArrow(_local(budget_mb << 20, along), schema), "local")
    owners = local.where("body is not null").select("row", "n", "h", "least", "rows", "body").repartition("n", "h")
    final = owners.select("row", "least", "rows", "body").mapInArrow(_owners(budget_mb << 20), "owner long, keep_row long, keep_id long, group_size long")
    every = local.select("row", "doc_id", "owner", "sha", *along).join(final, "owner", "left")
    alone = F.col("group_size").isNull()
    return every.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(F.col(c).alias("row") for c in along),
    )


__all__ = ["Patricia", "exact_dedup"]
