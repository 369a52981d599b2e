"""MinHash near-deduplication with exact confirmation.

Documents with one and the same shingle set form a class, represented by its smallest id.  Many universal hash minima
are banded; in each bucket every representative is paired with the bucket's smallest id only.  Pairs whose signatures
agree well enough are confirmed on full shingle sets, and confirmed links give components by alternating large-star
and small-star.  Buckets that still hold several components are then taken up again: their documents are compared by
signatures, block by block where there are many, and those with a pair to be confirmed by their sets.  A task merges
components as it finds links, so a pair is looked at only while it can still matter.  No pairs are emitted but links,
and no link that the bands can see is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Tables, texts
from ._repeats import slices

#: A pair at the threshold 0.8 shares no band with probability (1 - 0.8**5)**32, about 3 in a million.
BANDS, ROWS = 32, 5
#: A mixed bucket with more documents is compared block by block.
BLOCK = 2000


def word_hashes(batch: pa.Array, fold: bool, wide: bool = False):
    """(hash of every word, offsets of documents) for a string array; nulls have no words.  wide: two hashes a word."""
    import numpy as np
    import xxhash

    text = pc.fill_null(batch, "").cast(pa.large_string())
    parts = pc.ascii_split_whitespace(text)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    offsets = offsets - offsets[0]
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        offsets = np.r_[0, np.cumsum(real)][offsets]
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    distinct = pc.ascii_lower(coded.dictionary) if fold else coded.dictionary
    names = distinct.cast(pa.large_binary()).to_pylist()
    if wide:
        each = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names)), "<u8").reshape(-1, 2)
    else:
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    return each[coded.indices.to_numpy()] if len(each) else each, offsets.astype(np.int64)


def mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def join_hashes(a, b):
    import numpy as np

    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b)


def shingle_sets(batch: pa.Array, size: int = 4) -> list:
    """Sorted distinct shingle hashes of each document, A-Z folded; fewer words than `size` make one shingle."""
    import numpy as np
    import xxhash

    h, off = word_hashes(batch, True)
    if len(h) >= size:
        run = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            run = join_hashes(run, h[k : len(h) - size + 1 + k])
    out = []
    for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
        if j - i >= size:
            out.append(np.unique(run[i : j - size + 1]))
        elif j > i:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[i:j].tobytes(), seed=j - i)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 20):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 31, (bands * rows, 1), np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (bands * rows, 1), np.uint32)
        self.salt = rng.integers(0, 1 << 63, bands, np.uint64)

    def minima(self, shingles):
        import numpy as np

        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = None
        for i in range(0, len(x), 2048):
            m = (self.a * x[i : i + 2048] + self.b).min(axis=1)
            out = m if out is None else np.minimum(out, m)
        return out

    def band_keys(self, minima):
        import numpy as np

        m = minima.reshape(self.bands, self.rows).astype(np.uint64)
        h = self.salt.copy()
        for k in range(self.rows):
            h = join_hashes(h, m[:, k])
        return h.view(np.int64)


def _features(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        signer = Signer(bands, rows)
        for whole in batches:
            for b in slices(whole, "text", most=4 << 20, rows=500):
                n, prints, keys, sigs, seen = [], [], [], [], {}
                for s in shingle_sets(b["text"], size):
                    n.append(len(s))
                    fp = xxhash.xxh3_128_digest(s.tobytes())
                    prints.append(fp)
                    if fp not in seen:
                        m = signer.minima(s) if len(s) else None
                        seen[fp] = (None, None) if m is None else (signer.band_keys(m).tolist(), (m & np.uint32(255)).astype(np.uint8).tobytes())
                    keys.append(seen[fp][0])
                    sigs.append(seen[fp][1])
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"], pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "n", "fp", "bands", "sig"]
                )

    return run


def _sets(size: int):
    """Sets of the texts that have the fingerprint given with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for b in slices(whole, "text", most=4 << 20, rows=500):
                sets = [s.tobytes() for s in shingle_sets(b["text"], size)]
                right = pa.array([xxhash.xxh3_128_digest(s) == fp for s, fp in zip(sets, b["fp"].to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sets, pa.binary())], ["doc_id", "shingles"]).filter(right)

    return run


def _alike(hashes: int, share: float):
    """Pairs whose signatures agree as often as a pair at the threshold does, less six standard deviations."""
    least = hashes * share - 6 * (hashes * share * (1 - share)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, hashes) for c in ("sig_a", "sig_b"))
                b = b.filter(pa.array((x == y).sum(axis=1) >= least))
            yield b.select(["a", "b"])

    return run


def _confirm(percent: int):
    """Rows come by (a, part), the leader's own first (b null); members link if 100*shared >= percent*union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        lead = None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for a, b, raw in zip(*(batch[c].to_pylist() for c in ("a", "b", "shingles"))):
                s = np.frombuffer(raw, np.uint64)
                if b is None:
                    lead = s
                    continue
                if 100 * min(len(s), len(lead)) < percent * max(len(s), len(lead)):
                    continue
                both = np.concatenate([lead, s])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return run


class _Bucket:
    """Documents of one bucket (or of two of its blocks) by arrays; pairs that may be links between components."""

    def __init__(self, rows: list[tuple], percent: int, hashes: int):
        import numpy as np

        self.key, (_, x, y) = rows[0][:3], rows[0][:3]
        self.docs, self.own, self.block = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        self.size, self.bands = np.array([r[6] for r in rows], np.int64), np.array([r[7] for r in rows], np.int64)
        self.sigs = np.frombuffer(b"".join(r[8] for r in rows), np.uint8).reshape(len(rows), -1)
        self.across, self.percent = x != y, percent
        self.least = hashes * percent / 100 - 6 * (hashes * percent * (100 - percent)) ** 0.5 / 100
        self.band = int(np.flatnonzero(self.bands[0] == self.key[0])[0])

    def near(self, k: int, parts):
        """Earlier documents that document k may be linked with: in another part, of like size, with this bucket as the
        first that both share, with signatures that agree well enough.  Two blocks meet here only across."""
        import numpy as np

        n = self.size[k]
        at = np.flatnonzero((parts[:k] != parts[k]) & (100 * self.size[:k] >= self.percent * n) & (100 * n >= self.percent * self.size[:k]))
        if self.across:
            at = at[self.block[at] != self.block[k]]
        if len(at):
            at = at[(self.bands[at] == self.bands[k]).argmax(axis=1) == self.band]
        return at[(self.sigs[at] == self.sigs[k]).sum(axis=1) >= self.least] if len(at) else at

    def links(self, sets: list) -> list[tuple[int, int]]:
        """Confirmed links; parts that one joins are one part for the pairs that follow."""
        out, parts = [], self.own.copy()
        for k in range(1, len(self.docs)):
            for o in self.near(k, parts).tolist():
                if parts[k] == parts[o]:
                    continue
                shared, both = len(intersect(sets[k], sets[o])), len(sets[k]) + len(sets[o])
                if 100 * shared >= self.percent * (both - shared):
                    out.append((int(self.docs[o]), int(self.docs[k])))
                    parts[parts == max(parts[k], parts[o])] = min(parts[k], parts[o])
        return out


def intersect(a, b):
    import numpy as np

    return np.intersect1d(a, b, assume_unique=True)


PLACE = ("bucket", "x", "y", "doc_id", "component", "block", "n", "bands", "sig")


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple) -> Iterator[list[tuple]]:
    """Rows of one (bucket, x, y), which come one after the other."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*(b[c].to_pylist() for c in columns)):
            if held and r[:3] != held[0][:3]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _candidates(percent: int, hashes: int):
    """Documents of a bucket that have a pair to be confirmed there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, PLACE):
            g, found = _Bucket(rows, percent, hashes), set()
            for k in range(1, len(rows)):
                at = g.near(k, g.own).tolist()
                found.update([*at, k] if at else ())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[k][i] for k in sorted(found)], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], list(PLACE[:4]))

    return run


def _across(percent: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for rows in _grouped(batches, (*PLACE, "shingles")):
            links = _Bucket(rows, percent, hashes).links([np.frombuffer(r[9], np.uint64) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def connected_components(edges: DataFrame, tables: Tables, name: str = "cc") -> DataFrame:
    """(node, component) of every node of the edges (a, b); component: its smallest node.

    Alternating large-star and small-star (Kiveris et al. 2014) until no edge changes.  Minima are aggregated before
    the shuffle, so a node with a third of all edges costs its task one row for each other task.
    """
    ends = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    now = tables.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-edges")
    before = ends(now)
    turn = 0
    while before["n"]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tables.write(large, f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        turn += 1
        now = tables.write(small.select("e.u", "e.v").where("u <> v").distinct(), f"{name}-{turn}")
        tables.drop(f"{name}-edges", f"{name}-{turn - 1}", f"{name}-large")
        after = ends(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


class NearDedup:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, bands: int, rows: int):
        self.docs, self.size, self.percent, self.bands, self.rows = texts(docs, id_col, text_col), size, percent, bands, rows
        self.tables = Tables(docs.sparkSession)

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """Shingle sets of representatives, written.  Where an id has several texts, the one of its class."""
        found = self.docs.join(self.reps.select("doc_id", "fp").join(ids, "doc_id", "left_semi"), "doc_id").select("doc_id", "fp", "text")
        return self.tables.write(found.mapInArrow(_sets(self.size), "doc_id long, shingles binary"), name, "none")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the distinct pairs (a, b) that are links, by signature and then by full sets; written."""
        sig, t = self.reps.select("doc_id", "sig"), self.tables
        near = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
        near = t.write(near.select("a", "b", "sig_a", "sig_b").mapInArrow(_alike(self.bands * self.rows, self.percent / 100), "a long, b long"), f"{name}-near")
        ids = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
        sets = self.sets(ids, f"{name}-sets")
        parts = near.groupBy("a").agg(F.ceil(F.count("*") / 1000).cast("int").alias("parts"))
        members = near.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
        members = members.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "shingles")
        leads = parts.join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
        rows = leads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        out = t.write(rows.select("a", "b", "shingles").mapInArrow(_confirm(self.percent), "a long, b long"), f"{name}-links")
        t.drop(f"{name}-near", f"{name}-sets")
        return out

    def crossing(self, members: DataFrame, parts: DataFrame) -> DataFrame:
        """Links (a, b) between different components that share a bucket; enough of them to join what belongs together.

        Documents of a bucket meet by signatures first, and only those with a pair to be confirmed meet again with
        their sets.  A bucket of over BLOCK documents is dealt out by pairs of blocks, each in a task of its own.  A
        pair is looked at in the first bucket that it shares.
        """
        t = self.tables
        own = F.coalesce("component", "doc_id").alias("component")
        placed = members.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", own)
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("k")).where("lo < hi").select("bucket", "k")
        dealt = placed.join(mixed, "bucket").select("bucket", "doc_id", "component", "k", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int").alias("block"))
        dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")).select("bucket", F.least("block", "j").alias("x"), F.greatest("block", "j").alias("y"), "doc_id", "component", "block")
        dealt = t.write(dealt.join(self.reps.select("doc_id", "n", "bands", "sig"), "doc_id").select(*PLACE), "mixed")
        in_groups = lambda d: d.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "doc_id")
        chosen = t.write(in_groups(dealt).mapInArrow(_candidates(self.percent, self.bands * self.rows), "bucket long, x int, y int, doc_id long"), "chosen")
        if chosen.isEmpty():
            return chosen.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
        sets = self.sets(chosen.select("doc_id").distinct(), "chosen-sets")
        full = dealt.join(chosen, ["bucket", "x", "y", "doc_id"]).join(sets, "doc_id").select(*PLACE, "shingles")
        out = t.write(in_groups(full).mapInArrow(_across(self.percent, self.bands * self.rows), "a long, b long"), "crossing")
        t.drop("mixed", "chosen", "chosen-sets")
        return out

    def run(self) -> DataFrame:
        t = self.tables
        features = t.write(self.docs.mapInArrow(_features(self.size, self.bands, self.rows), "doc_id long, n long, fp binary, bands array<bigint>, sig binary"), "features")
        known = features.where("n > 0 and doc_id is not null")
        first = known.groupBy("fp").agg(F.min_by(F.struct("doc_id", "n", "bands", "sig"), "doc_id").alias("r"))
        # an id with several texts may lead several classes: it stands for one of them, and links the others by its id
        lead = first.select("fp", "r.doc_id", "r.n", "r.bands", "r.sig").groupBy("doc_id").agg(F.min_by(F.struct("fp", "n", "bands", "sig"), "fp").alias("r"))
        self.reps = t.write(lead.select("r.fp", "doc_id", "r.n", "r.bands", "r.sig"), "reps")
        keys = self.reps.select(F.explode("bands").alias("bucket"), "doc_id")
        leads = keys.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("doc_id").alias("lead")).where("rows > 1").select("bucket", "lead")
        members = t.write(keys.join(leads, "bucket").select("bucket", "doc_id", "lead"), "members")
        stars = t.write(members.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
        links = self.confirmed(stars, "star")
        parts = connected_components(links, t, "first")
        more = self.crossing(members, parts)
        if not more.isEmpty():
            every = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
            parts = connected_components(every, t, "second")
        t.drop("members", "stars", "star-links", "crossing")
        classes = known.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        classes = classes.select("fp", F.coalesce("component", "doc_id").alias("component_id"))
        linked = known.select("doc_id", "n", "fp").join(classes, "fp").select("doc_id", "n", "component_id")
        alone = features.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts without words, null texts and rows with a null id link with nothing: each is its own component (a null id
    stays null) and is kept.  Rows that repeat an id are one document: they share a component id, and all of the
    smallest are kept.  An empty table gives an empty result; extra columns are ignored.
    """
    return NearDedup(docs, id_col, text_col, shingle, percent, bands, rows).run()
