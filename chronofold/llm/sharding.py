"""Sharding [native]: size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards.  Shards whose sizes fall in one tier (powers of the fan-in)
form runs of like size; a tier with enough of them is merged into files of about the target size.  Every change is one
manifest version, written aside and renamed into place only if no such version exists, so readers see whole versions
and two writers can't both commit one.  Old shards stay until vacuum().
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ._common import hadoop, job_settings, remove


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    version: int


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, target: int = 64 << 20, fan_in: int = 4, smallest: int = 1 << 20):
        self.spark, self.root, self.target, self.fan_in, self.smallest = spark, root.rstrip("/"), target, fan_in, smallest

    # manifest
    def versions(self) -> list[int]:
        fs, p = hadoop(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        """(version, content) of the newest, or of the given version; version 0 is the empty table."""
        have = self.versions()
        at = version if version is not None else (have[-1] if have else 0)
        if at == 0:
            return 0, {"schema": None, "shards": []}
        fs, p = hadoop(self.spark, f"{self.root}/manifest/v{at:010d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return at, {"schema": found["schema"], "shards": [Shard(**s) for s in found["shards"]]}

    def _commit(self, version: int, schema: str | None, shards: list[Shard]) -> int:
        jvm, path = self.spark._jvm, f"{self.root}/manifest/v{version:010d}.json"
        fs, aside = hadoop(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(json.dumps({"schema": schema, "shards": [asdict(s) for s in shards]}).encode())
        finally:
            out.close()
        if fs.exists(jvm.org.apache.hadoop.fs.Path(path)):
            fs.delete(aside, False)
            raise CommitConflict(path)
        modes = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, jvm.org.apache.hadoop.fs.Path(path), modes)
        except Exception as e:
            fs.delete(aside, False)
            raise CommitConflict(path) from e
        return version

    def _write(self, df: DataFrame, version: int) -> list[Shard]:
        folder = f"{self.root}/shards/{version:010d}-{uuid.uuid4().hex[:8]}"
        with job_settings(self.spark):
            df.write.parquet(folder)
        fs, p = hadoop(self.spark, folder)
        found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
        return [Shard(path, n, version) for path, n in sorted(found)]

    # changes
    def append(self, df: DataFrame) -> int:
        """Add rows as new small shards; the new version.  A table without rows adds its schema only.

        Rows are kept as they are: nulls, empty and long texts, repeated rows, ties.  The first lot sets the columns;
        a later one must have the same names and types, in any order, else ValueError: no column is dropped or cast.
        """
        at, now = self.manifest()
        if now["schema"]:
            kinds = {f["name"]: f["type"] for f in json.loads(now["schema"])["fields"]}
            given = {f["name"]: f["type"] for f in json.loads(df.schema.json())["fields"]}
            if kinds != given or len(df.columns) != len(kinds):
                raise ValueError(f"columns of the table are {kinds}, not {given}")
            df = df.select(*[f"`{name}`" for name in kinds])
        return self._commit(at + 1, now["schema"] or df.schema.json(), now["shards"] + self._write(df, at + 1))

    def tier(self, shard: Shard) -> int:
        return 0 if shard.bytes <= self.smallest else int(math.log(shard.bytes / self.smallest, self.fan_in)) + 1

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Tiers below the target size that hold at least fan_in shards."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target // 2:
                tiers.setdefault(self.tier(s), []).append(s)
        return [t for _, t in sorted(tiers.items()) if len(t) >= self.fan_in]

    def compact(self) -> int:
        """Merge runs until no tier is full, one version for each round; the newest version."""
        while True:
            at, now = self.manifest()
            full = self.runs(now["shards"])
            if not full:
                return at
            merged, gone = [], set()
            for run in full:
                files = max(1, math.ceil(sum(s.bytes for s in run) / self.target))
                if files >= len(run):
                    files = max(1, len(run) // self.fan_in)
                merged += self._write(self._read(now["schema"], run).coalesce(files), at + 1)
                gone |= {s.path for s in run}
            self._commit(at + 1, now["schema"], [s for s in now["shards"] if s.path not in gone] + merged)

    def vacuum(self, keep_from: int | None = None) -> int:
        """Delete shard files that no version from `keep_from` (default: the newest) on names; how many went."""
        have = self.versions()
        first = keep_from if keep_from is not None else (have[-1] if have else 0)
        live = {s.path for v in have if v >= first for s in self.manifest(v)[1]["shards"]}
        dead = {s.path for v in have if v < first for s in self.manifest(v)[1]["shards"]} - live
        remove(self.spark, *dead, *[f"{self.root}/manifest/v{v:010d}.json" for v in have if v < first])
        return len(dead)

    # reads
    def _read(self, schema: str | None, shards: list[Shard]) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema)) if schema else StructType()
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards]) if shards else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)[1]
        return self._read(now["schema"], now["shards"])
