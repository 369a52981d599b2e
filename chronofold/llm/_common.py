"""Shared helpers: the cluster's shared folder, written intermediate tables, word rules."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here, as a regex class and as characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_roots: dict[str, str] = {}
_live: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a local one of our own only where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = "file://" + tempfile.mkdtemp(prefix="chronofold-")
        spark.conf.set("spark.checkpoint.dir", given)
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{given.rstrip('/')}/chronofold-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):
        remove(spark, root)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM, on the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = hadoop(spark, path)
        fs.delete(p, True)
        _live.discard(path)


def live() -> set[str]:
    """Paths of all written tables that are still there."""
    return set(_live)


#: For jobs whose output is a written table: shuffle files go when the job ends, and rows with long texts or packed
#: keys reach Python in small batches.
_JOB = {_CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def job_settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _JOB}
    for k, v in _JOB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Bytes of text (or ids) of one partition where an operator deals rows, and the most partitions of one exchange.
PART = 64 << 20
MOST = 1 << 16


def parts_for(spark: SparkSession, size: int) -> int | None:
    """Partitions of about PART bytes each, or None where the session's own number of them holds no more than that."""
    n = min(-(-size // PART), MOST)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, parts: int | None, *by, ranges: bool = False) -> DataFrame:
    """Repartitioned by these columns, by hash or range; without a number the session's, which the engine may adapt."""
    how = df.repartitionByRange if ranges else df.repartition
    return how(parts, *by) if parts else how(*by)


class Tables:
    """Written intermediate tables.  They cut lineage, survive lost executors, and go once they are superseded."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}
        self.parts: int | None = None

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = new_path(self.spark, name)
        with job_settings(self.spark):
            df.write.option("compression", codec).parquet(path)
        self.drop(name)
        self.paths[name] = path
        _live.add(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                remove(self.spark, path)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) and nothing else, so extra columns can't clash; a null text stays null."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def carried(keep: tuple[str, ...]) -> list:
    """Columns that an operator carries along: one struct, out of reach of its own names; nothing for no columns."""
    return [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row")] if keep else []


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about `most` bytes in the column; one that has more stays as it is."""
    held, size = [], 0
    for b in batches:
        n = b[column].nbytes
        if held and size + n > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Memo(dict):
    """A dict with two generations: when `most` entries are new, the older ones go, but for those used again."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def room(self, new: int) -> None:
        """Call before adding `new` entries."""
        if len(self) + new > self.most:
            self.old = dict(self)
            self.clear()

    def known(self, key) -> bool:
        """Is the key here?  An older entry moves to the new generation."""
        if key in self:
            return True
        if key in self.old:
            self[key] = self.old[key]
            return True
        return False
