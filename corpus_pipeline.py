"""Corpus pipeline: quality rules, exact dedup, MinHash near-dedup, secret scans, packing.

Each stage takes what its predecessor kept; run() writes every stage's rows as Parquet in the shared folder and reads
them again, so no stage is computed twice and a lost executor costs one stage's tasks at most.  Rows are settled one by
one: null and repeated ids stay what they are, a null text counts as empty, rows that repeat a text go in the exact
stage, an empty table gives no pieces, and columns beyond those of documents are dropped by the first stage; missing
lang, source or n_chars come out as null.

A stage's docs are its predecessor's rows, written and read again; so what the stages before it wrote on their way for
the same sf_dir goes as a stage begins, and run() drops it as soon as the stage is written.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import exact_dedup, minhash, packing, quality_rules, secret_scan
from chronofold.llm._common import Tables, live, remove
from chronofold.llm.queries import table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KINDS = ("long", "string", "string", "string", "long")


#: Tables that a stage wrote on its way and its result still reads, by (application, sf_dir, stage).
_left: dict[tuple[str, str, str], set[str]] = {}


def _drop(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for name in names:
        remove(spark, *_left.pop((spark.sparkContext.applicationId, sf_dir, name), ()))


def _staged(name: str, stage, earlier: list[str]):
    """The stage, which first drops what the earlier ones left and then notes its own."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _drop(spark, sf_dir, earlier)
        before = live()
        out = stage(spark, docs, sf_dir)
        _left.setdefault((spark.sparkContext.applicationId, sf_dir, name), set()).update(live() - before)
        return out

    return run_stage


def _kept(verdicts: DataFrame) -> DataFrame:
    """The rows that a verdict keeps, each by its own: ids may be null or repeated."""
    return verdicts.where("kept").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    docs = docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in zip(COLUMNS, KINDS)])
    return _kept(quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"), keep=COLUMNS))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _kept(exact_dedup.exact_dedup(docs, keep=COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, by five-word shingles.

    Rows that repeat an id are compared like any others: near_dedup takes row numbers, written once and in the order of
    the ids, so the smallest id of a component stays.  Where the id is null, so is the number: near_dedup keeps these.
    """
    order = ("doc_id", F.xxhash64("text"))
    rows = docs.select(*COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    rows = Tables(spark).write(rows, "numbered").withColumn("number", F.when(F.col("doc_id").isNotNull(), F.col("number")))
    out = minhash.near_dedup(rows, id_col="number", shingle=5).where("not kept").select(F.col("doc_id").alias("number"))
    return rows.join(out, "number", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced by a mark."""
    d = secret_scan.scan(docs.select(*COLUMNS), keep=("lang", "source", "n_chars"))
    clean = secret_scan.redacted(F.col("text"), F.col("spans"))
    return d.select("doc_id", clean.alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.length(clean).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


_PLAIN = [("quality_rules", quality), ("exact_dedup", exact), ("minhash_dedup", near), ("secret_scan", secrets), ("packing", packed)]
STAGES = [(name, _staged(name, stage, [n for n, _ in _PLAIN[:k]])) for k, (name, stage) in enumerate(_PLAIN)]

#: SQL cannot express learned rules, MinHash components or tokenizer packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs = Tables(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir), name)
        _drop(spark, sf_dir, [name])
        if k:
            tables.drop(STAGES[k - 1][0])
    return docs
