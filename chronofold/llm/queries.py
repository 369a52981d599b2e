"""The queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, minhash, packing, quality_rules, secret_scan, sentencepiece_codec, sharding, substring_dedup, suffix_dedup, warc
from ._common import new_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four lots, each appended; then one compaction; what the last manifest version holds."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardedTable(spark, new_path(spark, "sharded"), target=64 << 20)
    for lot in range(4):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == lot))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write_warc(table(spark, sf_dir, "pages"))
    out = warc.read_warc(spark, folder, index, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


SQL = {
    "op2_minhash_dedup": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM t),
             e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
             c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM c WHERE 100 * shared >= 80 * (x + y - shared)),
             d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
             m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
             g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM x),
             f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS turn FROM g) WHERE turn > 1),
             c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f),
             p AS (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d),
             a AS (SELECT p.doc_id, count(c.p) AS n_removed, string_agg(v, ' ' ORDER BY p.p) FILTER (WHERE c.p IS NULL) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id""",
    "op3_sharding": "SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS text_sha256, lang, source, n_chars FROM documents",
    "op9_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN payload_bytes < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
        FROM f""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
             g AS (SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g""",
}
