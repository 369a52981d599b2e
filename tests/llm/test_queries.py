"""Every opN query on the smallest tables: against its SQL, a library or a brute-force version."""

import hashlib
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute as B  # noqa: E402

from chronofold.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r.text for r in Q.table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(Q.SQL[name])
    names = [d[0] for d in want.description]
    got = Q.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_quality(spark, rows):
    got = Q.op1_quality_rules(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == B.base_statistics(rows[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_secrets(spark, rows):
    for r in Q.op4_secret_scan(spark, SF).collect():
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, B.base_spans(rows[r.doc_id]))) and r.base_sha256 == B.sha(B.base_listing(rows[r.doc_id]))


def test_suffixes(spark, rows):
    want = B.byte_repeats(list(rows.items()))
    for r in Q.op5_suffix_dedup(spark, SF).collect():
        body, mask = want[r.doc_id]
        runs = sum(m and not (k and mask[k - 1]) for k, m in enumerate(mask))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(body), sum(mask), runs, B.sha(bytes(c for c, m in zip(body, mask) if not m)))


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tok, found = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json")), {}
    for r in sorted(Q.op6_packing(spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        if r.doc_id not in found:
            found[r.doc_id] = [*tok.encode(rows[r.doc_id] or "", add_special_tokens=False).ids, 2]
        ids = found[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(found[r.doc_id]) and len(ids) == r.length and r.ids_crc32 == B.crc(ids)
    assert set(found) == set(rows)


def test_sentencepiece(spark, rows):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))
    for r in Q.op8_sentencepiece(spark, SF).collect():
        ids = m.encode(rows[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), B.sha(",".join(map(str, ids))), B.sha(m.decode(ids)))


def test_archives_read_as_gzip_members(spark):
    """Archives by Python's own gzip: a warcinfo first, and each revisit names a response that is there."""
    from pyarrow import fs

    from chronofold.llm import warc

    folder, index = warc.write_warc(Q.table(spark, SF, "pages"))
    store, path = fs.FileSystem.from_uri(folder)
    ids, wanted = set(), set()
    for name in {r.file for r in index.select("file").distinct().collect()}:
        data, first = store.open_input_file(f"{path}/{name}").readall(), True
        while data:
            unpack = zlib.decompressobj(31)
            head, block = warc.parse(unpack.decompress(data) + unpack.flush())
            data = unpack.unused_data
            assert (head["WARC-Type"] == "warcinfo") == first
            first = False
            if head["WARC-Type"] == "response":
                ids.add(head["WARC-Record-ID"])
                payload = block.partition(b"\r\n\r\n")[2]
                assert head["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
            elif "WARC-Refers-To" in head:
                wanted.add(head["WARC-Refers-To"])
    assert wanted <= ids


def test_shards_keep_their_columns(spark):
    from chronofold.llm import sharding
    from chronofold.llm._common import new_path

    t = sharding.ShardedTable(spark, new_path(spark, "columns"))
    t.append(spark.range(3).selectExpr("id", "string(id) as name"))
    t.append(spark.range(2).selectExpr("string(id) as name", "id"))
    assert t.read().columns == ["id", "name"] and t.read().count() == 5
    for bad in (spark.range(1).selectExpr("id", "id as name"), spark.range(1).selectExpr("id", "string(id) as name", "1 as more"), spark.range(1)):
        with pytest.raises(ValueError):
            t.append(bad)
