import zlib

import numpy as np
import pytest
from sparklore.llm.queries import _tokenizer, op2_token_orc
from sparklore.llm.token_orc import ChunkEncoder, ids_crc32, read_token_orc, write_token_orc


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_tokenizer("word_bpe_49k.json"))
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op2_token_orc(spark, sf_dir).collect())
    assert got == expected(sorted((r.doc_id, r.text) for r in docs))


@pytest.mark.parametrize("n", [1, 3])
def test_edges(spark, tmp_path, n):
    rows = [(5, "a  b c\n\tÉté ΑΣ \x01 x\x01y <|endoftext|>", "s"), (2, None, "s"), (9, "", None), (7, "İ ’tis ǅ é word" * 900, "s"), (-4, " ", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    write_token_orc(docs, str(tmp_path / "o"), _tokenizer("word_bpe_49k.json"), partitions=n)
    got = sorted(tuple(r) for r in ids_crc32(read_token_orc(spark, str(tmp_path / "o"))).collect())
    assert got == expected(sorted((r[0], r[1]) for r in rows))


def test_null_ids_repeats_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(None, "x"), (1, "same"), (1, "same"), (1, "other")], "doc_id long, text string")
    write_token_orc(docs, str(tmp_path / "a"), _tokenizer("word_bpe_49k.json"))
    got = ids_crc32(read_token_orc(spark, str(tmp_path / "a"))).collect()
    assert sorted(r.start for r in got) == [0, 2, 4, 6] and [r.start for r in got if r.doc_id is None] == [0]
    write_token_orc(docs.limit(0), str(tmp_path / "b"), _tokenizer("word_bpe_49k.json"))
    assert ids_crc32(read_token_orc(spark, str(tmp_path / "b"))).count() == 0


def test_id_filter_is_pushed(spark, tmp_path):
    write_token_orc(spark.range(50).selectExpr("id doc_id", "'t' text"), str(tmp_path / "p"), _tokenizer("word_bpe_49k.json"))
    plan = read_token_orc(spark, str(tmp_path / "p")).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path, texts = _tokenizer("byte_bpe_50k.json"), ["Two  words", "", " x\n\ny<|endoftext|>"]
    encoder = ChunkEncoder(path)
    counts, ids = encoder.encode(texts)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert not encoder.by_chunks and counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_forgetting_changes_nothing(monkeypatch):
    from sparklore.llm import token_orc

    texts = [f"w{i}x Word{chr(97 + i % 26)}{chr(97 + i // 26)}, end.\nnext {chr(97 + i % 7)}" for i in range(300)]
    counts, ids = ChunkEncoder(_tokenizer("word_bpe_49k.json")).encode(texts)
    monkeypatch.setattr(token_orc, "CACHED", 10)
    small = ChunkEncoder(_tokenizer("word_bpe_49k.json"))
    parts = [small.encode(texts[i : i + 7]) for i in range(0, 300, 7)]
    assert np.concatenate([p[0] for p in parts]).tolist() == counts.tolist() and np.concatenate([p[1] for p in parts]).tolist() == ids.tolist()


def test_written_form_and_skipped_rows(spark, tmp_path):
    """Run-length encoded ids, a row index and a Bloom filter on the id; a filter reads one stride of one stripe."""
    rows = spark.range(20_000).selectExpr("id * 2 doc_id", "'some text' text")
    write_token_orc(rows, str(tmp_path / "p"), _tokenizer("word_bpe_49k.json"), partitions=2, stripe_bytes=20_000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    (part, *_) = sorted((tmp_path / "p").glob("part-*.orc"))
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(part)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    stripes = reader.getStripes()
    footer = reader.rows().readStripeFooter(stripes.get(0))
    kinds = {(footer.getStreams(i).getColumn(), footer.getStreams(i).getKind().toString()) for i in range(footer.getStreamsCount())}
    names = [c for c in ("doc_id", "ids")]
    column = {n: reader.getSchema().findSubtype(n).getId() for n in names}
    assert (column["doc_id"], "BLOOM_FILTER_UTF8") in kinds and (column["doc_id"], "ROW_INDEX") in kinds and reader.getRowIndexStride() == 1000
    assert footer.getColumns(column["ids"] + 1).getKind().toString() == "DIRECT_V2"  # the array's items: integer run-length encoding
    assert not [k for c, k in kinds if c == column["ids"] and k == "BLOOM_FILTER_UTF8"]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for wanted, most, found in ((30, 1000, 1), (31, 1000, 0), (10**9, 0, 0)):
            df = spark.read.orc(str(tmp_path / "p")).where(f"doc_id = {wanted}").select("doc_id")
            assert len(df.collect()) == found
            scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
            assert scan.metrics().get("numOutputRows").get().value() <= most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
