import random

import public_tokenizers
import sentencepiece
from sparklore.llm.queries import op12_token_counts
from sparklore.llm.token_counts import WholeTokens, proved_strings, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, n_whole int"


def library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return [len(sp.encode(t or "")) for t in texts]


def test_proof_covers_the_vocabulary_and_names_only_single_tokens():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    proved = proved_strings(MODEL)
    assert {"▁the", "ing", "▁"} <= proved and "<s>" not in proved and "<0x0A>" not in proved
    for s in sorted(proved)[:3000]:
        if s.startswith("▁"):  # the library puts this mark itself
            assert len(sp.encode(s[1:])) == (1 if s != "▁" else 0), s


def test_odd_texts_count_as_the_library_counts_them():
    rng = random.Random(4)
    parts = ["the", "Haus", " ", "  ", "▁", "\n", "\t", "é", "é", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "\x01", "😀", "字", "1", "23", "²", "...", "?!", "_", "-", "ſ", " ", "​", "don't", "straße", "zzzzqqq", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)]
    texts += [" " * 5000, "x" * 20000, "word " * 20000, "ab▁" * 300, "字" * 5000]
    model = WholeTokens(MODEL)
    for at in range(0, len(texts), 700):
        tokens, whole = model.count(texts[at : at + 700])
        assert tokens == library(texts[at : at + 700])
        assert all(0 <= w <= n for w, n in zip(whole, tokens))
    assert all(len(w) <= 200 for w in model.words.recent)


def test_edges(spark):
    long = "word " * 5000
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "two words"), (4, long), (5, "<s> and </s>"), (6, " ".join(["and"] * 4096)), (7, " ".join(["and"] * 4097))]
    got = token_counts(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), MODEL)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"]
    want = [(i, len((t or "").encode()), n, n > 4096) for (i, t), n in zip(rows, library([t for _, t in rows]))]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted(want, key=str)
    assert want[-2][2:] == (4096, False) and want[-1][2:] == (4097, True)
    assert token_counts(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op12_token_counts(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    assert [got[i].n_tokens for i in sorted(texts)] == library([texts[i] for i in sorted(texts)])
    assert 0 < sum(r.n_whole for r in got.values()) < sum(r.n_tokens for r in got.values())
