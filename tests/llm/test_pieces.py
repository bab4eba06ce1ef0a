import itertools
import random

import duckdb
import pytest
import sentencepiece
from sparklore.llm.pieces import Pieces, decode, encode, round_trip
from sparklore.llm.queries import _tokenizer, op9_sentencepiece

MODEL = _tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(blob):
    return [int.from_bytes(blob[i : i + 4], "little") for i in range(0, len(blob), 4)]


def test_same_as_the_library(library, sf_dir):
    rng = random.Random(3)
    texts = [t for (t,) in duckdb.sql(f"select text from '{sf_dir}/documents.parquet'").fetchall()][:60]
    letters = "aaeeiothns tr  .,éßñ漢字🙂\n\t▁\x00İ'-0123THE"
    texts += ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(600)]
    texts += ["", " ", "   ", "internationalization " * 3, "a" * 3000, "the" * 500]
    pieces = Pieces.load(MODEL)
    for text, blob in zip(texts, pieces.encode(texts)):
        assert ids(blob) == library.encode(text), text
        assert pieces.decode(ids(blob)) == library.decode(ids(blob))


def test_cut_texts_and_forgotten_words(library, monkeypatch):
    """Texts of what may or may not be cut apart, with a cache that forgets all the time."""
    from sparklore.llm import pieces as P

    monkeypatch.setattr(P, "REMEMBERED", 20)
    monkeypatch.setattr(P, "PAIRS", 20)
    rng = random.Random(8)
    parts = ["the", "ing", " ", ",", ".\n", "1", "2.", "².", " ▁", "..", "://", "www.", "(s)", "it's", "C++", "_x", "½", "é", "THE", "\x00", "Ⅻ", "漢"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(2000)]
    pieces = Pieces.load(MODEL)
    assert pieces.cut("▁ab,\n▁▁c.5 ▁(s)") == ["▁ab", ",\n", "▁▁c", ".5 ", "▁(s)"]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        assert [ids(b) for b in pieces.encode(some)] == library.encode(some)


def test_unigram_scores_against_all_cuts():
    rng = random.Random(5)
    names = {"".join(rng.choices("▁ab", k=rng.randint(1, 4))) for _ in range(30)} | {"a", "▁"}
    names = {n for n in names if "▁" not in n.lstrip("▁")}
    texts = {n: (i, -rng.random() * len(n)) for i, n in enumerate(sorted(names))}
    pieces = Pieces(texts, [0] * 256, 999, False, [])
    for _ in range(200):
        word = "▁" + "".join(rng.choices("abc", k=rng.randint(0, 7)))
        cuts = [[word[i:j] for i, j in zip((0, *at), (*at, len(word)))] for n in range(len(word)) for at in itertools.combinations(range(1, len(word)), n)]
        score = lambda cut: sum(texts[p][1] if p in texts else pieces.least for p in cut)
        best = max(score(c) for c in cuts if all(p in texts or len(p) == 1 for p in c))
        ((_, got),) = pieces._forward([word])
        assert "".join(got) == word and abs(score(got) - best) < 1e-9


def test_edges(spark, library):
    rows = [(1, "Hello  world", "x", 5), (2, None, "x", 5), (3, "", None, 5), (None, "tab\tx", "x", None), (1, "Hello  world", "x", 5), (4, "w▁v", "x", 5), (5, "word " * 30_000, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded_ string, n_tokens int")
    got = {str(r.doc_id): r for r in round_trip(docs, MODEL).collect()}
    for i, text, *_ in rows:
        assert got[str(i)].ids == library.encode(text or "") and got[str(i)].exact == ("▁" not in (text or ""))
    assert round_trip(docs, MODEL).count() == 7 and round_trip(docs.limit(0), MODEL).count() == 0
    assert encode(docs, MODEL).columns == [*docs.columns, "ids"]
    bare = spark.createDataFrame([(None,), ([],), ([0, 99999, -1, 15043],)], "ids array<int>")
    assert [r.decoded for r in decode(bare, MODEL).collect()] == [None, "", library.decode([0, 15043])]


def test_whole_table(spark, sf_dir, library):
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())
    got = op9_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(texts) and all(r.exact and r.ids == library.encode(texts[r.doc_id]) for r in got)
