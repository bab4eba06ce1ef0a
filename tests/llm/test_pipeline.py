import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline
import sentencepiece
from sparklore.llm.common import stored, table
from sparklore.llm.decontaminate import fold
from sparklore.llm.queries import _tokenizer
from sparklore.llm.quality import quality_scores
from sparklore.llm.toxicity import toxicity_scores

from .test_simhash import brute_groups, brute_print


def test_stages_act_on_what_the_one_before_kept(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = [fold(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs, stored(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        texts = {r.doc_id: r.text for r in before.collect()}
        ids = [r.doc_id for r in out.collect()]
        assert len(set(ids)) == len(ids) and all(r.text == texts[r.doc_id] for r in out.collect())
        if name == "quality":
            want = {r.doc_id for r in quality_scores(before, labels).collect() if r.predicted}
        elif name == "toxicity":
            want = {r.doc_id for r in toxicity_scores(before, labels).collect() if not r.predicted}
        elif name == "near_duplicates":
            want = {d for d, _, c in brute_groups([(d, brute_print(t)) for d, t in texts.items()]) if d == c}
        else:
            want = {d for d, t in texts.items() if not any(m in fold(t) for m in marks)}
        assert set(ids) == want and 0 < len(want) < len(texts)
        kept[name], docs = want, out
    library = sentencepiece.SentencePieceProcessor(model_file=_tokenizer("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    last = {r.doc_id: r.ids for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert last == {d: library.encode(t) for d, t in texts.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()} == last


def test_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_odd_rows_and_names(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, ties and columns with the stages' own names."""
    some = table(spark, sf_dir, "documents").where("doc_id < 60").select("doc_id", "text")
    odd = [(None, "A null id, and words enough to be a document of its own."), (1000, None), (1001, ""), (1002, " \n "), (1003, "Fine words and more of them. " * 20_000), (1004, "One of two."), (1004, "One of two."), (1004, "Another text with the same id.")]
    named = ["'q' as quality", "1 as toxicity", "2 as simhash", "cast(null as int) as least", "array(1) as ids", "0.5 as score", "'f' as Fingerprint", "doc_id as id", "3 as y"]
    docs = stored(some.union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", *named), "odd")
    rows = lambda df: sorted(map(repr, df.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns and set(rows(out)) <= set(rows(docs))
        if name == "near_duplicates":
            assert sum(not (r.text or "").split() for r in out.collect()) == 1 and out.where("doc_id = 1004 and text = 'One of two.'").count() == 1
            assert out.where("doc_id is null").count() == 1
        elif name in ("toxicity", "decontamination"):
            assert out.where("doc_id >= 1000").count() == 7
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and {len(r.ids) for r in last.where("doc_id in (1000, 1001)").collect()} == {0}
