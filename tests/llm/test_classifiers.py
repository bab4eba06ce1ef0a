import zlib

import numpy as np
import pytest
from sparklore.llm.quality import class_prior, estimated_prior, features, fit, good_only, quality_scores, risk
from sparklore.llm.queries import op5_quality, op6_toxicity
from sparklore.llm.toxicity import Bags, clean_only, sentences, toxicity_scores, train

SCHEMA = "doc_id long, text string, score string, predicted string"


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.mark.parametrize(("query", "label", "cut", "least"), [(op5_quality, "quality", 0.7, 0.95), (op6_toxicity, "toxic", 0.3, 0.9)])
def test_held_out_accuracy(spark, query, label, cut, least):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = query(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == held_out(r.doc_id) for r in rows)
    judged = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert len(judged) > 50 and np.mean(judged) >= least


def test_prior_and_risk_on_a_known_mixture():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, size=(3000, 5)), rng.normal(-1.5, 1, size=(3000, 5))
    mixed = np.concatenate([good[1500:2700], bad[:800]])
    assert abs(class_prior(good[:1500, 0], mixed[:, 0]) - 0.6) < 0.1
    assert abs(estimated_prior(good[:1500], mixed, 24, 0) - 0.6) < 0.1
    net, _ = fit(good[:1500], mixed)
    assert (net.score(good[2700:]) >= 0.5).mean() > 0.97 and (net.score(bad[800:]) < 0.5).mean() > 0.97


def numeric(f, x, step=1e-5):
    return np.array([(f(x + step * e) - f(x - step * e)) / (2 * step) for e in np.eye(len(x))])


def test_quality_risk_and_its_gradient():
    """The risk by its definition, one document at a time, and its slope against small steps."""
    rng = np.random.default_rng(4)
    sigmoid = lambda t: 1 / (1 + np.exp(-t))
    for shift, prior, clipped in ((-1.0, 0.3, False), (0.0, 0.4, False), (3.0, 0.95, True)):
        p, u = rng.normal(shift, 1, 7), rng.normal(0 if not clipped else -3, 1, 11)
        good = sum(-np.log(sigmoid(x)) for x in p) / 7
        bad_p, bad_u = sum(-np.log(1 - sigmoid(x)) for x in p) / 7, sum(-np.log(1 - sigmoid(x)) for x in u) / 11
        value, slope = risk(p, u, prior)
        assert abs(value - (prior * good + max(0, bad_u - prior * bad_p))) < 1e-9 and (bad_u < prior * bad_p) == clipped
        both = np.concatenate([p, u])
        if not clipped:
            assert np.allclose(slope, numeric(lambda x: risk(x[:7], x[7:], prior)[0], both), atol=1e-6)
        else:  # the negatives' part is stepped back from
            part = lambda x: np.logaddexp(0, x[7:]).mean() - prior * np.logaddexp(0, x[:7]).mean()
            assert np.allclose(slope, -numeric(part, both), atol=1e-6)


def test_toxicity_likelihood_and_its_gradient():
    """The noisy-or likelihood sentence by sentence, and its slope against small steps."""
    from sparklore.llm.toxicity import CLEAN, WRONG

    rng = np.random.default_rng(2)
    documents = [(int(rng.integers(2)), [sorted(set(rng.integers(0, 5, rng.integers(1, 4)).tolist())) for _ in range(rng.integers(0, 4))]) for _ in range(30)]
    w, bags = rng.normal(6, 3, 5), Bags(documents, 5)
    total = 0.005 * (w * w).sum()
    for y, sentences_ in documents:
        clean = np.prod([1 - 1 / (1 + np.exp(-(CLEAN + sum(w[f] for f in s)))) for s in sentences_])
        p = WRONG + (1 - 2 * WRONG) * (1 - clean)
        total -= np.log(p if y else 1 - p)
    assert abs(bags.loss(w)[0] - total) < 1e-6
    assert np.allclose(bags.loss(w)[1], numeric(lambda x: bags.loss(x)[0], w), atol=1e-4)


def tables(spark, sf_dir):
    return (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))


def test_every_quality_score_is_that_of_the_fitted_network(spark, sf_dir):
    """The query's whole result against the network's units summed one by one."""
    from sparklore.llm import quality

    docs, labels = tables(spark, sf_dir)
    net, _ = quality.train(docs, labels)
    w, b, v, c = (p.tolist() for p in net.p)
    want = {}
    for r in docs.collect():
        x = [max(-6.0, min(6.0, (a - m) / s)) for a, m, s in zip(features(r.text or "").tolist(), net.mean.tolist(), net.scale.tolist())]
        units = [np.tanh(b[k] + sum(x[i] * w[i][k] for i in range(len(x)))) for k in range(len(b))]
        want[r.doc_id] = 1 / (1 + np.exp(-(c[0] + sum(h * a for h, a in zip(units, v)))))
    got = {r.doc_id: r for r in op5_quality(spark, sf_dir).collect()}
    assert set(got) == set(want)
    assert all(abs(got[i].score - want[i]) < 1e-6 and got[i].predicted == int(got[i].score >= 0.7) for i in want)


def test_every_toxicity_score_is_the_noisy_or_of_its_sentences(spark, sf_dir):
    """The query's whole result against products over sentences, from the fitted weights."""
    from sparklore.llm.toxicity import CLEAN, word_features

    docs, labels = tables(spark, sf_dir)
    weights = train(docs, labels).weights
    got = {r.doc_id: r for r in op6_toxicity(spark, sf_dir).collect()}
    rows = docs.collect()
    assert weights and len(got) == len(rows)
    for r in rows:
        clean, spans = 1.0, []
        for start, end, words in sentences(r.text or ""):
            z = sum(weights.get(f, 0.0) for w in words for f in word_features(w))
            if z:
                p = 1 / (1 + np.exp(-max(-40.0, min(40.0, CLEAN + z))))
                clean *= 1 - p
                spans += [(start, end)] if p >= 0.5 else []
        assert abs(got[r.doc_id].score - (1 - clean)) < 1e-6 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
        assert [(s.start, s.end) for s in got[r.doc_id].offending] == spans


def test_features_are_finite():
    for text in ["", " ", "\n\n", "\x00", "🙂" * 10, "w " * 100_000]:
        assert np.isfinite(features(text)).all()


@pytest.fixture
def world(spark):
    docs, labels = [], []
    for i in range(400):
        bad, toxic = i % 3 == 0, i % 5 == 0
        text = "A calm sentence about the weather and the sea. " * (i % 7 + 1) + f"It ends with number {i}."
        text = "$$$ ### !!! " * (i % 9 + 3) if bad else text
        docs.append((i, text + (" You vilewretch! Bye." if toxic else ""), "x", None))
        if i % 2:
            labels.append((i, int(not bad), int(toxic), "x"))
    docs += [(None, "No id. A vilewretch.", None, "x"), (1000, None, "x", "x"), (1001, "", "x", "x"), (1002, "Fine words. " * 20_000, "x", "x"), (2, docs[2][1], "x", None), (1003, " ?! ", "x", "x")]
    labels += [(None, 1, 1, "x"), (1002, None, None, "x")]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_quality_edges(world):
    docs, labels = world
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == 406 and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {True}
    kept = good_only(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 400} >= {i for i in range(400) if i % 3 and i % 5}
    assert not any(r.doc_id % 3 == 0 for r in kept.collect() if r.doc_id is not None and r.doc_id < 400)
    assert quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_where_all_or_none_are_labelled(spark, world):
    docs, labels = world
    numbered = docs.where("doc_id < 400")
    every = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    kept = [r.doc_id for r in good_only(numbered, every).collect()]
    assert {i for i in range(400) if i % 3 and i % 5} <= set(kept) and sum(i % 3 == 0 for i in kept) <= 13  # of 134
    for none in (labels.limit(0), every.where("quality = 0")):
        assert sorted(r.doc_id for r in good_only(numbered, none).collect()) == sorted(r.doc_id for r in numbered.collect())
        assert {(r.score, r.predicted) for r in quality_scores(numbered, none).collect()} == {(0.5, None)}


def test_toxicity_edges_and_sentences(world):
    docs, labels = world
    got = toxicity_scores(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == 406
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.predicted == ("vilewretch" in text), r
        assert all("vilewretch" in text[s.start : s.end] for s in r.offending) and bool(r.offending) == bool(r.predicted)
    kept = clean_only(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    assert train(docs, labels).weights == train(docs.repartition(3), labels.repartition(2)).weights


def test_names_that_clash_and_ids_that_repeat(world):
    docs, labels = world
    many = docs.unionByName(docs.where("doc_id = 1")).withColumnsRenamed({"score": "quality", "predicted": "Toxicity"})
    for f in (good_only, clean_only):
        kept = f(many, labels)
        assert kept.columns == many.columns and kept.where("doc_id = 1").count() in (0, 2)
    assert f(many.limit(0), labels).count() == 0


def test_sentences():
    assert sentences("A b. c!\n\n?D") == [(0, 3, ["a", "b"]), (4, 6, ["c"]), (10, 11, ["d"])]
