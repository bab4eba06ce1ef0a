import random

import pytest
from sparklore.llm.decontaminate import Matcher, contaminated, fold, myers, without_contaminated
from sparklore.llm.queries import op1_decontaminate

LETTERS = "ab c"


def distance(pattern, text):
    """Least edits of ``pattern`` against any stretch of ``text``, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", rng.choice(LETTERS), text[at] + rng.choice(LETTERS)]) + text[at + 1 :]
    return text


def test_myers():
    rng = random.Random(1)
    for _ in range(400):
        p, t = ("".join(rng.choices(LETTERS, k=rng.randint(1, n))) for n in (70, 90))
        best = myers(p, t, len(p))
        assert best[0] == distance(p, t)
        assert distance(p, t[: best[1]]) == best[0] and myers(p, t, best[0] - 1) is None


def test_matches_against_brute_force():
    rng = random.Random(2)
    letters = "abcdefghij klmno"
    items = [(i, "".join(rng.choices(letters, k=rng.randint(1, 120)))) for i in range(12)]
    items = [(i, fold(t)) for i, t in items if fold(t)]
    matcher, hits = Matcher(items, 0.1), 0
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(items)[1]
            parts.append(edited(rng, t, rng.randint(0, len(t) // 8)))
            parts.append("".join(rng.choices(letters, k=rng.randint(0, 60))))
        text = fold(" ".join(parts))
        got = {m[0] for m in matcher.matches(text)}
        assert got == {i for i, t in items if distance(t, text) <= len(t) // 10}
        for i, d, a, b in matcher.matches(text):
            assert distance(dict(items)[i], text[a:b]) == d
        hits += len(got)
    assert hits > 50


@pytest.fixture
def tables(spark):
    item = "Whoever reads this passage again, knows the answer to question nineteen by heart."
    docs = [(1, f"Before. {item} After.", "x"), (2, None, "x"), (3, "", "x"), (4, item.upper().replace(" ", "\n "), None), (5, item.replace("answer", "answrs"), "x"), (6, "Whoever reads this passage.", "x"), (7, "w " * 50_000 + item, "x"), (1, f"Before. {item} After.", "x"), (None, item, "x")]
    marks = [(9, item, "n"), (9, item, "m"), (10, None, "n"), (11, "", "n"), (12, " ?! ", "n"), (None, "Another passage, of no document at all.", "n")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(marks, "item_id long, text string, doc_id string")


def test_edges(tables):
    docs, marks = tables
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in contaminated(docs, marks).collect()), key=str)
    assert got == sorted([(1, 9, 0), (1, 9, 0), (4, 9, 0), (5, 9, 2), (7, 9, 0), (None, 9, 0)], key=str)
    kept = without_contaminated(docs, marks)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 6]
    assert contaminated(docs.limit(0), marks).count() == 0 and contaminated(docs, marks.limit(0)).count() == 0
    assert without_contaminated(docs, marks.limit(0)).count() == 9


def test_many_blocks(tables, monkeypatch):
    docs, marks = tables
    monkeypatch.setattr("sparklore.llm.decontaminate.blocks.__defaults__", (60,))
    assert contaminated(docs, marks).count() == 6 and without_contaminated(docs, marks).count() == 3


def test_whole_table_has_every_verbatim_passage(spark, sf_dir):
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    exact = {(d.doc_id, m.item_id) for d in docs for m in marks if fold(m.text) in fold(d.text)}
    got = op1_decontaminate(spark, sf_dir).collect()
    assert exact and {(r.doc_id, r.item_id) for r in got if r.distance == 0} == exact
