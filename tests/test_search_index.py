import random

from pyspark.sql import functions as F
from sparklore import schemas
from sparklore.operators import search
from sparklore.sources.search_index import SearchIndex
from sparklore.sources.tables import TopicTable

NAMES = "slug string, title string, aliases array<string>, tags array<string>, body string"


def topics_of(spark, rows):
    none = F.lit(None)
    full = spark.createDataFrame(rows, NAMES).withColumns({"projects": F.array().cast("array<string>"), "created": none.cast("timestamp"), "updated": none.cast("timestamp"), "extracted_at": none.cast("timestamp"), "source": none.cast("string"), "confidence": none.cast("string"), "source_context_id": none.cast("decimal(20,0)")})
    return full.select(*[c.split()[0] for c in schemas.TOPICS.split(", ")])


def test_the_index_follows_the_table_and_reads_its_own_stretches(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdef", k=rng.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    row = lambda i: (f"t{i}", text(2).title(), [text(1)] * rng.randint(0, 2), [text(1) for _ in range(rng.randint(0, 3))], text(12))
    rows = {f"t{i}": row(i) for i in range(120)}
    queries = spark.createDataFrame([(i, text(rng.randint(0, 3))) for i in range(25)] + [(90, ""), (91, "zzz"), (92, "a ab")], "query_id long, query string")
    table, index = TopicTable(spark, str(tmp_path / "topics")), SearchIndex(spark, str(tmp_path / "index"))
    assert index.search(queries).count() == 0
    table.replace(topics_of(spark, list(rows.values())))
    index.sync(table)

    def same():
        want = {(r.query_id, r.slug, r.score) for r in search.search_all(queries, topics_of(spark, list(rows.values()))).collect()}
        assert {(r.query_id, r.slug, r.score) for r in index.search(queries).collect()} == want
        best = {q: sorted(((-s, t) for k, t, s in want if k == q))[:3] for q in {k for k, _, _ in want}}
        assert {(r.query_id, r.slug, r.score) for r in index.search(queries, 3).collect()} == {(q, t, -s) for q, some in best.items() for s, t in some}

    same()
    before = index.postings.versions()
    index.sync(table)  # nothing has changed: nothing is written
    assert index.postings.versions() == before
    changed = [row(3), ("new", "New One", [], [], "abc")]
    table.apply(topics_of(spark, changed), spark.createDataFrame([("t9",)], "slug string"))
    rows |= {r[0]: r for r in changed}
    del rows["t9"]
    index.sync(table)
    added = [v for v in index.postings.versions() if v not in before]
    assert len(added) == 1 and {r.slug for r in spark.read.schema(index.postings.schema).parquet(f"{index.postings.path}/{added[0]}/*").collect()} == {"t3", "new"}
    same()
    few = index.postings.read(spark.createDataFrame([("abc",)], "gram string"))
    assert len(few.inputFiles()) <= 2 < len(index.postings.read().inputFiles())
