import os
from threading import Thread

from sparklore.sources.tables import GrowingTable, TopicTable


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_write_touches_the_buckets_of_its_keys_alone(spark, tmp_path):
    table = TopicTable(spark, str(tmp_path), "slug string, body string")
    rows = spark.range(5000).selectExpr("concat('t', id) as slug", "repeat(sha2(string(id), 512), 4) as body")
    table.replace(rows)
    whole = size(tmp_path)
    before = table._now()[1]["buckets"]
    table.apply(spark.createDataFrame([("t7", "new"), ("another", "x")], "slug string, body string"), spark.createDataFrame([("t8",)], "slug string"))
    after = table._now()[1]["buckets"]
    assert 1 <= sum(before.get(b) != p for b, p in after.items()) <= 3 and size(tmp_path) - whole < whole / 10
    got = {r.slug: r.body for r in table.read().collect()}
    assert len(got) == 5000 and got["t7"] == "new" and got["another"] == "x" and "t8" not in got
    few = table.read(spark.createDataFrame([("t7",)], "slug string"))
    assert len(few.inputFiles()) < len(table.read().inputFiles()) / 10 and "new" in {r.body for r in few.collect()}
    for n in range(5):
        table.apply(spark.createDataFrame([(f"t{n}", "again")], "slug string, body string"))
    assert len(table.versions()) == 3 and size(tmp_path) < 1.5 * whole and table.read().count() == 5000


def test_state_is_read_by_bucket_and_loses_what_is_superseded(spark, tmp_path):
    table = GrowingTable(spark, str(tmp_path), "id long, head long, pass long", "id", "pass")
    for n in range(4):
        table.append(spark.range(1000).selectExpr("id", f"id + {n} as head", f"{n}L as pass"))
    assert table.read().count() == 4000 and len(table.versions()) == 4
    own = spark.createDataFrame([(5,), (6,)], "id long")
    assert len(table.read(own).inputFiles()) <= 8 and {r.head for r in table.read(own).where("id = 5").collect()} == {5, 6, 7, 8}
    table.compact()
    assert {(r.id, r.head) for r in table.read().collect()} == {(i, i + 3) for i in range(1000)} and len(table.versions()) == 1
    empty = GrowingTable(spark, str(tmp_path / "none"), "hash string")
    assert empty.read().count() == 0 and empty.read(spark.createDataFrame([("x",)], "hash string")).count() == 0
    empty.append(spark.createDataFrame([], "hash string"))
    assert empty.read().count() == 0


def test_writers_that_add_at_once_lose_nothing(spark, tmp_path):
    def add(n):
        GrowingTable(spark, str(tmp_path), "hash string").append(spark.createDataFrame([(f"h{n}-{i}",) for i in range(3)], "hash string"))

    threads = [Thread(target=add, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert GrowingTable(spark, str(tmp_path), "hash string").read().distinct().count() == 12
