import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from sparklore.llm.hard_negatives import Best, bit_planes, hard_negatives, scores, subset_sums, whole_numbers
from sparklore.llm.queries import ORACLE_SQL, op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, positive_id string"


def brute(rows, anchor, positives=5, negatives=10):
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            kept[i] = min(kept.get(i, (label, whole)), (label, whole))
    out = []
    for a, (label, v) in kept.items():
        if anchor(a):
            ranked = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in kept.items() if i != a)
            for p, i, _ in [r for r in ranked if r[2] == label][:positives]:
                fits = [r for r in ranked if r[2] != label and 30 * -p <= 100 * -r[0] <= 90 * -p]
                out += [(a, i, k, r[1], -p, -r[0]) for k, r in enumerate(fits[:negatives], 1)]
    return sorted(out)


def check(spark, rows, anchor=lambda i: i % 3 == 0, condition="vec_id % 3 = 0", **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = hard_negatives(df, F.expr(condition), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, anchor, **{k: v for k, v in options.items() if k in ("positives", "negatives")})


def test_edges(spark):
    nan, inf, a = float("nan"), float("inf"), [1.0, 0.5, -0.25]
    rows = [(3, a, 1), (4, a, 1), (5, a, 2), (6, None, 1), (None, a, 1), (9, a, None), (12, [nan, 1.0, 1.0], 2), (13, [inf, 1.0, 1.0], 2), (14, [None, 1.0, 1.0], 2), (15, [], 1), (16, [0.7, 0.1, 0.2], 2), (17, [0.7, 0.1], 2)]
    rows += [(18, [0.0] * 3, 3), (19, [0.0] * 3, 3), (21, [-1.0, 0.0, 0.0], 4), (22, [1.0, 0.0, 0.0], 4), (24, [0.6, 0.2, 0.1], 2), (24, [0.6, 0.2, 0.0], 2), (24, a, 3)]
    check(spark, rows)
    check(spark, rows, tile=2, block=1)
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, a, 1, "", "")], SCHEMA), F.lit(None).cast("boolean")).count() == 0


def test_ties_and_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.integers(-3, 4, 11) / 4).tolist(), int(min(i % 6, 3))) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(60)] + [(2000 + i, rows[7][1], i % 4) for i in range(60)]
    check(spark, rows, tile=50, block=16)
    check(spark, rows, positives=2, negatives=3)


def test_tables_give_the_inner_products():
    rng = np.random.default_rng(1)
    for dims, size in ((1, 3), (8, 200), (13, 90_000), (64, 160)):
        x, a = (rng.integers(-size, size + 1, (n, dims)) for n in (70, 9))
        assert (scores(bit_planes(x), subset_sums(a)) == x @ a.T).all()
    x = np.array([[-1, -(1 << 40)], [0, (1 << 40) - 1]])
    assert (scores(bit_planes(x), subset_sums(x)) == x @ x.T).all()
    assert scores(bit_planes(np.zeros((2, 0), np.int64)), subset_sums(np.zeros((1, 0), np.int64))).tolist() == [[0], [0]]


def test_best_keeps_ties_by_id():
    best, rng = Best(3, 4), np.random.default_rng(6)
    seen = []
    for _ in range(20):
        at, ids, s = rng.integers(0, 3, 15), rng.integers(0, 10_000, 15), rng.integers(0, 6, 15)
        seen += list(zip(at, -s, ids))
        kept = s >= best.least[at]
        best.add(at[kept], ids[kept], s[kept])
    want = [r for k in range(3) for r in sorted(x for x in seen if x[0] == k)[:4]]
    assert sorted(zip(best.at, -best.scores, best.ids)) == want


def test_large_components(spark):
    vectors = [[1e6, -2e5], [9e5, 1e5], [8e5, 3e5]]
    schema = "vec_id long, embedding array<double>, label int"
    got = hard_negatives(spark.createDataFrame([(0, vectors[0], 1), (1, vectors[1], 1), (2, vectors[2], 2)], schema), F.col("vec_id") == 0).collect()
    w = [[int(256 * x) for x in v] for v in vectors]
    assert [(r.positive_score, r.negative_score) for r in got] == [tuple(sum(x * y for x, y in zip(w[0], w[k])) for k in (1, 2))]
    with pytest.raises(Exception, match="may not fit a long"):
        hard_negatives(spark.createDataFrame([(0, [1e9], 1), (1, [1e9], 1)], schema), F.lit(True)).collect()
    with pytest.raises(Exception, match="too large"):
        spark.range(1).select(whole_numbers(F.array(F.lit(1e300)))).collect()


def test_sql_agrees(spark, sf_dir):
    duckdb.sql(f"create or replace view embeddings as from '{sf_dir}/embeddings.parquet'")
    got = op13_hard_negatives(spark, sf_dir)
    want = duckdb.sql(ORACLE_SQL["op13_hard_negatives"])
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(want.fetchall())
