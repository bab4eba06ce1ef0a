import random

from pyspark.sql import functions as F
from sparklore.operators.ordered import last_before, running_sum
from sparklore.operators.transcript import TRUNCATED, within_budget


def test_blocks_agree_with_plain_loops(spark):
    rng = random.Random(9)
    rows = sorted((k, t, rng.choice([None, f"v{t}"]), rng.randint(0, 9)) for k in range(3) for t in rng.sample(range(100), 40))
    df = spark.createDataFrame(rows, "k int, t long, v string, n long")
    sums, lasts = {}, {}
    for k, t, *_ in rows:
        before = [r for r in rows if r[0] == k and r[1] < t]
        sums[k, t] = sum(r[3] for r in before)
        lasts[k, t] = next((r[2] for r in reversed(before) if r[2]), None)
    for span in (1, 7, 1000):
        assert {(r.k, r.t): r.s for r in running_sum(df, "k", F.col("t"), ["t"], F.col("n"), "s", span).collect()} == sums
        assert {(r.k, r.t): r.s for r in last_before(df, "k", "t", F.col("v"), "s", span).collect()} == lasts


def test_budget_agrees_with_the_plain_loop(spark):
    rng = random.Random(10)
    rows = [(k, t, "é" * rng.choice([0, 1, 5, 30])) for k in range(60) for t in rng.sample(range(9000), rng.randint(1, 9))]
    want = {}
    for k in {r[0] for r in rows}:
        text, cut = "", False
        for _, _, entry in sorted(r for r in rows if r[0] == k):
            if len(text.encode()) + len(entry.encode()) + 2 > 90:
                text, cut = text + TRUNCATED, True
                break
            text += entry + "\n"
        want[k] = text, cut
    got = within_budget(spark.createDataFrame(rows, "k int, t long, entry string"), "k", "t", 90).collect()
    assert {r.k: (r.transcript, r.truncated) for r in got} == want and {c for _, c in want.values()} == {True, False}
