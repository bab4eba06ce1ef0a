import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from sparklore.llm import source_audit
from sparklore.llm.queries import ORACLE_SQL, op11_source_audit
from sparklore.llm.source_audit import audit, term_counts

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, part string"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms(text)
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        every = Counter()
        for s in sources:
            every.update({t: counts[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(every)
        for s in sources:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [("term", t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            order = lambda r: (-r[2], r[1].encode())
            out += [(lang, s, *r, k) for part, most in ((pairs, None), (own, top)) for k, r in enumerate(sorted(part, key=order)[:most], 1)]
    return sorted(out)


def check(spark, rows, **options):
    got = audit(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA), **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, *({"least_docs": 10, "top": 10} | options).values())


def test_edges(spark):
    rows = [(i, "Alpha beta, BETA gamma1delta \u00c4\u00e9 \u5b57", "en", f"s{i % 3}") for i in range(30)]
    rows += [(1, None, None, None), (2, "", "", "s1"), (3, "alpha " * 3000, "en", "s0"), (4, "lonely words", "fr", "a"), (5, "lonely words", "fr", "b"), (6, None, "en", "none"), (7, "alpha", "en", "s9"), (7, "alpha", "en", "s9"), (None, "beta \x00 \x7f beta", "en", "S9")]
    check(spark, rows)
    check(spark, [], least_docs=10)
    assert audit(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, "x", "en", "only")], least_docs=1)


def test_many_counts_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", 50)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop\u00e9", k=4)) for _ in range(300)]
    rows = []
    for i in range(400):
        lang, source = rng.choice("xy"), rng.choice(["hot"] * 3 + list("abcde"))
        rows.append((i, " ".join(words[min(int(rng.expovariate(0.02)), 299)] for _ in range(rng.randint(0, 80))), lang, source))
    check(spark, rows)
    check(spark, rows, least_docs=1, top=3)


def test_a_task_sends_parts(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", 2)
    df = spark.createDataFrame([(1, "a b a", "en", "s"), (2, "b c d", "en", "s"), (3, "a", "en", "t")], "doc_id long, text string, lang string, source string").coalesce(1)
    got = term_counts(df).groupBy("source", "term").sum("n", "docs").where("term is not null")
    assert sorted(tuple(r) for r in got.collect()) == [("s", "a", 2, 1), ("s", "b", 2, 2), ("s", "c", 1, 1), ("s", "d", 1, 1), ("t", "a", 1, 1)]


def test_counts_beyond_a_long(spark):
    c = 10**13
    row = spark.range(1).select(source_audit.share(source_audit.F.lit(c), source_audit.F.lit(3 * c), source_audit.F.lit(1000)).alias("p")).first()
    assert row.p == 1 + 10**9 * (c + 2) // (3 * c + 2000)


@pytest.mark.parametrize("query", ["op11_source_audit"])
def test_sql_agrees(spark, sf_dir, query):
    duckdb.sql(f"create or replace view documents as from '{sf_dir}/documents.parquet'")
    got = op11_source_audit(spark, sf_dir)
    want = duckdb.sql(ORACLE_SQL[query])
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(want.fetchall())
