import random
import re

import numpy as np
import xxhash
from sparklore.llm.queries import op4_simhash
from sparklore.llm.simhash import anchors, fingerprint, nearest_codeword, near_duplicates, one_of_each, simhash_groups


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    prints = [p for _, p in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, f"{p:016x}", best[find(i)]) for i, (d, p) in enumerate(rows))


def test_fingerprint():
    for t in ["", " \t\n", "one", "A b C", "a b c d", "É é ÀB\x0bx\x1cy z\x85w q " * 9, None, "w " * 70000]:
        assert fingerprint((t or "").encode()) == (brute_print(t) if len(t or "") < 9999 else fingerprint(b"w " * 70000))
    assert fingerprint("w x y z ".encode() * 20000) == brute_print("w x y z " * 20000)


def test_golay_covers_and_close_prints_share_an_anchor():
    rng = random.Random(4)
    words = np.array([rng.getrandbits(23) for _ in range(5000)])
    assert np.bitwise_count(words ^ nearest_codeword(words)).max() == 3
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        r, k = anchors(np.array([x, y], dtype=np.uint64).view(np.int64))
        assert set(k[r == 0]) & set(k[r == 1])


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(tuple(r) for r in op4_simhash(spark, sf_dir).collect()) == brute_groups([(d.doc_id, brute_print(d.text)) for d in docs])


def test_chains_and_hot_anchors_in_tiles(spark, monkeypatch):
    rng = random.Random(7)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 4, 4, 5])))
    base = rng.getrandbits(64)
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(18) for b in range(a)}
    rows = [(i, p) for i, p in enumerate(sorted(prints, key=lambda p: p * 7919 % 104729))]
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows], "doc_id long, fingerprint long")
    for tile in (1024, 16):
        monkeypatch.setattr("sparklore.llm.simhash.links.__defaults__", (4, tile))
        got = near_duplicates(df).join(df, "fingerprint").select("doc_id", "component_id").collect()
        assert sorted(map(tuple, got)) == [(d, c) for d, _, c in brute_groups(rows)]


def test_edges(spark):
    schema = "doc_id long, text string, fingerprint string, component string"
    rows = [(3, None, "x", None), (1, "", "x", None), (5, "a b", None, None), (4, "A  B", "y", None), (4, "A  B", "y", None), (None, "a b", "z", None), (None, "lonely text here and now", None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.component_id) for r in simhash_groups(docs).collect()}
    assert got == {(3, 1), (1, 1), (5, 4), (4, 4), (None, 4), (None, None)}
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "None"]
    assert simhash_groups(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0
