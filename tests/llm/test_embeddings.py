import duckdb
import numpy as np
from sparklore.llm.embeddings import close_links, embedding_links, quantise, sure_links, unit_vectors
from sparklore.llm.queries import ORACLE_SQL, op8_embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n_links string"


def brute(rows):
    def ok(v, label):
        return v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = [[] for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and ok(v, a) and ok(w, b) and a == b and len(v) == len(w):
                x, y = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i].append(j)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        c = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((r[0], len(links[i]), c, r[0] is not None and r[0] == c))
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in embedding_links(df, **options).collect()), key=str) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    a = [1.0, 2.0, 3.0]
    check(spark, [(9, a, 1), (4, a, 1), (4, a, 1), (5, a, 2), (6, a, None), (7, None, 1), (8, [0.0] * 3, 1), (10, [nan, 1.0, 1.0], 1), (11, [inf, 1.0, 1.0], 1), (12, [None, 1.0, 1.0], 1), (13, [], 1), (14, [2.0, 4.0, 6.0], 1), (15, [1.0, 2.0], 1), (None, a, 1), (None, a, 3), (16, [-1.0, -2.0, -3.0], 1)])
    assert embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tiles_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(6, 16))
    for i in range(240):
        v = base[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.28, 0.4])
        rows.append((1000 - i, v.astype(np.float32).tolist(), int(i % 3 == 0)))
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(40)]
    for tile in (16, 2048):
        check(spark, rows, tile=tile)


def test_bounds_are_rigorous():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(400, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    codes, scale, bound = quantise(u)
    exact = u @ u.T
    rough = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(exact - rough) <= bound[:, None] + (1 + bound[:, None]) * bound).all()


def test_sure_and_close_links_are_all_links():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(3, 24))
    x = np.concatenate([b + rng.normal(size=(200, 24)) * 0.27 for b in base]) * 10.0 ** rng.integers(-300, 300, (600, 1))
    u = unit_vectors(x)
    assert np.allclose(np.linalg.norm(u, axis=1), 1)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.93)) if i < j}
    sure, doubt = set(), set()
    for a, b, c, d in sure_links(quantise(u), None, 0.93):
        sure |= set(zip(a.tolist(), b.tolist()))
        doubt |= set(zip(c.tolist(), d.tolist()))
    close = {p for a, b in close_links(x, None, 0.93) for p in zip(a.tolist(), b.tolist())}
    assert sure <= want and close <= doubt and sure | close == want and len(sure) > 10 and len(close) > 10


def test_very_large_and_small_doubles(spark):
    rows = [(i, [1.0 * s, 2.0 * s, 3.0 * s + t], 1) for i, (s, t) in enumerate([(1e-200, 0.0), (1e250, 0.0), (1.0, 0.01), (1e-200, 1e-199)])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3)}


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = sorted(tuple(r) for r in op8_embeddings(spark, sf_dir).collect())
    assert got == sorted(con.execute(ORACLE_SQL["op8_embeddings"]).fetchall())
