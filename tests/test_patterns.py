import random

import pytest
from pyspark.sql import functions as F
from sparklore.config import PatternConfig
from sparklore.operators import patterns


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def sequential(sets, threshold):
    """Leader clustering one message after the other."""
    leader = {}
    for i in range(len(sets)):
        if i not in leader:
            leader[i] = i
            for j in range(i + 1, len(sets)):
                if j not in leader and jaccard(sets[i], sets[j]) >= threshold:
                    leader[j] = i
    return leader


@pytest.mark.parametrize(("seed", "threshold", "tile"), [(1, 0.4, 512), (2, 0.34, 3), (3, 0.7, 2)])
def test_pairs_and_leaders_are_those_of_the_plain_loops(spark, monkeypatch, seed, threshold, tile):
    rng = random.Random(seed)
    tokens = [[f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.randint(0, 7))] for _ in range(90)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "idx long, tokens array<string>")
    sets = [set(t) for t in tokens]
    rep = {}
    for i, s in enumerate(sets):
        rep[i] = next((j for j in range(i) if s and sets[j] == s), i)
    want = {(i, j) for j in range(90) for i in range(j) if rep[i] == i and rep[j] == j and sets[i] and jaccard(sets[i], sets[j]) >= threshold}
    got = patterns.similar_pairs(df, threshold, tile).collect()
    assert {(r.i, r.j) for r in got} == want and len(got) == len(want)
    assert {r.idx: r.rep for r in patterns.classes(df).collect()} == rep
    for few in (patterns.FEW, 5, 0):  # one by one at once, after some rounds, and by rounds alone
        assert {r.idx: r.leader for r in patterns.leaders(df, threshold, few).collect()} == sequential(sets, threshold)


def test_pairs_that_are_not_similar_leave_no_task(spark, capsys):
    """Sets of very frequent tokens are compared where their blocks meet; no row is made for two sets that share a token."""
    df = spark.createDataFrame([(i, ["the", "and", "for", *(f"w{i}-{k}" for k in range(6))]) for i in range(300)], "idx long, tokens array<string>")
    pairs = patterns.similar_pairs(df, 0.4)
    assert pairs.count() == 0
    pairs.explain("formatted")
    assert "Join" not in capsys.readouterr().out


def test_sets_of_sizes_too_far_apart_meet_in_no_task(spark, monkeypatch):
    """Sets of 5 tokens cannot be similar to sets of 50, so they are not brought together (but in the block that has both)."""
    dealt, repartition = [], type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, *by: dealt.append(self) or repartition(self, *by))
    df = spark.createDataFrame([(i, [f"w{i}-{k}" for k in range(5 if i < 60 else 50)]) for i in range(120)], "idx long, tokens array<string>")
    assert patterns.similar_pairs(df, 0.4).count() == 0
    tasks = dealt[-1].groupBy("p", "q").agg(F.count_if(F.col("n") == 5).alias("small"), F.count_if(F.col("n") == 50).alias("large"))
    assert tasks.agg(F.sum(F.col("small") * F.col("large"))).first()[0] < 60 * 60 / 4


@pytest.mark.parametrize(("blocks", "counted"), [(1, (1,)), (4, (1, 2, 4, 8, 16)), (25, (4,))])
def test_pairs_of_many_sizes(spark, monkeypatch, blocks, counted):
    """Sizes from 1 to some hundreds, copies of parts of sets at and around the threshold, one block and many, one size in several blocks."""
    monkeypatch.setattr(patterns, "BLOCKS", blocks)
    monkeypatch.setattr(patterns, "COUNTED", counted)
    monkeypatch.setattr(patterns, "COMMON", 40)
    rng = random.Random(blocks)
    sets = [{f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(int(2 ** rng.uniform(0, 8)))} for _ in range(150)]
    sets += [set(rng.sample(sorted(s), max(1, round(len(s) * share)))) | {f"x{rng.randrange(40)}" for _ in range(rng.randrange(3))} for s in sets for share in (rng.choice((0.4, 0.41, 0.39, 0.7, 1)),)]
    sets = list({frozenset(s): s for s in sets}.values())
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "idx long, tokens array<string>")
    want = {(i, j): jaccard(sets[i], sets[j]) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.4}
    got = patterns.similar_pairs(df, 0.4).collect()
    assert {(r.i, r.j): r.similarity for r in got} == want and len(got) == len(want) > 100


def test_pairs_with_more_tokens_than_tasks_know(spark, monkeypatch):
    monkeypatch.setattr(patterns, "COMMON", 9)
    monkeypatch.setattr(patterns, "PAIRS", 3)
    rng = random.Random(4)
    sets = [{f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.randint(1, 12))} for _ in range(70)]
    sets = [s for i, s in enumerate(sets) if s not in sets[:i]]
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "idx long, tokens array<string>")
    want = {(i, j): jaccard(sets[i], sets[j]) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.3}
    got = patterns.similar_pairs(df, 0.3, 60).collect()
    assert {(r.i, r.j): r.similarity for r in got} == want and len(got) == len(want) > 10


def greedy(n, links):
    leads = {}
    for v in range(n):
        leads[v] = not any(leads[i] for i, j in links if j == v)
    return leads


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_agree_with_going_one_by_one(spark, seed):
    rng, n = random.Random(seed), 60
    links = {(v - rng.choice([1, 1, 1, 2]), v) for v in range(2, n) if rng.random() < 0.8} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(15 * seed)}
    nodes = spark.range(n).withColumnRenamed("id", "idx")
    df = spark.createDataFrame(sorted(links), "i long, j long")
    for few in (0, 10):
        assert {r.idx: r.leads for r in patterns.first_independent(nodes, df, few).collect()} == greedy(n, links)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 5000, []
    along = patterns._along
    monkeypatch.setattr(patterns, "_along", lambda single: rounds.append(1) or along(single))
    nodes, links = spark.range(n).withColumnRenamed("id", "idx"), spark.range(1, n).selectExpr("id - 1 as i", "id as j")
    got = {r.idx: r.leads for r in patterns.first_independent(nodes, links, 0).collect()}
    assert got == {v: v % 2 == 0 for v in range(n)} and len(rounds) == 1


def test_large_sets_and_long_chains(spark):
    """Sets that fill their signatures, and a chain in which each message is like the one before it alone."""
    rng = random.Random(6)
    words = [f"t{i}" for i in range(4000)]
    sets = [set(rng.sample(words, 2500)) for _ in range(6)] + [set(rng.sample(words[:300], 200)) for _ in range(6)]
    sets += [set(list(sets[0])[:2000]) | {"x"}, set(list(sets[3])[:900])]
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "idx long, tokens array<string>")
    want = {(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.45}
    assert {(r.i, r.j) for r in patterns.similar_pairs(df, 0.45).collect()} == want and len(want) > 10
    chain = [set(map(str, range(i * 3, i * 3 + 9))) for i in range(60)]
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(chain)], "idx long, tokens array<string>")
    assert {r.idx: r.leader for r in patterns.leaders(df, 0.5).collect()} == sequential(chain, 0.5)


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError, match="over 0"):
        patterns.similar_pairs(spark.createDataFrame([], "idx long, tokens array<string>"), 0)


TURNS = "context_id long, turn_id long, kind string, text string"


def test_messages_corrections_and_detection(spark):
    rows = []
    for c in (1, 2, 3):
        rows += [(c, 1, "assistant", "I ran npm install." if c > 1 else " "), (c, 2, "user_input", f"No, always use pnpm for installing packages {'here' * (c == 2)}"), (c, 3, "user_input", "run make gen before every build"), (c, 4, "user_input", "ok no")]
    rows.append((4, 1, "user_input", "what about the weather in summer"))
    turns = spark.createDataFrame(rows, TURNS)
    assert patterns.user_messages(turns).count() == 7
    found = {(r.context_id, r.turn_id): r.agent_action for r in patterns.corrections(turns).collect()}
    assert found == {(1, 2): "", (2, 2): "I ran npm install.", (3, 2): "I ran npm install."}
    numbered = lambda df: df.selectExpr("context_id * 10 + turn_id as idx", "string(null) as project", "*")
    none = spark.createDataFrame([], "content_hash string")
    args = numbered(patterns.user_messages(turns)), numbered(patterns.corrections(turns)), PatternConfig()
    got = patterns.detect(*args, none).collect()
    assert [(r.kind, r.n, r.contexts) for r in got] == [(patterns.INSTRUCTION, 3, 3), (patterns.INSTRUCTION, 3, 3), (patterns.CORRECTION, 3, 3)]
    known = spark.createDataFrame([(r.content_hash,) for r in got[:2]], "content_hash string")
    assert [r.kind for r in patterns.detect(*args, known).collect()] == [patterns.CORRECTION]


def test_action_is_cut_between_characters_and_scrubbed(spark):
    long = "a" * 199 + "é and more"
    rows = [(1, 1, "assistant", long), (1, 2, "user_input", "wrong"), (2, 1, "tool_call", "sh: password=hunter2"), (2, 2, "system", "x"), (2, 3, "user_input", "stop")]
    got = {r.context_id: r.agent_action for r in patterns.corrections(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1: "a" * 199 + "...", 2: "sh: [REDACTED:password]"}


def test_clusters_do_not_gather_their_texts(spark, capsys):
    rows = [(i, i % 50, f"alpha bravo charlie {'delta ' * (i % 3)}", ["alpha", "bravo", "charlie", *["delta"] * (i % 3 > 0)]) for i in range(300)] + [(1000, 1, "echo", ["echo"])]
    found = patterns.clusters(spark.createDataFrame(rows, "idx long, context_id long, text string, tokens array<string>"), patterns.INSTRUCTION, 0.4, 3)
    assert [(r.leader, r.n, r.contexts, r.representative) for r in found.collect()] == [(0, 300, 50, rows[0][2])]
    found.explain("formatted")
    assert "collect_list" not in capsys.readouterr().out and "occurrences" not in found.columns


def test_detected_clusters_list_their_messages(spark):
    rows = [(c, 1, f"run make gen before every build {'now' * (c == 2)}") for c in (1, 2, 3)] + [(4, 1, "no, not that at all")]
    said = spark.createDataFrame(rows, "context_id long, turn_id long, text string").selectExpr("context_id * 10 + turn_id as idx", "string(null) as project", "*", "split(text, ' ') as tokens")
    got = patterns.detect(said, said.where("false"), PatternConfig(), spark.createDataFrame([], "content_hash string")).collect()
    assert [[(o.idx, o.context_id, o.text) for o in r.occurrences] for r in got] == [[(c * 10 + 1, c, t) for c, _, t in rows[:3]]]
