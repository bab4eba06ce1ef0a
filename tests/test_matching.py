import random
import time

import pytest
from sparklore.config import Config, DedupePolicy, Regime
from sparklore.operators import matching, merge, search, topics
from sparklore.sources.topics import markdown, read_markdown
from pyspark.sql import functions as F

TOPICS = "slug string, title string, aliases array<string>, tags array<string>, projects array<string>, created timestamp, updated timestamp, extracted_at timestamp, source string, confidence string, source_context_id decimal(20,0), body string"
LEARNINGS = "learning_id long, pos long, topic_hint string, title string, summary string, evidence array<string>, tags array<string>, confidence double, project_path string"


def topic(slug, title, aliases=(), tags=(), body=""):
    return (slug, title, list(aliases), list(tags), [], None, None, None, None, None, None, body)


def learning(n, hint, title, summary, tags=(), evidence=(), project=None):
    return (n, n, hint, title, summary, list(evidence), list(tags), 0.8, project)


@pytest.fixture
def store(spark):
    return spark.createDataFrame(
        [topic("gh-cli", "GH CLI", ["github cli"], ["gh", "cli", "github"], "The gh tool. Unset the token first."), topic("docker-compose", "Docker Compose", [], ["docker", "compose", "containers"], "Use compose."), topic("aws-sso", "AWS SSO Login", ["sso"], ["aws", "sso", "credentials"], "Log in.")],
        TOPICS,
    )


def outcomes(spark, store, rows, policy):
    got = matching.outcomes(spark.createDataFrame(rows, LEARNINGS), store, policy).collect()
    return {r.learning_id: (r.stage, r.existing_slug, r.outcome) for r in got}


def test_each_stage(spark, store):
    rows = [
        learning(1, "GH CLI", "unset the token", "x"),
        learning(2, "SSO", "zq", "entirely different summary words"),
        learning(3, "compose", "zq", "entirely different summary words"),
        learning(4, "gh-cli-auth", "zq", "entirely different summary words", ["CLI", "gh"]),
        learning(5, "login", "zq", "entirely different summary words", ["aws", "Credentials", "sso"]),
        learning(6, "kubernetes", "t", "s", ["k8s"]),
    ]
    got = outcomes(spark, store, rows, DedupePolicy.preset("balanced"))
    assert got == {1: (1, "gh-cli", "NOOP"), 2: (2, "aws-sso", "APPEND"), 3: (3, "docker-compose", "APPEND"), 4: (4, "gh-cli", "APPEND"), 5: (3, "aws-sso", "APPEND"), 6: (None, None, "CREATE")}
    strict = outcomes(spark, store, rows, DedupePolicy.preset("aggressive"))
    assert strict[3] == strict[4] == strict[5] == (None, None, "CREATE")
    jaccard = outcomes(spark, store, [learning(7, "zzz", "zq", "s", ["aws", "sso"])], DedupePolicy.preset("balanced"))
    assert jaccard[7] == (5, "aws-sso", "APPEND")


def test_coverage_depends_on_the_regime(spark, store):
    words = "alpha bravo charlie delta echos foxtrot golfs hotel india"
    known = spark.createDataFrame([topic("t", "T", body=words)], TOPICS)
    rows = [learning(1, "t", "no such title", words + " juliett kilos")]
    assert [outcomes(spark, known, rows, DedupePolicy.preset(r))[1][2] for r in Regime] == ["APPEND", "NOOP", "NOOP"]


def test_policy_and_config():
    with pytest.raises(ValueError):
        DedupePolicy().with_overrides(coverage_threshold=1.2)
    with pytest.raises(ValueError):
        DedupePolicy().with_overrides(tag_overlap_minimum=0)
    with pytest.raises(ValueError):
        Regime.parse("wild")
    assert DedupePolicy.preset("Conservative").summary() == "conservative (title=fuzzy(0.50), tags>=1, coverage>=0.60)"
    config = Config.from_dict({"loop": {"context_limit": 3, "patterns": {"min_occurrences": 2}}, "dedupe": {"regime": "aggressive", "tag_overlap_minimum": 2}})
    assert config.loop.context_limit == 3 and config.loop.patterns.min_occurrences == 2 and config.dedupe.tag_overlap_minimum == 2 and config.dedupe.coverage_threshold == 0.95
    assert Config.load(None, {"SPARKLORE_SOURCE": " Codex "}).source == "codex" and Config.load(None, {"SPARKLORE_SOURCE": "x"}).source == "claude-code"


def test_creates_of_one_slug_and_appends_in_order(spark, store):
    rows = [
        learning(1, "New Tool", "First", "one", ["A", "b"], ["e1"], "p1"),
        learning(2, "new-tool", "Second", "two", ["a", "C"], ["e1", "e2"]),
        learning(3, "gh-cli", "Third title", "three words entirely other", ["x"], [], "p2"),
        learning(4, "gh-cli", "Fourth title", "four words entirely other", ["X", "gh"]),
    ]
    found = matching.outcomes(spark.createDataFrame(rows, LEARNINGS), store, DedupePolicy())
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    got = {r.slug: r for r in merge.merged_topics(store, found, lambda _: F.lit(7), at).collect()}
    assert len(got) == 4
    new = got["new-tool"]
    assert (new.title, new.tags, new.projects, new.confidence, new.source_context_id) == ("First", ["A", "b", "C"], ["p1"], "0.80", 7)
    assert new.body == "# First\n\none\n\nSecond: two\n\n## Evidence\n\n- e1\n- e2\n\n"
    old = got["gh-cli"]
    assert old.body.endswith("\n## Key Insights\n\n### Third title\n\nthree words entirely other\n\n_Extracted from context 7 at 2024-05-06 07:08 UTC_\n\n### Fourth title\n\nfour words entirely other\n\n_Extracted from context 7 at 2024-05-06 07:08 UTC_\n")
    assert (old.tags, old.projects) == (["gh", "cli", "github", "x"], ["p2"])
    assert merge.merge_counts(found).first().asDict() == {"topics_created": 1, "topics_updated": 2, "duplicates_skipped": 0}
    assert matching.counts(found).first().asDict() == {"created": 2, "appended": 2, "skipped": 0}
    lines = {r.learning_id: r.summary_line for r in matching.outcome_text(found).collect()}
    assert lines[1] == "new topic New Tool: First" and lines[3] == "added to gh-cli: Third title"


def test_search_and_lookup(spark, store):
    assert [(r.slug, r.score) for r in search.search(store, "cli").collect()] == [("gh-cli", 10 + 10 + 7 + 5)]
    assert [r.slug for r in search.search(store, "docker compose").collect()] == ["docker-compose"]
    assert search.search(store, "  ").count() == 0 and search.search(store, "kubernetes").count() == 0
    names = spark.createDataFrame([("GitHub CLI",), ("gh cli",), ("nothing",)], "name string")
    assert {r.name: r.slug for r in topics.lookup(names, store).collect()} == {"GitHub CLI": "gh-cli", "gh cli": "gh-cli"}
    new = spark.createDataFrame([topic("x", "X", ["SSO", "Docker Compose", "own"])], TOPICS)
    assert {(r.alias, r.other_slug) for r in topics.alias_collisions(new, store).collect()} == {("SSO", "aws-sso"), ("Docker Compose", "docker-compose")}


def test_markdown_round_trip(spark, store, tmp_path):
    for r in markdown(store).collect():
        (tmp_path / f"{r.slug}.md").write_text(r.text)
    back = {r.slug: r for r in read_markdown(spark, str(tmp_path)).collect()}
    for r in store.collect():
        assert (back[r.slug].title, back[r.slug].aliases, back[r.slug].tags, back[r.slug].body.rstrip()) == (r.title, r.aliases, r.tags, r.body)
    (tmp_path / "bad.md").write_text("no front matter")
    with pytest.raises(Exception, match="no front matter"):
        read_markdown(spark, str(tmp_path)).count()
    assert [r.error for r in read_markdown(spark, str(tmp_path), strict=False).collect() if r.error] == ["no front matter"]


def test_containment_by_grams(spark):
    import random

    rng = random.Random(6)
    words = ["".join(rng.choices("ab c", k=rng.randint(0, 9))) for _ in range(60)]
    outer = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "o long, text string")
    inner = spark.createDataFrame([(i, w) for i, w in enumerate(words[30:])], "i long, text string")
    want = {(o, i) for o, a in enumerate(words) for i, b in enumerate(words[30:]) if b and b in a}
    got = matching.containing(outer, inner).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_hints_and_titles(spark, store):
    rows = [learning(1, "", "zq", "s"), learning(2, "nothing like it", "zq", "s")]
    assert outcomes(spark, store, rows, DedupePolicy())[1] == (3, "aws-sso", "APPEND")
    untitled = store.union(spark.createDataFrame([topic("u", "", body="x")], TOPICS))
    assert outcomes(spark, untitled, rows, DedupePolicy())[2] == (3, "u", "APPEND")


def plain_tags(rows, topics, least, threshold):
    """(by count, by Jaccard) for each learning, one topic after the other."""
    first, near = {}, {}
    for n, tags in rows:
        own = {t.lower() for t in tags}
        for slug, held in sorted(topics):
            lower = [t.lower() for t in held]
            if own and sum(t in own for t in lower) >= least:
                first.setdefault(n, slug)
            j = len(own & set(lower)) / max(1, len(own | set(lower)))
            if lower and own and j >= threshold and j > near.get(n, (0,))[0]:
                near[n] = j, slug
    return first, {n: slug for n, (_, slug) in near.items()}


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_tag_stages_agree_with_plain_loops(spark, least):
    import random

    rng = random.Random(least)
    names = [f"T{i}" for i in range(14)]
    some = lambda most: [rng.choice(names).swapcase() if rng.random() < 0.3 else rng.choice(names) for _ in range(rng.randint(0, most))]
    rows = [(i, some(7)) for i in range(80)] + [(100, [f"t{i}" for i in range(60)]), (101, ["hot"])]
    topics_ = [(f"s{rng.randint(0, 10**6)}-{i}", [*some(7), *["HOT"] * rng.randint(0, 2)]) for i in range(70)] + [("a-wide", [f"T{i}" for i in range(50)])]
    learnings = spark.createDataFrame([(n, [t.lower() for t in tags]) for n, tags in rows], "learning_id long, ltags array<string>")
    held = spark.createDataFrame([(s, [t.lower() for t in tags]) for s, tags in topics_], "slug string, ltags array<string>")
    for threshold in (0.35, 0.5):
        first, near = plain_tags(rows, topics_, least, threshold)
        assert {r.learning_id: r.slug for r in matching._first(matching.enough_tags(learnings, held, least)).collect()} == first
        assert {r.learning_id: r.slug for r in matching.nearest_tags(learnings, held, threshold).collect()} == near


def test_a_tag_that_all_topics_have_meets_one_row_a_key(spark):
    """Rows that leave the joins of the tag stages: learnings times keys, not times topics."""
    topics_ = spark.range(3000).selectExpr("concat('t', id) as slug", "array('all', concat('own', id), concat('g', id % 5)) as ltags")
    learnings = spark.range(400).selectExpr("id as learning_id", "array('all', concat('g', id % 5)) as ltags", "concat('h', id) as hint_slug")
    for found, most in ((matching.enough_tags(learnings, topics_, 1), 400 * 3), (matching.enough_tags(learnings, topics_, 2), 400 * 3), (matching._by_affinity(learnings, topics_, 2), 400)):
        assert found.count() <= most
    assert {r.slug for r in matching._first(matching.enough_tags(learnings, topics_, 2)).collect()} == {min(f"t{i}" for i in range(g, 3000, 5)) for g in range(5)}


def test_affinity_with_empty_slugs(spark):
    topics_ = spark.createDataFrame([("", ["a", "b"]), ("tool", ["a", "b"]), ("other", ["a"])], "slug string, ltags array<string>")
    rows = spark.createDataFrame([(1, "my-tool-box", ["a", "b"]), (2, "", ["a", "b"]), (3, "oo", ["a", "b"]), (4, "else", ["a", "c"])], "learning_id long, hint_slug string, ltags array<string>")
    got = matching._by_affinity(rows, topics_, 2).collect()
    assert {(r.learning_id, r.slug) for r in got} == {(1, "tool"), (3, "tool"), (1, ""), (2, ""), (3, "")}


def test_insights_added_at_once_are_those_added_one_by_one(spark):
    rng = random.Random(5)
    some = ["x", "\n", "## Key Insights", "\n## ", "### t", "é", "# ", ""]
    text = lambda n: "".join(rng.choice(some) for _ in range(rng.randint(0, n)))
    rows = [(i, text(8), [text(5) if rng.random() < 0.98 else None for _ in range(rng.randint(0, 6))]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, body string, sections array<string>")
    one_by_one = F.aggregate("sections", F.col("body"), merge.add_insight)
    got = df.select(one_by_one.alias("a"), merge.add_insights(F.col("body"), F.col("sections")).alias("b"))
    assert got.where("not a <=> b").collect() == [] and got.where("b is null").count() > 3


def test_a_topic_with_very_many_appends_is_not_folded_one_by_one(spark):
    """20,000 appends of some 2 KB: a body that is copied for each of them takes hours."""
    topics = spark.createDataFrame([("a", "A", [], [], [], None, None, None, None, None, None, "# A\n")], TOPICS)
    rows = spark.range(20_000).selectExpr("id as pos", "'a' as topic_hint", "concat('t', id) as title", "repeat('s', 2000) as summary", "array('e') as evidence", "array('x', concat('T', id % 3)) as tags", "0.5D as confidence", "'p' as project_path", "'a' as existing_slug", "'APPEND' as outcome")
    start = time.monotonic()
    got = merge.merged_topics(topics, rows, lambda pos: pos, F.lit("2024-01-02 03:04:05").cast("timestamp")).selectExpr("length(body) as n", "tags", "projects").collect()
    assert [(r.n > 20_000 * 2000, r.tags, r.projects) for r in got] == [(True, ["x", "T0", "T1", "T2"], ["p"])]
    assert time.monotonic() - start < 100
