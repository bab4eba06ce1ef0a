import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F
from sparklore import schemas
from sparklore.cli import main
from sparklore.config import Config, LoopConfig, ModelConfig, PatternConfig
from sparklore.kb import KnowledgeBase, TopicError
from sparklore.sources import ClaudeLogs, CodexLogs, CrushLogs, GeminiLogs
from sparklore.sources.tables import Conflict, GrowingTable, TopicTable
from sparklore.sources.topics import read_markdown, write_markdown
from sparklore.streaming.runner import Store, answers, asked, run_once, run_pass, start


def session(root, name, *outputs):
    (root / f"{name}.jsonl").write_text("\n".join(json.dumps({"type": "function_call_completed", "data": {"output": o}}) for o in outputs))


def reply(system, prompt):
    """A model whose learning is named by the transcript's first output; some transcripts it fails on."""
    assert "JSON object" in system
    if "broken" in prompt:
        raise RuntimeError("no answer")
    word = prompt.split("[TOOL_RESULT] ")[1].split()[0]
    return "Sure: " + json.dumps({"context_id": 0, "learnings": [{"topic_hint": word, "title": f"About {word}", "summary": f"long summary about {word} things", "evidence": ["seen"], "tags": [word, "tools"], "confidence": 0.9}, {"topic_hint": "weak", "title": "w", "summary": "w", "confidence": 0.1}]})


def test_incremental_passes(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    session(logs, "one", "docker is odd")
    session(logs, "two", "docker again")
    session(logs, "three", "broken thing")
    store, config = Store(spark, str(tmp_path / "store")), Config(loop=LoopConfig(patterns=PatternConfig(enabled=False)))
    source, model = CodexLogs(str(logs)), asked(reply)
    dry = run_once(spark, source, store, config, model, dry_run=True)
    assert sorted(r.outcome for r in dry.collect()) == ["CREATE", "CREATE"] and store.topics.read().count() == 0
    run_once(spark, source, store, config, model)
    (topic,) = store.topics.read().collect()
    assert topic.slug == "docker" and topic.tags == ["docker", "tools"] and topic.confidence == "0.90"
    assert store.processed.read().count() == 2 and store.extracted.read().count() == 1
    assert run_once(spark, source, store, config, model).count() == 0  # only the failed session is taken again
    with open(logs / "one.jsonl", "a") as f:
        f.write("\n" + json.dumps({"type": "error", "data": {"message": "more"}}))
    assert run_once(spark, source, store, config, model).count() == 0  # taken again, but its learning is known
    session(logs, "four", "kubectl breaks")
    query = start(spark, lambda: run_once(spark, source, store, config, model), str(tmp_path / "checkpoint"), None)
    query.awaitTermination(120)
    assert {r.slug for r in store.topics.read().collect()} == {"docker", "kubectl"}


def test_patterns_become_topics_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for i in range(3):
        folder = logs / "-w"
        folder.mkdir(exist_ok=True)
        (folder / f"s{i}.jsonl").write_text(json.dumps({"type": "user", "message": {"content": "format all files before you push"}}))
    asked_for = []

    def synthesize(prompts):
        asked_for.extend(r.prompt for r in prompts.collect())
        text = json.dumps({"directives": [{"topic_hint": "format-files", "title": "Format files", "summary": "Always.", "evidence": [], "tags": ["format"], "confidence": 0.2, "projects": ["/w"]}]})
        return prompts.select("context_id", F.lit(text).alias("response"))

    store, none = Store(spark, str(tmp_path / "store")), answers(spark.createDataFrame([], schemas.RESPONSES))
    rows = run_once(spark, ClaudeLogs(str(logs)), store, Config(), none, synthesize)
    assert [(r.topic_hint, r.outcome) for r in rows.collect()] == [("format-files", "CREATE")]
    assert len(asked_for) == 1 and "1. repeated-instruction, 3 times" in asked_for[0] and asked_for[0].count(" in project /w: format all") == 3
    assert store.patterns.read().count() == 1 and store.topics.read().first().source_context_id == 0


def test_service_and_commands(spark, tmp_path, capsys, monkeypatch):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    assert kb.add("GitHub CLI", "Unset it.", tags=["gh"], aliases=["gh"]) == "github-cli"
    with pytest.raises(TopicError, match="exists"):
        kb.add("github cli", "again")
    with pytest.raises(TopicError, match="belongs"):
        kb.add("Other", "x", aliases=["GH"])
    with pytest.raises(TopicError, match="bad slug"):
        kb.add("é", "x")
    kb.update("gh", "New body")
    assert kb.get("GH").first().body == "New body" and kb.status()["topics"] == 1 and kb.is_initialized() and not kb.init()
    kb.add("Other", "x", aliases=["o"])
    with pytest.raises(TopicError, match="belongs"):
        kb.update("o", aliases=["gh"])
    with pytest.raises(TopicError, match="exists"):
        kb.update("o", slug="github-cli")
    assert kb.update("o", title="Renamed", slug="renamed", tags=["t"], aliases=["other"]) == "renamed"
    row = kb.get("Other").first()
    assert (row.slug, row.title, row.tags, row.aliases, row.body) == ("renamed", "Renamed", ["t"], ["other"], "x")
    kb.delete("renamed")
    args = ["--kb-path", str(tmp_path / "kb")]
    monkeypatch.setattr("sys.stdin", open(os.devnull))
    assert main([*args, "add", "Docker", "--tags", "d"], spark) == 0 and main([*args, "read", "gh"], spark) == 0
    assert main([*args, "topics"], spark) == 0 and main([*args, "search", "docker"], spark) == 0
    assert main([*args, "delete", "docker"], spark) == 0 and main([*args, "read", "docker"], spark) == 1
    assert "New body" in capsys.readouterr().out and [r.slug for r in kb.list().collect()] == ["github-cli"]
    logs = tmp_path / "logs"
    (logs / "-p").mkdir(parents=True)
    (logs / "-p" / "s.jsonl").write_text(json.dumps({"type": "system", "content": "boom", "subtype": "error"}))
    spark.createDataFrame([], schemas.RESPONSES).write.parquet(str(tmp_path / "r"))
    loop = [*args, "loop", "run", "--root", str(logs), "--responses", str(tmp_path / "r"), "--regime", "aggressive"]
    assert main([*loop, "--dry-run"], spark) == 1 and "no answer" in capsys.readouterr().err
    assert main(loop, spark) == 1 and main([*args, "loop", "status"], spark) == 0 and main([*args, "init"], spark) == 0
    assert "'processed': 0" in capsys.readouterr().out
    spark.createDataFrame([(r.context_id, '{"context_id": 1, "learnings": []}') for r in ClaudeLogs(str(logs)).sessions(spark).collect()], schemas.RESPONSES).write.parquet(str(tmp_path / "r2"))
    assert main([*loop[:-3], str(tmp_path / "r2")], spark) == 0 and kb.status()["processed"] == 1


def test_only_what_was_answered_is_done(spark, tmp_path):
    """Sessions without an answer, with a broken document or in a database that fails midway stay; blank ones are done."""
    chats = tmp_path / "gemini" / "p" / "chats"
    chats.mkdir(parents=True)
    said = lambda text: json.dumps({"messages": [{"type": "gemini", "content": text}]})
    for name, text in {"good": said("an error and its fix"), "silent": said("another error"), "blank": said("nothing here"), "broken": "{ no json"}.items():
        (chats / f"{name}.json").write_text(text)
    source, store = GeminiLogs(str(tmp_path / "gemini")), Store(spark, str(tmp_path / "store"))
    ids = {r.session_id: r.context_id for r in source.sessions(spark).collect()}
    table = spark.createDataFrame([(ids["good"], '{"context_id": 1, "learnings": []}')], schemas.RESPONSES)
    done = run_pass(spark, source, store, Config(), answers(table))
    errors = {r.context_id: r.error for r in done.errors.collect()}
    assert errors == {ids["silent"]: "no answer", ids["broken"]: "no JSON document"}
    assert {r.context_id for r in store.heads().collect()} == {ids["good"], ids["blank"]}
    totals = done.totals().first()
    assert (totals.sessions, totals.failed, totals.topics_created) == (4, 2, 0)
    path = tmp_path / "crush.db"
    with sqlite3.connect(path) as db:
        db.execute("create table sessions (id text, title text, message_count int, updated_at int)")
        db.execute("create table messages (session_id text, role text, parts text, created_at int)")
        db.execute("insert into sessions values ('s', 'S', 2, 1)")
        db.executemany("insert into messages values ('s', 'user', ?, ?)", [(json.dumps([{"type": "text", "data": {"text": f"error {i} " + "x" * 900}}]), i) for i in range(3000)])
    size = os.path.getsize(path)
    with open(path, "r+b") as f:  # what is stored at the end cannot be read
        f.seek(size // 2)
        f.write(b"\xff" * (size - size // 2))
    crush = CrushLogs((str(path),))
    got = run_pass(spark, crush, Store(spark, str(tmp_path / "store2")), Config(), answers(table))
    assert [str(path) in r.error for r in got.errors.collect()] == [True] and got.outcomes.isEmpty()
    assert Store(spark, str(tmp_path / "store2")).processed.read().isEmpty()


def test_a_failing_topic_write_marks_nothing(spark, tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    logs.mkdir()
    session(logs, "one", "docker is odd")
    store = Store(spark, str(tmp_path / "store"))
    model = asked(reply)

    def full(self, rows, deleted=None):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(TopicTable, "apply", full)
        with pytest.raises(OSError):
            run_once(spark, CodexLogs(str(logs)), store, Config(), model)
    assert store.processed.read().isEmpty() and store.extracted.read().isEmpty() and store.patterns.read().isEmpty()
    assert [r.outcome for r in run_once(spark, CodexLogs(str(logs)), store, Config(), model).collect()] == ["CREATE"]
    query = start(spark, lambda: full(None, None), str(tmp_path / "checkpoint"), None)
    with pytest.raises(Exception, match="disk full"):
        query.awaitTermination(120)


def test_tables_tell_writers_apart(spark, tmp_path):
    at = lambda: TopicTable(spark, str(tmp_path / "t"), "a long, b string")
    rows = lambda *n: spark.createDataFrame([(i, "x") for i in n], "a long, b string")
    one, two = at(), at()
    one.replace(one.read().union(rows(1)))
    late = two.read()
    one.replace(one.read().union(rows(2)))
    two.replace(two.read().union(rows(3)))
    one.base = one.base[:0] + ["an older one"]
    with pytest.raises(Conflict, match="changed"):
        one.replace(rows(9))
    assert late.count() == 1 and sorted(r.a for r in at().read().collect()) == [1, 2, 3]
    name = at()._claimed(4)
    with pytest.raises(Conflict, match="being written"):
        at().replace(rows(8))
    os.remove(name)
    for n in range(4, 8):
        at().replace(rows(n))
    assert len(at().versions()) == 3 and [r.a for r in at().read().collect()] == [7]
    grown = GrowingTable(spark, str(tmp_path / "g"), "a long, b string")
    for n in range(4):
        grown.append(rows(n, 0))
    grown.compact()
    assert sorted(r.a for r in grown.read().collect()) == [0, 1, 2, 3] and len(grown.versions()) == 1


def test_markdown_round_trip(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.add("First Topic", "Line one.\n\n---\nLine two: é\n", tags=["a", "b: c"], aliases=["f"])
    kb.add("Second", "")
    write_markdown(kb.load(), str(tmp_path / "md"))
    key = lambda rows: sorted((r.slug, r.title, tuple(r.aliases), tuple(r.tags), r.created, r.source, r.confidence, r.body.strip()) for r in rows.collect())
    assert key(read_markdown(spark, str(tmp_path / "md"))) == key(kb.load())


def test_settings():
    config = Config.load(env={"SPARKLORE_LOOP_CONTEXT_LIMIT": "7", "SPARKLORE_LOOP_PATTERNS_ENABLED": "no", "SPARKLORE_REGIME": "conservative", "SPARKLORE_LLM_PROVIDER": "openai"})
    assert config.loop.context_limit == 7 and not config.loop.patterns.enabled and config.dedupe.tag_overlap_minimum == 1
    assert config.llm.resolved({}).model == "gpt-4o-mini" and ModelConfig().resolved({"GEMINI_API_KEY": "k"}).provider == "gemini" and ModelConfig().resolved({}).provider == ""
    with pytest.raises(ValueError, match="not set"):
        config.llm.key({})
    assert config.llm.key({"OPENAI_API_KEY": "k"}) == "k"


def test_settings_file(tmp_path):
    config = Config.load(env={"SPARKLORE_LOOP_CONTEXT_LIMIT": "7"}, kb_path='/k "q"')
    config.write(str(tmp_path / "a" / "c.toml"))
    assert Config.load(str(tmp_path / "a" / "c.toml"), env={}) == config
