import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringContains
from sparklore.functions import turns as T
from sparklore.sources.sqlite import SqliteReader
from sparklore.sources.sqlite import query as sqlite_query
from sparklore.sources import ClaudeLogs, CodexLogs, CrushLogs, GeminiLogs, OpenCodeLogs
from sparklore.streaming.runner import typed


def got(spark, source, sessions=None):
    sessions = source.sessions(spark) if sessions is None else sessions
    names = {r.context_id: r.session_id for r in sessions.collect()}
    rows = typed(source.turns(spark, sessions)).orderBy("context_id", "turn_id").collect()
    return [(names[r.context_id], r.turn_id, r.kind, r.text, r.error) for r in rows]


def lines(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def test_claude(spark, tmp_path):
    lines(
        tmp_path / "-home-me-app" / "run-7.jsonl",
        {"type": "progress"}, "", "not json",
        {"type": "user", "message": {"content": "do it"}},
        {"type": "assistant", "message": {"content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "ok"}, {"type": "text", "text": ""}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"b": 1, "a": "ls"}}, {"type": "tool_use", "id": "c2"}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": "access denied", "is_error": True}, {"type": "tool_result", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"type": "text", "text": "next"}]}},
        {"type": "system", "content": "hello"}, {"type": "system", "content": "boom", "subtype": "error"}, {"type": "system", "content": ""},
        {"type": "user", "content": "flat"}, {"type": "user", "message": {"content": ""}}, {"type": "assistant", "message": {"content": "text"}}, {"type": "assistant"},
    )
    (tmp_path / "-home-me-app" / "empty.jsonl").touch()
    source = ClaudeLogs(str(tmp_path))
    (session,) = source.sessions(spark).collect()
    assert (session.session_id, session.project, int(session.context_id)) == ("run-7", "/home/me/app", 3207254827887083700)
    assert got(spark, source) == [
        ("run-7", 1, "user_input", "do it", False), ("run-7", 2, "assistant", "ok", False), ("run-7", 3, "tool_call", 'Bash: {"a":"ls","b":1}', False), ("run-7", 4, "tool_call", "unknown: {}", False),
        ("run-7", 5, "tool_result", "ERROR: access denied", True), ("run-7", 6, "tool_result", "a\nb", False), ("run-7", 7, "user_input", "next", False), ("run-7", 8, "system", "[info] hello", False),
        ("run-7", 9, "system", "[error] boom", True), ("run-7", 10, "user_input", "flat", False),
    ]


def test_codex(spark, tmp_path):
    lines(
        tmp_path / "s 1+é.jsonl",
        {"type": "function_call_requested", "data": {"name": "sh", "call_id": "1", "arguments": '{"x":1}'}}, {"type": "function_call_requested"},
        {"type": "function_call_completed", "data": {"call_id": "1", "output": "done"}}, {"type": "error", "data": {"message": "bad"}}, {"type": "error"}, {"type": "delta", "data": {"text": "x"}},
        {"type": "response.completed", "data": {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "one"}, {"type": "output_text", "text": ""}, {"type": "other", "text": "no"}, {"type": "output_text", "text": "two"}]}]}},
    )
    assert [r[2:] for r in got(spark, CodexLogs(str(tmp_path)))] == [
        ("tool_call", 'sh: "{\\"x\\":1}"', False), ("tool_result", "done", False), ("system", "[error] bad", True), ("system", "[error] unknown error", True), ("assistant", "one", False), ("assistant", "two", False),
    ]


def test_gemini(spark, tmp_path):
    chats = tmp_path / "p" / "chats"
    call = {"id": "c", "name": "ls", "args": {"d": "."}, "result": [{"functionResponse": {"response": {"output": "f"}}}, {"other": 1}, {"functionResponse": {}}]}
    lines(chats / "one.json", {"sessionId": "x", "messages": [{"type": "user", "content": "hi"}, {"type": "gemini", "content": "", "toolCalls": [call]}, {"type": "gemini", "content": "bye"}, {"type": "info", "content": "no"}]})
    lines(chats / "bad.json", "{ no json")
    source = GeminiLogs(str(tmp_path))
    assert [r[2:4] for r in got(spark, source)] == [("user_input", "hi"), ("tool_call", 'ls: {"d":"."}'), ("tool_result", "f"), ("tool_result", ""), ("assistant", "bye")]
    assert [r.error for r in source.documents(spark, source.sessions(spark)).where("error is not null").collect()] == ["no JSON document"]


def test_crush(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "crush.db")
    db.execute("create table sessions (id text, title text, message_count int, updated_at int)")
    db.execute("create table messages (session_id text, role text, parts text, created_at int)")
    db.executemany("insert into sessions values (?, ?, ?, ?)", [("s1", "One", 5, 10), ("s2", "None", 0, 20)])
    parts = lambda *p: json.dumps([{"type": t, "data": d} for t, d in p])
    db.executemany("insert into messages values ('s1', ?, ?, ?)", [("tool", parts(("tool_result", {"tool_call_id": "c", "content": "Exit code 127"})), 3), ("user", parts(("text", {"text": "hi"}), ("text", {"text": ""})), 1), ("assistant", parts(("text", {"text": "yo"}), ("tool_call", {"id": "c", "name": "sh", "input": '{"a":1}'}), ("finish", {})), 2), ("user", "no json", 4)])
    db.commit()
    source = CrushLogs((str(tmp_path / "crush.db"), str(tmp_path / "missing.db")))
    assert got(spark, source) == [("s1", 1, "user_input", "hi", False), ("s1", 2, "assistant", "yo", False), ("s1", 3, "tool_call", 'sh: {"a":1}', False), ("s1", 4, "tool_result", "ERROR: Exit code 127", True)]
    (s,) = source.sessions(spark).collect()
    assert (s.project, int(s.head_turn_id), s.modified) == ("One", 5, 10)


def test_opencode(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "opencode.db")
    db.execute("create table session (id text, directory text, time_updated int, time_archived int)")
    db.execute("create table message (id text, session_id text, data text, time_created int)")
    db.execute("create table part (message_id text, data text, time_created int)")
    db.executemany("insert into session values (?, '/w', ?, ?)", [("a", 7, None), ("b", 8, 9), ("c", 0, None)])
    db.executemany("insert into message values (?, 'a', ?, ?)", [("m2", '{"role":"assistant"}', 2), ("m1", '{"role":"user"}', 1), ("m3", "bad", 3)])
    tool = lambda **state: json.dumps({"type": "tool", "tool": "sh", "callID": "c", "state": state})
    db.executemany("insert into part values (?, ?, ?)", [("m1", '{"type":"text","text":"hi"}', 1), ("m2", '{"type":"text","content":"yo"}', 1), ("m2", tool(status="completed", input={"a": 1}, output="ok"), 2), ("m2", tool(status="error", error="no"), 3), ("m2", tool(status="running"), 4), ("m2", "bad", 5), ("m3", '{"type":"text","text":"lost"}', 1)])
    db.commit()
    assert [r[2:] for r in got(spark, OpenCodeLogs((str(tmp_path / "opencode.db"),)))] == [
        ("user_input", "hi", False), ("assistant", "yo", False), ("tool_call", 'sh: {"a":1}', False), ("tool_result", "ok", False), ("tool_call", "sh: {}", False), ("tool_result", "ERROR: no", True), ("tool_call", "sh: {}", False),
    ]


CASES = [
    ({"item_type": "tool_call", "tool_call": {"name": "gh"}}, "tool_call", "gh: ", "gh", False),
    ({"item_type": "user_input", "text": "flat"}, "user_input", "flat", None, False),
    ({"item_type": "odd", "content": "c", "tool": "t"}, "unknown", "c", "t", False),
    ({"output": "o", "exit_code": 3}, "unknown", "o", None, True),
    ({"output": 5, "exit_code": 0}, "unknown", '{"exit_code":0,"output":5}', None, False),
    ({"error": None}, "unknown", '{"error":null}', None, True),
    ({"error": "e"}, "unknown", "ERROR: e", None, True),
    ({"status": "failed", "tool": 5, "name": "n"}, "unknown", '{"name":"n","status":"failed","tool":5}', None, True),
    ({"item_type": "tool_result", "tool_result": {"content": "x", "is_error": "true"}}, "tool_result", "x", None, False),
    ({"item_type": "assistant_turn", "turn": {"text": "t"}}, "assistant_turn", "t", None, False),
    ("plain", "unknown", "plain", None, False),
    (None, "unknown", "", None, False),
]


@pytest.mark.parametrize("case", CASES, ids=str)
def test_accessors(spark, case):
    d = F.parse_json(F.lit(json.dumps(case[0])))
    r = spark.range(1).select(T.turn_type(d), T.text_content(d), T.tool_name(d), T.is_error(d)).first()
    assert tuple(r) == case[1:]


def test_filters_reach_sqlite(spark, tmp_path):
    paths = []
    for n in range(2):
        path = tmp_path / f"{n}.db"
        with sqlite3.connect(path) as db:
            db.execute("create table messages (session_id text, role text, parts text, created_at int)")
            db.executemany("insert into messages values (?, 'user', 'x', ?)", [(f"s{i % 40}", i) for i in range(400)])
        paths.append(str(path))
    rows = sqlite_query(spark, paths, "messages", "session_id string, created_at long, row long")
    chosen = rows.where(F.col("session_id").isin([f"s{i}" for i in range(12)]) & (F.col("created_at") >= 40) & ~(F.col("created_at") == 41) & (F.col("db") == 1))
    plan = spark._jvm.PythonSQLUtils.explainString(chosen._jdf.queryExecution(), "formatted")
    assert "Filter (" not in plan.replace("PushedFilters", "") and "BatchScan" in plan, plan
    kept = [(1, f"s{i % 40}", i, i + 1, None) for i in range(40, 400) if i % 40 < 12 and i != 41]
    assert sorted(tuple(r) for r in chosen.collect()) == sorted(kept)
    reader = SqliteReader(chosen.schema, {"paths": json.dumps(paths), "table": "messages"})
    assert list(reader.pushFilters([In(("session_id",), ("s1", "s2")), EqualTo(("db",), 0), StringContains(("session_id",), "1")])) == [StringContains(("session_id",), "1")]
    (only,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(only)) == 20  # no more than these left the database


def test_a_database_that_cannot_be_read_is_an_error_of_its_sessions(spark, tmp_path):
    (tmp_path / "bad.db").write_text("no database at all")
    rows = sqlite_query(spark, [str(tmp_path / "bad.db")], "messages", "session_id string, row long")
    (row,) = rows.where(F.col("session_id").isin("s1", "s2")).collect()
    assert "bad.db" in row.error and row.session_id is None


def test_folders_of_sessions_are_listed_together(spark, tmp_path, monkeypatch):
    """Folders that Spark has written, one a session, are listed in a bounded number of tasks, and parsed once."""
    from sparklore.sources import logs

    seen, name = [], "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    rows = spark.range(80).selectExpr("concat('s', id, '.jsonl') as session", """concat('{"type": "error", "data": {"message": "m', id, '"}}') as value""")
    rows.repartition(2).write.partitionBy("session").text(str(tmp_path / "logs"))
    before, group = spark.conf.get(name), "listed-together"
    monkeypatch.setattr(logs, "LISTING", 1)
    spark.sparkContext.setJobGroup(group, group)
    try:
        source = logs.CodexLogs(str(tmp_path / "logs"))
        assert source.turns(spark, source.sessions(spark)).count() == 80 and spark.conf.get(name) == before
        tracker = spark.sparkContext.statusTracker()
        for job in tracker.getJobIdsForGroup(group):
            seen += [tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(s)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen and max(seen) < 80


def test_a_task_reads_many_small_logs(spark, tmp_path, monkeypatch):
    """Spark's own weight of a file has a task read 32 of them."""
    from sparklore.sources import logs

    name, group, seen = "spark.sql.files.openCostInBytes", "small-logs", []
    for n in range(400):
        lines(tmp_path / f"s{n}.jsonl", {"type": "error", "data": {"message": f"m{n}"}})
    monkeypatch.setattr(logs, "LISTING", 1)
    before = spark.conf.get(name)
    spark.sparkContext.setJobGroup(group, group)
    try:
        source = CodexLogs(str(tmp_path))
        assert source.turns(spark, source.sessions(spark)).count() == 400 and spark.conf.get(name) == before
        tracker = spark.sparkContext.statusTracker()
        for job in tracker.getJobIdsForGroup(group):
            seen += [tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(s)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen and max(seen) <= 6
