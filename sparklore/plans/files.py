"""Queries over what the library reads and writes: logs of every kind, topic files, versioned tables, a whole pass.

The logs are made from the ``conversations`` table by Spark's tasks, below the shared folder, and read by
the sources.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from dataclasses import replace
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config, DedupePolicy, LoopConfig, PatternConfig
from ..functions import responses as R
from ..functions import text as X
from ..functions.turns import label, unsigned
from ..operators import matching, merge, transcript
from ..shared import checkpointed, file_store, local_path, scratch_path
from ..sources import PROVIDERS
from ..sources.search_index import SearchIndex
from ..sources.tables import GrowingTable, TopicTable
from ..sources.topics import read_markdown, write_markdown
from ..kb import KnowledgeBase
from ..streaming.changes import changed_files
from ..streaming.runner import Store, answers, run_pass, typed
from . import registry as Q
from . import views as V

query = Q.query
#: Projects that conversations are dealt to, rows that a task inserts at a time, and bytes of a log that it writes at a time.
PROJECTS, AT_ONCE, BUFFER = 3, 1000, 1 << 16


def _json(**values) -> Column:
    """A JSON object; strings are literals, as are numbers."""
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.to_json(F.struct(*[column(v).alias(k) for k, v in values.items()]))


def _struct(**values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])



def claude_records() -> Column:
    """The lines of a turn in a log of the first kind."""
    # What a content block lacks is null, and left out of its JSON.
    kinds = {"type": "string", "thinking": "string", "text": "string", "id": "string", "name": "string", "input": "struct<turn:long>"}
    block = lambda **v: _struct(**{k: (v[k] if isinstance(v[k], Column) else F.lit(v[k])) if k in v else F.lit(None).cast(t) for k, t in kinds.items()})
    blocks = F.array(block(type="thinking", thinking="hm"), block(type="text", text=F.col("text")), block(type="tool_use", id="c", name="sh", input=_struct(turn=F.col("turn").cast("long"))))
    results = F.array(_struct(type="tool_result", tool_use_id="c", content=F.array(_struct(type="text", text="done"), _struct(type="text", text=F.col("turn").cast("string"))), is_error=(F.col("turn") % 2 == 1)))
    said = F.array(_json(type="assistant", message=_struct(content=blocks)), _json(type="user", message=_struct(content=results)))
    return F.when(F.col("role") == "user", F.array(_json(type="user", message=_struct(content=F.col("text"))))).when(F.col("role") == "assistant", said).otherwise(F.array(_json(type="system", content=F.col("text"), subtype="error")))


def codex_records() -> Column:
    """The lines of a turn in a log of the second kind."""
    output = F.array(_struct(type="message", content=F.array(_struct(type="output_text", text=F.col("text")))))
    said = F.array(
        _json(type="response.completed", data=_struct(output=output)),
        _json(type="function_call_requested", data=_struct(name="sh", call_id="c", arguments=_struct(turn=F.col("turn")))),
        _json(type="function_call_completed", data=_struct(call_id="c", output=F.concat(F.lit("done\n"), F.col("turn").cast("string")))),
    )
    error = F.array(_json(type="error", data=_struct(message=F.col("text"))))
    return F.when(F.col("role") == "assistant", said).when(F.col("role") == "system", error).otherwise(F.array(_json(type="delta", data=_struct(text=F.col("text")))))


def gemini_message() -> Column:
    """A turn as a message of a document of the third kind."""
    response = _struct(functionResponse=_struct(response=_struct(output=F.concat(F.lit("done\n"), F.col("turn").cast("string")))))
    calls = F.array(_struct(id="c", name="sh", args=_struct(turn=F.col("turn")), result=F.array(response)))
    kind = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "gemini").otherwise("info")
    return _struct(type=kind, content=F.col("text"), toolCalls=F.when(F.col("role") == "assistant", calls))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv, session, turn, role, text): of conversations without an id one."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv"), "turn", "role", "text")


def _name(suffix: str, *folder: str | Column) -> Column:
    """The path of a conversation's log in the ``folder`` that is named by these pieces."""
    return F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in (*folder, "s", F.col("conv"), suffix)])


def _write(rows: DataFrame, root: str, path: Column) -> None:
    """``value`` of the rows (conv, value, and what else sorts them) as lines of a file for each session, at ``path`` below ``root``.

    A task writes its sessions one after the other, in its rows' order. A file is put in its place when it is whole.
    """
    order = [c for c in rows.columns if c not in ("conv", "value")]

    def run(batches):
        store, top = file_store(root)
        folders, lines = set(), (line for b in batches for line in zip(b.column("path").to_pylist(), b.column("value").to_pylist()))
        for name, own in groupby(lines, itemgetter(0)):
            folder = os.path.dirname(f"{top}/{name}")
            if folder not in folders:
                store.create_dir(folder, recursive=True)
                folders.add(folder)
            part = f"{folder}/{uuid.uuid4().hex}.part"
            with store.open_output_stream(part, buffer_size=BUFFER) as out:
                for _, value in own:
                    out.write(f"{value or ''}\n".encode())
            store.move(part, f"{top}/{name}")
        yield pa.RecordBatch.from_pydict({"written": [len(folders)]})

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("path", path).repartition(tasks, "path").sortWithinPartitions("path", *order)
    placed.select("path", "value").mapInArrow(run, "written long").write.format("noop").mode("overwrite").save()


def _databases(rows: DataFrame, root: str, tables: dict[str, str], keys: dict[str, Column]) -> tuple[str, ...]:
    """SQLite files below ``root``, one a task, with ``tables`` (name: columns) from the rows' arrays of structs of those names.

    ``keys`` are further columns of the rows, by which they are dealt and sorted. A file is put in its place when it is whole.
    """
    folder = local_path(root)
    schema = rows.withColumns(keys).schema
    names = list(tables)

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}.db"
        with sqlite3.connect(f"{path}.part") as db:
            for name, columns in tables.items():
                db.execute(f"create table {name} ({columns})")
            for batch in batches:
                for name in names:
                    values = (tuple(v.values()) for held in batch.column(name).to_pylist() for v in held)
                    marks = ", ".join("?" * len(schema[name].dataType.elementType.names))
                    while some := list(islice(values, AT_ONCE)):
                        db.executemany(f"insert into {name} values ({marks})", some)
        db.close()
        os.replace(f"{path}.part", path)
        yield pa.RecordBatch.from_pydict({"path": [path]})

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumns(keys).repartition(tasks, "conv").sortWithinPartitions("conv", *[k for k in keys if k != "conv"])
    return tuple(sorted(r.path for r in placed.select(*names).mapInArrow(run, "path string").collect()))  # one row a task


def crush_databases(rows: DataFrame, root: str) -> tuple[str, ...]:
    """Databases of the fourth kind: sessions, and messages of one or two parts."""
    last = F.col("at") == 1
    project = F.concat(F.lit("/home/p"), (F.col("conv") % PROJECTS).cast("string"))
    name = F.concat(F.lit("s"), F.col("conv").cast("string"))
    said = F.to_json(F.array(_struct(type="text", data=_struct(text=F.col("text")))))
    both = F.concat(F.regexp_replace(said, r"\]$", ","), _json(type="tool_call", data=_struct(id="c", name="sh", input=F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit("}")))), F.lit("]"))
    result = F.to_json(F.array(_struct(type="tool_result", data=_struct(tool_call_id="c", content=F.concat(F.when((F.col("turn") % 2 == 1), "error: ").otherwise("done\n"), F.col("turn").cast("string"))))))
    message = lambda role, parts, created: _struct(session_id=name, role=role, parts=parts, created_at=created)
    spoken = message(F.col("role"), F.when(F.col("role") == "assistant", both).otherwise(said), F.col("turn") * 2)
    messages = F.when(F.col("role") == "assistant", F.array(spoken, message(F.lit("tool"), result, F.col("turn") * 2 + 1))).otherwise(F.array(spoken))
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    sessions = F.when(last, F.array(_struct(id=name, title=project, message_count=F.col("n"), updated_at=F.col("conv")))).otherwise(F.array().cast("array<struct<id:string,title:string,message_count:long,updated_at:long>>"))
    rows = rows.join(sizes, "conv").withColumn("at", (F.col("turn") == F.col("first")).cast("int"))
    tables = {"sessions": "id text, title text, message_count int, updated_at int", "messages": "session_id text, role text, parts text, created_at int"}
    return _databases(rows.select("conv", "turn", sessions.alias("sessions"), messages.alias("messages")), root, tables, {"turn": F.col("turn")})


def opencode_databases(rows: DataFrame, root: str) -> tuple[str, ...]:
    """Databases of the fifth kind: sessions, messages, and parts of messages."""
    name, at = F.concat(F.lit("s"), F.col("conv").cast("string")), F.concat(F.lit("m"), F.col("conv").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    none = F.array().cast("array<struct<id:string,directory:string,time_updated:long,time_archived:long>>")
    session = _struct(id=name, directory=F.concat(F.lit("/home/p"), (F.col("conv") % PROJECTS).cast("string")), time_updated=F.col("conv") + 1, time_archived=F.lit(None).cast("long"))
    failed, done = _struct(status="error", error=F.concat(F.lit("bad "), F.col("turn").cast("string")), output=F.lit(None).cast("string"), input=_struct(turn=F.col("turn"))), _struct(status="completed", error=F.lit(None).cast("string"), output=F.concat(F.lit("done\n"), F.col("turn").cast("string")), input=_struct(turn=F.col("turn")))
    part = lambda data, created: _struct(message_id=at, data=data, time_created=created)
    spoken, call = part(_json(type="text", text=F.col("text")), 1), part(_json(type="tool", tool="sh", callID="c", state=F.when((F.col("turn") % 2 == 1), failed).otherwise(done)), 2)
    sizes = rows.groupBy("conv").agg(F.min("turn").alias("first"))
    rows = rows.join(sizes, "conv").select(
        "conv", "turn", F.when(F.col("turn") == F.col("first"), F.array(session)).otherwise(none).alias("session"),
        F.array(_struct(id=at, session_id=name, data=_json(role=F.col("role")), time_created=F.col("turn"))).alias("message"), F.when(F.col("role") == "assistant", F.array(spoken, call)).otherwise(F.array(spoken)).alias("part"),
    )
    tables = {"session": "id text, directory text, time_updated int, time_archived int", "message": "id text primary key, session_id text, data text, time_created int", "part": "message_id text, data text, time_created int"}
    return _databases(rows, root, tables, {"turn": F.col("turn")})


def _lines(rows: DataFrame, records: Column) -> DataFrame:
    """(conv, turn, line, value): the lines of logs, with some that are no JSON."""
    noise = F.when(F.col("turn") == 0, F.array(F.lit("no json"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    return rows.select("conv", "turn", F.posexplode(F.concat(noise, records)).alias("line", "value"))


def made(spark: SparkSession, sf_dir: str, provider: str):
    """The provider's source over logs of all conversations."""
    root, rows, project = scratch_path(spark, provider), _conversations(spark, sf_dir), F.col("conv") % PROJECTS
    if provider in ("crush", "opencode"):
        return PROVIDERS[provider]((crush_databases if provider == "crush" else opencode_databases)(rows, root))
    if provider == "gemini":
        # One document a session, which is one text.
        messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", gemini_message().alias("m")))), lambda t: t["m"])
        _write(rows.groupBy("conv").agg(F.to_json(F.struct(messages.alias("messages"))).alias("value")), root, _name(".json", "p", project, "/chats/"))
    else:
        folder, records = (("-home-p", project, "/"), claude_records()) if provider == "claude-code" else ((), codex_records())
        _write(_lines(rows, records), root, _name(".jsonl", *folder))
    return PROVIDERS[provider](root)


def turns_sql(dropped: str, system: str, failed: str, said: str = "concat('done', chr(10), turn)", failing: str | None = None) -> str:
    """SQL of the turns of logs: what is said, and after an assistant's text a call and its result."""
    return f"""
with t as (select conv_id, turn, 0 as k, case role when 'user' then 'user_input' when 'assistant' then 'assistant' else {system} end as kind, case when {system} = 'system' and role = 'system' then concat('[error] ', text) else text end as text, {system} = 'system' and role = 'system' as error from conversations where {dropped}
  union all select conv_id, turn, 1, 'tool_call', concat('sh: {{"turn":', turn, '}}'), false from conversations where role = 'assistant'
  union all select conv_id, turn, 2, 'tool_result', case when {failed} then concat('ERROR: ', {failing or said}) else {said} end, {failed} from conversations where role = 'assistant')
select concat('s', conv_id) as session_id, row_number() over (partition by conv_id order by turn, k) as turn_id, kind, text, error from t"""


def _turns(spark: SparkSession, sf_dir: str, provider: str) -> DataFrame:
    source = made(spark, sf_dir, provider)
    sessions = checkpointed(source.sessions(spark))
    return typed(source.turns(spark, sessions)).join(sessions.select("context_id", "session_id"), "context_id").select("session_id", "turn_id", "kind", "text", "error")


@query(turns_sql("true", "'system'", "turn % 2 = 1"))
def provider_claude(spark, sf_dir):
    return _turns(spark, sf_dir, "claude-code")


@query(turns_sql("role <> 'user'", "'system'", "false"))
def provider_codex(spark, sf_dir):
    return _turns(spark, sf_dir, "codex")


@query(turns_sql("role <> 'system'", "'none'", "false"))
def provider_gemini(spark, sf_dir):
    return _turns(spark, sf_dir, "gemini")


@query(turns_sql("role <> 'system'", "'none'", "turn % 2 = 1", failing="concat('error: ', turn)"))
def provider_crush(spark, sf_dir):
    return _turns(spark, sf_dir, "crush")


@query(turns_sql("true", "'assistant'", "turn % 2 = 1", failing="concat('bad ', turn)"))
def provider_opencode(spark, sf_dir):
    return _turns(spark, sf_dir, "opencode")


IDS = Q.LITTLE.replace("substr(h,", "substr(sha256(concat('s', conv_id)),")


@query(f"""with c as (select conv_id, count(*) as n from conversations group by 1), p as (select unnest(['claude-code', 'codex', 'gemini', 'crush', 'opencode']) as provider)
select provider, concat('s', conv_id) as session_id, cast({IDS}::ubigint as varchar) as context_id, case when provider in ('claude-code', 'crush', 'opencode') then concat('/home/p', conv_id % 3) end as project,
  case provider when 'crush' then n when 'opencode' then conv_id + 1 end as head from c cross join p""")
def provider_sessions(spark, sf_dir):
    out = []
    for provider in PROVIDERS:
        rows = made(spark, sf_dir, provider).sessions(spark)
        head = F.col("head_turn_id").cast("long") if provider in ("crush", "opencode") else F.lit(None).cast("long")
        out.append(rows.select(F.lit(provider).alias("provider"), "session_id", F.col("context_id").cast("string").alias("context_id"), "project", head.alias("head")))
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@query(f"""with k as (select * from ({V.TURNS_PLANTED}) t where {Q.RELEVANT}), e as (select context_id, turn_id, {Q.ENTRY} as entry from k),
b as (select *, coalesce(sum(strlen(entry) + 1) over (partition by context_id order by turn_id rows between unbounded preceding and 1 preceding), 0) + strlen(entry) + 2 > 900 as over from e),
c as (select *, max(over::int) over (partition by context_id order by turn_id rows between unbounded preceding and current row) as broken from b)
select context_id, concat('[PROJECT: p', context_id % 3, ']', chr(10), chr(10), coalesce(string_agg(entry || chr(10), '' order by turn_id) filter (broken = 0), ''), case when max(broken) = 1 then chr(10) || '[... transcript truncated ...]' || chr(10) else '' end) as transcript
from c group by context_id""")
def session_transcripts(spark, sf_dir):
    rows = V.view(spark, sf_dir, V.TURNS_PLANTED).withColumns({"tool": F.lit(None).cast("string"), "error": F.contains("text", F.lit("error")), "names_tool": F.lit(False)})
    made_ = transcript.transcripts(rows, 900)
    return made_.select("context_id", transcript.with_project(F.col("transcript"), F.concat(F.lit("p"), F.col("context_id") % 3)).alias("transcript"))


@query(f"""select learning_id, concat('# ', title, chr(10), chr(10), summary, chr(10), chr(10), '## Evidence', chr(10), chr(10), '- ', array_to_string(evidence, chr(10) || '- '), chr(10), chr(10)) as body,
  case when confidence > 0.7 then '0.90' else '0.50' end as confidence from ({Q.LEARNINGS}) l""")
def new_topic_bodies(spark, sf_dir):
    rows = V.view(spark, sf_dir, V.LEARNINGS)
    return rows.select("learning_id", merge.new_body(F.col("title"), F.col("summary"), F.col("evidence")).alias("body"), F.format_string("%.2f", F.col("confidence").cast("double")).alias("confidence"))


@query(f"""with l as ({Q.LEARNINGS}), o as ({Q.match_sql(DedupePolicy())})
select learning_id, case outcome when 'CREATE' then concat('new topic ', topic_hint, ': ', title) when 'APPEND' then concat('added to ', existing_slug, ': ', title) else concat('known from ', existing_slug, ': ', title) end as summary_line from o join l using (learning_id)""")
def outcome_lines(spark, sf_dir):
    return matching.outcome_text(Q._outcomes(spark, sf_dir, "balanced")).select("learning_id", "summary_line")


@query(f"""with o as (select * from ({Q.match_sql(DedupePolicy())}) o join ({Q.LEARNINGS}) l using (learning_id)), t as ({Q.TOPICS}),
n as (select existing_slug as slug, count(*) as n from o where outcome = 'APPEND' group by 1)
select slug, coalesce(n, 0) as insights, true as was_there from t left join n using (slug) union all select distinct {Q.slug_sql('topic_hint')}, 0, false from o where outcome = 'CREATE'""")
def merged_topics(spark, sf_dir):
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    rows = V.view(spark, sf_dir, V.TOPICS)
    none = F.lit(None)
    topics = rows.withColumns({"created": none.cast("timestamp"), "updated": none.cast("timestamp"), "extracted_at": none.cast("timestamp"), "source": none.cast("string"), "confidence": none.cast("string"), "source_context_id": none.cast("decimal(20,0)")})
    topics = topics.select(*[c.split()[0] for c in schemas.TOPICS.split(", ")])
    outcomes = checkpointed(Q._outcomes(spark, sf_dir, "balanced").withColumn("pos", F.col("learning_id")).withColumn("confidence", F.col("confidence").cast("double")))
    got = merge.merged_topics(topics, outcomes, lambda pos: pos, at)
    mark = "\n_Extracted from context "
    return got.select("slug", ((F.length("body") - F.length(F.replace("body", F.lit(mark)))) / len(mark)).cast("long").alias("insights"), F.col("created").isNull().alias("was_there"))


@query(f"select slug, title, array_to_string(aliases, '|') as aliases, array_to_string(tags, '|') as tags, array_to_string(projects, '|') as projects, concat(body, chr(10)) as body from ({Q.TOPICS}) t")
def topics_as_markdown(spark, sf_dir):
    path = scratch_path(spark, "markdown")
    none = F.lit(None)
    empty = {"created": none.cast("timestamp"), "updated": none.cast("timestamp"), "extracted_at": none.cast("timestamp"), "source": none.cast("string"), "confidence": none.cast("string"), "source_context_id": none.cast("decimal(20,0)")}
    write_markdown(V.view(spark, sf_dir, V.TOPICS).withColumns(empty), path)
    back = read_markdown(spark, path)
    joined = [F.array_join(c, "|").alias(c) for c in ("aliases", "tags", "projects")]
    return back.select("slug", "title", *joined, F.concat(F.regexp_replace("body", "\n+$", ""), F.lit("\n")).alias("body"))


@query(Q.ORACLE_SQL["topic_upsert"])
def topic_versions(spark, sf_dir):
    table = TopicTable(spark, scratch_path(spark, "topics"), "slug string, title string")
    rows = V.view(spark, sf_dir, V.TOPICS).select("slug", "title")
    table.replace(rows)
    for piece in (F.col("slug") < "h", (F.col("slug") >= "h") & (F.col("slug") < "p")):
        changed = rows.where(piece).select(F.when(F.col("slug") < "h", F.col("slug")).otherwise(F.concat("slug", F.lit("-new"))).alias("slug"), F.upper("title").alias("title"))
        table.apply(changed)
    return table.read()


CHANGED = f"select case when slug < 'h' then slug else concat(slug, '-new') end as slug, concat('Red ', title) as title, aliases, tags, projects, body from ({Q.TOPICS}) t where slug < 'h' union all select * from ({Q.TOPICS}) t where slug >= 'h' and slug < 'p'"


@query(f"""with r as (select *, row_number() over (partition by query_id order by score desc, slug) as k from ({Q.ORACLE_SQL["topic_search_batch"].replace(f"({Q.TOPICS})", f"({CHANGED})")}) s) select query_id, slug, score from r where k <= 7""")
def topic_search_index(spark, sf_dir):
    """The best seven topics of each query from a stored index, after topics were changed and taken away."""
    table, index = TopicTable(spark, scratch_path(spark, "topics")), SearchIndex(spark, scratch_path(spark, "search"))
    none = F.lit(None)
    empty = {"created": none.cast("timestamp"), "updated": none.cast("timestamp"), "extracted_at": none.cast("timestamp"), "source": none.cast("string"), "confidence": none.cast("string"), "source_context_id": none.cast("decimal(20,0)")}
    rows = V.view(spark, sf_dir, V.TOPICS).withColumns(empty)
    table.replace(rows)
    index.sync(table)
    table.apply(rows.where("slug < 'h'").withColumn("title", F.concat(F.lit("Red "), F.col("title"))), rows.where("slug >= 'p'").select("slug"))
    index.sync(table)
    return index.search(Q.search_queries(spark, sf_dir), 7)


@query(f"select context_id, case when context_id % 2 = 0 then head_turn_id else head_turn_id + 1 end as head_turn_id from ({V.SESSIONS}) s")
def session_heads(spark, sf_dir):
    store = Store(spark, scratch_path(spark, "state"))
    rows = V.view(spark, sf_dir, V.SESSIONS).select(F.col("context_id").cast("decimal(20,0)").alias("context_id"), F.col("head_turn_id").cast("decimal(20,0)").alias("head_turn_id"))
    store.processed.append(rows.withColumn("head_turn_id", (F.col("head_turn_id") + 1).cast("decimal(20,0)")).withColumn("pass", F.lit(1).cast("long")))
    store.processed.append(rows.where("context_id % 2 = 0").withColumn("pass", F.lit(2).cast("long")))
    return store.heads().select(F.col("context_id").cast("long").alias("context_id"), F.col("head_turn_id").cast("long").alias("head_turn_id"))


@query(f"select distinct {Q.slug_sql('source')} as hash from documents")
def known_hashes(spark, sf_dir):
    table = GrowingTable(spark, scratch_path(spark, "hashes"), schemas.HASHES)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(X.slug(F.col("source")).alias("hash"), "doc_id")
    for k in range(3):
        table.append(rows.where(F.col("doc_id") % 3 == k).select("hash").distinct())
    table.compact()
    return table.read()


@query("""select doc_id, concat('Session ', doc_id, '. What was learned in it? Its transcript:', chr(10), chr(10), case when doc_id % 2 = 0 then concat('[PROJECT: ', source, ']', chr(10), chr(10)) else '' end, text) as prompt from documents""")
def extraction_prompts(spark, sf_dir):
    project = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", R.extraction_prompt(F.col("doc_id"), transcript.with_project(F.col("text"), project)).alias("prompt"))


RAW_ID = "case doc_id % 5 when 0 then cast(doc_id as string) when 1 then '' when 2 then '18446744073709551615' when 3 then lang else concat('-', cast(doc_id as string)) end"


@query("""select doc_id, case doc_id % 5 when 0 then cast(doc_id as varchar) when 2 then '18446744073709551615' end as id, case when doc_id % 3 = 0 then lang else source end as label from documents""")
def ids_and_labels(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    title = F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    return rows.select("doc_id", unsigned(F.expr(RAW_ID)).cast("string").alias("id"), label(title, F.col("source")).alias("label"))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(context_id, conv, response): an answer with a learning of its own for the session of every conversation."""
    text = F.concat(F.lit('{"context_id": 1, "learnings": [{"topic_hint": "tool '), F.col("conv").cast("string"), F.lit('", "title": "T'), F.col("conv").cast("string"), F.lit('", "summary": "s", "confidence": 0.9}]}'))
    session = F.concat(F.lit("s"), F.col("conv").cast("string"))
    return _conversations(spark, sf_dir).select("conv").distinct().select(X.context_id(session).alias("context_id"), "conv", text.alias("response"))


def _all_sessions() -> Config:
    return replace(Config(), loop=LoopConfig(context_limit=2**31 - 1, patterns=PatternConfig(enabled=False)))


@query("""with c as (select conv_id, count(*) filter (role in ('assistant', 'system')) > 0 as said from conversations group by 1)
select count(*) as sessions, count(*) filter (said and conv_id % 5 = 0) as failed, count(*) filter (said and conv_id % 5 <> 0) as topics_created, 0::bigint as topics_updated, 0::bigint as duplicates_skipped,
  count(*) filter (not (said and conv_id % 5 = 0)) as processed, count(*) filter (said and conv_id % 5 <> 0) as topics from c""")
def whole_pass(spark, sf_dir):
    """A pass over all conversations as logs; every fifth session gets no answer, and stays."""
    source, store = made(spark, sf_dir, "codex"), Store(spark, scratch_path(spark, "pass"))
    done = run_pass(spark, source, store, _all_sessions(), answers(_told(spark, sf_dir).where("conv % 5 <> 0").select("context_id", "response")))
    totals = done.totals().select("sessions", "failed", "topics_created", "topics_updated", "duplicates_skipped")
    return totals.withColumns({"processed": F.lit(store.heads().count()).cast("long"), "topics": F.lit(store.topics.read().count()).cast("long")})


@query("""with c as (select conv_id, count(*) filter (role in ('assistant', 'system')) > 0 as said from conversations group by 1)
select concat('T', conv_id) as title, 'CREATE' as outcome, 0::bigint as stored from c where said and conv_id % 5 <> 0""")
def dry_pass(spark, sf_dir):
    """What a pass would do, and the topics that there are after it."""
    source, store = made(spark, sf_dir, "codex"), Store(spark, scratch_path(spark, "pass"))
    done = run_pass(spark, source, store, _all_sessions(), answers(_told(spark, sf_dir).where("conv % 5 <> 0").select("context_id", "response")), dry_run=True)
    return done.outcomes.select("title", "outcome", F.lit(store.topics.read().count() + store.heads().count()).cast("long").alias("stored"))


@query(f"""select (select count(*) from ({Q.TOPICS}) t) as topics, (select count(*) from ({V.SESSIONS}) s) as processed, (select count(distinct source) from documents) as extraction_hashes, (select count(distinct lang) from documents) as pattern_hashes""")
def state_sizes(spark, sf_dir):
    kb = KnowledgeBase(spark, scratch_path(spark, "state"))
    none = F.lit(None)
    empty = {"created": none.cast("timestamp"), "updated": none.cast("timestamp"), "extracted_at": none.cast("timestamp"), "source": none.cast("string"), "confidence": none.cast("string"), "source_context_id": none.cast("decimal(20,0)")}
    kb.upsert(V.view(spark, sf_dir, V.TOPICS).withColumns(empty).withColumn("aliases", F.array().cast("array<string>")))
    heads = V.view(spark, sf_dir, V.SESSIONS).select(F.col("context_id").cast("decimal(20,0)").alias("context_id"), F.col("head_turn_id").cast("decimal(20,0)").alias("head_turn_id"))
    for n in range(2):
        kb.store.processed.append(heads.withColumn("pass", F.lit(n).cast("long")))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for table, column in ((kb.store.extracted, "source"), (kb.store.patterns, "lang")):
        table.append(documents.select(F.col(column).alias("hash")).distinct())
        table.append(documents.select(F.col(column).alias("hash")).distinct())
    return spark.createDataFrame([tuple(kb.status().values())], ", ".join(f"{k} long" for k in kb.status()))


@query("select concat('s', conv_id) as session_id, 1 + max((conv_id % 5 = 0)::int) as changes from conversations group by conv_id")
def changed_logs(spark, sf_dir):
    """How often each log has come by the stream of changed files: once, and again where it grew between two runs of the query."""
    root, out = made(spark, sf_dir, "codex").root, scratch_path(spark, "changes")
    rows = _conversations(spark, sf_dir).where(F.col("conv") % 5 == 0)
    more = rows.groupBy("conv").agg((F.max("turn") + 1).alias("turn"), F.lit(0).alias("line"), F.min("text").alias("value"))
    for grown in (False, True):
        if grown:
            _write(_lines(rows, codex_records()).unionByName(more), root, _name(".jsonl"))
        stream = changed_files(spark, [root], f"{out}/snapshots", [".jsonl"], quiet=0)
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    session = F.regexp_extract("path", r"/(s-?\d+)\.jsonl$", 1)
    return spark.read.parquet(f"{out}/rows").groupBy(session.alias("session_id")).agg(F.count("*").cast("int").alias("changes"))
