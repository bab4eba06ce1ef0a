"""Queries by name, each a function of (spark, sf_dir), and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DedupePolicy, Regime, TitleMode
from ..functions import blocks as B
from ..functions import responses as R
from ..functions import text as X
from ..operators import discovery, matching, merge, patterns, search, topics, transcript
from ..operators.ordered import running_sum
from ..shared import checkpointed
from . import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- turns and discovery -------------------------------------------------------------------------

EVENT_KIND = "case event_type when 'view' then 'tool_call' when 'click' then 'tool_result' when 'error' then 'tool_result' when 'signup' then 'user_input' else 'assistant' end"
EVENT_TEXT = "case event_type when 'view' then concat('view: ', props) when 'error' then concat('ERROR: ', props) else props end"


@query(f"select user_id as context_id, row_number() over (partition by user_id order by ts, event_id) as turn_id, {EVENT_KIND} as kind from events")
def turns_normalized(spark, sf_dir):
    rows = V.typed_events(spark, sf_dir)
    placed = running_sum(rows, "context_id", F.unix_seconds(F.col("ts").cast("timestamp")), ["ts", "event_id"], F.lit(1), "before", span=3600)
    return placed.select("context_id", (F.col("before") + 1).cast("long").alias("turn_id"), "kind")


@query(f"select event_id, {EVENT_TEXT} as text, case when event_type = 'view' then 'view' end as tool from events")
def turn_text(spark, sf_dir):
    return V.typed_events(spark, sf_dir).select("event_id", "text", "tool")


@query("select event_id, event_type = 'error' as is_error from events")
def turn_is_error(spark, sf_dir):
    return V.typed_events(spark, sf_dir).select("event_id", F.col("error").alias("is_error"))


def _discover(spark, sf_dir, pick):
    chosen = pick(V.view(spark, sf_dir, V.SESSIONS), V.view(spark, sf_dir, V.STATE), 20)
    return chosen.select("context_id", "session_id", "head_turn_id")


@query(f"select context_id, session_id, head_turn_id from (select * from ({V.SESSIONS}) s order by modified desc, session_id limit 20) n where not exists (select 1 from ({V.STATE}) t where t.context_id = n.context_id and t.head_turn_id = n.head_turn_id)")
def sessions_limit_then_filter(spark, sf_dir):
    return _discover(spark, sf_dir, discovery.limit_then_filter)


@query(f"select context_id, session_id, head_turn_id from ({V.SESSIONS}) n where not exists (select 1 from ({V.STATE}) t where t.context_id = n.context_id and t.head_turn_id = n.head_turn_id) order by modified desc, session_id limit 20")
def sessions_filter_then_limit(spark, sf_dir):
    return _discover(spark, sf_dir, discovery.filter_then_limit)


# --- transcripts ---------------------------------------------------------------------------------


def any_of(column: str, phrases) -> str:
    return "(" + " or ".join(f"contains({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


RELEVANT = f"case kind when 'system' then contains(text, 'error') when 'assistant' then {any_of('lower(text)', transcript.AGENT_WORDS)} else {any_of('lower(text)', transcript.USER_WORDS)} end"


@query(f"select context_id, turn_id, text from ({V.TURNS_PLANTED}) t where {RELEVANT}")
def relevant_turns(spark, sf_dir):
    rows = V.view(spark, sf_dir, V.TURNS_PLANTED)
    return rows.where(transcript.is_relevant(F.col("kind"), F.col("text"), F.contains("text", F.lit("error")))).select("context_id", "turn_id", "text")


BUDGET = 3000


def lines_sql(text: str) -> str:
    """SQL of a text cut to its first and last 15 lines."""
    raw = f"string_split({text}, chr(10))"
    lines = f"list_transform(case when {raw}[-1] = '' then {raw}[:-2] else {raw} end, lambda x: regexp_replace(x, '\\r$', ''))"
    return f"case when len({lines}) <= 30 then {text} else array_to_string(list_concat({lines}[:15], ['[... ' || (len({lines}) - 30)::varchar || ' lines omitted ...]'], {lines}[-15:]), chr(10)) end"


PREFIX = "case kind when 'user_input' then '[USER]' when 'assistant' then '[ASSISTANT]' else '[SYSTEM]' end"
ENTRY = f"{PREFIX} || case when {lines_sql('text')} = '' then '' else ' ' || {lines_sql('text')} end"


@query(f"""
with e as (select context_id, turn_id, {ENTRY} as entry from ({V.TURNS_CONVERSATIONS}) t),
b as (select *, coalesce(sum(strlen(entry) + 1) over (partition by context_id order by turn_id rows between unbounded preceding and 1 preceding), 0) + strlen(entry) + 2 > {BUDGET} as over from e),
c as (select *, max(over::int) over (partition by context_id order by turn_id rows between unbounded preceding and current row) as broken from b)
select context_id, coalesce(string_agg(entry || chr(10), '' order by turn_id) filter (broken = 0), '') || case when max(broken) = 1 then chr(10) || '[... transcript truncated ...]' || chr(10) else '' end as transcript, max(broken) = 1 as truncated
from c group by context_id""")
def transcript_budget(spark, sf_dir):
    rows = V.view(spark, sf_dir, V.TURNS_CONVERSATIONS)
    entries = rows.select("context_id", "turn_id", transcript.entry(F.col("kind"), F.col("text"), F.lit(None).cast("string")).alias("entry"))
    return transcript.within_budget(entries, "context_id", "turn_id", BUDGET)


@query(f"select doc_id, {lines_sql('text')} as text from documents")
def truncate_lines(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.truncate_lines(F.col("text")).alias("text"))


@query(f"select context_id, turn_id, {ENTRY} as entry from ({V.TURNS_CONVERSATIONS}) t")
def format_turns(spark, sf_dir):
    rows = V.view(spark, sf_dir, V.TURNS_CONVERSATIONS)
    return rows.select("context_id", "turn_id", transcript.entry(F.col("kind"), F.col("text"), F.lit(None).cast("string")).alias("entry"))


# --- scalars -------------------------------------------------------------------------------------

LITTLE = "concat(" + ", ".join(["'0x'", *[f"substr(h, {15 - 2 * i}, 2)" for i in range(8)]]) + ")"


@query(f"select doc_id, cast({LITTLE}::ubigint as varchar) as context_id from (select doc_id, sha256(text) as h from documents) d")
def context_hash_id(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.context_id(F.col("text")).cast("string").alias("context_id"))


@query("select doc_id, sha256(concat(lower(source), '|', lower(lang), '|', lower(text))) as content_hash, sha256(concat(lower(text), '|repeated-instruction')) as cluster_hash from documents")
def hashes(spark, sf_dir):
    made = X.content_hash(F.col("source"), F.col("lang"), F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", made.alias("content_hash"), X.cluster_hash(F.col("text"), F.lit(patterns.INSTRUCTION)).alias("cluster_hash"))


def slug_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"select doc_id, {slug_sql('text')} as slug from documents")
def slugs(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.slug(F.col("text")).alias("slug"))


CANDIDATE = "case doc_id % 7 when 0 then '' when 1 then '-a' when 2 then 'a/b' when 3 then source when 4 then concat(source, '-x') when 5 then lower(text) else concat(lang, cast(doc_id as string)) end"


@query(f"""select doc_id, case when s = '' then 'empty' when strlen(s) > 128 then 'too long' when regexp_matches(s, '[./\\\\]') then 'path traversal' when starts_with(s, '-') or ends_with(s, '-') then 'edge hyphen'
  when regexp_matches(s, '[^a-z0-9-]') then 'invalid character' end as error from (select doc_id, {CANDIDATE} as s from documents) d""")
def slug_validation(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.slug_error(F.expr(CANDIDATE)).alias("error"))


def scrub_sql(text: str) -> str:
    for pattern, label in X.SECRET_PATTERNS:
        p = pattern.replace("(?iU)", "(?i)").replace("'", "''")
        text = f"regexp_replace({text}, '{p}', '{label.replace('$1', chr(92) + '1')}', 'g')"
    return text


@query(f"select doc_id, {scrub_sql('text')} as text from ({V.SECRETS}) d")
def scrubbed(spark, sf_dir):
    return V.view(spark, sf_dir, V.SECRETS).select("doc_id", X.scrub(F.col("text")).alias("text"))


@query("select doc_id, (" + " or ".join("regexp_matches(text, '" + p.replace("(?iU)", "(?i)").replace("'", "''") + "')" for p, _ in X.SECRET_PATTERNS) + f") as found from ({V.SECRETS}) d")
def contains_secret(spark, sf_dir):
    return V.view(spark, sf_dir, V.SECRETS).select("doc_id", X.contains_secret(F.col("text")).alias("found"))


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: strlen(w) >= 3)"


@query(f"select doc_id, array_to_string({tokens_sql('text')}, ' ') as tokens from documents")
def tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


def cut_sql(x: str) -> str:
    """SQL of the longest start of at most 200 bytes, by the longest of 200 starts that fits."""
    return f"(select max_by(left({x}, k::int), k) from range(1, 201) r(k) where strlen(left({x}, k::int)) <= 200)"


@query(f"select doc_id, case when strlen(text) <= 200 then text else {cut_sql('text')} end as text from documents")
def truncate_bytes(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.truncate_bytes(F.col("text"), 200).alias("text"))


# --- messages and patterns -----------------------------------------------------------------------


@query(f"select context_id, turn_id, len({tokens_sql('text')})::int as n from ({V.TURNS_CONVERSATIONS}) t where kind = 'user_input' and len({tokens_sql('text')}) >= 3")
def user_messages(spark, sf_dir):
    return patterns.user_messages(V.view(spark, sf_dir, V.TURNS_CONVERSATIONS)).select("context_id", "turn_id", F.size("tokens").alias("n"))


PRECEDING = "last_value(case when kind = 'assistant' and trim(text) <> '' then text end ignore nulls) over (partition by context_id order by turn_id rows between unbounded preceding and 1 preceding)"


@query(f"""select context_id, turn_id, text, coalesce(case when strlen(a) <= 200 then a else {cut_sql('a')} || '...' end, '') as agent_action
  from (select *, {PRECEDING} as a from ({V.TURNS_PLANTED}) t) u where kind = 'user_input' and {any_of('lower(text)', patterns.CORRECTIONS)}""")
def corrections(spark, sf_dir):
    return patterns.corrections(V.view(spark, sf_dir, V.TURNS_PLANTED))


def _messages(spark, sf_dir):
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("idx"), F.col("doc_id").alias("context_id"), "text", X.tokens(F.col("text")).alias("tokens"))


THRESHOLD = 0.4
SETS = f"t as (select doc_id as idx, list_sort(list_distinct({tokens_sql('text')})) as s from documents), r as (select s, min(idx) as idx from t where len(s) > 0 group by s)"
PAIRS = f"""{SETS}, e as (select idx, unnest(s) as tok, len(s) as n from r),
p as (select a.idx as i, b.idx as j, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) as sim from e a join e b on a.tok = b.tok and a.idx < b.idx group by a.idx, b.idx having sim >= {THRESHOLD})"""


@query(f"with {PAIRS} select i, j, round(sim, 6) as similarity from p")
def similar_pairs(spark, sf_dir):
    return patterns.similar_pairs(_messages(spark, sf_dir), THRESHOLD).select("i", "j", F.round("similarity", 6).alias("similarity"))


@query(f"with {SETS} select t.idx, coalesce(r.idx, t.idx) as rep from t left join r on t.s = r.s")
def similar_classes(spark, sf_dir):
    return patterns.classes(_messages(spark, sf_dir))


LEADERS = f"""{PAIRS}, m as (select t.idx, coalesce(r.idx, t.idx) as rep from t left join r on t.s = r.s),
q as (select rep, row_number() over (order by rep) as k from (select distinct rep from m) x),
adj as (select j, list(i order by i) as earlier from p group by j),
w(k, led) as (select 0::bigint, []::bigint[] union all select q.k, case when list_has_any(coalesce(adj.earlier, []), w.led) then w.led else list_append(w.led, q.rep) end from w join q on q.k = w.k + 1 left join adj on adj.j = q.rep),
f as (select arg_max(led, k) as led from w),
l as (select q.rep, case when list_contains(f.led, q.rep) then q.rep else list_min(list_intersect(adj.earlier, f.led)) end as leader from q cross join f left join adj on adj.j = q.rep),
g as (select m.idx, l.leader from m join l on m.rep = l.rep)"""


@query(f"with recursive {LEADERS} select idx, leader from g")
def leader_clusters(spark, sf_dir):
    return patterns.leaders(_messages(spark, sf_dir), THRESHOLD)


CLUSTERS = f"""{LEADERS}, c as (select leader, count(*) as n, any_value(d.text) filter (d.doc_id = leader) as representative from g join documents d on d.doc_id = g.idx group by leader having count(*) >= 3),
h as (select *, sha256(concat(lower(representative), '|repeated-instruction')) as content_hash from c)"""


def _clusters(spark, sf_dir):
    return patterns.clusters(_messages(spark, sf_dir), patterns.INSTRUCTION, THRESHOLD, 3)


@query(f"with recursive {CLUSTERS} select leader, n, representative, content_hash from h order by n desc, leader limit 5")
def top_clusters(spark, sf_dir):
    return patterns.largest(_clusters(spark, sf_dir), 5).select("leader", "n", "representative", "content_hash")


@query(f"with recursive {CLUSTERS} select leader, n, content_hash from h where leader % 2 = 1")
def novel_clusters(spark, sf_dir):
    found = checkpointed(_clusters(spark, sf_dir))
    return patterns.novel(found, found.where("leader % 2 = 0")).select("leader", "n", "content_hash")


@query(f"""with recursive {LEADERS}, c as (select leader, count(*) as n, count(distinct doc_id % 7) as contexts, any_value(d.text) filter (d.doc_id = leader) as representative from g join documents d on d.doc_id = g.idx group by leader)
select leader, n, contexts, sha256(concat(lower(representative), '|repeated-correction')) as content_hash from c where n >= 2 and contexts >= 2""")
def correction_clusters(spark, sf_dir):
    messages = _messages(spark, sf_dir).withColumn("context_id", F.col("context_id") % 7)
    return patterns.clusters(messages, patterns.CORRECTION, THRESHOLD, 2, 2).select("leader", "n", "contexts", "content_hash")


@query("select distinct doc_id % 1009 as context_id from documents")
def cluster_contexts(spark, sf_dir):
    rows = _documents(spark, sf_dir).groupBy(F.expr("doc_id div 4").alias("leader")).agg(F.collect_list(F.struct((F.col("doc_id") % 1009).alias("context_id"))).alias("occurrences"))
    return patterns.contexts(rows)


@query(f"""with a as (select context_id, session_id, head_turn_id, modified, context_id % 3 as place from ({V.SESSIONS}) x)
select context_id, place from a anti join ({V.STATE}) t using (context_id, head_turn_id) where head_turn_id <> 0 order by place, modified desc, session_id limit 20""")
def sessions_by_place(spark, sf_dir):
    """Sessions of several databases: those of the first come first, then the newest."""
    sessions = V.view(spark, sf_dir, V.SESSIONS).withColumn("place", F.col("context_id") % 3)
    return discovery.filter_then_limit(sessions, V.view(spark, sf_dir, V.STATE), 20).select("context_id", "place")


@query("""with c as (select doc_id, case doc_id % 3 when 0 then text when 1 then concat(text, chr(10), 'Current topics: ', source) else concat('Current topics: ', source, ', ', lang, ', ', doc_id, chr(10), text) end as content from documents)
select doc_id, case when regexp_matches(content, '(?m)^Current topics: ') then len(string_split(regexp_extract(content, '(?m)^Current topics: (.*)$', 1), ', ')) else 0 end::int as topics from c""")
def block_topic_counts(spark, sf_dir):
    line = lambda *parts: F.concat(F.lit(B.LISTED), F.concat_ws(", ", *parts))
    content = F.expr("doc_id % 3")
    content = F.when(content == 0, F.col("text")).when(content == 1, F.concat("text", F.lit("\n"), line("source"))).otherwise(F.concat(line("source", "lang", F.col("doc_id").cast("string")), F.lit("\n"), F.col("text")))
    return _documents(spark, sf_dir).select("doc_id", B.topic_count(content).alias("topics"))


# --- topics and search ---------------------------------------------------------------------------

TOPICS = V.duck(V.TOPICS)
LEARNINGS = V.duck(V.LEARNINGS)
TERMS = "red small widget bolt economy notes small"


def score_sql(term: str) -> str:
    each = lambda c: f"len(list_filter({c}, lambda x: contains(lower(x), {term})))"
    return f"(10 * contains(slug, {term})::int + 10 * contains(lower(title), {term})::int + 7 * {each('aliases')} + 5 * {each('tags')} + 2 * contains(lower(body), {term})::int)"


@query("select slug, score::int as score from (select slug, " + " + ".join(score_sql(f"'{t}'") for t in TERMS.split()) + f" as score from ({TOPICS}) t) u where score > 0")
def topic_search(spark, sf_dir):
    return search.search(V.view(spark, sf_dir, V.TOPICS), TERMS).select("slug", "score")


@query(f"select n_nationkey as query_id, slug, sum({score_sql('term')})::int as score from (select n_nationkey, unnest(string_split(lower(concat(n_name, ' ', case n_nationkey % 3 when 0 then 'Red gear' when 1 then 'LARGE Brand#1' else 'bolt bolt' end)), ' ')) as term from nation) q cross join ({TOPICS}) t group by 1, 2 having score > 0")
def topic_search_batch(spark, sf_dir):
    return search.search_all(search_queries(spark, sf_dir), V.view(spark, sf_dir, V.TOPICS))


def search_queries(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    text = F.expr("concat(n_name, ' ', case n_nationkey % 3 when 0 then 'Red gear' when 1 then 'LARGE Brand#1' else 'bolt bolt' end)")
    return nation.select(F.col("n_nationkey").alias("query_id"), text.alias("query"))


@query(f"select distinct lower(tag) as tag from (select unnest(tags) as tag from ({TOPICS}) t) u")
def tag_vocabulary(spark, sf_dir):
    return search.tag_vocabulary(V.view(spark, sf_dir, V.TOPICS))


@query(f"select slug, title, array_to_string(aliases, '|') as aliases, array_to_string(tags, '|') as tags from ({TOPICS}) t")
def topic_index(spark, sf_dir):
    return topics.index(V.view(spark, sf_dir, V.TOPICS)).select("slug", "title", F.array_join("aliases", "|").alias("aliases"), F.array_join("tags", "|").alias("tags"))


NAMES = f"select distinct topic_hint as name from ({LEARNINGS}) l union select concat(upper(p_name), ' ', p_brand) from part union select p_brand from part"


@query(f"""with t as ({TOPICS}), n as ({NAMES}), m as (select name, slug, 0 as pri from n join t on slug = {slug_sql('name')} union all select name, slug, 1 from n join (select slug, unnest(aliases) as a from t) x on lower(a) = lower(name))
select name, slug from m qualify row_number() over (partition by name order by pri, slug) = 1""")
def topic_lookup(spark, sf_dir):
    V.tables(spark, sf_dir, "part", "documents", "labels")
    names = V.view(spark, sf_dir, f"select distinct topic_hint as name from ({V.LEARNINGS}) l union select concat(upper(p_name), ' ', p_brand) from part union select p_brand from part")
    return topics.lookup(names, V.view(spark, sf_dir, V.TOPICS))


NEW = "select slug, case when slug < 'm' then list_value(concat('x ', slug), aliases[2]) else list_value(replace(slug, '-', ' '), concat(title, 's')) end as aliases from t"
OTHERS = "select concat(slug, '-2') as slug, aliases from new"


@query(f"""with t as ({TOPICS}), new as ({NEW}), w as (select slug, unnest(aliases) as alias from ({OTHERS}) o), k as (select slug as other, unnest(aliases) as a from t)
select distinct slug, alias, other_slug from (select w.slug, alias, t.slug as other_slug from w join t on t.slug = {slug_sql('alias')} union all select w.slug, alias, other from w join k on lower(a) = lower(alias)) x where slug <> other_slug""")
def alias_collisions(spark, sf_dir):
    rows = V.view(spark, sf_dir, V.TOPICS)
    made = F.when(F.col("slug") < "m", F.array(F.concat(F.lit("x "), "slug"), F.col("aliases")[1])).otherwise(F.array(F.replace("slug", F.lit("-"), F.lit(" ")), F.concat("title", F.lit("s"))))
    return topics.alias_collisions(rows.select(F.concat("slug", F.lit("-2")).alias("slug"), made.alias("aliases")), rows)


CHANGED = "select case when slug < 'h' then slug else concat(slug, '-new') end as slug, upper(title) as title from ({t}) t where slug < 'p'"


@query(f"select slug, title from ({TOPICS}) t where slug not in (select slug from ({CHANGED.format(t=TOPICS)}) c) union all {CHANGED.format(t=TOPICS)}")
def topic_upsert(spark, sf_dir):
    rows = V.view(spark, sf_dir, V.TOPICS).select("slug", "title")
    changed = rows.where("slug < 'p'").select(F.when(F.col("slug") < "h", F.col("slug")).otherwise(F.concat("slug", F.lit("-new"))).alias("slug"), F.upper("title").alias("title"))
    return topics.upsert(rows, changed)


@query(f"select slug, title from ({TOPICS}) t where slug not in (select {slug_sql('topic_hint')} from ({LEARNINGS}) l where learning_id % 12 = 0)")
def topic_delete(spark, sf_dir):
    rows = V.view(spark, sf_dir, V.TOPICS).select("slug", "title")
    gone = V.view(spark, sf_dir, V.LEARNINGS).where("learning_id % 12 = 0").select(X.slug(F.col("topic_hint")).alias("slug"))
    return topics.delete(rows, gone)


# --- matching ------------------------------------------------------------------------------------


def parts_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, '-'), lambda w: w <> ''))"


def jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both} / nullif(len({a}) + len({b}) - {both}, 0), 0)"


def covered_sql(threshold: float) -> str:
    words = "list_filter(string_split_regex(lower(summary), '\\s+'), lambda w: strlen(w) >= 4)"
    return f"(contains(lower(body), lower(title)) or coalesce(len(list_filter({words}, lambda w: contains(lower(body), w))) / nullif(len({words}), 0) > {threshold}, false))"


def match_sql(policy: DedupePolicy) -> str:
    spaced, lower = "replace(hint_slug, '-', ' ')", "lower(t.title)"
    contains = f"contains({lower}, {spaced}) or contains({spaced}, replace({lower}, ' ', '-'))"
    title = {TitleMode.EXACT: f"{slug_sql('t.title')} = hint_slug", TitleMode.CONTAINS: contains, TitleMode.FUZZY: f"{contains} or {jaccard_sql(parts_sql(slug_sql('t.title')), parts_sql('hint_slug'))} >= {policy.title_similarity}"}[policy.title_mode]
    affinity = "(contains(t.slug, hint_slug) or contains(hint_slug, t.slug))" if policy.require_slug_affinity else "true"
    overlap = "len(list_filter(t.tags, lambda x: list_contains(ltags, lower(x))))"
    near = f"when j >= {policy.tag_jaccard_threshold} then 5" if policy.tag_jaccard_threshold < 1 else ""
    j = jaccard_sql("list_distinct(ltags)", "list_distinct(list_transform(t.tags, lambda x: lower(x)))")
    return f"""
with l as (select *, {slug_sql('topic_hint')} as hint_slug, list_transform(tags, lambda x: lower(x)) as ltags from ({LEARNINGS}) x), t as ({TOPICS}),
c as (select learning_id, t.slug, hint_slug, {j} as j, case when t.slug = hint_slug then 1 when list_contains(list_transform(t.aliases, lambda x: lower(x)), lower(topic_hint)) then 2 when {title} then 3
  when {overlap} >= {policy.tag_overlap_minimum} and {affinity} then 4 end as s from l cross join t),
d as (select learning_id, slug, j, case when s is not null then s {near} end as stage from c),
m as (select * from d where stage is not null qualify row_number() over (partition by learning_id order by stage, case when stage = 5 then j else 0 end desc, slug) = 1)
select l.learning_id, m.stage::int as stage, m.slug as existing_slug, case when m.slug is null then 'CREATE' when (select any_value({covered_sql(policy.coverage_threshold).replace('(title)', '(l.title)')}) from t where t.slug = m.slug) then 'NOOP' else 'APPEND' end as outcome
from l left join m using (learning_id)"""


def _outcomes(spark, sf_dir, regime):
    return matching.outcomes(V.view(spark, sf_dir, V.LEARNINGS), V.view(spark, sf_dir, V.TOPICS), DedupePolicy.preset(regime))


for _regime in Regime:

    def _match(spark, sf_dir, regime=_regime):
        return _outcomes(spark, sf_dir, regime).select("learning_id", "stage", "existing_slug", "outcome")

    QUERIES[f"match_{_regime}"] = _match
    ORACLE_SQL[f"match_{_regime}"] = match_sql(DedupePolicy.preset(_regime))


@query(f"select count(*) filter (outcome = 'CREATE') as created, count(*) filter (outcome = 'APPEND') as appended, count(*) filter (outcome = 'NOOP') as skipped from ({match_sql(DedupePolicy())}) o")
def outcome_counts(spark, sf_dir):
    return matching.counts(_outcomes(spark, sf_dir, Regime.BALANCED))


@query(f"select count(distinct {slug_sql('topic_hint')}) filter (outcome = 'CREATE') as topics_created, count(*) filter (outcome = 'APPEND') as topics_updated, count(*) filter (outcome = 'NOOP') as duplicates_skipped from ({match_sql(DedupePolicy())}) o join ({LEARNINGS}) l using (learning_id)")
def merge_counts(spark, sf_dir):
    return merge.merge_counts(_outcomes(spark, sf_dir, Regime.BALANCED))


@query(f"select learning_id, {covered_sql(0.6)} as covered from (select learning_id, l.title, l.summary, t.body from ({LEARNINGS}) l join ({TOPICS}) t on starts_with(l.title, t.title)) x")
def coverage(spark, sf_dir):
    rows = V.view(spark, sf_dir, V.LEARNINGS).join(V.view(spark, sf_dir, V.TOPICS).select(F.col("title").alias("name"), "body"), F.expr("startswith(title, name)"))
    return rows.select("learning_id", matching.is_covered(F.col("body"), F.col("title"), F.col("summary"), 0.6).alias("covered"))


# --- merging -------------------------------------------------------------------------------------


@query(f"""with l as (select *, {slug_sql('topic_hint')} as slug from ({LEARNINGS}) x), f as (select *, row_number() over (partition by slug order by learning_id) as n from l),
s as (select slug, min(learning_id) as pos, count(*)::int as merged, string_agg(case when n = 1 then summary else chr(10) || chr(10) || title || ': ' || summary end, '' order by n) as summary, arg_min(title, n) as title from f group by slug),
u as (select slug, n, unnest(tags) as tag, generate_subscripts(tags, 1) as k from f), v as (select slug, tag, n * 100 + k as o from u where n = 1 union all select slug, arg_min(tag, n * 100 + k), min(n * 100 + k) from u where n > 1 and not exists (select 1 from u f where f.slug = u.slug and f.n = 1 and lower(f.tag) = lower(u.tag)) group by slug, lower(tag)),
g as (select slug, string_agg(tag, '|' order by o) as tags from v group by 1),
u2 as (select slug, n, unnest(evidence) as ev, generate_subscripts(evidence, 1) as k from f), v2 as (select slug, ev, min(n * 100 + k) as o from u2 group by 1, 2), h as (select slug, string_agg(ev, '|' order by o) as evidence from v2 group by 1)
select pos, slug, title, md5(summary) as summary, evidence, tags, merged from s join g using (slug) join h using (slug)""")
def coalesce_creates(spark, sf_dir):
    made = merge.coalesce_creates(V.view(spark, sf_dir, V.LEARNINGS).withColumnRenamed("learning_id", "pos"))
    return made.select("pos", "slug", "title", F.md5("summary").alias("summary"), F.array_join("evidence", "|").alias("evidence"), F.array_join("tags", "|").alias("tags"), "merged")


BODY = "case doc_id % 3 when 0 then text when 1 then concat(text, chr(10), '## Key Insights', chr(10), 'old') else concat('intro', chr(10), '## Key Insights', chr(10), 'old', chr(10), chr(10), '## Other', chr(10), text) end"


@query(f"""with b as (select doc_id, {BODY} as body, concat('### ', source, chr(10), chr(10), lang, chr(10), chr(10), '- e', chr(10), chr(10), '_Extracted from context ', doc_id, ' at 2024-01-02 03:04 UTC_', chr(10)) as section from documents),
a as (select *, strpos(body, '## Key Insights') as head from b), c as (select *, strpos(substr(body, head + 1), chr(10) || '## ') as nxt from a), e as (select *, case when nxt > 0 then head + nxt - 1 else length(body) end as cut from c)
select doc_id, case when head > 0 then substr(body, 1, cut) || case when ends_with(substr(body, 1, cut), chr(10)) then '' else chr(10) end || chr(10) || section || substr(body, cut + 1)
  else body || case when ends_with(body, chr(10)) then '' else chr(10) end || chr(10) || '## Key Insights' || chr(10) || chr(10) || section end as body from e""")
def append_insight(spark, sf_dir):
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    section = merge.insight(F.col("source"), F.col("lang"), F.array(F.lit("e")), F.col("doc_id"), at)
    return _documents(spark, sf_dir).select("doc_id", merge.add_insight(F.expr(BODY), section).alias("body"))


# --- responses -----------------------------------------------------------------------------------


@query(f"select learning_id, confidence from ({LEARNINGS}) l where confidence >= 0.7")
def confidence_filter(spark, sf_dir):
    return V.view(spark, sf_dir, V.LEARNINGS).where(F.col("confidence") >= 0.7).select("learning_id", F.col("confidence").cast("double").alias("confidence"))


ORACLE_SQL["confidence_filter"] = ORACLE_SQL["confidence_filter"].replace("learning_id, confidence", "learning_id, confidence::double as confidence", 1)


@query(f"""with h as (select learning_id, sha256(concat(lower(topic_hint), '|', lower(title), '|', lower(summary))) as hash from ({LEARNINGS}) l) select learning_id, hash from h where hash not in (select hash from h where learning_id % 3 = 0)""")
def novel_learnings(spark, sf_dir):
    rows = V.view(spark, sf_dir, V.LEARNINGS).select("learning_id", X.content_hash(F.col("topic_hint"), F.col("title"), F.col("summary")).alias("hash"))
    return rows.join(rows.where("learning_id % 3 = 0").select("hash"), "hash", "left_anti").select("learning_id", "hash")


@query("""select doc_id as context_id, 0 as n, source as topic_hint, concat('t', doc_id) as title, concat(lang, ' words') as summary, 'e|f' as evidence, lang as tags, case doc_id % 7 when 1 then 0.25 else 0.75 end::double as confidence
from documents where doc_id % 6 <> 5 and doc_id % 7 <> 0""")
def parsed_extractions(spark, sf_dir):
    found, _ = R.parse_extractions(V.view(spark, sf_dir, V.RESPONSES))
    return found.select("context_id", "n", "topic_hint", "title", "summary", F.array_join("evidence", "|").alias("evidence"), F.array_join("tags", "|").alias("tags"), "confidence")


@query("select doc_id as context_id, source as topic_hint, concat('t', doc_id) as title, lang as summary, case when doc_id % 3 = 0 then null else 'p1' end as project_path from documents where doc_id % 5 <> 0")
def parsed_directives(spark, sf_dir):
    found, _ = R.parse_directives(V.view(spark, sf_dir, V.DIRECTIVES))
    return found.select("context_id", "topic_hint", "title", "summary", "project_path")


# --- managed blocks ------------------------------------------------------------------------------

FILES = "select doc_id, case doc_id % 5 when 0 then text when 1 then concat(text, chr(10), chr(10), '{b}old{e}', chr(10), chr(10), text) when 2 then concat('{b}', text) when 3 then concat('{b}{e}', text, '{b}{e}') else '' end as content from documents"
_B, _E = B.begin("agent") + "\n", "\n" + B.END + "\n"
FILES = FILES.format(b=_B, e=_E)
BLOCK = B.wrap("agent", "New $1 text.")
PARTS = f"strpos(content, '{B.begin('agent')}') as head, strpos(content, '{B.END}') as tail, (len(string_split(content, '{B.begin('agent')}')) - 1) as n"
AFTER = f"substr(content, tail + {len(B.END)} + case when substr(content, tail + {len(B.END)}, 1) = chr(10) then 1 else 0 end)"


@query(f"""with f as (select *, {PARTS} from ({FILES}) x)
select doc_id, case when content = '' then '{BLOCK}' when n = 0 then content || case when ends_with(content, chr(10)) then '' else chr(10) end || chr(10) || '{BLOCK}'
  when n = 1 and tail > 0 then substr(content, 1, head - 1) || '{BLOCK}' || {AFTER} else content end as installed,
  case when n = 1 and tail > 0 then rtrim(regexp_replace(substr(content, 1, head - 1) || {AFTER}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(9) || ' ') else content end as removed from f""")
def managed_blocks(spark, sf_dir):
    V.tables(spark, sf_dir, "documents")
    rows = spark.sql(FILES.replace("\n", "\\n"))
    return rows.select("doc_id", B.install(F.col("content"), "agent", BLOCK).alias("installed"), B.remove(F.col("content"), "agent").alias("removed"))
