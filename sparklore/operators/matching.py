"""Which topic a learning belongs to: a cascade of five stages, the first that hits decides.

1 slug = normalised hint, 2 an alias equals the hint, 3 title (exact, contains or fuzzy), 4 shared tags (and
slug affinity), 5 tag Jaccard. All are equi joins: on slug, alias, title token, for containment on a stretch of three
characters, and for tags on what keeps a tag that all topics have from meeting them all. With affinity, candidates
come from the slugs and tags are only counted. Without it, the key is a set of tags that is enough by itself, of which
each has one row, the first slug. For Jaccard, equal tag sets are one row, and sets meet by their rarest tags.
Each stage runs on what those before leave.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DedupePolicy, TitleMode
from ..functions import text as X
from ..shared import checkpointed

CREATE, APPEND, NOOP = "CREATE", "APPEND", "NOOP"
#: Tags of a row, and the minimum of shared ones, up to which sets of tags are keys (some 5,500 of a row at most).
MOST_TAGS, MOST_LEAST = 32, 3


def tag_overlap(tags: Column, learning_tags: Column) -> Column:
    """Topic tags (repeats counted) whose lower case is among the learning's."""
    return F.size(F.filter(tags, lambda t: F.array_contains(learning_tags, F.lower(t))))


def slug_jaccard(a: Column, b: Column) -> Column:
    parts = lambda s: F.filter(F.split(s, "-"), lambda w: w != "")
    return X.jaccard(F.array_distinct(parts(a)), F.array_distinct(parts(b)))


def is_covered(body: Column, title: Column, summary: Column, threshold: float) -> Column:
    """Whether the body holds the title, or more than ``threshold`` of the summary's words of 4 bytes or more."""
    lower = F.lower(body)
    words = F.filter(X.words(F.lower(summary)), lambda w: F.octet_length(w) >= 4)
    hits = F.size(F.filter(words, lambda w: F.contains(lower, w)))
    return F.contains(lower, F.lower(title)) | F.coalesce(hits / F.nullif(F.size(words), F.lit(0)) > threshold, F.lit(False))


def _first(hits: DataFrame, *better: Column) -> DataFrame:
    """Each learning's hit that is first by ``better`` and slug."""
    best = hits.groupBy("learning_id").agg(F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(better)], F.col("slug").alias("slug"))).alias("b"))
    return best.select("learning_id", "b.slug")


def grams(text: Column, n: int) -> Column:
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def own_grams(text: Column) -> Column:
    """The stretches of three characters of ``text``, or all of a shorter one."""
    return F.when(F.length(text) < 3, F.array(text)).otherwise(grams(text, 3))


def containing(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(o, i): where ``text`` of ``outer`` (o, text) holds that of ``inner`` (i, text), which is not empty.

    An equi join of ids: of the inner text's stretches of three characters (or all of a shorter text) the one
    that the fewest outer texts hold must be among theirs. Texts are looked at for the pairs left.
    """
    inner = inner.where("text <> ''")
    wanted = checkpointed(inner.select("i", F.explode(own_grams(F.col("text"))).alias("gram")))
    held = outer.select("o", F.explode(F.concat(*[grams(F.col("text"), n) for n in (1, 2, 3)])).alias("gram"))
    held = checkpointed(held.join(wanted.select("gram").distinct(), "gram", "left_semi"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("i").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
    pairs = held.join(rarest.select("i", F.col("g.gram").alias("gram")), "gram").select("o", "i")
    checked = pairs.join(outer.select("o", F.col("text").alias("otext")), "o").join(inner.select("i", F.col("text").alias("itext")), "i")
    return checked.where(F.contains("otext", "itext")).select("o", "i")


def _by_title(rest: DataFrame, names: DataFrame, policy: DedupePolicy) -> DataFrame:
    """(learning_id, slug) of titles that match: every way to match is an equi join on grams or tokens."""
    if policy.title_mode is TitleMode.EXACT:
        return rest.join(names.withColumn("hint_slug", X.slug(F.lower("title"))), "hint_slug").select("learning_id", "slug")
    spaced, hyphened = F.replace("hint_slug", F.lit("-"), F.lit(" ")), F.replace(F.lower("title"), F.lit(" "), F.lit("-"))
    hints = rest.select("learning_id", spaced.alias("text"))
    found = containing(names.select(F.col("slug").alias("o"), F.lower("title").alias("text")), hints.withColumnRenamed("learning_id", "i")).select(F.col("i").alias("learning_id"), F.col("o").alias("slug"))
    found = found.union(containing(hints.withColumnRenamed("learning_id", "o"), names.select(F.col("slug").alias("i"), hyphened.alias("text"))).select(F.col("o").alias("learning_id"), F.col("i").alias("slug")))
    # An empty text is within any other: the first topic for empty hints, the first untitled one for any hint.
    first = lambda some: some.agg(F.min("slug").alias("slug")).scalar()
    ends = hints.where("text = ''").select("learning_id", first(names).alias("slug")).union(hints.select("learning_id", first(names.where("title = ''")).alias("slug")))
    found = found.union(ends.where("slug is not null"))
    if policy.title_mode is TitleMode.FUZZY:
        parts = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, "-"), lambda w: w != "")))
        shared = rest.select("learning_id", "hint_slug", parts(F.col("hint_slug")).alias("w")).join(names.select("slug", "title", parts(X.slug(F.col("title"))).alias("w")), "w")
        near = shared.dropDuplicates(["learning_id", "slug"]).where(slug_jaccard(X.slug(F.col("title")), F.col("hint_slug")) >= policy.title_similarity)
        found = found.union(near.select("learning_id", "slug"))
    return found


def _subsets(tags: Column, most: int) -> Column:
    """All sets of 1 to ``most`` of ``tags``, which are sorted and distinct."""
    level = F.transform(tags, lambda t: F.array(t))
    levels = [level]
    for _ in range(most - 1):
        level = F.flatten(F.transform(level, lambda s: F.transform(F.filter(tags, lambda t: t > F.element_at(s, -1)), lambda t: F.concat(s, F.array(t)))))
        levels.append(level)
    return F.concat(*levels)


def enough_tags(learnings: DataFrame, topics: DataFrame, least: int) -> DataFrame:
    """(learning_id, slug): the first topic of which at least ``least`` tags (repeats counted) are among the learning's.

    Learnings (learning_id, ltags) and topics (slug, ltags), tags in lower case. A topic's keys are the sets of up to
    ``least`` of its tags that are enough, repeats counted; a key keeps its first slug. A learning asks for all sets of
    its tags, so it meets one row a key, however many topics have a tag. Rows of very many tags, and a minimum over
    ``MOST_LEAST``, meet by single tags instead.
    """
    learnings, topics = (df.withColumn("set", F.array_sort(F.array_distinct("ltags"))) for df in (learnings, topics))
    narrow = (F.size("set") <= MOST_TAGS) & F.lit(least <= MOST_LEAST)
    sets = topics.where(narrow).select("slug", F.explode(F.filter(_subsets(F.col("set"), min(least, MOST_LEAST)), lambda s: tag_overlap(F.col("ltags"), s) >= least)).alias("key"))
    asked = learnings.where(narrow).select("learning_id", F.explode(_subsets(F.col("set"), min(least, MOST_LEAST))).alias("key"))
    found = asked.join(sets.groupBy("key").agg(F.min("slug").alias("slug")), "key").select("learning_id", "slug")

    def by_tag(some: DataFrame, of: DataFrame) -> DataFrame:
        pairs = some.select("learning_id", F.explode("set").alias("tag")).join(of.select("slug", F.explode("set").alias("tag")), "tag").select("learning_id", "slug").distinct()
        pairs = pairs.join(some.select("learning_id", F.col("set").alias("own")), "learning_id").join(of.select("slug", "ltags"), "slug")
        return pairs.where(tag_overlap(F.col("ltags"), F.col("own")) >= least).select("learning_id", "slug")

    return found.union(by_tag(learnings.where(~narrow), topics)).union(by_tag(learnings.where(narrow), topics.where(~narrow)))


def nearest_tags(learnings: DataFrame, topics: DataFrame, threshold: float) -> DataFrame:
    """(learning_id, slug): the topic of the largest Jaccard similarity of tag sets that is ``threshold`` or more; of equals the first.

    Equal sets are one row, on both sides. Two sets that are so near share one of the first tags of each, by rarity:
    all but as many less one as a set must at least have in common with the other.
    """
    sets = lambda df: df.withColumn("set", F.array_sort(F.array_distinct("ltags"))).where(F.size("set") > 0)
    asked, of = sets(learnings).select("learning_id", "set"), checkpointed(sets(topics).groupBy("set").agg(F.min("slug").alias("slug")))
    wanted = checkpointed(asked.select("set").distinct())
    held = of.select(F.explode("set").alias("tag")).groupBy("tag").agg(F.count("*").alias("held"))

    def first(df: DataFrame, *more: str) -> DataFrame:
        """A row for each of the rarest tags of each set; tags that no topic has come first of all, and meet nothing."""
        ranked = df.select("set", *more, F.explode("set").alias("tag")).join(held, "tag", "left").groupBy("set", *more).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "tag"))).alias("order"))
        kept = F.slice("order", 1, F.size("order") - F.ceil(F.size("order") * threshold - 1e-9).cast("int") + 1)
        return ranked.select("set", *more, F.explode(kept).alias("o")).select("set", *more, F.col("o.tag").alias("tag"))

    pairs = first(wanted).join(first(of, "slug").withColumnRenamed("set", "other"), "tag").where((F.size("set") >= F.size("other") * threshold - 1e-9) & (F.size("other") >= F.size("set") * threshold - 1e-9))
    near = pairs.withColumn("j", X.jaccard(F.col("set"), F.col("other"))).where(F.col("j") >= threshold)
    best = near.groupBy("set").agg(F.min(F.struct((-F.col("j")).alias("k"), "slug")).alias("b")).select("set", "b.slug")
    return asked.join(best, "set").select("learning_id", "slug")


def _by_affinity(rest: DataFrame, topics: DataFrame, least: int) -> DataFrame:
    """(learning_id, slug): topics of enough tags one of whose slug and the hint's holds the other; tags are counted for those alone."""
    hints, slugs = rest.where("hint_slug <> ''").select("learning_id", F.col("hint_slug").alias("text")), topics.where("slug <> ''").select("slug", F.col("slug").alias("text"))
    near = containing(slugs.withColumnRenamed("slug", "o"), hints.withColumnRenamed("learning_id", "i")).select(F.col("i").alias("learning_id"), F.col("o").alias("slug"))
    near = near.union(containing(hints.withColumnRenamed("learning_id", "o"), slugs.withColumnRenamed("slug", "i")).select(F.col("o").alias("learning_id"), F.col("i").alias("slug"))).distinct()
    counted = near.join(rest.select("learning_id", F.col("ltags").alias("own")), "learning_id").join(topics, "slug")
    found = counted.where(tag_overlap(F.col("ltags"), F.col("own")) >= least).select("learning_id", "slug")
    # An empty slug is within any other.
    return found.union(enough_tags(rest.where("hint_slug = ''"), topics, least)).union(enough_tags(rest, topics.where("slug = ''"), least))


def match(learnings: DataFrame, topics: DataFrame, policy: DedupePolicy) -> DataFrame:
    """(learning_id, stage, slug) for every learning that some stage finds a topic for."""
    lower = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    keyed = learnings.select("learning_id", F.lower("topic_hint").alias("hint"), X.slug(F.col("topic_hint")).alias("hint_slug"), lower("tags").alias("ltags"))
    names = topics.select("slug", "title")
    found: list[DataFrame] = []

    def rest():
        return reduce(lambda left, hits: left.join(hits.select("learning_id"), "learning_id", "left_anti"), found, keyed)

    def settle(hits, stage):
        found.append(checkpointed(hits.select("learning_id", F.lit(stage).alias("stage"), "slug")))

    settle(keyed.join(names.select("slug"), F.col("hint_slug") == F.col("slug")), 1)
    alias = topics.select("slug", F.explode("aliases").alias("a")).select("slug", F.lower("a").alias("hint"))
    settle(_first(rest().join(alias, "hint")), 2)
    settle(_first(_by_title(checkpointed(rest()), names, policy)), 3)
    tagged, left = topics.select("slug", lower("tags").alias("ltags")), checkpointed(rest().where(F.size("ltags") > 0))
    settle(_first((_by_affinity if policy.require_slug_affinity else enough_tags)(left, tagged, policy.tag_overlap_minimum)), 4)
    if policy.tag_jaccard_threshold < 1:
        settle(nearest_tags(left.join(found[-1].select("learning_id"), "learning_id", "left_anti"), tagged, policy.tag_jaccard_threshold), 5)
    return reduce(DataFrame.unionByName, found)


def outcomes(learnings: DataFrame, topics: DataFrame, policy: DedupePolicy) -> DataFrame:
    """``learnings`` with ``stage``, ``existing_slug`` and ``outcome``: CREATE, APPEND, or NOOP where the topic covers it."""
    found = match(learnings, topics, policy).withColumnRenamed("slug", "existing_slug")
    bodies = topics.select(F.col("slug").alias("existing_slug"), F.col("body").alias("__body"))
    rows = learnings.join(found, "learning_id", "left").join(bodies, "existing_slug", "left")
    covered = is_covered(F.col("__body"), F.col("title"), F.col("summary"), policy.coverage_threshold)
    outcome = F.when(F.col("existing_slug").isNull(), CREATE).when(covered, NOOP).otherwise(APPEND)
    return rows.withColumn("outcome", outcome).drop("__body").select(*learnings.columns, "stage", "existing_slug", "outcome")


def outcome_text(rows: DataFrame) -> DataFrame:
    """``rows`` of ``outcomes`` with ``summary_line``, the line that shows one to a reader."""
    line = (
        F.when(F.col("outcome") == CREATE, F.format_string("new topic %s: %s", "topic_hint", "title"))
        .when(F.col("outcome") == APPEND, F.format_string("added to %s: %s", "existing_slug", "title"))
        .otherwise(F.format_string("known from %s: %s", "existing_slug", "title"))
    )
    return rows.withColumn("summary_line", line)


def counts(rows: DataFrame) -> DataFrame:
    """(created, appended, skipped) of outcome rows."""
    return rows.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in ((CREATE, "created"), (APPEND, "appended"), (NOOP, "skipped"))])
