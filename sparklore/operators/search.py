"""Keyword relevance over topics: slug and title 10 each, aliases 7, tags 5, body 2, for every term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import checkpointed
from .matching import containing


def term_score(term: Column) -> Column:
    hit = lambda c, n: F.when(F.contains(c, term), n).otherwise(0)
    each = lambda c, n: n * F.size(F.filter(c, lambda x: F.contains(F.lower(x), term)))
    return hit(F.col("slug"), 10) + hit(F.lower("title"), 10) + each(F.col("aliases"), 7) + each(F.col("tags"), 5) + hit(F.lower("body"), 2)


def search(topics: DataFrame, query: str) -> DataFrame:
    """``topics`` that some term of ``query`` hits, with ``score``, best first; repeated terms count again."""
    terms = query.lower().split()
    score = sum((term_score(F.lit(t)) for t in terms), F.lit(0))
    return topics.withColumn("score", score.cast("int")).where("score > 0").orderBy(F.desc("score"), "slug")


def fields(topics: DataFrame) -> DataFrame:
    """(o, slug, weight, text): what a term may be found in, one row each; repeats of an alias or tag count each."""
    lower = lambda c, w: F.transform(c, lambda x: F.struct(F.lower(x).alias("text"), F.lit(w).alias("weight")))
    one = lambda c, w: F.struct(c.alias("text"), F.lit(w).alias("weight"))
    all_ = F.concat(F.array(one(F.col("slug"), 10), one(F.lower("title"), 10), one(F.lower("body"), 2)), lower("aliases", 7), lower("tags", 5))
    rows = topics.select("slug", F.posexplode(all_).alias("place", "f")).where("f.text is not null")
    return rows.select(F.struct("slug", "place").alias("o"), "slug", "f.weight", "f.text")


def search_all(queries: DataFrame, topics: DataFrame) -> DataFrame:
    """(query_id, slug, score) of every topic that some term of a query (query_id, query) hits.

    Queries and topics may both be many: each distinct term is joined to the fields that hold it, on its rarest
    stretch of three characters (see ``containing``), and scores are summed by term and topic first.
    """
    asked = queries.select("query_id", F.explode(X.words(F.lower("query"))).alias("i")).groupBy("query_id", "i").agg(F.count("*").alias("times"))
    asked, held = checkpointed(asked), checkpointed(fields(topics))
    hits = containing(held.select("o", "text"), asked.select("i", F.col("i").alias("text")).distinct())
    scored = hits.join(held.select("o", "slug", "weight"), "o").groupBy("i", "slug").agg(F.sum("weight").alias("score"))
    out = asked.join(scored, "i").groupBy("query_id", "slug").agg(F.sum(F.col("times") * F.col("score")).cast("int").alias("score"))
    return out.select("query_id", "slug", "score")


def tag_vocabulary(topics: DataFrame) -> DataFrame:
    """(tag): all tags in lower case, sorted."""
    return topics.select(F.explode("tags").alias("tag")).select(F.lower("tag").alias("tag")).distinct().orderBy("tag")
