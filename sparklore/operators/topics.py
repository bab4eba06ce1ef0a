"""The topic store's operations on a topics DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

SUMMARY = ("slug", "title", "aliases", "tags")


def index(topics: DataFrame) -> DataFrame:
    return topics.select(*SUMMARY).orderBy("slug")


def alias_collisions(new: DataFrame, topics: DataFrame) -> DataFrame:
    """(slug, alias, other_slug): aliases of ``new`` that name another topic by its slug or one of its aliases."""
    wanted = new.select("slug", F.explode("aliases").alias("alias"))
    slugs = topics.select(F.col("slug").alias("other_slug"), F.col("slug").alias("key"))
    named = topics.select(F.col("slug").alias("other_slug"), F.explode("aliases").alias("a")).select("other_slug", F.lower("a").alias("key"))
    by_slug = wanted.withColumn("key", X.slug(F.col("alias"))).join(slugs, "key")
    by_alias = wanted.withColumn("key", F.lower("alias")).join(named, "key")
    return by_slug.unionByName(by_alias).where("slug <> other_slug").select("slug", "alias", "other_slug").distinct()


def upsert(topics: DataFrame, changed: DataFrame) -> DataFrame:
    """``topics`` with ``changed`` in place of those of the same slug, and added to the others."""
    return topics.join(changed.select("slug"), "slug", "left_anti").select(*topics.columns).unionByName(changed.select(*topics.columns))


def delete(topics: DataFrame, slugs: DataFrame) -> DataFrame:
    return topics.join(slugs.select("slug"), "slug", "left_anti").select(*topics.columns)


def lookup(names: DataFrame, topics: DataFrame) -> DataFrame:
    """(name, slug): the topic each of ``names`` (name) means, by slug first, else by alias (first in slug order)."""
    by_slug = names.join(topics.select("slug"), X.slug(F.col("name")) == F.col("slug")).select("name", "slug", F.lit(0).alias("pri"))
    alias = topics.select("slug", F.explode("aliases").alias("a")).select("slug", F.lower("a").alias("key"))
    by_alias = names.withColumn("key", F.lower("name")).join(alias, "key").select("name", "slug", F.lit(1).alias("pri"))
    first = Window.partitionBy("name").orderBy("pri", "slug")
    return by_slug.union(by_alias).withColumn("n", F.row_number().over(first)).where("n = 1").select("name", "slug")


def checked(topics: DataFrame) -> DataFrame:
    """``topics`` with ``error``: why the slug is no valid one, else null."""
    return topics.withColumn("error", X.slug_error(F.col("slug")))
