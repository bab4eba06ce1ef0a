"""The topic store as a service: what the commands call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import text as X
from .operators import search, topics
from .streaming.runner import Store


class TopicError(ValueError):
    """A topic that cannot be stored or found."""


class KnowledgeBase:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def is_initialized(self) -> bool:
        return bool(self.store.topics.versions())

    def init(self) -> bool:
        """An empty store, unless there is one; whether it was made."""
        made = not self.is_initialized()
        if made:
            self.store.topics.replace(self.load())
        return made

    def load(self) -> DataFrame:
        return self.store.topics.read()

    def list(self) -> DataFrame:
        return topics.index(self.load())

    def search(self, words: str) -> DataFrame:
        return search.search(self.load(), words).select("slug", "title", "score")

    def get(self, name: str) -> DataFrame:
        """The topic of that slug or alias; an error if there is none."""
        found = topics.lookup(self.spark.createDataFrame([(name,)], "name string"), self.load())
        row = self.load().join(found.select("slug"), "slug", "left_semi")
        if row.isEmpty():
            raise TopicError(f"no topic {name!r}")
        return row

    def _row(self, title: str, slug: str, body: str, tags=(), aliases=()) -> DataFrame:
        made = self.spark.createDataFrame([(slug, title, list(aliases), list(tags), body)], "slug string, title string, aliases array<string>, tags array<string>, body string")
        now, none = F.current_timestamp(), F.lit(None)
        full = made.withColumns({"projects": F.array().cast("array<string>"), "created": now, "updated": now, "extracted_at": none.cast("timestamp"), "source": F.lit("manual"), "confidence": F.lit("high"), "source_context_id": none.cast("decimal(20,0)")})
        return full.select(*[c.split()[0] for c in schemas.TOPICS.split(", ")])

    def _checked(self, row: DataFrame, others: DataFrame | None = None) -> DataFrame:
        error = topics.checked(row).first()["error"]
        if error:
            raise TopicError(f"bad slug: {error}")
        clash = topics.alias_collisions(row, self.load() if others is None else others).first()
        if clash:
            raise TopicError(f"alias {clash['alias']!r} belongs to {clash['other_slug']!r}")
        return row

    def add(self, title: str, body: str, slug: str | None = None, tags=(), aliases=()) -> str:
        """A new topic; its slug is made from the title unless given."""
        slug = slug or self.spark.range(1).select(X.slug(F.lit(title)).alias("s")).first()["s"]
        row = self._checked(self._row(title, slug, body, tags, aliases))
        if not self.load().where(F.col("slug") == slug).isEmpty():
            raise TopicError(f"topic {slug!r} exists")
        self.store.topics.apply(row)
        return slug

    def update(self, name: str, body: str | None = None, title: str | None = None, slug: str | None = None, tags=None, aliases=None) -> str:
        """The topic of that slug or alias with what is given in place of what it had; a new ``slug`` renames it."""
        row = self.get(name)
        old = row.first()["slug"]
        lists = {k: F.array(*map(F.lit, v)).cast("array<string>") for k, v in (("tags", tags), ("aliases", aliases)) if v is not None}
        row = row.withColumns({k: F.lit(v) for k, v in (("body", body), ("title", title), ("slug", slug)) if v is not None} | lists | {"updated": F.current_timestamp()})
        others = topics.delete(self.load(), self.spark.createDataFrame([(old,)], "slug string"))
        new = self._checked(row, others).first()["slug"]
        if not others.where(F.col("slug") == new).isEmpty():
            raise TopicError(f"topic {new!r} exists")
        self.store.topics.apply(row, self.spark.createDataFrame([(old,)], "slug string"))
        return new

    def upsert(self, rows: DataFrame) -> None:
        """Topics of ``rows`` in place of those of their slugs, or added; one bad slug or alias stops all of it."""
        bad = topics.checked(rows).where("error is not null").first() or topics.alias_collisions(rows, self.load()).first()
        if bad:
            raise TopicError(f"cannot store {bad['slug']!r}")
        self.store.topics.apply(rows)

    def delete(self, name: str) -> None:
        row = self.get(name)
        self.store.topics.apply(row.limit(0), row.select("slug"))

    def status(self) -> dict:
        """Sizes of the state tables."""
        s = self.store
        sizes = {"topics": self.load(), "processed": s.heads(), "extraction_hashes": s.extracted.read().distinct(), "pattern_hashes": s.patterns.read().distinct()}
        return {n: t.count() for n, t in sizes.items()}
