"""A stored index for searching topics: which topics hold a stretch of one to three characters, and their fields.

The index follows a table of topics by its manifest: of buckets that have not changed nothing is read, and of topics that are
as they were nothing is written. Postings are only added to: one counts while its topic is still of the posting's version.
A search reads the buckets of its own terms' stretches, then the fields of the topics that have all of them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.matching import grams, own_grams
from ..operators.search import fields
from ..shared import checkpointed
from .tables import GrowingTable, TopicTable

FIELDS = "slug string, version string, fields array<struct<weight:int,text:string>>"
POSTINGS = "gram string, slug string, version string"


class SearchIndex:
    """The index below ``path`` of the topics in a ``TopicTable``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # Stretches come from buckets of their own number, versions of topics from those of their slugs.
        self.live = TopicTable(spark, f"{self.path}/fields", FIELDS)
        self.postings = GrowingTable(spark, f"{self.path}/postings", POSTINGS)

    def _known(self) -> dict:
        """The folders of the topic table's buckets that the index has seen."""
        fs, path = self.live._fs()
        at = path(f"{self.path}/seen.json")
        if not fs.exists(at):
            return {}
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _remember(self, buckets: dict) -> None:
        fs, path = self.live._fs()
        stream = fs.create(path(f"{self.path}/seen.json"), True)
        stream.write(bytearray(json.dumps(buckets).encode()))
        stream.close()

    def sync(self, table: TopicTable) -> None:
        """Bring the index to the table's newest state. What is interrupted is done again by the next call."""
        held, known = table._now()[1], self._known()
        changed = [int(b) for b in held["buckets"].keys() | known.keys() if held["buckets"].get(b) != known.get(b)]
        if not changed:
            return
        rows = fields(table._files(held, changed)).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(F.col("o.place").alias("place"), "weight", "text"))).alias("all"))
        rows = rows.select("slug", F.transform("all", lambda f: F.struct(f["weight"].alias("weight"), f["text"].alias("text"))).alias("fields"))
        rows = checkpointed(rows.select("slug", F.sha2(F.to_json("fields"), 256).alias("version"), "fields"))
        live = self.live.read().where(table._bucket(held["count"], "slug").isin(changed)).select("slug", "version")
        new = checkpointed(rows.join(live, ["slug", "version"], "left_anti"))
        gone = checkpointed(live.select("slug").join(rows.select("slug"), "slug", "left_anti"))
        texts = new.select("slug", "version", F.explode("fields.text").alias("text"))
        self.postings.append(texts.select(F.explode(F.concat(*[grams(F.col("text"), n) for n in (1, 2, 3)])).alias("gram"), "slug", "version").distinct())
        self.live.apply(new, gone)
        self._remember(held["buckets"])

    def search(self, queries: DataFrame, most: int | None = None) -> DataFrame:
        """(query_id, slug, score) of the topics that some term of a query (query_id, query) hits; the best ``most`` of each query, if given.

        Scores are those of ``search_all``; of equals the first slug is better. Queries without a term have no rows.
        """
        asked = queries.select("query_id", F.explode(X.words(F.lower("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        asked = checkpointed(asked)
        wanted = checkpointed(asked.select("term").distinct().select("term", F.explode(own_grams(F.col("term"))).alias("gram")))
        held = self.postings.read(wanted).join(wanted, "gram").groupBy("term", "slug", "version").agg(F.count_distinct("gram").alias("n"))
        sizes = wanted.groupBy("term").agg(F.count("*").alias("grams"))
        likely = checkpointed(held.join(sizes, "term").where("n = grams").select("term", "slug", "version"))
        live = self.live.read(likely.select("slug"))
        hit = F.aggregate("fields", F.lit(0), lambda a, f: a + F.when(F.contains(f["text"], F.col("term")), f["weight"]).otherwise(0))
        scored = likely.join(live, ["slug", "version"]).select("term", "slug", hit.alias("score")).where("score > 0")
        out = asked.join(scored, "term").groupBy("query_id", "slug").agg(F.sum(F.col("times") * F.col("score")).cast("int").alias("score"))
        if most is not None:
            out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "slug"))).where(F.col("rank") <= most)
        return out.select("query_id", "slug", "score")
