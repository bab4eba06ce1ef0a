"""Topics as Markdown files with YAML front matter."""

from __future__ import annotations

from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

LISTS, TIMES, TEXTS = ("aliases", "tags", "projects"), ("created", "updated", "extracted_at"), ("source", "confidence")


def _time(value) -> datetime | None:
    if value is None or value == "":
        return None
    out = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    return (out if out.tzinfo else out.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None)


def _fields(head: str) -> dict:
    """The front matter's fields; a record without title or slug is an error."""
    import yaml

    data = yaml.safe_load(head)
    if not isinstance(data, dict) or not str(data.get("title") or "").strip() or not str(data.get("slug") or "").strip():
        raise ValueError("front matter without title or slug")
    out = {"title": str(data["title"]), "slug": str(data["slug"])}
    out |= {k: [str(x) for x in data.get(k) or []] for k in LISTS} | {k: _time(data.get(k)) for k in TIMES}
    out |= {k: None if data.get(k) is None else str(data[k]) for k in TEXTS}
    return out | {"source_context_id": None if data.get("source_context_id") is None else str(data["source_context_id"])}


def read_markdown(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Topics of ``<path>/*.md``, or of the folders that ``write_markdown`` makes (columns of ``schemas.TOPICS`` and ``error``).

    A file without proper front matter fails the read, or with ``strict`` off is a row with an ``error``
    and no slug.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    listed = jvm.org.apache.hadoop.fs.Path(f"{path}/slug=*/part-*")
    made = listed.getFileSystem(conf).globStatus(listed)
    rows = spark.read.text(f"{path}/slug=*/part-*" if made else f"{path}/*.md", wholetext=True)
    parts = F.regexp_extract("value", r"(?s)^---(.*?)\n---(.*)$", 1)
    body = F.regexp_replace(F.regexp_extract("value", r"(?s)^---(.*?)\n---(.*)$", 2), "^\n{1,2}", "")
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.when(F.col("value").rlike(r"(?s)^---.*?\n---"), parts).alias("head"), body.alias("body"))
    schema = "file string, body string, error string, slug string, title string, aliases array<string>, tags array<string>, projects array<string>, created timestamp, updated timestamp, extracted_at timestamp, source string, confidence string, context string"

    def run(frames):
        for frame in frames:
            out = []
            for file, head, text in zip(frame["file"], frame["head"], frame["body"]):
                try:
                    if head is None:
                        raise ValueError("no front matter")
                    fields, error = _fields(head), None
                except Exception as e:  # a malformed file of the user's
                    if strict:
                        raise ValueError(f"{file}: {e}") from e
                    fields, error = dict.fromkeys((*LISTS, *TIMES, *TEXTS, "title", "slug", "source_context_id")), str(e)
                context = fields.pop("source_context_id")
                out.append({"file": file, "body": text, "error": error, **fields, "context": context})
            frame = pd.DataFrame(out, columns=["file", "body", "error", "slug", "title", *LISTS, *TIMES, *TEXTS, "context"])
            for k in TIMES:
                frame[k] = pd.to_datetime(frame[k])
            yield frame

    out = rows.mapInPandas(run, schema).withColumn("source_context_id", F.expr("try_cast(context as decimal(20,0))"))
    names = [c.split()[0] for c in schemas.TOPICS.split(", ")]
    return out.select(*names, "error")


def markdown(topics: DataFrame) -> DataFrame:
    """(slug, text): each topic as a Markdown file; empty lists and missing values are left out of its head."""

    def run(frames):
        import yaml

        for frame in frames:
            texts = []
            for row in frame.to_dict("records"):
                head = {"title": row["title"], "slug": row["slug"]}
                head |= {k: list(row[k]) for k in LISTS if row[k] is not None and len(row[k])}
                head |= {k: row[k].strftime("%Y-%m-%dT%H:%M:%S.%fZ") for k in TIMES if not pd.isna(row[k])}
                head |= {k: row[k] for k in TEXTS if row[k] is not None}
                if row["context"] is not None:
                    head["source_context_id"] = int(row["context"])
                text = f"---\n{yaml.safe_dump(head, sort_keys=False, allow_unicode=True)}---\n\n{row['body'] or ''}"
                texts.append(text if text.endswith("\n") else text + "\n")
            yield pd.DataFrame({"slug": frame["slug"], "text": texts})

    return topics.withColumn("context", F.col("source_context_id").cast("string")).drop("source_context_id").mapInPandas(run, "slug string, text string")


def write_markdown(topics: DataFrame, path: str) -> None:
    """One file a topic below ``path``, in a folder named after its slug (the text writer names the file itself); ``read_markdown`` reads them back."""
    # A line end within the text is no separator here: each text is one row, and ends with its own.
    markdown(topics).write.mode("overwrite").partitionBy("slug").option("lineSep", "\n").text(path)
