"""Operator 7: WARC archives, read back by boundary-chain verification. DataFrame functions only.

Writing: one record a row. Of rows with equal payloads the smallest id is stored as ``response``, the
others as ``revisit`` records that name it and carry no payload.

Reading: every split is cut at the record magic, so each piece is a *candidate* record start. A
candidate's header names its length and so its successor's offset. Only candidates reachable from
offset 0 of their file are records: magic inside a payload is never reached. Stretches of candidates
whose successor is simply the next candidate are joined to runs first; pointer jumping over the runs
(doubling the reach each round) finds those reachable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

MAGIC, BREAK = "WARC/1.0\r\n", "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1 (32 characters): each 5 hexadecimal digits are 4 base32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_payload_bytes: int = 0, records_per_file: int = 50_000, compression: str = "gzip") -> None:
    """Write one record a row of ``pages`` under ``path``.

    A null body is an empty payload, a null url has no target header. Line breaks within a url are
    written as ``%0D``/``%0A``. Rows that repeat the smallest id of their payload are all responses;
    a null id is larger than any other. Other columns are ignored. The text writer's line separator is
    the record end, so any file system that Spark writes will do. ``compression="none"`` gives archives
    that are read in splits.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("bytes"), base32_sha1(body.cast("binary")).alias("digest"))
    firsts = stored(rows.where(F.col("bytes") >= min_payload_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first_id")), "warc_firsts")
    rows = rows.join(firsts, ["digest", "bytes"], "left")
    revisit = F.col("first_id").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first_id")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(BREAK))
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("first_id")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block_bytes),
    )
    record = F.concat(header, F.lit(BREAK), http, F.when(revisit, "").otherwise(F.col("body")))
    writer = rows.select(record.alias("value")).write.option("lineSep", BREAK).option("maxRecordsPerFile", records_per_file)
    writer.option("compression", compression).text(path)


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?:^|\r\n){name}: *([^\r\n]*)", 1), F.lit(""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, with its place: file, split and rank within the split."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value")


def _described(value: Column) -> list[Column]:
    """Columns of the record that starts at a piece, if one does."""
    head = F.substring_index(value, BREAK, 1)
    length = _field(head, "Content-Length").try_cast("long")
    block = F.substring(value.cast("binary"), F.octet_length(head) + F.lit(5), F.least(length, F.lit(2**31 - 1)).cast("int"))
    http = F.substring_index(block.cast("string"), BREAK, 1)
    payload = F.substring(block, F.octet_length(http) + F.lit(5), F.octet_length(block))
    kind = _field(head, "WARC-Type")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    stated = F.regexp_extract(http, r"\r\nContent-Length: *(\d+)", 1).try_cast("long")
    return [
        F.when(kind.isNotNull(), F.lit(len(MAGIC) + 8) + F.octet_length(head) + length).alias("record_bytes"),
        number(_field(head, "WARC-Record-ID")).alias("page_id"),
        _field(head, "WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        number(_field(head, "WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(_field(head, "WARC-Payload-Digest"), r"^sha1:(\w+)$", 1).alias("stated_digest"),
        F.when(kind == "revisit", stated).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(kind != "revisit", base32_sha1(payload)).alias("read_digest"),
    ]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every magic of the archives with its offset, its successor's offset and the header's fields.

    ``tight``: the successor is the next magic of the file or its end. Offsets are running sums of
    piece lengths over a file's pieces, which carry no payload here.
    """
    rows = _pieces(spark, path)
    rows = rows.select("file", "split", "seq", F.octet_length("value").alias("bytes"), *_described(F.col("value")))
    in_file = Window.partitionBy("file").orderBy("split", "seq")
    step = F.col("bytes").cast("long") + len(MAGIC)
    rows = rows.withColumn("offset", F.sum(step).over(in_file) - step - len(MAGIC))
    rows = rows.withColumn("next_offset", F.coalesce(F.lead("offset").over(in_file), F.col("offset") + step))
    rows = rows.where("offset >= 0").withColumn("successor", F.col("offset") + F.col("record_bytes"))
    return rows.withColumn("tight", F.coalesce(F.col("successor") == F.col("next_offset"), F.lit(False)))


def reachable(found: DataFrame) -> DataFrame:
    """The candidates of ``found`` on the chain from offset 0 of their file, by pointer jumping over runs."""
    spark = found.sparkSession
    shared_dir(spark)
    landings = found.where("not tight and successor is not null").select("file", F.col("successor").alias("offset")).distinct().withColumn("landing", F.lit(True))
    in_file = Window.partitionBy("file").orderBy("offset")
    rows = found.join(landings, ["file", "offset"], "left")
    begins = ~F.coalesce(F.lag("tight").over(in_file), F.lit(False)) | F.coalesce("landing", F.lit(False))
    rows = rows.withColumn("run", F.sum(begins.cast("long")).over(in_file))
    runs = rows.groupBy("file", "run").agg(F.min("offset").alias("first"), F.max_by("successor", "offset").alias("jump"))
    jumps = runs.withColumn("reached", F.col("first") == 0).checkpoint()
    while True:
        ahead = jumps.select("file", F.col("first").alias("jump"), F.col("jump").alias("jump2"), F.col("reached").alias("known"))
        hits = jumps.join(ahead, ["file", "jump"])
        new = hits.where("reached and not known").select("file", F.col("jump").alias("first")).distinct()
        new = new.checkpoint()
        if new.isEmpty():
            break
        far = hits.select("file", "first", "jump2")
        jumps = jumps.join(far, ["file", "first"], "left").join(new.withColumn("new", F.lit(True)), ["file", "first"], "left")
        jumps = jumps.select("file", "run", "first", F.col("jump2").alias("jump"), (F.col("reached") | F.coalesce("new", F.lit(False))).alias("reached")).checkpoint()
    return rows.join(jumps.where("reached").select("file", "run"), ["file", "run"], "left_semi").drop("landing", "run")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``path``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact.

    Digest and size are of the payload as read; a revisit's are those its header states of the record
    it refers to. ``intact``: the digest read is the one stated. A record whose payload holds the magic
    is put together from its pieces in a second read of its file alone. Null ids and urls are as they were written,
    records that repeat are read each, archives without a record give no rows. Where a file's chain breaks off
    (``unread`` tells) the records before are read.
    """
    found = stored(candidates(spark, path), "warc_candidates")
    records = stored(reachable(found), "warc_records")
    whole = records.where("tight").select("page_id", "url", "record_type", "refers_to", "payload_bytes", "stated_digest", "read_digest")
    out = whole.unionByName(_assembled(spark, path, records.where("not tight"))) if not records.where("not tight").isEmpty() else whole
    digest = F.coalesce("read_digest", "stated_digest")
    return out.select("page_id", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", (digest == F.col("stated_digest")).alias("intact"))


def unread(spark: SparkSession, path: str) -> DataFrame:
    """(file, read_to, bytes, starts): the files of ``path`` whose chain of records does not end where they do.

    A wrong length or a file cut short breaks the chain; ``read_to`` is where it leads (0 where the first record names no
    length), ``starts`` how many record starts lie there or beyond, which may be records that nothing leads to. None of intact archives.
    """
    found = stored(candidates(spark, path), "warc_candidates")
    read = reachable(found).groupBy("file").agg(F.max("successor").alias("read_to"))
    ends = found.groupBy("file").agg(F.max("next_offset").alias("bytes")).join(read, "file", "left").select("file", F.coalesce("read_to", F.lit(0).cast("long")).alias("read_to"), "bytes")
    broken = stored(ends.where("read_to <> bytes"), "warc_broken")
    beyond = found.join(broken, "file").where("offset >= read_to").groupBy("file").agg(F.count("*").alias("starts"))
    return broken.join(beyond, "file", "left").select("file", "read_to", "bytes", F.coalesce("starts", F.lit(0)).cast("long").alias("starts"))


def _assembled(spark: SparkSession, path: str, split: DataFrame) -> DataFrame:
    spans = split.select("file", F.col("offset").alias("begin"), F.col("successor").alias("end"))
    pieces = _pieces(spark, path).join(spans.select("file").distinct(), "file", "left_semi")
    step = F.octet_length("value").cast("long") + len(MAGIC)
    in_file = Window.partitionBy("file").orderBy("split", "seq")
    placed = pieces.withColumn("offset", F.sum(step).over(in_file) - step - len(MAGIC)).select("file", "offset", "value")
    marks = spans.select("file", F.col("begin").alias("offset"), F.struct("begin", "end").alias("span"))
    owner = F.last("span", True).over(Window.partitionBy("file").orderBy("offset"))
    owned = placed.join(marks, ["file", "offset"], "left").withColumn("span", owner).where("offset < span.end")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"])
    texts = owned.groupBy("file", F.col("span.begin").alias("begin"), F.col("span.end").alias("end")).agg(F.array_join(parts, MAGIC).alias("value"))
    return texts.select(*_described(F.col("value"))).drop("record_bytes")


def oracle_sql() -> str:
    return """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha1(body) as hex from p),
e as (select page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * (i // 4)::int + 1, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') as payload_digest from d),
f as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first_id from e)
select page_id, payload_bytes, payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to from f"""
