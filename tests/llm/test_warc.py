import base64
import hashlib

import duckdb
import pytest
from sparklore.llm.queries import ORACLE_SQL, op7_warc
from sparklore.llm.warc import read_warc, unread, write_warc

COLUMNS = "page_id long, url string, html string, value string"


def expected(rows):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    out = []
    for i, body in payloads:
        first = min((k for k, b in payloads if b == body and k is not None), default=None)
        again = first is not None and (i is None or i > first)
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def got(spark, rows, path, **options):
    write_warc(spark.createDataFrame([(i, f"http://h/{i}", h, "x") for i, h in rows], COLUMNS).repartition(2), path, **options)
    back = read_warc(spark, path).collect()
    assert all(r.intact for r in back)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)


INNER = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nHTTP\r\n\r\n"
ROWS = [(1, "plain"), (2, None), (3, ""), (4, "WARC/1.0\r\n"), (5, "a" + INNER * 3 + "b"), (6, INNER), (7, "x\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\n"), (8, "é \x00" * 50), (9, "plain"), (None, "plain"), (None, "other"), (9, "plain"), (1, "plain"), (20, "WARC/1.0\r\n" * 40)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_magic_inside_payloads_and_edges(spark, tmp_path, compression):
    assert got(spark, ROWS, str(tmp_path / "w"), compression=compression) == expected(ROWS)


def test_small_splits(spark, tmp_path):
    rows = [(i, INNER * (i % 4) + "text %d " % (i % 7) * (i % 50) + "WARC/1.0\r\n" * (i % 3)) for i in range(200)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert got(spark, rows, str(tmp_path / "w"), compression="none") == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_what_a_wrong_length_cuts_off_is_told(spark, tmp_path):
    path = tmp_path / "w"
    assert got(spark, ROWS, str(path), compression="none") == expected(ROWS)
    assert unread(spark, str(path)).count() == 0
    (part,) = sorted(path.glob("part-*"), key=lambda p: -p.stat().st_size)[:1]
    data = part.read_bytes()
    (path / f".{part.name}.crc").unlink()  # the local file system's own checksum
    records = [i for i in range(len(data)) if data.startswith(b"WARC/1.0\r\nWARC-Type: re", i) and b"WARC-Record-ID" in data[i : i + 90]]
    second = records[1]
    at = data.index(b"Content-Length: ", second) + 16
    digits = data[at : data.index(b"\r", at)]
    part.write_bytes(data[:at] + b"9" * len(digits) + data[at + len(digits) :])
    (row,) = unread(spark, str(path)).collect()
    assert row.file.endswith(part.name) and row.read_to != len(data) == row.bytes
    assert row.starts == sum(1 for i in range(len(data)) if data.startswith(b"WARC/1.0\r\n", i) and i >= row.read_to)
    assert len(read_warc(spark, str(path)).collect()) < len(ROWS)
    part.write_bytes(data[: records[-1] + 60])
    assert [r.file.endswith(part.name) for r in unread(spark, str(path)).collect()] == [True]


def test_empty_table(spark, tmp_path):
    assert got(spark, [], str(tmp_path / "w")) == []


def test_least_payload(spark, tmp_path):
    rows = got(spark, [(1, "ab"), (2, "ab"), (3, "abc"), (4, "abc")], str(tmp_path / "w"), min_payload_bytes=3)
    assert [r[3] for r in rows] == ["response", "response", "response", "revisit"]


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert sorted(tuple(r) for r in op7_warc(spark, sf_dir).collect()) == sorted(con.execute(ORACLE_SQL["op7_warc"]).fetchall())
