import os

import pytest
from pyspark.sql import functions as F
from sparklore.plans import files
from sparklore.shared import file_store


@pytest.mark.parametrize("provider, depth", [("codex", 1), ("claude-code", 2), ("gemini", 3)])
def test_a_session_is_one_file_in_its_place(spark, tmp_path, provider, depth):
    """Also of a conversation with a negative id, or with none; a task leaves nothing beside its logs."""
    rows = spark.range(-2, 38).selectExpr("nullif(id, 37) as conv_id", "0L as turn", "'system' as role", "concat('é', id) as text")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    source = files.made(spark, str(tmp_path), provider)
    top = file_store(source.root)[1]
    found = [os.path.relpath(f"{at}/{name}", top) for at, _, names in os.walk(top) for name in names]
    names = sorted(r.session_id for r in source.sessions(spark).collect())
    assert len(found) == 39 and all(f.count("/") == depth - 1 and f.endswith((".json", ".jsonl")) for f in found)
    assert names == sorted(os.path.basename(f).rpartition(".")[0] for f in found) == sorted(f"s{n}" for n in range(-2, 37))


def test_lines_of_a_log_keep_their_order(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 2).alias("conv"), (-F.col("id")).alias("turn"), F.when(F.col("id") > 3, F.col("id").cast("string")).alias("value"))
    for _ in range(2):  # what is written again is put in place of what there was
        files._write(rows.repartition(8), f"file://{tmp_path}", files._name(".log", "p", F.col("conv"), "/"))
    for n in range(2):
        want = [str(k) if k > 3 else "" for k in range(2998 + n, -1, -2)]
        assert (tmp_path / f"p{n}" / f"s{n}.log").read_text().split("\n") == [*want, ""]


def test_answers_of_a_pass_are_parsed_in_several_tasks(spark, sf_dir, monkeypatch):
    """They are few bytes, so Spark would make one partition of them."""
    seen, parse = [], files.R.parse_extractions
    monkeypatch.setattr(files.R, "parse_extractions", lambda rows: seen.append(rows.rdd.getNumPartitions()) or parse(rows))
    files.whole_pass(spark, sf_dir).collect()
    assert seen == [spark.sparkContext.defaultParallelism]
