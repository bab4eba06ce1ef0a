import time

from sparklore.streaming.changes import changed_files
from sparklore.streaming.runner import start


def wait(until, seconds=90):
    end = time.time() + seconds
    while not until() and time.time() < end:
        time.sleep(0.3)
    return until()


def test_files_that_grow_or_shrink_come_again_also_after_a_restart(spark, tmp_path):
    logs, got = tmp_path / "logs", []
    (logs / "p").mkdir(parents=True)
    (logs / "p" / "a.jsonl").write_text("one\n")
    (logs / "p" / "b.jsonl").write_text("two\n")
    (logs / "other.txt").write_text("no log")

    def query():
        stream = changed_files(spark, [str(logs), str(tmp_path / "missing")], str(tmp_path / "snapshots"), quiet=2, most=30, idle=10**6)
        each = lambda batch, n: got.append(sorted((r.path.rpartition("/")[2], r.size, r.was) for r in batch.collect()))
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="500 milliseconds").start()

    q = query()
    assert wait(lambda: got) and got[0] == [("a.jsonl", 4, None), ("b.jsonl", 4, None)]
    for n in range(4):  # a burst is one batch
        (logs / "p" / f"c{n}.jsonl").write_text("x" * n)
        time.sleep(0.4)
    (logs / "p" / "a.jsonl").write_text("o")
    assert wait(lambda: len(got) > 1) and got[1] == [("a.jsonl", 1, 4), *[(f"c{n}.jsonl", n, None) for n in range(4)]]
    q.stop()
    (logs / "p" / "b.jsonl").write_text("two and more\n")
    (logs / "p" / "c0.jsonl").unlink()
    q = query()
    assert wait(lambda: len(got) > 2) and got[2] == [("b.jsonl", 13, 4), ("c0.jsonl", None, 0)]
    time.sleep(3)
    q.stop()
    assert len(got) == 3


def test_passes_run_when_files_change(spark, tmp_path):
    logs, passes = tmp_path / "logs", []
    logs.mkdir()
    (logs / "a.jsonl").write_text("one\n")
    q = start(spark, lambda: passes.append(1), str(tmp_path / "checkpoint"), 1, watch=[str(logs)], quiet=1)
    assert wait(lambda: len(passes) == 1)
    (logs / "a.jsonl").write_text("one and more\n")
    assert wait(lambda: len(passes) == 2)
    q.stop()
    q = start(spark, lambda: passes.append(1), str(tmp_path / "checkpoint2"), None, watch=[str(logs)])
    q.awaitTermination(60)
    assert len(passes) == 3
