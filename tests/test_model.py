import os
import time
from decimal import Decimal

import pytest
from sparklore.streaming.model import FAILED, Calls, Journal, asked

SCHEMA = "context_id decimal(20,0), system string, prompt string"


def told(path, prompt):
    with open(f"{path}/{prompt}-{time.time_ns()}-{os.getpid()}", "w"):
        pass


def calls_of(path):
    return sorted(n.split("-")[0] for n in os.listdir(path))


def test_a_killed_task_does_not_ask_twice(spark, tmp_path):
    """The worker dies in its fourth call; when the prompts are asked again the answers of the first three are there."""
    made, fatal = tmp_path / "made", tmp_path / "fatal"
    made.mkdir()

    def complete(system, prompt):
        told(made, prompt)
        if prompt == "p3" and not fatal.exists():
            fatal.touch()
            os._exit(1)
        return f"answer to {prompt}"

    model = asked(complete, str(tmp_path / "journal"), Calls(in_flight=1))
    prompts = spark.createDataFrame([(Decimal(i), "s", f"p{i}") for i in range(6)], SCHEMA).coalesce(1)
    with pytest.raises(Exception):  # noqa: B017
        model(prompts).collect()
    got = {int(r.context_id): r.response for r in model(prompts).collect()}
    assert got == {i: f"answer to p{i}" for i in range(6)}
    assert calls_of(made) == ["p0", "p1", "p2", "p3", "p3", "p4", "p5"]
    assert len(model(prompts).collect()) == 6 and len(calls_of(made)) == 7


def test_time_limit_and_retries(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    def complete(system, prompt):
        told(made, prompt)
        turn = calls_of(made).count(prompt)
        if prompt == "hangs":
            time.sleep(60)
        if prompt == "passes" and turn < 3:
            raise ConnectionError("overloaded")
        if prompt == "wrong":
            raise ValueError("bad key")
        return f"{prompt} {turn}"

    model = asked(complete, f"file://{tmp_path}/journal", Calls(seconds=2, retries=2, pause=0.01))
    began = time.time()
    rows = [(Decimal(i), "s", p) for i, p in enumerate(["hangs", "passes", "wrong", "plain"])]
    got = {r.context_id: r.response for r in model(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(4)] == [f"{FAILED}no answer within 2 s", "passes 3", f"{FAILED}bad key", "plain 1"]
    assert calls_of(made) == ["hangs"] * 3 + ["passes"] * 3 + ["plain", "wrong"] and time.time() - began < 50
    journal = Journal(f"{tmp_path}/journal")
    assert journal.get(Journal.key("s", "passes")) == "passes 3" and journal.get(Journal.key("s", "wrong")) is None
    assert Journal.key("a", "bc") != Journal.key("ab", "c")
