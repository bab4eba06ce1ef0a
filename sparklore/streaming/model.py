"""Models that answer prompts: a table of stored answers, or calls within the tasks.

Calls are dear and must not be made again for a task that is run again. So each answer goes into a journal as it comes, a file
under the prompt's hash, and a prompt that has one is not asked for. A call has a time limit; one that fails for a
reason that may pass is made again a few times, with growing pauses.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import schemas

#: From (context_id, system, prompt) to (context_id, response); a table of stored answers will do.
Model = Callable[[DataFrame], DataFrame]
FAILED = "request failed: "


def answers(table: DataFrame) -> Model:
    """A model that looks its answers up in ``table`` (context_id, response)."""
    return lambda prompts: prompts.select("context_id").join(table, "context_id")


@dataclass(frozen=True)
class Calls:
    """How calls are made: seconds until one is given up, how often it is made again, first pause, and how many a task has under way."""

    seconds: float = 120.0
    retries: int = 2
    pause: float = 1.0
    in_flight: int = 4
    #: Failures that may pass: an overloaded or unreachable service. Others, such as a wrong key, are not tried again.
    passing: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError, OSError)


class Journal:
    """Answers by the hash of their prompts below ``path``, in any store that Arrow's file systems open."""

    def __init__(self, path: str):
        self.path = path

    @staticmethod
    def key(system: str, prompt: str) -> str:
        return hashlib.sha256(f"{len(system)} {system}{prompt}".encode()).hexdigest()

    def _at(self, key: str):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"/{self.path.removeprefix('file:').lstrip('/')}")
        return store, f"{root.rstrip('/')}/{key[:2]}", key

    def get(self, key: str) -> str | None:
        store, folder, name = self._at(key)
        try:
            with store.open_input_stream(f"{folder}/{name}") as file:
                return file.read().decode()
        except FileNotFoundError:
            return None

    def put(self, key: str, answer: str) -> None:
        """Whole or not at all: the file is moved to its name when it is written."""
        store, folder, name = self._at(key)
        store.create_dir(folder, recursive=True)
        part = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as file:
            file.write(answer.encode())
        store.move(part, f"{folder}/{name}")


def within(seconds: float, call: Callable[[], str]) -> str:
    """What ``call`` returns or raises, or a TimeoutError; a call that hangs is left behind in a thread that nobody waits for."""
    out: list = []

    def run():
        try:
            out.append((call(), None))
        except Exception as e:  # whatever the caller's client raises
            out.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        raise TimeoutError(f"no answer within {seconds:g} s")
    if out[0][1] is not None:
        raise out[0][1]
    return out[0][0]


def answered(complete: Callable[[str, str], str], system: str, prompt: str, journal: Journal | None, calls: Calls) -> str:
    """The answer to one prompt: from the journal, or from calls; after the last failing one a text that is no proper answer."""
    key = Journal.key(system, prompt)
    known = journal.get(key) if journal else None
    if known is not None:
        return known
    for turn in range(calls.retries + 1):
        try:
            answer = within(calls.seconds, lambda: complete(system, prompt))
        except Exception as e:  # whatever the caller's client raises
            if turn == calls.retries or not isinstance(e, calls.passing):
                return f"{FAILED}{e}"
            time.sleep(calls.pause * 2**turn)
        else:
            if journal:
                journal.put(key, answer)
            return answer
    raise AssertionError


def asked(complete: Callable[[str, str], str], journal: str | None = None, calls: Calls = Calls()) -> Model:  # noqa: B008
    """A model that asks ``complete`` (system text, prompt) within the tasks; ``journal`` is a folder that all of them share.

    Equal prompts have one answer. Failing calls are not in the journal, so a later pass makes them again.
    """

    def run(frames):
        kept = Journal(journal) if journal else None
        for frame in frames:
            with ThreadPoolExecutor(calls.in_flight) as pool:
                out = list(pool.map(lambda p: answered(complete, *p, kept, calls), zip(frame["system"], frame["prompt"])))
            yield frame[["context_id"]].assign(response=out)

    return lambda prompts: prompts.mapInPandas(run, schemas.RESPONSES)
