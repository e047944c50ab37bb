"""Scores from an external process: one child a partition, kept over all its batches and fed while it answers."""

from __future__ import annotations

import json
import subprocess
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

REPLY = "id string, turn int, lead double, error string"
IN_FLIGHT = 256


class Child:
    """A process that takes and gives JSON lines, in any order of its own; what it says first of a key counts."""

    def __init__(self, command: list[str], in_flight: int) -> None:
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        self.room = threading.Semaphore(in_flight)
        self.waiting: dict[tuple, str] = {}
        self.answers: dict[tuple, dict] = {}
        self.changed = threading.Condition()
        self.ended = False
        self.reader = threading.Thread(target=self._read, daemon=True)
        self.reader.start()

    def _read(self) -> None:
        for line in self.process.stdout:
            try:
                reply = json.loads(line)
            except ValueError:
                continue  # not every line of a process is an answer
            if not isinstance(reply, dict) or ("warning" in reply and "error" not in reply and "lead" not in reply):
                continue
            with self.changed:
                if self.waiting.pop(key := (reply.get("id"), reply.get("turn")), None) is not None:
                    self.answers[key] = reply
                    self.room.release()
                    self.changed.notify_all()
        with self.changed:
            self.ended = True
            for _ in self.waiting:
                self.room.release()
            self.changed.notify_all()

    def ask(self, key: tuple, line: str) -> None:
        """Send a request as soon as fewer than the bound are open."""
        self.room.acquire()
        with self.changed:
            if self.ended:
                return
            self.waiting[key] = line
        try:
            self.process.stdin.write(line)
        except BrokenPipeError:
            pass

    def take(self, keys: list[tuple], timeout: float) -> dict[tuple, dict]:
        """The answers to these requests; those that have none when the process ends or falls silent are left out."""
        self._flush()
        with self.changed:
            while not self.ended and any(k in self.waiting for k in keys):
                if not self.changed.wait(timeout):
                    break
            for k in keys:
                if self.waiting.pop(k, None) is not None and not self.ended:
                    self.room.release()
            return {k: self.answers.pop(k) for k in keys if k in self.answers}

    def _flush(self) -> None:
        try:
            if not self.process.stdin.closed:
                self.process.stdin.flush()
        except BrokenPipeError:
            pass

    def close_input(self) -> None:
        """Tell the process that no request follows."""
        try:
            self.process.stdin.close()
        except BrokenPipeError:
            pass

    def finish(self) -> int:
        self.close_input()
        self.reader.join()
        return self.process.wait()


def score_with(positions: DataFrame, command: list[str], in_flight: int = IN_FLIGHT, timeout: float = 600.0) -> DataFrame:
    """REPLY rows for positions (id, turn, request): each request is a JSON line to the child, keyed by id and turn.

    A child starts with its partition's first batch and serves all of them; at most ``in_flight`` requests are open at
    a time, so it has to answer as it goes, and replies are matched by key in any order. Its input is closed after the
    last request. A position asked twice in a batch has one answer. A reply with
    an error, and a position that got none within ``timeout`` seconds of silence, has its error in the row; a child that
    fails makes the task fail, so that it is tried again.
    """

    def rows_of(child: Child, keys: list[tuple]) -> pd.DataFrame:
        replies = child.take(list(dict.fromkeys(keys)), timeout)
        if child.ended and (code := child.finish()):
            raise RuntimeError(f"the scorer ended with {code}")
        found = [(k, replies.get(k, {"error": "no reply"})) for k in keys]
        return pd.DataFrame([(*k, r.get("lead"), r.get("error")) for k, r in found], columns=["id", "turn", "lead", "error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child, open_keys = None, None
        try:
            for batch in batches:
                child = child or Child(command, in_flight)
                keys = [(i, int(t)) for i, t in zip(batch["id"], batch["turn"])]
                for key, request in dict(zip(keys, batch["request"])).items():
                    child.ask(key, json.dumps({"id": key[0], "turn": key[1], "request": request}) + "\n")
                if open_keys is not None:  # the batch before, while this one is at work
                    yield rows_of(child, open_keys)
                open_keys = keys
            if child:
                child.close_input()
                yield rows_of(child, open_keys)
                if code := child.finish():
                    raise RuntimeError(f"the scorer ended with {code}")
        finally:
            if child and child.process.poll() is None:
                child.process.kill()
                child.process.wait()

    return positions.select("id", "turn", "request").mapInPandas(run, REPLY)
