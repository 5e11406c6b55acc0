"""Keyed state that holds a file until its lint report, its reviewers' answers or its extracted text have come, or waiting ends.

Events of a file share its id. A code file is complete when all named models have answered and, if its language is linted, a report
has come; an image when its text has come, which makes it a code file that waits for the rest. Time is event time: waiting ends
when the watermark passes the first event by the given time, so that a replay ends it at the same place. What comes for a file after
that is an orphan, and reported as one when its own waiting ends.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT = "file_id string, at timestamp, event string, path string, kind string, language string, content string, size long, tool string, model string, model_ord int, status string, body string"
READY = (
    "file_id string, path string, kind string, language string, content string, size long, outcome string, "
    "lint array<struct<tool:string,report:string>>, runs array<struct<model:string,model_ord:int,status:string,response:string>>"
)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# fixed values: events and outcomes
FILE, LINT, RUN, TEXT = "file", "lint", "run", "text"
COMPLETE, WAITED, ORPHAN, NO_TEXT = "complete", "waited", "orphan", "no text"


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType()}


def _schema(ddl: str) -> T.StructType:
    """Without a session, which workers do not have."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


class Waiting(StatefulProcessor):
    def __init__(self, models: tuple[str, ...], linted: tuple[str, ...], wait_ms: int) -> None:
        self.models, self.linted, self.wait_ms = frozenset(models), frozenset(linted), wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", _schema("path string, kind string, language string, content string, size long"))
        self.lint = handle.getListState("lint", _schema("tool string, report string"))
        self.runs = handle.getListState("runs", _schema("model string, model_ord int, status string, response string"))
        self.text = handle.getValueState("text", _schema("language string, content string"))
        self.due = handle.getValueState("due", _schema("ms long"))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        for r in rows:
            ms = int(r["at"].timestamp() * 1000)
            first = ms if first is None else min(first, ms)
            if r["event"] == FILE:
                self.file.update((r["path"], r["kind"], r["language"], r["content"], r["size"]))
            elif r["event"] == LINT:
                self.lint.appendValue((r["tool"], r["body"]))
            elif r["event"] == RUN:
                self.runs.appendValue((r["model"], r["model_ord"], r["status"], r["body"]))
            else:
                self.text.update((r["language"], r["body"]))
        if self._complete():
            yield self._ready(key, COMPLETE)
        elif not self.due.exists() and first is not None:
            self.due.update((first + self.wait_ms,))
            self.handle.registerTimer(first + self.wait_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        file = self.file.get() if self.file.exists() else None
        outcome = ORPHAN if file is None else NO_TEXT if file[1] == "image" and not self.text.exists() else WAITED
        yield self._ready(key, outcome)

    def close(self) -> None:
        pass

    def _complete(self) -> bool:
        if not self.file.exists():
            return False
        _, kind, language, _, _ = self.file.get()
        if kind == "image":
            if not self.text.exists():
                return False
            language = self.text.get()[0]
        elif kind != "code":
            return True
        answered = {r[0] for r in self.runs.get()} if self.runs.exists() else set()
        return self.models <= answered and (language not in self.linted or self.lint.exists())

    def _ready(self, key: tuple, outcome: str) -> Row:
        """What is known of the file; the state of its key is empty afterwards."""
        path, kind, language, content, size = self.file.get() if self.file.exists() else (None,) * 5
        if self.text.exists() and kind == "image":
            (language, content), kind = self.text.get(), "code"
        lint = [tuple(x) for x in self.lint.get()] if self.lint.exists() else []
        runs = [tuple(x) for x in self.runs.get()] if self.runs.exists() else []
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        for state in (self.file, self.lint, self.runs, self.text, self.due):
            state.clear()
        return Row(
            file_id=key[0], path=path, kind=kind, language=language, content=content, size=size, outcome=outcome, lint=lint, runs=runs
        )


def wait_for_parts(events: DataFrame, models: tuple[str, ...], linted: tuple[str, ...], wait_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """A stream of ``events`` (columns of ``EVENT``) to one of files with what came for them (columns of ``READY``)."""
    marked = events.withWatermark("at", delay)
    return marked.groupBy("file_id").transformWithState(Waiting(models, linted, wait_seconds * 1000), READY, "append", "eventTime")
