"""Which captured texts may go, from a stream: what has been learnt from and nothing needs any more.

A capture's text goes once it has been extracted, unless it is context of the next extraction (the last CONTEXT extracted ones and what
working memory quotes) or a prompt whose turn before waits for its verdict. When a session has ended, all is extracted and all
turns are settled, the context goes too. When nothing has come for IDLE_S of event time, all goes. What is still needed is state of the
session, in the query's checkpoint; a capture leaves it with its text, and the rest with the session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import state_in_rocksdb
from .verdicts import IDLE_S

#: Fixed value: extracted captures that the next extraction still shows.
CONTEXT = 6
OUT = "session string, id string, reason string"


class Retention(StatefulProcessor):
    def __init__(self, idle: int, judged: bool):
        self.idle, self.judged = idle, judged

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.captures = handle.getListState("captures", "id string, done boolean, erased boolean")
        self.prompts = handle.getListState("prompts", "id string, settled boolean")
        self.session = handle.getValueState("session", "ended boolean, last long, working array<string>")

    def _forget(self) -> None:
        for state in (self.captures, self.prompts, self.session):
            state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _stale(self, session: str) -> pd.DataFrame:
        left = [i for i, _, erased in self.captures.get() if not erased]
        self._forget()
        return pd.DataFrame([(session, i, "stale") for i in left], columns=["session", "id", "reason"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.session.exists() and self.session.get()[1] + self.idle * 1000 <= timerValues.getCurrentWatermarkInMs():
            yield self._stale(key[0])  # its timer is due in this batch
        captures = {i: [done, erased] for i, done, erased in self.captures.get()}
        prompts = dict(self.prompts.get())
        ended, last, working = self.session.get() if self.session.exists() else (False, 0, [])
        events = pd.concat(list(rows)).sort_values(["at", "id"])
        for event, at, kind, refs, kept in zip(events["id"], events["at"], events["kind"], events["refs"], events["working"], strict=True):
            last = max(last, int(at.value // 1_000_000))
            if kind == "extracted":
                for i in refs if refs is not None else ():
                    if i in captures:
                        captures[i][0] = True
                working = list(kept) if kept is not None else []
            elif kind == "settled":
                prompts |= {i: True for i in (refs if refs is not None else ()) if i in prompts}
            else:
                captures.setdefault(event, [False, False])
                ended = ended or kind == "end"
                if kind == "prompt":
                    prompts.setdefault(event, False)
        turns = list(prompts)
        waiting = {b for a, b in zip(turns[:-1], turns[1:], strict=True) if not prompts[a]} if self.judged else set()
        complete = ended and not waiting and all(done or erased for done, erased in captures.values()) and (not self.judged or not turns or prompts[turns[-1]])
        done = [i for i, (x, _) in captures.items() if x]
        context = set() if complete else {*working, *done[-CONTEXT:]}
        gone = [i for i in done if not captures[i][1] and i not in context and i not in waiting]
        for i in gone:
            captures[i][1] = True
        yield pd.DataFrame([(key[0], i, "complete" if complete else "extracted") for i in gone], columns=["session", "id", "reason"])
        self._forget()
        if complete:
            return
        recent = set(done[-CONTEXT:])
        if left := [(i, d, e) for i, (d, e) in captures.items() if not e or i in recent]:
            self.captures.put(left)
        if prompts:
            first = next((k for k, t in enumerate(turns) if not prompts[t]), len(turns) - 1)
            self.prompts.put([(t, prompts[t]) for t in turns[first:]])
        self.session.update((ended, last, working))
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, last + self.idle * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._stale(key[0])

    def close(self) -> None:
        pass


def erasable(events: DataFrame, late: str = "10 seconds", idle: int = IDLE_S, judged: bool = True) -> DataFrame:
    """A stream of (session, at timestamp, id, kind prompt | other | end | extracted | settled, refs, working array<string>) -> a stream of
    OUT: texts to erase. refs are the captures that were extracted, or the prompts whose turns were settled; working, what working memory quotes."""
    state_in_rocksdb(events.sparkSession)
    rows = events.select("session", "at", "id", "kind", "refs", "working").filter(F.col("session").isNotNull()).withWatermark("at", late)
    return rows.groupBy("session").transformWithStateInPandas(Retention(idle, judged), OUT, "append", "eventtime")
