"""Verdicts on turns from a stream, each once: whether what a turn used was corrected, not corrected, or never judged.

A prompt opens a turn and puts the one before it up for a verdict. A verdict settles it; if none comes within WAIT_S of event time, or
another prompt comes first, it is withheld; the end of a session settles what is open and confirms nothing. A turn goes by the id of its prompt, so a
session that goes on after its end, or after its state has gone, gives no id twice; events that come again within the watermark are dropped, as are
rows later than it. State is kept for a session's open and pending turn alone: it goes with the session's end, or when
nothing has come for IDLE_S of event time. It lives in the query's checkpoint and survives a restart."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import state_in_rocksdb

#: Seconds that a turn waits for its verdict, and after which a session without events is over.
WAIT_S, IDLE_S = 60, 7 * 24 * 3600
OUT = "id string, session string, turn string, verdict string"
STATE = "open string, pending string, since long, last long"


def verdict_id(session: str, turn: str) -> str:
    return "verdict:" + hashlib.sha256(f"{session}\n{turn}".encode()).hexdigest()


def step(state: tuple, at: int, event: str, kind: str, correction: bool | None, wait: int = WAIT_S) -> tuple[tuple, list[tuple[str, str]]]:
    """(open turn, pending turn, its time in ms) and an event -> the state after it and settled turns."""
    turn, pending, since = state
    out = [(pending, "withheld")] if pending and (at - since >= wait * 1000 or kind == "prompt") else []
    if out:
        pending = None
    if kind == "prompt":
        return (event, turn, at), out
    if kind == "verdict" and pending:
        return (turn, None, 0), [*out, (pending, "correction" if correction else "no_correction")]
    if kind == "end":
        return (None, None, 0), [*out, *((t, "session_end") for t in (pending, turn) if t)]
    return (turn, pending, since if pending else 0), out


class Settlement(StatefulProcessor):
    def __init__(self, wait: int, idle: int):
        self.wait, self.idle = wait, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("turns", STATE)

    def _settled(self, session: str, turns: list) -> pd.DataFrame:
        return pd.DataFrame([(verdict_id(session, t), session, t, v) for t, v in turns], columns=["id", "session", "turn", "verdict"])

    def _keep(self, now: tuple, last: int, watermark: int) -> None:
        """The state with one timer, for what is due first; nothing where no turn is open or pending."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not (now[0] or now[1]):
            self.state.clear()
            return
        self.state.update((*now, last))
        self.handle.registerTimer(max(watermark + 1, min([last + self.idle * 1000, *([now[2] + self.wait * 1000] if now[1] else [])])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = max(0, timerValues.getCurrentWatermarkInMs())
        *now, last = self.state.get() if self.state.exists() else (None, None, 0, 0)
        events, out = pd.concat(list(rows)).sort_values(["at", "id"]), []
        if last + self.idle * 1000 <= watermark:  # its timer is due in this batch
            now, out = (None, None, 0), [(now[1], "withheld")] if now[1] else []
        for event, at, kind, correction in zip(events["id"], events["at"], events["kind"], events["correction"], strict=True):
            at = int(at.value // 1_000_000)
            if at >= watermark:
                now, settled = step(tuple(now), at, event, kind, bool(correction), self.wait)
                last, out = max(last, at), out + settled
        self._keep(tuple(now), last, watermark)
        yield self._settled(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turn, pending, since, last = self.state.get()
        watermark = timerValues.getCurrentWatermarkInMs()
        out = [(pending, "withheld")] if pending and since + self.wait * 1000 <= watermark else []
        over = last + self.idle * 1000 <= watermark
        self._keep((None, None, 0) if over else (turn, None if out else pending, since), last, watermark)
        yield self._settled(key[0], out)

    def close(self) -> None:
        pass


def verdicts(events: DataFrame, late: str = "10 seconds", wait: int = WAIT_S, idle: int = IDLE_S) -> DataFrame:
    """A stream of (session, at timestamp, id, kind prompt | verdict | end | other, correction) -> a stream of OUT."""
    state_in_rocksdb(events.sparkSession)
    rows = events.select("session", "at", "id", "kind", F.coalesce("correction", F.lit(False)).alias("correction")).withWatermark("at", late)
    rows = rows.dropDuplicatesWithinWatermark(["session", "id"])
    return rows.groupBy("session").transformWithStateInPandas(Settlement(wait, idle), OUT, "append", "eventtime")


def windows(events: DataFrame, late: str = "1 hour") -> dict[str, DataFrame]:
    """Counts of (at, kind) by fixed, sliding and session windows behind a watermark; for streams as well as tables."""
    rows = events.select("at", "kind").withWatermark("at", late)
    kinds = {"fixed": F.window("at", "1 hour"), "sliding": F.window("at", "1 hour", "30 minutes"), "session": F.session_window("at", "10 minutes")}
    return {k: rows.groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select("w.start", "w.end", "kind", "n") for k, w in kinds.items()}
