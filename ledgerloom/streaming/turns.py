"""Turns of sessions from a stream of events: a turn opens on an opening event and settles when the next one comes.

State of a session: number and counters of its open turn. A settled turn has a deterministic key (session, turn_no) and
is emitted once; the open turn stays in state, as nothing settles it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import shared_path

OUT = "user_id long, turn_no long, injected long, edits long"
STATE = "turn_no long, injected long, edits long"


def _settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turn, injected, edits = state.get if state.exists else (0, 0, 0)
    rows, out = pd.concat(list(frames)).sort_values(["ts", "event_id"]), []
    for kind in rows["event_type"]:
        if kind == "signup":
            if turn:
                out.append((key[0], turn, injected, edits))
            turn, injected, edits = turn + 1, 0, 0
        elif turn:
            injected, edits = injected + (kind == "view"), edits + (kind == "purchase")
    state.update((turn, injected, edits))
    yield pd.DataFrame(out, columns=["user_id", "turn_no", "injected", "edits"])


def settled_turns(events: DataFrame) -> DataFrame:
    """A stream of (user_id, ts, event_id, event_type) -> a stream of settled turns. Events must come in order of time
    from batch to batch; within one they are sorted."""
    rows = events.select("user_id", "ts", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(_settle, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for what is there now, by way of files in the shared folder."""
    spark, place = stream.sparkSession, shared_path(stream.sparkSession, name)
    done = stream.writeStream.format("parquet").option("checkpointLocation", place + "/state").trigger(availableNow=True).start(place + "/rows")
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(place + "/rows")
