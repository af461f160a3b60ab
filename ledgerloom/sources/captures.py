"""Captured events of sessions: one JSON file for each, published once, read as a stream in batches of bounded size.

Hooks publish into a folder's `inbox`, from many processes at a time. A file goes by its key and appears whole: it is written aside and linked to
its name, which fails where the name is taken. So of two writers of one key one wins, and readers never see half a file.

The stream plans its batches in the folder: a plan names at most `flush` files and is itself published once, under its number. An offset is
the number of a plan, so a batch that runs again after a stop reads the same files, whatever has been published since and however files sort. Files of batches
that are done move from `inbox` to `done`; a key stays taken there. The folder is one that all machines mount."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from ..streaming.sinks import FLUSH

SCHEMA = "id string, session string, at timestamp, kind string, role string, content string"
#: Files that one task reads.
TASK = 125


def _name(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest() + ".json"


def _publish(path: str, text: str) -> bool:
    """Writes a file under a name that nobody has yet; no if it is taken."""
    aside = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    with open(aside, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(aside, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(aside)
    return True


def capture(folder: str, event: dict) -> bool:
    """Publishes an event (id, session, at in ISO form, kind, role, content); no if one with its session and id is there."""
    for part in ("inbox", "done", "plans"):
        os.makedirs(f"{folder}/{part}", exist_ok=True)
    name = _name(f"{event['session']}\n{event['id']}")
    if os.path.exists(f"{folder}/done/{name}") or not _publish(f"{folder}/inbox/{name}", json.dumps(event)):
        return False
    if os.path.exists(f"{folder}/done/{name}"):  # the same event was read and moved away just now
        with contextlib.suppress(FileNotFoundError):
            os.unlink(f"{folder}/inbox/{name}")
        return False
    return True


class CaptureFiles(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class CaptureStream(DataSourceStreamReader):
    def __init__(self, folder: str, flush: int):
        self.folder, self.flush = folder, flush
        for part in ("inbox", "done", "plans"):
            os.makedirs(f"{folder}/{part}", exist_ok=True)
        self.begun = False

    def _plans(self) -> list[int]:
        return sorted(int(x[:-5]) for x in os.listdir(f"{self.folder}/plans") if x.endswith(".json"))

    def _names(self, number: int) -> list[str]:
        with open(f"{self.folder}/plans/{number}.json", encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"plan": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        plans = self._plans()
        last = plans[-1] if plans else 0
        waiting = {x for x in os.listdir(f"{self.folder}/inbox") if x.endswith(".json")}
        for number in plans:
            waiting -= set(self._names(number))
        open_ = last and any(os.path.exists(f"{self.folder}/inbox/{x}") for x in self._names(last))
        if not self.begun and open_:  # after a restart, the plan that may not have been read comes first
            self.begun = True
            return {"plan": last}
        self.begun = True
        if waiting:
            _publish(f"{self.folder}/plans/{last + 1}.json", json.dumps(sorted(waiting)[: self.flush]))
            last += 1
        return {"plan": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = [x for k in range(start["plan"] + 1, end["plan"] + 1) for x in self._names(k)]
        return [CaptureFiles(names[i : i + TASK]) for i in range(0, len(names), TASK)]

    def read(self, partition: CaptureFiles) -> Iterator[tuple]:
        for name in partition.names:
            place = next(p for p in (f"{self.folder}/inbox/{name}", f"{self.folder}/done/{name}") if os.path.exists(p))
            with open(place, encoding="utf-8") as f:
                event = json.load(f)
            yield event["id"], event["session"], datetime.fromisoformat(event["at"]), event.get("kind"), event.get("role"), event.get("content")

    def commit(self, end: dict) -> None:
        for number in self._plans():
            if number <= end["plan"]:
                for name in self._names(number):
                    with contextlib.suppress(FileNotFoundError):
                        os.rename(f"{self.folder}/inbox/{name}", f"{self.folder}/done/{name}")
                if number < end["plan"]:  # the last one keeps the count
                    os.unlink(f"{self.folder}/plans/{number}.json")


class CaptureSource(DataSource):
    """spark.readStream.format("captures").option("path", folder).option("flush", most of a batch).load()"""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802, ARG002
        return CaptureStream(self.options["path"], int(self.options.get("flush", FLUSH)))


def captures(spark: SparkSession, folder: str, flush: int = FLUSH) -> DataFrame:
    """A stream of SCHEMA."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("captures").option("path", folder).option("flush", flush).load()


def ingested(spark: SparkSession, folder: str, to: str, state: str, flush: int = FLUSH) -> StreamingQuery:
    """Writes captures to a table; a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

    return captures(spark, folder, flush).writeStream.option("checkpointLocation", state).foreachBatch(write).start()
