"""Undo logs and recently used lists as state of a stream: bounded lists by key that outlive the query in its checkpoint.

Each trigger gives the whole list of every key that it changed, with ``version`` counting the key's changes, so that the
rows of a key's largest version are its list and a sink that replaces a key's rows may see a trigger twice
(``latest``, ``replaced``). Rows of a key are taken in the order of ``seq`` inside a trigger, and trigger after trigger.

State is kept in RocksDB: call ``state_store`` on the session first. With ``idle`` seconds a key that has not changed
for so long by the clock is forgotten, and gives an empty list.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pixelmill.operators.edits import RECENT, UNDO_DEPTH
from pixelmill.runtime import ship

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "place long, seq long, value string"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Lists(StatefulProcessor):
    """Keeps a list of (seq, value), latest first; a subclass says what a row does to it."""

    def __init__(self, key: str, idle: float | None) -> None:
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.list = handle.getListState("list", "seq long, value string")
        self.version = handle.getValueState("version", "version long")
        self.timer = handle.getValueState("timer", "at long")

    def changed(self, old: list[tuple[int, str]], row: Row) -> list[tuple[int, str]]:
        raise NotImplementedError

    def _told(self, key: tuple, entries: list[tuple[int, str]]) -> Iterator[Row]:
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        for k, (seq, value) in enumerate(entries, 1) if entries else [(0, (None, None))]:  # place 0 tells of an empty list
            yield Row(**{self.key: key[0], "version": version, "place": k, "seq": seq, "value": value})

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        entries = [tuple(e) for e in self.list.get()] if self.list.exists() else []
        for row in sorted(rows, key=lambda r: r["seq"]):
            entries = self.changed(entries, row)
        if entries:
            self.list.put(entries)
        else:
            self.list.clear()
        if self.idle is not None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000)
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield from self._told(key, entries)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.list.clear()
        self.timer.clear()
        yield from self._told(key, [])

    def close(self) -> None:
        pass


class UndoLog(_Lists):
    """``edit`` adds to the log, whose oldest entry beyond ``UNDO_DEPTH`` goes; ``undo`` takes the last one off, ``clear`` all."""

    def changed(self, old: list[tuple[int, str]], row: Row) -> list[tuple[int, str]]:
        if row["action"] == "clear":
            return []
        return old[1:] if row["action"] == "undo" else [(row["seq"], row["value"]), *old][:UNDO_DEPTH]


class RecentList(_Lists):
    """``use`` puts a value in front, once, and the last one beyond ``RECENT`` goes; ``clear`` takes all off."""

    def changed(self, old: list[tuple[int, str]], row: Row) -> list[tuple[int, str]]:
        if row["action"] == "clear":
            return []
        return [(row["seq"], row["value"]), *[e for e in old if e[1] != row["value"]]][:RECENT]


def _stateful(log: DataFrame, key: str, processor: type[_Lists], idle: float | None) -> DataFrame:
    ship(log.sparkSession)
    kind = log.schema[key].dataType.simpleString()
    grouped = log.select(key, F.col("seq").cast("long").alias("seq"), F.col("action").cast("string").alias("action"), F.col("value").cast("string").alias("value")).groupBy(key)
    return grouped.transformWithState(processor(key, idle), f"`{key}` {kind}, version long, {_ROW}", "Update", "none" if idle is None else "processingTime")


def undo_stream(log: DataFrame, key: str = "image_id", idle: float | None = None) -> DataFrame:
    """A stream ``log(key, seq, action, value)`` of edits and undos to ``key, version, place, seq, value``, place 1 the latest edit."""
    return _stateful(log, key, UndoLog, idle)


def recent_stream(log: DataFrame, key: str = "user_id", idle: float | None = None) -> DataFrame:
    """A stream ``log(key, seq, action, value)`` of what is used to ``key, version, place, seq, value``, place 1 used last."""
    return _stateful(log, key, RecentList, idle)


def latest(told: DataFrame, key: str) -> DataFrame:
    """The lists as they are, out of all that a stream has told: the rows of each key's largest version."""
    last = told.groupBy(key).agg(F.max("version").alias("version"))
    return told.join(last, [key, "version"]).where("place > 0").distinct()


def replaced(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """A table of lists with those of a trigger's keys in place of older ones; the same again if the trigger comes twice."""
    both = table.unionByName(batch)
    newest = F.max("version").over(Window.partitionBy(key))
    return both.withColumn("_newest", newest).where("version = _newest").drop("_newest").distinct()
