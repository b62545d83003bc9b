"""Change notification: one message for each statement that touched a row, to listeners and to a change log."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: channel names are cut to so many characters.
CHANNEL_LENGTH = 63
LOG_SCHEMA = "channel string, version long, at timestamp"


def channel_name(schema: str, table: str) -> str:
    return f"{schema}_{table}_changed"[:CHANNEL_LENGTH]


class Notifier:
    """Listeners by channel, and the log that other processes stream from."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._listeners: dict[str, list[Callable[[str], None]]] = {}

    def listen(self, channel: str, fn: Callable[[str], None]) -> None:
        self._listeners.setdefault(channel, []).append(fn)

    def unlisten(self, channel: str, fn: Callable[[str], None] | None = None) -> None:
        """Remove a listener, or all of a channel (``*``: of all channels)."""
        if channel == "*":
            self._listeners.clear()
        elif fn is None:
            self._listeners.pop(channel, None)
        elif fn in self._listeners.get(channel, []):
            self._listeners[channel].remove(fn)

    def notify(self, channel: str, log: str | None = None, version: int = 0) -> None:
        if log:
            row = [(channel, version, datetime.now(timezone.utc))]
            self._spark.createDataFrame(row, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(log)
        for fn in list(self._listeners.get(channel, [])):
            fn(channel)


def changes(spark: SparkSession, log: str) -> DataFrame:
    """The change log as a stream."""
    return spark.readStream.schema(LOG_SCHEMA).parquet(log)
