"""Extensions beyond the batch operators: the audit over a stream of inventory rows, the cache's life over a stream of its rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.audit import with_issues


def audit_stream(tracks: DataFrame, sidecars: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts of issues by hour of modification over a stream of tracks; sidecars are a static table."""
    audited = with_issues(tracks.withWatermark("modified", delay), sidecars)
    return audited.groupBy(F.window("modified", "1 hour")).agg(F.count("*").alias("files"), F.count_if(F.size("issues") > 0).alias("files_with_issues"))


class _Entry(StatefulProcessor):
    """One key's live entry; a timer at its expiry, which a newer entry moves."""

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "stored_us bigint, expires_ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(rows).sort_values(["stored_us", "value_json"]).drop_duplicates("stored_us", keep="last")
        held = self.entry.get() if self.entry.exists() else None
        first = held
        out = []
        for stored, expires, value in zip(rows["stored_us"], rows["expires_us"], rows["value_json"], strict=True):
            if held is not None and stored <= held[0]:
                continue  # late: a newer one is there
            if held is not None and held[1] * 1000 < stored:
                out.append((key[0], held[1] * 1000, "expired", None))
            out.append((key[0], stored, "put", value))
            held = (int(stored), int(expires) // 1000)
        if held is not None and held != first:
            if first is not None:
                self.handle.deleteTimer(first[1])
            self.entry.update(held)
            self.handle.registerTimer(held[1])
        yield pd.DataFrame(out, columns=["key", "at_us", "change", "value_json"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.entry.clear()
        yield pd.DataFrame([(key[0], expiredTimerInfo.getExpiryTimeInMs() * 1000, "expired", None)], columns=["key", "at_us", "change", "value_json"])

    def close(self) -> None:
        pass


def cache_changes(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(key, at, change, value_json) as ``operators.cache.changes``, over a stream of cache rows: state is a key's live entry only, gone when it expires.

    An entry expires when the watermark, ``delay`` behind the latest stored_at, passes expires_at (whole milliseconds).
    Rows later than that may find a newer entry of their key, and are then left out.  The session's
    state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    us = rows.withWatermark("stored_at", delay).select("key", "value_json", "stored_at", F.unix_micros("stored_at").alias("stored_us"), F.unix_micros("expires_at").alias("expires_us"))
    out = us.groupBy("key").transformWithStateInPandas(_Entry(), "key string, at_us bigint, change string, value_json string", "Append", "EventTime")
    return out.select("key", F.timestamp_micros("at_us").alias("at"), "change", "value_json")
