"""Streams of status events: recording on change, late arrivals, daily windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_FIELDS = ("id", "at", "status", "fingerprint", "alert")
_OUT = "key string, id array<long>, at array<long>, status array<string>, fingerprint array<string>, alert array<string>"  # a key's rows of a trigger are one
_STATE = "status string, recorded string, known string, last long, told boolean"


def alert_of(status: str, fingerprint: str | None, before: str | None, known: str | None) -> str:
    """As operators.history.alerts, for one event: before is the status before, known the last known fingerprint."""
    if status == "unreachable":
        return "nothing" if before == "unreachable" else "unreachable"
    if status == "drifted":
        if before != "drifted":
            return "reachable" if before == "unreachable" else "drifted"
        return "changed" if fingerprint is not None and known is not None and fingerprint != known else "nothing"
    if status == "in_sync" and before in ("drifted", "unreachable"):
        return "in_sync" if before == "drifted" else "reachable"
    return "nothing"


def _packed() -> Column:
    """An event's at, id, status and fingerprint as one text, for Spark hands each row to Python field by field: numbers, the status's length (-1: null), the status, = and the fingerprint (nothing: null)."""
    return F.concat(F.col("at"), F.lit(" "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.char_length("status"), F.lit(-1)), F.lit(" "), F.coalesce("status", F.lit("")), F.coalesce(F.concat(F.lit("="), "fingerprint"), F.lit("")))


def unpacked(event: str) -> tuple[int, int | None, str | None, str | None]:
    """at, id, status, fingerprint."""
    at, id, n, rest = event.split(" ", 3)
    n = int(n)
    return int(at), int(id) if id else None, rest[:n] if n >= 0 else None, rest[max(n, 0) + 1 :] if len(rest) > max(n, 0) else None


def _recorder(silent: int | None) -> StatefulProcessor:
    """A processor of one key's events; silent: milliseconds without an event after which a row says so. Made here, so that workers get it by value."""

    class Recorder(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", _STATE)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            first, state = not self.held.exists(), self.held.get()
            before, recorded, known, last, told = state if state else (None, None, None, None, False)
            due = None if last is None or told else last // 1000 + (silent or 0)
            out = []
            for at, id, status, fingerprint in sorted((unpacked(r.event) for r in rows), key=lambda r: r[:2]):
                if silent is not None and last is not None and not told and at - last > silent * 1000:
                    out.append((None, last + silent * 1000, "silent", None, "silent"))
                if first or status != before or (fingerprint is not None and fingerprint != recorded):
                    out.append((id, at, status, fingerprint, alert_of(status, fingerprint, before, known)))
                    recorded = fingerprint
                before, known, first, last, told = status, known if fingerprint is None else fingerprint, False, at, False
            if out:
                yield Row(key=key[0], **dict(zip(_FIELDS, map(list, zip(*out)))))
            self.held.update((before, recorded, known, last, told))
            if silent is not None:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(last // 1000 + silent)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            before, recorded, known, last, told = self.held.get()
            if not told:
                self.held.update((before, recorded, known, last, True))
                yield Row(key=key[0], id=[None], at=[last + silent * 1000], status=["silent"], fingerprint=[None], alert=["silent"])

        def close(self) -> None:
            pass

    return Recorder()


def recorded_on_change(events: DataFrame, silent: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events (key, id, ts, status, fingerprint) that go to the log, as operators.history.recorded_outcomes, with the alert each raises.

    With `silent` (an interval such as "6 hours") a row of status and alert "silent" and no id tells where a key had no event for longer:
    as soon as the next event comes, or by a timer once the watermark (ts less `delay`) has passed; once for each gap.
    The state is five values a key, in RocksDB. Events of one trigger are taken in (ts, id) order, so the result doesn't hang on how
    events in time order are cut into triggers; a trigger's events of one key are held together (limit triggers by files or rows)."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = events if silent is None else events.withWatermark("ts", delay)
    timed = timed.select("key", "id", F.unix_micros("ts").alias("at"), "status", "fingerprint", *([] if silent is None else ["ts"]))
    narrow = timed.select("key", _packed().alias("event"), *([] if silent is None else ["ts"]))
    wait = None if silent is None else spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {silent})").first()[0]
    made = narrow.groupBy("key").transformWithState(_recorder(wait), _OUT, "append", "none" if silent is None else "eventTime")
    made = made.select("key", F.inline(F.arrays_zip(*_FIELDS)))
    return made.select("key", "id", F.timestamp_micros("at").alias("ts"), "status", "fingerprint", "alert")


def without_late_repeats(events: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Each id once, late ones within the delay included."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def daily(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts and the largest value by UTC day, closed when the watermark passes."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("runs"), F.max("value").alias("max_value")).select(F.col("w.start").cast("date").alias("day"), "runs", "max_value")


def tick(events: DataFrame, path: str, checkpoint: str, seconds: int | None = None):
    """Start a query that appends to Parquet: every `seconds`, or once over what is there."""
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
