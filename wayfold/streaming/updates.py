"""Streams: point-file refreshes, and location updates with a gate, a throttle and a debounce."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfold.operators import blocks

# Worst accuracy and greatest age of a location used for routing, and the pauses between drawings and queries.
ACCURACY_METRES, AGE = 150.0, "30 seconds"
DRAW_MILLIS, PAUSE = 750, "350 milliseconds"


def usable(updates: DataFrame, now: Column | None = None) -> DataFrame:
    """updates (user_id, ts, accuracy, watching if any, ...) with `usable`: watched, accurate and at most AGE old at `now`
    (the current time by default); others stay in the stream."""
    at = F.current_timestamp() if now is None else now
    fresh = (F.col("accuracy") <= ACCURACY_METRES) & (F.col("ts") >= at - F.expr(f"interval {AGE}"))
    if "watching" in updates.columns:
        fresh = fresh & F.col("watching")
    return updates.withColumn("usable", F.coalesce(fresh, F.lit(False)))


def throttled(updates: DataFrame) -> DataFrame:
    """The first update of each user in every slot of 750 ms; state is dropped once the watermark passes a slot."""
    slot = F.floor(F.unix_millis("ts") / DRAW_MILLIS)
    return updates.withWatermark("ts", AGE).withColumn("slot", slot).dropDuplicatesWithinWatermark(["user_id", "slot"])


def latest(updates: DataFrame) -> DataFrame:
    """Each user's update with the greatest sequence number: late ones never replace it (output mode update or complete)."""
    return updates.groupBy("user_id").agg(F.max_by(F.struct("ts", "accuracy", "usable"), "sequence").alias("last"), F.max("sequence").alias("sequence")).select("user_id", "sequence", "last.*")


def debounced(updates: DataFrame) -> DataFrame:
    """The last update before each pause of 350 ms in a user's updates."""
    return updates.withWatermark("ts", AGE).groupBy("user_id", F.session_window("ts", PAUSE).alias("burst")).agg(F.max_by("sequence", F.struct("ts", "sequence")).alias("sequence"))


class Pen:
    """When a user's latest update is drawn: at once if the last drawing is DRAW_MILLIS old, else as soon as it is.

    Times are milliseconds. An update whose sequence number isn't greater than the latest one's came late and is dropped."""

    def __init__(self, drawn: int | None = None, latest: int | None = None, waiting: bool = False):
        self.drawn, self.latest, self.waiting = drawn, latest, waiting

    def due(self) -> int | None:
        return self.drawn + DRAW_MILLIS if self.waiting else None

    def until(self, now: int) -> Iterator[tuple[int, int]]:
        """(time, sequence) of the drawing that waits, if its time has come."""
        if self.waiting and self.due() <= now:
            self.drawn, self.waiting = self.due(), False
            yield self.drawn, self.latest

    def update(self, at: int, sequence: int) -> Iterator[tuple[int, int]]:
        """Drawings that an update brings about, one that waited till then first."""
        yield from self.until(at)
        if self.latest is not None and sequence <= self.latest:
            return
        self.latest = sequence
        if self.drawn is None or at >= self.drawn + DRAW_MILLIS:
            self.drawn = at
            yield at, sequence
        else:
            self.waiting = True


def _millis(df: DataFrame, column: str) -> Column:
    """Milliseconds since 1970 of a timestamp, or of one without a time zone as it stands."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', {column})")
    return F.unix_millis(column)


def drawings(updates: DataFrame) -> DataFrame:
    """(user_id, drawn_ms, sequence): all drawings of updates (user_id, ts, sequence) of a finished table, by Pen.

    Users are dealt over tasks and their updates sorted by time, then sequence; a task holds one user's state, however many
    updates there are. Updates without user, time or sequence are left out."""
    blocks.ship(updates.sparkSession)
    rows = updates.select(F.col("user_id").cast("bigint").alias("user_id"), _millis(updates, "ts").alias("at"), F.col("sequence").cast("bigint").alias("sequence")).dropna()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, pen, out = None, Pen(), []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["user_id", "drawn_ms", "sequence"])
            out.clear()
            return made

        for b in batches:
            for own, at, sequence in zip(*(b.column(c).to_pylist() for c in ("user_id", "at", "sequence")), strict=True):
                if own != user:
                    out.extend((user, *x) for x in pen.until(1 << 62))
                    user, pen = own, Pen()
                out.extend((user, *x) for x in pen.update(at, sequence))
            if len(out) > 10_000:
                yield batch()
        out.extend((user, *x) for x in pen.until(1 << 62))
        yield batch()

    dealt = rows.repartition(int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id").sortWithinPartitions("user_id", "at", "sequence")
    return dealt.mapInArrow(draw, "user_id bigint, drawn_ms bigint, sequence bigint")


class _Drawer(StatefulProcessor):
    """A user's Pen between micro-batches, with a timer for a drawing that waits and one for the end of the state."""

    def __init__(self, idle_millis: int):
        self.idle = idle_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pen = handle.getValueState("pen", "drawn bigint, latest bigint, waiting boolean, seen bigint")

    def _load(self) -> tuple[Pen, int]:
        if not self.pen.exists():
            return Pen(), 0
        drawn, latest, waiting, seen = self.pen.get()
        return Pen(drawn, latest, waiting), seen

    def _keep(self, pen: Pen, seen: int) -> None:
        self.pen.update((pen.drawn, pen.latest, pen.waiting, seen))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(pen.due() if pen.waiting else seen + self.idle)

    @staticmethod
    def _frame(key, drawn: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]] * len(drawn), "drawn_ms": [x for x, _ in drawn], "sequence": [x for _, x in drawn]}).astype("int64")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pen, seen = self._load()
        all_rows = pd.concat(list(rows)).sort_values(["at", "sequence"])
        drawn = [x for at, sequence in zip(all_rows["at"], all_rows["sequence"], strict=True) for x in pen.update(int(at), int(sequence))]
        self._keep(pen, max(seen, int(all_rows["at"].max())))
        yield self._frame(key, drawn)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pen, seen = self._load()
        if pen.waiting:
            yield self._frame(key, list(pen.until(expiredTimerInfo.getExpiryTimeInMs())))
        if seen + self.idle <= timerValues.getCurrentWatermarkInMs():
            self.pen.clear()
        else:
            self._keep(pen, seen)

    def close(self) -> None:
        pass


def drawn_stream(updates: DataFrame, late: str = AGE, idle_millis: int = 30_000) -> DataFrame:
    """(user_id, drawn_ms, sequence): drawings() of a stream of updates (user_id, ts, sequence), as the watermark passes them.

    State is a pen a user: the last drawing, the latest sequence and whether a drawing waits; a timer draws it when the watermark
    reaches its time, though no update comes. State is dropped `idle_millis` after a user's last update. Updates later than `late`
    are dropped by the watermark. Needs the RocksDB state store."""
    blocks.ship(updates.sparkSession)
    rows = updates.where("user_id is not null and ts is not null and sequence is not null").withWatermark("ts", late)
    rows = rows.select(F.col("user_id").cast("bigint").alias("user_id"), "ts", _millis(updates, "ts").alias("at"), F.col("sequence").cast("bigint").alias("sequence"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Drawer(idle_millis), "user_id bigint, drawn_ms bigint, sequence bigint", "append", "eventTime")


def refresh_on_arrival(spark: SparkSession, folder: str, checkpoint: str, refresh: Callable[[DataFrame, int], None]):
    """Runs refresh(records, batch id) over the record files (record_index, json lines) that came since the last run, then stops."""
    files = spark.readStream.schema("record_index bigint, json string").json(folder)
    return files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
