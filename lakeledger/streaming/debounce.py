"""Debounced file events: after a quiet gap, the last event of each path.

Any event below a root restarts the gap of that root. Batch form: events are first condensed to the last one per path and
gap-wide tick, which a partial aggregate does map-side. Bursts are found by a prefix scan over the ticks in slabs of time
(``operators/slabs``): a root with all of the events lies in many slabs, and no task goes through a whole root.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..constants import DEBOUNCE_SECONDS
from ..operators.slabs import highest_so_far, in_slabs, previous
from ..session import cut_lineage

_LAST = ["kind", "dest_path", "ts", "event_id"]


def _micros(seconds: float) -> int:
    return max(1, round(seconds * 1_000_000))


def _order() -> Column:
    """What makes an event the later one: time, then arrival id."""
    return F.struct("ts", "event_id")


def _tick(gap: int) -> Column:
    return F.floor(F.unix_micros("ts") / F.lit(gap)).cast("bigint")


def _with_event_id(events: DataFrame) -> DataFrame:
    """Events without an arrival id are ordered by kind where times are equal."""
    if "event_id" in events.columns:
        return events
    return events.withColumn("event_id", F.xxhash64("path", "kind", "dest_path"))


def last_per_tick(events: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """The last event per path and tick, with the first and last time in the tick."""
    path = [] if "path" in keys else ["path"]
    return (
        _with_event_id(events)
        .groupBy(*keys, *path, _tick(gap).alias("tick"))
        .agg(
            F.max_by(F.struct(*_LAST), _order()).alias("last"),
            F.min(F.unix_micros("ts")).alias("low"),
            F.max(F.unix_micros("ts")).alias("high"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def with_bursts(condensed: DataFrame, keys: list[str], gap: int, slabs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(condensed rows with ``session_start``, bounds): ticks belong together unless more than the gap lies between.

    ``bounds`` has a row (keys, session_start, session_end) per burst. It is a written table, so a burst with very many rows is
    split by AQE where rows meet their bounds.
    """
    dealt = in_slabs(condensed, keys, ["tick"], slabs)
    part = [*keys, "_slab"]
    ticks = dealt.groupBy(*part, "tick").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    before = previous(ticks, keys, ["tick"], F.col("high"), "_before")
    opens = F.when(F.col("_before").isNull() | (F.col("low") > F.col("_before") + gap), F.col("low"))
    started = cut_lineage(highest_so_far(before, keys, ["tick"], opens, "session_start").select(*part, "tick", "high", "session_start"))
    bounds = cut_lineage(started.groupBy(*keys, "session_start").agg(F.max("high").alias("session_end")))
    return dealt.join(started.drop("high"), [*part, "tick"]).drop("_slab"), bounds


def _emitted(condensed: DataFrame, keys: list[str], gap: int) -> DataFrame:
    return _folded(*with_bursts(condensed, keys, gap), keys, gap)


def _folded(rows: DataFrame, bounds: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """A row per path and burst, of what ``with_bursts`` gives."""
    path = [] if "path" in keys else ["path"]
    folded = rows.groupBy(*keys, *path, "session_start").agg(
        F.max_by("last", F.struct("last.ts", "last.event_id")).alias("last"), F.sum("n").alias("n_events"))
    return folded.join(bounds, [*keys, "session_start"]).select(
        *keys, *path, "last.kind", "last.dest_path", F.col("last.event_id").alias("event_id"),
        "n_events", "session_start", "session_end", (F.col("session_end") + gap).alias("fires_at"))


def debounce(events: DataFrame, gap_seconds: float = DEBOUNCE_SECONDS, group: str = "root") -> DataFrame:
    """One row per path and burst of its root: last kind and destination, number of events folded.

    Times are epoch microseconds; ``fires_at`` is when the quiet gap is over. ``group`` names the column
    whose events share one timer.
    """
    gap = _micros(gap_seconds)
    return _emitted(last_per_tick(events, [group], gap), [group], gap)


def debounce_by_path(events: DataFrame, gap_seconds: float = DEBOUNCE_SECONDS, group: str = "root") -> DataFrame:
    """The same with a timer per path."""
    gap = _micros(gap_seconds)
    keys = [group, "path"]
    return _emitted(last_per_tick(events, keys, gap), keys, gap)


BUCKETS = 4096      # groups of paths that share a call and a timer; more than there are state partitions


class BurstTimers(StatefulProcessor):
    """The timers of a bucket of paths, as ``transformWithState`` runs it.

    The state of a bucket is the list of the open bursts of its paths, nearly always one of a path: events that arrive out of order within the
    watermark may open an earlier one or join two. A burst goes out when the watermark passes its end and the gap. Every call to the state store
    takes far longer than an event, so paths share them: a bucket reads and writes its list once per micro-batch and has one timer, at the earliest end.
    """

    STATE = T.StructType([T.StructField(n, t) for n, t in (
        ("root", T.StringType()), ("path", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("n", T.LongType()),
        ("kind", T.StringType()), ("dest_path", T.StringType()), ("event_id", T.LongType()))])

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.STATE)

    def _deadline(self, burst: tuple) -> int:
        """Milliseconds, in which timers count, rounded up."""
        return -(-(burst[3] + self.gap) // 1000)

    def _bursts(self) -> list[tuple]:
        return [tuple(b) for b in self.open.get()] if self.open.exists() else []

    def _keep(self, bursts: list[tuple]) -> int | None:
        """Write what is open; the earliest deadline."""
        if not bursts:
            self.open.clear()
            return None
        self.open.put(bursts)
        return min(map(self._deadline, bursts))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        by_path: dict[tuple, list[tuple]] = {}
        before = self._bursts()
        for b in before:
            by_path.setdefault(b[:2], []).append(b[2:])
        events: dict[tuple, list[tuple]] = {}
        for row in rows:
            at = row["at"]
            events.setdefault((row["root"], row["path"]), []).append((at, at, 1, row["kind"], row["dest_path"], row["event_id"]))
        for path, new in events.items():
            by_path[path] = self._joined(by_path.get(path, []) + new)
        first = min(map(self._deadline, before), default=None)
        earliest = self._keep([(*path, *b) for path, bursts in by_path.items() for b in bursts])
        if earliest != first:
            if first is not None:
                self.handle.deleteTimer(first)
            self.handle.registerTimer(earliest)
        return iter([])

    def _joined(self, bursts: list[tuple]) -> list[tuple]:
        """The bursts of a path, those joined that lie within the gap of each other."""
        out: list[tuple] = []
        for own in sorted(bursts, key=lambda x: x[0]):
            b = out[-1] if out else None
            if b is None or own[0] > b[1] + self.gap:
                out.append(own)
            else:
                # the later one by time, then by id, tells kind and destination
                last = max(own, b, key=lambda x: (x[1], x[5]))
                out[-1] = (b[0], max(own[1], b[1]), own[2] + b[2], *last[3:])
        return out

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        # what the watermark has passed goes out at once: no event that could join it is still let in
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        bursts = self._bursts()
        earliest = self._keep([b for b in bursts if self._deadline(b) > now])
        if earliest is not None:
            self.handle.registerTimer(earliest)
        for burst in bursts:
            if self._deadline(burst) <= now:
                root, path, start, end, n, kind, dest, event_id = burst
                yield Row(root=root, path=path, kind=kind, dest_path=dest, event_id=event_id, n_events=n,
                          session_start=start, session_end=end, fires_at=end + self.gap)

    def close(self) -> None:
        pass


BURST = ("root string, path string, kind string, dest_path string, event_id bigint, n_events bigint, session_start bigint, "
         "session_end bigint, fires_at bigint")
END_OF_INPUT = "end of input"      # kind of the event that ends a feed: it only moves the clock


def end_of_input(spark: SparkSession) -> DataFrame:
    """One event in the far future without a path. At the end of a feed it moves the watermark over all open bursts, which then go out."""
    return spark.sql(f"""SELECT CAST(NULL AS STRING) AS root, CAST(NULL AS STRING) AS path, '{END_OF_INPUT}' AS kind,
        CAST(NULL AS STRING) AS dest_path, CAST(NULL AS BIGINT) AS event_id, TIMESTAMP '9000-01-01 00:00:00' AS ts""")


def debounce_by_path_stream(events: DataFrame, gap_seconds: float = DEBOUNCE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Streaming debounce with a timer per path, rows like ``debounce_by_path``.

    State is keyed by a bucket of (root, path) and holds its paths' open bursts. Events later than the watermark are dropped and counted (``late_rows``); at
    the end of a feed ``end_of_input`` closes what is open. Needs a state store with timers (``with_timers``).
    """
    timed = _with_event_id(events).withWatermark("ts", delay)
    rows = timed.select("root", "path", "kind", "dest_path", "event_id", "ts", F.unix_micros("ts").alias("at"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("root", "path"), F.lit(BUCKETS)))
    bursts = rows.groupBy("bucket").transformWithState(
        BurstTimers(_micros(gap_seconds)), outputStructType=BURST, outputMode="append", timeMode="eventTime")
    # the marker is a burst of no path
    return bursts.filter(F.col("kind") != END_OF_INPUT)


@contextmanager
def with_timers(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which ``transformWithState`` asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def late_rows(query: StreamingQuery) -> int:
    """How many rows of a query came later than the watermark and were dropped, by its recent progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for report in query.recentProgress for op in report["stateOperators"])


class DebounceSink:
    """Streaming debounce per root, as a ``foreachBatch`` function.

    The pending state is a table of condensed events (last event per path and tick), one folder per
    micro-batch, in ``state_dir``; closed bursts go to ``out_dir``, one folder per micro-batch. Both are
    overwritten when a batch is repeated, so a restart neither loses nor doubles anything. Because the
    state is a table and the sessions come from the batch operator, a root with most of the events does
    not run in one task, as it would with state keyed by root.

    Events later than the watermark go to the table ``late`` in ``state_dir``, one folder per micro-batch. At the end of the
    input ``flush`` gives out the bursts that are still open.
    """

    STATE = (
        "root STRING, path STRING, tick BIGINT, "
        "last STRUCT<kind: STRING, dest_path: STRING, ts: TIMESTAMP, event_id: BIGINT>, "
        "low BIGINT, high BIGINT, n BIGINT"
    )

    def __init__(self, out_dir: str, state_dir: str, gap_seconds: float = DEBOUNCE_SECONDS, delay_seconds: float = 0):
        self.out_dir, self.state_dir = out_dir.rstrip("/"), state_dir.rstrip("/")
        self.gap, self.delay = _micros(gap_seconds), round(delay_seconds * 1_000_000)
        self.last_batch: int | None = None

    def _previous(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame | None, int | None]:
        """Pending events and newest time after the micro-batch before (ids follow one another)."""
        if batch_id == 0:
            return None, None
        reader = batch.sparkSession.read
        newest = reader.schema("newest BIGINT").parquet(f"{self.state_dir}/clock/{batch_id - 1}").first()["newest"]
        return reader.schema(self.STATE).parquet(f"{self.state_dir}/pending/{batch_id - 1}"), newest

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pending, newest_before = self._previous(batch, batch_id)
        # later than the watermark: the burst such an event belongs to may be out already
        fresh = batch if newest_before is None else batch.filter(F.unix_micros("ts") >= newest_before - self.delay)
        late = batch.limit(0) if newest_before is None else batch.filter(F.unix_micros("ts") < newest_before - self.delay)
        late.write.mode("overwrite").parquet(f"{self.state_dir}/late/{batch_id}")
        condensed = last_per_tick(fresh, ["root"], self.gap)
        if pending is not None:
            both = condensed.unionByName(pending)
            condensed = both.groupBy("root", "path", "tick").agg(
                F.max_by("last", F.struct("last.ts", "last.event_id")).alias("last"),
                F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"),
            )
        rows, bounds = with_bursts(condensed, ["root"], self.gap)
        newest = bounds.agg(F.max("session_end").alias("newest")).first()["newest"]
        newest = max(t for t in (newest, newest_before, -(2**62)) if t is not None)
        watermark = newest - self.delay
        closed = F.col("session_end") + self.gap < watermark
        open_bursts = bounds.filter(~closed).select("root", "session_start")
        still_open = rows.join(open_bursts, ["root", "session_start"]).select(*condensed.columns)
        still_open.write.mode("overwrite").parquet(f"{self.state_dir}/pending/{batch_id}")
        # a closed burst is whole here: it goes out with the bounds found, and is not looked for again
        done = _folded(rows, bounds.filter(closed), ["root"], self.gap)
        done.write.mode("overwrite").parquet(f"{self.out_dir}/batch={batch_id}")
        clock = spark.range(1).select(F.lit(newest).cast("bigint").alias("newest"))
        clock.write.mode("overwrite").parquet(f"{self.state_dir}/clock/{batch_id}")
        self.last_batch = batch_id

    def late_events(self, spark: SparkSession) -> DataFrame:
        """The events that came too late for their bursts."""
        return spark.read.parquet(f"{self.state_dir}/late/*")

    def flush(self, spark: SparkSession, last_batch_id: int | None = None) -> None:
        """Give out the bursts still open after the last micro-batch, in the folder of the next one.

        If the stream goes on after all, that micro-batch overwrites the folder, and nothing is doubled. A sink that has seen a batch knows the last one.
        """
        last = self.last_batch if last_batch_id is None else last_batch_id
        if last is None:
            pending = spark.createDataFrame([], self.STATE)
        else:
            pending = spark.read.schema(self.STATE).parquet(f"{self.state_dir}/pending/{last}")
        done = _emitted(pending, ["root"], self.gap)
        done.write.mode("overwrite").parquet(f"{self.out_dir}/batch={0 if last is None else last + 1}")
