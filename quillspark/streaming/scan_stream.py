"""Checks of page scans while their pages land, with Structured Streaming state.

``pages`` is a stream with one row per landed page: scan, started, landed (timestamps), offset, total, n_papers.
``entries`` has one row per paper of a page: scan, started, landed, id. Nothing that has been seen is read again: a scan's
coverage lies in the state of its key, ids in the state of a streaming aggregate, and both go when the scan expires.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark import fixed_values as fixed
from quillspark.session import ship_package

HOURS = f"{fixed.CHECKPOINT_MAX_AGE_HOURS} hours"
#: How late a page may be known, against the latest one.
DELAY = "10 minutes"

PAGES = T.StructType([
    T.StructField("scan", T.StringType()), T.StructField("started", T.TimestampType()),
    T.StructField("landed", T.TimestampType()), T.StructField("offset", T.LongType()),
    T.StructField("total", T.LongType()), T.StructField("n_papers", T.LongType())])
ENTRIES = T.StructType([
    T.StructField("scan", T.StringType()), T.StructField("started", T.TimestampType()),
    T.StructField("landed", T.TimestampType()), T.StructField("id", T.StringType())])
VERDICT = T.StructType([
    T.StructField("scan", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("covered", T.LongType()), T.StructField("total", T.LongType()), T.StructField("first_gap", T.LongType())])
SPAN = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
TOTALS = T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order, without touching ones."""
    result: list[tuple[int, int]] = []
    for begin, end in sorted(s for s in spans if s[0] < s[1]):
        if result and begin <= result[-1][1]:
            result[-1] = (result[-1][0], max(end, result[-1][1]))
        else:
            result.append((begin, end))
    return result


class ScanState(StatefulProcessor):
    """What a scan has covered and the totals its pages reported; one verdict when it is whole or its time is up.

    - ``complete``: every paper from 0 to the highest total is covered, and all pages reported that total.
    - ``drift``: the pages reported different totals; said when the highest is covered, or when the time is up.
    - ``expired``: the time is up and papers are missing, from ``first_gap`` on.

    The state is a few spans, since pages that touch become one. A page that lands twice counts once, and the order of
    pages does not matter.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", SPAN)
        self.totals = handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.totals.get()
        if known is None:
            low, high, spans = None, 0, []
        else:
            low, high, spans = known[0], known[1], [tuple(s) for s in self.spans.get()]
        deadline = None
        for row in rows:
            low = row.total if low is None else min(low, row.total)
            high = max(high, row.total)
            spans.append((row.offset, row.offset + row.n_papers))
            deadline = row.deadline
        spans = united(spans)
        if spans == united([(0, high)]):
            self._forget()
            yield self._verdict(key, "complete" if low == high else "drift", spans, high)
            return
        self.totals.update((low, high))
        self.spans.put(spans) if spans else self.spans.clear()
        if known is None:
            self.handle.registerTimer(deadline)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        low, high = self.totals.get()
        spans = [tuple(s) for s in self.spans.get()]
        self._forget()
        yield self._verdict(key, "expired" if low == high else "drift", spans, high)

    def _forget(self) -> None:
        self.totals.clear()
        self.spans.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    @staticmethod
    def _verdict(key, status: str, spans: list[tuple[int, int]], high: int) -> Row:
        covered = sum(end - begin for begin, end in spans)
        reached = spans[0][1] if spans and spans[0][0] == 0 else 0
        return Row(scan=key[0], status=status, covered=covered, total=high, first_gap=reached if reached < high else None)

    def close(self) -> None:
        pass


def verdicts(pages: DataFrame) -> DataFrame:
    """The verdict of every scan that is whole or out of time. A page that landed after its scan's time belongs to none."""
    deadline = F.col("started") + F.expr(f"INTERVAL {HOURS}")
    timed = pages.withWatermark("landed", DELAY).where(F.col("landed") <= deadline).withColumn(
        "deadline", F.unix_millis(deadline))
    return timed.groupBy("scan").transformWithState(ScanState(), VERDICT, "Append", "EventTime")


def repeated_ids(entries: DataFrame) -> DataFrame:
    """(scan, id, copies) of ids that a scan has delivered more than once so far; in update mode, a row for each change.

    The counts stay in the JVM. They go once a scan began that is younger by more than the time a scan may take.
    """
    deadline = F.col("started") + F.expr(f"INTERVAL {HOURS}")
    timed = entries.withColumn("deadline", deadline).where("landed <= deadline").withWatermark("deadline", HOURS)
    return timed.groupBy("scan", "deadline", "id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(
        "scan", "id", "copies")


class ScanChecks:
    """The checks of all scans whose pages land under ``root``/pages and ``root``/entries.

    drain() takes what has landed since the last call, also after a restart of the program: offsets, state and
    watermark lie in the checkpoints. A batch that is run again overwrites its own folder.
    """

    def __init__(self, spark: SparkSession, root: str):
        # A session of its own: timers need the RocksDB store, and other streams keep their setting.
        self.spark, self.root = spark.newSession(), root
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        self.spark.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        self.reader = spark

    def land(self, pages: DataFrame, entries: DataFrame) -> None:
        entries.select(*ENTRIES.names).write.mode("append").parquet(f"{self.root}/entries")
        pages.select(*PAGES.names).write.mode("append").parquet(f"{self.root}/pages")

    def drain(self) -> None:
        ship_package(self.reader)
        stream = self.spark.readStream
        self._run(verdicts(stream.schema(PAGES).parquet(f"{self.root}/pages")), "verdicts", "append")
        self._run(repeated_ids(stream.schema(ENTRIES).parquet(f"{self.root}/entries")), "repeated", "update")

    def _run(self, rows: DataFrame, name: str, mode: str) -> None:
        target = f"{self.root}/{name}"

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

        (rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{self.root}/state_{name}")
         .trigger(availableNow=True).start().awaitTermination())

    def verdicts(self) -> DataFrame:
        return self.reader.read.schema(VERDICT).parquet(f"{self.root}/verdicts").select(*VERDICT.names)

    def repeated(self) -> DataFrame:
        """Ids that a scan delivered more than once, with the last count."""
        schema = "scan string, id string, copies bigint"
        changes = self.reader.read.schema(schema).parquet(f"{self.root}/repeated")
        return changes.groupBy("scan", "id").agg(F.max("copies").alias("copies"))
