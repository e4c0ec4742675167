"""Incremental merge of landed records with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillspark.operators.merge import merge
from quillspark.schema import SEEN_FIELDS
from quillspark.session import scratch_folder
from quillspark.sinks.catalog import CatalogStore
from quillspark.sources.feed import parse_feed
from quillspark.sources.library import raw_page_stream


def latest_revisions(records: DataFrame) -> DataFrame:
    """One row per id, the highest (version, updated), and of equal ones the highest hash of all columns, so that a batch
    gives the same whatever order its rows come in; combined on the map side, so hot ids are cheap."""
    columns = [c for c in records.columns if c != "id"]
    best = records.groupBy("id").agg(
        F.max_by(F.struct(*columns), F.struct("version", "updated", F.xxhash64(*columns))).alias("r"))
    return best.select("id", "r.*")


class StreamMerger:
    """A foreachBatch sink that merges each micro-batch into the stored catalog.

    A commit names the streaming query and its batch. A batch that is replayed after a failure is skipped if
    the catalog holds it and merged again from the same input if not, so every batch counts once, whatever
    else has written to the catalog. A new checkpoint is a new query, whose batches are all merged. A record
    older than the stored revision is ignored, whatever batch it arrives in.
    """

    def __init__(self, store: CatalogStore, checkpoint: str):
        self.store, self.checkpoint, self._stream = store, checkpoint, None

    def stream(self) -> str:
        """The id that the checkpoint gives its query."""
        if self._stream is None:
            self._stream = self.store.spark.read.json(f"{self.checkpoint}/metadata").first()["id"]
        return self._stream

    def __call__(self, records: DataFrame, batch: int) -> None:
        stream = self.stream()
        if self.store.last_batch(stream) >= batch:
            return
        stamp = f"batch {batch:08d}"
        latest = latest_revisions(records)
        # A micro-batch is a part of a scan only: rows it does not mention stay as they are, those found gone as well.
        self.store.change(lambda papers: merge(papers, latest, stamp, partial=True).drop("state"),
                          last_sync=stamp, stream=stream, batch=batch)


class PageMerger:
    """A foreachBatch sink for raw Atom pages: good batches are merged, a bad page stops the stream.

    The pages that break a rule are written to the error table first, with the reason. None of the batch is
    merged then, so nothing is lost: the batch runs again once the page is mended or taken away.
    """

    def __init__(self, merger: StreamMerger, errors: str):
        self.merger, self.errors = merger, errors

    def __call__(self, pages: DataFrame, batch: int) -> None:
        checked, entries = parse_feed(pages)
        bad = checked.where("error IS NOT NULL").select("offset", "error")
        bad.write.mode("overwrite").json(f"{self.errors}/batch={batch}")
        first = self.merger.store.spark.read.schema(bad.schema).json(f"{self.errors}/batch={batch}").first()
        if first:
            raise ValueError(f"Page {first.offset} of batch {batch} is not usable: {first.error}")
        self.merger(entries.drop("offset", "position"), batch)


def _drain(stream: DataFrame, sink, checkpoint: str) -> None:
    query = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def run_merge(records: DataFrame, root: str, before: DataFrame | None = None) -> DataFrame:
    """Drain a streaming DataFrame of records into the catalog under ``root``; returns its state. ``before`` is the
    catalog that the stream finds, if there is none yet."""
    seen = T.StructType(records.schema.fields + SEEN_FIELDS)
    store = CatalogStore(records.sparkSession, f"{root}/catalog", seen)
    if before is not None and store.latest() is None:
        store.change(lambda _: before.select(*seen.names))
    _drain(records, StreamMerger(store, f"{root}/checkpoint"), f"{root}/checkpoint")
    return store.papers()


def run_page_merge(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """Drain the Atom pages that landed in ``folder`` into the catalog under ``root``; returns its state."""
    store = CatalogStore(spark, f"{root}/catalog")
    merger = PageMerger(StreamMerger(store, f"{root}/checkpoint"), f"{root}/bad_pages")
    _drain(raw_page_stream(spark, folder), merger, f"{root}/checkpoint")
    return store.papers()


def merge_events(spark: SparkSession, events: DataFrame, batches: int = 4) -> DataFrame:
    """The last event of every user, merged by a stream of about ``batches`` batches into a catalog that holds rows which
    no event mentions: some current, some that a scan found gone.

    The events land in files by a hash of their id, several files a batch, so a user's events are spread over the
    batches and most batches hold events that are older than what is stored.
    """
    root = scratch_folder(spark, "stream")
    files = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    events.repartition(files, F.xxhash64("event_id")).write.parquet(f"{root}/landed")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(f"{root}/landed")
    records = stream.select(
        F.col("user_id").cast("string").alias("id"), F.lit(1).alias("version"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("#"),
                 F.lpad(F.col("event_id").cast("string"), 20, "0")).alias("updated"),
        "event_type", "value")
    stored = events.select("user_id").distinct().filter("user_id % 5 = 0").select(
        F.concat(F.lit("stored-"), F.col("user_id").cast("string")).alias("id"), F.lit(1).alias("version"),
        F.lit("").alias("updated"), F.lit("none").alias("event_type"), F.lit(None).cast(events.schema["value"].dataType).alias("value"),
        F.lit("s0").alias("first_seen"), F.lit("s0").alias("last_seen"), (F.col("user_id") % 2 == 0).alias("in_latest_search"))
    return run_merge(records, root, stored).select("id", "version", "updated", "event_type", "value", "in_latest_search")
