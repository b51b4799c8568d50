"""Keeping a store current from a stream of file events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomnote.config import EngineConfig
from loomnote.operators.changes import Tables, apply_batch, build
from loomnote.sources.files import as_notes, outside_nested
from loomnote.sources.ignore import compile_rules, ignores
from loomnote.sources.store import Store

#: What a stream of events has: type is create, change or delete; seq orders the events of a path; mtime_ms is when the file was changed.
EVENT_SCHEMA = "notebook_id string, relative_path string, type string, content string, seq bigint, mtime_ms double"


def not_ignored(batch: DataFrame, ignore_text: str, notebook_id: str | None = None) -> DataFrame:
    """Without upserts of files that the rules (of one notebook, or of all) ignore; deletions always pass."""
    rules = compile_rules(ignore_text)
    if not rules:
        return batch
    hidden = ignores(F.col("relative_path"), rules) & (F.col("type") != "delete")
    return batch.where(~hidden if notebook_id is None else ~(hidden & (F.col("notebook_id") == notebook_id)))


def usable_events(batch: DataFrame, roots: DataFrame | None = None, ignore_text: str = "") -> DataFrame:
    """Without upserts of ignored files (deletions always pass), and without events of nested notebooks' files."""
    kept = not_ignored(batch, ignore_text)
    return kept if roots is None else outside_nested(kept, roots)


def batch_handler(store: Store, config: EngineConfig = EngineConfig(), roots: DataFrame | None = None, ignore_text: str = "", extractor=None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: load, apply the batch as one transition, publish. A batch that is seen again changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        usable = usable_events(batch, roots, ignore_text)
        state = store.load()
        if state is None:
            empty = as_notes(spark.createDataFrame([], "notebook_id string, relative_path string, content string"))
            state = build(empty, config, extractor)
        batch.persist()
        try:
            store.save(apply_batch(state, usable, config, extractor))
        finally:
            batch.unpersist()

    return handle


def follow(spark: SparkSession, events_dir: str, store: Store, checkpoint: str, debounce_ms: int = 300, once: bool = False, **options) -> StreamingQuery:
    """Follow a folder of event files. The trigger interval stands for the debounce: the last event of a path in it counts."""
    if not 50 <= debounce_ms <= 5000:
        raise ValueError("debounce_ms must be between 50 and 5000")
    stream = spark.readStream.schema(EVENT_SCHEMA).json(events_dir)
    writer = stream.writeStream.foreachBatch(batch_handler(store, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{debounce_ms} milliseconds")).start()


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per notebook, type and time window, for a stream with an event time ``ts``; late ones are taken up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "notebook_id", "type").agg(F.count("*").alias("n"))


def progress(tables: Tables) -> DataFrame:
    """Notes per notebook, as the listing after a batch shows them."""
    return tables.note.groupBy("notebook_id").agg(F.count("*").alias("file_count"))
