"""Structured Streaming: tumbling counts, exact de-duplication, keyed state, and idempotent batch sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.readers import work_path

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream_table(spark: SparkSession, root: str, name: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """A table of a data directory as a stream of its files, so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet").parquet(root)


def as_files(df: DataFrame, order: str, files: int = 4) -> str:
    """Write a table as files that follow each other by ``order``, as a source would deliver them; gives their folder."""
    base = work_path(df.sparkSession, f"arrivals-{uuid.uuid4().hex}")
    cuts = [None, *df.select(F.col(order).cast("timestamp").cast("double").alias("t")).approxQuantile("t", [i / files for i in range(1, files)], 0.01), None]
    t = F.col(order).cast("timestamp").cast("double")
    for low, high in zip(cuts, cuts[1:]):
        part = df.filter((F.lit(True) if low is None else t > low) & (F.lit(True) if high is None else t <= high))
        part.coalesce(1).write.mode("append").parquet(base)
    return base


def stream_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of files as a stream, one file a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now; every micro-batch is written with its id, so a repeated batch replaces itself."""
    spark = stream.sparkSession
    base = work_path(spark, f"stream-{uuid.uuid4().hex}")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/rows").drop("batch")


def tumbling_counts(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; in update mode each batch gives the windows that it changed."""
    w = F.window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def newest_per_window(rows: DataFrame) -> DataFrame:
    """The last update of each window."""
    return rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch_id").alias("x")).select("window_start", "event_type", "x.*")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Exact de-duplication by key within the watermark, where a lossy filter would forget."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def failure_runs(events: DataFrame) -> DataFrame:
    """(user_id, failures, events): keyed state over micro-batches: failures since the last success."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, seen = state.get if state.exists else (0, 0)
        success, open_ = None, []  # the latest success of the batch, and the failures after it: no more of a hot key is held
        for b in batches:
            seen += len(b)
            at = list(zip(b["ts"], b["event_id"]))
            success = max([x for x, kind in zip(at, b["event_type"]) if kind == "purchase"] + ([success] if success else []), default=None)
            open_ = [x for x in open_ + [x for x, kind in zip(at, b["event_type"]) if kind == "error"] if success is None or x > success]
        failures = len(open_) + (failures if success is None else 0)
        state.update((failures, seen))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [failures], "events": [seen]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(step, "user_id long, failures long, events long", "failures long, seen long", "update", GroupStateTimeout.NoTimeout)
