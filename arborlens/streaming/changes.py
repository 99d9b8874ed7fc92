"""Change streams: debounce, suppression, counters, liveness; the same function serves batch and stream where Spark allows (family R)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, watermark: str | None) -> DataFrame:
    """Late rows are dropped after the watermark, which wants a time with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if watermark else events


def debounced(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Batches of changes: a session per repository that ends after `gap` of silence; the set of paths, and their number of events."""
    e = _watermarked(events, watermark)
    g = e.groupBy("repository_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.size(F.collect_set("path")).cast("long").alias("paths"))
    return g.select("repository_id", F.col("w.start").alias("started"), "events", "paths")


def interval_counts(events: DataFrame, interval: str, watermark: str | None = None) -> DataFrame:
    e = _watermarked(events, watermark)
    return e.groupBy(F.window("ts", interval).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "n")


def running_totals(counts: DataFrame) -> DataFrame:
    """Cumulative counts over intervals: sums within ranges of the order, and before them the sums of the earlier ranges, so no task sees all intervals."""
    from arborlens.operators.graph import checkpointed

    rows = counts.repartitionByRange("started").withColumn("_part", F.spark_partition_id())
    rows = checkpointed(rows.withColumn("_own", F.sum("n").over(Window.partitionBy("_part").orderBy("started").rowsBetween(Window.unboundedPreceding, 0))))
    parts = rows.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn("total", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def changed_only(events: DataFrame) -> DataFrame:
    """Events whose change type differs from the one before on the same repository and path."""
    w = Window.partitionBy("repository_id", "path").orderBy("ts", "event_id")
    return events.withColumn("b", F.lag("change_type").over(w)).where("b is null or b <> change_type").drop("b")


def changed_stream(events: DataFrame) -> DataFrame:
    """changed_only for a stream: the state of each (repository_id, path) is the last change type that came, in order of event_id within a micro-batch."""
    def step(key, frames, state):
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            if row.change_type != last:
                out.append((row.event_id, key[0], key[1], row.change_type))
            last = row.change_type
        state.update((last,))
        yield pd.DataFrame(out, columns=["event_id", "repository_id", "path", "change_type"])

    return events.select("ts", "event_id", "repository_id", "path", "change_type").groupBy("repository_id", "path").applyInPandasWithState(step, "event_id long, repository_id long, path string, change_type string", "last string", "append", "NoTimeout")


def reset_counters(counts: DataFrame, start) -> DataFrame:
    """Counts per interval from a given start on: earlier intervals no longer count."""
    return running_totals(counts.where(F.col("started") >= start))


def fan_out(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Every event to each subscriber(subscriber, since) from its own start on, numbered in order: slow readers lose nothing."""
    w = Window.partitionBy("subscriber").orderBy("event_id")
    return events.join(subscribers, F.col("event_id") >= F.col("since")).select("subscriber", "event_id", F.row_number().over(w).cast("long").alias("place"))


def pipeline(batch: DataFrame, known: DataFrame) -> DataFrame:
    """What one trigger does with its changes: the last state of each path, without those whose content is known. path, change_type, hash."""
    last = batch.groupBy("path").agg(F.max_by(F.struct("change_type", "hash"), F.struct("ts", "event_id")).alias("r")).select("path", "r.change_type", "r.hash")
    return last.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def stale_beats(events: DataFrame, seconds: int) -> DataFrame:
    """Per repository, gaps between heartbeats longer than `seconds`."""
    w = Window.partitionBy("repository_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return events.withColumn("gap", gap).where(F.col("gap") > seconds * 1_000_000).groupBy("repository_id").agg(F.count("*").alias("stale"), F.max("gap").alias("longest_us"))


def run_once(stream: DataFrame, transform, path: str, checkpoint: str) -> None:
    """Drain a stream through `transform` into Parquet, one micro-batch after the other, exactly once by batch id."""
    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def source(spark, root: str, patterns: list[str] = ()) -> DataFrame:
    """New and rewritten files below a folder as a stream: path, ts, size. Ignored folders and files without a language are left out; new folders are seen as they appear."""
    from arborlens.functions.enrichers import language_of
    from arborlens.operators.resolve import ignored
    from arborlens.sources.workspace import BUILD_FOLDERS

    base = re.sub(r"^[a-z0-9]+:/+", "/", root).rstrip("/")
    f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("ts"), F.col("length").alias("size"))
    f = f.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{re.escape(base)}/", ""))
    return ignored(f, BUILD_FOLDERS, list(patterns)).where("not ignored").drop("ignored").where(language_of(F.col("path"))["language"].isNotNull())
