"""The log of versions: what changed since the latest one, stored diffs, and tombstones of what is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions.naming import fact_summary_identity


def changed_raw(latest: DataFrame, now: DataFrame) -> DataFrame:
    """latest, now(type, key, hash) -> type, key, state: what is new or has another hash, and files that are gone (other things go with their file)."""
    j = latest.select("type", "key", F.col("hash").alias("before")).join(now.select("type", "key", F.col("hash").alias("after")), ["type", "key"], "full_outer")
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), F.when(F.col("type") == "file", "deleted")).when(F.col("before") != F.col("after"), "updated")
    return j.select("type", "key", state.alias("state")).where("state IS NOT NULL")


def promoted_summaries(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after(key, hash) of fact summaries -> key, before_key, before_hash, after_hash, change_type: a new summary whose file and fact type had another one is that one, updated.

    The smallest key of several is it, and its own deletion is no change. If its hash is the same, the new one counts as added.
    """
    described = lambda df, p: df.select(F.col("key").alias(f"{p}key"), F.col("hash").alias(f"{p}hash"), fact_summary_identity(F.col("key")).alias("who"))
    b, a = described(before, "b_"), described(after, "a_")
    same = b.join(a.select(F.col("a_key").alias("b_key"), "a_hash"), "b_key").where("b_hash <> a_hash").select(F.col("b_key").alias("key"), F.col("b_key").alias("before_key"), F.col("b_hash").alias("before_hash"), F.col("a_hash").alias("after_hash"), F.lit("updated").alias("change_type"))
    new = a.join(b.select(F.col("b_key").alias("a_key")), "a_key", "left_anti")
    old = b.where("who IS NOT NULL").groupBy("who").agg(F.min("b_key").alias("b_key"), F.min_by("b_hash", "b_key").alias("b_hash"))
    j = new.join(old, "who", "left")
    moved = F.col("b_key").isNotNull() & (F.col("b_hash") != F.col("a_hash"))
    fresh = j.select(F.col("a_key").alias("key"), F.when(moved, F.col("b_key")).alias("before_key"), F.when(moved, F.col("b_hash")).alias("before_hash"), F.col("a_hash").alias("after_hash"), F.when(moved, "updated").otherwise("added").alias("change_type"))
    gone = b.join(a.select(F.col("a_key").alias("b_key")), "b_key", "left_anti").join(fresh.where("before_key IS NOT NULL").select(F.col("before_key").alias("b_key")), "b_key", "left_anti")
    none = F.lit(None).cast("string")
    return same.unionByName(fresh).unionByName(gone.select(F.col("b_key").alias("key"), F.col("b_key").alias("before_key"), F.col("b_hash").alias("before_hash"), none.alias("after_hash"), F.lit("deleted").alias("change_type")))


def versions_of(runs: DataFrame) -> DataFrame:
    """runs(repository_id, place, head, hash, clean) -> the runs that make a version (head or hash differs from the run before), numbered from 1 in a repository."""
    w = Window.partitionBy("repository_id").orderBy("place")
    moved = ~F.col("head").eqNullSafe(F.lag("head").over(w)) | ~F.col("hash").eqNullSafe(F.lag("hash").over(w)) | F.lag("place").over(w).isNull()
    return runs.withColumn("_moved", moved).where("_moved").drop("_moved").withColumn("version", F.row_number().over(w).cast("long"))


def stored_diffs(versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """versions(repository_id, place, version), snapshots(repository_id, place, key, hash) -> repository_id, version, key, before_hash, after_hash, change_type.

    A version is held against the one before it; the first one initialises everything. One join of all versions' rows with the same rows moved on by one.
    """
    rows = snapshots.join(versions.select("repository_id", "place", "version"), ["repository_id", "place"]).select("repository_id", "version", "key", "hash")
    last = versions.groupBy("repository_id").agg(F.max("version").alias("last"))
    moved = rows.join(last, "repository_id").where("version < last").select("repository_id", (F.col("version") + 1).alias("version"), "key", F.col("hash").alias("before_hash"))
    j = moved.join(rows.withColumnRenamed("hash", "after_hash"), ["repository_id", "version", "key"], "full_outer")
    kind = F.when(F.col("version") == 1, "initialized").when(F.col("before_hash").isNull(), "added").when(F.col("after_hash").isNull(), "deleted").when(F.col("before_hash") != F.col("after_hash"), "updated")
    return j.select("repository_id", "version", "key", "before_hash", "after_hash", kind.alias("change_type")).where("change_type IS NOT NULL")


def tombstones(versions: DataFrame, diffs: DataFrame) -> DataFrame:
    """What a version deleted stays visible until a version of a clean tree, or until it is back: repository_id, key, since, until (exclusive; null: still there)."""
    gone = diffs.where("change_type = 'deleted'").select("repository_id", F.col("version").alias("since"), "key")
    back = diffs.where("change_type = 'added'").select("repository_id", "key", F.col("version").alias("back"))
    # The first clean version from each version on.
    w = Window.partitionBy("repository_id").orderBy(F.col("version").desc()).rowsBetween(Window.unboundedPreceding, 0)
    clean = versions.select("repository_id", F.col("version").alias("since"), F.min(F.when(F.col("clean"), F.col("version"))).over(w).alias("cleaned"))
    j = gone.join(clean, ["repository_id", "since"]).join(back, ["repository_id", "key"], "left").where("back IS NULL OR back > since")
    other = gone.join(back, ["repository_id", "key"]).where("back < since").groupBy("repository_id", "key", "since").agg(F.count("*").alias("n"))
    rows = j.groupBy("repository_id", "key", "since").agg(F.min("cleaned").alias("cleaned"), F.min("back").alias("back"))
    # A key that came back only before it went again has no row in j.
    lost = other.join(rows.select("repository_id", "key", "since"), ["repository_id", "key", "since"], "left_anti").join(clean, ["repository_id", "since"]).select("repository_id", "key", "since", "cleaned", F.lit(None).cast("long").alias("back"))
    every = rows.unionByName(lost)
    return every.select("repository_id", "key", "since", F.least("cleaned", "back").alias("until")).where("until IS NULL OR until > since")
