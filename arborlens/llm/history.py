"""Versioned dimension history: DuckDB joins each shard of keys, Spark deals the shards.

A change says what a key's value is from a day on (`update`), that the key is
gone from a day on (`delete`), or what its value is within a span of days
(`correction`). On each day the last-arrived correction that covers it holds;
else the update or delete with the latest start not after it, ties to the
last-arrived. A day with a delete or with nothing is an absent one. Runs of
consecutive present days with equal value are a key's versions.

Spark first leaves, of the changes of one key that compete for one place (one start of updates
and deletes; one start and length of corrections), the last-arrived (a
partial aggregate before the shuffle), so a key keeps at most a row for each
start and span, whatever the number of its changes. Whole keys are then dealt over shards of
about SHARD_CHANGES changes by hash, and each shard goes through DuckDB as one
Arrow group: days at which something begins or ends are boundaries, an ASOF
join finds each boundary's base, an interval join with arg_max its correction,
and windows merge equal neighbours (islands). No result of Spark is needed but the
number of changes.

Defined results: changes without key, start, kind or arrival order concern nothing and are left out, as are corrections of no
length; a null value is a value, equal to null. Wholly repeated changes
are one; of two that differ but arrive alike, the one of the greater kind, then of the greater value counts (null is the smallest).
An empty table has no versions. Extra columns of the changes, whatever their names, are not read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import prepare

#: Changes in a shard, on average: bounds a task's memory.
SHARD_CHANGES = 40_000
#: Changes made from a document start within so many days.
DAYS = 60
CORRECTION_DAYS = 10
UPDATE, DELETE, CORRECTION = 0, 1, 2

VERSIONS = "key long, version int, valid_from long, valid_to long, value string"

#: One shard's changes(key, kind, valid_from, valid_to, arrival, value) to its versions.
SHARD_SQL = f"""
WITH base AS (
  SELECT key, valid_from, kind, value FROM changes WHERE kind <> {CORRECTION}),
corrections AS (
  SELECT key, valid_from, valid_to, arrival, value FROM changes WHERE kind = {CORRECTION}),
bounds AS (
  SELECT DISTINCT key, day FROM (
    SELECT key, valid_from AS day FROM changes UNION ALL
    SELECT key, valid_to FROM corrections)),
spans AS (
  SELECT key, day, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM bounds),
based AS (
  SELECT s.key, s.day, s.until, b.kind, b.value
  FROM spans s ASOF LEFT JOIN base b ON s.key = b.key AND s.day >= b.valid_from),
corrected AS (
  SELECT s.key, s.day, arg_max(struct_pack(value := c.value), c.arrival) AS held
  FROM spans s JOIN corrections c ON s.key = c.key AND s.day >= c.valid_from AND s.day < c.valid_to
  GROUP BY s.key, s.day),
present AS (
  SELECT b.key, b.day, b.until, CASE WHEN c.held IS NOT NULL THEN c.held.value ELSE b.value END AS value
  FROM based b LEFT JOIN corrected c ON b.key = c.key AND b.day = c.day
  WHERE c.held IS NOT NULL OR b.kind = {UPDATE}),
starts AS (
  SELECT *, CASE WHEN lag(until) OVER w = day AND lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS first
  FROM present WINDOW w AS (PARTITION BY key ORDER BY day)),
islands AS (
  SELECT *, sum(first) OVER (PARTITION BY key ORDER BY day) AS island FROM starts)
SELECT key, CAST(island AS INTEGER) AS version, min(day) AS valid_from,
       CASE WHEN bool_or(until IS NULL) THEN NULL ELSE max(until) END AS valid_to, any_value(value) AS value
FROM islands GROUP BY key, island ORDER BY key, island
"""


def _versions(changes: pa.Table) -> pa.Table:
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as con:
        con.register("changes", changes)
        out = con.sql(SHARD_SQL).to_arrow_table()
    # any_value passes over nulls; a version's rows have one value, so that a null stays null.
    return out.cast(pa.schema([("key", pa.int64()), ("version", pa.int32()), ("valid_from", pa.int64()), ("valid_to", pa.int64()), ("value", pa.string())]))


def last_arrived(changes: DataFrame) -> DataFrame:
    """Of the changes that compete for one place of a key, the last-arrived: (key, kind, valid_from, valid_to, arrival, value).

    Of updates and deletes of one start one is left; of corrections one for each start and end.
    """
    order = F.struct("arrival", "kind", F.struct("value").alias("value"))
    corrects = F.col("kind") == CORRECTION
    kept = changes.where(F.col("key").isNotNull() & F.col("kind").isNotNull() & F.col("valid_from").isNotNull() & F.col("arrival").isNotNull())
    kept = kept.where(~corrects | F.coalesce(F.col("valid_to") > F.col("valid_from"), F.lit(False)))
    one = kept.groupBy("key", corrects.alias("corrects"), "valid_from", F.when(corrects, F.col("valid_to")).alias("valid_to")).agg(F.max(order).alias("last"))
    return one.select("key", F.col("last.kind").alias("kind"), "valid_from", "valid_to", F.col("last.arrival").alias("arrival"), F.col("last.value.value").alias("value"))


def versions(changes: DataFrame, shard_changes: int = SHARD_CHANGES) -> DataFrame:
    """changes(key long, kind int, valid_from long, valid_to long, arrival string or number or struct, value string) -> (key, version, valid_from, valid_to, value).

    `arrival` is any orderable value that grows with the order of arrival; valid_to is read from corrections only.
    Versions are numbered from 1 by valid_from; valid_to is exclusive, null without end.
    """
    prepare(changes.sparkSession)
    n = changes.count()
    shards = max(1, math.ceil(n / shard_changes))
    dealt = last_arrived(changes).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_versions, VERSIONS)


def document_changes(docs: DataFrame) -> DataFrame:
    """Two changes of each document (see the contract in `op12_dimension_history`), as versions() takes them.

    Arrival order is a hash's first 48 bits, then doc_id, then the number of the change. Rows without doc_id make none.
    """
    one = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("source").cast("string").alias("value")).where("d IS NOT NULL")
    one = one.select("d", "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    hashed = F.substring(F.sha2(F.concat_ws(":", "d", "j"), 256), 1, 12)
    # conv() gives decimal text; 48 bits fit a long.
    one = one.select("d", "j", "value", F.conv(hashed, 16, 10).cast("long").alias("h"))
    start: Column = F.col("h") % DAYS
    digit = F.expr("h DIV 1000") % 10
    kind = F.when(digit < 2, DELETE).when(digit < 5, CORRECTION).otherwise(UPDATE)
    return one.select(
        (F.col("d") - F.col("d") % 10).alias("key"),
        kind.alias("kind"),
        start.alias("valid_from"),
        F.when(kind == CORRECTION, start + CORRECTION_DAYS).alias("valid_to"),
        F.struct("h", "d", "j").alias("arrival"),
        "value",
    )
