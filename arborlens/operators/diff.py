"""Snapshots: diffs, change lists, three-way merge, pruning, upserts, entity merge (families T and M)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, hash) twice -> rows added, updated or deleted."""
    b, a = before.select(F.col(key), F.col("hash").alias("before_hash")), after.select(F.col(key), F.col("hash").alias("after_hash"))
    kind = F.when(F.col("before_hash").isNull(), "added").when(F.col("after_hash").isNull(), "deleted").when(F.col("before_hash") != F.col("after_hash"), "updated")
    return b.join(a, key, "full_outer").withColumn("change_type", kind).where("change_type is not null")


def merged_changes(changes: DataFrame) -> DataFrame:
    """changes(grp, path, change_type, language): a delete wins; else the first group with a language, else the first."""
    best = F.struct((F.col("change_type") != "deleted").alias("x"), (F.coalesce("language", F.lit("")) == "").alias("y"), F.col("grp"))
    return changes.groupBy("path").agg(F.min_by("change_type", best).alias("change_type"), F.min_by("language", best).alias("language"))


def three_way(base: DataFrame, local: DataFrame, server: DataFrame, key: str, prefer_server: list[str], fields: list[str]) -> DataFrame:
    """Merge by update time: server only changed -> server; both -> field by field, a clash is a conflict (but for position
    fields, which follow the server); gone from the server but in base -> deleted; new on either side -> kept."""
    side = lambda df, p: df.select(F.col(key), F.lit(True).alias(f"{p}_in"), *[F.col(c).alias(f"{p}_{c}") for c in [*fields, "updated_at"]])
    j = side(base, "b").join(side(local, "l"), key, "full_outer").join(side(server, "s"), key, "full_outer")
    here = lambda p: F.coalesce(f"{p}_in", F.lit(False))
    changed = lambda p: here(p) & (~here("b") | (F.col(f"{p}_updated_at") > F.col("b_updated_at")))
    action = (F.when(here("b") & here("l") & ~here("s"), "deleted").when(here("b") & ~here("l"), F.when(here("s") & changed("s"), "server").otherwise("removed"))
              .when(~here("l"), "added").when(~here("s"), "kept").when(changed("l") & changed("s"), "merged").when(changed("s"), "server").otherwise("kept"))
    j = j.withColumn("action", action)
    out, clashes = [], F.lit(0)
    for c in fields:
        b, l, s = (F.col(f"{p}_{c}") for p in "bls")  # noqa: E741
        clash = ~l.eqNullSafe(s) & ~l.eqNullSafe(b) & ~s.eqNullSafe(b)
        both = F.when(l.eqNullSafe(b), s).when(s.eqNullSafe(b), l).otherwise(s if c in prefer_server else l)
        out.append(F.when(F.col("action") == "merged", both).when(F.col("action").isin("server", "added"), s).otherwise(l).alias(c))
        if c not in prefer_server:
            clashes = clashes + F.when((F.col("action") == "merged") & clash, 1).otherwise(0)
    return j.where("action not in ('deleted', 'removed')").select(key, *out, "action", clashes.alias("conflicts"))


def diff_summary(diffs: DataFrame) -> DataFrame:
    """Counts per resource and change type, and sums of lines, negatives as none."""
    pos = lambda c: F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)))
    return diffs.groupBy("resource_type", "change_type").agg(F.count("*").alias("n"), pos("added_lines").alias("added"), pos("removed_lines").alias("removed"))


def missing(known: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    return known.join(planned.select(key), key, "left_anti")


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of changes replace those of the same key; others stay."""
    return current.join(changes.select(*key), key, "left_anti").unionByName(changes)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version beside the others, then move a pointer to it in one rename: readers see the old one or the new one, also after a crash. The one before is kept."""
    spark = df.sparkSession
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    name = f"v-{uuid.uuid4().hex}"
    before = _version(spark, path)
    df.write.parquet(f"{path}/{name}")
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = hadoop(f"{path}/NEXT-{name}")
    out = fs.create(fresh)
    out.write(bytearray(name.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop(path).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, hadoop(f"{path}/CURRENT"), options)
    for status in fs.listStatus(hadoop(path)):
        old = status.getPath().getName()
        if old.startswith("v-") and old not in (name, before):
            fs.delete(status.getPath(), True)


def _version(spark, path: str) -> str | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(f"{path}/CURRENT")):
        return None
    return spark.read.text(f"{path}/CURRENT").first()[0]


def read_table(spark, path: str) -> DataFrame:
    """The current version of a table written by replace_table."""
    return spark.read.parquet(f"{path}/{_version(spark, path)}")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that df has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def preserve_dirty(generated: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """stored(key, value, hash, last_hash): rows edited since the last run (hash differs) keep their value."""
    s = stored.select(key, F.col("value").alias("old"), (F.col("hash") != F.col("last_hash")).alias("dirty"))
    j = generated.join(s, key, "full_outer")
    dirty = F.coalesce("dirty", F.lit(False))
    return j.where(dirty | F.col("value").isNotNull()).select(key, F.when(dirty, F.col("old")).otherwise(F.col("value")).alias("value"), dirty.alias("dirty"))


def merge_entities(connectors: DataFrame, survivor: int, gone: int) -> DataFrame:
    """Reassign the ends of an element that is merged into another; an edge between them becomes a loop and stays."""
    move = lambda c: F.when(F.col(c) == gone, F.lit(survivor).cast("long")).otherwise(F.col(c)).alias(c)
    return connectors.select(*[move(c) if c in ("source_element_id", "target_element_id") else F.col(c) for c in connectors.columns])


def merge_placements(placements: DataFrame, survivor: int, gone: int) -> DataFrame:
    """Places of both elements as the survivor's, one for each view: its own where it has one."""
    mine = placements.withColumn("_own", F.col("element_id") != gone).withColumn("element_id", F.when(F.col("element_id") == gone, F.lit(survivor).cast("long")).otherwise(F.col("element_id")))
    w = Window.partitionBy("view_id", "element_id").orderBy(F.col("_own").desc())
    return mine.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_own")


def merge_fields(elements: DataFrame, survivor: int, gone: int, fields: list[str]) -> DataFrame:
    """The survivor takes the fields it lacks from the other, which goes."""
    other = elements.where(F.col("id") == gone).select(*[F.col(f).alias(f"_{f}") for f in fields]).limit(1)
    kept = elements.where(F.col("id") != gone).join(F.broadcast(other), F.col("id") == survivor, "left")
    fill = lambda f: F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.col(f"_{f}")).otherwise(F.col(f)).alias(f)
    return kept.select(*[fill(c) if c in fields else F.col(c) for c in elements.columns])


def set_override(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(view_id, element_id, delta): clamped to -4..4; 0 takes the row away."""
    c = changes.withColumn("delta", F.greatest(F.least(F.col("delta"), F.lit(4)), F.lit(-4)).cast("int"))
    return upsert(overrides, c, ["view_id", "element_id"]).where("delta <> 0")


def suppressed(stream: DataFrame, key: str, order: list, fingerprint: str) -> DataFrame:
    """Rows whose fingerprint differs from the one before of the same key."""
    before = F.lag(fingerprint).over(Window.partitionBy(key).orderBy(*order))
    return stream.where(F.lit(True)).withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col(fingerprint))).drop("_b")
