"""Merging nested sections of a workspace, row by row (T11): the placements of elements that were changed on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _filled(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def merged_value(local: Column, server: Column) -> tuple[Column, Column]:
    """(value, is a conflict) of a scalar that both sides have: the filled one, or either of equal ones; else both in a marked text."""
    a, b = _filled(local), _filled(server)
    clash = (a != b) & (a != "") & (b != "")
    marked = F.concat(F.lit("<<< LOCAL\n"), a, F.lit("\n===\n"), b, F.lit("\n>>> SERVER"))
    return F.when(clash, marked).when(a == "", server.cast("string")).otherwise(local.cast("string")), clash


def merge_sections(actions: DataFrame, local: DataFrame, server: DataFrame, positions: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """actions(key, action), local and server(key, parent, place, positions..., fields...) -> (rows, conflicts).

    An element whose action is "merged" gets its sections matched by parent: both sides' values are merged field by field, positions come from the server; what one side alone has stays.
    Of "server" and "added" elements the server's rows count, of others the local ones. Local rows without a parent match nothing and
    stay; of several server rows of one parent the last by place counts. Rows: key, parent, positions, fields (text), side. Conflicts: key, parent, field, local, server.
    """
    keyed = lambda df, p: df.select("key", "parent", F.struct("place", *positions, *fields).alias(p))
    of = lambda df, test: keyed(df, "r").join(actions.where(test).select("key"), "key", "left_semi")
    whole = of(local, ~F.col("action").isin("merged", "server", "added", "deleted", "removed")).withColumn("side", F.lit("local"))
    whole = whole.unionByName(of(server, F.col("action").isin("server", "added")).withColumn("side", F.lit("server")))
    clashing = actions.where("action = 'merged'").select("key")
    mine = keyed(local, "l").join(clashing, "key", "left_semi").withColumn("match", F.when(_filled(F.col("parent")) != "", F.col("parent")))
    theirs = keyed(server, "s").join(clashing, "key", "left_semi").where(_filled(F.col("parent")) != "")
    theirs = theirs.groupBy("key", F.col("parent").alias("match")).agg(F.max_by("s", "s.place").alias("s"))
    both = mine.join(theirs, ["key", "match"], "full_outer")
    here = F.col("l").isNotNull() & F.col("s").isNotNull()
    values = {c: merged_value(F.col(f"l.{c}"), F.col(f"s.{c}")) for c in fields}
    merged = both.select(
        "key", F.coalesce("parent", "match").alias("parent"), *[F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"l.{c}")).alias(c) for c in positions],
        *[F.when(here, v).otherwise(F.coalesce(F.col(f"l.{c}").cast("string"), F.col(f"s.{c}").cast("string"))).alias(c) for c, (v, _) in values.items()],
        F.when(here, "both").when(F.col("l").isNotNull(), "local").otherwise("server").alias("side"),
    )
    rows = whole.select("key", "parent", *[F.col(f"r.{c}").alias(c) for c in positions], *[F.col(f"r.{c}").cast("string").alias(c) for c in fields], "side")
    told = F.array_compact(F.array(*[F.when(here & clash, F.struct(F.lit(c).alias("field"), _filled(F.col(f"l.{c}")).alias("local"), _filled(F.col(f"s.{c}")).alias("server"))) for c, (_, clash) in values.items()]))
    conflicts = both.select("key", F.coalesce("parent", "match").alias("parent"), F.explode(told).alias("c")).select("key", "parent", "c.*")
    return rows.unionByName(merged), conflicts
