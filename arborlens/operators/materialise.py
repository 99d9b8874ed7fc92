"""A repository's graph as workspace rows (M4-M6): elements, views, placements and connectors of every level in one plan, with provenance.

The repository, each folder, file and chunk of symbols owns a view; what stands one level below is placed there. Symbols of a file beyond `most` are
dealt in chunks of that size, in order of line and key, each with an element and a view of its own. A reference is drawn where its ends' paths part: in the view that both share, between
the two elements that stand there for the ends. Owners that are known keep their ids; new ones get ids after the largest known one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.operators.graph import checkpointed
from arborlens.operators.layout import CELL_X, CELL_Y
from arborlens.operators.relational import numbered

#: Cells of a view's grid in a row.
COLUMNS = 4
LEVELS = {"repository": 0, "folder": 1, "file": 2, "cluster": 3, "symbol": 4}


@dataclass
class Workspace:
    """elements: id, owner_key, kind, name, parent, dirty; views: id, owner_key, element_id, name; placements: view_id, element_id, x, y; connectors: view_id, source_id, target_id, n, kinds."""

    elements: DataFrame
    views: DataFrame
    placements: DataFrame
    connectors: DataFrame


def _places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `at`: their number within the group, from 0, by ranges of the order instead of a task for each group."""
    every = numbered(rows, [group, *order], "_all")
    first = every.groupBy(group).agg(F.min("_all").alias("_first"))
    return every.join(first, group).withColumn("at", F.col("_all") - F.col("_first")).drop("_all", "_first")


def _with_ids(owners: DataFrame, known: DataFrame) -> DataFrame:
    """owners(owner_key, level, ...) with id: the known one, or the next after the largest, by level and key."""
    most = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    j = checkpointed(owners.join(known.select("owner_key", F.col("id").alias("known")), "owner_key", "left"))
    fresh = numbered(j.where("known IS NULL").select("level", "owner_key"), ["level", "owner_key"]).crossJoin(F.broadcast(most)).select("owner_key", (F.col("most") + F.col("place") + 1).alias("fresh"))
    return j.join(fresh, "owner_key", "left").withColumn("id", F.coalesce("known", "fresh")).drop("known", "fresh")


def materialised(name: str, symbols: DataFrame, references: DataFrame, known: DataFrame, known_views: DataFrame, most: int) -> Workspace:
    """symbols(key, name, path, line), references(source, target, kind), known(owner_key, id, name, hash, last_hash), known_views(owner_key, id) -> the workspace's rows.

    A known element whose hash differs from what the last run left was edited by hand: it keeps its name and is dirty.
    """
    file = F.concat(F.lit("file:"), F.col("path"))
    placed = _places(symbols.select("key", "name", "path", "line"), "path", ["line", "key"])
    large = placed.groupBy("path").agg(F.max("at").alias("last")).select("path", (F.col("last") >= most).alias("many"))
    placed = checkpointed(placed.join(large, "path").withColumn("chunk", F.when(F.col("many"), F.floor(F.col("at") / most))))
    members = placed.where("chunk IS NOT NULL").groupBy("path", "chunk").agg(F.sha2(F.concat_ws("\n", "path", F.array_join(F.array_sort(F.collect_list("key")), "\n")), 256).alias("hash"))
    placed = checkpointed(placed.join(members, ["path", "chunk"], "left"))

    root = F.lit("repository:1")
    parts = F.split("path", "/")
    # Owners from the repository down to the file.
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.lit("folder:"), F.array_join(F.slice(parts, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))
    files = placed.select("path").distinct().select("path", F.concat(F.array(root), above, F.array(file)).alias("chain"))
    files = checkpointed(files)
    base = lambda c: F.regexp_extract(c, r"([^/:]*)$", 1)
    steps = files.select("chain", F.explode(F.sequence(F.lit(1), F.size("chain"))).alias("k")).select(F.element_at("chain", F.col("k")).alias("owner_key"), F.when(F.col("k") > 1, F.element_at("chain", F.col("k") - 1)).alias("parent")).distinct()
    kind = F.split_part("owner_key", F.lit(":"), F.lit(1))
    steps = steps.select("owner_key", "parent", kind.alias("kind"), F.when(F.col("parent").isNull(), F.lit(name)).otherwise(base(F.col("owner_key"))).alias("name"), F.lit(0).cast("long").alias("line"))
    cluster = F.concat(F.lit("cluster:"), F.col("hash"))
    clusters = placed.where("chunk IS NOT NULL").groupBy("path", "chunk", "hash").agg(F.count("*")).select(cluster.alias("owner_key"), file.alias("parent"), F.lit("cluster").alias("kind"), F.concat(base(F.col("path")), F.lit(" cluster "), (F.col("chunk") + 1).cast("string")).alias("name"), F.col("chunk").alias("line"))
    leaves = placed.select(F.concat(F.lit("symbol:"), F.col("key")).alias("owner_key"), F.coalesce(cluster, file).alias("parent"), F.lit("symbol").alias("kind"), "name", F.col("line").cast("long").alias("line"))
    level = F.element_at(F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (k, v)]), F.col("kind"))
    owners = steps.unionByName(clusters).unionByName(leaves).withColumn("level", level)

    edited = known.select("owner_key", F.col("name").alias("kept"), (F.col("hash") != F.col("last_hash")).alias("dirty"))
    elements = _with_ids(owners, known).join(edited, "owner_key", "left").withColumn("dirty", F.coalesce("dirty", F.lit(False)))
    elements = checkpointed(elements.withColumn("name", F.when(F.col("dirty"), F.col("kept")).otherwise(F.col("name"))).drop("kept"))
    views = checkpointed(_with_ids(elements.where("kind <> 'symbol'").select("owner_key", "level", F.col("id").alias("element_id"), "name"), known_views))
    in_view = elements.where("parent IS NOT NULL").join(views.select(F.col("owner_key").alias("parent"), F.col("id").alias("view_id")), "parent")
    spots = _places(in_view.select("view_id", "id", "level", "line", "owner_key"), "view_id", ["level", "line", "owner_key"])
    placements = spots.select("view_id", F.col("id").alias("element_id"), (F.col("at") % COLUMNS * CELL_X).cast("long").alias("x"), (F.floor(F.col("at") / COLUMNS) * CELL_Y).cast("long").alias("y"))
    top = elements.where("kind = 'repository'").select(F.lit(0).cast("long").alias("view_id"), F.col("id").alias("element_id"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    # Where the ends' chains part: the view of the last owner they share, and the next owner of either.
    chains = placed.join(files, "path").select("key", F.concat("chain", F.when(F.col("chunk").isNotNull(), F.array(cluster)).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit("symbol:"), F.col("key")))).alias("chain"))
    pairs = references.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    j = pairs.join(chains.select(F.col("key").alias("source"), F.col("chain").alias("a")), "source").join(chains.select(F.col("key").alias("target"), F.col("chain").alias("b")), "target")
    parted = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y) & x.isNotNull()), lambda same: same))
    ends = j.withColumn("k", parted).select(F.element_at("a", F.col("k")).alias("home"), F.element_at("a", F.col("k") + 1).alias("s"), F.element_at("b", F.col("k") + 1).alias("t"), "n", "kinds")
    drawn = ends.groupBy("home", "s", "t").agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"))
    ids = lambda c, name: elements.select(F.col("owner_key").alias(c), F.col("id").alias(name))
    connectors = drawn.join(views.select(F.col("owner_key").alias("home"), F.col("id").alias("view_id")), "home").join(ids("s", "source_id"), "s").join(ids("t", "target_id"), "t").select("view_id", "source_id", "target_id", "n", "kinds")
    return Workspace(elements.select("id", "owner_key", "kind", "name", "parent", "dirty"), views.select("id", "owner_key", "element_id", "name"), placements.unionByName(top), connectors)


def stale(made: Workspace, known: DataFrame, tombstones: DataFrame) -> DataFrame:
    """known(owner_key, id, hash, last_hash) that this run did not make: gone, but for what was edited by hand and what a version still shows (tombstones: owner_key). owner_key, id."""
    left = known.join(made.elements.select("owner_key"), "owner_key", "left_anti").where("hash = last_hash")
    return left.join(tombstones.select("owner_key"), "owner_key", "left_anti").select("owner_key", "id")
