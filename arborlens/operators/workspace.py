"""Workspaces: materialising a graph, plans, partial updates, cascades, renames, reference resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions.naming import architecture_slug
from arborlens.operators.relational import numbered

#: Colours for tags, in order of use.
COLOURS = ["#60a5fa", "#f87171", "#34d399", "#fbbf24", "#a78bfa", "#f472b6", "#22d3ee", "#a3e635", "#fb923c", "#94a3b8"]


def element_placements(elements: DataFrame, placements: DataFrame, views: DataFrame) -> DataFrame:
    """Where each element stands: element_id, view_id, view_name."""
    v = views.select(F.col("id").alias("view_id"), F.col("name").alias("view_name"))
    return placements.join(elements.select(F.col("id").alias("element_id")), "element_id", "left_semi").join(v, "view_id").select("element_id", "view_id", "view_name")


def binding_targets(materialised: DataFrame, elements: DataFrame, views: DataFrame, owners: list[str]) -> DataFrame:
    """Materialised elements of these owner types with their view (0 if none) and blanks for missing fields."""
    v = views.where("owner_element_id is not null").select(F.col("id").alias("view_id"), F.col("owner_element_id").alias("resource_id"))
    e = elements.select(F.col("id").alias("resource_id"), "name", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("technology", F.lit("")).alias("technology"))
    m = materialised.where((F.col("resource_type") == "element") & F.col("owner_type").isin(owners))
    return m.join(e, "resource_id").join(v, "resource_id", "left").select("owner_type", "owner_key", "resource_id", F.coalesce("view_id", F.lit(0)).cast("long").alias("view_id"), "name", "kind", "technology")


def materialise(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements, placements and connectors of a graph, with provenance: each owner key keeps its resource id.

    nodes(key, name, folder), edges(source, target, label), known(owner_key, resource_id). New owners get ids after the
    largest known one, in order of key: folders first, then nodes. A node stands in its folder's view (the folder's
    element id); an edge in the view that holds both ends' folder, else in view 0.
    """
    folders = nodes.select(F.concat(F.lit("folder:"), "folder").alias("owner_key"), F.col("folder").alias("name"), F.lit(None).cast("string").alias("parent")).distinct()
    items = nodes.select(F.concat(F.lit("node:"), "key").alias("owner_key"), "name", F.concat(F.lit("folder:"), "folder").alias("parent"))
    every = folders.union(items).join(known, "owner_key", "left")
    most = known.agg(F.coalesce(F.max("resource_id"), F.lit(0)).alias("most"))
    fresh = every.where("resource_id is null").select("owner_key")
    fresh_ids = numbered(fresh, ["owner_key"]).crossJoin(F.broadcast(most)).select("owner_key", (F.col("most") + F.col("place") + 1).alias("fresh_id"))
    elements = every.join(fresh_ids, "owner_key", "left").select(F.coalesce("resource_id", "fresh_id").alias("id"), "owner_key", "name", "parent")
    ids = elements.select("owner_key", "id")
    placements = elements.where("parent is not null").select(F.col("id").alias("element_id"), F.col("parent").alias("owner_key")).join(ids, "owner_key").select(F.col("id").alias("view_id"), "element_id")
    at = elements.where("parent is not null").join(placements.withColumnRenamed("element_id", "id"), "id").select("id", "owner_key", "view_id")
    s = at.select(F.col("id").alias("source_id"), F.col("owner_key").alias("s"), F.col("view_id").alias("sv"))
    t = at.select(F.col("id").alias("target_id"), F.col("owner_key").alias("t"), F.col("view_id").alias("tv"))
    e = edges.select(F.concat(F.lit("node:"), "source").alias("s"), F.concat(F.lit("node:"), "target").alias("t"), "label").join(s, "s").join(t, "t")
    connectors = e.groupBy(F.when(F.col("sv") == F.col("tv"), F.col("sv")).otherwise(0).cast("long").alias("view_id"), "source_id", "target_id").agg(F.min("label").alias("label"), F.count("*").alias("n"))
    return elements, placements, connectors


def swept(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """stored(id, kind, dirty, tombstone): what a run did not touch goes, connectors first, then views, then elements; dirty rows and tombstones stay."""
    order = F.when(F.col("kind") == "connector", 0).when(F.col("kind") == "view", 1).otherwise(2)
    return stored.join(touched, ["kind", "id"], "left_anti").where("not dirty and not tombstone").select("kind", "id", order.cast("int").alias("step"))


def cascade(gone: DataFrame, placements: DataFrame, connectors: DataFrame, views: DataFrame) -> DataFrame:
    """Rows that go with deleted elements: their placements, connectors and owned views, and what stands in those views. (kind, id)."""
    e = gone.select(F.col("id").alias("element_id")).distinct()
    dead = views.join(e, views.owner_element_id == e.element_id, "left_semi").select(F.col("id").alias("view_id"))
    # By name: a join puts its key first, so the columns of the two parts stand in different order.
    p = placements.join(e, "element_id", "left_semi").unionByName(placements.join(dead, "view_id", "left_semi")).select("view_id", "element_id").distinct()
    c = connectors.join(e.withColumnRenamed("element_id", "source_element_id"), "source_element_id", "left_semi").select("id").union(connectors.join(e.withColumnRenamed("element_id", "target_element_id"), "target_element_id", "left_semi").select("id")).union(connectors.join(dead, "view_id", "left_semi").select("id")).distinct()
    rows = e.select(F.lit("element").alias("kind"), F.col("element_id").cast("string").alias("id"))
    return rows.union(dead.select(F.lit("view"), F.col("view_id").cast("string"))).union(p.select(F.lit("placement"), F.concat_ws(":", "view_id", "element_id"))).union(c.select(F.lit("connector"), F.col("id").cast("string")))


def partial_update(rows: DataFrame, changes: DataFrame, key: str, fields: list[str], keep: dict[str, object] | None = None) -> DataFrame:
    """Fields of changes that are given replace the old ones; null keeps, and so does the value that `keep` names for a field."""
    c = changes.select(key, *[F.col(f).alias(f"n_{f}") for f in fields])
    new = lambda f: F.when(F.col(f"n_{f}") != F.lit(keep[f]), F.col(f"n_{f}")) if keep and f in keep else F.col(f"n_{f}")
    return rows.join(c, key, "left").select(key, *[F.coalesce(new(f), F.col(f)).alias(f) if f in fields else F.col(f) for f in rows.columns if f != key])


def resolved_references(connectors: DataFrame, ids: DataFrame) -> DataFrame:
    """connectors(ref, source, target), ids(ref, id) -> ref, source_id, target_id; those with an unknown end are skipped."""
    s, t = ids.select(F.col("ref").alias("source"), F.col("id").alias("source_id")), ids.select(F.col("ref").alias("target"), F.col("id").alias("target_id"))
    return connectors.join(s, "source").join(t, "target").select("ref", "source_id", "target_id")


def view_owners(views: DataFrame, elements: DataFrame, navigations: DataFrame) -> DataFrame:
    """views(id, owner, name, label), elements(ref, id, name, label), navigations(view_id, element_id) -> view_id, ref, by.

    The owner named by the view; else by a navigation to it; else the one element of that name and label that no view has
    taken; else the one of that name.
    """
    e = elements.select("ref", F.col("id").alias("eid"), F.col("name").alias("ename"), F.col("label").alias("elabel"))
    own = views.join(e, F.col("owner") == F.col("eid")).select(F.col("id").alias("view_id"), "ref", F.lit(1).alias("by"))
    nav = views.join(navigations, F.col("id") == F.col("view_id")).join(e, F.col("element_id") == F.col("eid")).groupBy(F.col("id").alias("view_id")).agg(F.min("ref").alias("ref")).withColumn("by", F.lit(2))
    sure = own.union(nav.join(own.select("view_id"), "view_id", "left_anti").select("view_id", "ref", "by"))
    free = e.join(sure.select("ref"), "ref", "left_anti")
    open_ = views.join(sure.select(F.col("view_id").alias("id")), "id", "left_anti")
    # Elements are counted by name before the join, so that a name of many views and many elements makes no pairs.
    one = lambda found, by: found.groupBy(F.col("id").alias("view_id")).agg(F.sum("n").alias("n"), F.min("ref").alias("ref")).where("n = 1").select("view_id", "ref", F.lit(by).alias("by"))
    counted = lambda *names: free.groupBy(*names).agg(F.count("*").alias("n"), F.min("ref").alias("ref"))
    both = one(open_.join(counted("ename", "elabel"), (F.col("name") == F.col("ename")) & (F.col("label") == F.col("elabel"))), 3)
    rest = open_.join(both.select(F.col("view_id").alias("id")), "id", "left_anti")
    return sure.union(both).union(one(rest.join(counted("ename"), F.col("name") == F.col("ename")), 4))


def plan(elements: DataFrame, connectors: DataFrame, scope: Column) -> DataFrame:
    """An ordered request: elements in scope, a view for each element that something is placed in (and one root), then connectors between them.

    elements(ref, parent, known), connectors(ref, source, target, known) -> step, kind, ref, action (create or update).
    """
    e = elements.where(scope)
    act = F.when(F.col("known"), "update").otherwise("create").alias("action")
    homes = e.where("parent <> 'root'").select(F.col("parent").alias("ref")).distinct().join(e.select("ref", "known"), "ref")
    root = e.where("parent = 'root'").limit(1).select(F.lit(1).alias("step"), F.lit("view").alias("kind"), F.lit("root").alias("ref"), F.lit("create").alias("action"))
    inside = e.select("ref")
    c = connectors.join(inside.withColumnRenamed("ref", "source"), "source", "left_semi").join(inside.withColumnRenamed("ref", "target"), "target", "left_semi")
    return e.select(F.lit(0).alias("step"), F.lit("element").alias("kind"), "ref", act).union(root).union(homes.select(F.lit(1), F.lit("view"), "ref", act)).union(c.select(F.lit(2), F.lit("connector"), "ref", act))


def plan_summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy("kind").agg(F.count_if(F.col("action") == "create").alias("created"), F.count_if(F.col("action") == "update").alias("updated"))


def applied(planned: DataFrame, current: DataFrame) -> DataFrame:
    """planned(ref, name, value), current(id, ref, name, value) -> id, ref, name, value: known refs are updated, new ones follow the largest id in order of ref."""
    both = current.join(planned.select("ref", F.col("name").alias("n"), F.col("value").alias("v")), "ref", "left")
    kept = both.select("id", "ref", F.coalesce("n", "name").alias("name"), F.coalesce("v", "value").alias("value"))
    most = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    fresh = numbered(planned.join(current.select("ref"), "ref", "left_anti"), ["ref"]).crossJoin(F.broadcast(most))
    return kept.union(fresh.select((F.col("most") + F.col("place") + 1).alias("id"), "ref", "name", "value"))


def renamed(connectors: DataFrame, old: Column, new: Column) -> DataFrame:
    """Rewrite references to renamed elements in source and target."""
    return connectors.withColumns({c: F.when(F.col(c) == old, new).otherwise(F.col(c)) for c in ("source", "target")})


def removal_blockers(elements: DataFrame, connectors: DataFrame, placements: DataFrame) -> DataFrame:
    """ref -> connectors and children that stand in the way of removing an element; only those that have any."""
    c = connectors.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("ref")).groupBy("ref").agg(F.count("*").alias("connectors"))
    p = placements.groupBy(F.col("parent").alias("ref")).agg(F.count("*").alias("children"))
    return elements.select("ref").join(c, "ref", "left").join(p, "ref", "left").where("connectors is not null or children is not null").select("ref", F.coalesce("connectors", F.lit(0)).cast("long").alias("connectors"), F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def context_actions(tiers: DataFrame, actions: DataFrame, most: int) -> DataFrame:
    """tiers(scope, tier), actions(scope, action in show, clean, hide): show adds a tier, clean takes one, within 0..most; hide marks the scope. -> scope, before, after, hidden."""
    step = F.when(F.col("action") == "show", 1).when(F.col("action") == "clean", -1).otherwise(0)
    a = actions.groupBy("scope").agg(F.sum(step).alias("step"), F.bool_or(F.col("action") == "hide").alias("hidden"))
    j = a.join(tiers, "scope", "left").withColumn("before", F.coalesce("tier", F.lit(0)))
    return j.select("scope", F.col("before").cast("int").alias("before"), F.greatest(F.least(F.col("before") + F.col("step"), F.lit(most)), F.lit(0)).cast("int").alias("after"), "hidden")


def tag_colours(tags: DataFrame) -> DataFrame:
    """tags(tag, colour or null): those without one get the colour that fewest tags have, dealt in turn by name. -> tag, colour."""
    used = tags.where("colour is not null").groupBy("colour").agg(F.count("*").alias("n"))
    all_ = tags.sparkSession.createDataFrame([(i, c) for i, c in enumerate(COLOURS)], "at int, colour string")
    free = F.broadcast(all_.join(used, "colour", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "colour"))), lambda x: x["colour"]).alias("free")))
    open_ = numbered(tags.where("colour is null").select("tag").distinct(), ["tag"]).withColumn("place", F.pmod("place", F.lit(len(COLOURS)))).crossJoin(free)
    return tags.where("colour is not null").select("tag", "colour").union(open_.select("tag", F.element_at("free", (F.col("place") + 1).cast("int"))))


def ensured_placements(placements: DataFrame, connectors: DataFrame) -> DataFrame:
    """Places that connectors need and that are not there: both ends of each stand in its view."""
    ends = connectors.select("view_id", F.explode(F.array("source_element_id", "target_element_id")).alias("element_id")).distinct()
    return ends.join(placements, ["view_id", "element_id"], "left_anti")


def resource_hash(*columns: Column, tags: Column | None = None, managed: tuple[str, ...] = ("git:", "watch:")) -> Column:
    """SHA-256 of a resource's fields in order, missing ones marked; tags sorted, without those that the engine manages."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x01")) for c in columns]
    if tags is not None:
        own = F.filter(F.array_sort(F.array_distinct(tags)), lambda t: ~F.lit(False) if not managed else ~t.rlike("^(" + "|".join(managed) + ")"))
        parts.append(F.array_join(own, ","))
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def unique_refs(names: DataFrame) -> DataFrame:
    """names(id, name) -> id, ref: slugs, and -2, -3 and so on for repeats in order of id."""
    s = names.withColumn("slug", architecture_slug(F.col("name")))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    return s.select("id", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string"))).alias("ref"))
