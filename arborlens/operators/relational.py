"""Read surface: lookups, paging, joins, degree and signal aggregates, merges, top-k (families P, J, A, W)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 100) -> DataFrame:
    """LIMIT rules of the listing calls: below 0 all rows, 0 the default of 100; a negative offset is 0."""
    out = df.orderBy(*order)
    out = out.offset(max(0, offset)) if offset > 0 else out
    return out if limit < 0 else out.limit(limit or 100)


def element_search(elements: DataFrame, views: DataFrame, text: str, offset: int, limit: int) -> DataFrame:
    """Elements whose name holds the trimmed text, any case; total of all hits; whether and which view they own."""
    hits = elements.where(F.lower("name").contains(text.strip().lower()))
    owned = views.where("owner_element_id is not null").groupBy("owner_element_id").agg(F.min_by("name", "id").alias("view_label"))
    total = hits.agg(F.count("*").alias("total"))
    out = page(hits, [F.col("id").desc()], offset, limit).join(owned, F.col("id") == F.col("owner_element_id"), "left")
    return out.crossJoin(F.broadcast(total)).select("id", "kind", "name", F.col("owner_element_id").isNotNull().alias("has_view"), "view_label", "total")


def root_views(views: DataFrame, placements: DataFrame) -> DataFrame:
    """Views without an owner, or whose owner is placed in no other view."""
    p = placements.select(F.col("view_id").alias("p_view"), "element_id")
    return views.join(p, (F.col("owner_element_id") == F.col("element_id")) & (F.col("p_view") != F.col("id")), "left_anti").select("id", "name")


def child_views(views: DataFrame, placements: DataFrame, parent: int) -> DataFrame:
    """Distinct views whose owner is placed in the parent view, but for itself."""
    inside = placements.where(F.col("view_id") == parent).select("element_id")
    return views.where(F.col("id") != parent).join(inside, F.col("owner_element_id") == F.col("element_id"), "left_semi").select("id", "name")


def degrees(connectors: DataFrame) -> DataFrame:
    """In and out degree of every element on a connector; parallel ones count."""
    ends = F.explode(F.array(F.struct(F.col("source_element_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_element_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return connectors.select(ends.alias("e")).groupBy(F.col("e.id").alias("element_id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def both_ways(connectors: DataFrame) -> DataFrame:
    """(element_id, other): each connector seen from both ends; a self loop once."""
    one = connectors.select(F.col("source_element_id").alias("element_id"), F.col("target_element_id").alias("other"))
    return one.union(connectors.where("source_element_id <> target_element_id").select("target_element_id", "source_element_id"))


def neighbours(connectors: DataFrame) -> DataFrame:
    return both_ways(connectors).distinct().groupBy("element_id").agg(F.count("*").alias("neighbours"))


def neighbour_positions(connectors: DataFrame) -> DataFrame:
    """Where each neighbour stands: both directions top, in left, out right."""
    one = connectors.select(F.col("source_element_id").alias("element_id"), F.col("target_element_id").alias("other"), F.lit(True).alias("out"))
    two = connectors.select(F.col("target_element_id").alias("element_id"), F.col("source_element_id").alias("other"), F.lit(False).alias("out"))
    g = one.union(two).groupBy("element_id", "other").agg(F.count("*").alias("n"), F.bool_or("out").alias("o"), F.bool_or(~F.col("out")).alias("i"))
    return g.select("element_id", "other", "n", F.when(F.col("o") & F.col("i"), "top").when(F.col("i"), "left").otherwise("right").alias("position"))


def duplicate_connectors(connectors: DataFrame) -> DataFrame:
    """Groups of connectors with the same view and ends, and the one that stays."""
    return connectors.groupBy("view_id", "source_element_id", "target_element_id").agg(F.count("*").alias("n"), F.min("id").alias("survivor")).where("n > 1")


def merged_connectors(connectors: DataFrame) -> DataFrame:
    """Each group as one connector: relationships distinct, in id order, joined by ' / '; first label; direction bits of all.

    Distinct relationships are made before the lists, so a list holds as many entries as a group has relationships.
    """
    group = ["view_id", "source_element_id", "target_element_id"]
    way = F.col("direction") if "direction" in connectors.columns else F.lit("forward")
    bits = F.when(way == "both", 3).when(way == "backward", 2).when(way == "none", 0).otherwise(1)
    labelled = F.when(F.col("label").isNotNull(), F.col("id"))
    each = connectors.groupBy(*group, "relationship").agg(F.min("id").alias("id"), F.min_by("label", labelled).alias("label"), F.min(labelled).alias("lid"), F.bit_or(bits).alias("bits"))
    rows = F.array_sort(F.collect_list(F.struct("id", "relationship")))
    g = each.groupBy(*group).agg(rows.alias("r"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("lid"))).alias("label"), F.bit_or("bits").alias("bits"))
    direction = F.when(F.col("bits") == 3, "both").when(F.col("bits") == 2, "backward").when(F.col("bits") == 0, "none").otherwise("forward")
    return g.select(*group, F.col("r")[0]["id"].alias("id"), F.array_join(F.transform("r", lambda x: x["relationship"]), " / ").alias("relationship"), "label", direction.alias("direction"))


def first_per_group(df: DataFrame, group: str, order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")


def keep_latest(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """Retention: the first n rows of each group in this order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def chunk_members(df: DataFrame, group: str, order: list, size: int) -> DataFrame:
    """Number the chunks of `size` rows of each group."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size).cast("long"))


def duplicate_ordinals(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Keys that occur more than once get a running ordinal; others null."""
    w = Window.partitionBy(*key)
    return df.withColumn("ordinal", F.when(F.count("*").over(w) > 1, F.row_number().over(w.orderBy(*order))))


def covered_tags(tags: DataFrame, per_owner: int = 5, share: float = 0.70) -> DataFrame:
    """tags(owner, tag): those on 2 owners at least and `share` of them at most, the rarest `per_owner` of each owner."""
    each = tags.distinct()
    owners = each.agg(F.count_distinct("owner").alias("owners"))
    most = F.floor(share * F.col("owners"))
    ok = each.groupBy("tag").agg(F.count("*").alias("df")).crossJoin(F.broadcast(owners)).where((F.col("df") >= 2) & (F.col("df") <= F.when(most > 0, most).otherwise(F.col("owners") - 1))).select("tag", "df")
    return keep_latest(each.join(ok, "tag"), ["owner"], [F.col("df"), F.col("tag")], per_owner)


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Row numbers from 0 in this total order, without gathering the rows: ranges of the order, and their offsets from a count of each range."""
    from arborlens.operators.graph import checkpointed

    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = checkpointed(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_at")).drop("_part", "_at", "_offset")


def jump_rank(name: Column, term: str) -> Column:
    low = F.lower(name)
    return F.when(low == term, 0).when(low.startswith(term), 1).when(low.contains(term), 2).otherwise(3)


def jump_search(views: DataFrame, elements: DataFrame, term: str) -> DataFrame:
    """Up to 4 views, then up to 6 elements, by rank and name; 8 in all; a term below 3 characters finds nothing."""
    term = term.strip().lower()
    v = views.where(F.lower("name").contains(term) & F.lit(len(term) >= 3)).select(F.lit("view").alias("type"), "id", "name", jump_rank(F.col("name"), term).alias("rank"))
    e = elements.where((F.lower("name").contains(term) | F.lower(F.coalesce("kind", F.lit(""))).contains(term) | F.lower(F.coalesce("technology", F.lit(""))).contains(term)) & F.lit(len(term) >= 3)).select(F.lit("element").alias("type"), "id", "name", jump_rank(F.col("name"), term).alias("rank"))
    both = v.orderBy("rank", "name", "id").limit(4).union(e.orderBy("rank", "name", "id").limit(6))
    return both.orderBy(F.col("type").desc(), "rank", "name", "id").limit(8)


def suggestions(catalog: DataFrame, words: DataFrame, most: int = 3, k: int = 3) -> DataFrame:
    """For each word(word) the k nearest names(name) within an edit distance, shorter names first.

    A name within `most` edits holds one of its most + 1 parts unchanged, moved by `most` places at most, so words and names meet
    on (length of the name, number of the part, the part) instead of all with all.
    """
    parts = most + 1
    cut = lambda n, i: F.floor(n * i / parts).cast("int")
    piece = lambda text, start, size: F.substring(text, start + 1, size)
    low = F.lower("name")
    n = F.length(low)
    names = catalog.select("name").distinct().select("name", F.explode(F.array(*[F.struct(n.alias("n"), F.lit(i).alias("i"), piece(low, cut(n, i), cut(n, i + 1) - cut(n, i)).alias("part")) for i in range(parts)])).alias("x"))
    low = F.lower("word")
    sizes = F.explode(F.sequence(F.greatest(F.length(low) - most, F.lit(0)), F.length(low) + most)).alias("n")
    shifts = [(i, d) for i in range(parts) for d in range(-most, most + 1)]
    m = F.col("n")
    at = lambda i, d: F.when((cut(m, i) + d >= 0) & (cut(m, i + 1) + d <= F.length(low)), F.struct(m.alias("n"), F.lit(i).alias("i"), piece(low, cut(m, i) + d, cut(m, i + 1) - cut(m, i)).alias("part")))
    asked = words.select("word").distinct().select("word", sizes).select("word", F.explode(F.array_distinct(F.array_compact(F.array(*[at(i, d) for i, d in shifts])))).alias("x"))
    pairs = asked.join(names, "x").select("word", "name").distinct().withColumn("distance", F.levenshtein(F.lower("word"), F.lower("name"), most)).where("distance >= 0")
    return keep_latest(pairs, ["word"], [F.col("distance"), F.length("name"), F.col("name")], k)


def symbol_page(symbols: DataFrame, files: DataFrame, search: str = "", kind: str | None = None, path: str | None = None, offset: int = 0, limit: int = 0) -> DataFrame:
    """symbols(id, file_id, name, qualified_name, kind, start_line) with their file's path: by words in either name, by kind, by exact file; in order of path, line and name."""
    rows = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    if search.strip():
        rows = rows.where(F.contains(F.lower("name"), F.lit(search.strip().lower())) | F.contains(F.lower("qualified_name"), F.lit(search.strip().lower())))
    for column, value in (("kind", kind), ("path", path)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return page(rows, ["path", "start_line", "name", "id"], offset, limit)


def views_below(views: DataFrame, closure: DataFrame, root: int | None = None, parent: int | None = None, text: str = "") -> DataFrame:
    """Views under a root at any depth, or directly under a parent, whose name holds a text in any case."""
    rows = views
    if root is not None:
        rows = rows.join(closure.where((F.col("ancestor_id") == root) & (F.col("depth") > 0)).select(F.col("view_id").alias("id")), "id", "left_semi")
    if parent is not None:
        rows = rows.join(closure.where((F.col("ancestor_id") == parent) & (F.col("depth") == 1)).select(F.col("view_id").alias("id")), "id", "left_semi")
    return rows.where(F.contains(F.lower("name"), F.lit(text.strip().lower()))) if text.strip() else rows


def latest_decisions(decisions: DataFrame, owner_type: str | None = None, decision: str | None = None) -> DataFrame:
    """Decisions of the latest run(run_id) only."""
    last = decisions.agg(F.max("run_id").alias("last"))
    rows = decisions.join(F.broadcast(last), F.col("run_id") == F.col("last")).drop("last")
    for column, value in (("owner_type", owner_type), ("decision", decision)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def owner_signals(materialised: DataFrame, decisions: DataFrame) -> DataFrame:
    """Signals of resources through their owners: both owner_type and owner_key must agree; largest score, smallest tier."""
    j = materialised.join(decisions, ["owner_type", "owner_key"])
    return j.groupBy("resource_id").agg(F.max("score").alias("filter_score"), F.min("tier").alias("tier"))


def directed_neighbours(connectors: DataFrame) -> DataFrame:
    """element_id, other, n, position: by where connectors point, with their direction: to both top, to none bottom, both in and out top, in left, out right."""
    way = F.col("direction")
    one = connectors.select(F.col("source_element_id").alias("element_id"), F.col("target_element_id").alias("other"), way.isin("forward", "both").alias("o"), way.isin("backward", "both").alias("i"))
    two = connectors.where("source_element_id <> target_element_id").select(F.col("target_element_id").alias("element_id"), F.col("source_element_id").alias("other"), way.isin("backward", "both").alias("o"), way.isin("forward", "both").alias("i"))
    g = one.union(two).groupBy("element_id", "other").agg(F.count("*").alias("n"), F.bool_or("o").alias("o"), F.bool_or("i").alias("i"))
    return g.select("element_id", "other", "n", F.when(F.col("o") & F.col("i"), "top").when(F.col("i"), "left").when(F.col("o"), "right").otherwise("bottom").alias("position"))


def orphans(identities: DataFrame, symbols: DataFrame) -> DataFrame:
    """Identities whose current key no symbol has."""
    return identities.join(symbols.select(F.col("stable_key").alias("current_key")), "current_key", "left_anti")


def pruned_tags(tags: DataFrame, forced: tuple[str, ...] = ("owner:",), keep: tuple[str, ...] = ("owner:",), per_owner: int = 5, share: float = 0.70) -> DataFrame:
    """tags(owner, tag): a tag with a forced prefix counts as approved, others by how many owners have them; then the rarest `per_owner` of each owner, forced ones before; kept prefixes beyond that too."""
    starts = lambda prefixes: F.lit(False) if not prefixes else F.col("tag").rlike("^(" + "|".join(prefixes) + ")")
    each = tags.distinct()
    owners = each.agg(F.count_distinct("owner").alias("owners"))
    most = F.floor(share * F.col("owners"))
    df = each.groupBy("tag").agg(F.count("*").alias("df")).crossJoin(F.broadcast(owners))
    ok = df.where(starts(forced) | ((F.col("df") >= 2) & (F.col("df") <= F.when(most > 0, most).otherwise(F.col("owners") - 1)))).select("tag", "df")
    w = Window.partitionBy("owner").orderBy((~starts(forced)).cast("int"), "df", "tag")
    return each.join(ok, "tag").withColumn("r", F.row_number().over(w)).where((F.col("r") <= per_owner) | starts(keep)).select("owner", "tag")


def folder_pairs(references: DataFrame, limit: int = 24, most: int = 100) -> DataFrame:
    """references(source_path, target_path): cross-folder references counted per pair of top folders.

    A pair of more than `limit` is one edge 'N references'; of others each pair of files is an edge. The first `most` by number.
    """
    top = lambda c: F.when(F.contains(F.col(c), F.lit("/")), F.split_part(F.col(c), F.lit("/"), F.lit(1))).otherwise(".")
    files = references.where("source_path <> target_path").groupBy("source_path", "target_path").agg(F.count("*").alias("n"))
    files = files.withColumn("source_folder", top("source_path")).withColumn("target_folder", top("target_path")).where("source_folder <> target_folder")
    pairs = files.groupBy("source_folder", "target_folder").agg(F.sum("n").alias("total"))
    big = pairs.where(F.col("total") > limit).select(F.col("source_folder").alias("source"), F.col("target_folder").alias("target"), F.col("total").alias("n"), F.concat(F.col("total").cast("string"), F.lit(" references")).alias("label"))
    small = files.join(pairs.where(F.col("total") <= limit), ["source_folder", "target_folder"], "left_semi").select(F.col("source_path").alias("source"), F.col("target_path").alias("target"), "n", F.lit(None).cast("string").alias("label"))
    return big.union(small).orderBy(F.col("n").desc(), "source", "target").limit(most)


def tiered_chunks(df: DataFrame, group: str, order: list, base: int, tier: str) -> DataFrame:
    """Chunks of a group's rows, larger where its tier is higher (naming.effective_maximum)."""
    from arborlens.functions.naming import effective_maximum

    size = effective_maximum(base, F.max(tier).over(Window.partitionBy(group)))
    r = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn("r", r).withColumn("size", size).withColumn("chunk", F.floor(F.col("r") / F.col("size")).cast("long")).drop("r", "size")


def jump_targets(views: DataFrame, placed: DataFrame, term: str) -> DataFrame:
    """jump_search over placed(view_id, element_id, name, kind, technology, path, tags): elements also by path and tags, each view and element once."""
    term = term.strip().lower()
    ok = F.lit(len(term) >= 3)
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term))
    tagged = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit(term)))
    v = views.where(has("name") & ok).select(F.lit("view").alias("type"), F.col("id").alias("view_id"), F.lit(None).cast("long").alias("element_id"), "name", jump_rank(F.col("name"), term).alias("rank"))
    hits = placed.where((has("name") | has("kind") | has("technology") | has("path") | tagged) & ok).dropDuplicates(["view_id", "element_id"])
    e = hits.select(F.lit("element").alias("type"), "view_id", "element_id", "name", jump_rank(F.col("name"), term).alias("rank"))
    both = v.orderBy("rank", "name", "view_id").limit(4).union(e.orderBy("rank", "name", "element_id", "view_id").limit(6))
    return both.orderBy(F.col("type").desc(), "rank", "name", "view_id", "element_id").limit(8)


def alike(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """rows(key, ...) -> (name, ...): its rows without the key, each once and named by 128 bits of hashes of its values; and (name, key)."""
    rest = [c for c in rows.columns if c != key]
    # As text, since a hash of columns passes over nulls.
    values = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    code = F.struct(F.xxhash64(values), F.xxhash64(F.lit(1), values)).alias(name)
    return rows.select(code, *rest).distinct(), rows.select(code, key)


def smallest(members: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """members(group, key): those of the `most` smallest keys of each group."""
    return members.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_at") <= most).drop("_at")
