"""Versions: classified diffs, line attribution, diff lenses and locations, version log, reuse, tag state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.operators import relational

#: Tags that follow the state of the working tree.
MANAGED_TAGS = ["git:staged", "git:unstaged", "git:untracked", "watch:deleted"]


def current_snapshot(**parts: DataFrame) -> DataFrame:
    """Files, symbols, facts and resources, each (owner_key, hash), as one keyed relation: owner_type, owner_key, hash."""
    out = None
    for kind, df in sorted(parts.items()):
        one = df.select(F.lit(kind).alias("owner_type"), F.col("owner_key").cast("string").alias("owner_key"), "hash")
        out = one if out is None else out.unionByName(one)
    return out


def promoted_diff(before: DataFrame, after: DataFrame, raw_before: DataFrame, raw_after: DataFrame) -> DataFrame:
    """Diff of materialised elements (key, hash) with their raw resources: a new element whose raw resource was there and changed is updated, not added.

    One whose raw resource did not change stays added. Rows: key, before_hash, after_hash, change_type.
    """
    j = before.select("key", F.col("hash").alias("before_hash")).join(after.select("key", F.col("hash").alias("after_hash")), "key", "full_outer")
    j = j.join(raw_before.select("key", F.col("hash").alias("raw0")), "key", "left").join(raw_after.select("key", F.col("hash").alias("raw1")), "key", "left")
    new = F.col("before_hash").isNull()
    kind = F.when(new & F.col("raw0").isNotNull() & F.col("raw1").isNotNull() & (F.col("raw0") != F.col("raw1")), "updated").when(new, "added").when(F.col("after_hash").isNull(), "deleted").when(F.col("before_hash") != F.col("after_hash"), "updated")
    return j.select("key", F.when(new & (kind == "updated"), F.col("raw0")).otherwise(F.col("before_hash")).alias("before_hash"), "after_hash", kind.alias("change_type")).where("change_type is not null")


def initial_diff(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The first version's diff: snapshot(key, paths), changes(path, change_type).

    A clean tree initialises everything; in a dirty one only resources of touched paths show, added if any of their
    paths is, else updated.
    """
    dirty = changes.select("path", "change_type").where(F.col("change_type").isin("added", "updated"))
    any_ = changes.limit(1).agg((F.count("*") > 0).alias("dirty"))
    touched = snapshot.select("key", F.explode("paths").alias("path")).join(dirty, "path").groupBy("key").agg(F.min("change_type").alias("c"))
    j = snapshot.select("key").join(touched, "key", "left").crossJoin(F.broadcast(any_))
    return j.where("c is not null or not dirty").select("key", F.coalesce("c", F.lit("initialized")).alias("change_type"))


def import_of_line(line: Column) -> Column:
    """The module of an import line: import "x", alias "x" or "x" alone."""
    found = F.regexp_extract(F.trim(line), r'^(?:import\s+)?(?:[A-Za-z_.][A-Za-z0-9_]*\s+)?"([^"]+)"$', 1)
    return F.when(found != "", found)


def deleted_imports(lines: DataFrame, removed: DataFrame, summaries: DataFrame, known: DataFrame) -> DataFrame:
    """Deletions of single imports that only a summary recorded: lines(file, line_no, line) of the old files, removed(file,
    line_no), summaries(file) deleted import summaries, known(owner_key). Rows: owner_type, owner_key, summary, an element and a connector each."""
    hit = removed.distinct().join(summaries.select("file").where("file like '%.go'").distinct(), "file", "left_semi").join(lines, ["file", "line_no"])
    hit = hit.withColumn("module", import_of_line(F.col("line"))).where("module is not null")
    key = F.concat(F.lit("fact:dependency.import:"), "file", F.lit(":"), "module", F.lit(":"), F.col("line_no").cast("string"))
    fresh = hit.select("file", "module", key.alias("owner_key")).join(known.select("owner_key"), "owner_key", "left_anti")
    both = F.explode(F.array(F.struct(F.lit("fact").alias("t"), F.col("owner_key").alias("k"), F.col("module").alias("s")), F.struct(F.lit("fact-import-connector").alias("t"), F.concat("owner_key", F.lit(":file")).alias("k"), F.concat(F.regexp_extract("file", "([^/]*)$", 1), F.lit("->"), "module").alias("s"))))
    return fresh.select(both.alias("r")).select(F.col("r.t").alias("owner_type"), F.col("r.k").alias("owner_key"), F.col("r.s").alias("summary"))


def diff_query(diffs: DataFrame, change: str | None, resource: str | None, language: str | None, limit: int) -> DataFrame:
    """Filters on change and resource, then the limit, then the language: a page may hold fewer rows than the limit."""
    rows = diffs
    for name, value in (("change_type", change), ("resource_type", resource)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    rows = rows.orderBy("id").limit(limit)
    return rows if language is None else rows.where(F.col("language") == language)


def file_lines(symbols: DataFrame) -> DataFrame:
    """Lines of a file, as its symbols show: the largest end (or start)."""
    return symbols.groupBy("path").agg(F.max(F.coalesce("end_line", "start_line")).alias("lines"))


def under_folders(files: DataFrame, *sums: str) -> DataFrame:
    """files(path, counts...) -> folder and the sums below it, at any depth; the file itself counts as its own folder."""
    parts = F.split("path", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return files.withColumn("folder", up).groupBy("folder").agg(*[F.sum(c).alias(c) for c in sums])


def attributed_lines(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """symbols(key, path, start_line, end_line, old_start, old_end), lines(path, line, kind added or removed) -> key, added, removed.

    Added lines count in the new range, removed ones in the old range (the new one where there is none). A range's number is the lines up to its end less those before its start, so no line
    meets a range: running sums over the numbers of a file's lines and ranges' ends, each number once, are looked up.
    """
    start, end = F.coalesce("old_start", "start_line"), F.coalesce("old_end", "end_line")
    r = symbols.select("key", "path", (F.col("start_line") - 1).alias("a0"), F.col("end_line").alias("b0"), (start - 1).alias("a1"), end.alias("b1"))
    r = r.withColumns({c: F.when((F.col(f"a{c[1]}") >= 0) & (F.col(f"b{c[1]}") > F.col(f"a{c[1]}")), F.col(c)) for c in ("a0", "b0", "a1", "b1")})
    counts = lines.groupBy("path", "line").agg(F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"))
    zero = F.lit(0).cast("long")
    points = r.select("path", F.explode(F.array("a0", "b0", "a1", "b1")).alias("line")).where("line is not null").distinct().select("path", "line", zero.alias("added"), zero.alias("removed"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    each = counts.unionByName(points).groupBy("path", "line").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    total = each.select("path", "line", F.sum("added").over(w).alias("added"), F.sum("removed").over(w).alias("removed"))
    for c, kind in (("a0", "added"), ("b0", "added"), ("a1", "removed"), ("b1", "removed")):
        r = r.join(total.select("path", F.col("line").alias(c), F.col(kind).alias(f"n_{c}")), ["path", c], "left")
    within = lambda k: F.coalesce(F.sum(F.col(f"n_b{k}") - F.col(f"n_a{k}")), zero)
    return r.groupBy("key").agg(within(0).alias("added"), within(1).alias("removed"))


def chunked_hash(rows: DataFrame, group: str, order: list, line: Column, size: int = 1000) -> DataFrame:
    """SHA-256 of a group's lines in order, through hashes of chunks of `size` lines: no task holds more lines than a chunk, and hashes of one group a thousandth of them."""
    # Lines are numbered by ranges of the order, so a group of many lines is many tasks; each group begins at its smallest number.
    by = [(c if isinstance(c, Column) else F.col(c)).alias(f"_{k}") for k, c in enumerate(order)]
    every = relational.numbered(rows.select(group, line.alias("line"), *by), [group, *[f"_{k}" for k in range(len(order))]], "_all")
    first = every.groupBy(F.col(group).alias("_group")).agg(F.min("_all").alias("_first"))
    each = every.join(first, F.col(group).eqNullSafe(F.col("_group"))).select(group, "line", (F.col("_all") - F.col("_first") + 1).alias("at"))
    part = each.groupBy(group, F.floor((F.col("at") - 1) / size).alias("chunk")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n"), 256).alias("h"))
    return part.groupBy(group).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "h"))), lambda x: x["h"]), "\n"), 256).alias("hash"))


def lens(changed: DataFrame, placements: DataFrame, closure: DataFrame, views: DataFrame) -> DataFrame:
    """Which elements a diff brings into sight: element_id, changed, ancestor, sibling, unplaced.

    From every view a changed element stands in, up to the root: all placed elements are siblings, owners of the views are
    ancestors. A changed element without a place is unplaced.
    """
    where = placements.join(changed.select("element_id").distinct(), "element_id", "left_semi").select("view_id").distinct()
    path = where.join(closure, "view_id").select(F.col("ancestor_id").alias("view_id")).distinct()
    none = F.lit(0)
    a = changed.select("element_id").distinct().join(placements.select("element_id", F.lit(1).alias("p")).distinct(), "element_id", "left").select("element_id", F.lit(1).alias("changed"), none.alias("ancestor"), none.alias("sibling"), F.when(F.col("p").isNull(), 1).otherwise(0).alias("unplaced"))
    b = placements.join(path, "view_id", "left_semi").select("element_id", none, none, F.lit(1), none)
    c = views.join(path, views.id == path.view_id, "left_semi").where("owner_element_id is not null").select("owner_element_id", none, F.lit(1), none, none)
    return a.union(b).union(c).groupBy("element_id").agg(*[(F.max(k) == 1).alias(k) for k in ("changed", "ancestor", "sibling", "unplaced")])


def locations(diffs: DataFrame, placements: DataFrame, connectors: DataFrame) -> DataFrame:
    """Where each change shows: resource_type, resource_id, view_id, change_type (of the first diff of that place), added, removed."""
    spots = placements.select(F.lit("element").alias("resource_type"), F.col("element_id").alias("resource_id"), "view_id").union(connectors.select(F.lit("connector"), "id", "view_id"))
    j = diffs.join(spots, ["resource_type", "resource_id"])
    pos = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    first = F.min_by(F.struct("change_type", pos(F.col("added")).alias("added"), pos(F.col("removed")).alias("removed")), "id")
    return j.groupBy("resource_type", "resource_id", "view_id").agg(first.alias("d")).select("resource_type", "resource_id", "view_id", "d.change_type", "d.added", "d.removed")


def new_versions(heads: DataFrame, order: list) -> DataFrame:
    """heads(repository_id, head, hash, ...) in order: a version wherever the head or the representation differs from the one before."""
    w = Window.partitionBy("repository_id").orderBy(*order)
    moved = ~F.col("head").eqNullSafe(F.lag("head").over(w)) | ~F.col("hash").eqNullSafe(F.lag("hash").over(w))
    return heads.withColumn("moved", moved).where("moved").drop("moved")


def reusable(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """wanted(repository_id, raw_hash, settings_hash) -> + run_id of the latest completed run if it has the same hashes, else null (run again)."""
    latest = runs.where("status = 'completed'").groupBy("repository_id").agg(F.max_by(F.struct("run_id", "raw_hash", "settings_hash"), "run_id").alias("r"))
    same = (F.col("r.raw_hash") == F.col("raw_hash")) & (F.col("r.settings_hash") == F.col("settings_hash"))
    return wanted.join(latest, "repository_id", "left").select("repository_id", F.when(same, F.col("r.run_id")).alias("run_id"))


def tag_state(elements: DataFrame, status: DataFrame) -> DataFrame:
    """elements(id, path, tags), status(path, tag) -> id, tags, added, removed: managed tags follow the status, others stay."""
    wanted = status.groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("wanted"))
    none = F.array().cast("array<string>")
    managed = F.array(*[F.lit(t) for t in MANAGED_TAGS])
    j = elements.join(wanted, "path", "left").withColumn("wanted", F.coalesce("wanted", none))
    kept = F.array_except("tags", F.array_except(managed, F.col("wanted")))
    return j.select("id", F.array_union(kept, F.col("wanted")).alias("tags"), F.size(F.array_except("wanted", "tags")).cast("long").alias("added"), (F.size("tags") - F.size(kept)).cast("long").alias("removed"))


def control_states(requests: DataFrame, order: list) -> DataFrame:
    """requests(lock, request in pause, resume, stop) -> the state each lock ends in: stopping wins for good."""
    last = requests.where("request in ('pause', 'resume')").withColumn("n", F.row_number().over(Window.partitionBy("lock").orderBy(*order))).groupBy("lock").agg(F.max_by("request", "n").alias("r"))
    stopped = requests.groupBy("lock").agg(F.bool_or(F.col("request") == "stop").alias("stop"))
    return stopped.join(last, "lock", "left").select("lock", F.when(F.col("stop"), "stopping").when(F.col("r") == "pause", "paused").otherwise("active").alias("state"))


def poll_ticks(events: DataFrame, every: int, quiet: float) -> DataFrame:
    """events(repository_id, second): per repository, polls due each `every` seconds from its first event to its last, and those skipped as an event was less than `quiet` seconds before.

    Polls are counted by their numbers, without a row for each: an event skips those of a range of numbers, and of ranges in order each adds what lies behind the largest end so far.
    """
    span = events.groupBy("repository_id").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a is not null")
    span = span.select("repository_id", "a", F.floor((F.col("b") - F.col("a")) / every).alias("last"))
    after = F.col("second") - F.col("a")
    ranges = events.where("second is not null").join(span, "repository_id").select("repository_id", F.ceil(after / every).alias("x"), F.least(F.floor((after + int(quiet) - 1) / every), "last").alias("y"))
    ranges = ranges.where("x <= y").groupBy("repository_id", "x").agg(F.max("y").alias("y"))
    w = Window.partitionBy("repository_id").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    fresh = ranges.withColumn("seen", F.coalesce(F.max("y").over(w), F.lit(-1))).where("y > seen")
    skipped = fresh.groupBy("repository_id").agg(F.sum(F.col("y") - F.greatest("x", F.col("seen") + 1) + 1).alias("skipped"))
    return span.join(skipped, "repository_id", "left").select("repository_id", (F.col("last") + 1).alias("due"), F.coalesce("skipped", F.lit(0)).cast("long").alias("skipped"))


def graph_lines(symbols: DataFrame, references: DataFrame, facts: DataFrame) -> DataFrame:
    """The lines that a graph's hash is made of: repository_id, at (their order), line: symbols, then references by their ends' keys, then facts."""
    key = symbols.select("id", F.col("stable_key").alias("key"))
    s = symbols.select("repository_id", F.concat(F.lit("s:"), "stable_key", F.lit(":"), "content_hash").alias("line"), F.lit(0).alias("part"))
    ends = references.join(key.withColumnsRenamed({"id": "source", "key": "a"}), "source").join(key.withColumnsRenamed({"id": "target", "key": "b"}), "target")
    r = ends.select("repository_id", F.concat_ws(":", F.lit("r"), "a", "b", "kind", "evidence").alias("line"), F.lit(1).alias("part"))
    f = facts.select("repository_id", F.concat_ws(":", F.lit("f"), "enricher", "stable_key", "hash").alias("line"), F.lit(2).alias("part"))
    return s.union(r).union(f)


def graph_hash(symbols: DataFrame, references: DataFrame, facts: DataFrame) -> DataFrame:
    return chunked_hash(graph_lines(symbols, references, facts), "repository_id", ["part", "line"], F.col("line"))


def full_diff(before: DataFrame, after: DataFrame, header: str) -> DataFrame:
    """Snapshots (owner_type, owner_key, resource_type, resource_id, hash) as a diff: raw facts are left out, another resource id is an update too, and a repository row leads if anything changed."""
    on = ["owner_type", "owner_key", "resource_type"]
    side = lambda df, p: df.where("owner_type <> 'fact' or resource_type <> 'fact'").select(*on, F.col("hash").alias(f"{p}_hash"), F.col("resource_id").alias(f"{p}_id"), F.lit(True).alias(f"{p}_in"))
    j = side(before, "before").join(side(after, "after"), on, "full_outer")
    same = F.col("before_hash").eqNullSafe(F.col("after_hash")) & F.col("before_id").eqNullSafe(F.col("after_id"))
    kind = F.when(F.col("before_in").isNull(), "added").when(F.col("after_in").isNull(), "deleted").when(~same, "updated")
    rows = j.select(*on, "before_hash", "after_hash", F.coalesce("after_id", "before_id").alias("resource_id"), kind.alias("change_type")).where("change_type is not null")
    lead = rows.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("repository").alias("owner_type"), F.lit(header).alias("owner_key"), F.lit("repository").alias("resource_type"), F.lit(None).cast("string").alias("before_hash"), F.lit(None).cast("string").alias("after_hash"), F.lit(None).cast("long").alias("resource_id"), F.lit("updated").alias("change_type"))
    return lead.union(rows.select(lead.columns))


def repository_summary(files: DataFrame, symbols: DataFrame, references: DataFrame, runs: DataFrame) -> DataFrame:
    """repository_id with the numbers of its files, symbols and references, and its latest run and that one's status."""
    n = lambda df, name: df.groupBy("repository_id").agg(F.count("*").alias(name))
    last = runs.groupBy("repository_id").agg(F.max_by(F.struct("run_id", "status"), "run_id").alias("r")).select("repository_id", "r.run_id", "r.status")
    j = n(files, "files").join(n(symbols, "symbols"), "repository_id", "full_outer").join(n(references, "references"), "repository_id", "full_outer").join(last, "repository_id", "full_outer")
    return j.select("repository_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "symbols", "references")], "run_id", "status")


def fact_summaries(facts: DataFrame) -> DataFrame:
    """facts(path, type, tags) that no view shows on their own -> one for each (path, type): n, label, tags (all, sorted)."""
    flat = facts.select("path", "type", F.explode_outer("tags").alias("tag"))
    tags = flat.groupBy("path", "type").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    n = facts.groupBy("path", "type").agg(F.count("*").alias("n"))
    return n.join(tags, ["path", "type"]).select("path", "type", "n", F.concat_ws(" ", F.col("n").cast("string"), "type", F.when(F.col("n") == 1, "fact").otherwise("facts")).alias("label"), "tags")
