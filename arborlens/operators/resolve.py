"""Joins that resolve things: intervals, patterns, prefixes, identities, entities, vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions.text import glob_regex
from arborlens.operators import relational
from arborlens.operators.graph import stored

#: Fixed value: links of one component at most.
MOST_LINKS = 12


def _innermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, line, kind 0: a start, 1: a point, end, name) by file, block, line, kind and name from the largest -> file, line, name, start of each point that something holds.

    A start hides those before it that do not end after it, so what is open is kept with falling ends, and the last of it that has not ended is the innermost.
    """
    place, held, last = None, [], None
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("file", "block", "line", "kind", "end", "name")), strict=True)
        at, names, starts = [], [], []
        for k, (file, block, line, kind, end, name) in enumerate(rows):
            if (file, block) != place:
                place, held, last = (file, block), [], None
            if kind == 0:
                while held and held[-1][0] <= end:
                    held.pop()
                held.append((end, name, line))
            elif line != last:
                last = line
                while held and held[-1][0] < line:
                    held.pop()
                if held:
                    at.append(k)
                    names.append(held[-1][1])
                    starts.append(held[-1][2])
        if at:
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([taken.column("file"), taken.column("line"), pa.array(names, batch.schema.field("name").type), pa.array(starts, pa.int64())], ["file", "line", "name", "start"])


def enclosing(points: DataFrame, intervals: DataFrame, block: int = 4096) -> DataFrame:
    """points(file, line) x intervals(file, name, start, end or null): the innermost (largest start, then smallest name) that holds the line.

    Starts and points of a block of a file's lines pass by in order, so an interval meets no point. Closed intervals are dealt to all blocks they reach into. Open ones hold every later
    line, so of them only the last of the blocks before goes on to a block.
    """
    number = lambda c: F.floor(F.col(c) / block).alias("block")
    row = lambda df, kind, end: df.select("file", "block", F.col("line").cast("long").alias("line"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), "name")
    known = intervals.where("file IS NOT NULL AND start IS NOT NULL").withColumnRenamed("start", "line")
    closed = known.where("line <= end").withColumn("block", F.explode(F.sequence(F.floor(F.col("line") / block), F.floor(F.col("end") / block))))
    opened = known.where("end IS NULL").groupBy("file", number("line"), "line").agg(F.min_by("name", F.struct("name")).alias("name"))
    asked = points.where("file IS NOT NULL AND line IS NOT NULL").select("file", number("line"), "line", F.lit(None).cast(intervals.schema["name"].dataType).alias("name"))
    # A row for each block of a file: the last open start in it, and from that what comes before a block.
    last = opened.groupBy("file", "block").agg(F.max_by(F.struct("line", "name"), "line").alias("o"))
    blocks = last.unionByName(asked.select("file", "block").distinct().withColumn("o", F.lit(None).cast(last.schema["o"].dataType))).groupBy("file", "block").agg(F.max_by("o", "o").alias("o"))
    before = F.last("o", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.withColumn("o", before).where("o IS NOT NULL").select("file", "block", "o.line", "o.name")
    forever = F.lit((1 << 63) - 1)
    every = row(closed, 0, F.col("end")).unionByName(row(opened, 0, forever)).unionByName(row(carried, 0, forever)).unionByName(row(asked, 1, F.lit(None)))
    dealt = every.repartition("file", "block").sortWithinPartitions("file", "block", "line", "kind", F.col("name").desc_nulls_last())
    types = {f.name: f.dataType.simpleString() for f in every.schema}
    found = dealt.mapInArrow(_innermost, f"file {types['file']}, line long, name {types['name']}, start long")
    return found.select("file", F.col("line").cast(points.schema["line"].dataType).alias("line"), "name", F.col("start").cast(intervals.schema["start"].dataType).alias("start"))


def prefix_lookup(paths: DataFrame, policies: DataFrame) -> DataFrame:
    """paths(path), policies(prefix, action, tier): the nearest prefix's action and the largest tier among all."""
    parts = F.split("path", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix"))))
    j = paths.withColumn("u", up).select("path", "u.depth", "u.prefix").join(policies, "prefix")
    return j.groupBy("path").agg(F.max_by("action", "depth").alias("action"), F.max("tier").alias("tier"))


def ignored(paths: DataFrame, implicit: list[str], patterns: list[str]) -> DataFrame:
    """Ignore rules of a short list, as one expression, for streams (rules.ignored takes a table): implicit ones cannot be negated; of the others the last match decides, ! negates."""
    test = lambda p: F.col("path").rlike(f"^(?:.*/)?{glob_regex(p.strip('/'))[1:-1]}(?:/.*)?$" if "/" not in p.rstrip("/") else f"^{glob_regex(p.strip('/'))[1:-1]}(?:/.*)?$")
    out = F.lit(False)
    for p in patterns:
        out = F.when(test(p.removeprefix("!")), F.lit(not p.startswith("!"))).otherwise(out)
    for p in implicit:
        out = F.when(test(p), F.lit(True)).otherwise(out)
    return paths.withColumn("ignored", out)


def linked_entities(components: DataFrame, targets: DataFrame, least: float = 0.72) -> DataFrame:
    """Score components(key, repo, name, tokens) against targets(id, repo, name, tokens) without evidence (architecture.bindings has it all).

    .04 same repository, .42 same name, .30 a shared token, .16 two or more; best 12 of `least` and above;
    none when the best two are within .02. Without the name a pair has .50 at most, so above that the name is the join key.
    Components that are alike but for their key are scored once, and so are targets that are alike but for their id, of which the smallest 12 ids can be among the best.
    """
    if least <= 0.5:
        raise ValueError("pairs without an equal name are not looked at: least must be above 0.5")
    alike, of_key = relational.alike(components.where("name is not null"), "key", "class")
    t, of_id = relational.alike(targets.select(*[F.col(c).alias(f"t_{c}") for c in targets.columns]).where("t_name is not null"), "t_id", "t_class")
    block = alike.join(t, F.lower("name") == F.lower("t_name"))
    shared = F.size(F.array_intersect("tokens", "t_tokens"))
    score = F.when(F.col("repo") == F.col("t_repo"), 0.04).otherwise(0.0) + 0.42 + F.when(shared >= 1, 0.30).otherwise(0.0) + F.when(shared >= 2, 0.16).otherwise(0.0)
    pairs = block.select("class", "t_class", F.round(F.least(score, F.lit(1.0)), 6).alias("score")).where(F.col("score") >= least)
    rows = pairs.join(relational.smallest(of_id, "t_class", "t_id", MOST_LINKS), "t_class").select("class", F.col("t_id").alias("id"), "score")
    w = Window.partitionBy("class").orderBy(F.col("score").desc(), "id")
    rows = rows.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    unsure = F.max(F.when((F.col("rank") == 1) & (F.col("score") - F.col("next") <= 0.02), 1)).over(Window.partitionBy("class"))
    best = rows.withColumn("unsure", unsure).where((F.col("rank") <= MOST_LINKS) & F.col("unsure").isNull())
    return best.join(of_key, "class").select("key", "id", "score", F.col("rank").cast("long").alias("rank"))


def in_scope(active: Column, repo: Column, remote: Column, path: Column, root: str) -> Column:
    """Whether an element belongs to a repository: any where no scope is active; by its remote if known; else by its path below the root."""
    return F.when(~active, True).when(repo.isNotNull() & (remote != ""), repo == remote).otherwise((path == root) | path.startswith(root.rstrip("/") + "/"))


def stale(known: DataFrame, now: DataFrame, changes: DataFrame) -> DataFrame:
    """known(key, seen), now(key), changes(key, changed) -> key, state: symbols that are gone, and those whose file is newer than what was seen."""
    j = known.join(now.select("key", F.lit(1).alias("here")), "key", "left").join(changes, "key", "left")
    return j.select("key", F.when(F.col("here").isNull(), "vanished").when(F.col("changed") > F.col("seen"), "outdated").alias("state")).where("state is not null")


def catalog_search(catalog: DataFrame, text: Column, term: str, order: str, limit: int = 12) -> DataFrame:
    """Rows whose text matches a regular expression, any case; the plain words where it is none."""
    import re

    try:
        re.compile(term)
        hit = text.rlike(f"(?i){term}")
    except re.error:
        hit = F.contains(F.lower(text), F.lit(term.lower()))
    return catalog.where(hit).orderBy(order).limit(limit)


#: Words of labels that name no technology.
STOPWORDS = ["and", "for", "the", "with", "app", "api", "service", "server", "client", "database", "cluster", "system", "platform", "engine"]


def catalog_matches(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """labels(id, label), catalog(alias, lower case) -> id, alias: the whole label; else, part by part (cut at , / ; |), the part or the first of its tokens that is known."""
    tokens = lambda p: F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(F.replace(p, F.lit("+"), F.lit("plus")), r"(\p{Ll})(\p{Lu})", "$1 $2"), r"[^\p{L}\p{N}#]+", " ")), " "), lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))
    forms = lambda p: F.concat(F.array(F.lower(F.trim(p))), tokens(p))
    parts = F.filter(F.split("label", "[,/;|]"), lambda p: F.trim(p) != "")
    every = F.concat(F.array(F.lower(F.trim("label"))), F.flatten(F.transform(parts, forms)))
    each = labels.select("id", F.posexplode(every).alias("at", "alias"))
    return each.join(catalog.select("alias").distinct(), "alias").groupBy("id").agg(F.min_by("alias", "at").alias("alias"))


def with_both_ends(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with the columns of their two symbols, as source_... and target_...."""
    side = lambda p: symbols.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in symbols.columns if c != "id"])
    return references.join(side("source"), "source").join(side("target"), "target")


def owner_keys(symbols: DataFrame, identities: DataFrame) -> DataFrame:
    """The key that outlives a rename where a symbol has one, else its stable key."""
    return symbols.join(identities, "id", "left").withColumn("owner_key", F.coalesce("identity_key", "stable_key"))


def _around(points: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """points(file, line) -> file, line, and the innermost symbol there."""
    found = enclosing(points.select("file", "line").distinct(), symbols.select("file", F.col("id").alias("name"), F.col("start_line").alias("start"), F.col("end_line").alias("end")))
    return found.select("file", "line", F.col("name").alias(name))


def resolved_calls(calls: DataFrame, symbols: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """calls(id, file, name, line, anywhere, kind where given), symbols(id, file, name, start_line, end_line), definitions(id of the call, place, file, line) -> id, source_id, target_id.

    The target is the innermost symbol at the first of the call's definitions that has one; else it has the one name of its kind among all
    symbols and stands in the same file, or the call's language allows any. The source is the innermost symbol around the call. Calls to the own
    symbol are none, and only references of kind call (or none) are calls.
    """
    if "kind" in calls.columns:
        calls = calls.where("coalesce(kind, '') IN ('', 'call')")
    only = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("only_id"), F.min("file").alias("only_file")).where("n = 1").drop("n")
    named = F.when(F.col("anywhere") | (F.col("file") == F.col("only_file")), F.col("only_id"))
    if definitions is None:
        hit = calls.join(only, "name").withColumn("target_id", named).where("target_id IS NOT NULL").select("id", "file", "line", "target_id")
        around = _around(hit, symbols, "source_id")
    else:
        # Symbols pass by once, for definitions and calls alike.
        calls = stored(calls.select("id", "file", "name", "line", "anywhere"))[0].hint("merge")
        around = stored(_around(calls.select("file", "line").unionByName(definitions.select("file", "line")), symbols, "source_id"))[0].hint("merge")
        at = definitions.join(around.withColumnRenamed("source_id", "target_id"), ["file", "line"]).groupBy("id").agg(F.min_by("target_id", "place").alias("target_id"))
        hit = calls.join(at, "id", "left").join(only, "name", "left").withColumn("target_id", F.coalesce("target_id", named)).where("target_id IS NOT NULL").select("id", "file", "line", "target_id")
    return hit.join(around, ["file", "line"]).where("source_id <> target_id").select("id", "source_id", "target_id")


def identified(symbols: DataFrame, identities: DataFrame) -> DataFrame:
    """The first step of matching: an identity whose current key a symbol has is that symbol's; others stay open for identity.candidates. key, identity."""
    return symbols.join(identities.select(F.col("current_key").alias("key"), "identity"), "key").select("key", "identity")
