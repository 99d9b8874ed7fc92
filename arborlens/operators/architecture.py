"""Architecture from facts: components and edges, merges, endpoints, bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions.naming import ROLE_WORDS, architecture_slug, component_of_path, dependency_family, endpoint_name, name_tokens, service_root
from arborlens.operators.graph import checkpointed
from arborlens.operators.graph import components as connected
from arborlens.operators.relational import alike, smallest


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def dependency_label(target: Column) -> Column:
    return F.when(F.contains(target, F.lit("redis")), "redis").when(target.rlike("otel|opentelemetry"), "observes").otherwise("uses")


def kind_key(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.isin("datastore", "queue", "external", "contract"), low).when(low == "interface", "contract").otherwise("component")


def model_of_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts(id, type, path, name, source, target, kind, technology, label, relationship, confidence) -> components, edges.

    A file's source component is the attribute `source`, else its innermost folder that is no layout. Components: key,
    name, kind, technology (first in fact order), evidence (their number). Edges: key, source_key, target_key, label,
    relationship, confidence (largest), evidence. Ends are names of hosts; an edge of one end with itself or without a name is none.
    """
    f = facts.withColumn("owner", first_filled(F.col("source"), component_of_path(F.col("path"))))
    own = f.where("owner is not null").select("id", F.concat(F.lit("component:"), architecture_slug(F.col("owner"))).alias("key"), F.col("owner").alias("name"), F.lit("service").alias("kind"), F.lit(None).cast("string").alias("technology"))
    named = first_filled(F.col("name"), F.col("target"))
    kind = F.when(F.col("type") == "runtime.component", first_filled(F.col("kind"), F.lit("service"))).when(F.col("type") == "grpc.server", "service").when(F.col("type") == "grpc.contract", "interface").when(F.col("type") == "datastore.dependency", "datastore").when(F.col("type") == "external.dependency", "external")
    technology = F.when(F.col("type").startswith("grpc."), "gRPC").otherwise(first_filled(F.col("technology"), F.when(F.col("type") == "runtime.component", "Runtime").otherwise("External")))
    told = f.withColumn("k", kind).withColumn("n", named).where("k is not null and n is not null")
    told = told.select("id", F.concat(kind_key(F.col("k")), F.lit(":"), architecture_slug(F.col("n"))).alias("key"), F.col("n").alias("name"), F.col("k").alias("kind"), technology.alias("technology"))
    linked = F.col("type").isin("runtime.connection", "runtime.endpoint_ref", "grpc.client", "http.client", "datastore.dependency", "external.dependency")
    to = F.when(F.col("type") == "http.client", first_filled(F.col("target"), F.lit("external traffic"))).when(F.col("type").isin("runtime.connection", "runtime.endpoint_ref"), F.col("target")).otherwise(named)
    label = F.when(F.col("type") == "runtime.connection", first_filled(F.col("label"), F.lit("uses"))).when(F.col("type") == "grpc.client", "grpc").when(F.col("type") == "http.client", "http").when(F.col("type") == "runtime.endpoint_ref", "uses").otherwise(dependency_label(to))
    relationship = F.when(F.col("type") == "runtime.connection", first_filled(F.col("relationship"), F.lit("runtime-dependency"))).otherwise("runtime-dependency")
    e = f.where(linked).select("id", endpoint_name(F.col("owner")).alias("s"), endpoint_name(to).alias("t"), label.alias("label"), relationship.alias("relationship"), "confidence").where("s is not null and t is not null and s <> t")
    e = e.withColumn("source_key", F.concat(F.lit("component:"), F.col("s"))).withColumn("target_key", F.concat(F.lit("component:"), F.col("t")))
    edges = e.groupBy("source_key", "target_key", "relationship", "label").agg(F.max("confidence").alias("confidence"), F.count("*").alias("evidence"))
    edges = edges.withColumn("key", F.concat("source_key", F.lit("->"), "target_key", F.lit(":"), "relationship", F.lit(":"), "label"))
    ends = e.select("id", F.explode(F.array(F.struct(F.col("source_key").alias("key"), F.col("s").alias("name")), F.struct(F.col("target_key").alias("key"), F.col("t").alias("name")))).alias("c")).select("id", "c.key", "c.name", F.lit("service").alias("kind"), F.lit(None).cast("string").alias("technology"))
    every = own.withColumn("at", F.lit(0)).union(told.withColumn("at", F.lit(1))).union(ends.withColumn("at", F.lit(2)))
    first = F.struct("id", "at")
    found = every.groupBy("key").agg(F.min_by("name", first).alias("name"), F.min_by("kind", first).alias("kind"), F.min_by("technology", F.when(F.col("technology").isNotNull(), first)).alias("technology"), F.count("*").alias("evidence"))
    return found, edges


def union_models(components: DataFrame) -> DataFrame:
    """Several models of components(model, key, technology, description, path, tags, evidence) as one: first filled scalars in model order, tags united, evidence added."""
    first = lambda c: F.min_by(c, F.when(F.trim(c) != "", F.col("model"))).alias(c)
    return components.groupBy("key").agg(first("technology"), first("description"), first("path"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.sum("evidence").alias("evidence"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """edges(key, source, target, label, relationship, direction, confidence) -> one for each unordered pair.

    The smallest key gives the ends; others are turned round where they run the other way. Directions
    add up (both, forward, backward, none); a merged label is blank, a relationship blank if they differ.
    """
    pair = edges.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target")).where("a <> b")
    # Bits seen from a to b: 1 forward, 2 backward.
    bits = F.when(F.col("direction") == "both", 3).when(F.col("direction") == "none", 0).when((F.col("direction") == "backward") != (F.col("source") > F.col("target")), 2).otherwise(1)
    g = pair.withColumn("bits", bits).groupBy("a", "b").agg(
        F.min_by(F.struct("source", "target"), "key").alias("e"), F.min_by("label", "key").alias("label"), F.min("relationship").alias("r0"), F.max("relationship").alias("r1"),
        F.bit_or("bits").alias("bits"), F.max("confidence").alias("confidence"), F.count("*").alias("evidence"))
    turned = F.col("e.source") != F.col("a")
    way = F.when(F.col("bits") == 3, "both").when(F.col("bits") == 0, "none").when((F.col("bits") == 2) != turned, "backward").otherwise("forward")
    return g.select(F.col("e.source").alias("source"), F.col("e.target").alias("target"), F.when(F.col("evidence") == 1, F.col("label")).otherwise("").alias("label"), F.when(F.col("r0") == F.col("r1"), F.col("r0")).otherwise("").alias("relationship"), way.alias("direction"), "confidence", "evidence")


def merged_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence(key, ...) of edges as merged_edges() merges them: source and target of the merged edge, and each piece as a row of its own, so that an edge of any number of pieces is no single row."""
    pair = edges.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target")).where("a <> b")
    ends = pair.groupBy("a", "b").agg(F.min_by(F.struct("source", "target"), "key").alias("e"))
    kept = pair.select("key", "a", "b").join(ends, ["a", "b"]).select("key", F.col("e.source").alias("source"), F.col("e.target").alias("target"))
    return evidence.join(kept, "key").drop("key")


def pruned(components: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without loops and dangling edges, and without components that are left with none."""
    a = components.select(F.col("key").alias("source"))
    live = edges.where("source <> target").join(a, "source", "left_semi").join(a.withColumnRenamed("source", "target"), "target", "left_semi")
    degree = live.select(F.explode(F.array("source", "target")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    return components.join(degree, "key"), live


def endpoint_edges(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """definitions(ordinal, component, host), uses(component, host, protocol) -> source, target, label, confidence.

    A host is known by its name and by its first label; of several definitions the last holds.
    """
    host = F.lower(F.trim(F.regexp_replace(F.regexp_replace("host", r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[:/?#].*$", "")))
    d = definitions.withColumn("h", host)
    alias = d.select("ordinal", "component", F.explode(F.array_distinct(F.array("h", F.split_part("h", F.lit("."), F.lit(1))))).alias("h")).where("h <> ''")
    owner = alias.groupBy("h").agg(F.max_by("component", F.struct("ordinal", "component")).alias("target"))
    j = uses.withColumn("h", host).join(owner, "h").where("component <> target")
    return j.select(F.col("component").alias("source"), "target", first_filled(F.col("protocol"), F.lit("uses")).alias("label"), F.lit(0.78).alias("confidence")).distinct()


def runtime_edges(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """nodes(id, path, name), facts(type, path, source, target) -> type, source_id, target_id, label: ends found by normalised name in the fact's file."""
    norm = lambda c: F.lower(F.trim(c))
    n = nodes.groupBy("path", norm(F.col("name")).alias("n")).agg(F.min("id").alias("nid"))
    side = lambda p: n.select(F.col("path"), F.col("n").alias(f"{p}_n"), F.col("nid").alias(f"{p}_id"))
    f = facts.withColumn("source_n", norm(F.col("source"))).withColumn("target_n", norm(F.col("target")))
    j = f.join(side("source"), ["path", "source_n"]).join(side("target"), ["path", "target_n"]).where("source_id <> target_id")
    return j.select("type", "source_id", "target_id", F.when(F.col("type") == "runtime.volume", "mounts").when(F.col("type") == "runtime.endpoint", "exposes").otherwise("uses").alias("label")).distinct()


#: Kinds of evidence that make a service's name its own.
STRONG_EVIDENCE = ["deployable", "endpoint", "runtime-component", "source-service", "grpc.server", "grpc-client", "grpc.contract", "service-contract"]


def _key_rank(key: Column) -> Column:
    """Order in which keys stand for their set: components, stores and queues, externals, contracts, others; then the key."""
    kind = F.split_part(key, F.lit(":"), F.lit(1))
    return F.struct(F.when(kind == "component", 0).when(kind.isin("datastore", "queue"), 1).when(kind == "external", 2).when(kind == "contract", 3).otherwise(4).alias("r"), key.alias("key"))


def _alias_rank(name: Column, kind: Column, evidence: Column, root: Column) -> Column:
    """Which of the names of one service root is the service's own; smaller is better."""
    held = lambda e: F.array_contains(F.coalesce(evidence, F.array().cast("array<string>")), e)
    service, slugged = kind == "service", architecture_slug(name)
    return F.when(slugged == F.concat(F.coalesce(root, F.lit("")), F.lit("service")), 0).when(service & held("deployable"), 1).when(service & held("runtime-component"), 2).when(service & (slugged == F.coalesce(root, F.lit(""))), 3).when(kind == "interface", 4).otherwise(5)


def contracted(sets: DataFrame, links: DataFrame, order: DataFrame) -> DataFrame:
    """One phase: sets(key, rep), links(a, b) between reps, order(rep, rank: the smallest stands for the joined sets) -> sets with new reps.

    Only reps that a link names take part; the others keep their set. Edges of later phases are read through the new reps.
    """
    ids = lambda c: F.xxhash64(c)
    ends = checkpointed(links.where("a <> b").select("a", "b").distinct())
    named = checkpointed(ends.select(F.explode(F.array("a", "b")).alias("rep")).distinct().select("rep", ids("rep").alias("id")))
    if named.isEmpty():
        return sets
    label = connected(ends.select(ids("a").alias("a"), ids("b").alias("b")), named.select("id"))
    group = named.join(label, "id").join(order, "rep")
    best = group.groupBy("component").agg(F.min_by("rep", "rank").alias("new"))
    moved = group.join(best, "component").select("rep", "new")
    return checkpointed(sets.join(moved, "rep", "left").select("key", F.coalesce("new", "rep").alias("rep")))


def inferred_roots(services: DataFrame) -> DataFrame:
    """services(key, name) -> key, name, inferred, each key and name once: a known root of several words that spells the same without dashes, else the own root if it is known, long enough, or the name has a role word.

    Known are roots of several words, and those of names with a role word.
    """
    tokens = name_tokens(F.col("name"))
    s = services.select("key", "name").distinct().select("key", "name", service_root(F.col("name"), 1).alias("root"), F.exists(tokens, lambda t: t.isin(ROLE_WORDS)).alias("role")).where("root IS NOT NULL")
    s = s.withColumn("compact", F.replace("root", F.lit("-"), F.lit("")))
    known = s.where(F.contains("root", F.lit("-")) | F.col("role")).select("root", "compact").distinct()
    dashed = known.where(F.contains("root", F.lit("-"))).groupBy("compact").agg(F.min("root").alias("dashed"))
    one = s.join(dashed, "compact", "left").join(known.select("root", F.lit(True).alias("known")), "root", "left")
    return one.select("key", "name", "role", F.coalesce("dashed", F.when(F.col("known") | (F.length("root") >= 3) | F.col("role"), F.col("root"))).alias("inferred")).where("inferred IS NOT NULL")


def _service_links(sets: DataFrame, services: DataFrame, edges: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Links (a: the set of a root's best name, b: the set of another of its names), and the order in which sets stand for joined ones."""
    # Of rows of one key and rank, one with strong evidence comes first.
    place = F.struct(F.col("alias"), F.col("key"), ~F.col("strong"), ~F.col("role"))
    hub = services.groupBy(root).agg(F.min_by(F.struct("key", "strong", "role"), place).alias("hub"), F.min("alias").alias("alias"))
    pair = services.select("key", "strong", "role", root).join(hub, root).where(F.col("key") != F.col("hub.key"))
    joined = edges.select(F.col("source").alias("x"), F.col("target").alias("y")).union(edges.select("target", "source")).distinct().withColumn("joined", F.lit(True))
    pair = pair.join(joined, (F.col("hub.key") == F.col("x")) & (F.col("key") == F.col("y")), "left")
    strong = F.col("strong") & F.col("hub.strong")
    fits = F.when(F.length(root) < 3, strong & (F.col("role") | F.col("hub.role"))).otherwise(F.col("joined").isNotNull() | strong)
    kept = pair.where(fits).select(F.col("hub.key").alias("p"), "key", "alias")
    links = kept.join(sets.select(F.col("key").alias("p"), F.col("rep").alias("a")), "p").join(sets.select("key", F.col("rep").alias("b")), "key")
    # The set of a best name stands for what it takes in; of several, the best one's.
    parents = links.where("a <> b").groupBy(F.col("a").alias("rep")).agg(F.min(F.struct("alias", "p")).alias("as"))
    order = sets.select("rep").distinct().join(parents, "rep", "left").select("rep", F.struct(F.col("as").isNull().alias("child"), F.col("as.alias").alias("alias"), F.coalesce("as.p", "rep").alias("key")).alias("rank"))
    return checkpointed(links.select("a", "b")), checkpointed(order)


def canonical(components: DataFrame, edges: DataFrame) -> DataFrame:
    """components(key, name, kind, technology, tags, evidence: its kinds), edges(source, target) -> key, canonical: the component each one is.

    Four phases, each over the sets that the one before left: its links join sets, and edges are read through the sets' present names.
    1. Equal slugs join the smallest key of the slug; interfaces only if that is one, others only if it is none.
    2. Names of one service root (at least three characters) join its best name, where an edge joins the two or both have strong evidence.
    3. The same for inferred roots; roots of one or two characters need strong evidence on both sides and a role word.
    4. Of what one source uses of one family, the generic dependencies (named as the family) are the concrete one, if that is just one.
    In phases 1 and 4 the best kind and smallest key stand for a set, in 2 and 3 the set of the best name.
    """
    c = components.select("key", "name", "kind", "technology", "tags", "evidence", architecture_slug(F.col("name")).alias("slug"), (F.col("kind") == "interface").alias("interface"))
    # Rows that are equal are one, and a key of several rows is one set: rows of one key do not meet each other.
    c, edges = checkpointed(c.distinct()), checkpointed(edges.select("source", "target").distinct())
    by_rank = lambda sets: sets.select("rep").distinct().select("rep", _key_rank(F.col("rep")).alias("rank"))
    hub = c.groupBy("slug").agg(F.min("key").alias("a"), F.min_by("interface", "key").alias("of_interface"))
    same = c.join(hub, "slug").where("interface = of_interface").select("a", F.col("key").alias("b"))
    sets = checkpointed(c.select("key", F.col("key").alias("rep")).distinct())
    sets = contracted(sets, same, by_rank(sets))

    strong = F.exists(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: e.isin(STRONG_EVIDENCE))
    services = c.where(F.col("kind").isin("service", "interface")).withColumn("root", service_root(F.col("name")))
    services = services.select("key", "name", "root", strong.alias("strong"), _alias_rank(F.col("name"), F.col("kind"), F.col("evidence"), F.col("root")).alias("alias"))
    inferred = checkpointed(services.join(inferred_roots(services), ["key", "name"], "left").withColumn("role", F.coalesce("role", F.lit(False))))
    for root in ("root", "inferred"):
        links, order = _service_links(sets, inferred.where(F.col(root).isNotNull()), edges, root)
        sets = contracted(sets, links, order)

    family = dependency_family(F.col("kind"), F.col("name"), F.col("technology"), F.col("tags"))
    of = c.select(F.col("key").alias("t"), family.alias("family"), (F.col("slug") == family).alias("generic")).where("family <> ''")
    used = edges.join(sets.select(F.col("key").alias("source"), F.col("rep").alias("s")), "source").join(sets.select(F.col("key").alias("target"), F.col("rep").alias("t")), "target").select("s", "t").distinct().join(of, "t")
    one = used.where("NOT generic").groupBy("s", "family").agg(F.min("t").alias("a"), F.max("t").alias("last")).where("a = last").select("s", "family", "a")
    folded = used.where("generic").join(one, ["s", "family"]).select("a", F.col("t").alias("b"))
    sets = contracted(sets, folded, by_rank(sets)).select("key", F.col("rep").alias("canonical"))
    return components.select("key").join(sets, "key")


def repository_of(values: DataFrame, repositories: DataFrame) -> DataFrame:
    """values(value), repositories(id, root, remote) -> value, id: by root, by remote, then by owner/name, any case; smallest id."""
    def slugged(c):
        trimmed = F.regexp_replace(F.lower(F.trim(c)), r"(\.git)?/*$", "")
        return F.when(trimmed.rlike(r"[/:][^/:]+/[^/]+$"), F.regexp_extract(trimmed, r"([^/:]+/[^/]+)$", 1))

    forms = lambda c: F.array_compact(F.array(F.concat(F.lit("="), F.lower(F.trim(c))), F.concat(F.lit("~"), slugged(c))))
    r = repositories.select("id", F.explode(F.array_union(forms(F.col("root")), F.coalesce(forms(F.col("remote")), F.array().cast("array<string>")))).alias("form"))
    v = values.select("value").distinct().select("value", F.explode(forms(F.col("value"))).alias("form"))
    return v.join(r, "form").groupBy("value").agg(F.min("id").alias("id"))


#: What each kind of evidence adds to a binding.
EVIDENCE = {"repository": 0.04, "name": 0.42, "path": 0.30, "overlap": 0.16, "evidence_path": 0.78, "under": 0.66, "directory": 0.30, "symbol": 0.18, "fact": 0.20, "summary": -0.08}


def bindings(components: DataFrame, targets: DataFrame, least: float = 0.72, most: int = 12, gap: float = 0.02) -> DataFrame:
    """Score components(key, repo, name, tokens, paths) against targets(id, repo, type, name, tokens, path).

    A pair needs an equal name, an evidence path or its folder, or the name in the path, to be worth a score (without them it has .50 at most); candidates are
    blocked by each of these, so nothing is compared with all. Per component: those of `least` and more, at most
    `most`; none where the best two are within `gap` and neither has an evidence path.
    """
    # What is alike but for its key is scored once; of alike targets the smallest ids alone can be among the best.
    components, of_key = alike(components, "key", "class")
    t, of_id = alike(targets.select(*[F.col(c).alias(f"t_{c}") for c in targets.columns]), "t_id", "t_class")
    folder = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    parts = lambda p: F.filter(F.split(F.lower(p), "[/._-]"), lambda x: x != "")
    ups = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda k: F.array_join(F.slice(F.split(p, "/"), F.lit(1), k), "/"))
    c_keys = F.array_distinct(F.flatten(F.array(F.array(F.concat(F.lit("n:"), F.lower("name")), F.concat(F.lit("s:"), F.lower("name"))), F.flatten(F.transform("paths", lambda p: F.concat(F.array(F.concat(F.lit("p:"), p)), F.transform(ups(p), lambda u: F.concat(F.lit("u:"), u))))))))
    t_keys = F.array_distinct(F.flatten(F.array(F.array(F.concat(F.lit("n:"), F.lower("t_name")), F.concat(F.lit("p:"), F.col("t_path"))), F.when(F.col("t_type") == "folder", F.array(F.concat(F.lit("u:"), F.col("t_path")))).otherwise(F.array().cast("array<string>")), F.transform(parts(F.col("t_path")), lambda x: F.concat(F.lit("s:"), x)))))
    a = components.select("class", F.explode(c_keys).alias("block"))
    b = t.select("t_class", F.explode(t_keys).alias("block"))
    pairs = a.join(b, "block").select("class", "t_class").distinct().join(components, "class").join(t, "t_class")
    at = lambda f: F.exists("paths", f)
    on_path, under, beside = at(lambda p: p == F.col("t_path")), at(lambda p: p.startswith(F.concat(F.col("t_path"), F.lit("/")))), at(lambda p: folder(p) == folder(F.col("t_path")))
    same = F.lower("name") == F.lower("t_name")
    tests = [("repository", F.col("repo") == F.col("t_repo")), ("name", same), ("path", F.array_contains(parts(F.col("t_path")), F.lower("name"))), ("overlap", F.size(F.array_intersect("tokens", "t_tokens")) >= 2),
             ("evidence_path", on_path), ("under", ~on_path & (F.col("t_type") == "folder") & under), ("directory", ~on_path & ~((F.col("t_type") == "folder") & under) & beside),
             ("symbol", (F.col("t_type") == "symbol") & same), ("fact", (F.col("t_type") == "fact") & same), ("summary", F.col("t_type") == "fact-summary")]
    score = sum((F.when(test, EVIDENCE[kind]).otherwise(0.0) for kind, test in tests), F.lit(0.0))
    rows = pairs.select("class", "t_class", F.round(F.least(score, F.lit(1.0)), 6).alias("score"), (on_path | ((F.col("t_type") == "folder") & under)).alias("concrete")).where(F.col("score") >= least)
    rows = rows.join(smallest(of_id, "t_class", "t_id", max(most, 2)), "t_class").select("class", F.col("t_id").alias("id"), "score", "concrete")
    w = Window.partitionBy("class").orderBy(F.col("score").desc(), "id")
    rows = rows.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("next", F.lead("score").over(w)).withColumn("next_concrete", F.lead("concrete").over(w))
    unsure = rows.where((F.col("rank") == 1) & (F.round(F.col("score") - F.col("next"), 6) <= gap) & ~F.col("concrete") & ~F.col("next_concrete")).select("class")
    return rows.where(F.col("rank") <= most).join(unsure, "class", "left_anti").join(of_key, "class").select("key", "id", "score", "rank")
