"""All queries of the graph engine by name, and the SQL they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlens.functions import enrich, specs, text
from arborlens.operators import ancestry, crossview, density, diff, graph, identity, lint, relational, resolve, vectors, versionlog, versions
from arborlens.operators import rules as rules_
from arborlens.plans import projection as P
from arborlens.streaming import changes, liveness

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(oracle: str | None = None, more: str = "", recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = P.sql(oracle, more, recursive)
        return f

    return add


def _signals(s: SparkSession, d: str) -> DataFrame:
    return density.signals(P.decisions(s, d), P.links(s, d))


SIGNALS = "sig AS (SELECT coalesce(a.element_id, b.element_id) AS element_id, filter_score, tier, confidence FROM (SELECT element_id, max(score) AS filter_score, min(tier) AS tier FROM decisions GROUP BY 1) a FULL JOIN (SELECT element_id, max(confidence) AS confidence FROM links GROUP BY 1) b ON a.element_id = b.element_id)"
SCORED = SIGNALS + """,
deg AS (SELECT view_id, e AS element_id, count(*) AS degree FROM (SELECT view_id, source_element_id AS e FROM connectors UNION ALL SELECT view_id, target_element_id FROM connectors) GROUP BY ALL),
scored AS (
  SELECT p.view_id, p.element_id, e.name, coalesce(o.delta, 0) AS delta,
    round(12 * coalesce(degree, 0) + 30 * coalesce(filter_score, 0.0::DOUBLE) + CASE WHEN tier IS NOT NULL THEN 5 * greatest(0, 10 - tier) ELSE 0 END + 20 * coalesce(confidence, 0.0::DOUBLE)
      + CASE WHEN p.element_id IN (SELECT owner_element_id FROM views WHERE owner_element_id IS NOT NULL) THEN 20 ELSE 0 END + CASE WHEN description IS NOT NULL THEN 4 ELSE 0 END
      - 0.001::DOUBLE * ln(1 + p.element_id::DOUBLE) + 100 * coalesce(o.delta, 0), 6) AS score
  FROM placements p JOIN elements e ON e.id = p.element_id LEFT JOIN deg USING (view_id, element_id) LEFT JOIN sig ON sig.element_id = p.element_id LEFT JOIN overrides o ON o.view_id = p.view_id AND o.element_id = p.element_id)"""


def _content(s, d, level):
    return density.view_elements(P.placements(s, d), P.elements(s, d), P.views(s, d), P.connectors(s, d), _signals(s, d), P.overrides(s, d), level)


@query("SELECT view_id, element_id, name, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY score DESC, element_id) AS rank FROM scored WHERE delta > -4) WHERE rank <= 8 OR delta > 0", SCORED)
def view_content_projected(s, d):
    return _content(s, d, -1)


@query("SELECT view_id, element_id, name, score, row_number() OVER (PARTITION BY view_id ORDER BY score DESC, element_id) AS rank FROM scored WHERE delta >= 0", SCORED)
def view_content_full(s, d):
    return _content(s, d, 2)


CONNECTOR_TERMS = """,
cg AS (SELECT id, CASE WHEN id % 4 = 0 THEN (id % 50) / 50.0::DOUBLE END AS filter_score, CASE WHEN id % 4 = 0 THEN (id % 12)::INT END AS tier, CASE WHEN id % 6 = 0 THEN (id % 30) / 30.0::DOUBLE END AS confidence FROM connectors),
cv AS (SELECT view_id, id, (id % 9 - 4)::INT AS delta FROM connectors WHERE id % 7 = 0)"""


@query("""SELECT view_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY score DESC, id) AS rank FROM (
  SELECT c.view_id, c.id, coalesce(cv.delta, 0) AS delta, round(30 * coalesce(filter_score, 0.0::DOUBLE) + coalesce(cg.tier, 0) + 20 * coalesce(confidence, 0.0::DOUBLE) + CASE WHEN relationship IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN label IS NOT NULL THEN 6 ELSE 0 END
    + CASE WHEN c.id % 5 = 0 THEN 3 ELSE 0 END - 0.001::DOUBLE * ln(1 + c.id::DOUBLE) + 100 * coalesce(cv.delta, 0), 6) AS score
  FROM connectors c LEFT JOIN cg ON cg.id = c.id LEFT JOIN cv ON cv.view_id = c.view_id AND cv.id = c.id SEMI JOIN scored a ON a.view_id = c.view_id AND a.element_id = c.source_element_id AND a.delta >= 0 SEMI JOIN scored b ON b.view_id = c.view_id AND b.element_id = c.target_element_id AND b.delta >= 0) WHERE delta > -4) WHERE rank <= 24 OR delta > 0""", SCORED + CONNECTOR_TERMS)
def connector_projection(s, d):
    k = F.col("id")
    c = P.connectors(s, d).withColumn("description", F.when(k % 5 == 0, "told"))
    signal = c.select(k, F.when(k % 4 == 0, (k % 50) / 50.0).alias("filter_score"), F.when(k % 4 == 0, k % 12).cast("int").alias("tier"), F.when(k % 6 == 0, (k % 30) / 30.0).alias("confidence"))
    overrides = c.where(k % 7 == 0).select("view_id", k, (k % 9 - 4).cast("int").alias("delta"))
    return density.view_connectors(c, _content(s, d, 2), 0, signal, overrides)


TERMS = """,
pl AS (SELECT view_id, element_id, element_id * 3 + view_id AS placement_id FROM placements),
worth AS (SELECT s.view_id, s.element_id, s.name, s.delta, round(s.score + 0.001::DOUBLE * ln(1 + s.element_id::DOUBLE) - 0.001::DOUBLE * ln(1 + placement_id::DOUBLE) + CASE WHEN s.element_id % 4 = 0 THEN 3 ELSE 0 END + CASE WHEN s.element_id % 6 = 0 THEN 2 ELSE 0 END, 5) AS score FROM scored s JOIN pl USING (view_id, element_id))"""


@query("SELECT view_id, element_id, name, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY score DESC, element_id) AS rank FROM worth WHERE delta > -4) WHERE rank <= 12 OR delta > 0", SCORED + TERMS)
def view_content_terms(s, d):
    """Placements with ids of their own, elements with tags and files."""
    e = P.elements(s, d).withColumns({"tags": F.when(F.col("id") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), "file_path": F.when(F.col("id") % 6 == 0, "a.go").otherwise(" ")})
    p = P.placements(s, d).withColumn("placement_id", F.col("element_id") * 3 + F.col("view_id"))
    return density.view_elements(p, e, P.views(s, d), P.connectors(s, d), _signals(s, d), P.overrides(s, d), 0, digits=5)


@query("""SELECT view_id, id FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY score DESC, id) AS rank FROM (SELECT c.view_id, c.id, c.score, c.delta FROM ca c LEFT JOIN (SELECT view_id, element_id FROM sh) x ON x.view_id = c.view_id AND x.element_id = c.s LEFT JOIN br f ON f.view_id = c.view_id AND f.e = c.s
  LEFT JOIN (SELECT view_id, element_id FROM sh) y ON y.view_id = c.view_id AND y.element_id = c.t LEFT JOIN br g ON g.view_id = c.view_id AND g.e = c.t
  WHERE c.delta > 0 OR ((x.element_id IS NOT NULL OR f.first > c.score) AND (y.element_id IS NOT NULL OR g.first > c.score)))) WHERE rank <= 24 OR delta > 0""", SCORED + """,
sh AS (SELECT view_id, element_id FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY score DESC, element_id) AS rank FROM scored WHERE delta > -4) WHERE rank <= 8 OR delta > 0),
ca AS (SELECT view_id, id, source_element_id AS s, target_element_id AS t, id::DOUBLE AS score, CASE WHEN id % 53 = 0 THEN 1 ELSE 0 END AS delta FROM connectors),
br AS (SELECT view_id, e, max(score) AS first FROM (SELECT view_id, s AS e, score FROM ca WHERE delta > 0 UNION ALL SELECT view_id, t, score FROM ca WHERE delta > 0) GROUP BY 1, 2)""")
def connector_admission(s, d):
    c = P.connectors(s, d).withColumn("score", F.col("id").cast("double")).withColumn("delta", F.when(F.col("id") % 53 == 0, 1).otherwise(0))
    return density.admitted(c, _content(s, d, -1), 24)


@query("""SELECT e.id, kind, e.name, v.owner_element_id IS NOT NULL AS has_view, v.view_label, (SELECT count(*) FROM elements WHERE contains(lower(name), '1')) AS total
FROM (SELECT * FROM elements WHERE contains(lower(name), '1') ORDER BY id DESC LIMIT 20 OFFSET 2) e LEFT JOIN (SELECT owner_element_id, min_by(name, id) AS view_label FROM views WHERE owner_element_id IS NOT NULL GROUP BY 1) v ON v.owner_element_id = e.id""")
def element_search_page(s, d):
    return relational.element_search(P.elements(s, d), P.views(s, d), " 1 ", 2, 20)


@query("SELECT id, name FROM views WHERE contains(lower(name), 'a') ORDER BY id LIMIT 10 OFFSET 3")
def view_listing(s, d):
    return relational.page(P.views(s, d).where(F.lower("name").contains("a")).select("id", "name"), ["id"], 3, 10)


@query("SELECT id, kind, name FROM elements WHERE kind = 'customer' AND name ILIKE '%1%' ORDER BY name, id LIMIT 100")
def symbol_query(s, d):
    return relational.page(P.elements(s, d).where((F.col("kind") == "customer") & F.col("name").ilike("%1%")).select("id", "kind", "name"), ["name", "id"], 0, 0)


@query("SELECT id, source_element_id, target_element_id, line FROM connectors WHERE source_element_id = 4000007 OR target_element_id = 3000005 ORDER BY line, id LIMIT 100")
def reference_query(s, d):
    touch = (F.col("source_element_id") == 4000007) | (F.col("target_element_id") == 3000005)
    return relational.page(P.connectors(s, d).where(touch).select("id", "source_element_id", "target_element_id", "line"), ["line", "id"], 0, 0)


@query("SELECT c.id, c.target_element_id FROM connectors c SEMI JOIN (SELECT id FROM elements WHERE kind = 'customer' AND technology = 'BUILDING') k ON k.id = c.source_element_id")
def batch_lookup(s, d):
    keys = P.elements(s, d).where("kind = 'customer' and technology = 'BUILDING'").select(F.col("id").alias("source_element_id"))
    return P.connectors(s, d).join(keys, "source_element_id", "left_semi").select("id", "target_element_id")


@query("SELECT element_id, round(score, 6) AS score, tier FROM decisions WHERE score >= 0.5 ORDER BY score DESC, element_id LIMIT 50")
def decision_query(s, d):
    return relational.page(P.decisions(s, d).where("score >= 0.5").select("element_id", F.round("score", 6).alias("score"), "tier"), [F.col("score").desc(), "element_id"], 0, 50)


@query("SELECT v.id, v.name FROM views v WHERE NOT EXISTS (SELECT 1 FROM placements p WHERE p.element_id = v.owner_element_id AND p.view_id <> v.id)")
def root_views_anti(s, d):
    return relational.root_views(P.views(s, d), P.placements(s, d))


@query("SELECT DISTINCT v.id, v.name FROM views v JOIN placements p ON p.element_id = v.owner_element_id WHERE p.view_id = 101 AND v.id <> 101")
def child_views_semi(s, d):
    return relational.child_views(P.views(s, d), P.placements(s, d), 101)


@query("SELECT p.view_id, p.element_id, e.name, v.name AS child_view FROM placements p JOIN elements e ON e.id = p.element_id LEFT JOIN views v ON v.owner_element_id = e.id")
def placed_elements(s, d):
    v = P.views(s, d).select(F.col("owner_element_id"), F.col("name").alias("child_view"))
    return P.placements(s, d).join(P.elements(s, d), F.col("element_id") == F.col("id")).join(v, F.col("element_id") == F.col("owner_element_id"), "left").select("view_id", "element_id", "name", "child_view")


@query("SELECT e AS element_id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source_element_id AS e, 0 AS i, 1 AS o FROM connectors UNION ALL SELECT target_element_id, 1, 0 FROM connectors) GROUP BY 1")
def degree_maps(s, d):
    return relational.degrees(P.connectors(s, d))


@query("SELECT e AS element_id, count(DISTINCT x) AS neighbours FROM (SELECT source_element_id AS e, target_element_id AS x FROM connectors UNION ALL SELECT target_element_id, source_element_id FROM connectors) GROUP BY 1")
def distinct_neighbours(s, d):
    return relational.neighbours(P.connectors(s, d))


@query("SELECT e AS element_id, x AS other, count(*) AS n, CASE WHEN bool_or(o) AND bool_or(NOT o) THEN 'top' WHEN bool_or(NOT o) THEN 'left' ELSE 'right' END AS position FROM (SELECT source_element_id AS e, target_element_id AS x, true AS o FROM connectors UNION ALL SELECT target_element_id, source_element_id, false FROM connectors) GROUP BY 1, 2")
def neighbour_position(s, d):
    return relational.neighbour_positions(P.connectors(s, d))


@query("SELECT view_id, source_element_id, target_element_id, count(*) AS n, min(id) AS survivor FROM connectors GROUP BY ALL HAVING count(*) > 1")
def duplicate_connectors(s, d):
    return relational.duplicate_connectors(P.connectors(s, d))


@query("""SELECT view_id, source_element_id, target_element_id, min(id) AS id, string_agg(r, ' / ' ORDER BY id, r) AS relationship, min_by(label, lid) FILTER (WHERE label IS NOT NULL) AS label, CASE bit_or(bits) WHEN 3 THEN 'both' WHEN 2 THEN 'backward' WHEN 0 THEN 'none' ELSE 'forward' END AS direction
FROM (SELECT view_id, source_element_id, target_element_id, relationship AS r, min(id) AS id, min_by(label, id) FILTER (WHERE label IS NOT NULL) AS label, min(id) FILTER (WHERE label IS NOT NULL) AS lid, bit_or(CASE line % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END) AS bits FROM connectors GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def merged_connectors(s, d):
    way = F.element_at(F.array(*map(F.lit, ["both", "forward", "backward", "none"])), F.col("line") % 4 + 1)
    return relational.merged_connectors(P.connectors(s, d).withColumn("direction", way))


@query("SELECT element_id, round(filter_score, 6) AS filter_score, tier, round(confidence, 6) AS confidence FROM sig", SIGNALS)
def filter_signal_rollup(s, d):
    return _signals(s, d).select("element_id", F.round("filter_score", 6).alias("filter_score"), "tier", F.round("confidence", 6).alias("confidence"))


VIEW_SCORES = SIGNALS + """, each AS (SELECT element_id, list_avg(list_filter([filter_score, CASE WHEN tier IS NOT NULL THEN greatest(0, 10 - tier) / 10.0::DOUBLE END, confidence], lambda x: x IS NOT NULL)) AS s FROM sig),
vs AS (SELECT view_id, round(avg(s), 6) AS score FROM placements JOIN each USING (element_id) WHERE s IS NOT NULL GROUP BY 1)"""


@query("SELECT view_id, score FROM vs", VIEW_SCORES)
def view_signal_score(s, d):
    return density.view_scores(P.placements(s, d), _signals(s, d))


@query("SELECT v.id AS view_id, coalesce(level, 0)::INT AS level FROM views v LEFT JOIN (SELECT view_id, CASE WHEN count(*) OVER () = 1 THEN 0 ELSE (row_number() OVER (ORDER BY score, view_id) - 1) * 5 // count(*) OVER () - 2 END AS level FROM vs) r ON r.view_id = v.id", VIEW_SCORES)
def density_bucket(s, d):
    return density.density_levels(P.views(s, d), density.view_scores(P.placements(s, d), _signals(s, d)))


@query("SELECT view_id, element_id, ((row_number() OVER (PARTITION BY view_id ORDER BY element_id) - 1) // 50)::BIGINT AS chunk FROM placements")
def chunk_members(s, d):
    return relational.chunk_members(P.placements(s, d), "view_id", ["element_id"], 50)


@query("SELECT owner_element_id, min(id) AS id FROM views WHERE owner_element_id IS NOT NULL GROUP BY 1")
def first_view_per_owner(s, d):
    return relational.first_per_group(P.views(s, d).where("owner_element_id is not null").select("owner_element_id", "id"), "owner_element_id", ["id"])


@query("SELECT repository_id, event_id, change_type FROM ev QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_run(s, d):
    return P.events(s, d).groupBy("repository_id").agg(F.max_by(F.struct("event_id", "change_type"), F.struct("ts", "event_id")).alias("r")).select("repository_id", "r.event_id", "r.change_type")


@query("SELECT repository_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY ts DESC, event_id DESC) <= 5")
def retain_last_n(s, d):
    return relational.keep_latest(P.events(s, d).select("repository_id", "event_id", "ts"), ["repository_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select("repository_id", "event_id")


@query("SELECT id, CASE WHEN count(*) OVER w > 1 THEN row_number() OVER (PARTITION BY source_element_id, target_element_id ORDER BY id) END::INT AS ordinal FROM connectors WINDOW w AS (PARTITION BY source_element_id, target_element_id)")
def duplicate_ordinals(s, d):
    return relational.duplicate_ordinals(P.connectors(s, d), ["source_element_id", "target_element_id"], ["id"]).select("id", F.col("ordinal").cast("int").alias("ordinal"))


@query("SELECT source_element_id % 100 AS source_file, target_element_id % 100 AS target_file, count(*) AS n FROM connectors WHERE source_element_id % 100 <> target_element_id % 100 GROUP BY 1, 2")
def file_pair_rollup(s, d):
    c = P.connectors(s, d).select((F.col("source_element_id") % 100).alias("source_file"), (F.col("target_element_id") % 100).alias("target_file"))
    return c.where("source_file <> target_file").groupBy("source_file", "target_file").agg(F.count("*").alias("n"))


@query("""SELECT source_folder, target_folder, n, CASE WHEN n > 24 THEN n || ' references' END AS label FROM (
  SELECT source_element_id % 10 AS source_folder, target_element_id % 10 AS target_folder, count(*) AS n FROM connectors WHERE source_element_id % 10 <> target_element_id % 10 GROUP BY 1, 2) ORDER BY n DESC, 1, 2 LIMIT 100""")
def folder_pair_collapse(s, d):
    c = P.connectors(s, d).select((F.col("source_element_id") % 10).alias("source_folder"), (F.col("target_element_id") % 10).alias("target_folder"))
    g = c.where("source_folder <> target_folder").groupBy("source_folder", "target_folder").agg(F.count("*").alias("n"))
    return g.withColumn("label", F.when(F.col("n") > 24, F.concat(F.col("n").cast("string"), F.lit(" references")))).orderBy(F.col("n").desc(), "source_folder", "target_folder").limit(100)


TAGS = "tg AS (SELECT DISTINCT source_element_id AS owner, 's' || (target_element_id % 100) AS tag FROM connectors), df AS (SELECT tag, count(*) AS df FROM tg GROUP BY 1), nn AS (SELECT count(DISTINCT owner) AS n FROM tg)"


@query("SELECT owner, tag FROM (SELECT owner, tag, row_number() OVER (PARTITION BY owner ORDER BY df, tag) AS r FROM tg JOIN df USING (tag) WHERE df >= 2 AND df <= floor(0.70 * (SELECT n FROM nn))) WHERE r <= 5", TAGS)
def tag_coverage(s, d):
    tags = P.connectors(s, d).select(F.col("source_element_id").alias("owner"), F.concat(F.lit("s"), (F.col("target_element_id") % 100).cast("string")).alias("tag"))
    return relational.covered_tags(tags).select("owner", "tag")


@query("SELECT type, enricher FROM (SELECT type, enricher, count(*) AS n FROM facts GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC, enricher) = 1")
def dominant_language(s, d):
    n = P.facts(s, d).groupBy("type", "enricher").agg(F.count("*").alias("n"))
    return relational.first_per_group(n, "type", [F.col("n").desc(), "enricher"]).select("type", "enricher")


@query("SELECT type, enricher, count(*) AS n, count(*) || ' ' || type AS label FROM facts GROUP BY 1, 2")
def fact_summary(s, d):
    return P.facts(s, d).groupBy("type", "enricher").agg(F.count("*").alias("n")).withColumn("label", F.concat_ws(" ", F.col("n").cast("string"), "type"))


@query("SELECT view_id, sha256(string_agg(h, chr(10) ORDER BY chunk)) AS hash FROM (SELECT view_id, (r - 1) // 1000 AS chunk, sha256(string_agg(l, chr(10) ORDER BY r)) AS h FROM (SELECT view_id, 'r:' || source_element_id || ':' || target_element_id || ':' || relationship || ':' || id AS l, row_number() OVER (PARTITION BY view_id ORDER BY id, 'r:' || source_element_id || ':' || target_element_id || ':' || relationship || ':' || id) AS r FROM connectors) GROUP BY 1, 2) GROUP BY 1")
def raw_graph_hash(s, d):
    line = F.concat_ws(":", F.lit("r"), "source_element_id", "target_element_id", "relationship", "id")
    return versions.chunked_hash(P.connectors(s, d), "view_id", ["id", line], line)


def _snapshots(s, d):
    o = P.table(s, d, "orders")
    h = lambda c: F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", c), 256)
    before = o.where("o_orderkey % 7 <> 0").select("o_orderkey", h(F.lit("a")).alias("hash"))
    after = o.where("o_orderkey % 5 <> 0").select("o_orderkey", h(F.when(F.col("o_orderkey") % 11 == 0, "b").otherwise("a")).alias("hash"))
    return before, after


SNAP = """b AS (SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|a') AS hash FROM orders WHERE o_orderkey % 7 <> 0),
a AS (SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || CASE WHEN o_orderkey % 11 = 0 THEN 'b' ELSE 'a' END) AS hash FROM orders WHERE o_orderkey % 5 <> 0)"""


@query("SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.hash AS before_hash, a.hash AS after_hash, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'deleted' ELSE 'updated' END AS change_type FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey WHERE b.hash IS DISTINCT FROM a.hash", SNAP)
def snapshot_diff(s, d):
    return diff.snapshot_diff(*_snapshots(s, d), "o_orderkey")


@query("SELECT type, key, state FROM (SELECT CASE WHEN coalesce(a.o_orderkey, b.o_orderkey) % 3 = 0 THEN 'file' ELSE 'symbol' END AS type, coalesce(a.o_orderkey, b.o_orderkey) AS key, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN CASE WHEN b.o_orderkey % 3 = 0 THEN 'deleted' END WHEN a.hash <> b.hash THEN 'updated' END AS state FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) WHERE state IS NOT NULL", SNAP)
def changed_resources(s, d):
    before, after = (x.select(F.when(F.col("o_orderkey") % 3 == 0, "file").otherwise("symbol").alias("type"), F.col("o_orderkey").alias("key"), "hash") for x in _snapshots(s, d))
    return versionlog.changed_raw(before, after)


@query("SELECT b.o_orderkey FROM b ANTI JOIN a USING (o_orderkey)", SNAP)
def prune_missing(s, d):
    before, after = _snapshots(s, d)
    return diff.missing(before, after, "o_orderkey").select("o_orderkey")


@query("SELECT event_type AS resource_type, CASE WHEN value > 50 THEN 'added' ELSE 'updated' END AS change_type, count(*) AS n, sum(greatest(event_id % 7 - 2, 0))::BIGINT AS added, sum(greatest(event_id % 5 - 2, 0))::BIGINT AS removed FROM events GROUP BY 1, 2")
def diff_summary(s, d):
    e = P.table(s, d, "events").select(F.col("event_type").alias("resource_type"), F.when(F.col("value") > 50, "added").otherwise("updated").alias("change_type"), (F.col("event_id") % 7 - 2).alias("added_lines"), (F.col("event_id") % 5 - 2).alias("removed_lines"))
    return diff.diff_summary(e)


@query("""SELECT path, CASE WHEN bool_or(t = 'deleted') THEN 'deleted' ELSE min_by(t, CASE WHEN l = '' THEN 1000000000 ELSE 0 END + event_id) END AS change_type,
  CASE WHEN bool_or(t = 'deleted') THEN min_by(l, CASE WHEN l = '' THEN 1000000000 ELSE 0 END + event_id) FILTER (WHERE t = 'deleted') ELSE min_by(l, CASE WHEN l = '' THEN 1000000000 ELSE 0 END + event_id) END AS language
FROM (SELECT event_id, path || '/' || (event_id % 40) AS path, CASE WHEN change_type = 'error' THEN 'deleted' ELSE change_type END AS t, CASE event_id % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'ts' ELSE '' END AS l FROM ev) GROUP BY 1""")
def merged_changes(s, d):
    k = F.col("event_id")
    e = P.events(s, d).select(k.alias("grp"), F.concat("path", F.lit("/"), (k % 40).cast("string")).alias("path"), F.when(F.col("change_type") == "error", "deleted").otherwise(F.col("change_type")).alias("change_type"), F.when(k % 3 == 0, "go").when(k % 3 == 1, "ts").otherwise("").alias("language"))
    return diff.merged_changes(e)


@query("""SELECT k AS key, name, x, action, conflicts FROM (
  SELECT coalesce(b.k, l.k, s.k) AS k,
    CASE WHEN b.k IS NOT NULL AND l.k IS NOT NULL AND s.k IS NULL THEN 'deleted' WHEN b.k IS NOT NULL AND l.k IS NULL THEN CASE WHEN s.t > b.t THEN 'server' ELSE 'removed' END
      WHEN l.k IS NULL THEN 'added' WHEN s.k IS NULL THEN 'kept' WHEN (b.k IS NULL OR l.t > b.t) AND (b.k IS NULL OR s.t > b.t) THEN 'merged' WHEN b.k IS NULL OR s.t > b.t THEN 'server' ELSE 'kept' END AS action,
    CASE WHEN action = 'merged' THEN CASE WHEN l.n IS NOT DISTINCT FROM b.n THEN s.n ELSE l.n END WHEN action IN ('server', 'added') THEN s.n ELSE l.n END AS name,
    CASE WHEN action = 'merged' THEN CASE WHEN l.x IS NOT DISTINCT FROM b.x THEN s.x WHEN s.x IS NOT DISTINCT FROM b.x THEN l.x ELSE s.x END WHEN action IN ('server', 'added') THEN s.x ELSE l.x END AS x,
    CASE WHEN action = 'merged' AND l.n IS DISTINCT FROM s.n AND l.n IS DISTINCT FROM b.n AND s.n IS DISTINCT FROM b.n THEN 1 ELSE 0 END AS conflicts
  FROM (SELECT p_partkey AS k, p_name AS n, p_size AS x, 0 AS t FROM part WHERE p_partkey % 10 <> 0) b
  FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'L' ELSE p_name END AS n, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE p_size END AS x, CASE WHEN p_partkey % 12 = 0 OR p_partkey % 3 = 0 OR p_partkey % 4 = 0 THEN 1 ELSE 0 END AS t FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 20 <> 0) l ON l.k = b.k
  FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 'S' ELSE p_name END AS n, CASE WHEN p_partkey % 8 = 0 THEN 2 ELSE p_size END AS x, CASE WHEN p_partkey % 6 = 0 OR p_partkey % 8 = 0 THEN 1 ELSE 0 END AS t FROM part WHERE p_partkey % 17 <> 0) s ON s.k = coalesce(b.k, l.k)) WHERE action NOT IN ('deleted', 'removed')""")
def three_way_merge(s, d):
    p, k = P.table(s, d, "part"), F.col("p_partkey")
    side = lambda df, n, x, t: df.select(k.alias("key"), n.alias("name"), x.cast("int").alias("x"), t.cast("int").alias("updated_at"))
    base = side(p.where("p_partkey % 10 <> 0"), F.col("p_name"), F.col("p_size"), F.lit(0))
    local = side(p.where("p_partkey % 13 <> 0 and p_partkey % 20 <> 0"), F.when(k % 3 == 0, "L").otherwise(F.col("p_name")), F.when(k % 4 == 0, 1).otherwise(F.col("p_size")), ((k % 3 == 0) | (k % 4 == 0)))
    server = side(p.where("p_partkey % 17 <> 0"), F.when(k % 6 == 0, "S").otherwise(F.col("p_name")), F.when(k % 8 == 0, 2).otherwise(F.col("p_size")), ((k % 6 == 0) | (k % 8 == 0)))
    return diff.three_way(base, local, server, "key", ["x"], ["name", "x"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'Z' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT o_orderkey + 100000000, 'N' FROM orders WHERE o_orderkey % 100 = 0")
def upserted(s, d):
    o = P.table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = o.where("o_orderkey % 9 = 0").withColumn("status", F.lit("Z")).union(o.where("o_orderkey % 100 = 0").select(F.col("o_orderkey") + 100000000, F.lit("N")))
    return diff.upsert(o, new, ["o_orderkey"])


@query("SELECT view_id, CASE WHEN source_element_id = 4000002 THEN 4000001 ELSE source_element_id END AS source, target_element_id AS target, count(*) AS n, min(id) AS id FROM connectors GROUP BY ALL")
def merged_entities(s, d):
    m = diff.merge_entities(P.connectors(s, d), 4000001, 4000002)
    return m.groupBy("view_id", F.col("source_element_id").alias("source"), F.col("target_element_id").alias("target")).agg(F.count("*").alias("n"), F.min("id").alias("id"))


@query("SELECT DISTINCT view_id, CASE WHEN element_id = 4000002 THEN 4000001 ELSE element_id END AS element_id FROM placements")
def merged_placements(s, d):
    return diff.merge_placements(P.placements(s, d), 4000001, 4000002).select("view_id", "element_id")


@query("SELECT id, CASE WHEN id = 4000001 THEN coalesce(description, (SELECT description FROM elements WHERE id = 4000003)) ELSE description END AS description, technology FROM elements WHERE id <> 4000003")
def merged_fields(s, d):
    return diff.merge_fields(P.elements(s, d), 4000001, 4000003, ["description", "technology"]).select("id", "description", "technology")


@query("SELECT view_id, element_id, delta FROM overrides WHERE delta <> 0 AND element_id % 2 = 1 UNION ALL SELECT view_id, element_id, 4 FROM placements WHERE element_id % 1000 = 500 AND element_id >= 4000000")
def override_set(s, d):
    o = P.overrides(s, d)
    ch = o.where("element_id % 2 = 0").withColumn("delta", F.lit(0)).unionByName(P.placements(s, d).where("element_id % 1000 = 500 and element_id >= 4000000").withColumn("delta", F.lit(99)))
    latest = ch.groupBy("view_id", "element_id").agg(F.max("delta").alias("delta"))
    return diff.set_override(o, latest)


@query("""SELECT id, forced OR base >= 1 OR base + got >= 1 AS visible, round(base + CASE WHEN forced OR base >= 1 THEN 0 WHEN base + got >= 1 THEN least(got, ceil(1 - base)) ELSE got END, 6) AS score
FROM (SELECT s.*, coalesce(n, 0) AS got FROM sd s LEFT JOIN (SELECT c.target_element_id AS t, count(*) AS n FROM connectors c JOIN sd ON sd.id = c.source_element_id WHERE sd.forced OR sd.base >= 1 GROUP BY 1) r ON r.t = s.id)""", "sd AS (SELECT id, (id % 11) / 10.0::DOUBLE AS base, id % 101 = 0 AS forced FROM elements WHERE kind IN ('customer', 'supplier'))")
def visibility_fixpoint(s, d):
    seeds = P.elements(s, d).where("kind in ('customer', 'supplier')").select("id", ((F.col("id") % 11) / 10).alias("base"), (F.col("id") % 101 == 0).alias("forced"))
    refs = P.connectors(s, d).select(F.col("source_element_id").alias("source"), F.col("target_element_id").alias("target"))
    return graph.visibility(seeds, refs)


# A chain of orders in which each is referred to by the one before: what shows runs down it until a base is too low.
@query("""SELECT id, id IN (SELECT id FROM shown) AS visible, round(base + CASE WHEN forced OR base >= 1 THEN 0 WHEN id - 1 IN (SELECT id FROM shown) AND id % 60 <> 0 THEN 1 ELSE 0 END, 6) AS score FROM vs""", """vs AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 60 = 41 THEN -0.5::DOUBLE ELSE (o_orderkey % 7) / 10.0::DOUBLE END AS base, o_orderkey % 60 IN (2, 50) AS forced FROM orders),
shown AS (SELECT id FROM vs WHERE forced OR base >= 1 UNION SELECT v.id FROM shown s JOIN vs v ON v.id = s.id + 1 WHERE v.id % 60 <> 0 AND v.base + 1 >= 1)""", True)
def visibility_chains(s, d):
    k = F.col("o_orderkey")
    o = P.table(s, d, "orders")
    seeds = o.select(k.alias("id"), F.when(k % 60 == 41, -0.5).otherwise((k % 7) / 10).alias("base"), (k % 60).isin(2, 50).alias("forced"))
    return graph.visibility(seeds, o.where(k % 60 != 0).select((k - 1).alias("source"), k.alias("target")))


@query("SELECT view_id, parent_id FROM (SELECT v.id AS view_id, min(p.view_id) AS parent_id FROM views v LEFT JOIN placements p ON p.element_id = v.owner_element_id AND p.view_id <> v.id GROUP BY 1)")
def view_parents(s, d):
    return graph.view_parents(P.views(s, d), P.placements(s, d))


LINEAGE = """par AS (SELECT v.id AS view_id, min(p.view_id) AS parent_id FROM views v LEFT JOIN placements p ON p.element_id = v.owner_element_id AND p.view_id <> v.id GROUP BY 1),
cl AS (SELECT view_id, view_id AS ancestor_id, 0 AS depth FROM par UNION ALL SELECT cl.view_id, par.parent_id, depth + 1 FROM cl JOIN par ON par.view_id = cl.ancestor_id WHERE par.parent_id IS NOT NULL)"""


@query("SELECT view_id, ancestor_id, depth::INT AS depth FROM cl", LINEAGE, True)
def lineage(s, d):
    return graph.lineage(view_parents(s, d))


@query("SELECT view_id, max(depth)::INT AS depth FROM cl GROUP BY 1", LINEAGE, True)
def view_depths(s, d):
    nodes = ancestry.rooted(view_parents(s, d).select(F.col("view_id").alias("id"), F.col("parent_id").alias("parent")))[1]
    return nodes.select(F.col("id").alias("view_id"), F.col("depth").cast("int").alias("depth"))


@query("SELECT a, b, min_by(ancestor_id, (da + db) * 1000000 + ancestor_id) AS lca, min(da + db)::BIGINT AS distance FROM (SELECT a, b, x.ancestor_id, x.depth AS da, y.depth AS db FROM pr JOIN cl x ON x.view_id = a JOIN cl y ON y.view_id = b AND x.ancestor_id = y.ancestor_id) GROUP BY 1, 2", LINEAGE + ", pr AS (SELECT DISTINCT s.view_id AS a, t.view_id AS b FROM connectors c JOIN placements s ON s.element_id = c.source_element_id JOIN placements t ON t.element_id = c.target_element_id)", True)
def lca_distance(s, d):
    lift = ancestry.lifting(view_parents(s, d).select(F.col("view_id").alias("id"), F.col("parent_id").alias("parent")))
    place = lambda end, name: P.placements(s, d).select(F.col("element_id").alias(end), F.col("view_id").alias(name))
    pairs = P.connectors(s, d).select("source_element_id", "target_element_id").distinct().join(place("source_element_id", "a"), "source_element_id").join(place("target_element_id", "b"), "target_element_id").select("a", "b")
    return ancestry.common_ancestors(lift, pairs)


# Deep graphs from the tables: orders in chains of 750, customers in a heap (the parent of n is n / 2), so that SQL knows depths and ancestors by arithmetic.
CHAIN = 750


def _chains(s, d):
    k = F.col("o_orderkey")
    return P.table(s, d, "orders").select(k.alias("id"), F.when(k % CHAIN != 0, k - 1).alias("parent"))


@query(f"SELECT o_orderkey AS id, CASE WHEN EXISTS (SELECT 1 FROM orders r WHERE r.o_orderkey = o.o_orderkey - o.o_orderkey % {CHAIN}) THEN o_orderkey % {CHAIN} ELSE o_orderkey - (SELECT min(o_orderkey) FROM orders) END AS depth FROM orders o")
def chain_depths(s, d):
    return ancestry.rooted(_chains(s, d))[1].select("id", "depth")


@query(f"SELECT DISTINCT least(a, b) AS lca, a, b, abs(a - b) AS distance FROM (SELECT o_orderkey AS a, (o_orderkey * 7 + 3) % (SELECT max(o_orderkey) FROM orders) AS b FROM orders) JOIN orders o ON o.o_orderkey = b WHERE a // {CHAIN} = b // {CHAIN}")
def chain_ancestors(s, d):
    o = P.table(s, d, "orders").select(F.col("o_orderkey").alias("a"))
    most = o.agg(F.max("a").alias("most"))
    pairs = o.crossJoin(F.broadcast(most)).select("a", ((F.col("a") * 7 + 3) % F.col("most")).alias("b"))
    return ancestry.common_ancestors(ancestry.lifting(_chains(s, d)), pairs)


@query("""SELECT a, b, lca, distance FROM (SELECT a, b, x AS lca, (floor(log2(a)) + floor(log2(b)) - 2 * floor(log2(x)))::BIGINT AS distance, row_number() OVER (PARTITION BY a, b ORDER BY x DESC) AS r
  FROM (SELECT DISTINCT o_custkey AS a, c_custkey AS b FROM orders JOIN customer ON c_custkey = o_orderkey % 997 + 1), (SELECT unnest(range(0, 40)) AS i), LATERAL (SELECT a >> i::INT AS x), (SELECT unnest(range(0, 40)) AS j) WHERE x > 0 AND b >> j::INT = x) WHERE r = 1""")
def heap_ancestors(s, d):
    c = P.table(s, d, "customer").select(F.col("c_custkey").alias("id"))
    parents = c.select("id", F.when(F.col("id") > 1, F.shiftright("id", 1)).alias("parent"))
    pairs = P.table(s, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 997 + 1).alias("b")).distinct()
    return ancestry.common_ancestors(ancestry.lifting(parents), pairs)


@query("SELECT n AS id, min(m) AS component FROM (SELECT r.n, r.m FROM reach r) GROUP BY 1", """sel AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE c_custkey // 3 + 1 END AS b FROM customer),
reach AS (SELECT c_custkey AS n, c_custkey AS m FROM customer UNION SELECT x.a, r.m FROM (SELECT a, b FROM sel UNION SELECT b, a FROM sel) x JOIN reach r ON r.n = x.b)""", True)
def connected_components(s, d):
    c = P.table(s, d, "customer").select(F.col("c_custkey").alias("id"))
    # Every customer has an edge; that of each fourth goes to itself.
    return graph.components(c.select(F.col("id").alias("a"), F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.floor(F.col("id") / 3) + 1).cast("long").alias("b")), c)


@query("SELECT view_id, element_id, max(level)::BIGINT AS level FROM (SELECT view_id, source_element_id AS element_id, 0 AS level FROM connectors UNION ALL SELECT view_id, target_element_id, 1 FROM connectors) GROUP BY 1, 2")
def layout_levels(s, d):
    return graph.levels(P.connectors(s, d).select("view_id", F.col("source_element_id").alias("source"), F.col("target_element_id").alias("target")))


CYCLIC = """ce AS (SELECT DISTINCT p_size % 25 AS view_id, p_partkey AS source, CASE WHEN p_partkey % 50 < 47 OR p_size % 2 = 0 THEN q ELSE p_partkey END AS target FROM (
  SELECT p_partkey, p_size, lead(p_partkey) OVER (PARTITION BY p_size % 25 ORDER BY p_partkey) AS up, lag(p_partkey, 3) OVER (PARTITION BY p_size % 25 ORDER BY p_partkey) AS down, CASE WHEN p_partkey % 11 = 0 AND p_size % 25 < 20 THEN down ELSE up END AS q FROM part) WHERE q IS NOT NULL),
cn AS (SELECT view_id, n AS element_id, count(*) OVER (PARTITION BY view_id) AS n FROM (SELECT view_id, source AS n FROM ce UNION SELECT view_id, target FROM ce)),
walk AS (SELECT view_id, element_id, 0::BIGINT AS level, n FROM cn UNION SELECT w.view_id, e.target, w.level + 1, w.n FROM walk w JOIN ce e ON e.view_id = w.view_id AND e.source = w.element_id WHERE w.level + 1 < w.n)"""


@query("SELECT view_id, element_id, max(level) AS level FROM walk GROUP BY 1, 2", CYCLIC, True)
def cyclic_levels(s, d):
    p = P.table(s, d, "part")
    w = Window.partitionBy("view_id").orderBy("p_partkey")
    key = F.col("p_partkey")
    e = p.select((F.col("p_size") % 25).alias("view_id"), key, "p_size").withColumns({"up": F.lead("p_partkey").over(w), "down": F.lag("p_partkey", 3).over(w)})
    e = e.withColumn("q", F.when((key % 11 == 0) & (F.col("view_id") < 20), F.col("down")).otherwise(F.col("up"))).where("q IS NOT NULL")
    return graph.levels(e.select("view_id", key.alias("source"), F.when((key % 50 < 47) | (F.col("p_size") % 2 == 0), F.col("q")).otherwise(key).alias("target")))


@query("SELECT DISTINCT folder, len(string_split(folder, '/'))::BIGINT AS depth FROM (SELECT type AS folder FROM facts UNION ALL SELECT type || '/' || enricher FROM facts)")
def folder_closure(s, d):
    return graph.folders(P.facts(s, d).select(F.col("file_path").alias("path")))


INTERVALS = "iv AS (SELECT l_suppkey AS file, l_orderkey || ':' || l_linenumber AS name, (l_orderkey % 1000)::BIGINT AS s, CASE WHEN l_linenumber = 3 THEN NULL ELSE (l_orderkey % 1000 + l_quantity)::BIGINT END AS e FROM lineitem), pt AS (SELECT DISTINCT ps AS file, ln AS line FROM (SELECT l_suppkey AS ps, (l_partkey % 1100)::BIGINT AS ln FROM lineitem))"


@query("SELECT file, line, min_by(name, (200000 - s)::VARCHAR || name) AS name, max(s) AS start FROM pt JOIN iv USING (file) WHERE s <= line AND line <= coalesce(e, line) GROUP BY 1, 2", INTERVALS)
def enclosing_interval(s, d):
    li = P.table(s, d, "lineitem")
    iv = li.select(F.col("l_suppkey").alias("file"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("name"), (F.col("l_orderkey") % 1000).alias("start"), F.when(F.col("l_linenumber") != 3, (F.col("l_orderkey") % 1000 + F.col("l_quantity")).cast("long")).alias("end"))
    pt = li.select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 1100).alias("line")).distinct()
    return resolve.enclosing(pt, iv)


@query("""SELECT file_path AS path, coalesce(CASE WHEN doc_id % 10 = 0 THEN 'show' END, CASE WHEN enricher IN ('en', 'de') THEN 'hide' END, 'show') AS action,
  greatest(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END, CASE WHEN enricher IN ('en', 'de') THEN 3 ELSE 0 END, 2)::INT AS tier FROM facts""")
def ancestor_policy_lookup(s, d):
    f = P.facts(s, d)
    p = f.where("doc_id % 10 = 0").select(F.col("file_path").alias("prefix"), F.lit("show").alias("action"), F.lit(1).alias("tier"))
    p = p.union(f.where(F.col("enricher").isin("en", "de")).select(F.concat_ws("/", "type", "enricher"), F.lit("hide"), F.lit(3)).distinct()).union(f.select("type", F.lit("show"), F.lit(2)).distinct())
    return resolve.prefix_lookup(f.select(F.col("file_path").alias("path")), p)


@query("""SELECT file_path AS path, CASE WHEN type = 'src7' AND enricher = 'en' THEN 'team-e' WHEN file_path LIKE 'src1/%' THEN 'team-d' WHEN enricher = 'fr' THEN 'team-c' WHEN regexp_matches(file_path, '^src[0-9]/de/') THEN 'team-b' ELSE 'all' END AS owner FROM facts""")
def pattern_owner_last_match(s, d):
    rules = [("*", "all"), ("/src?/de/", "team-b"), ("fr", "team-c"), ("/src1/**", "team-d"), ("src7/en", "team-e")]
    return rules_.last_match(P.facts(s, d).select(F.col("file_path").alias("path")), s.createDataFrame([(k, *r) for k, r in enumerate(rules)], "number long, pattern string, owner string"))


OWNER_RULES = """ru AS (SELECT p_partkey AS k, 'src' || (p_partkey % 20) AS ty, ['en', 'de', 'fr', 'es'][(p_partkey % 4 + 1)::INT] AS la, p_partkey % 6 AS v FROM part)"""


@query("""SELECT f.file_path AS path, 'o' || max(k) AS owner FROM facts f LEFT JOIN ru ON CASE v WHEN 0 THEN type = ty WHEN 1 THEN type = ty AND enricher = la
  WHEN 2 THEN type LIKE '%' || (k % 100) OR enricher LIKE '%' || (k % 100) OR doc_id::VARCHAR LIKE '%' || (k % 100) WHEN 3 THEN type LIKE 'src_' AND enricher = la
  WHEN 4 THEN doc_id = k % 3000 ELSE type = ty AND doc_id = k % 50 END GROUP BY 1""", OWNER_RULES)
def owner_rules(s, d):
    k = F.col("p_partkey")
    join = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    top, lang = join("src", k % 20), F.element_at(F.array(*map(F.lit, ["en", "de", "fr", "es"])), (k % 4 + 1).cast("int"))
    pattern = F.when(k % 6 == 0, join("/", top, "/")).when(k % 6 == 1, join(top, "/", lang)).when(k % 6 == 2, join("*", k % 100)).when(k % 6 == 3, join("/src?/", lang, "/")).when(k % 6 == 4, join(k % 3000)).otherwise(join(top, "/**/", k % 50))
    table = P.table(s, d, "part").select(k.alias("number"), pattern.alias("pattern"), join("o", k).alias("owner"))
    return rules_.last_match(P.facts(s, d).select(F.col("file_path").alias("path")), table)


@query("SELECT file_path AS path, type = 'src3' OR (enricher = 'es' AND type <> 'src4') AS ignored FROM facts")
def ignore_rules(s, d):
    table = s.createDataFrame([(0, "src3", True), (1, "es", False), (2, "!src4/es", False), (3, "!src3", False)], "number long, pattern string, implicit boolean")
    return rules_.ignored(P.facts(s, d).select(F.col("file_path").alias("path")), table)


IDENT = """li AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2),
sy AS (SELECT l_orderkey || ':' || l_linenumber AS key, l_suppkey AS file, l_returnflag AS kind, (l_orderkey % 500)::BIGINT AS line, CASE WHEN l_partkey % 17 > 0 THEN l_partkey::VARCHAR END AS hash,
  'p' || (l_linenumber % 2) || '.get_' || l_linestatus || '_' || (l_partkey % 3) AS qualified_name, 'p' || (l_linenumber % 2) AS parent, ['get', lower(l_linestatus), (l_partkey % 3)::VARCHAR] AS tokens FROM li),
idn AS (SELECT 'i' || l_orderkey || ':' || l_linenumber AS identity, CASE WHEN l_linenumber = 3 THEN '' ELSE 'was:' END || l_orderkey || ':' || l_linenumber AS current_key,
  CASE WHEN l_orderkey % 9 = 0 THEN l_suppkey + 1000000 ELSE l_suppkey END AS file, l_returnflag AS kind, (l_orderkey % 500 + l_linenumber % 3)::BIGINT AS line, CASE WHEN l_partkey % 17 > 0 THEN l_partkey::VARCHAR END AS hash,
  'p' || (l_orderkey % 2) AS parent, [CASE WHEN l_linenumber % 4 = 1 THEN 'load' ELSE 'get' END, lower(l_returnflag), (l_partkey % 3)::VARCHAR] AS tokens FROM li),
ex AS (SELECT key, identity FROM sy JOIN idn ON current_key = key),
sf AS (SELECT * FROM sy WHERE key NOT IN (SELECT key FROM ex)), fi AS (SELECT * FROM idn WHERE identity NOT IN (SELECT identity FROM ex))"""


def _identities(s, d):
    # Symbols are unique by key: of lines with one number in an order, the smallest of each value.
    li = graph.stored(P.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")]))[0]
    key, part, number = F.concat_ws(":", "l_orderkey", "l_linenumber"), F.col("l_partkey"), F.col("l_linenumber")
    text_of = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    code = F.when(part % 17 > 0, part.cast("string")).alias("hash")
    symbols = li.select(key.alias("key"), F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") % 500).alias("line"), code, text_of("p", number % 2, ".get_", F.col("l_linestatus"), "_", part % 3).alias("qualified_name"))
    identities = li.select(F.concat(F.lit("i"), key).alias("identity"), F.concat(F.when(number == 3, "").otherwise("was:"), key).alias("current_key"), F.when(F.col("l_orderkey") % 9 == 0, F.col("l_suppkey") + 1000000).otherwise(F.col("l_suppkey")).alias("file"),
        F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") % 500 + number % 3).alias("line"), code, text_of("p", F.col("l_orderkey") % 2, F.when(number % 4 == 1, ".load_").otherwise(".get_"), F.col("l_returnflag"), "_", part % 3).alias("qualified_name"))
    return symbols, identities


@query("""SELECT key, identity, round(score, 6) AS score FROM (
  SELECT key, identity, 0.35::DOUBLE + CASE WHEN s.line = i.line THEN 0.35::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN coalesce(s.hash, '') = coalesce(i.hash, '') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN s.parent = i.parent THEN 0.1::DOUBLE ELSE 0 END AS score
  FROM sf s JOIN fi i ON s.file = i.file AND s.kind = i.kind WHERE abs(s.line - i.line) <= 3
  UNION ALL SELECT key, identity, 0.8::DOUBLE + CASE WHEN s.parent = i.parent THEN 0.1::DOUBLE ELSE 0 END
    + CASE WHEN 2 * len(list_intersect(s.tokens, i.tokens)) >= len(list_distinct(list_concat(s.tokens, i.tokens))) THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN abs(s.line - i.line) <= 5 THEN 0.05::DOUBLE ELSE 0 END
  FROM sf s JOIN fi i ON s.kind = i.kind AND s.hash = i.hash WHERE i.file NOT IN (SELECT file FROM sy)) WHERE round(score, 6) >= 0.70""", IDENT)
def identity_candidates(s, d):
    return identity.candidates(*_identities(s, d))


@query()
def identity_matches(s, d):
    return identity.matched(*_identities(s, d))


@query("""SELECT key, id, score, rank FROM (SELECT *, min(CASE WHEN rank = 1 AND score - nxt <= 0.02 THEN 1 ELSE 2 END) OVER (PARTITION BY key) AS amb FROM (
  SELECT key, id, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, id) AS rank, lead(score) OVER (PARTITION BY key ORDER BY score DESC, id) AS nxt FROM (
    SELECT a.p_partkey AS key, b.p_partkey AS id, round(CASE WHEN a.p_brand = b.p_brand THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN lower(a.p_name) = lower(b.p_name) THEN 0.42::DOUBLE ELSE 0 END + CASE WHEN sh >= 1 THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN sh >= 2 THEN 0.16::DOUBLE ELSE 0 END, 6) AS score
    FROM (SELECT a, b, len(list_intersect(list_distinct(string_split(a.p_type || ' ' || a.p_name, ' ')), list_distinct(string_split(b.p_type || ' ' || b.p_name, ' ')))) AS sh FROM part a JOIN part b ON a.p_partkey % 20 = 0)) WHERE score >= 0.72)) WHERE rank <= 12 AND amb = 2""")
def entity_link_scores(s, d):
    p = P.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.col("p_name").alias("name"), F.array_distinct(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).alias("tokens"))
    return resolve.linked_entities(p.where("id % 20 = 0").withColumnRenamed("id", "key"), p)


@query("""SELECT query, id, similarity, rank FROM (SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM (
  SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id AND q.vec_id % 20 = 0)) WHERE rank <= 10""")
def knn_cosine(s, d):
    v = P.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.similar(vectors.build(v), v.where("id % 20 = 0"), 10)


@query()
def knn_recall(s, d):
    """Ten neighbours by a number of lists visited, against the exact ones: probes, due, found."""
    v = P.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 20 = 0")
    index = vectors.build(v)
    exact = graph.checkpointed(vectors.similar(index, q, 10))
    out = None
    for share in (4, 2):
        probes = max(1, len(index.centroids) // share)
        one = exact.select("query", "id").join(vectors.similar(index, q, 10, probes).select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left").agg(F.lit(probes).alias("probes"), F.count("*").alias("due"), F.count("hit").alias("found"))
        out = one if out is None else out.union(one)
    return out


@query("""SELECT word, name, distance::INT AS distance FROM (SELECT word, name, levenshtein(lower(word), lower(name)) AS distance, row_number() OVER (PARTITION BY word ORDER BY levenshtein(lower(word), lower(name)), length(name), name) AS r FROM (SELECT DISTINCT p_type AS name FROM part) CROSS JOIN (SELECT DISTINCT replace(p_type, 'E', 'I') || 'x' AS word FROM part) WHERE levenshtein(lower(word), lower(name)) <= 3) WHERE r <= 3""")
def catalog_suggest(s, d):
    t = P.table(s, d, "part").select(F.col("p_type").alias("name")).distinct()
    return relational.suggestions(t, t.select(F.concat(F.regexp_replace("name", "E", "I"), F.lit("x")).alias("word")).distinct()).select("word", "name", F.col("distance").cast("int").alias("distance"))


@query(r"""SELECT token, count(*) AS n FROM (SELECT CASE WHEN t[1] IN ('"', '''') THEN 'string_lit' WHEN regexp_matches(t, '^[0-9]') THEN 'number_lit' ELSE lower(t) END AS token FROM (SELECT unnest(regexp_extract_all(text, '("[^"]*"|''[^'']*''|[A-Za-z_][A-Za-z0-9_]*|[0-9]+)', 1)) AS t FROM documents)) GROUP BY 1""")
def lexical_token_counts(s, d):
    return P.table(s, d, "documents").select(F.explode(text.lexical_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(p_name) - 1), lambda i: p_name[i:i + 2])) AS g FROM part) GROUP BY 1")
def char_ngrams(s, d):
    return P.table(s, d, "part").select(F.explode(text.char_ngrams(F.col("p_name"), 3)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, (('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT % 512)::BIGINT AS idx, CASE WHEN ('0x' || h[9:10])::INT % 2 = 1 THEN -1 ELSE 1 END::INT AS sign FROM (SELECT p_partkey, sha256('tok:' || p_name) AS h FROM part)")
def feature_hash(s, d):
    t = F.concat(F.lit("tok:"), F.col("p_name"))
    return P.table(s, d, "part").select("p_partkey", text.feature_index(t, 512).alias("idx"), text.feature_sign(t).alias("sign"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(s, d):
    return P.table(s, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_type", "p_brand")).alias("slug"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[:/?#].*$', '')) AS host FROM pages")
def endpoint_hosts(s, d):
    return P.table(s, d, "pages").select("page_id", text.endpoint_host(F.col("url")).alias("host"))


@query("""SELECT page_id, count(*) AS n, min('GET ' || m) AS first_name FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS m FROM pages) GROUP BY 1""")
def route_facts(s, d):
    f = P.table(s, d, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    return enrich.route_facts(f, 'href="([^"]*)"', None, 1, "GET").groupBy(F.col("path").alias("page_id")).agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query("SELECT page_id, CASE WHEN contains(html, '<table') THEN '<table' WHEN contains(html, '<ul') THEN '<ul' ELSE '<p' END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '/\\*.*?\\*/', '', 'gs'), '//[^\\n]*', '', 'g'), '#[^\\n]*', '', 'g') AS html FROM pages) WHERE contains(html, '<table') OR contains(html, '<ul') OR contains(html, '<p')")
def pattern_facts(s, d):
    f = P.table(s, d, "pages").select(F.col("page_id").alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"), F.array().cast("array<string>").alias("signals"))
    one = s.createDataFrame([("markup", "ui.block", ["<table", "<ul", "<p"], None, None, None, None)], specs.SPECS)
    return specs.facts(f, one).select(F.col("path").alias("page_id"), "name")


SPECIFIED = """tk AS (SELECT p_partkey // 4 AS sid, p_partkey AS place, chr((97 + p_partkey % 26)::INT) || chr((97 + p_partkey // 26 % 26)::INT) || chr((97 + p_partkey * 7 % 26)::INT) AS token FROM part),
cd AS (SELECT doc_id, lang, source, regexp_replace(regexp_replace(regexp_replace(text, '/\\*.*?\\*/', '', 'gs'), '//[^\\n]*', '', 'g'), '#[^\\n]*', '', 'g') AS code FROM documents)"""


@query("""SELECT doc_id::VARCHAR AS path, 'spec' || sid AS enricher, 't' || (sid % 5) AS type, min_by(token, place) AS name FROM cd JOIN tk ON contains(code, token)
WHERE (sid % 3 > 0 OR lang = 'en') AND (sid % 4 > 0 OR source = 'src' || (sid % 20) OR starts_with(source, 'src' || (sid % 20) || '/')) AND (sid % 5 > 0 OR contains(doc_id::VARCHAR, (sid % 10)::VARCHAR)) GROUP BY 1, 2, 3""", SPECIFIED)
def specified_facts(s, d):
    k, sid = F.col("p_partkey"), F.col("sid")
    letter = lambda c: F.char((97 + c % 26).cast("int"))
    parts = P.table(s, d, "part").select(F.floor(k / 4).alias("sid"), k.alias("place"), F.concat(letter(k), letter(F.floor(k / 26)), letter(k * 7)).alias("token"))
    none, text_of = F.array().cast("array<string>"), lambda c: c.cast("string")
    table = parts.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("tokens")).select(
        F.concat(F.lit("spec"), text_of(sid)).alias("id"), F.concat(F.lit("t"), text_of(sid % 5)).alias("type"), "tokens", F.when(sid % 3 == 0, F.array(F.lit("en"))).otherwise(none).alias("languages"),
        F.when(sid % 4 == 0, F.array(F.concat(F.lit("src"), text_of(sid % 20)))).otherwise(none).alias("triggers"), F.when(sid % 5 == 0, F.array(text_of(sid % 10))).otherwise(none).alias("path_tokens"), none.alias("tags"))
    files = P.table(s, d, "documents").select(text_of(F.col("doc_id")).alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"), F.array("source").alias("signals"))
    return specs.facts(files, table).select("path", "enricher", "type", "name")


SCORED_FACTS = """fx AS (SELECT *, type IN ('src0', 'src1') OR doc_id % 6 = 5 AS hs, enricher = 'de' AS dp, CASE WHEN doc_id % 3 = 0 THEN 'symbol' ELSE 'file' END AS subject_kind, doc_id % 40 AS subject_key, CASE WHEN doc_id % 7 = 0 THEN 0.6::DOUBLE WHEN doc_id % 11 = 0 THEN -0.5::DOUBLE END AS hint FROM facts)"""


@query("""SELECT doc_id AS id, score, tier, (hs OR dp) AND (tier > 0 OR score >= 1.0) AS visible FROM (SELECT *, round(CASE WHEN hs THEN 1.5::DOUBLE * confidence WHEN dp THEN 0.2::DOUBLE * confidence ELSE 0 END + CASE WHEN subject_kind = 'symbol' AND subject_key < 25 THEN 1 ELSE 0 END
  + CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN tier > 0 THEN 100 ELSE 0 END + coalesce(hint, 0), 6) AS score FROM (
  SELECT *, greatest(CASE WHEN type = 'src3' THEN 1 ELSE 0 END, CASE WHEN type = 'src3' AND enricher = 'fr' THEN 4 ELSE 0 END, CASE WHEN doc_id % 50 = 0 THEN 2 ELSE 0 END)::INT AS tier FROM fx WHERE type <> 'src9'))""", SCORED_FACTS)
def fact_scores(s, d):
    k = F.col("doc_id")
    f = P.facts(s, d).select(k.alias("id"), F.when(F.col("type") == "src9", enrich.VERSION_TYPE).otherwise(F.col("type")).alias("type"), "enricher", F.when(k % 3 == 0, "symbol").otherwise("file").alias("subject_kind"), (k % 40).alias("subject_key"), F.col("file_path").alias("path"), "confidence", F.when(k % 7 == 0, 0.6).when(k % 11 == 0, -0.5).alias("hint"), "n_chars")
    expansions = f.where("id % 50 = 0").select("path", F.lit(2).alias("tier")).union(s.createDataFrame([("src3", 1), ("src3/fr", 4)], "path string, tier int"))
    return enrich.fact_scores(f, F.col("type").isin("src0", "src1") | (F.col("id") % 6 == 5), F.col("enricher") == "de", f.where("subject_key < 25").select(F.col("subject_key").alias("key")), f.where("n_chars % 2 = 0").select("path"), expansions)


@query("""SELECT type, id, name, rank::INT AS rank FROM (
  SELECT * FROM (SELECT 'view' AS type, id, name, CASE WHEN lower(name) = 'nat' THEN 0 WHEN lower(name) LIKE 'nat%' THEN 1 WHEN lower(name) LIKE '%nat%' THEN 2 ELSE 3 END AS rank FROM views WHERE lower(name) LIKE '%nat%' ORDER BY rank, name, id LIMIT 4)
  UNION ALL SELECT * FROM (SELECT 'element', id, name, CASE WHEN lower(name) = 'nat' THEN 0 WHEN lower(name) LIKE 'nat%' THEN 1 WHEN lower(name) LIKE '%nat%' THEN 2 ELSE 3 END AS rank FROM elements WHERE lower(name) LIKE '%nat%' OR lower(kind) LIKE '%nat%' OR lower(coalesce(technology, '')) LIKE '%nat%' ORDER BY rank, name, id LIMIT 6)) ORDER BY type DESC, rank, name, id LIMIT 8""")
def jump_search(s, d):
    return relational.jump_search(P.views(s, d), P.elements(s, d), " Nat ")


def _lint(s, d, code):
    args = P.elements(s, d), P.views(s, d), P.placements(s, d), P.connectors(s, d)
    return lint.RULES[code][1](*args).select(F.col("location").cast("long").alias("location"))


@query("SELECT view_id AS location FROM placements GROUP BY 1 HAVING count(*) > 20")
def lint_density(s, d):
    return _lint(s, d, "density")


@query("SELECT id AS location FROM elements WHERE id NOT IN (SELECT source_element_id FROM connectors) AND id NOT IN (SELECT target_element_id FROM connectors)")
def lint_isolated(s, d):
    return _lint(s, d, "isolated")


@query("SELECT view_id AS location FROM (SELECT view_id, count(*) AS n FROM placements GROUP BY 1) LEFT JOIN (SELECT view_id, count(*) AS m FROM connectors GROUP BY 1) USING (view_id) WHERE 2 * coalesce(m, 0) < n")
def lint_low_insight(s, d):
    return _lint(s, d, "low_insight")


@query("SELECT min(id) AS location FROM elements GROUP BY lower(name) HAVING count(*) > 1")
def lint_duplicate_name(s, d):
    return _lint(s, d, "duplicate_name")


@query("SELECT owner_element_id AS location FROM views v WHERE owner_element_id IS NOT NULL AND id NOT IN (SELECT view_id FROM placements) AND id NOT IN (SELECT view_id FROM connectors)")
def lint_empty_view(s, d):
    return _lint(s, d, "empty_view")


@query("SELECT location, part FROM (SELECT id AS location, lower(technology) AS part FROM elements WHERE technology IS NOT NULL) WHERE part NOT IN ('building', 'machinery')")
def lint_unknown_technology(s, d):
    known = s.createDataFrame([("building",), ("machinery",)], "alias string")
    return lint.unknown_technology(P.elements(s, d), known)


@query("""SELECT rule, location FROM (SELECT 'abstraction_leak' AS rule, c_custkey AS location FROM customer WHERE c_custkey % 3 = 0 AND (c_custkey % 5 = 0 OR c_custkey % 7 = 0)
  UNION ALL SELECT 'generic_name', c_custkey FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'generic_label', o_orderkey FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT 'flat_hierarchy', 1)""")
def lint_workspace(s, d):
    k = F.col("c_custkey")
    c = P.table(s, d, "customer")
    e = c.select(k.alias("id"), F.when(k % 4 == 0, "My Module").otherwise(F.col("c_name")).alias("name"), F.when(k % 3 == 0, "Function").otherwise("service").alias("kind"))
    v = s.createDataFrame([(0, None), (1, 1), (2, 2)], "id long, owner_element_id long")
    p = c.where("c_custkey % 7 <> 0").select(F.when(k % 5 == 0, 0).otherwise(1).cast("long").alias("view_id"), (k + F.when(k < 3, 1000000).otherwise(0)).alias("element_id"))
    o = P.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).cast("long").alias("view_id"), F.when(F.col("o_orderkey") % 6 == 0, "Uses").otherwise("reads").alias("label"))
    out = None
    for code in ("abstraction_leak", "flat_hierarchy", "generic_label", "generic_name"):
        rows = lint.RULES[code][1](e, v, p, o).select(F.lit(code).alias("rule"), F.col("location").cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT rule, count(*) AS n FROM (SELECT 'dangling_connector' AS rule, id FROM connectors WHERE source_element_id NOT IN (SELECT id FROM elements) OR target_element_id NOT IN (SELECT id FROM elements)
  UNION ALL SELECT 'dead_end', t FROM (SELECT DISTINCT target_element_id AS t FROM connectors) WHERE t NOT IN (SELECT source_element_id FROM connectors)
  UNION ALL SELECT 'density', view_id FROM placements GROUP BY view_id HAVING count(*) > 20
  UNION ALL SELECT 'duplicate_name', min(id) FROM elements GROUP BY lower(name) HAVING count(*) > 1
  UNION ALL SELECT 'isolated', id FROM elements WHERE id NOT IN (SELECT source_element_id FROM connectors) AND id NOT IN (SELECT target_element_id FROM connectors)
  UNION ALL SELECT 'low_insight', view_id FROM (SELECT view_id, count(*) AS n FROM placements GROUP BY 1) LEFT JOIN (SELECT view_id, count(*) AS m FROM connectors GROUP BY 1) USING (view_id) WHERE 2 * coalesce(m, 0) < n
  UNION ALL SELECT 'missing_description', id FROM elements WHERE coalesce(trim(description), '') = ''
  UNION ALL SELECT 'missing_label', id FROM connectors WHERE coalesce(trim(label), '') = ''
  UNION ALL SELECT 'empty_view', owner_element_id FROM views WHERE owner_element_id IS NOT NULL AND id NOT IN (SELECT view_id FROM placements) AND id NOT IN (SELECT view_id FROM connectors)
  UNION ALL SELECT 'shared_context', element_id FROM placements GROUP BY element_id HAVING count(DISTINCT view_id) > 1) GROUP BY 1""")
def lint_summary(s, d):
    out = lint.lint(P.elements(s, d), P.views(s, d), P.placements(s, d), P.connectors(s, d))
    return out.groupBy("rule").agg(F.count("*").alias("n"))


ISLANDS = "g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY repository_id ORDER BY ts, event_id) AS island FROM (SELECT *, lag(ts) OVER (PARTITION BY repository_id ORDER BY ts, event_id) AS p FROM ev))"


@query("SELECT repository_id, min(ts) AS started, count(*) AS events, count(DISTINCT path) AS paths FROM g GROUP BY repository_id, island", ISLANDS)
def debounced_batches(s, d):
    return changes.debounced(P.events(s, d), "6 hours")


@query("SELECT event_id, repository_id, change_type FROM (SELECT *, lag(change_type) OVER (PARTITION BY repository_id, path ORDER BY ts, event_id) AS b FROM ev) WHERE b IS NULL OR b <> change_type")
def change_suppression(s, d):
    return changes.changed_only(P.events(s, d)).select("event_id", "repository_id", "change_type")


@query("SELECT started, n, sum(n) OVER (ORDER BY started)::BIGINT AS total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, count(*) AS n FROM ev GROUP BY 1)")
def interval_counter(s, d):
    return changes.running_totals(changes.interval_counts(P.events(s, d), "1 hour"))


@query("SELECT repository_id, count(*) AS stale, max(gap) AS longest_us FROM (SELECT repository_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY repository_id ORDER BY ts, event_id)) AS gap FROM ev) WHERE gap > 21600 * 1000000::BIGINT GROUP BY 1")
def stale_heartbeat(s, d):
    return changes.stale_beats(P.events(s, d), 21600)


PROXIES = LINEAGE + """,
up AS (SELECT DISTINCT element_id, view_id, element_id AS proxy FROM placements UNION SELECT p.element_id, q.view_id, v.owner_element_id FROM placements p JOIN cl ON cl.view_id = p.view_id JOIN views v ON v.id = cl.ancestor_id JOIN placements q ON q.element_id = v.owner_element_id),
pe AS (SELECT least(source_element_id, target_element_id) AS x, greatest(source_element_id, target_element_id) AS y, count(*) AS n FROM connectors GROUP BY 1, 2),
pg AS (SELECT a.view_id, least(a.proxy, b.proxy) AS source, greatest(a.proxy, b.proxy) AS target, sum(n)::BIGINT AS n FROM pe JOIN up a ON a.element_id = x JOIN up b ON b.element_id = y AND b.view_id = a.view_id WHERE a.proxy <> b.proxy AND NOT (a.proxy = x AND b.proxy = y) GROUP BY 1, 2, 3)"""


@query("SELECT view_id, count(*) FILTER (WHERE r <= 5) AS shown, coalesce(sum(n) FILTER (WHERE r > 5), 0)::BIGINT AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY n DESC, source, target) AS r FROM pg) GROUP BY 1", PROXIES, True)
def proxy_budget(s, d):
    closure = graph.lineage(view_parents(s, d))
    return crossview.omitted(crossview.proxy_connectors(P.connectors(s, d), P.placements(s, d), closure, P.views(s, d), 1 << 40), 5)


@query("SELECT view_id, source, target, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY n DESC, source, target) AS rank FROM pg) WHERE rank <= 50", PROXIES, True)
def proxy_connectors(s, d):
    closure = graph.lineage(view_parents(s, d))
    return crossview.proxy_connectors(P.connectors(s, d), P.placements(s, d), closure, P.views(s, d))


@query("SELECT v.id AS view_id, coalesce(e, 0)::BIGINT AS elements, coalesce(k, 0)::BIGINT AS children, coalesce(c, 0)::BIGINT AS connectors FROM views v LEFT JOIN (SELECT view_id, count(*) AS e, count(w.id) AS k FROM placements p LEFT JOIN views w ON w.owner_element_id = p.element_id GROUP BY 1) a ON a.view_id = v.id LEFT JOIN (SELECT view_id, count(*) AS c FROM connectors GROUP BY 1) b ON b.view_id = v.id")
def view_summary(s, d):
    v = P.views(s, d)
    kids = v.select(F.col("owner_element_id"), F.col("id").alias("child")).where("owner_element_id is not null")
    p = P.placements(s, d).join(kids, F.col("element_id") == F.col("owner_element_id"), "left").groupBy("view_id").agg(F.count("*").alias("elements"), F.count("child").alias("children"))
    c = P.connectors(s, d).groupBy("view_id").agg(F.count("*").alias("connectors"))
    out = v.select(F.col("id").alias("view_id")).join(p, "view_id", "left").join(c, "view_id", "left")
    return out.select("view_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("elements", "children", "connectors")])


@query("SELECT kind, count(*) AS elements, count(description) AS described, count(technology) AS with_technology FROM elements GROUP BY 1")
def resource_counts(s, d):
    return P.elements(s, d).groupBy("kind").agg(F.count("*").alias("elements"), F.count("description").alias("described"), F.count("technology").alias("with_technology"))


# -- versions ------------------------------------------------------------------

VERSION_LOG = """sn AS (SELECT user_id % 8 AS repository_id, event_id % 12 AS place, event_type || ':' || (event_id % 5) || ':' || (user_id % 3) AS key, (max(event_id) % 3)::VARCHAR AS hash FROM events WHERE (event_id // 12) % 3 < 2 GROUP BY ALL),
rn AS (SELECT repository_id, place, 'h' || (place // 2) AS head, (sum(hash::BIGINT) % 2)::VARCHAR AS hash, place % 3 = 0 AS clean FROM sn GROUP BY 1, 2),
vn AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY place) AS version FROM (SELECT *, lag(head) OVER w AS h, lag(hash) OVER w AS r FROM rn WINDOW w AS (PARTITION BY repository_id ORDER BY place)) WHERE h IS NULL OR h <> head OR r <> hash),
vr AS (SELECT repository_id, version, key, sn.hash FROM sn JOIN vn USING (repository_id, place)),
vd AS (SELECT repository_id, version, key, b.hash AS before_hash, a.hash AS after_hash, CASE WHEN version = 1 THEN 'initialized' WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'deleted' WHEN a.hash <> b.hash THEN 'updated' END AS change_type
  FROM (SELECT repository_id, version + 1 AS version, key, hash FROM vr WHERE (repository_id, version + 1) IN (SELECT repository_id, version FROM vn)) b FULL JOIN vr a USING (repository_id, version, key))"""


def _version_log(s, d):
    e = P.table(s, d, "events").where("(event_id DIV 12) % 3 < 2")
    k, u = F.col("event_id"), F.col("user_id")
    key = F.concat_ws(":", "event_type", (k % 5).cast("string"), (u % 3).cast("string"))
    snapshots = e.groupBy((u % 8).alias("repository_id"), (k % 12).alias("place"), key.alias("key")).agg((F.max("event_id") % 3).cast("string").alias("hash"))
    runs = snapshots.groupBy("repository_id", "place").agg((F.sum(F.col("hash").cast("long")) % 2).cast("string").alias("hash")).select("repository_id", "place", F.concat(F.lit("h"), F.floor(F.col("place") / 2).cast("string")).alias("head"), "hash", (F.col("place") % 3 == 0).alias("clean"))
    versions_ = versionlog.versions_of(runs)
    return versions_, versionlog.stored_diffs(versions_, snapshots)


@query("SELECT * FROM vd WHERE change_type IS NOT NULL", VERSION_LOG)
def stored_diffs(s, d):
    return _version_log(s, d)[1]


@query("""SELECT repository_id, key, since, least(cleaned, back) AS until FROM (SELECT g.repository_id, g.key, g.version AS since, (SELECT min(version) FROM vn c WHERE c.repository_id = g.repository_id AND c.clean AND c.version >= g.version) AS cleaned,
  (SELECT min(version) FROM vd x WHERE x.repository_id = g.repository_id AND x.key = g.key AND x.change_type = 'added' AND x.version > g.version) AS back FROM vd g WHERE change_type = 'deleted') WHERE least(cleaned, back) IS NULL OR least(cleaned, back) > since""", VERSION_LOG)
def version_tombstones(s, d):
    return versionlog.tombstones(*_version_log(s, d))


SUMMARIES = """fb AS (SELECT 'fact-summary:f' || (p_partkey % 60) || '.go:t' || (p_partkey % 4) || ':' || lpad(p_partkey::VARCHAR, 16, '0') AS key, 'f' || (p_partkey % 60) || '.go' AS f, 't' || (p_partkey % 4) AS t, (p_size % 3)::VARCHAR AS hash FROM part WHERE p_partkey % 11 < 6),
fa AS (SELECT 'fact-summary:f' || (p_partkey % 60) || '.go:t' || (p_partkey % 4) || ':' || lpad(p_partkey::VARCHAR, 16, '0') AS key, 'f' || (p_partkey % 60) || '.go' AS f, 't' || (p_partkey % 4) AS t, ((p_size + p_partkey % 2) % 3)::VARCHAR AS hash FROM part WHERE p_partkey % 7 < 4),
fn AS (SELECT a.*, o.bk, o.bh, o.bk IS NOT NULL AND o.bh <> a.hash AS moved FROM fa a LEFT JOIN (SELECT f, t, min(key) AS bk, min_by(hash, key) AS bh FROM fb GROUP BY 1, 2) o USING (f, t) WHERE a.key NOT IN (SELECT key FROM fb))"""


@query("""SELECT key, key AS before_key, fb.hash AS before_hash, fa.hash AS after_hash, 'updated' AS change_type FROM fb JOIN fa USING (key) WHERE fb.hash <> fa.hash
UNION ALL SELECT key, CASE WHEN moved THEN bk END, CASE WHEN moved THEN bh END, hash, CASE WHEN moved THEN 'updated' ELSE 'added' END FROM fn
UNION ALL SELECT key, key, hash, NULL, 'deleted' FROM fb WHERE key NOT IN (SELECT key FROM fa) AND key NOT IN (SELECT bk FROM fn WHERE moved)""", SUMMARIES)
def promoted_summaries(s, d):
    p, k = P.table(s, d, "part"), F.col("p_partkey")
    key = F.concat(F.lit("fact-summary:f"), (k % 60).cast("string"), F.lit(".go:t"), (k % 4).cast("string"), F.lit(":"), F.lpad(k.cast("string"), 16, "0"))
    side = lambda test, h: p.where(test).select(key.alias("key"), (h % 3).cast("string").alias("hash"))
    return versionlog.promoted_summaries(side(k % 11 < 6, F.col("p_size")), side(k % 7 < 4, F.col("p_size") + k % 2))


# -- streams over a replayed table -------------------------------------------


def _replayed(s, d, name):
    """A table as a stream. Files of a stream are found below a folder or by a pattern, and a table may be either a file or a folder."""
    return s.readStream.schema(P.table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _drained(s, stream, name):
    folder = f"{graph.shared_folder(s)}/{name}-{uuid.uuid4().hex}"
    return liveness.drained(stream, f"{folder}/rows", f"{folder}/state")


@query("SELECT event_id, repository_id, path, count(*) OVER (PARTITION BY repository_id, path ORDER BY ts, event_id) AS change FROM (SELECT *, lag(event_type) OVER w AS c, lag(event_id % 2) OVER w AS t, row_number() OVER w AS r FROM (SELECT event_id, ts, user_id AS repository_id, 'p' || (event_id % 3) AS path, event_type FROM events) WINDOW w AS (PARTITION BY repository_id, path ORDER BY ts, event_id)) WHERE r = 1 OR c <> event_type OR t <> event_id % 2")
def streamed_changes(s, d):
    e = F.col("event_id")
    rows = _replayed(s, d, "events").select(e, "ts", F.col("user_id").alias("repository_id"), F.concat(F.lit("p"), (e % 3).cast("string")).alias("path"), F.col("event_type").alias("content"), (e % 2).cast("string").alias("tree"), F.col("value").cast("string").alias("metadata"))
    return _drained(s, liveness.content_changes(rows), "changes")


STALE = 43_200


@query(f"""SELECT repository_id, at_us, 'w' || repository_id AS token, status FROM (
  SELECT repository_id, us AS at_us, 'active' AS status FROM g WHERE gap IS NULL OR gap > {STALE * 1_000_000}
  UNION ALL SELECT repository_id, us - gap + {STALE * 1_000_000}, 'stale' FROM g WHERE gap > {STALE * 1_000_000}
  UNION ALL SELECT repository_id, max(us) + {STALE * 1_000_000}, 'stale' FROM g GROUP BY 1 HAVING (max(us) + {STALE * 1_000_000}) // 1000 + 1 <= (SELECT max(us) // 1000 FROM g))""", "g AS (SELECT user_id AS repository_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)")
def streamed_locks(s, d):
    rows = _replayed(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("repository_id"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("token"), F.lit("acquire").alias("kind"))
    return _drained(s, liveness.lock_stream(rows, STALE), "locks")
