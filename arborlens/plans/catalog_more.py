"""Queries on fuller forms: pages with their files, latest runs, directions, hashes of whole graphs, tags, chunks by tier, endpoints (P, J, A, W, T, F families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlens.functions import naming, text
from arborlens.operators import crossview, graph, layout, lint, materialise, relational, resolve, versions
from arborlens.plans import projection as P
from arborlens.plans.catalog_code import SYMBOLS, _symbols
from arborlens.plans.registry import LINEAGE, query, view_parents


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


CODE = "cs AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS file_id, 'f' || l_partkey AS name, 'pkg.' || l_returnflag || '.f' || l_partkey AS qualified_name, l_linestatus AS kind, (l_orderkey % 1000)::BIGINT AS start_line FROM lineitem), cf AS (SELECT s_suppkey AS id, 'src/' || s_name || '.go' AS path FROM supplier)"


def _code(s, d):
    li = P.table(s, d, "lineitem")
    syms = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("file_id"), _text("f", F.col("l_partkey")).alias("name"), _text("pkg.", F.col("l_returnflag"), ".f", F.col("l_partkey")).alias("qualified_name"), F.col("l_linestatus").alias("kind"), (F.col("l_orderkey") % 1000).alias("start_line"))
    return syms, P.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), _text("src/", F.col("s_name"), ".go").alias("path"))


@query("SELECT cs.id, path, start_line, name FROM cs JOIN cf ON cf.id = cs.file_id WHERE (contains(lower(name), 'a.f1') OR contains(lower(qualified_name), 'a.f1')) AND kind = 'O' ORDER BY path, start_line, name, cs.id LIMIT 50 OFFSET 5", CODE)
def symbol_page(s, d):
    return relational.symbol_page(*_code(s, d), " A.f1 ", "O", None, 5, 50).select("id", "path", "start_line", "name")


@query("SELECT v.id, v.name FROM views v WHERE v.id IN (SELECT view_id FROM cl WHERE ancestor_id = 0 AND depth > 0) AND v.id IN (SELECT view_id FROM cl WHERE ancestor_id = 101 AND depth = 1) AND contains(lower(v.name), 'nation')", LINEAGE, True)
def views_below(s, d):
    return relational.views_below(P.views(s, d), graph.lineage(view_parents(s, d)), 0, 101, "Nation").select("id", "name")


RUNS = "rd AS (SELECT event_id AS owner_id, event_id % 37 AS run_id, CASE WHEN event_id % 2 = 0 THEN 'symbol' ELSE 'reference' END AS owner_type, CASE WHEN event_id % 3 = 0 THEN 'hidden' ELSE 'visible' END AS decision FROM events)"


@query("SELECT owner_id, run_id FROM rd WHERE run_id = (SELECT max(run_id) FROM rd) AND owner_type = 'symbol' AND decision = 'visible'", RUNS)
def latest_decisions(s, d):
    e = F.col("event_id")
    rows = P.table(s, d, "events").select(e.alias("owner_id"), (e % 37).alias("run_id"), F.when(e % 2 == 0, "symbol").otherwise("reference").alias("owner_type"), F.when(e % 3 == 0, "hidden").otherwise("visible").alias("decision"))
    return relational.latest_decisions(rows, "symbol", "visible").select("owner_id", "run_id")


@query("SELECT resource_id, round(max(score), 6) AS filter_score, min(tier) AS tier FROM (SELECT CASE WHEN id % 2 = 0 THEN 'symbol' ELSE 'file' END AS owner_type, id % 500 AS owner_key, id AS resource_id FROM elements) m JOIN (SELECT CASE WHEN element_id % 3 = 0 THEN 'symbol' ELSE 'file' END AS owner_type, element_id % 500 AS owner_key, score, tier FROM decisions) x USING (owner_type, owner_key) GROUP BY 1")
def owner_signals(s, d):
    m = P.elements(s, d).select(F.when(F.col("id") % 2 == 0, "symbol").otherwise("file").alias("owner_type"), (F.col("id") % 500).alias("owner_key"), F.col("id").alias("resource_id"))
    x = P.decisions(s, d).select(F.when(F.col("element_id") % 3 == 0, "symbol").otherwise("file").alias("owner_type"), (F.col("element_id") % 500).alias("owner_key"), "score", "tier")
    return relational.owner_signals(m, x).withColumn("filter_score", F.round("filter_score", 6))


@query("SELECT element_id, other, count(*) AS n, CASE WHEN bool_or(o) AND bool_or(i) THEN 'top' WHEN bool_or(i) THEN 'left' WHEN bool_or(o) THEN 'right' ELSE 'bottom' END AS position FROM (SELECT source_element_id AS element_id, target_element_id AS other, line % 4 IN (0, 1) AS o, line % 4 IN (0, 2) AS i FROM connectors UNION ALL SELECT target_element_id, source_element_id, line % 4 IN (0, 2), line % 4 IN (0, 1) FROM connectors) GROUP BY 1, 2")
def directed_neighbours(s, d):
    way = F.element_at(F.array(*map(F.lit, ["both", "forward", "backward", "none"])), F.col("line") % 4 + 1)
    return relational.directed_neighbours(P.connectors(s, d).withColumn("direction", way))


@query("SELECT id, current_key FROM (SELECT id, 'stable:' || (id + CASE WHEN id % 9 = 0 THEN 10000000 ELSE 0 END) AS current_key FROM sym) WHERE current_key NOT IN (SELECT 'stable:' || id FROM sym)", SYMBOLS)
def orphan_identities(s, d):
    e = _symbols(s, d).select("id", _text("stable:", F.col("id")).alias("stable_key"))
    i = e.select("id", _text("stable:", F.col("id") + F.when(F.col("id") % 9 == 0, 10000000).otherwise(0)).alias("current_key"))
    return relational.orphans(i, e).select("id", "current_key")


@query("SELECT s.key, i.identity FROM (SELECT 'k' || id AS key FROM sym) s JOIN (SELECT 'k' || (id * 2) AS key, 'i' || id AS identity FROM sym) i USING (key)", SYMBOLS)
def identified_symbols(s, d):
    e = _symbols(s, d)
    return resolve.identified(e.select(_text("k", F.col("id")).alias("key")), e.select(_text("k", F.col("id") * 2).alias("current_key"), _text("i", F.col("id")).alias("identity")))


TAGS = "tg AS (SELECT DISTINCT source_element_id AS owner, 's' || (target_element_id % 100) AS tag FROM connectors UNION SELECT source_element_id, 'owner:' || (source_element_id % 7) FROM connectors UNION SELECT source_element_id, 'lang:' || (source_element_id % 300) FROM connectors), nn AS (SELECT count(DISTINCT owner) AS n FROM tg), df AS (SELECT tag, count(*) AS df FROM tg GROUP BY 1), ok AS (SELECT tag, df FROM df WHERE tag LIKE 'owner:%' OR tag LIKE 'lang:%' OR (df >= 2 AND df <= floor(0.70 * (SELECT n FROM nn))))"


@query("SELECT owner, tag FROM (SELECT owner, tag, row_number() OVER (PARTITION BY owner ORDER BY CASE WHEN tag LIKE 'owner:%' OR tag LIKE 'lang:%' THEN 0 ELSE 1 END, df, tag) AS r FROM tg JOIN ok USING (tag)) WHERE r <= 2 OR tag LIKE 'owner:%'", TAGS)
def pruned_tags(s, d):
    c = P.connectors(s, d)
    o = F.col("source_element_id")
    tags = c.select(o.alias("owner"), F.explode(F.array(_text("s", F.col("target_element_id") % 100), _text("owner:", o % 7), _text("lang:", o % 300))).alias("tag"))
    return relational.pruned_tags(tags, ("owner:", "lang:"), ("owner:",), 2)


PAIRS = "rp AS (SELECT 'd' || (source_element_id % 12) || '/f' || (source_element_id % 40) || '.go' AS source_path, CASE WHEN target_element_id % 50 = 0 THEN 'main.go' ELSE 'd' || (target_element_id % 9) || '/g' || (target_element_id % 40) || '.go' END AS target_path FROM connectors), fp AS (SELECT source_path, target_path, count(*) AS n, split_part(source_path, '/', 1) AS a, CASE WHEN contains(target_path, '/') THEN split_part(target_path, '/', 1) ELSE '.' END AS b FROM rp WHERE source_path <> target_path GROUP BY ALL), pp AS (SELECT a, b, sum(n)::BIGINT AS total FROM fp WHERE a <> b GROUP BY 1, 2)"


@query("SELECT * FROM (SELECT a AS source, b AS target, total AS n, total || ' references' AS label FROM pp WHERE total > 150 UNION ALL SELECT source_path, target_path, n, NULL FROM fp WHERE a <> b AND (a, b) IN (SELECT (a, b) FROM pp WHERE total <= 150)) ORDER BY n DESC, source, target LIMIT 100", PAIRS)
def folder_pairs(s, d):
    a, b = F.col("source_element_id"), F.col("target_element_id")
    refs = P.connectors(s, d).select(_text("d", a % 12, "/f", a % 40, ".go").alias("source_path"), F.when(b % 50 == 0, "main.go").otherwise(_text("d", b % 9, "/g", b % 40, ".go")).alias("target_path"))
    return relational.folder_pairs(refs, 150)


@query("SELECT view_id, element_id, floor((row_number() OVER (PARTITION BY view_id ORDER BY element_id) - 1) / floor(20 * least(2.0::DOUBLE, 1 + 0.25::DOUBLE * max(element_id % 6) OVER (PARTITION BY view_id))))::BIGINT AS chunk FROM placements")
def tiered_chunks(s, d):
    p = P.placements(s, d).withColumn("tier", F.col("element_id") % 6)
    return relational.tiered_chunks(p, "view_id", ["element_id"], 20, "tier").select("view_id", "element_id", "chunk")


HASHED = SYMBOLS + """, gl AS (SELECT id % 5 AS repository_id, 0 AS part, 's:k' || id || ':' || name AS line FROM sym UNION ALL SELECT source_element_id % 5, 1, 'r:k' || source_element_id || ':k' || target_element_id || ':' || relationship || ':' || id FROM connectors UNION ALL SELECT doc_id % 5, 2, 'f:' || enricher || ':' || file_path || ':' || type FROM facts)"""


@query("SELECT repository_id, sha256(string_agg(h, chr(10) ORDER BY chunk)) AS hash FROM (SELECT repository_id, (r - 1) // 1000 AS chunk, sha256(string_agg(line, chr(10) ORDER BY r)) AS h FROM (SELECT repository_id, line, row_number() OVER (PARTITION BY repository_id ORDER BY part, line) AS r FROM gl) GROUP BY 1, 2) GROUP BY 1", HASHED)
def graph_hash(s, d):
    e = _symbols(s, d).select("id", (F.col("id") % 5).alias("repository_id"), _text("k", F.col("id")).alias("stable_key"), F.col("name").alias("content_hash"))
    r = P.connectors(s, d).select((F.col("source_element_id") % 5).alias("repository_id"), F.col("source_element_id").alias("source"), F.col("target_element_id").alias("target"), F.col("relationship").alias("kind"), F.col("id").cast("string").alias("evidence"))
    f = P.facts(s, d).select((F.col("doc_id") % 5).alias("repository_id"), "enricher", F.col("file_path").alias("stable_key"), F.col("type").alias("hash"))
    return versions.graph_hash(e, r, f)


@query("""SELECT owner_type, change_type, count(*) AS n, coalesce(sum(resource_id), 0)::BIGINT AS ids FROM (
  SELECT coalesce(b.t, a.t) AS owner_type, coalesce(a.id, b.id) AS resource_id, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'deleted' WHEN b.h <> a.h OR b.id <> a.id THEN 'updated' END AS change_type
  FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'fact' ELSE 'symbol' END AS t, o_orderkey % 5 AS h, o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 4 <> 0) b
  FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'fact' ELSE 'symbol' END AS t, o_orderkey % 5 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS h, o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS id FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 4 <> 0) a ON a.k = b.k) WHERE change_type IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'repository', 'updated', 1, 0""")
def full_diff(s, d):
    o, k = P.table(s, d, "orders"), F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "fact").otherwise("symbol")
    side = lambda where, h, i: o.where(where).select(kind.alias("owner_type"), k.cast("string").alias("owner_key"), kind.alias("resource_type"), i.alias("resource_id"), h.cast("string").alias("hash"))
    out = versions.full_diff(side("o_orderkey % 7 <> 0", k % 5, k), side("o_orderkey % 6 <> 0", k % 5 + F.when(k % 11 == 0, 1).otherwise(0), k + F.when(k % 13 == 0, 1).otherwise(0)), "repo")
    return out.groupBy("owner_type", "change_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("resource_id"), F.lit(0)).alias("ids"))


@query("SELECT repository_id, coalesce(f, 0)::BIGINT AS files, coalesce(y, 0)::BIGINT AS symbols, coalesce(r, 0)::BIGINT AS references, run_id, status FROM (SELECT s_suppkey % 20 AS repository_id, count(*) AS f FROM supplier GROUP BY 1) FULL JOIN (SELECT l_suppkey % 30 AS repository_id, count(*) AS y FROM lineitem GROUP BY 1) USING (repository_id) FULL JOIN (SELECT o_custkey % 25 AS repository_id, count(*) AS r FROM orders GROUP BY 1) USING (repository_id) FULL JOIN (SELECT user_id AS repository_id, max(event_id) AS run_id, max_by(event_type, event_id) AS status FROM events GROUP BY 1) USING (repository_id)".replace("AS references", 'AS "references"'))
def repository_summary(s, d):
    rep = lambda t, c, m: P.table(s, d, t).select((F.col(c) % m).alias("repository_id"))
    runs = P.table(s, d, "events").select(F.col("user_id").alias("repository_id"), F.col("event_id").alias("run_id"), F.col("event_type").alias("status"))
    return versions.repository_summary(rep("supplier", "s_suppkey", 20), rep("lineitem", "l_suppkey", 30), rep("orders", "o_custkey", 25), runs)


@query("SELECT path, type, n, n || ' ' || type || CASE WHEN n = 1 THEN ' fact' ELSE ' facts' END AS label, tags FROM (SELECT enricher AS path, type, count(*) AS n, string_agg(DISTINCT 't' || (doc_id % 4), ',' ORDER BY 't' || (doc_id % 4)) AS tags FROM facts GROUP BY 1, 2)")
def fact_summaries(s, d):
    f = P.facts(s, d).select(F.col("enricher").alias("path"), "type", F.array(_text("t", F.col("doc_id") % 4)).alias("tags"))
    return versions.fact_summaries(f).withColumn("tags", F.array_join("tags", ","))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'db.prod' WHEN 1 THEN 'cache' WHEN 2 THEN 'x.org' END AS host, CASE p_partkey % 4 WHEN 0 THEN 5432 WHEN 1 THEN 6379 END AS port, CASE p_partkey % 4 WHEN 0 THEN 'postgres' WHEN 2 THEN 'https' END AS protocol FROM part")
def parsed_endpoints(s, d):
    k = F.col("p_partkey")
    e = naming.endpoint(F.when(k % 4 == 0, "Postgres://u:p@DB.prod:5432/x").when(k % 4 == 1, " cache:6379 ").when(k % 4 == 2, "https://x.org/a?b").otherwise(F.col("p_name")))
    return P.table(s, d, "part").select(k, e["host"].alias("host"), e["port"].alias("port"), e["protocol"].alias("protocol"))


@query("SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(p_name) - k + 2), lambda i: p_name[i:i + k - 1])) AS g FROM part, (SELECT unnest([3, 4, 5]) AS k) u) GROUP BY 1")
def all_char_ngrams(s, d):
    grams = F.concat(*[text.char_ngrams(F.col("p_name"), n) for n in (3, 4, 5)])
    return P.table(s, d, "part").select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'datastore' WHEN 1 THEN 'component' WHEN 2 THEN 'external' ELSE 'component' END AS class, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN lower(p_type) WHEN 2 THEN trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') WHEN 3 THEN CASE WHEN p_partkey % 8 = 3 THEN NULL ELSE 'my-store' END END AS family FROM part")
def dependency_families(s, d):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "datastore").when(k % 4 == 2, "external").otherwise("service")
    technology = F.when((k % 4).isin(0, 1), F.col("p_type")).when(k % 4 == 3, "Docker Compose").otherwise("")
    tags = F.when((k % 4 == 3) & (k % 8 != 3), F.array(F.lit("x"), F.lit(" Datastore:My Store")))
    return P.table(s, d, "part").select(k, naming.component_class(kind).alias("class"), naming.dependency_family(kind, F.col("p_name"), technology, tags).alias("family"))


@query("SELECT p_partkey, 'a,b' || CASE WHEN p_brand NOT IN ('a', 'b') THEN ',' || p_brand ELSE '' END AS names, 'a,' || p_type AS both, greatest(-4, least(4, p_size - 20))::INT AS delta, floor(50 * least(2.0::DOUBLE, 1 + 0.25::DOUBLE * greatest(p_size % 7 - 1, 0)))::BIGINT AS most FROM part")
def small_rules(s, d):
    size = F.col("p_size")
    names = naming.unique_in_order(F.array(F.lit(" a"), F.lit("b"), F.lit(""), F.lit("a "), F.col("p_brand")))
    both = naming.united(F.array(F.lit("a")), F.array(F.lit("a"), F.col("p_type"), F.col("p_brand")), 2)
    return P.table(s, d, "part").select("p_partkey", F.array_join(names, ",").alias("names"), F.array_join(both, ",").alias("both"), naming.clamped(size - 20, -4, 4).cast("int").alias("delta"), naming.effective_maximum(50, size % 7 - 1).alias("most"))


ZOOM = LINEAGE + """,
pos AS (SELECT view_id, element_id, (element_id % 7 * 260)::DOUBLE AS x, (element_id % 11 * 160)::DOUBLE AS y FROM placements), hd AS (SELECT view_id, max(depth) AS d FROM cl GROUP BY 1),
off AS (SELECT u.view_id AS step, p.x * pow(0.25, h.d) AS ox, p.y * pow(0.25, h.d) AS oy FROM cl u JOIN views v ON v.id = u.view_id JOIN pos p ON p.view_id = u.ancestor_id AND p.element_id = v.owner_element_id JOIN hd h ON h.view_id = u.ancestor_id WHERE u.depth = 1),
org AS (SELECT cl.view_id, coalesce(sum(ox), 0) AS ox, coalesce(sum(oy), 0) AS oy FROM cl LEFT JOIN off ON off.step = cl.ancestor_id GROUP BY 1)"""


@query("SELECT view_id, element_id, round(ox + x * pow(0.25, d), 6) AS x, round(oy + y * pow(0.25, d), 6) AS y, pow(0.25, d)::DOUBLE AS size FROM pos JOIN org USING (view_id) JOIN hd USING (view_id)", ZOOM, True)
def zoom_layout(s, d):
    e = F.col("element_id")
    placed = P.placements(s, d).withColumns({"x": (e % 7 * 260).cast("double"), "y": (e % 11 * 160).cast("double")})
    return layout.zoom_layout(placed, graph.lineage(view_parents(s, d)), P.views(s, d))


VALID = """ve AS (SELECT 'e' || c_custkey AS ref, CASE WHEN c_custkey % 11 = 0 THEN '  ' WHEN c_custkey % 13 = 0 THEN '<<<<<<< ours' ELSE 'n' || (c_custkey % 900) END AS name, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'service' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 's' || (c_custkey % 50) END AS symbol, 'f' || (c_custkey % 10) AS file_path FROM customer), vc AS (SELECT 'c' || o_orderkey AS ref, 'e' || o_custkey AS source, 'e' || (o_orderkey % 2000) AS target FROM orders), vs AS (SELECT DISTINCT 'f' || (c_custkey % 10) AS path, 's' || (c_custkey % 40) AS name FROM customer)"""


@query("""SELECT 'required_field' AS rule, ref FROM ve WHERE trim(name) = '' OR kind IS NULL UNION ALL SELECT 'duplicate_name', ref FROM (SELECT ref, min(ref) OVER (PARTITION BY name) AS first FROM ve WHERE trim(name) <> '') WHERE ref <> first
UNION ALL SELECT DISTINCT 'dangling_reference', ref FROM vc WHERE source NOT IN (SELECT ref FROM ve) OR target NOT IN (SELECT ref FROM ve) UNION ALL SELECT 'conflict_marker', ref FROM ve WHERE name LIKE '<<<<<<<%'
UNION ALL SELECT 'missing_symbol', ref FROM ve WHERE symbol IS NOT NULL AND NOT EXISTS (SELECT 1 FROM vs WHERE vs.path = ve.file_path AND vs.name = ve.symbol)""", VALID)
def workspace_validation(s, d):
    c = F.col("c_custkey")
    cust = P.table(s, d, "customer")
    e = cust.select(_text("e", c).alias("ref"), F.when(c % 11 == 0, "  ").when(c % 13 == 0, "<<<<<<< ours").otherwise(_text("n", c % 900)).alias("name"), F.when(c % 17 != 0, "service").alias("kind"), F.when(c % 3 == 0, _text("s", c % 50)).alias("symbol"), _text("f", c % 10).alias("file_path"))
    k = P.table(s, d, "orders").select(_text("c", F.col("o_orderkey")).alias("ref"), _text("e", F.col("o_custkey")).alias("source"), _text("e", F.col("o_orderkey") % 2000).alias("target"))
    return lint.validate(e, k, cust.select(_text("f", c % 10).alias("path"), _text("s", c % 40).alias("name")).distinct())


CONTEXT = LINEAGE + """,
up AS (SELECT DISTINCT element_id, element_id AS proxy FROM placements WHERE view_id = 1003 UNION SELECT p.element_id, v.owner_element_id FROM placements p JOIN cl ON cl.view_id = p.view_id JOIN views v ON v.id = cl.ancestor_id JOIN placements q ON q.element_id = v.owner_element_id WHERE q.view_id = 1003),
hd AS (SELECT view_id, max(depth) AS d FROM cl GROUP BY 1), hm AS (SELECT h.element_id AS y, v.owner_element_id AS owner FROM (SELECT element_id, min(p.view_id) AS home FROM placements p JOIN hd USING (view_id) WHERE d <= 3 GROUP BY 1) h LEFT JOIN views v ON v.id = h.home),
bo AS (SELECT source_element_id AS x, target_element_id AS y FROM connectors UNION ALL SELECT target_element_id, source_element_id FROM connectors),
ff AS (SELECT up.proxy AS inside, bo.y, hm.owner FROM bo JOIN up ON up.element_id = bo.x JOIN hm ON hm.y = bo.y WHERE bo.y NOT IN (SELECT element_id FROM up)),
sh AS (SELECT owner FROM (SELECT DISTINCT owner, y FROM ff) WHERE owner IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"""


@query("SELECT inside, CASE WHEN sh.owner IS NOT NULL THEN ff.owner ELSE y END AS outside, count(*) AS n, sh.owner IS NOT NULL AS collapsed FROM ff LEFT JOIN sh ON sh.owner = ff.owner GROUP BY 1, 2, 4", CONTEXT, True)
def context_proxies(s, d):
    return crossview.context_proxies(P.connectors(s, d), P.placements(s, d), graph.lineage(view_parents(s, d)), P.views(s, d), 1003, 3)


@query("""SELECT type, view_id, element_id, name, rank::INT AS rank FROM (
  SELECT * FROM (SELECT 'view' AS type, id AS view_id, NULL::BIGINT AS element_id, name, CASE WHEN lower(name) = 'asia' THEN 0 WHEN lower(name) LIKE 'asia%' THEN 1 ELSE 2 END AS rank FROM views WHERE lower(name) LIKE '%asia%' ORDER BY rank, name, view_id LIMIT 4)
  UNION ALL SELECT * FROM (SELECT 'element', p.view_id, p.element_id, e.name, CASE WHEN lower(name) = 'asia' THEN 0 WHEN lower(name) LIKE 'asia%' THEN 1 WHEN lower(name) LIKE '%asia%' THEN 2 ELSE 3 END AS rank FROM placements p JOIN elements e ON e.id = p.element_id WHERE lower(name) LIKE '%asia%' OR e.id % 30 = 7 ORDER BY rank, name, element_id, view_id LIMIT 6)) ORDER BY type DESC, rank, name, view_id, element_id LIMIT 8""")
def jump_targets(s, d):
    e = P.elements(s, d).select(F.col("id").alias("element_id"), "name", "kind", "technology", F.when(F.col("id") % 30 == 7, "src/Asia.go").alias("path"), F.when(F.col("id") % 60 == 7, F.array(F.lit("x"), F.lit("inASIA"))).alias("tags"))
    placed = P.placements(s, d).join(e, "element_id")
    return relational.jump_targets(P.views(s, d), placed.union(placed.where("element_id % 2 = 0")), " Asia ")


# -- a repository as a workspace ----------------------------------------------

REPOSITORY = """ms AS (SELECT 's' || lpad(p_partkey::VARCHAR, 8, '0') AS key, p_name AS name, 'src/b' || (p_size % 5) || '/' || CASE WHEN p_size % 2 = 0 THEN 'in/' ELSE '' END || 'f' || (p_partkey % 7) || '.go' AS path, (p_partkey * 31 % 1000)::BIGINT AS line FROM part),
mc AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY path) > 3 THEN (row_number() OVER (PARTITION BY path ORDER BY line, key) - 1) // 3 END AS chunk FROM ms),
mh AS (SELECT path, chunk, 'cluster:' || sha256(path || chr(10) || string_agg(key, chr(10) ORDER BY key)) AS ck FROM mc WHERE chunk IS NOT NULL GROUP BY 1, 2),
ml AS (SELECT mc.*, ck, list_concat(['repository:1'], list_transform(range(1, len(string_split(mc.path, '/'))), lambda k: 'folder:' || array_to_string(string_split(mc.path, '/')[:k], '/')), ['file:' || mc.path], CASE WHEN ck IS NOT NULL THEN [ck] ELSE [] END, ['symbol:' || key]) AS chain FROM mc LEFT JOIN mh USING (path, chunk)),
mo AS (SELECT DISTINCT chain[k] AS owner_key, chain[k - 1] AS parent FROM ml, LATERAL (SELECT unnest(range(1, len(chain) + 1)) AS k)),
kn AS (SELECT 'symbol:' || key AS owner_key, (substr(key, 2)::BIGINT + 7) AS id, 'mine ' || key AS name, substr(key, 2)::BIGINT % 10 = 0 AS edited FROM ms WHERE substr(key, 2)::BIGINT % 2 = 0),
mn AS (SELECT owner_key, parent, split_part(owner_key, ':', 1) AS kind, CASE split_part(owner_key, ':', 1) WHEN 'repository' THEN 0 WHEN 'folder' THEN 1 WHEN 'file' THEN 2 WHEN 'cluster' THEN 3 ELSE 4 END AS level FROM mo),
md AS (SELECT mn.*, coalesce(y.line, h.chunk, 0) AS line, CASE WHEN kn.edited THEN kn.name WHEN kind = 'repository' THEN 'shop' WHEN kind = 'symbol' THEN y.name WHEN kind = 'cluster' THEN regexp_extract(h.path, '([^/:]*)$', 1) || ' cluster ' || (h.chunk + 1) ELSE regexp_extract(mn.owner_key, '([^/:]*)$', 1) END AS name, coalesce(kn.edited, false) AS dirty, kn.id AS kid
  FROM mn LEFT JOIN ms y ON mn.owner_key = 'symbol:' || y.key LEFT JOIN mh h ON h.ck = mn.owner_key LEFT JOIN kn ON kn.owner_key = mn.owner_key),
me AS (SELECT *, coalesce(kid, (SELECT max(id) FROM kn) + row_number() OVER (PARTITION BY kid IS NULL ORDER BY level, owner_key)) AS id FROM md),
mv AS (SELECT row_number() OVER (ORDER BY level, owner_key) AS id, owner_key, id AS element_id, name FROM me WHERE kind <> 'symbol')"""


def _repository(s, d):
    p, k = P.table(s, d, "part"), F.col("p_partkey")
    text_of = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    key = lambda c: text_of("s", F.lpad(c.cast("string"), 8, "0"))
    symbols = p.select(key(k).alias("key"), F.col("p_name").alias("name"), text_of("src/b", F.col("p_size") % 5, F.when(F.col("p_size") % 2 == 0, "/in/").otherwise("/"), "f", k % 7, ".go").alias("path"), (k * 31 % 1000).alias("line"))
    li = P.table(s, d, "lineitem")
    references = li.select(key(F.col("l_partkey")).alias("source"), key(F.col("l_orderkey") % 1000).alias("target"), F.col("l_returnflag").alias("kind"))
    known = p.where(k % 2 == 0).select(text_of("symbol:", key(k)).alias("owner_key"), (k + 7).alias("id"), text_of("mine ", key(k)).alias("name"), F.when(k % 10 == 0, "b").otherwise("a").alias("hash"), F.lit("a").alias("last_hash"))
    return materialise.materialised("shop", symbols, references, known, known.where("false").select("owner_key", "id"), 3)


@query("SELECT id, owner_key, kind, name, parent, dirty FROM me", REPOSITORY)
def repository_elements(s, d):
    return _repository(s, d).elements


@query("SELECT id, owner_key, element_id, name FROM mv", REPOSITORY)
def repository_views(s, d):
    return _repository(s, d).views


@query("SELECT view_id, element_id, pos % 4 * 260 AS x, pos // 4 * 160 AS y FROM (SELECT v.id AS view_id, e.id AS element_id, row_number() OVER (PARTITION BY v.id ORDER BY level, line, e.owner_key) - 1 AS pos FROM me e JOIN mv v ON v.owner_key = e.parent) UNION ALL SELECT 0, id, 0, 0 FROM me WHERE kind = 'repository'", REPOSITORY)
def repository_placements(s, d):
    return _repository(s, d).placements


@query("""SELECT v.id AS view_id, a.id AS source_id, b.id AS target_id, count(*) AS n, string_agg(DISTINCT r.kind, ',' ORDER BY r.kind) AS kinds FROM (
  SELECT l_returnflag AS kind, x.chain AS a, y.chain AS b, len(list_filter(list_zip(x.chain, y.chain), lambda z: z[1] IS NOT NULL AND z[1] IS NOT DISTINCT FROM z[2])) AS k FROM lineitem JOIN ml x ON x.key = 's' || lpad(l_partkey::VARCHAR, 8, '0') JOIN ml y ON y.key = 's' || lpad((l_orderkey % 1000)::VARCHAR, 8, '0') WHERE x.key <> y.key) r
JOIN mv v ON v.owner_key = r.a[k] JOIN me a ON a.owner_key = r.a[k + 1] JOIN me b ON b.owner_key = r.b[k + 1] GROUP BY 1, 2, 3""", REPOSITORY)
def repository_connectors(s, d):
    c = _repository(s, d).connectors
    return c.withColumn("kinds", F.array_join("kinds", ","))
