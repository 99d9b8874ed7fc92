"""Queries on views, versions, workspaces and streams (A, W, T, G, F, R, U and M families)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborlens.functions import embedding, enrich
from arborlens.operators import architecture, crossview, graph, layout, linediff, resolve, sections, versions, workspace
from arborlens.plans import projection as P
from arborlens.plans.registry import LINEAGE, PROXIES, query, view_parents
from arborlens.streaming import changes


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# -- hierarchy and layout ----------------------------------------------------


@query("SELECT cl.view_id, cl.ancestor_id, coalesce(string_agg(v.owner_element_id::VARCHAR, '/' ORDER BY i.depth DESC), '') AS path FROM cl LEFT JOIN cl i ON i.view_id = cl.view_id AND i.depth < cl.depth LEFT JOIN views v ON v.id = i.ancestor_id GROUP BY 1, 2", LINEAGE, True)
def owner_path(s, d):
    return graph.owner_paths(graph.lineage(view_parents(s, d)), P.views(s, d)).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


@query("SELECT v.owner_element_id AS element_id, min(p.view_id) AS from_view_id, min(v.id) AS to_view_id, min_by(v.name, v.id) AS to_view_name FROM views v JOIN placements p ON p.element_id = v.owner_element_id AND p.view_id <> v.id GROUP BY 1")
def navigation_edges(s, d):
    return graph.navigations(P.views(s, d), P.placements(s, d))


@query("SELECT cl.view_id, max(cl.depth)::INT AS depth, string_agg(v.name, '/' ORDER BY cl.depth DESC) AS path FROM cl JOIN views v ON v.id = cl.ancestor_id GROUP BY 1", LINEAGE, True)
def view_tree(s, d):
    return graph.tree(graph.lineage(view_parents(s, d)), P.views(s, d))


@query("""SELECT element_id, view_id FROM (SELECT p.element_id, p.view_id, row_number() OVER (PARTITION BY p.element_id ORDER BY CASE WHEN p.view_id = 101 THEN 0 WHEN p.view_id = 1001 THEN 10 WHEN up.depth IS NOT NULL THEN 50 + up.depth ELSE 200 + 10 * (a.da + a.db) + 2 * (b.da + b.db) - a.lcadepth END, p.view_id) AS r
FROM placements p LEFT JOIN cl up ON up.view_id = p.view_id AND up.ancestor_id = 101
JOIN (SELECT y.view_id, min(x.depth) AS da, min(y.depth) AS db, (SELECT max(depth) FROM cl WHERE view_id = 101) - min(x.depth) AS lcadepth FROM cl x JOIN cl y ON x.ancestor_id = y.ancestor_id WHERE x.view_id = 101 GROUP BY 1) a ON a.view_id = p.view_id
JOIN (SELECT y.view_id, min(x.depth) AS da, min(y.depth) AS db FROM cl x JOIN cl y ON x.ancestor_id = y.ancestor_id WHERE x.view_id = 1001 GROUP BY 1) b ON b.view_id = p.view_id) WHERE r = 1""", LINEAGE, True)
def best_placement(s, d):
    return crossview.best_placement(P.placements(s, d), graph.lineage(view_parents(s, d)), 101, 1001)


@query("""SELECT source, target, n, CASE WHEN n = 1 THEN 'single' ELSE 'group' END AS kind FROM (
  SELECT a.proxy AS source, b.proxy AS target, count(*) AS n FROM connectors c
  JOIN (SELECT element_id, proxy FROM zp WHERE r <= 2) a ON a.element_id = c.source_element_id JOIN (SELECT element_id, proxy FROM zp WHERE r <= 2) b ON b.element_id = c.target_element_id
  WHERE a.proxy <> b.proxy AND NOT (a.proxy = c.source_element_id AND b.proxy = c.target_element_id) GROUP BY 1, 2)""", LINEAGE + """,
zp AS (SELECT element_id, proxy, row_number() OVER (PARTITION BY element_id ORDER BY depth DESC, proxy) AS r FROM (
  SELECT DISTINCT p.element_id, p.element_id AS proxy, 1000 AS depth FROM placements p WHERE p.element_id % 2 = 0
  UNION SELECT p.element_id, v.owner_element_id, (SELECT max(depth) FROM cl z WHERE z.view_id = cl.ancestor_id) FROM placements p JOIN cl ON cl.view_id = p.view_id JOIN views v ON v.id = cl.ancestor_id WHERE v.owner_element_id IS NOT NULL))""", True)
def zoom_proxies(s, d):
    shown = P.elements(s, d).where("id % 2 = 0 or id < 3000000").select(F.col("id").alias("element_id"))
    return crossview.zoom_proxies(P.connectors(s, d), P.placements(s, d), graph.lineage(view_parents(s, d)), P.views(s, d), shown)


COLUMNS = """lv AS (SELECT view_id, element_id, max(level) AS level FROM (SELECT view_id, source_element_id AS element_id, 0 AS level FROM connectors UNION ALL SELECT view_id, target_element_id, 1 FROM connectors) GROUP BY 1, 2)"""


@query("SELECT view_id, element_id, ((sum(CASE WHEN r = 0 THEN (n + 5) // 6 ELSE 0 END) OVER (PARTITION BY view_id ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (n + 5) // 6 + r // 6) * 260)::BIGINT AS x, (r % 6 * 160)::BIGINT AS y FROM (SELECT *, row_number() OVER (PARTITION BY view_id, level ORDER BY element_id) - 1 AS r, count(*) OVER (PARTITION BY view_id, level) AS n FROM lv)", COLUMNS)
def level_columns(s, d):
    c = P.connectors(s, d)
    lv = c.select("view_id", F.explode(F.array(F.struct(F.col("source_element_id").alias("e"), F.lit(0).alias("level")), F.struct(F.col("target_element_id").alias("e"), F.lit(1).alias("level")))).alias("x")).groupBy("view_id", F.col("x.e").alias("element_id")).agg(F.max("x.level").alias("level"))
    return layout.level_columns(lv)


@query("SELECT view_id, element_id, (r % 4 * 260)::BIGINT AS x, (r // 4 * 160)::BIGINT AS y, (r % 4) || ':' || (r // 4) AS cell FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY element_id) - 1 AS r FROM placements)")
def grid_positions(s, d):
    return layout.grid(P.placements(s, d), 4)


@query("SELECT cell_x, cell_y, count(*) AS n, min(element_id) AS first FROM (SELECT element_id, unnest(range((x // 500)::BIGINT, ((x + 200) // 500)::BIGINT + 1)) AS cell_x, y FROM (SELECT element_id, element_id % 7 * 260 AS x, element_id % 11 * 160 AS y FROM placements)) JOIN (SELECT unnest(range(0, 10)) AS cell_y) g ON cell_y BETWEEN y // 500 AND (y + 100) // 500 GROUP BY 1, 2")
def hit_index(s, d):
    e = F.col("element_id")
    boxes = P.placements(s, d).select("element_id", (e % 7 * 260).alias("x"), (e % 11 * 160).alias("y"), F.lit(200).alias("w"), F.lit(100).alias("h"))
    return layout.hit_index(boxes, 500).groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"), F.min("element_id").alias("first"))


# -- cross view --------------------------------------------------------------


# Eight names for each n: a service, its deployable, its interface name, its contract, a generic and a concrete store, and two of a root with two letters.
CANON = """cb AS (SELECT c_custkey // 8 AS n, c_custkey % 8 AS v, 'qu' || chr((97 + c_custkey // 8 % 26)::INT) || chr((97 + c_custkey // 208 % 26)::INT) || 'm' AS w, 'x' || chr((97 + c_custkey // 8 % 26)::INT) AS x, ['redis', 'kafka', 'mysql'][(c_custkey // 8 % 3 + 1)::INT] AS f FROM customer),
cc AS (SELECT n, v, CASE v WHEN 0 THEN 'component:' || w WHEN 1 THEN 'component:' || w || 'service' WHEN 2 THEN 'component:' || w || '-api' WHEN 3 THEN 'contract:' || w || 'service' WHEN 4 THEN 'datastore:' || f || n WHEN 5 THEN 'component:' || f || '-' || w WHEN 6 THEN 'component:' || x || n ELSE 'component:' || x || n || 'service' END AS key,
  CASE v WHEN 0 THEN w WHEN 1 THEN w || 'service' WHEN 2 THEN w || 'API' WHEN 3 THEN w || 'Service' WHEN 4 THEN f WHEN 5 THEN f || '-' || w WHEN 6 THEN x ELSE x || 'service' END AS name,
  CASE v WHEN 3 THEN 'interface' WHEN 4 THEN 'datastore' ELSE 'service' END AS kind, CASE v WHEN 0 THEN w WHEN 1 THEN w WHEN 2 THEN w WHEN 3 THEN w WHEN 5 THEN f || '-' || w WHEN 6 THEN x WHEN 7 THEN x END AS root, v IN (0, 1, 3, 6, 7) AND n % 5 > 0 AS strong, v IN (1, 2, 3, 7) AS role,
  CASE WHEN v IN (4, 5) THEN f END AS family, v = 4 AS generic, CASE v WHEN 1 THEN 0 WHEN 3 THEN 0 WHEN 0 THEN 3 WHEN 7 THEN 1 WHEN 6 THEN 1 ELSE 5 END AS alias0 FROM cb),
c1 AS (SELECT *, lower(name) AS slug, kind = 'interface' AS itf,
  CASE WHEN length(root) >= 3 THEN CASE WHEN v = 5 THEN 5 WHEN v = 2 THEN 5 WHEN v = 0 AND n % 5 > 0 THEN 3 ELSE alias0 END WHEN v IN (6, 7) AND n % 5 > 0 THEN 1 WHEN v IN (6, 7) THEN 5 END AS alias, CASE WHEN key LIKE 'component:%' THEN '0' WHEN key LIKE 'datastore:%' THEN '1' ELSE '3' END || key AS rk FROM cc),
ce AS (SELECT a.key AS source, b.key AS target FROM c1 a JOIN c1 b ON (a.n = b.n AND a.v = 0 AND b.v IN (4, 5)) OR (a.n = b.n AND a.n % 2 = 0 AND a.v = 2 AND b.v = 1) OR (a.v = 0 AND a.n % 4 = 0 AND b.n = a.n + 3 AND b.v = 5)),
r1 AS (SELECT key, min_by(key, rk) OVER (PARTITION BY g) AS rep FROM (SELECT key, rk, CASE WHEN itf = hi THEN h ELSE key END AS g FROM c1 JOIN (SELECT slug, min(key) AS h, min_by(itf, key) AS hi FROM c1 GROUP BY 1) USING (slug)))"""
# Joins of sets by links (p, c), and what stands for a joined set: a parent of the best name.
STEP = """l{i} AS (SELECT DISTINCT a.rep AS p, b.rep AS c, h.alias, h.key AS hub FROM c1 k JOIN (SELECT root, min_by(key, lpad(alias::VARCHAR, 2, '0') || key) AS key, min(alias) AS alias, min_by(strong, lpad(alias::VARCHAR, 2, '0') || key) AS strong, min_by(role, lpad(alias::VARCHAR, 2, '0') || key) AS role FROM c1 WHERE {which} GROUP BY 1) h ON h.root = k.root AND h.key <> k.key
  JOIN r{j} a ON a.key = h.key JOIN r{j} b ON b.key = k.key WHERE k.{which} AND a.rep <> b.rep AND CASE WHEN length(k.root) < 3 THEN k.strong AND h.strong AND (k.role OR h.role) ELSE (k.strong AND h.strong) OR EXISTS (SELECT 1 FROM ce WHERE (source = k.key AND target = h.key) OR (source = h.key AND target = k.key)) END),
t{i} AS (SELECT DISTINCT rep AS a, rep AS b FROM r{j} UNION SELECT t.a, x.d FROM t{i} t JOIN (SELECT p AS s, c AS d FROM l{i} UNION SELECT c, p FROM l{i}) x ON x.s = t.b),
r{i} AS (SELECT r.key, z.top AS rep FROM r{j} r JOIN (SELECT t.a, min_by(t.b, coalesce(o.o, '9' || t.b)) AS top FROM t{i} t LEFT JOIN (SELECT p, min(lpad(alias::VARCHAR, 2, '0') || hub) AS o FROM l{i} GROUP BY 1) o ON o.p = t.b GROUP BY 1) z ON z.a = r.rep)"""
CANON_ALL = ",\n".join([CANON, STEP.format(i=2, j=1, which="root IS NOT NULL AND length(root) >= 3").replace("k.root IS NOT NULL AND length(root) >= 3", "length(k.root) >= 3"), STEP.format(i=3, j=2, which="root IS NOT NULL"), """us AS (SELECT DISTINCT a.rep AS s, b.rep AS t, k.family, k.generic FROM ce JOIN r3 a ON a.key = source JOIN r3 b ON b.key = target JOIN c1 k ON k.key = b.rep WHERE k.family IS NOT NULL),
l4 AS (SELECT DISTINCT o.a, u.t AS b FROM us u JOIN (SELECT s, family, min(t) AS a FROM us WHERE NOT generic GROUP BY 1, 2 HAVING count(DISTINCT t) = 1) o USING (s, family) WHERE u.generic),
t4 AS (SELECT DISTINCT rep AS a, rep AS b FROM r3 UNION SELECT t.a, x.d FROM t4 t JOIN (SELECT a AS s, b AS d FROM l4 UNION SELECT b, a FROM l4) x ON x.s = t.b)"""])


@query("SELECT r.key, z.top AS canonical FROM r3 r JOIN (SELECT t.a, min_by(t.b, c.rk) AS top FROM t4 t JOIN c1 c ON c.key = t.b GROUP BY 1) z ON z.a = r.rep", CANON_ALL, True)
def canonical_components(s, d):
    k = F.col("c_custkey")
    letter = lambda c: F.char((97 + c % 26).cast("int"))
    b = P.table(s, d, "customer").select(F.floor(k / 8).alias("n"), (k % 8).alias("v"))
    b = b.withColumns({"w": _text("qu", letter(F.col("n")), letter(F.floor(F.col("n") / 26)), "m"), "x": _text("x", letter(F.col("n"))), "f": F.element_at(F.array(*map(F.lit, ["redis", "kafka", "mysql"])), (F.col("n") % 3 + 1).cast("int"))})
    w, x, f, n, v = (F.col(c) for c in "wxfnv")
    each = lambda *texts: F.element_at(F.array(*[t if not isinstance(t, str) else F.lit(t) for t in texts]), (v + 1).cast("int"))
    c = b.select(n, v, each(_text("component:", w), _text("component:", w, "service"), _text("component:", w, "-api"), _text("contract:", w, "service"), _text("datastore:", f, n), _text("component:", f, "-", w), _text("component:", x, n), _text("component:", x, n, "service")).alias("key"),
        each(w, _text(w, "service"), _text(w, "API"), _text(w, "Service"), f, _text(f, "-", w), x, _text(x, "service")).alias("name"), F.when(v == 3, "interface").when(v == 4, "datastore").otherwise("service").alias("kind"), F.when(v == 5, f).alias("technology"),
        F.when(v == 4, F.array(_text("datastore:", f))).otherwise(F.array().cast("array<string>")).alias("tags"), F.when((n % 5 > 0) & v.isin(0, 1, 3, 6, 7), F.array(each("grpc.server", "deployable", "", "service-contract", "", "", "deployable", "deployable"))).alias("evidence"))
    side = lambda vs, of, key: c.where(F.col("v").isin(vs)).select((F.col("n") + of).alias("n"), F.col("key").alias(key))
    edges = side([0], 0, "source").join(side([4, 5], 0, "target"), "n").select("source", "target").union(side([2], 0, "source").where("n % 2 = 0").join(side([1], 0, "target"), "n").select("source", "target"))
    edges = edges.union(side([0], 0, "source").where("n % 4 = 0").join(side([5], -3, "target"), "n").select("source", "target"))
    return architecture.canonical(c.drop("n", "v"), edges)


BIND = """bc AS (SELECT p_partkey AS key, p_brand AS repo, p_name AS name, list_distinct(string_split(p_type || ' ' || p_name, ' ')) AS tokens, ['src/' || p_type || '/' || p_brand || '/a' || (p_size % 5) || '.go'] AS paths FROM part WHERE p_partkey % 20 = 0),
bt AS (SELECT p_partkey AS id, p_brand AS repo, ['folder', 'symbol', 'fact', 'fact-summary', 'file'][p_partkey % 5 + 1] AS type, p_name AS name, list_distinct(string_split(p_type || ' ' || p_name, ' ')) AS tokens, CASE WHEN p_partkey % 5 = 0 THEN 'src/' || p_type ELSE 'src/' || p_type || '/' || p_brand || '/a' || (p_size % 5) || '.go' END AS path FROM part),
bs AS (SELECT key, id, round(least(1.0::DOUBLE, CASE WHEN c.repo = t.repo THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN c.name = t.name THEN 0.42::DOUBLE ELSE 0 END + CASE WHEN len(list_intersect(c.tokens, t.tokens)) >= 2 THEN 0.16::DOUBLE ELSE 0 END
  + CASE WHEN paths[1] = path THEN 0.78::DOUBLE WHEN type = 'folder' AND starts_with(paths[1], path || '/') THEN 0.66::DOUBLE WHEN regexp_extract(paths[1], '^(.*)/[^/]*$', 1) = regexp_extract(path, '^(.*)/[^/]*$', 1) THEN 0.30::DOUBLE ELSE 0 END
  + CASE WHEN type = 'symbol' AND c.name = t.name THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN type = 'fact' AND c.name = t.name THEN 0.20::DOUBLE ELSE 0 END - CASE WHEN type = 'fact-summary' THEN 0.08::DOUBLE ELSE 0 END), 6) AS score, paths[1] = path OR (type = 'folder' AND starts_with(paths[1], path || '/')) AS concrete FROM bc c JOIN bt t ON true),
br AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt, lead(concrete) OVER w AS nc FROM bs WHERE score >= 0.72 WINDOW w AS (PARTITION BY key ORDER BY score DESC, id))"""


@query("SELECT key, id, score, rank FROM br WHERE rank <= 12 AND key NOT IN (SELECT key FROM br WHERE rank = 1 AND round(score - nxt, 6) <= 0.02 AND NOT concrete AND NOT nc)", BIND)
def architecture_bindings(s, d):
    p, k = P.table(s, d, "part"), F.col("p_partkey")
    tokens = F.array_distinct(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).alias("tokens")
    path = _text("src/", F.col("p_type"), "/", F.col("p_brand"), "/a", F.col("p_size") % 5, ".go")
    c = p.where(k % 20 == 0).select(k.alias("key"), F.col("p_brand").alias("repo"), F.col("p_name").alias("name"), tokens, F.array(path).alias("paths"))
    t = p.select(k.alias("id"), F.col("p_brand").alias("repo"), F.element_at(F.array(*map(F.lit, ["folder", "symbol", "fact", "fact-summary", "file"])), (k % 5 + 1).cast("int")).alias("type"), F.col("p_name").alias("name"), tokens, F.when(k % 5 == 0, _text("src/", F.col("p_type"))).otherwise(path).alias("path"))
    return architecture.bindings(c, t)


# -- versions ----------------------------------------------------------------

TWO = """vb AS (SELECT o_orderkey AS key, o_orderkey % 5 AS hash FROM orders WHERE o_orderkey % 3 <> 0), va AS (SELECT o_orderkey AS key, o_orderkey % 5 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS hash FROM orders WHERE o_orderkey % 4 <> 0),
rb AS (SELECT o_orderkey AS key, o_orderkey % 7 AS hash FROM orders WHERE o_orderkey % 2 = 0), ra AS (SELECT o_orderkey AS key, o_orderkey % 7 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS hash FROM orders WHERE o_orderkey % 9 <> 0)"""


@query("""SELECT * FROM (SELECT key, CASE WHEN vb.hash IS NULL AND rb.hash <> ra.hash THEN rb.hash ELSE vb.hash END AS before_hash, va.hash AS after_hash, CASE WHEN vb.hash IS NULL AND rb.hash <> ra.hash THEN 'updated' WHEN vb.hash IS NULL THEN 'added' WHEN va.hash IS NULL THEN 'deleted' WHEN vb.hash <> va.hash THEN 'updated' END AS change_type
FROM vb FULL JOIN va USING (key) LEFT JOIN rb USING (key) LEFT JOIN ra USING (key)) WHERE change_type IS NOT NULL""", TWO)
def promoted_diff(s, d):
    o, k = P.table(s, d, "orders"), F.col("o_orderkey")
    side = lambda where, m, bump: o.where(where).select(k.alias("key"), (k % m + (F.when(k % bump == 0, 1).otherwise(0) if bump else 0)).alias("hash"))
    return versions.promoted_diff(side("o_orderkey % 3 <> 0", 5, 0), side("o_orderkey % 4 <> 0", 5, 11), side("o_orderkey % 2 = 0", 7, 0), side("o_orderkey % 9 <> 0", 7, 13))


@query("SELECT file_path AS key, min(c) AS change_type FROM (SELECT file_path, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'updated' END AS c FROM facts UNION ALL SELECT a.file_path, CASE WHEN b.doc_id % 10 = 0 THEN 'added' WHEN b.doc_id % 10 = 1 THEN 'updated' END FROM facts a JOIN facts b ON b.doc_id = a.doc_id + 3) WHERE c IS NOT NULL GROUP BY 1")
def initial_diff(s, d):
    f = P.facts(s, d).select("doc_id", "file_path")
    near = f.select((F.col("doc_id") - 3).alias("doc_id"), F.col("file_path").alias("near"))
    snapshot = f.join(near, "doc_id", "left").groupBy(F.col("file_path").alias("key")).agg(F.array_union(F.collect_set("file_path"), F.collect_set("near")).alias("paths"))
    k = F.col("doc_id") % 10
    ch = f.select(F.col("file_path").alias("path"), F.when(k == 0, "added").when(k == 1, "updated").otherwise("deleted").alias("change_type"))
    return versions.initial_diff(snapshot, ch)


IMPORTS = "li AS (SELECT 'f' || (p_partkey % 40) || CASE WHEN p_partkey % 3 = 0 THEN '.py' ELSE '.go' END AS file, p_partkey AS line_no, CASE p_partkey % 4 WHEN 0 THEN 'import \"' || p_type || '\"' WHEN 1 THEN '  alias \"lib/' || p_brand || '\" ' WHEN 2 THEN '\"fmt\"' ELSE 'x := \"y\"' END AS line FROM part), im AS (SELECT file, line_no, CASE line_no % 4 WHEN 0 THEN regexp_extract(line, '\"(.*)\"', 1) WHEN 1 THEN regexp_extract(line, '\"(.*)\"', 1) WHEN 2 THEN 'fmt' END AS module FROM li WHERE line_no % 2 = 0 OR line_no % 5 = 0), dk AS (SELECT file, module, 'fact:dependency.import:' || file || ':' || module || ':' || line_no AS k FROM im WHERE module IS NOT NULL AND file LIKE '%.go' AND line_no % 40 < 30 AND line_no % 14 <> 0)"


@query("SELECT 'fact' AS owner_type, k AS owner_key, module AS summary FROM dk UNION ALL SELECT 'fact-import-connector', k || ':file', file || '->' || module FROM dk", IMPORTS)
def deleted_imports(s, d):
    p, k = P.table(s, d, "part"), F.col("p_partkey")
    file = _text("f", k % 40, F.when(k % 3 == 0, ".py").otherwise(".go"))
    line = F.when(k % 4 == 0, _text('import "', F.col("p_type"), '"')).when(k % 4 == 1, _text('  alias "lib/', F.col("p_brand"), '" ')).when(k % 4 == 2, '"fmt"').otherwise('x := "y"')
    lines = p.select(file.alias("file"), k.alias("line_no"), line.alias("line"))
    removed = lines.where("line_no % 2 = 0 or line_no % 5 = 0").select("file", "line_no")
    gone = lines.where("line_no % 40 < 30").select("file").distinct()
    known = lines.where("line_no % 14 = 0").withColumn("m", versions.import_of_line(F.col("line"))).select(_text("fact:dependency.import:", F.col("file"), ":", F.col("m"), ":", F.col("line_no")).alias("owner_key"))
    return versions.deleted_imports(lines, removed, gone, known)


@query("SELECT owner_type, count(*) AS n, min(owner_key) AS first, max(hash) AS last FROM (SELECT 'element' AS owner_type, id::VARCHAR AS owner_key, sha256(name) AS hash FROM elements UNION ALL SELECT 'fact', file_path, sha256(type) FROM facts UNION ALL SELECT 'view', id::VARCHAR, sha256(name) FROM views) GROUP BY 1")
def current_snapshot(s, d):
    h = lambda c: F.sha2(c, 256).alias("hash")
    snap = versions.current_snapshot(element=P.elements(s, d).select(F.col("id").alias("owner_key"), h("name")), fact=P.facts(s, d).select(F.col("file_path").alias("owner_key"), h("type")), view=P.views(s, d).select(F.col("id").alias("owner_key"), h("name")))
    return snap.groupBy("owner_type").agg(F.count("*").alias("n"), F.min("owner_key").alias("first"), F.max("hash").alias("last"))


LINES = "sy2 AS (SELECT l_orderkey * 10 + l_linenumber AS key, 'p' || (l_suppkey % 20) AS path, (l_orderkey % 500 + 1)::BIGINT AS a, (l_orderkey % 500 + l_quantity)::BIGINT AS b, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 500 + 1)::BIGINT END AS oa, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 500 + 30)::BIGINT END AS ob FROM lineitem)"


@query("SELECT path, max(coalesce(CASE WHEN key % 3 <> 0 THEN b END, a)) AS lines FROM sy2 GROUP BY 1", LINES)
def file_line_counts(s, d):
    return versions.file_lines(_ranges(s, d).withColumn("end_line", F.when(F.col("key") % 3 != 0, F.col("end_line"))))


def _ranges(s, d):
    li = P.table(s, d, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), _text("p", F.col("l_suppkey") % 20).alias("path"), (F.col("l_orderkey") % 500 + 1).alias("start_line"), (F.col("l_orderkey") % 500 + F.col("l_quantity")).cast("long").alias("end_line"), F.when(even, F.col("l_partkey") % 500 + 1).alias("old_start"), F.when(even, F.col("l_partkey") % 500 + 30).alias("old_end"))


@query("SELECT folder, sum(n)::BIGINT AS files, sum(c)::BIGINT AS chars FROM (SELECT f.folder, 1 AS n, n_chars AS c FROM facts, unnest([type, type || '/' || enricher, file_path]) AS f(folder)) GROUP BY 1")
def folder_line_counts(s, d):
    f = P.facts(s, d).select(F.col("file_path").alias("path"), F.lit(1).cast("long").alias("files"), F.col("n_chars").alias("chars"))
    return versions.under_folders(f, "files", "chars")


@query("""SELECT s.key, coalesce(count(*) FILTER (WHERE l.kind = 'added' AND l.line BETWEEN s.a AND s.b), 0)::BIGINT AS added, coalesce(count(*) FILTER (WHERE l.kind = 'removed' AND l.line BETWEEN coalesce(s.oa, s.a) AND coalesce(s.ob, s.b)), 0)::BIGINT AS removed
FROM sy2 s LEFT JOIN (SELECT 'p' || (event_id % 20) AS path, (event_id % 523)::BIGINT AS line, CASE WHEN event_id % 2 = 0 THEN 'added' ELSE 'removed' END AS kind FROM events) l ON l.path = s.path GROUP BY 1""", LINES)
def attributed_lines(s, d):
    e = F.col("event_id")
    lines = P.table(s, d, "events").select(_text("p", e % 20).alias("path"), (e % 523).alias("line"), F.when(e % 2 == 0, "added").otherwise("removed").alias("kind"))
    return versions.attributed_lines(_ranges(s, d), lines)


@query("SELECT event_type, sha256(string_agg(h, chr(10) ORDER BY chunk)) AS hash FROM (SELECT event_type, (r - 1) // 1000 AS chunk, sha256(string_agg(l, chr(10) ORDER BY r)) AS h FROM (SELECT event_type, 's:' || event_id || ':' || user_id AS l, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) GROUP BY 1, 2) GROUP BY 1")
def representation_hash(s, d):
    e = P.table(s, d, "events").select("event_type", "event_id", "user_id")
    return versions.chunked_hash(e, "event_type", ["event_id"], F.concat_ws(":", F.lit("s"), "event_id", "user_id"))


LENS = LINEAGE + ", chg AS (SELECT id AS element_id FROM elements WHERE id % 1009 = 0 OR id = 2000003 UNION ALL SELECT 99), whr AS (SELECT DISTINCT view_id FROM placements WHERE element_id IN (SELECT element_id FROM chg)), pth AS (SELECT DISTINCT ancestor_id AS view_id FROM cl WHERE view_id IN (SELECT view_id FROM whr))"


@query("""SELECT element_id, bool_or(c) AS changed, bool_or(a) AS ancestor, bool_or(s) AS sibling, bool_or(u) AS unplaced FROM (
  SELECT element_id, true AS c, false AS a, false AS s, element_id NOT IN (SELECT element_id FROM placements) AS u FROM chg UNION ALL SELECT element_id, false, false, true, false FROM placements WHERE view_id IN (SELECT view_id FROM pth)
  UNION ALL SELECT owner_element_id, false, true, false, false FROM views WHERE id IN (SELECT view_id FROM pth) AND owner_element_id IS NOT NULL) GROUP BY 1""", LENS, True)
def diff_lens(s, d):
    changed = P.elements(s, d).where("id % 1009 = 0 or id = 2000003").select(F.col("id").alias("element_id")).union(s.range(99, 100).select("id"))
    return versions.lens(changed, P.placements(s, d), graph.lineage(view_parents(s, d)), P.views(s, d))


DIFFS = "df AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'element' ELSE 'connector' END AS resource_type, CASE WHEN event_id % 2 = 0 THEN 4000000 + event_id % 1700 ELSE event_id * 10 + 1 END AS resource_id, event_type AS change_type, event_id % 9 - 3 AS added, event_id % 7 - 3 AS removed FROM events)"


@query("SELECT resource_type, resource_id, view_id, min_by(change_type, id) AS change_type, greatest(min_by(added, id), 0) AS added, greatest(min_by(removed, id), 0) AS removed FROM df JOIN (SELECT 'element' AS resource_type, element_id AS resource_id, view_id FROM placements UNION ALL SELECT 'connector', id, view_id FROM connectors) USING (resource_type, resource_id) GROUP BY 1, 2, 3", DIFFS)
def diff_locations(s, d):
    e = F.col("event_id")
    diffs = P.table(s, d, "events").select(e.alias("id"), F.when(e % 2 == 0, "element").otherwise("connector").alias("resource_type"), F.when(e % 2 == 0, 4000000 + e % 1700).otherwise(e * 10 + 1).alias("resource_id"), F.col("event_type").alias("change_type"), (e % 9 - 3).alias("added"), (e % 7 - 3).alias("removed"))
    return versions.locations(diffs, P.placements(s, d), P.connectors(s, d))


# Every line is one of its file, so what is kept is the common subsequence, and SQL finds hunks as runs of lines that are not.
@query("""SELECT file, CASE WHEN old_lines > 0 THEN o ELSE o - 1 END AS old_start, old_lines, CASE WHEN new_lines > 0 THEN n ELSE q END AS new_start, new_lines FROM (
  SELECT file, run, min(num) AS o, count(*) AS old_lines, count(*) FILTER (state = 'changed') AS new_lines, min(new) FILTER (state = 'changed') AS n, min(new) AS q FROM (
    SELECT *, sum(CASE WHEN state = 'kept' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY num) AS run, count(*) FILTER (state <> 'gone') OVER (PARTITION BY file ORDER BY num) AS new FROM (
      SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS num, CASE WHEN p_partkey % 33 < 2 THEN 'gone' WHEN p_partkey % 10 = 0 THEN 'changed' ELSE 'kept' END AS state FROM part))
  WHERE state <> 'kept' GROUP BY 1, 2)""")
def file_diff(s, d):
    p, k = P.table(s, d, "part"), F.col("p_partkey")
    number = lambda df: df.withColumn("number", F.row_number().over(Window.partitionBy("file").orderBy("p_partkey"))).select("file", "number", "line")
    line = _text(F.col("p_name"), " ", k)
    old = p.select(F.col("p_brand").alias("file"), k, line.alias("line"))
    new = p.where(k % 33 >= 2).select(F.col("p_brand").alias("file"), k, F.when(k % 10 == 0, _text(line, "!")).otherwise(line).alias("line"))
    # Small files as such would never meet an anchor: from 60 lines on they are cut.
    return linediff.hunks(number(old), number(new), small=60)


@query("SELECT event_id, repository_id FROM (SELECT event_id, user_id AS repository_id, event_type AS h, event_id % 2 AS g, lag(event_type) OVER w AS ph, lag(event_id % 2) OVER w AS pg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE h IS DISTINCT FROM ph OR g IS DISTINCT FROM pg")
def new_versions(s, d):
    e = P.table(s, d, "events").select("event_id", F.col("user_id").alias("repository_id"), F.col("event_type").alias("head"), (F.col("event_id") % 2).alias("hash"), "ts")
    return versions.new_versions(e, ["ts", "event_id"]).select("event_id", "repository_id")


@query("SELECT c_custkey AS repository_id, CASE WHEN r.t = c_nationkey % 5 AND r.st = c_custkey % 2 THEN r.run END AS run_id FROM customer LEFT JOIN (SELECT user_id, max(event_id) AS run, max_by(event_id % 5, event_id) AS t, max_by(event_id % 2, event_id) AS st FROM events WHERE event_type = 'view' GROUP BY 1) r ON r.user_id = c_custkey")
def reusable_runs(s, d):
    e = F.col("event_id")
    runs = P.table(s, d, "events").select(F.col("user_id").alias("repository_id"), e.alias("run_id"), (e % 5).alias("raw_hash"), (e % 2).alias("settings_hash"), F.when(F.col("event_type") == "view", "completed").otherwise("failed").alias("status"))
    wanted = P.table(s, d, "customer").select(F.col("c_custkey").alias("repository_id"), (F.col("c_nationkey") % 5).alias("raw_hash"), (F.col("c_custkey") % 2).alias("settings_hash"))
    return versions.reusable(wanted, runs)


@query("""SELECT id, CASE p WHEN 0 THEN 'keep,git:staged,watch:deleted' WHEN 1 THEN 'keep,git:staged' ELSE CASE WHEN id % 2 = 0 THEN 'keep' ELSE 'keep' END END AS tags, CASE p WHEN 0 THEN CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END ELSE 0 END::BIGINT AS added, CASE WHEN id % 2 = 0 AND p > 1 THEN 1 WHEN id % 2 = 1 THEN 1 ELSE 0 END::BIGINT AS removed
FROM (SELECT id, id % 4 AS p FROM elements)""")
def tag_state(s, d):
    i = F.col("id")
    e = P.elements(s, d).select("id", _text("f", i % 4).alias("path"), F.when(i % 2 == 0, F.array(F.lit("keep"), F.lit("git:staged"))).otherwise(F.array(F.lit("keep"), F.lit("git:unstaged"))).alias("tags"))
    status = s.createDataFrame([("f0", "git:staged"), ("f0", "watch:deleted"), ("f1", "git:staged")], "path string, tag string")
    return versions.tag_state(e, status).withColumn("tags", F.array_join("tags", ","))


@query("SELECT user_id AS lock, CASE WHEN bool_or(event_type = 'purchase' AND event_id % 7 = 0) THEN 'stopping' WHEN max_by(event_type, event_id) FILTER (WHERE event_type IN ('click', 'view')) = 'click' THEN 'paused' ELSE 'active' END AS state FROM events GROUP BY 1")
def control_states(s, d):
    t = F.col("event_type")
    r = P.table(s, d, "events").select(F.col("user_id").alias("lock"), "event_id", F.when(t == "click", "pause").when(t == "view", "resume").when((t == "purchase") & (F.col("event_id") % 7 == 0), "stop").otherwise("beat").alias("request"))
    return versions.control_states(r, ["event_id"])


@query("""SELECT repository_id, count(*) AS due, count(b.tick) AS skipped FROM (SELECT repository_id, unnest(range(min(second), max(second) + 1, 3600)) AS tick FROM (SELECT user_id AS repository_id, epoch(ts)::BIGINT AS second FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)) GROUP BY 1) t
LEFT JOIN (SELECT DISTINCT repository_id, unnest(range(second, second + 60)) AS tick FROM (SELECT user_id AS repository_id, epoch(ts)::BIGINT AS second FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events))) b USING (repository_id, tick) GROUP BY 1""")
def poll_ticks(s, d):
    e = P.table(s, d, "events").select(F.col("user_id").alias("repository_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return versions.poll_ticks(e, 3600, 60)


# -- workspaces --------------------------------------------------------------


@query("SELECT ref, source_id, target_id FROM (SELECT o_orderkey AS ref, o_custkey AS s, o_orderkey % 2000 AS t FROM orders) o JOIN (SELECT c_custkey AS x, c_custkey * 2 AS source_id FROM customer WHERE c_custkey % 7 <> 0) a ON a.x = s JOIN (SELECT c_custkey AS x, c_custkey * 2 AS target_id FROM customer WHERE c_custkey % 7 <> 0) b ON b.x = t")
def plan_references(s, d):
    c = P.table(s, d, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 2000).alias("target"))
    return workspace.resolved_references(c, P.table(s, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("ref"), (F.col("c_custkey") * 2).alias("id")))


OWNERS = """vw AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS owner, 'n' || (s_suppkey % 60) AS name, 'l' || (s_suppkey % 2) AS label FROM supplier), el AS (SELECT 'r' || s_suppkey AS ref, s_suppkey AS id, 'n' || ((s_suppkey + 1) % 80) AS name, 'l' || (s_suppkey % 3) AS label FROM supplier),
own AS (SELECT v.id AS view_id, ref, 1 AS by FROM vw v JOIN el e ON e.id = v.owner), nav AS (SELECT v.id AS view_id, min(ref) AS ref, 2 AS by FROM vw v JOIN el e ON e.id = v.id // 2 WHERE v.id % 5 = 1 AND v.id NOT IN (SELECT view_id FROM own) GROUP BY 1), sure AS (SELECT * FROM own UNION ALL SELECT * FROM nav),
free AS (SELECT * FROM el WHERE ref NOT IN (SELECT ref FROM sure)), bth AS (SELECT v.id AS view_id, min(ref) AS ref, 3 AS by FROM vw v JOIN free e ON e.name = v.name AND e.label = v.label WHERE v.id NOT IN (SELECT view_id FROM sure) GROUP BY 1 HAVING count(*) = 1),
nam AS (SELECT v.id AS view_id, min(ref) AS ref, 4 AS by FROM vw v JOIN free e ON e.name = v.name WHERE v.id NOT IN (SELECT view_id FROM sure) AND v.id NOT IN (SELECT view_id FROM bth) GROUP BY 1 HAVING count(*) = 1)"""


@query("SELECT * FROM sure UNION ALL SELECT * FROM bth UNION ALL SELECT * FROM nam", OWNERS)
def view_owner_refs(s, d):
    k, sup = F.col("s_suppkey"), P.table(s, d, "supplier")
    v = sup.select(k.alias("id"), F.when(k % 4 == 0, k).alias("owner"), _text("n", k % 60).alias("name"), _text("l", k % 2).alias("label"))
    e = sup.select(_text("r", k).alias("ref"), k.alias("id"), _text("n", (k + 1) % 80).alias("name"), _text("l", k % 3).alias("label"))
    nav = sup.where("s_suppkey % 5 = 1").select(k.alias("view_id"), F.floor(k / 2).alias("element_id"))
    return workspace.view_owners(v, e, nav)


@query("SELECT kind, count(*) FILTER (WHERE NOT known) AS created, count(*) FILTER (WHERE known) AS updated FROM pl GROUP BY 1", """
pe AS (SELECT 'e' || c_custkey AS ref, CASE WHEN c_custkey % 10 = 0 THEN 'root' ELSE 'e' || (c_custkey // 10 * 10) END AS parent, c_custkey % 3 = 0 AS known FROM customer WHERE c_nationkey < 20),
pl AS (SELECT 'element' AS kind, known FROM pe UNION ALL SELECT 'view', known FROM pe WHERE ref IN (SELECT parent FROM pe WHERE parent <> 'root') UNION ALL SELECT 'view', false WHERE EXISTS (SELECT 1 FROM pe WHERE parent = 'root')
  UNION ALL SELECT 'connector', o_orderkey % 2 = 0 FROM orders WHERE 'e' || o_custkey IN (SELECT ref FROM pe) AND 'e' || (o_orderkey % 1500) IN (SELECT ref FROM pe))""")
def plan_summary(s, d):
    return workspace.plan_summary(_plan(s, d))


def _plan(s, d):
    k = F.col("c_custkey")
    e = P.table(s, d, "customer").select(_text("e", k).alias("ref"), F.when(k % 10 == 0, "root").otherwise(_text("e", F.floor(k / 10) * 10)).alias("parent"), (k % 3 == 0).alias("known"), "c_nationkey")
    c = P.table(s, d, "orders").select(_text("c", F.col("o_orderkey")).alias("ref"), _text("e", F.col("o_custkey")).alias("source"), _text("e", F.col("o_orderkey") % 1500).alias("target"), (F.col("o_orderkey") % 2 == 0).alias("known"))
    return workspace.plan(e, c, F.col("c_nationkey") < 20)


@query("SELECT s_suppkey AS id, 'r' || s_suppkey AS ref, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 1 ELSE s_nationkey END AS value FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY 'x' || lpad(n_nationkey::VARCHAR, 3, '0')), 'x' || lpad(n_nationkey::VARCHAR, 3, '0'), n_name, n_regionkey FROM nation")
def applied_plan(s, d):
    k = F.col("s_suppkey")
    sup = P.table(s, d, "supplier").select(k.alias("id"), _text("r", k).alias("ref"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("value"))
    new = P.table(s, d, "nation").select(_text("x", F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("ref"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("value"))
    planned = sup.where("id % 3 = 0").select("ref", F.lit("new").alias("name"), F.when(F.col("id") % 2 == 0, 1).cast("int").alias("value")).union(new)
    return workspace.applied(planned, sup)


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 THEN c_custkey % 3 ELSE c_nationkey END AS c_nationkey FROM customer")
def partial_update(s, d):
    rows = P.table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("c_custkey")
    changes_ = rows.where(k % 5 == 0).select(k, F.lit("renamed").alias("c_name"), (k % 3).cast("int").alias("c_nationkey"))
    return workspace.partial_update(rows, changes_, "c_custkey", ["c_name", "c_nationkey"], {"c_nationkey": 0})


GONE = "gn AS (SELECT id FROM elements WHERE id % 101 = 0 OR id = 2000004), dv AS (SELECT id FROM views WHERE owner_element_id IN (SELECT id FROM gn))"


@query("SELECT kind, count(*) AS n, min(id) AS first FROM (SELECT 'element' AS kind, id::VARCHAR AS id FROM gn UNION ALL SELECT 'view', id::VARCHAR FROM dv UNION ALL SELECT DISTINCT 'placement', view_id || ':' || element_id FROM placements WHERE element_id IN (SELECT id FROM gn) OR view_id IN (SELECT id FROM dv) UNION ALL SELECT DISTINCT 'connector', id::VARCHAR FROM connectors WHERE source_element_id IN (SELECT id FROM gn) OR target_element_id IN (SELECT id FROM gn) OR view_id IN (SELECT id FROM dv)) GROUP BY 1", GONE)
def cascade_delete(s, d):
    rows = workspace.cascade(P.elements(s, d).where("id % 101 = 0 or id = 2000004"), P.placements(s, d), P.connectors(s, d), P.views(s, d))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first"))


MAT = """nd AS (SELECT 'c' || lpad(c_custkey::VARCHAR, 8, '0') AS key, c_name AS name, 'd' || lpad(c_nationkey::VARCHAR, 2, '0') AS folder FROM customer), kn AS (SELECT 'node:c' || lpad(c_custkey::VARCHAR, 8, '0') AS owner_key, c_custkey + 7 AS resource_id FROM customer WHERE c_custkey % 2 = 0),
ev0 AS (SELECT DISTINCT 'folder:' || folder AS owner_key, folder AS name, NULL AS parent FROM nd UNION ALL SELECT 'node:' || key, name, 'folder:' || folder FROM nd),
me AS (SELECT coalesce(kn.resource_id, (SELECT max(resource_id) FROM kn) + row_number() OVER (PARTITION BY kn.resource_id IS NULL ORDER BY owner_key)) AS id, owner_key, name, parent FROM ev0 LEFT JOIN kn USING (owner_key)),
mp AS (SELECT f.id AS view_id, e.id AS element_id FROM me e JOIN me f ON f.owner_key = e.parent)"""


@query("SELECT id, owner_key, name, parent FROM me", MAT)
def materialised_elements(s, d):
    return _materialised(s, d)[0]


@query("SELECT CASE WHEN a.view_id = b.view_id THEN a.view_id ELSE 0 END::BIGINT AS view_id, a.element_id AS source_id, b.element_id AS target_id, min(l) AS label, count(*) AS n FROM (SELECT 'node:c' || lpad(o_custkey::VARCHAR, 8, '0') AS s, 'node:c' || lpad((o_orderkey % 1500)::VARCHAR, 8, '0') AS t, o_orderstatus AS l FROM orders) o JOIN me x ON x.owner_key = o.s JOIN me y ON y.owner_key = o.t JOIN mp a ON a.element_id = x.id JOIN mp b ON b.element_id = y.id GROUP BY ALL", MAT)
def materialised_connectors(s, d):
    return _materialised(s, d)[2]


def _materialised(s, d):
    key = lambda c: _text("c", F.lpad(c.cast("string"), 8, "0"))
    c = P.table(s, d, "customer")
    nodes = c.select(key(F.col("c_custkey")).alias("key"), F.col("c_name").alias("name"), _text("d", F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("folder"))
    edges = P.table(s, d, "orders").select(key(F.col("o_custkey")).alias("source"), key(F.col("o_orderkey") % 1500).alias("target"), F.col("o_orderstatus").alias("label"))
    known = c.where("c_custkey % 2 = 0").select(_text("node:", key(F.col("c_custkey"))).alias("owner_key"), (F.col("c_custkey") + 7).alias("resource_id"))
    return workspace.materialise(nodes, edges, known)


@query("SELECT kind, step, count(*) AS n FROM (SELECT ['connector', 'view', 'element'][event_id % 3 + 1] AS kind, (event_id % 3)::INT AS step, event_id FROM events WHERE event_id % 5 <> 0 AND event_type <> 'error' AND event_id % 11 <> 0) GROUP BY 1, 2")
def swept_rows(s, d):
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ["connector", "view", "element"])), (e % 3 + 1).cast("int"))
    stored = P.table(s, d, "events").select(e.alias("id"), kind.alias("kind"), (F.col("event_type") == "error").alias("dirty"), (e % 11 == 0).alias("tombstone"))
    return workspace.swept(stored, stored.where("id % 5 = 0").select("kind", "id")).groupBy("kind", "step").agg(F.count("*").alias("n"))


@query("SELECT 'e' || user_id AS scope, coalesce(CASE WHEN user_id % 2 = 0 THEN user_id % 3 END, 0)::INT AS before, greatest(least(coalesce(CASE WHEN user_id % 2 = 0 THEN user_id % 3 END, 0) + sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END), 2), 0)::INT AS after, bool_or(event_type = 'error' AND event_id % 50 = 0) AS hidden FROM events GROUP BY user_id")
def context_actions(s, d):
    t, u = F.col("event_type"), F.col("user_id")
    acts = P.table(s, d, "events").select(_text("e", u).alias("scope"), F.when(t == "click", "show").when(t == "view", "clean").when((t == "error") & (F.col("event_id") % 50 == 0), "hide").otherwise("none").alias("action"))
    tiers = P.table(s, d, "events").where(u % 2 == 0).select(_text("e", u).alias("scope"), (u % 3).alias("tier")).distinct()
    return workspace.context_actions(tiers, acts, 2)


@query("SELECT view_id, element_id FROM (SELECT DISTINCT view_id, target_element_id AS element_id FROM connectors UNION SELECT view_id, source_element_id FROM connectors) ANTI JOIN placements USING (view_id, element_id)")
def ensured_placements(s, d):
    return workspace.ensured_placements(P.placements(s, d), P.connectors(s, d))


@query("SELECT ref, connectors, children FROM (SELECT 'e' || c_custkey AS ref FROM customer) e LEFT JOIN (SELECT x AS ref, count(*) AS connectors FROM (SELECT o_orderkey, 'e' || o_custkey AS x FROM orders UNION SELECT o_orderkey, 'e' || (o_orderkey % 1500) FROM orders) GROUP BY 1) c USING (ref) LEFT JOIN (SELECT 'e' || c_nationkey AS ref, count(*) AS children FROM customer GROUP BY 1) p USING (ref) WHERE connectors IS NOT NULL OR children IS NOT NULL".replace("SELECT ref, connectors, children FROM", "SELECT ref, coalesce(connectors, 0) AS connectors, coalesce(children, 0) AS children FROM"))
def removal_blockers(s, d):
    c = P.table(s, d, "customer")
    o = P.table(s, d, "orders").select(_text("e", F.col("o_custkey")).alias("source"), _text("e", F.col("o_orderkey") % 1500).alias("target"))
    return workspace.removal_blockers(c.select(_text("e", F.col("c_custkey")).alias("ref")), o, c.select(_text("e", F.col("c_nationkey")).alias("parent")))


@query("SELECT p_partkey AS id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS ref FROM (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part))")
def unique_refs(s, d):
    return workspace.unique_refs(P.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


# -- embeddings and enrichers ------------------------------------------------

LEX = """tx AS (SELECT p_partkey, 'func ' || p_name || '(' || p_type || ') return ' || p_size AS body FROM part),
tt AS (SELECT p_partkey, body, list_transform(regexp_extract_all(body, '([A-Za-z_][A-Za-z0-9_]*|[0-9]+|[()])', 1), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN 'number_lit' ELSE t END) AS t FROM tx),
ft AS (SELECT p_partkey, 'tok:' || lower(x) AS f, 1.0::DOUBLE AS w FROM tt, unnest(t) AS u(x) UNION ALL SELECT p_partkey, 'kw:' || lower(x), 1.4 FROM tt, unnest(t) AS u(x) WHERE lower(x) IN ('func', 'return')
  UNION ALL SELECT p_partkey, 'id:' || y, 1.2 FROM (SELECT p_partkey, unnest(list_distinct(list_filter(string_split(trim(lower(regexp_replace(regexp_replace(x, '([A-Z])', ' \\1', 'g'), '[_\\-.\\s]+', ' ', 'g'))), ' '), lambda z: z <> ''))) AS y FROM tt, unnest(t) AS u(x))
  UNION ALL SELECT p_partkey, 'c' || n || ':' || substr(x, i, n), 0.25 FROM (SELECT p_partkey, lower(x) AS x, n, unnest(range(1, length(x) - n + 2)) AS i FROM tt, unnest(t) AS u(x), (SELECT unnest([3, 4, 5]) AS n) g WHERE length(x) >= n)
  UNION ALL SELECT p_partkey, 'bi:' || lower(t[i]) || chr(0) || lower(t[i + 1]), 0.8 FROM (SELECT p_partkey, t, unnest(range(1, len(t))) AS i FROM tt)
  UNION ALL SELECT p_partkey, 'tri:' || lower(t[i]) || chr(0) || lower(t[i + 1]) || chr(0) || lower(t[i + 2]), 0.45 FROM (SELECT p_partkey, t, unnest(range(1, len(t) - 1)) AS i FROM tt)
  UNION ALL SELECT p_partkey, 'ast:' || w, 1.0 FROM (SELECT p_partkey, body, unnest(['if', 'for', 'while', 'switch', 'match', 'try', 'catch', 'except', 'return', 'yield', 'throw', 'raise', 'defer', 'go']) AS w FROM tx) WHERE contains(body, w) UNION ALL SELECT p_partkey, 'ast:indent:0', 1.0 FROM tx),
hx AS (SELECT p_partkey, w, sha256(f) AS h FROM ft),
sm AS (SELECT p_partkey, (('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT % 512)::BIGINT AS idx, round(sum(CASE WHEN ('0x' || h[9:10])::INT % 2 = 1 THEN -w ELSE w END), 6) AS w FROM hx GROUP BY 1, 2)"""


@query("SELECT p_partkey, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 5) AS value FROM sm WHERE w <> 0", LEX)
def lexical_vectors(s, d):
    rows = P.table(s, d, "part").select("p_partkey", _text("func ", F.col("p_name"), "(", F.col("p_type"), ") return ", F.col("p_size")).alias("body"))
    return embedding.text_vectors(rows, "p_partkey", "body").withColumn("value", F.round("value", 5))


@query("SELECT vec_id, 256::INT AS bytes, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def vector_codec(s, d):
    v = P.table(s, d, "embeddings").select("vec_id", embedding.encoded(F.col("embedding")).alias("b"))
    return v.select("vec_id", F.octet_length("b").alias("bytes"), F.round(F.aggregate(embedding.decoded(F.col("b")), F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("SELECT p_partkey, round(('0x' || substr(sha256(p_name || ':0'), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1, 6) AS x0, round(('0x' || substr(sha256(p_name || ':1'), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1, 6) AS x1 FROM part")
def seeded_vectors(s, d):
    v = embedding.seeded_vector(F.col("p_name"), 2)
    return P.table(s, d, "part").select("p_partkey", F.round(v[0], 6).alias("x0"), F.round(v[1], 6).alias("x1"))


SHRUNK = r"""tx AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS w FROM conversations),
ln AS (SELECT *, list_filter(string_split(w, chr(10)), lambda x: NOT regexp_matches(regexp_replace(x, '^\s+', ''), '^(//|/\*|\*|$)')) AS kept FROM tx),
bd AS (SELECT *, CASE WHEN len(kept) > 0 THEN regexp_replace(array_to_string(kept, chr(10)), '^\s+|\s+$', '', 'g') ELSE w END AS b FROM ln),
tk AS (SELECT *, greatest(ceil(strlen(w) / 4), len(regexp_extract_all(w, '\S+'))) AS tw, greatest(ceil(strlen(b) / 4), len(regexp_extract_all(b, '\S+'))) AS tb FROM bd)"""


@query(r"SELECT conv_id, turn, length(body)::INT AS length, left(body, 10) AS head, right(body, 5) AS tail FROM (SELECT conv_id, turn, CASE WHEN tw <= 30 THEN w WHEN tb <= 30 OR strlen(b) <= 120 THEN b ELSE regexp_replace(left(b, 78), '^\s+|\s+$', '', 'g') || '...' || regexp_replace(right(b, 39), '^\s+|\s+$', '', 'g') END AS body FROM tk)", SHRUNK)
def shrunk_texts(s, d):
    t = P.table(s, d, "conversations").select("conv_id", "turn", embedding.shrunk(F.col("text"), 30, "...").alias("body"))
    return t.select("conv_id", "turn", F.length("body").alias("length"), F.left("body", F.lit(10)).alias("head"), F.right("body", F.lit(5)).alias("tail"))


@query("SELECT p_partkey AS owner, sha256(p_name) AS input_hash FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey % 2 = 0)")
def embedding_cache(s, d):
    p, k = P.table(s, d, "part"), F.col("p_partkey")
    cache = p.where(k % 3 == 0).select(F.lit("m").alias("model"), k.alias("owner"), F.sha2(F.when(k % 2 == 0, F.col("p_name")).otherwise("other"), 256).alias("input_hash"), F.array(F.lit(0.0)).alias("vector"))
    return embedding.cache_misses(p.select(k.alias("owner"), F.col("p_name").alias("text")), cache, "m")


@query("SELECT DISTINCT 'e' || n AS id FROM (SELECT n_nationkey AS n FROM nation) WHERE n % 4 IN (0, 1) AND EXISTS (SELECT 1 FROM facts WHERE (n % 4 = 0 AND type = 'src' || (n % 8)) OR (n % 4 = 1 AND type = 'src' || (n % 8) AND enricher = 'en'))")
def active_enrichers(s, d):
    n = F.col("n_nationkey")
    trigger = F.when(n % 4 == 0, _text("src", n % 8)).when(n % 4 == 1, _text("src", n % 8, "/en")).when(n % 4 == 2, _text("rc", n % 8)).otherwise("en")
    return enrich.active(P.table(s, d, "nation").select(_text("e", n).alias("id"), trigger.alias("trigger")), P.facts(s, d).select(F.col("file_path").alias("signal")))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'backward' WHEN 1 THEN 'both' WHEN 2 THEN 'none' ELSE 'forward' END AS way, CASE p_partkey % 5 WHEN 0 THEN 'forward' WHEN 1 THEN 'both' WHEN 2 THEN 'none' ELSE 'backward' END AS back FROM part")
def directions(s, d):
    from arborlens.functions import text

    k = F.col("p_partkey")
    way = text.direction(F.when(k % 5 == 0, " Reverse ").when(k % 5 == 1, "BOTH").when(k % 5 == 2, "none").when(k % 5 == 3, "x"))
    return P.table(s, d, "part").select(k, way.alias("way"), text.reverse_direction(way).alias("back"))


@query("SELECT vec_id AS id FROM embeddings h WHERE vec_id % 5 <> 0 AND EXISTS (SELECT 1 FROM embeddings v WHERE v.vec_id % 5 = 0 AND (v.vec_id = h.vec_id + 1 OR v.vec_id = h.vec_id - 1) AND list_cosine_similarity(v.embedding::DOUBLE[], h.embedding::DOUBLE[]) >= 0.3)")
def embedding_rescue(s, d):
    v = P.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    refs = v.select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    return graph.rescued(v.select("id", (F.col("id") % 5 == 0).alias("visible")), refs, v, 0.3)


@query("SELECT event_id, repository_id FROM (SELECT event_id, user_id AS repository_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, event_type FROM events) WHERE b IS DISTINCT FROM event_type")
def suppressed_events(s, d):
    from arborlens.operators import diff

    e = P.table(s, d, "events").select("event_id", F.col("user_id").alias("repository_id"), "event_type")
    return diff.suppressed(e, "repository_id", ["event_id"], "event_type").select("event_id", "repository_id")


# -- nested sections ----------------------------------------------------------

SECTIONS = """ac AS (SELECT p_partkey AS key, ['merged', 'server', 'kept', 'added', 'deleted'][p_partkey % 5 + 1] AS action FROM part),
lo AS (SELECT p_partkey AS key, 'v' || (p_partkey % 7) AS parent, p_partkey % 100 AS x, CASE WHEN p_partkey % 3 > 0 THEN 'n' || (p_partkey % 4) END AS label FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'w' || (p_partkey % 3) END, 5, 'only here' FROM part),
se AS (SELECT p_partkey AS key, 'v' || (p_partkey % 7) AS parent, p_partkey % 90 AS x, CASE WHEN p_partkey % 8 > 0 THEN 'n' || (p_partkey % 6) ELSE '' END AS label FROM part UNION ALL SELECT p_partkey, 'u' || (p_partkey % 3), 7, 'only there' FROM part WHERE p_partkey % 4 < 2),
j AS (SELECT coalesce(l.key, s.key) AS key, coalesce(l.parent, s.parent) AS parent, coalesce(s.x, l.x) AS x, trim(coalesce(l.label, '')) AS a, trim(coalesce(s.label, '')) AS b, l.key IS NOT NULL AS inl, s.key IS NOT NULL AS ins, l.label AS la, s.label AS sb
  FROM (SELECT lo.* FROM lo JOIN ac USING (key) WHERE action = 'merged') l FULL JOIN (SELECT se.* FROM se JOIN ac USING (key) WHERE action = 'merged') s ON l.key = s.key AND l.parent = s.parent)"""


def _sections(s, d):
    p, k = P.table(s, d, "part"), F.col("p_partkey")
    actions = p.select(k.alias("key"), F.element_at(F.array(*map(F.lit, ["merged", "server", "kept", "added", "deleted"])), (k % 5 + 1).cast("int")).alias("action"))
    row = lambda parent, place, x, label: (k.alias("key"), parent.alias("parent"), F.lit(place).alias("place"), x.cast("long").alias("x"), label.alias("label"))
    local = p.select(*row(_text("v", k % 7), 0, k % 100, F.when(k % 3 > 0, _text("n", k % 4)))).union(p.select(*row(F.when(k % 2 == 0, _text("w", k % 3)), 1, F.lit(5), F.lit("only here"))))
    server = p.select(*row(_text("v", k % 7), 0, k % 90, F.when(k % 8 > 0, _text("n", k % 6)).otherwise(""))).union(p.where(k % 4 < 2).select(*row(_text("u", k % 3), 1, F.lit(7), F.lit("only there"))))
    return sections.merge_sections(actions, local, server, ["x"], ["label"])


@query("""SELECT key, parent, x, CASE WHEN inl AND ins THEN CASE WHEN a <> b AND a <> '' AND b <> '' THEN '<<< LOCAL' || chr(10) || a || chr(10) || '===' || chr(10) || b || chr(10) || '>>> SERVER' WHEN a = '' THEN sb ELSE la END ELSE coalesce(la, sb) END AS label, CASE WHEN inl AND ins THEN 'both' WHEN inl THEN 'local' ELSE 'server' END AS side FROM j
UNION ALL SELECT key, parent, x, label, 'local' FROM lo JOIN ac USING (key) WHERE action = 'kept' UNION ALL SELECT key, parent, x, label, 'server' FROM se JOIN ac USING (key) WHERE action IN ('server', 'added')""", SECTIONS)
def merged_sections(s, d):
    return _sections(s, d)[0]


@query("SELECT key, parent, 'label' AS field, a AS local, b AS server FROM j WHERE inl AND ins AND a <> b AND a <> '' AND b <> ''", SECTIONS)
def section_conflicts(s, d):
    return _sections(s, d)[1]


# -- proxies in the order of a viewport ------------------------------------------

VIEWPORT = """,
geo AS (SELECT view_id, element_id, element_id % 7 * 260 + 100.0::DOUBLE AS cx, element_id % 11 * 160 + 50.0::DOUBLE AS cy FROM placements),
vp AS (SELECT id AS view_id, (id % 3) * 100.0::DOUBLE AS x0, (id % 3) * 100.0::DOUBLE + 900 AS x1, 0.0::DOUBLE AS y0, 700.0::DOUBLE AS y1 FROM views),
ud AS (SELECT element_id, view_id, proxy, min(depth) AS depth FROM (SELECT element_id, view_id, element_id AS proxy, 0 AS depth FROM placements UNION ALL SELECT p.element_id, q.view_id, v.owner_element_id, cl.depth + 1 FROM placements p JOIN cl ON cl.view_id = p.view_id JOIN views v ON v.id = cl.ancestor_id JOIN placements q ON q.element_id = v.owner_element_id) GROUP BY 1, 2, 3),
lf AS (SELECT a.view_id, x, y, n, least(a.proxy, b.proxy) AS source, greatest(a.proxy, b.proxy) AS target, CASE WHEN a.proxy < b.proxy THEN a.depth ELSE b.depth END AS ds, CASE WHEN a.proxy < b.proxy THEN b.depth ELSE a.depth END AS dt FROM pe JOIN ud a ON a.element_id = x JOIN ud b ON b.element_id = y AND b.view_id = a.view_id WHERE a.proxy <> b.proxy AND NOT (a.proxy = x AND b.proxy = y)),
pr AS (SELECT view_id, source, target, sum(n)::BIGINT AS n, min(ds) AS ds, min(dt) AS dt FROM lf GROUP BY 1, 2, 3),
ps AS (SELECT pr.*, sqrt((s.cx - (x0 + x1) / 2) ** 2 + (s.cy - (y0 + y1) / 2) ** 2) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS sd, sqrt((t.cx - (x0 + x1) / 2) ** 2 + (t.cy - (y0 + y1) / 2) ** 2) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS td,
  (s.cx BETWEEN x0 AND x1 AND s.cy BETWEEN y0 AND y1)::INT + (t.cx BETWEEN x0 AND x1 AND t.cy BETWEEN y0 AND y1)::INT AS ins FROM pr JOIN vp USING (view_id) JOIN geo s ON s.view_id = pr.view_id AND s.element_id = source JOIN geo t ON t.view_id = pr.view_id AND t.element_id = target),
rk AS (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY round(least(sd, td) * 1000 - greatest(sd, td) * 320 - CASE WHEN ins > 0 THEN 300 ELSE 0 END + CASE WHEN ins = 2 THEN 160 ELSE 0 END, 6), n DESC, greatest(ds, dt), ds + dt, source, target) AS rank FROM ps WHERE ins > 0)"""


def _viewport(s, d, budget):
    e, v = F.col("element_id"), F.col("id")
    boxes = P.placements(s, d).select("view_id", e, (e % 7 * 260).alias("x"), (e % 11 * 160).alias("y"), F.lit(200).alias("w"), F.lit(100).alias("h"))
    ports = P.views(s, d).select(v.alias("view_id"), (v % 3 * 100).alias("min_x"), F.lit(0).alias("min_y"), (v % 3 * 100 + 900).alias("max_x"), F.lit(700).alias("max_y"))
    return crossview.viewport_proxies(P.connectors(s, d), P.placements(s, d), graph.lineage(view_parents(s, d)), P.views(s, d), boxes, ports, budget)


@query("SELECT view_id, source, target, n, rank FROM rk WHERE rank <= 20", PROXIES + VIEWPORT, True)
def viewport_proxies(s, d):
    return _viewport(s, d, 20)[0].select("view_id", "source", "target", "n", "rank")


@query("SELECT r.view_id, count(*) FILTER (WHERE rank <= 20) AS shown, coalesce(any_value(o.n), 0)::BIGINT AS omitted FROM rk r LEFT JOIN (SELECT view_id, sum(n) AS n FROM (SELECT DISTINCT lf.view_id, x, y, lf.n FROM lf JOIN rk USING (view_id, source, target) WHERE rank > 20) GROUP BY 1) o ON o.view_id = r.view_id GROUP BY 1", PROXIES + VIEWPORT, True)
def viewport_omissions(s, d):
    return _viewport(s, d, 20)[1]
