"""Queries on the code graph: predicates, resolution, architecture, names and text (P, J, A, F, G families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlens.functions import naming, text
from arborlens.operators import architecture, filtering, resolve, versions, workspace
from arborlens.plans import projection as P
from arborlens.plans.registry import query

# -- symbols and their signals ----------------------------------------------

SYMBOLS = """sym AS (SELECT id, CASE WHEN id % 3 = 0 THEN lower(name) ELSE name END AS name, CASE WHEN id % 17 = 0 THEN 'pkg/logger.go' ELSE kind || '/' || (id % 100) || '.go' END AS path, kind FROM elements),
fx AS (SELECT element_id AS id, CASE tier WHEN 0 THEN 'http.route' WHEN 1 THEN 'dependency.import' ELSE 'misc' END AS type, CASE WHEN tier = 2 THEN 0.6::DOUBLE END AS hint, score AS confidence FROM decisions)"""


def _symbols(s, d):
    e = P.elements(s, d)
    path = F.when(F.col("id") % 17 == 0, "pkg/logger.go").otherwise(F.concat("kind", F.lit("/"), (F.col("id") % 100).cast("string"), F.lit(".go")))
    return e.select("id", F.when(F.col("id") % 3 == 0, F.lower("name")).otherwise(F.col("name")).alias("name"), path.alias("path"), "kind")


def _symbol_facts(s, d):
    t = F.col("tier")
    return P.decisions(s, d).select(F.col("element_id").alias("id"), F.when(t == 0, "http.route").when(t == 1, "dependency.import").otherwise("misc").alias("type"), F.when(t == 2, 0.6).alias("hint"), F.col("score").alias("confidence"))


def _references(s, d):
    return P.connectors(s, d).select("id", F.col("source_element_id").alias("source"), F.col("target_element_id").alias("target"), "relationship", "line", "view_id")


@query("SELECT id, regexp_matches(name, '^\\p{Lu}') AS exported, regexp_matches(lower(name), 'log|metric|trace|debug|helper|util') OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), 'log|metric|trace|debug|helper|util') AS utility FROM sym", SYMBOLS)
def symbol_predicates(s, d):
    return _symbols(s, d).select("id", naming.exported(F.col("name")).alias("exported"), naming.utility(F.col("name"), F.col("path")).alias("utility"))


SEEDS = SYMBOLS + """,
dg AS (SELECT e, sum(i) AS i, sum(o) AS o FROM (SELECT source_element_id AS e, 0 AS i, 1 AS o FROM connectors UNION ALL SELECT target_element_id, 1, 0 FROM connectors) GROUP BY 1),
seeds AS (SELECT sym.id, round(CASE WHEN regexp_matches(name, '^\\p{Lu}') THEN 1.2::DOUBLE ELSE 0 END + CASE WHEN coalesce(o, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END + coalesce(told, 0.0::DOUBLE) + CASE WHEN sym.id % 211 = 0 THEN 100 ELSE 0 END
  + CASE WHEN coalesce(o, 0) > 40 OR coalesce(i, 0) > 25 THEN -1.5::DOUBLE ELSE 0 END + CASE WHEN (regexp_matches(lower(name), 'log|metric|trace|debug|helper|util') OR path = 'pkg/logger.go') AND coalesce(o, 0) + coalesce(i, 0) > 8 THEN -0.8::DOUBLE ELSE 0 END, 8) AS base, sym.id % 211 = 0 AS forced
  FROM sym LEFT JOIN dg ON dg.e = sym.id LEFT JOIN (SELECT id, sum(CASE WHEN coalesce(hint, 0) > 0 OR type = 'http.route' THEN 1.5::DOUBLE * confidence WHEN type LIKE 'dependency.%' THEN 0.2::DOUBLE * confidence ELSE 0 END) AS told FROM fx GROUP BY 1) t ON t.id = sym.id)"""


def _seeds(s, d):
    forced = _symbols(s, d).where("id % 211 = 0").select("id")
    return filtering.seeds(_symbols(s, d), _references(s, d), _symbol_facts(s, d), forced)


@query("SELECT id, base, forced FROM seeds", SEEDS)
def visibility_seeds(s, d):
    return _seeds(s, d)


@query("SELECT DISTINCT x AS id FROM (SELECT target_element_id AS x FROM connectors WHERE source_element_id % 211 = 0 UNION ALL SELECT source_element_id FROM connectors WHERE target_element_id % 211 = 0)")
def change_endpoints(s, d):
    return filtering.forced_ends(_references(s, d), _symbols(s, d).where("id % 211 = 0").select("id"))


@query("""SELECT c.id, CASE WHEN h THEN 'hidden' WHEN a AND b THEN 'visible' ELSE 'hidden' END AS decision, CASE WHEN h THEN 'user marked as noise' WHEN a AND b THEN 'connects visible symbols' ELSE 'unresolved or hidden endpoint' END AS reason
FROM (SELECT id, id % 97 = 0 AS h, source_element_id IN (SELECT id FROM seeds WHERE forced OR base >= 1) AS a, target_element_id IN (SELECT id FROM seeds WHERE forced OR base >= 1) AS b FROM connectors) c""", SEEDS)
def reference_decisions(s, d):
    refs = _references(s, d)
    return filtering.reference_decisions(refs, _seeds(s, d).where("forced or base >= 1"), refs.where("id % 97 = 0"))


@query("SELECT event_type, kind FROM (SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN 'runtime.connection' WHEN 'view' THEN 'runtime.volume' WHEN 'error' THEN 'dependency.import' WHEN 'signup' THEN 'grpc.server' ELSE 'other' END AS t, CASE event_type WHEN 'click' THEN 'connection' WHEN 'view' THEN 'volume' WHEN 'error' THEN 'import' WHEN 'signup' THEN 'component' END AS kind FROM events)")
def fact_kinds(s, d):
    t = F.col("event_type")
    type_ = F.when(t == "click", "runtime.connection").when(t == "view", "runtime.volume").when(t == "error", "dependency.import").when(t == "signup", "grpc.server").otherwise("other")
    return P.table(s, d, "events").select("event_type", filtering.fact_kind(type_).alias("kind")).distinct()


@query("SELECT doc_id, file_path, type, rank, rank <= 16 AS shown FROM (SELECT doc_id, enricher || '/' || (doc_id % 7) AS file_path, type, row_number() OVER (PARTITION BY enricher, doc_id % 7 ORDER BY type, doc_id) AS rank FROM facts)")
def fact_caps(s, d):
    f = P.facts(s, d).select(F.col("doc_id").alias("id"), F.concat_ws("/", "enricher", (F.col("doc_id") % 7).cast("string")).alias("path"), "type")
    return filtering.capped_facts(f).select(F.col("id").alias("doc_id"), F.col("path").alias("file_path"), "type", "rank", "shown")


@query("SELECT id, path FROM sym ORDER BY path, id LIMIT 5000", SYMBOLS)
def embedding_candidates(s, d):
    return filtering.first_rows(_symbols(s, d).select("id", "path"), ["path", "id"])


@query("SELECT row_number() OVER (ORDER BY file_path, type, enricher, doc_id) AS place, doc_id, file_path FROM facts ORDER BY 1 LIMIT 200")
def fact_listing(s, d):
    from pyspark.sql import Window

    order = ["file_path", "type", "enricher", "doc_id"]
    first = P.facts(s, d).select("doc_id", "file_path", "type", "enricher").orderBy(*order).limit(200)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("place", "doc_id", "file_path")


@query("SELECT id, change_type, language FROM (SELECT event_id AS id, event_type AS change_type, CASE WHEN event_id % 3 = 0 THEN 'go' ELSE 'python' END AS language FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 100) WHERE language = 'go'")
def diff_query(s, d):
    diffs = P.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("change_type"), F.lit("element").alias("resource_type"), F.when(F.col("event_id") % 3 == 0, "go").otherwise("python").alias("language"))
    return versions.diff_query(diffs, "click", "element", "go", 100).select("id", "change_type", "language")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN true WHEN id % 2 = 0 THEN id % 7 = 1 ELSE path = 'customer' OR path LIKE 'customer/%' END AS inside FROM sym", SYMBOLS)
def repository_scope(s, d):
    e = _symbols(s, d)
    return e.select("id", resolve.in_scope(F.col("id") % 5 != 0, F.when(F.col("id") % 2 == 0, (F.col("id") % 7).cast("string")), F.lit("1"), F.col("path"), "customer").alias("inside"))


@query("SELECT id, CASE WHEN k IS NULL THEN 'vanished' WHEN changed > seen THEN 'outdated' END AS state FROM (SELECT s.id, t.id AS k, s.id % 19 AS changed, s.id % 23 AS seen FROM sym s LEFT JOIN (SELECT id FROM sym WHERE id % 29 <> 0) t ON t.id = s.id) WHERE k IS NULL OR changed > seen", SYMBOLS)
def stale_symbols(s, d):
    e = _symbols(s, d).select(F.col("id").alias("key"), (F.col("id") % 23).alias("seen"))
    now = _symbols(s, d).where("id % 29 <> 0").select(F.col("id").alias("key"), (F.col("id") % 19).alias("changed"))
    known = _symbols(s, d).select(F.col("id").alias("key"), (F.col("id") % 19).alias("changed"))
    return resolve.stale(e, now, known).select(F.col("key").alias("id"), "state")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name || ' ' || p_brand || ' ' || p_type, '^small.*(steel|promo)', 'i') ORDER BY p_partkey LIMIT 12")
def technology_search(s, d):
    return resolve.catalog_search(P.table(s, d, "part"), F.concat_ws(" ", "p_name", "p_brand", "p_type"), "^small.*(steel|promo)", "p_partkey").select("p_partkey", "p_name")


# -- joins -------------------------------------------------------------------


@query("SELECT p.element_id, p.view_id, v.name AS view_name FROM placements p JOIN elements e ON e.id = p.element_id JOIN views v ON v.id = p.view_id")
def element_placements(s, d):
    return workspace.element_placements(P.elements(s, d), P.placements(s, d), P.views(s, d))


MATERIALISED = "mat AS (SELECT CASE WHEN id % 4 = 0 THEN 'folder' WHEN id % 4 = 1 THEN 'symbol' ELSE 'reference' END AS owner_type, 'k' || id AS owner_key, 'element' AS resource_type, id AS resource_id FROM elements)"


@query("SELECT owner_type, owner_key, resource_id, coalesce(v.id, 0)::BIGINT AS view_id, e.name, coalesce(kind, '') AS kind, coalesce(technology, '') AS technology FROM mat JOIN elements e ON e.id = resource_id LEFT JOIN views v ON v.owner_element_id = e.id WHERE owner_type IN ('folder', 'symbol')", MATERIALISED)
def binding_targets(s, d):
    i = F.col("id")
    m = P.elements(s, d).select(F.when(i % 4 == 0, "folder").when(i % 4 == 1, "symbol").otherwise("reference").alias("owner_type"), F.concat(F.lit("k"), i.cast("string")).alias("owner_key"), F.lit("element").alias("resource_type"), i.alias("resource_id"))
    return workspace.binding_targets(m, P.elements(s, d), P.views(s, d), ["folder", "symbol"])


@query("SELECT c.id, a.name AS source_name, b.name AS target_name, a.path AS source_path FROM connectors c JOIN sym a ON a.id = source_element_id JOIN sym b ON b.id = target_element_id", SYMBOLS)
def reference_symbols(s, d):
    return resolve.with_both_ends(_references(s, d), _symbols(s, d)).select("id", "source_name", "target_name", "source_path")


@query("SELECT s.id, coalesce(i.identity_key, 'stable:' || s.id) AS owner_key, s.path FROM sym s LEFT JOIN (SELECT id, 'identity:' || (id * 7) AS identity_key FROM sym WHERE id % 3 = 1) i ON i.id = s.id", SYMBOLS)
def identity_keys(s, d):
    e = _symbols(s, d).withColumn("stable_key", F.concat(F.lit("stable:"), F.col("id").cast("string")))
    i = e.where("id % 3 = 1").select("id", F.concat(F.lit("identity:"), (F.col("id") * 7).cast("string")).alias("identity_key"))
    return resolve.owner_keys(e, i).select("id", "owner_key", "path")


RESOLVE = """syms AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS file, 'f' || (l_partkey * 8 + l_linenumber) AS name, (l_orderkey % 1000)::BIGINT AS start_line, CASE WHEN l_linenumber = 3 THEN NULL ELSE (l_orderkey % 1000 + l_quantity)::BIGINT END AS end_line FROM lineitem),
calls AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS file, 'f' || (l_partkey * 8 + l_linenumber % 3) AS name, (l_partkey % 1100)::BIGINT AS line, l_returnflag = 'A' AS go FROM lineitem),
uniq AS (SELECT name, min(id) AS id, min(file) AS file FROM syms GROUP BY 1 HAVING count(*) = 1),
src AS (SELECT c.file, c.line, max(s.start_line) AS start_line, min_by(s.id, -s.start_line * 10000000000 + s.id) AS id FROM (SELECT DISTINCT file, line FROM calls) c JOIN syms s ON s.file = c.file AND s.start_line <= c.line AND c.line <= coalesce(s.end_line, c.line) GROUP BY 1, 2)"""


@query("SELECT c.id, src.id AS source_id, u.id AS target_id FROM calls c JOIN uniq u ON u.name = c.name AND (u.file = c.file OR c.go) JOIN src ON src.file = c.file AND src.line = c.line WHERE src.id <> u.id", RESOLVE)
def reference_resolution(s, d):
    li = P.table(s, d, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id")
    name = lambda n: F.concat(F.lit("f"), (F.col("l_partkey") * 8 + n).cast("string")).alias("name")
    start = F.col("l_orderkey") % 1000
    syms = li.select(key, F.col("l_suppkey").alias("file"), name(F.col("l_linenumber")), start.alias("start_line"), F.when(F.col("l_linenumber") != 3, (start + F.col("l_quantity")).cast("long")).alias("end_line"))
    calls = li.select(key, F.col("l_suppkey").alias("file"), name(F.col("l_linenumber") % 3), (F.col("l_partkey") % 1100).alias("line"), (F.col("l_returnflag") == "A").alias("anywhere"))
    return resolve.resolved_calls(calls, syms)


DEFINED = RESOLVE + """,
kc AS (SELECT id, min(file) AS file, min(name) AS name, min(line) AS line, bool_or(go) AS go FROM calls WHERE id % 7 <> 0 GROUP BY 1),
dl AS (SELECT id, 0 AS place, (file * 3) % 10 AS file, line + 2000 AS line FROM kc WHERE id % 3 = 0 UNION ALL SELECT id, 1, (file * 3) % 10, line FROM kc WHERE id % 3 = 0 UNION ALL SELECT id, 2, file, line + 5 FROM kc WHERE id % 6 = 0),
dp AS (SELECT DISTINCT file, line FROM dl),
dt AS (SELECT p.file, p.line, min_by(s.id, -s.start_line * 10000000000 + s.id) AS id FROM dp p JOIN syms s ON s.file = p.file AND s.start_line <= p.line AND p.line <= coalesce(s.end_line, p.line) GROUP BY 1, 2),
ds AS (SELECT dl.id, min_by(dt.id, place) AS target_id FROM dl JOIN dt USING (file, line) GROUP BY 1),
ks AS (SELECT c.file, c.line, min_by(s.id, -s.start_line * 10000000000 + s.id) AS id FROM (SELECT DISTINCT file, line FROM kc) c JOIN syms s ON s.file = c.file AND s.start_line <= c.line AND c.line <= coalesce(s.end_line, c.line) GROUP BY 1, 2)"""


@query("SELECT c.id, ks.id AS source_id, coalesce(ds.target_id, u.id) AS target_id FROM kc c LEFT JOIN ds ON ds.id = c.id LEFT JOIN uniq u ON u.name = c.name AND (u.file = c.file OR c.go) JOIN ks ON ks.file = c.file AND ks.line = c.line WHERE ks.id <> coalesce(ds.target_id, u.id)", DEFINED)
def defined_references(s, d):
    """Calls with the locations that a definition server gave for some of them, and other kinds of references between them."""
    li = P.table(s, d, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id")
    name = lambda n: F.concat(F.lit("f"), (F.col("l_partkey") * 8 + n).cast("string")).alias("name")
    start = F.col("l_orderkey") % 1000
    syms = li.select(key, F.col("l_suppkey").alias("file"), name(F.col("l_linenumber")), start.alias("start_line"), F.when(F.col("l_linenumber") != 3, (start + F.col("l_quantity")).cast("long")).alias("end_line"))
    calls = li.select(key, F.col("l_suppkey").alias("file"), name(F.col("l_linenumber") % 3), (F.col("l_partkey") % 1100).alias("line"), (F.col("l_returnflag") == "A").alias("anywhere"))
    calls = calls.groupBy("id").agg(F.min("file").alias("file"), F.min("name").alias("name"), F.min("line").alias("line"), F.bool_or("anywhere").alias("anywhere")).withColumn("kind", F.when(F.col("id") % 7 == 0, "type").when(F.col("id") % 2 == 0, "call"))
    where = lambda test, place, file, line: calls.where(f"id % 7 <> 0 AND {test}").select("id", F.lit(place).alias("place"), file.alias("file"), line.alias("line"))
    f, n = F.col("file"), F.col("line")
    definitions = where("id % 3 = 0", 0, f * 3 % 10, n + 2000).union(where("id % 3 = 0", 1, f * 3 % 10, n)).union(where("id % 6 = 0", 2, f, n + 5))
    return resolve.resolved_calls(calls, syms, definitions)


ARCH = """af AS (SELECT o_orderkey AS id, ['runtime.component', 'runtime.connection', 'runtime.endpoint_ref', 'grpc.server', 'grpc.contract', 'grpc.client', 'http.client', 'datastore.dependency', 'external.dependency', 'runtime.volume'][o_orderkey % 10 + 1] AS type,
  CASE WHEN o_orderkey % 4 = 0 THEN 'apps/n' || c_nationkey || '/src/main.go' WHEN o_orderkey % 4 = 1 THEN 'services/Pay' || (c_nationkey % 3) || '/cmd/x.py' ELSE 'main.go' END AS path,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Part ' || (o_custkey % 40) END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'unit-' || (o_orderkey % 20) END AS source,
  CASE WHEN o_orderkey % 6 = 0 THEN 'tcp://redis.svc:6379' WHEN o_orderkey % 6 = 1 THEN '{{ host }}' WHEN o_orderkey % 6 = 2 THEN NULL ELSE 'n' || (o_custkey % 30) || '.prod.local:80' END AS target,
  CASE WHEN o_orderkey % 7 = 0 THEN 'queue' WHEN o_orderkey % 7 = 1 THEN '' ELSE 'service' END AS kind, CASE WHEN o_orderkey % 8 = 0 THEN 'Go' ELSE '' END AS technology,
  CASE WHEN o_orderkey % 9 = 0 THEN 'calls' END AS label, NULL::VARCHAR AS relationship, (o_orderkey % 100) / 100.0::DOUBLE AS confidence FROM orders JOIN customer ON o_custkey = c_custkey),
slugged AS (SELECT *, CASE WHEN trim(coalesce(source, '')) <> '' THEN source WHEN path LIKE 'apps/%' THEN 'n' || regexp_extract(path, 'n([0-9]+)', 1) WHEN path LIKE 'services/%' THEN regexp_extract(path, '(Pay[0-9]+)', 1) END AS owner, CASE WHEN trim(name) <> '' THEN name WHEN trim(coalesce(target, '')) <> '' THEN target END AS named FROM af),
ep(raw, ep) AS (SELECT raw, CASE WHEN raw NOT LIKE '%{{%' AND trim(regexp_replace(split_part(split_part(regexp_replace(lower(raw), '^.*?://', ''), ':', 1), '.', 1), '[^a-z0-9-]+', '-', 'g'), '-') <> '' THEN trim(regexp_replace(split_part(split_part(regexp_replace(lower(raw), '^.*?://', ''), ':', 1), '.', 1), '[^a-z0-9-]+', '-', 'g'), '-') END FROM (SELECT owner AS raw FROM slugged UNION SELECT named FROM slugged UNION SELECT target FROM slugged UNION SELECT 'external traffic') WHERE raw IS NOT NULL),
lk AS (SELECT id, owner, CASE WHEN type = 'http.client' THEN coalesce(CASE WHEN trim(target) <> '' THEN target END, 'external traffic') WHEN type IN ('runtime.connection', 'runtime.endpoint_ref') THEN target ELSE named END AS t, type, label, confidence FROM slugged WHERE type IN ('runtime.connection', 'runtime.endpoint_ref', 'grpc.client', 'http.client', 'datastore.dependency', 'external.dependency')),
ed AS (SELECT id, a.ep AS s, b.ep AS t, CASE WHEN type = 'runtime.connection' THEN coalesce(label, 'uses') WHEN type = 'grpc.client' THEN 'grpc' WHEN type = 'http.client' THEN 'http' WHEN type = 'runtime.endpoint_ref' THEN 'uses' WHEN contains(lk.t, 'redis') THEN 'redis' ELSE 'uses' END AS label, confidence FROM lk JOIN ep a ON a.raw = lk.owner JOIN ep b ON b.raw = lk.t WHERE a.ep <> b.ep),
told AS (SELECT id, named AS n, CASE type WHEN 'runtime.component' THEN CASE WHEN trim(kind) <> '' THEN kind ELSE 'service' END WHEN 'grpc.server' THEN 'service' WHEN 'grpc.contract' THEN 'interface' WHEN 'datastore.dependency' THEN 'datastore' WHEN 'external.dependency' THEN 'external' END AS k,
  CASE WHEN type LIKE 'grpc.%' THEN 'gRPC' WHEN technology <> '' THEN technology WHEN type = 'runtime.component' THEN 'Runtime' ELSE 'External' END AS technology FROM slugged),
allc AS (SELECT id, 0 AS nr, 'component:' || coalesce(nullif(trim(regexp_replace(lower(owner), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS key, owner AS name, 'service' AS kind, NULL::VARCHAR AS technology FROM slugged WHERE owner IS NOT NULL
  UNION ALL SELECT id, 1, CASE WHEN k IN ('datastore', 'queue', 'external', 'contract') THEN k WHEN k = 'interface' THEN 'contract' ELSE 'component' END || ':' || coalesce(nullif(trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown'), n, k, technology FROM told WHERE k IS NOT NULL AND n IS NOT NULL
  UNION ALL SELECT id, 2, 'component:' || s, s, 'service', NULL FROM ed UNION ALL SELECT id, 2, 'component:' || t, t, 'service', NULL FROM ed)"""


def _arch_facts(s, d):
    k = F.col("o_orderkey")
    types = ["runtime.component", "runtime.connection", "runtime.endpoint_ref", "grpc.server", "grpc.contract", "grpc.client", "http.client", "datastore.dependency", "external.dependency", "runtime.volume"]
    j = P.table(s, d, "orders").join(P.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    num = lambda c: c.cast("string")
    return j.select(
        k.alias("id"), F.element_at(F.array(*map(F.lit, types)), (k % 10 + 1).cast("int")).alias("type"),
        F.when(k % 4 == 0, F.concat(F.lit("apps/n"), num(F.col("c_nationkey")), F.lit("/src/main.go"))).when(k % 4 == 1, F.concat(F.lit("services/Pay"), num(F.col("c_nationkey") % 3), F.lit("/cmd/x.py"))).otherwise("main.go").alias("path"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Part "), num(F.col("o_custkey") % 40))).alias("name"), F.when(k % 5 == 0, F.concat(F.lit("unit-"), num(k % 20))).alias("source"),
        F.when(k % 6 == 0, "tcp://redis.svc:6379").when(k % 6 == 1, "{{ host }}").when(k % 6 != 2, F.concat(F.lit("n"), num(F.col("o_custkey") % 30), F.lit(".prod.local:80"))).alias("target"),
        F.when(k % 7 == 0, "queue").when(k % 7 == 1, "").otherwise("service").alias("kind"), F.when(k % 8 == 0, "Go").otherwise("").alias("technology"),
        F.when(k % 9 == 0, "calls").alias("label"), F.lit(None).cast("string").alias("relationship"), ((k % 100) / F.lit(100.0)).alias("confidence"))


@query("SELECT key, min_by(name, id * 10 + nr) AS name, min_by(kind, id * 10 + nr) AS kind, min_by(technology, id * 10 + nr) FILTER (WHERE technology IS NOT NULL) AS technology, count(*) AS evidence FROM allc GROUP BY 1", ARCH)
def architecture_components(s, d):
    return architecture.model_of_facts(_arch_facts(s, d))[0]


@query("SELECT 'component:' || s AS source_key, 'component:' || t AS target_key, label, 'runtime-dependency' AS relationship, max(confidence) AS confidence, count(*) AS evidence, 'component:' || s || '->component:' || t || ':runtime-dependency:' || label AS key FROM ed GROUP BY s, t, label", ARCH)
def architecture_edges(s, d):
    return architecture.model_of_facts(_arch_facts(s, d))[1]


EDGES = """ae AS (SELECT o_orderkey AS key, 'c' || (o_custkey % 60) AS source, 'c' || (o_orderkey % 60) AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'uses' ELSE 'calls' END AS label, o_orderstatus AS relationship, ['forward', 'backward', 'both', 'none'][o_orderkey % 4 + 1] AS direction, (o_orderkey % 100) / 100.0::DOUBLE AS confidence FROM orders),
ab AS (SELECT *, least(source, target) AS a, greatest(source, target) AS b, CASE WHEN direction = 'both' THEN 3 WHEN direction = 'none' THEN 0 WHEN (direction = 'backward') <> (source > target) THEN 2 ELSE 1 END AS bits FROM ae WHERE source <> target),
g AS (SELECT a, b, min_by(source, key) AS source, min_by(target, key) AS target, min_by(label, key) AS l, min(relationship) AS r0, max(relationship) AS r1, bit_or(bits) AS bits, max(confidence) AS confidence, count(*) AS evidence FROM ab GROUP BY 1, 2)"""


def _arch_edges(s, d):
    k = F.col("o_orderkey")
    return P.table(s, d, "orders").select(k.alias("key"), F.concat(F.lit("c"), (F.col("o_custkey") % 60).cast("string")).alias("source"), F.concat(F.lit("c"), (k % 60).cast("string")).alias("target"), F.when(k % 2 == 0, "uses").otherwise("calls").alias("label"), F.col("o_orderstatus").alias("relationship"), F.element_at(F.array(*map(F.lit, ["forward", "backward", "both", "none"])), (k % 4 + 1).cast("int")).alias("direction"), ((k % 100) / F.lit(100.0)).alias("confidence"))


@query("SELECT source, target, CASE WHEN evidence = 1 THEN l ELSE '' END AS label, CASE WHEN r0 = r1 THEN r0 ELSE '' END AS relationship, CASE WHEN bits = 3 THEN 'both' WHEN bits = 0 THEN 'none' WHEN (bits = 2) <> (source <> a) THEN 'backward' ELSE 'forward' END AS direction, confidence, evidence FROM g", EDGES)
def merged_architecture_edges(s, d):
    return architecture.merged_edges(_arch_edges(s, d))


@query("SELECT g.source, g.target, 'edge ' || ab.key AS evidence FROM ab JOIN g USING (a, b)", EDGES)
def merged_edge_evidence(s, d):
    e = _arch_edges(s, d)
    return architecture.merged_evidence(e, e.select("key", F.concat(F.lit("edge "), F.col("key").cast("string")).alias("evidence")))


@query("SELECT key, degree FROM (SELECT k AS key, count(*) AS degree FROM (SELECT source AS k FROM ae WHERE source <> target AND source <> 'c7' AND target <> 'c7' UNION ALL SELECT target FROM ae WHERE source <> target AND source <> 'c7' AND target <> 'c7') GROUP BY 1)", EDGES)
def pruned_components(s, d):
    c = P.table(s, d, "orders").select(F.concat(F.lit("c"), (F.col("o_orderkey") % 70).cast("string")).alias("key")).where("key <> 'c7'").distinct()
    return architecture.pruned(c, _arch_edges(s, d))[0]


@query("""SELECT key, min_by(technology, model) FILTER (WHERE technology <> '') AS technology, min_by(description, model) FILTER (WHERE description <> '') AS description, min_by(path, model) FILTER (WHERE path <> '') AS path, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, (count(*) / 2)::BIGINT AS evidence
FROM (SELECT p_partkey % 50 AS key, p_partkey AS model, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS technology, CASE WHEN p_size % 4 = 0 THEN p_name END AS description, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE '' END AS path, unnest([p_brand, p_type]) AS tag FROM part) GROUP BY 1""")
def united_models(s, d):
    size = F.col("p_size")
    c = P.table(s, d, "part").select((F.col("p_partkey") % 50).alias("key"), F.col("p_partkey").alias("model"), F.when(size % 3 == 0, F.col("p_type")).otherwise("").alias("technology"), F.when(size % 4 == 0, F.col("p_name")).alias("description"), F.when(size % 5 == 0, F.col("p_brand")).otherwise("").alias("path"), F.array("p_brand", "p_type").alias("tags"), F.lit(1).cast("long").alias("evidence"))
    return architecture.union_models(c).withColumn("tags", F.array_join("tags", ","))


HOSTS = """defs AS (SELECT s_suppkey AS ordinal, 's' || (s_suppkey % 90) AS component, CASE WHEN s_suppkey % 2 = 0 THEN 'http://H' || (s_suppkey % 40) || '.prod:80' ELSE 'h' || (s_suppkey % 40) END AS host FROM supplier),
uses AS (SELECT DISTINCT 's' || (c_custkey % 120) AS component, 'h' || (c_custkey % 50) || CASE WHEN c_custkey % 3 = 0 THEN '.prod:443' ELSE '' END AS host, CASE WHEN c_custkey % 2 = 0 THEN 'grpc' END AS protocol FROM customer),
al AS (SELECT ordinal, component, unnest(list_distinct([h, split_part(h, '.', 1)])) AS h FROM (SELECT ordinal, component, lower(regexp_replace(regexp_replace(host, '^http://', ''), ':.*$', '')) AS h FROM defs)),
ow AS (SELECT h, max_by(component, ordinal) AS target FROM al GROUP BY 1)"""


@query("SELECT DISTINCT component AS source, target, coalesce(protocol, 'uses') AS label, 0.78::DOUBLE AS confidence FROM (SELECT component, protocol, regexp_replace(host, ':.*$', '') AS h FROM uses) u JOIN ow USING (h) WHERE component <> target", HOSTS)
def endpoint_edges(s, d):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    defs = P.table(s, d, "supplier").select(k.alias("ordinal"), F.concat(F.lit("s"), (k % 90).cast("string")).alias("component"), F.when(k % 2 == 0, F.concat(F.lit("http://H"), (k % 40).cast("string"), F.lit(".prod:80"))).otherwise(F.concat(F.lit("h"), (k % 40).cast("string"))).alias("host"))
    uses = P.table(s, d, "customer").select(F.concat(F.lit("s"), (c % 120).cast("string")).alias("component"), F.concat(F.lit("h"), (c % 50).cast("string"), F.when(c % 3 == 0, ".prod:443").otherwise("")).alias("host"), F.when(c % 2 == 0, "grpc").alias("protocol"))
    return architecture.endpoint_edges(defs, uses)


@query("""SELECT DISTINCT f.type, a.id AS source_id, b.id AS target_id, CASE f.type WHEN 'runtime.volume' THEN 'mounts' WHEN 'runtime.endpoint' THEN 'exposes' ELSE 'uses' END AS label
FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'runtime.volume' WHEN event_id % 3 = 1 THEN 'runtime.endpoint' ELSE 'runtime.connection' END AS type, 'f' || (user_id % 5) AS path, 'customer#' || (event_id % 40) AS s, 'customer#' || (user_id % 40) AS t FROM events) f
JOIN (SELECT path, n, min(id) AS id FROM (SELECT c_custkey AS id, 'f' || (c_custkey % 5) AS path, 'customer#' || (c_custkey % 45) AS n FROM customer) GROUP BY 1, 2) a ON a.path = f.path AND a.n = f.s
JOIN (SELECT path, n, min(id) AS id FROM (SELECT c_custkey AS id, 'f' || (c_custkey % 5) AS path, 'customer#' || (c_custkey % 45) AS n FROM customer) GROUP BY 1, 2) b ON b.path = f.path AND b.n = f.t WHERE a.id <> b.id""")
def runtime_connectors(s, d):
    e, c = F.col("event_id"), F.col("c_custkey")
    nodes = P.table(s, d, "customer").select(c.alias("id"), F.concat(F.lit("f"), (c % 5).cast("string")).alias("path"), F.concat(F.lit("Customer#"), (c % 45).cast("string")).alias("name"))
    facts = P.table(s, d, "events").select(F.when(e % 3 == 0, "runtime.volume").when(e % 3 == 1, "runtime.endpoint").otherwise("runtime.connection").alias("type"), F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")).alias("path"), F.concat(F.lit(" Customer#"), (e % 40).cast("string")).alias("source"), F.concat(F.lit("customer#"), (F.col("user_id") % 40).cast("string")).alias("target"))
    return architecture.runtime_edges(nodes, facts)


@query("""SELECT DISTINCT v.value, min(r.id) AS id FROM (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'https://host/org/Repo' || (c_custkey % 30) || '.git' WHEN c_custkey % 3 = 1 THEN '/src/repo' || (c_custkey % 30) ELSE 'git@host:ORG/repo' || (c_custkey % 30) END AS value FROM customer) v
JOIN (SELECT s_suppkey AS id, s_suppkey % 25 AS n FROM supplier) r ON lower(v.value) IN ('/src/repo' || r.n, 'https://host/org/repo' || r.n || '.git', 'git@host:org/repo' || r.n) GROUP BY 1""")
def repository_matches(s, d):
    c, k = F.col("c_custkey"), F.col("s_suppkey")
    num = lambda x: x.cast("string")
    values = P.table(s, d, "customer").select(F.when(c % 3 == 0, F.concat(F.lit("https://host/org/Repo"), num(c % 30), F.lit(".git"))).when(c % 3 == 1, F.concat(F.lit("/src/repo"), num(c % 30))).otherwise(F.concat(F.lit("git@host:ORG/repo"), num(c % 30))).alias("value"))
    repos = P.table(s, d, "supplier").select(k.alias("id"), F.concat(F.lit("/src/repo"), num(k % 25)).alias("root"), F.concat(F.lit("https://host/org/repo"), num(k % 25), F.lit(".git")).alias("remote"))
    return architecture.repository_of(values, repos)


# -- names, keys, text -------------------------------------------------------

NAMES = """nm AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'HTTPServer' || p_size || replace(p_name, ' ', '') WHEN 1 THEN replace(p_name, ' ', '_') || 'Service' WHEN 2 THEN upper(p_brand) || '-paymentdb' ELSE p_type || 'Api2Client' END AS name FROM part),
tk AS (SELECT p_partkey, name, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z0-9])', '\\1 \\2', 'g'), '([A-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')),
  '([a-z0-9])(controller|database|adapter|gateway|handler|service|client|server|worker|store|api|svc|db)( |$)', '\\1 \\2\\3', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> '') AS tokens FROM nm)"""


def _names(s, d):
    p, k = P.table(s, d, "part"), F.col("p_partkey")
    flat = F.replace("p_name", F.lit(" "), F.lit(""))
    return p.select(k, F.when(k % 4 == 0, F.concat(F.lit("HTTPServer"), F.col("p_size").cast("string"), flat)).when(k % 4 == 1, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("Service"))).when(k % 4 == 2, F.concat(F.upper("p_brand"), F.lit("-paymentdb"))).otherwise(F.concat("p_type", F.lit("Api2Client"))).alias("name"))


@query("SELECT p_partkey, array_to_string(tokens, ' ') AS tokens FROM tk", NAMES)
def name_tokens(s, d):
    return _names(s, d).select("p_partkey", F.array_join(naming.name_tokens(F.col("name")), " ").alias("tokens"))


@query("SELECT p_partkey, CASE WHEN length(root) >= 3 THEN root END AS root FROM (SELECT p_partkey, array_to_string(list_filter(tokens, lambda x: x NOT IN ('service', 'svc', 'api', 'db', 'database', 'store', 'client', 'server', 'worker', 'gateway', 'adapter', 'controller', 'handler')), '-') AS root FROM tk)", NAMES)
def service_roots(s, d):
    return _names(s, d).select("p_partkey", naming.service_root(F.col("name")).alias("root"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(l, 'watch|scan|represent|materializ|embedding') THEN 'role:watch' END, CASE WHEN regexp_matches(l, 'cmd/|cli|command|cobra') THEN 'role:cli' END, CASE WHEN regexp_matches(l, 'api|http|server|handler|route|rpc|websocket') THEN 'role:api' END,
  CASE WHEN regexp_matches(l, 'store|db|database|sqlite|migration|schema|repository') THEN 'role:persistence' END, CASE WHEN regexp_matches(l, 'frontend|component|view|react|canvas|zui') THEN 'role:ui' END, CASE WHEN regexp_matches(l, 'analyzer|symbol|parser|importer|planner|dependency') THEN 'role:analysis' END,
  CASE WHEN regexp_matches(l, 'git|version|history|commit|branch') THEN 'role:versioning' END, CASE WHEN regexp_matches(l, 'config|setting|option|threshold') THEN 'role:config' END, CASE WHEN regexp_matches(l, 'test|fixture|mock') THEN 'role:test' END], lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT p_partkey, lower(name) AS l FROM nm)""", NAMES)
def role_tags(s, d):
    return _names(s, d).select("p_partkey", F.array_join(naming.role_tags(F.col("name")), ",").alias("tags"))


@query("SELECT id, 'area:' || trim(regexp_replace(lower(split_part(path, '/', 1)), '[^a-z0-9]+', '-', 'g'), '-') AS area, CASE WHEN kind <> 'region' THEN 'kind:' || kind END AS kind, CASE WHEN regexp_matches(name, '^\\p{Lu}') THEN 'graph:entrypoint' ELSE '' END AS graph FROM sym", SYMBOLS)
def symbol_tags(s, d):
    e = _symbols(s, d)
    return e.select("id", naming.area_tag(F.col("path")).alias("area"), naming.prefixed_tag("kind", F.col("kind"), ("region",)).alias("kind"), F.array_join(naming.graph_tags(F.col("name"), F.lit(0), F.lit(0)), ",").alias("graph"))


@query("""SELECT p_partkey, path, CASE WHEN f = 0 THEN 100 WHEN f = 1 THEN 100 WHEN f = 2 THEN 95 WHEN f = 3 THEN 90 WHEN f = 4 THEN 85 WHEN f = 5 THEN 80 WHEN f = 6 THEN 70 WHEN f = 7 THEN 88 WHEN f = 8 THEN 40 WHEN f = 9 THEN 60 ELSE 0 END AS score
FROM (SELECT p_partkey, p_partkey % 11 AS f, p_type || '/' || ['Dockerfile', 'docker-compose.dev.yml', 'values.yaml', 'CODEOWNERS', 'go.mod', 'api.proto', 'README.md', 'k8s/app.yaml', 'other.yml', 'main.go', 'x.go'][p_partkey % 11 + 1] AS path FROM part)""")
def path_scores(s, d):
    names = ["Dockerfile", "docker-compose.dev.yml", "values.yaml", "CODEOWNERS", "go.mod", "api.proto", "README.md", "k8s/app.yaml", "other.yml", "main.go", "x.go"]
    p = P.table(s, d, "part").select("p_partkey", F.concat_ws("/", "p_type", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 11 + 1).cast("int"))).alias("path"))
    return p.select("p_partkey", "path", naming.path_score(F.col("path")).alias("score"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || '/f' || p_size || '.go' END AS path, p_brand || '.a,' || p_type || '.b' AS pair, CASE WHEN p_partkey % 3 = 0 THEN p_type || ':x.go' END AS summary_file, CASE WHEN p_partkey % 3 = 0 THEN 'dependency.import' END AS summary_type FROM part""")
def parsed_keys(s, d):
    p, k = P.table(s, d, "part"), F.col("p_partkey")
    path = F.concat(F.col("p_type"), F.lit("/f"), F.col("p_size").cast("string"), F.lit(".go"))
    key = F.when(k % 2 == 0, F.concat(F.lit("func:"), path, F.lit(":Name:1:2"))).otherwise(F.concat(F.lit("func:"), path))
    pair = F.concat("p_brand", F.lit(".a -> "), "p_type", F.lit(".b"))
    summary = F.when(k % 3 == 0, F.concat(F.lit("fact-summary:"), "p_type", F.lit(":x.go:dependency.import:0123456789abcdef0123"))).otherwise(F.concat(F.lit("fact:"), "p_type", F.lit(":x")))
    who = naming.fact_summary_identity(summary)
    return p.select("p_partkey", naming.path_of_stable_key(key).alias("path"), F.array_join(naming.paths_of_pair(pair), ",").alias("pair"), who["file"].alias("summary_file"), who["type"].alias("summary_type"))


CATALOG = """cat AS (SELECT DISTINCT lower(p_type) AS alias FROM part)"""


@query("""SELECT p_partkey, alias FROM (SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 IN (1, 3) AND split_part(p_name, ' ', 1) IN (SELECT alias FROM cat) THEN split_part(p_name, ' ', 1) END, CASE WHEN p_partkey % 4 IN (1, 3) AND split_part(p_name, ' ', 2) IN (SELECT alias FROM cat) THEN split_part(p_name, ' ', 2) END, CASE WHEN p_partkey % 4 <> 3 THEN lower(p_type) END) AS alias FROM part) WHERE alias IS NOT NULL""", CATALOG)
def catalog_match(s, d):
    p, k = P.table(s, d, "part"), F.col("p_partkey")
    label = F.when(k % 4 == 0, F.concat(F.lit(" "), "p_type", F.lit(" "))).when(k % 4 == 1, F.concat("p_name", F.lit(" / "), F.lower("p_type"))).when(k % 4 == 2, F.concat("p_brand", F.lit(";my"), "p_type", F.lit(" the "), "p_type", F.lit("-db"))).otherwise(F.col("p_name"))
    return resolve.catalog_matches(p.select(k.alias("id"), label.alias("label")), p.select(F.lower("p_type").alias("alias")).distinct()).select(F.col("id").alias("p_partkey"), "alias")


CODE = "code AS (SELECT p_partkey, chr(10) || '    if ' || p_name || ':' || chr(10) || '        return ' || p_size || chr(10) || chr(10) || chr(9) || '  yield ' || p_type || chr(10) AS body, p_type AS name FROM part)"


def _code(s, d):
    nl = F.lit("\n")
    return P.table(s, d, "part").select("p_partkey", F.concat(nl, F.lit("    if "), "p_name", F.lit(":"), nl, F.lit("        return "), F.col("p_size").cast("string"), nl, nl, F.lit("\t  yield "), "p_type", nl).alias("body"), F.col("p_type").alias("name"))


@query("""SELECT p_partkey, array_to_string(list_concat(list_concat(m1, ['indent:1']), list_concat(list_concat(m2, ['indent:2']), list_concat(m3, ['indent:1']))), ' ') AS tokens FROM (
  SELECT p_partkey, list_filter(['if', 'for', 'while', 'switch', 'match', 'try', 'catch', 'except', 'return', 'yield', 'throw', 'raise', 'defer', 'go'], lambda w: contains('if ' || p_name || ':', w)) AS m1,
    list_filter(['if', 'for', 'while', 'switch', 'match', 'try', 'catch', 'except', 'return', 'yield', 'throw', 'raise', 'defer', 'go'], lambda w: contains('return ' || p_size, w)) AS m2,
    list_filter(['if', 'for', 'while', 'switch', 'match', 'try', 'catch', 'except', 'return', 'yield', 'throw', 'raise', 'defer', 'go'], lambda w: contains('yield ' || p_type, w)) AS m3 FROM part)""")
def structural_tokens(s, d):
    return _code(s, d).select("p_partkey", F.array_join(naming.structural_tokens(F.col("body")), " ").alias("tokens"))


@query("SELECT p_partkey, 'if ' || p_name || ':' || chr(10) || '     return ' || p_size || chr(10) || chr(10) || 'yield __symbol__' AS body, '    if ' || p_name || ':' AS second FROM (SELECT *, 1 FROM part)")
def normalised_content(s, d):
    c = _code(s, d).withColumn("body", F.replace("body", F.lit("        return"), F.lit("\t       return"))).withColumn("lined", F.replace("body", F.lit("\t"), F.lit("    ")))
    even = F.regexp_replace("lined", "(?m)^      yield", "    yield")
    body = F.regexp_replace(even, "(?m)^           return", "         return")
    return c.select("p_partkey", naming.normalised_content(body, F.col("name")).alias("body"), naming.line_range(F.col("body"), 2, 2).alias("second"))


@query("""SELECT view_id, target_element_id, CASE WHEN n = 1 THEN coalesce(first_label, 'Cross-view') WHEN len(labels) = 1 THEN n || ' × ' || labels[1] ELSE n || ' connectors' END AS label
FROM (SELECT view_id, target_element_id, count(*) AS n, list_distinct(list(label) FILTER (WHERE label IS NOT NULL)) AS labels, coalesce(min_by(label, id) FILTER (WHERE label IS NOT NULL), min_by(relationship, id)) AS first_label FROM connectors GROUP BY 1, 2)""")
def proxy_labels(s, d):
    g = P.connectors(s, d).groupBy("view_id", "target_element_id").agg(F.count("*").alias("n"), F.collect_set("label").alias("labels"), F.coalesce(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("id"))), F.min_by("relationship", "id")).alias("first"))
    return g.select("view_id", "target_element_id", naming.proxy_label(F.col("n"), F.col("labels"), F.col("first")).alias("label"))


@query("""SELECT n_nationkey, concat_ws(', ', CASE WHEN c = 1 THEN '1 view changed' WHEN c > 0 THEN c || ' views changed' END, CASE WHEN i = 1 THEN '1 view initialized' WHEN i > 0 THEN i || ' views initialized' END, CASE WHEN c = 0 AND i = 0 THEN '0 views changed' END, CASE WHEN a > 0 THEN '+' || a END, CASE WHEN r > 0 THEN '-' || r END) AS line
FROM (SELECT n_nationkey, n_nationkey % 3 AS c, n_nationkey % 2 AS i, n_nationkey % 5 AS a, n_nationkey % 4 AS r FROM nation)""")
def stat_lines(s, d):
    k = F.col("n_nationkey")
    return P.table(s, d, "nation").select(k, naming.stat_line("view", k % 3, k % 2, k % 5, k % 4).alias("line"))


@query("SELECT p_partkey, sha256(p_name || chr(0) || coalesce(CASE WHEN p_size % 2 = 0 THEN p_type END, chr(1)) || chr(0) || CASE WHEN p_brand < p_type THEN p_brand || ',' || p_type ELSE p_type || ',' || p_brand END) AS hash FROM part")
def resource_hashes(s, d):
    p = P.table(s, d, "part")
    return p.select("p_partkey", workspace.resource_hash(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), tags=F.array("p_type", "p_brand", F.lit("git:staged"), F.col("p_type"))).alias("hash"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type || '/' || p_brand || ' & co'), '[^a-z0-9]+', '-', 'g'), '-') AS architecture, lower(p_type) || '-' || replace(lower(p_brand), '#', '#') || '-and-co' AS tag FROM part")
def slug_variants(s, d):
    label = F.concat("p_type", F.lit("/"), "p_brand", F.lit(" & co"))
    return P.table(s, d, "part").select("p_partkey", naming.architecture_slug(label).alias("architecture"), naming.tag_value(label).alias("tag"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.none'), '') AS none FROM events")
def parsed_json(s, d):
    return P.table(s, d, "events").select("event_id", text.json_field(F.col("props"), "k", "long", F.lit(-1)).alias("k"), text.json_field(F.col("props"), "none", "string", F.lit("")).alias("none"))
