"""The driver's tables seen as the graph's relations, and the same as SQL common table expressions.

elements: region 1e6+key, nation 2e6+key, supplier 3e6+key, customer 4e6+key.
views: 0 (root), 100+region, 1000+nation, owned by the region or nation. A placement
has its element's id. A connector is a lineitem: customer -> supplier, in the view of the customer's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {"region": 1_000_000, "nation": 2_000_000, "supplier": 3_000_000, "customer": 4_000_000}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def elements(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, name, description (null for even keys), technology."""
    out = None
    for kind, base in BASE.items():
        p = kind[0]
        key = F.col(f"{p}_{kind[:4]}key" if kind in ("supplier",) else f"{p}_{'cust' if kind == 'customer' else kind}key").cast("long")
        tech = F.col("c_mktsegment") if kind == "customer" else F.lit(None).cast("string")
        one = table(spark, d, kind).select((key + base).alias("id"), F.lit(kind).alias("kind"), F.col(f"{p}_name").alias("name"), F.when(key % 2 == 1, F.concat(F.lit("about "), F.col(f"{p}_name"))).alias("description"), tech.alias("technology"))
        out = one if out is None else out.unionByName(one)
    return out


def views(spark: SparkSession, d: str) -> DataFrame:
    """id, owner_element_id, name."""
    root = spark.range(1).select(F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("owner_element_id"), F.lit("root").alias("name"))
    r = table(spark, d, "region").select((F.col("r_regionkey") + 100).cast("long").alias("id"), (F.col("r_regionkey") + BASE["region"]).cast("long").alias("owner_element_id"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), (F.col("n_nationkey") + BASE["nation"]).cast("long").alias("owner_element_id"), F.col("n_name").alias("name"))
    return root.unionByName(r).unionByName(n)


def placements(spark: SparkSession, d: str) -> DataFrame:
    """view_id, element_id."""
    pick = lambda t, view, e: table(spark, d, t).select(view.cast("long").alias("view_id"), e.cast("long").alias("element_id"))
    out = pick("region", F.lit(0), F.col("r_regionkey") + BASE["region"])
    out = out.union(pick("nation", F.col("n_regionkey") + 100, F.col("n_nationkey") + BASE["nation"]))
    out = out.union(pick("supplier", F.col("s_nationkey") + 1000, F.col("s_suppkey") + BASE["supplier"]))
    return out.union(pick("customer", F.col("c_nationkey") + 1000, F.col("c_custkey") + BASE["customer"]))


def connectors(spark: SparkSession, d: str) -> DataFrame:
    """id, view_id, source_element_id, target_element_id, label, relationship, line."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("view_id"), (F.col("o_custkey") + BASE["customer"]).alias("source_element_id"), (F.col("l_suppkey") + BASE["supplier"]).alias("target_element_id"), F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("label"), F.col("l_returnflag").alias("relationship"), F.col("l_linenumber").cast("int").alias("line"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """element_id, score, tier: filter decisions of suppliers and customers."""
    c = table(spark, d, "customer").select((F.col("c_custkey") + BASE["customer"]).alias("element_id"), (F.col("c_acctbal") / 10000).alias("score"), (F.col("c_custkey") % 12).cast("int").alias("tier"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + BASE["supplier"]).alias("element_id"), (F.col("s_acctbal") / 10000).alias("score"), (F.col("s_suppkey") % 12).cast("int").alias("tier"))
    return c.union(s)


def links(spark: SparkSession, d: str) -> DataFrame:
    """element_id, confidence: architecture links of suppliers and customers whose key divides by 3."""
    e = elements(spark, d).where(F.col("kind").isin("supplier", "customer"))
    key = F.col("id") % 1_000_000
    return e.where(key % 3 == 0).select(F.col("id").alias("element_id"), ((key % 100) / F.lit(100.0)).alias("confidence"))


def overrides(spark: SparkSession, d: str) -> DataFrame:
    """view_id, element_id, delta from -4 to 4, for keys below 9 modulo 97."""
    key = F.col("element_id") % 1_000_000
    return placements(spark, d).where((F.col("element_id") >= BASE["supplier"]) & (key % 97 < 9)).select("view_id", "element_id", (key % 97 - 4).cast("int").alias("delta"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, type, enricher, confidence, file_path from documents and labels."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(lab, "doc_id", "left").select("doc_id", F.col("source").alias("type"), F.col("lang").alias("enricher"), F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("confidence"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("file_path"), "n_chars")


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, ts, repository_id, change_type, path."""
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("repository_id"), F.col("event_type").alias("change_type"), F.get_json_object("props", "$.k").alias("path"), "value")


CTE = """
elements AS (
  SELECT r_regionkey::BIGINT + 1000000 AS id, 'region' AS kind, r_name AS name, CASE WHEN r_regionkey % 2 = 1 THEN 'about ' || r_name END AS description, NULL::VARCHAR AS technology FROM region
  UNION ALL SELECT n_nationkey::BIGINT + 2000000, 'nation', n_name, CASE WHEN n_nationkey % 2 = 1 THEN 'about ' || n_name END, NULL FROM nation
  UNION ALL SELECT s_suppkey + 3000000, 'supplier', s_name, CASE WHEN s_suppkey % 2 = 1 THEN 'about ' || s_name END, NULL FROM supplier
  UNION ALL SELECT c_custkey + 4000000, 'customer', c_name, CASE WHEN c_custkey % 2 = 1 THEN 'about ' || c_name END, c_mktsegment FROM customer),
views AS (
  SELECT 0::BIGINT AS id, NULL::BIGINT AS owner_element_id, 'root' AS name
  UNION ALL SELECT r_regionkey::BIGINT + 100, r_regionkey::BIGINT + 1000000, r_name FROM region
  UNION ALL SELECT n_nationkey::BIGINT + 1000, n_nationkey::BIGINT + 2000000, n_name FROM nation),
placements AS (
  SELECT 0::BIGINT AS view_id, r_regionkey::BIGINT + 1000000 AS element_id FROM region
  UNION ALL SELECT n_regionkey::BIGINT + 100, n_nationkey::BIGINT + 2000000 FROM nation
  UNION ALL SELECT s_nationkey::BIGINT + 1000, s_suppkey + 3000000 FROM supplier
  UNION ALL SELECT c_nationkey::BIGINT + 1000, c_custkey + 4000000 FROM customer),
connectors AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, c_nationkey::BIGINT + 1000 AS view_id, o_custkey + 4000000 AS source_element_id, l_suppkey + 3000000 AS target_element_id,
         CASE WHEN l_linestatus = 'O' THEN l_linestatus END AS label, l_returnflag AS relationship, l_linenumber::INT AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
decisions AS (
  SELECT c_custkey + 4000000 AS element_id, c_acctbal / 10000 AS score, (c_custkey % 12)::INT AS tier FROM customer
  UNION ALL SELECT s_suppkey + 3000000, s_acctbal / 10000, (s_suppkey % 12)::INT FROM supplier),
links AS (SELECT id AS element_id, ((id % 1000000) % 100) / 100.0::DOUBLE AS confidence FROM elements WHERE id >= 3000000 AND id % 1000000 % 3 = 0),
overrides AS (SELECT view_id, element_id, (element_id % 1000000 % 97 - 4)::INT AS delta FROM placements WHERE element_id >= 3000000 AND element_id % 1000000 % 97 < 9),
facts AS (
  SELECT d.doc_id, source AS type, lang AS enricher, coalesce(quality::DOUBLE, 0.5) AS confidence, source || '/' || lang || '/' || d.doc_id AS file_path, n_chars
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id),
ev AS (SELECT event_id, ts, user_id AS repository_id, event_type AS change_type, json_extract_string(props, '$.k') AS path, value FROM events)
"""


def sql(body: str, more: str = "", recursive: bool = False) -> str:
    """A statement over the relations; more: further common table expressions."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{CTE}{', ' + more if more else ''}\n{body}"
