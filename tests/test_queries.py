"""Queries against DuckDB on the smallest tables, and operators on small fixtures."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborlens.functions import text
from arborlens.operators import density, diff, graph, resolve
from arborlens.plans import catalog, registry
from arborlens.sources import workspace
from arborlens.streaming import changes

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

def canon(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str)) else str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = canon(df.select(*cols).collect())
    rel = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == canon([[r[i] for i in at] for r in rel.fetchall()])


def test_promoted_connector_brings_both_ends(spark):
    made = spark.createDataFrame([(1, 201, 101, 102, 1.0, 0), (1, 202, 105, 106, 0.5, 1), (1, 203, 105, 101, 0.4, 0), (1, 204, 107, 101, 0.3, 0)], "view_id long, id long, source_element_id long, target_element_id long, score double, delta int")
    shown = spark.createDataFrame([(1, 101), (1, 102)], "view_id long, element_id long")
    assert sorted(r["id"] for r in density.admitted(made, shown).collect()) == [201, 202, 203]
    assert sorted(r["id"] for r in density.admitted(made, shown, 1).collect()) == [201, 202]


def test_visibility_is_the_least_fixpoint(spark):
    seeds = spark.createDataFrame([(1, 1.2, False), (2, 0.0, False), (3, -1.5, False), (4, 0.0, True), (5, 0.0, False)], "id long, base double, forced boolean")
    refs = spark.createDataFrame([(1, 2), (2, 3), (2, 3), (4, 3), (3, 5), (5, 1)], "source long, target long")
    got = {r["id"]: (r["visible"], r["score"]) for r in graph.visibility(seeds, refs).collect()}
    assert got == {1: (True, 1.2), 2: (True, 1.0), 3: (True, 1.5), 4: (True, 0.0), 5: (True, 1.0)}


def test_layout_levels_by_hand(spark, duck):
    edges = duck.execute(registry.P.sql("SELECT DISTINCT view_id, source_element_id, target_element_id FROM connectors")).fetchall()
    into, nodes = {}, set()
    for v, a, b in edges:
        into.setdefault((v, b), []).append((v, a))
        nodes |= {(v, a), (v, b)}
    level = lambda x: max((level(y) + 1 for y in into.get(x, [])), default=0)
    assert sorted(tuple(r) for r in registry.layout_levels(spark, D).collect()) == sorted((*x, level(x)) for x in nodes)


def test_levels_of_chains_and_cycles(spark):
    edges = [(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 3, 4), (1, 5, 6), (1, 6, 5), (1, 6, 7), (1, 8, 8), (2, 3, 1), (2, 3, 1)]
    got = {(r[0], r[1]): r[2] for r in graph.levels(spark.createDataFrame(edges, "view_id long, source long, target long")).collect()}
    # Two cycles (5 and 6; 8 with itself) and 7 behind one: eight elements, so level 7.
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (1, 5): 7, (1, 6): 7, (1, 7): 7, (1, 8): 7, (2, 3): 0, (2, 1): 1}


def test_lineage_cuts_cycles(spark):
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3)], "view_id long, parent_id long")
    got = {(r[0], r[1]) for r in graph.lineage(parents).select("view_id", "ancestor_id").collect()}
    assert got == {(1, 1), (2, 2), (2, 1), (3, 3), (3, 4), (4, 4), (4, 3)}


def test_lineage_of_a_deep_chain(spark):
    parents = spark.createDataFrame([(i, i - 1 if i else None) for i in range(67)], "view_id long, parent_id long")
    assert graph.lineage(parents).groupBy().max("depth").first()[0] == 66


def test_dirty_rows_survive(spark):
    made = spark.createDataFrame([(1, "new"), (2, "new")], "k long, value string")
    kept = spark.createDataFrame([(1, "mine", "h1", "h0"), (2, "old", "h", "h"), (3, "gone", "h", "h")], "k long, value string, hash string, last_hash string")
    assert {(r["k"], r["value"]) for r in diff.preserve_dirty(made, kept, "k").collect()} == {(1, "mine"), (2, "new")}


def test_table_swap(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (3, 5):
        diff.replace_table(spark.range(n), path)
    assert diff.read_table(spark, path).count() == 5
    assert len(list((tmp_path / "t").glob("v-*"))) == 2


def test_text_functions(spark):
    df = spark.createDataFrame([("getHTTPName_v2",)], "s string")
    row = df.select(text.identifier_tokens(F.col("s")).alias("t"), text.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0))).alias("c"), text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert "get" in row["t"] and "v2" in row["t"] and abs(row["c"] - 1) < 1e-12 and row["z"] == 0


def test_scan_and_symbols(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "m.py").write_text("class C:\n    def f(self):\n        pass\n")
    (tmp_path / "a" / "bad.py").write_text("def (")
    (tmp_path / "node_modules" / "x.js").write_text("1")
    files = workspace.scan(spark, f"file://{tmp_path}")
    assert {r["path"] for r in files.collect()} == {"a/m.py", "a/bad.py"}
    assert {(r["name"], r["kind"], r["parent"]) for r in workspace.python_symbols(files).collect()} == {("C", "class", None), ("f", "function", "C")}


def test_mermaid():
    nodes, edges = workspace.mermaid("graph TD\n A[Web] -->|calls| B(API)\n B <--> C")
    assert nodes == [("A", "Web"), ("B", "API"), ("C", "C")]
    assert edges == [("A", "B", "calls", "forward"), ("B", "C", None, "both")]


def test_stream_of_two_batches_equals_batch(spark, tmp_path):
    src = f"{tmp_path}/in"
    e = registry.P.events(spark, D).select("ts", "event_id", "repository_id", "path", "change_type")
    e.where("event_id < 500").coalesce(1).write.parquet(src)
    import os
    import time

    time.sleep(1.1)
    e.where("event_id >= 500").coalesce(1).write.mode("append").parquet(src)
    assert len([f for f in os.listdir(src) if f.endswith(".parquet")]) == 2
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    (changes.changed_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination())
    got = sorted((r["event_id"], r["repository_id"], r["change_type"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((r["event_id"], r["repository_id"], r["change_type"]) for r in changes.changed_only(e).collect())


def test_micro_batches_are_written_once(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [(1, "a", "added", "h1"), (2, "a", "updated", "h2"), (3, "b", "added", "h3")]
    made = spark.createDataFrame(rows, "event_id long, path string, change_type string, hash string").selectExpr("*", "timestamp_seconds(event_id) as ts")
    for i in range(2):
        made.where(f"(event_id <= 2) = {i == 0}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(src)
    known = spark.createDataFrame([("b", "h3")], "path string, hash string")
    for _ in range(2):
        changes.run_once(stream, lambda b: changes.pipeline(b, known), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("path", "change_type", "hash").collect()] == [("a", "updated", "h2")]


def test_debounce_with_a_watermark(spark, tmp_path):
    src = f"{tmp_path}/in"
    e = registry.P.events(spark, D).select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "repository_id", "path")
    e.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    (changes.debounced(stream, "6 hours", "1 minute").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination())
    got = {(r["repository_id"], r["started"], r["events"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["repository_id"], r["started"], r["events"]) for r in changes.debounced(e, "6 hours").collect()}
    assert got and got <= want


def test_subscribers_lose_nothing(spark):
    e = spark.range(1, 6).withColumnRenamed("id", "event_id")
    got = changes.fan_out(e, spark.createDataFrame([("a", 1), ("b", 4)], "subscriber string, since long"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", i, i) for i in range(1, 6)] + [("b", 4, 1), ("b", 5, 2)]


def test_counters_reset(spark):
    c = spark.createDataFrame([(1, 5), (2, 7), (3, 1)], "started int, n long")
    assert [r["total"] for r in changes.reset_counters(c, 2).orderBy("started").collect()] == [7, 8]


def test_numbered_rows(spark):
    from arborlens.operators import relational

    got = relational.numbered(spark.range(1000).repartition(7).selectExpr("id * 3 % 1000 as k"), ["k"])
    assert all(r["k"] == r["place"] for r in got.collect()) and got.count() == 1000


def test_free_cell():
    from arborlens.operators import layout

    rows = [("place", 1, 0.0, 0.0), ("place", 2, 2.0, 0.0), ("place", 3, None, None)]
    pdf = pd.DataFrame([(7, k, e, x, y, None, None) for k, e, x, y in rows] + [(7, "edge", None, None, None, 3, 1), (7, "edge", None, None, None, 3, 2)], columns=["view_id", "kind", "element_id", "x", "y", "source", "target"])
    assert layout.free_cell(pdf)[["element_id", "x", "y"]].values.tolist() == [[3, 1, 0]]


def test_cycles_get_a_root(spark):
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 4)], "view_id long, parent_id long")
    assert [r[0] for r in graph.roots_of_cycles(parents, graph.lineage(parents)).collect()] == [3]


def test_catalog_search_takes_a_broken_expression(spark):
    df = spark.createDataFrame([(1, "a (b"), (2, "c")], "id long, t string")
    assert [r["id"] for r in resolve.catalog_search(df, F.col("t"), "(b", "id").collect()] == [1]


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    spark.createDataFrame([(1, "a"), (2, "b")], "n long, f string").write.partitionBy("f").parquet(path)
    diff.replace_partitions(spark.createDataFrame([(3, "b")], "n long, f string"), path, "f")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("n", "f").collect()) == [(1, "a"), (3, "b")]


def test_tag_colours(spark):
    from arborlens.operators import workspace as ws

    tags = spark.createDataFrame([("x", ws.COLOURS[0]), ("a", None), ("b", None)], "tag string, colour string")
    got = dict(tuple(r) for r in ws.tag_colours(tags).collect())
    assert got == {"x": ws.COLOURS[0], "a": ws.COLOURS[1], "b": ws.COLOURS[2]}


def test_scalars(spark):
    from arborlens.functions import embedding

    df = spark.createDataFrame([("one two three four five",)], "s string")
    assert df.select(text.approximate_tokens(F.col("s"))).first()[0] == 6
    assert df.select(embedding.healthy(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.5)))).first()[0]
    dense = embedding.dense(spark.createDataFrame([(1, 0, 0.6), (1, 2, 0.8)], "k long, idx long, value double"), "k", 4).first()
    assert dense["vector"] == [0.6, 0.0, 0.8, 0.0]
