"""Nested merges, materialised repositories, proxies by viewport, fact scores: fixtures."""

import math

from pyspark.sql import functions as F

from arborlens.functions import embedding, enrich
from arborlens.operators import crossview, graph, materialise, sections

ROWS = "key string, parent string, place int, position_x double, position_y double, label string, visibility string"


def test_sections_merge_by_parent(spark):
    actions = spark.createDataFrame([("api", "merged"), ("web", "kept"), ("db", "server"), ("gone", "deleted")], "key string, action string")
    local = [("api", "root", 0, 1.0, 1.0, "mine", ""), ("api", "extra", 1, 5.0, 5.0, "here", "1"), ("api", None, 2, 0.0, 0.0, "loose", None), ("web", "root", 0, 3.0, 3.0, "w", ""), ("db", "root", 0, 4.0, 4.0, "local", ""), ("gone", "root", 0, 0.0, 0.0, "x", "")]
    server = [("api", "root", 0, 8.0, 8.0, "older", "x"), ("api", "root", 3, 9.0, 9.5, " theirs ", "2"), ("api", "new", 1, 7.0, 7.0, "there", None), ("web", "root", 0, 0.0, 0.0, "s", ""), ("db", "other", 0, 6.0, 6.0, "server", "")]
    rows, conflicts = sections.merge_sections(actions, spark.createDataFrame(local, ROWS), spark.createDataFrame(server, ROWS), ["position_x", "position_y"], ["label", "visibility"])
    got = {(r["key"], r["parent"]): (r["position_x"], r["position_y"], r["label"], r["visibility"], r["side"]) for r in rows.collect()}
    assert got == {
        ("api", "root"): (9.0, 9.5, "<<< LOCAL\nmine\n===\ntheirs\n>>> SERVER", "2", "both"),
        ("api", "extra"): (5.0, 5.0, "here", "1", "local"), ("api", None): (0.0, 0.0, "loose", None, "local"), ("api", "new"): (7.0, 7.0, "there", None, "server"),
        ("web", "root"): (3.0, 3.0, "w", "", "local"), ("db", "other"): (6.0, 6.0, "server", "", "server"),
    }
    assert [tuple(r) for r in conflicts.collect()] == [("api", "root", "label", "mine", "theirs")]


def test_a_repository_keeps_ids_and_edited_names(spark):
    symbols = spark.createDataFrame([("a", "A", "cmd/main.go", 1), ("b", "B", "cmd/main.go", 5), ("c", "C", "cmd/main.go", 9), ("d", "D", "lib/x/util.go", 1), ("e", "E", "top.go", 1)], "key string, name string, path string, line int")
    refs = spark.createDataFrame([("a", "b", "call"), ("a", "c", "call"), ("a", "d", "use"), ("b", "d", "call"), ("e", "a", "call"), ("a", "a", "call"), ("a", "zz", "call")], "source string, target string, kind string")
    known = spark.createDataFrame([("symbol:b", 40, "My B", "edited", "h"), ("folder:cmd", 41, "cmd", "h", "h"), ("symbol:old", 42, "Old", "h", "h"), ("symbol:kept", 43, "Kept", "edited", "h"), ("symbol:shown", 44, "Shown", "h", "h")], "owner_key string, id long, name string, hash string, last_hash string")
    views = spark.createDataFrame([("folder:cmd", 7)], "owner_key string, id long")
    made = materialise.materialised("shop", symbols, refs, known, views, 2)
    e = {r["owner_key"]: r for r in made.elements.collect()}
    cluster = {r["name"]: k for k, r in e.items() if r["kind"] == "cluster"}
    assert set(cluster) == {"main.go cluster 1", "main.go cluster 2"} and len({r["id"] for r in e.values()}) == len(e) == 14
    assert (e["symbol:b"]["id"], e["symbol:b"]["name"], e["symbol:b"]["dirty"]) == (40, "My B", True) and e["folder:cmd"]["id"] == 41
    assert min(r["id"] for k, r in e.items() if k not in ("symbol:b", "folder:cmd")) == 45
    assert (e["symbol:a"]["parent"], e["symbol:c"]["parent"], e["symbol:d"]["parent"], e["file:top.go"]["parent"], e["folder:lib/x"]["parent"]) == (cluster["main.go cluster 1"], cluster["main.go cluster 2"], "file:lib/x/util.go", "repository:1", "folder:lib")
    v = {r["owner_key"]: r["id"] for r in made.views.collect()}
    assert v["folder:cmd"] == 7 and len(v) == 9 and not any(k.startswith("symbol:") for k in v)
    back = {r["id"]: k for k, r in e.items()}
    homes = {i: k for k, i in v.items()}
    drawn = {(homes[r["view_id"]], back[r["source_id"]], back[r["target_id"]]): (r["n"], r["kinds"]) for r in made.connectors.collect()}
    assert drawn == {
        (cluster["main.go cluster 1"], "symbol:a", "symbol:b"): (1, ["call"]),
        ("file:cmd/main.go", cluster["main.go cluster 1"], cluster["main.go cluster 2"]): (1, ["call"]),
        ("repository:1", "folder:cmd", "folder:lib"): (2, ["call", "use"]),
        ("repository:1", "file:top.go", "folder:cmd"): (1, ["call"]),
    }
    assert made.placements.count() == 14 and made.placements.groupBy("view_id", "x", "y").count().where("count > 1").isEmpty()
    assert [tuple(r) for r in materialise.stale(made, known, spark.createDataFrame([("symbol:shown",)], "owner_key string")).collect()] == [("symbol:old", 42)]


def test_an_empty_repository(spark):
    made = materialise.materialised("x", spark.createDataFrame([], "key string, name string, path string, line int"), spark.createDataFrame([], "source string, target string, kind string"), spark.createDataFrame([], "owner_key string, id long, name string, hash string, last_hash string"), spark.createDataFrame([], "owner_key string, id long"), 5)
    assert made.elements.count() == made.connectors.count() == made.placements.count() == 0


def test_proxies_by_viewport_count_each_connector_once(spark):
    # Root view 0 shows 1 and 2, which own views 10 and 20; 3 and 4 stand in 10, 5 in 20 and 6 in the root.
    views = spark.createDataFrame([(0, None, "root"), (10, 1, "a"), (20, 2, "b")], "id long, owner_element_id long, name string")
    placements = spark.createDataFrame([(0, 1), (0, 2), (0, 6), (10, 3), (10, 4), (20, 5)], "view_id long, element_id long")
    connectors = spark.createDataFrame([(1, 3, 5), (2, 4, 5), (3, 3, 6), (4, 5, 6), (5, 1, 2)], "id long, source_element_id long, target_element_id long")
    boxes = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 50.0, 0.0), (0, 6, 5000.0, 0.0)], "view_id long, element_id long, x double, y double").withColumns({"w": F.lit(10.0), "h": F.lit(10.0)})
    ports = spark.createDataFrame([(0, 0.0, 0.0, 100.0, 100.0)], "view_id long, min_x double, min_y double, max_x double, max_y double")
    closure = graph.lineage(graph.view_parents(views, placements))
    found, count = crossview.viewport_proxies(connectors, placements, closure, views, boxes, ports, 2)
    got = [tuple(r) for r in found.orderBy("rank").select("source", "target", "n", "source_depth", "target_depth").collect()]
    away = lambda x: math.hypot(x + 5 - 50, 5 - 50) / math.hypot(100, 100)
    near = lambda a, b: min(a, b) * 1000 - max(a, b) * 320 - 300
    scores = {(1, 2): near(away(0), away(50)) + 160, (1, 6): near(away(0), away(5000)), (2, 6): near(away(50), away(5000))}
    order = sorted(scores, key=scores.get)
    assert [g[:2] for g in got] == order[:2] and {g[:2]: g[2] for g in got} == {k: {(1, 2): 2, (1, 6): 1, (2, 6): 1}[k] for k in order[:2]}
    assert all(g[3:] == ((1, 1) if g[:2] == (1, 2) else (1, 0)) for g in got)
    assert [tuple(r) for r in count.collect()] == [(0, 2, {(1, 2): 2, (1, 6): 1, (2, 6): 1}[order[2]])]


def test_fact_scores_in_full(spark):
    schema = "id long, type string, subject_kind string, subject_key string, path string, confidence double, hint double"
    rows = [(1, "http.route", "symbol", "s1", "a/x.go", 0.4, None), (2, "dependency.import", "file", "s1", "a/x.go", 1.0, None), (3, "note", "symbol", "s1", "a/x.go", 1.0, 5.0), (4, "http.route", "file", None, "b/y/z.go", 0.1, -0.5), (5, enrich.VERSION_TYPE, "file", None, "a/x.go", 1.0, 9.0), (6, "http.route", "file", None, "c.go", 0.5, None), (7, "http.route", "file", None, "c.go", None, None)]
    f = spark.createDataFrame(rows, schema)
    keys, files = spark.createDataFrame([("s1",), ("s1",)], "key string"), spark.createDataFrame([("a/x.go",)], "path string")
    expansions = spark.createDataFrame([("b", 1), ("b/y", 3), ("a/x", 9)], "path string, tier int")
    high, dep = F.col("type") == "http.route", F.col("type").startswith("dependency.")
    got = {r["id"]: (r["score"], r["tier"], r["visible"]) for r in enrich.fact_scores(f, high, dep, keys, files, expansions).collect()}
    assert got == {1: (2.6, 0, True), 2: (1.2, 0, True), 3: (7.0, 0, False), 4: (99.65, 3, True), 6: (0.75, 0, False), 7: (0.0, 0, False)}
    assert all(r["visible"] == (r["id"] != 3) for r in enrich.fact_scores(f, high, dep, keys, files, expansions, None).collect())


def test_shrunk_texts_by_bytes_and_words(spark):
    texts = ["  short  ", "a b c d e f g h i j k l", "// only\n* comments", "x" * 60, "é" * 30, "code();\n// note\n\n  * star\nmore();" + "y" * 20]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(embedding.shrunk(F.col("t"), 10, "..")).collect()]
    assert got[0] == "short" and got[1] == texts[1] and got[2] == texts[2]
    assert got[3] == "x" * 25 + ".." + "x" * 13 and got[4] == "é" * 25 + ".." + "é" * 13
    assert got[5] == "code();\nmore();" + "y" * 20
