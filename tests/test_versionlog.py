"""Version log, tombstones, promoted summaries, definitions: fixtures."""

from arborlens.operators import resolve, versionlog


def test_versions_store_what_changed_and_keep_what_is_gone(spark):
    runs = spark.createDataFrame([(1, 10, "h1", "r1", False), (1, 20, "h1", "r1", False), (1, 30, "h2", "r1", False), (1, 40, "h2", "r2", False), (1, 50, "h3", "r2", True), (1, 60, "h4", "r4", False)], "repository_id long, place long, head string, hash string, clean boolean")
    items = {10: "a1 b1 c1", 20: "a9", 30: "a1 b2", 40: "b2 d1", 50: "b2 d1 c2", 60: "b2"}
    snapshots = spark.createDataFrame([(1, p, x[0], x[1]) for p, text in items.items() for x in text.split()], "repository_id long, place long, key string, hash string")
    versions = versionlog.versions_of(runs)
    assert [(r["place"], r["version"]) for r in versions.orderBy("place").collect()] == [(10, 1), (30, 2), (40, 3), (50, 4), (60, 5)]
    diffs = versionlog.stored_diffs(versions, snapshots)
    got = {(r["version"], r["key"]): r["change_type"] for r in diffs.collect()}
    assert got == {(1, "a"): "initialized", (1, "b"): "initialized", (1, "c"): "initialized", (2, "b"): "updated", (2, "c"): "deleted", (3, "a"): "deleted", (3, "d"): "added", (4, "c"): "added", (5, "c"): "deleted", (5, "d"): "deleted"}
    # The tree is clean at version 4, which ends what went before; what goes at 5 stays.
    assert {(r["key"], r["since"], r["until"]) for r in versionlog.tombstones(versions, diffs).collect()} == {("c", 2, 4), ("a", 3, 4), ("c", 5, None), ("d", 5, None)}
    assert versionlog.stored_diffs(versions.where("false"), snapshots).collect() == []


def test_a_summary_of_the_same_file_and_type_is_the_same_one(spark):
    key = lambda f, t, n: f"fact-summary:{f}:{t}:{n:016x}"
    before = [(key("a.go", "http", 1), "x"), (key("a.go", "grpc", 1), "x"), (key("b.go", "http", 1), "x"), (key("c.go", "http", 1), "x"), ("odd", "x")]
    after = [(key("a.go", "http", 2), "y"), (key("a.go", "grpc", 1), "y"), (key("b.go", "http", 2), "x"), (key("d.go", "http", 1), "z")]
    t = lambda rows: spark.createDataFrame(rows, "key string, hash string")
    got = {(r["key"], r["before_key"], r["change_type"]) for r in versionlog.promoted_summaries(t(before), t(after)).collect()}
    assert got == {(key("a.go", "http", 2), key("a.go", "http", 1), "updated"), (key("a.go", "grpc", 1), key("a.go", "grpc", 1), "updated"), (key("b.go", "http", 2), None, "added"), (key("d.go", "http", 1), None, "added"),
                   (key("b.go", "http", 1), key("b.go", "http", 1), "deleted"), (key("c.go", "http", 1), key("c.go", "http", 1), "deleted"), ("odd", "odd", "deleted")}


def test_changed_raw_tells_deleted_files_only(spark):
    t = lambda rows: spark.createDataFrame(rows, "type string, key string, hash string")
    got = versionlog.changed_raw(t([("file", "a", "1"), ("file", "b", "1"), ("symbol", "s", "1"), ("symbol", "t", "1")]), t([("file", "a", "2"), ("symbol", "t", "1"), ("symbol", "u", "1")])).collect()
    assert {tuple(r) for r in got} == {("file", "a", "updated"), ("file", "b", "deleted"), ("symbol", "u", "added")}


def test_definitions_come_before_names(spark):
    symbols = spark.createDataFrame([(1, "a.py", "main", 1, 50), (2, "a.py", "inner", 10, 20), (3, "b.py", "run", 1, 30), (4, "c.py", "run", 1, 9), (5, "b.py", "only", 40, 45)], "id long, file string, name string, start_line long, end_line long")
    calls = spark.createDataFrame([(1, "a.py", "run", 12, False, "call"), (2, "a.py", "run", 30, False, ""), (3, "a.py", "only", 30, False, None), (4, "a.py", "only", 31, True, None), (5, "a.py", "run", 13, False, "type"), (6, "a.py", "inner", 15, False, "call")], "id long, file string, name string, line long, anywhere boolean, kind string")
    definitions = spark.createDataFrame([(1, 0, "zz.py", 3), (1, 1, "c.py", 5), (1, 2, "b.py", 5), (5, 0, "b.py", 5), (6, 0, "a.py", 30), (3, 0, "b.py", 99)], "id long, place int, file string, line long")
    got = {(r["id"], r["source_id"], r["target_id"]) for r in resolve.resolved_calls(calls, symbols, definitions).collect()}
    assert got == {(1, 2, 4), (4, 1, 5), (6, 2, 1)}
