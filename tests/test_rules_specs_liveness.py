"""Rule tables, token specifications and stateful streams: fixtures, brute force, several micro-batches."""

import datetime as dt
import os
import random
import re

from pyspark.sql import functions as F

from arborlens.functions import specs
from arborlens.functions.text import glob_regex
from arborlens.operators import resolve, rules
from arborlens.streaming import liveness

RULES = "number long, pattern string, owner string"


def holds(pattern, path):
    p, anchored = pattern.strip("/"), "/" in pattern.rstrip("/")
    return re.fullmatch(f"{'' if anchored else '(?:.*/)?'}{glob_regex(p)[1:-1]}(?:/.*)?", path) is not None


def test_ten_thousand_rules_against_each_path(spark):
    rng = random.Random(3)
    words = ["src", "lib", "api", "core", "user", "order", "cart", "util", "a", "b1", "x.go", "y_test.go", "main.py"]
    bits = [*words, "*", "**", "*.go", "?1", "us*", "*er", "**r", "c?re", "cor**"]
    paths = sorted({"/".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(250)})
    table = [(k, rng.choice(["", "/"]) + "/".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/"]), f"o{k}") for k in range(10_000)] + [(10_001, "/", "root"), (10_002, None, "none"), (10_003, "only/one", "first"), (10_004, "only/one", "last")]
    due = {}
    last = {p: (k, o) for k, p, o in table if p and p.strip("/")}
    for path in [*paths, "only/one/x"]:
        hit = [v for p, v in last.items() if holds(p, path)]
        due[path] = max(hit)[1] if hit else None
    t = spark.createDataFrame([(p,) for p in [*paths, "only/one/x"]], "path string")
    got = rules.last_match(t, spark.createDataFrame(table, RULES))
    assert {r["path"]: r["owner"] for r in got.collect()} == due and due["only/one/x"] == "last"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ignore_tables_equal_ignore_lists(spark):
    patterns = ["*.log", "!keep.log", "build", "/docs/*.md", "!docs/a.md", "**/gen"]
    paths = ["a.log", "x/keep.log", "build/x", "src/build/y", "docs/a.md", "docs/b.md", "x/docs/b.md", "a/gen/b", "gen", "node_modules/keep.log", "x"]
    t = spark.createDataFrame([(p,) for p in paths], "path string")
    table = spark.createDataFrame([(-1, "node_modules", True), *[(k, p, False) for k, p in enumerate(patterns)]], "number long, pattern string, implicit boolean")
    want = {r["path"]: r["ignored"] for r in resolve.ignored(t, ["node_modules"], patterns).collect()}
    assert {r["path"]: r["ignored"] for r in rules.ignored(t, table).collect()} == want
    assert want["x/keep.log"] is False and want["node_modules/keep.log"] is True


def test_first_listed_token_wins_and_conditions_hold(spark):
    files = [("svc/main.go", "go", "x := redis.New() // kafka.\nmongo.Dial()", ["github.com/x/redis"]), ("web/a.ts", "typescript", "import kafka.; /* redis. */", []), ("none", None, None, None)]
    table = [
        ("store", "datastore", ["mongo.", "redis."], None, None, None, ["t"]),
        ("queue", "queue", ["kafka."], [], [], [], None),
        ("go-only", "x", ["mongo."], ["go"], ["github.com/x"], ["svc/"], None),
        ("other-trigger", "x", ["mongo."], ["go"], ["github.com/xy"], None, None),
        ("other-path", "x", ["mongo."], None, None, ["cmd/"], None),
        ("empty", "x", [""], None, None, None, None),
    ]
    got = specs.facts(spark.createDataFrame(files, "path string, language string, content string, signals array<string>"), spark.createDataFrame(table, specs.SPECS)).collect()
    assert {(r["path"], r["enricher"], r["name"], tuple(r["tags"])) for r in got} == {("svc/main.go", "store", "mongo.", ("t",)), ("web/a.ts", "queue", "kafka.", ()), ("svc/main.go", "go-only", "mongo.", ())}
    assert {(r["confidence"], r["hint"]) for r in got} == {(0.78, 0.6)}


def test_many_specifications_in_several_passes(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(800)]
    table = [(f"s{k}", "t", words[k * 2 : k * 2 + 2], None, None, None, None) for k in range(400)]
    files = [(f"f{i}", "go", "".join(rng.choice("abcd ") for _ in range(120)), None) for i in range(40)]
    due = {(p, s, next(w for w in ws if w in text)) for p, _, text, _ in files for s, _, ws, *_ in table if any(w in text for w in ws)}
    f = spark.createDataFrame(files, "path string, language string, content string, signals array<string>")
    for size in (8 << 20, 2000):
        monkeypatch.setattr(specs, "TOKEN_BYTES", size)
        got = specs.facts(f, spark.createDataFrame(table, specs.SPECS))
        assert {(r["path"], r["enricher"], r["name"]) for r in got.collect()} == due
    assert specs.facts(f, spark.createDataFrame([], specs.SPECS)).collect() == []


# -- streams -------------------------------------------------------------------


def batches(spark, tmp_path, schema, *parts):
    """Files that a stream takes one a micro-batch, in order."""
    folder = tmp_path / "in"
    for k, rows in enumerate(parts):
        out = tmp_path / f"w{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{out}")
        folder.mkdir(exist_ok=True)
        source = next(out.glob("*.parquet"))
        target = folder / f"{k:03d}.parquet"
        target.write_bytes(source.read_bytes())
        os.utime(target, (1_700_000_000 + k * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def test_locks_over_micro_batches(spark, tmp_path):
    zero = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    at = lambda s: zero + dt.timedelta(seconds=s)
    schema = "event_id long, ts timestamp, repository_id long, token string, kind string"
    parts = [
        [(1, at(0), 1, "a", "acquire"), (2, at(1), 1, "b", "acquire"), (3, at(0), 2, "c", "acquire"), (4, at(5), 1, "b", "stop")],
        [(5, at(20), 1, "a", "beat"), (6, at(21), 1, "a", "pause"), (7, at(22), 1, "a", "pause")],
        # Repository 2 gets nothing more: its timer ends it when the watermark has passed, in a later batch.
        [(8, at(45), 1, "a", "beat"), (9, at(46), 1, "a", "resume")],
        [(10, at(60), 1, "a", "stop"), (11, at(61), 1, "a", "release"), (12, at(62), 1, "b", "acquire"), (13, at(70), 2, "d", "acquire")],
        [(14, at(140), 1, "b", "beat"), (15, at(141), 3, "e", "acquire")],
    ]
    stream = liveness.lock_stream(batches(spark, tmp_path, schema, *parts))
    rows = liveness.drained(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()
    start = int(zero.timestamp()) * 1_000_000
    got = sorted(((r["at_us"] - start) // 1_000_000, r["repository_id"], r["token"], r["status"]) for r in rows)
    assert got == sorted([
        (0, 1, "a", "active"), (0, 2, "c", "active"), (1, 1, "b", "refused"), (21, 1, "a", "paused"), (30, 2, "c", "stale"), (46, 1, "a", "active"),
        (60, 1, "a", "stopping"), (61, 1, "a", "released"), (62, 1, "b", "active"), (70, 2, "d", "active"), (92, 1, "b", "stale"), (100, 2, "d", "stale"), (141, 3, "e", "active"),
    ])


def test_lock_step_by_step():
    s, told = liveness.lock_step(None, "a", "acquire", 0, 30)
    assert (s, told) == (("a", "active", 0), "active")
    assert liveness.lock_step(s, "b", "acquire", 30, 30) == (s, "refused")
    assert liveness.lock_step(s, "b", "acquire", 31, 30) == (("b", "active", 31), "active")
    assert liveness.lock_step(s, "a", "beat", 31, 30) == (s, None)
    assert liveness.lock_step(s, "a", "stop", 10, 30) == (("a", "stopping", 0), "stopping")
    assert liveness.lock_step(("a", "released", 0), "b", "acquire", 1, 30) == (("b", "active", 1), "active")


def test_metadata_only_changes_are_silent_across_batches(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    schema = "event_id long, ts timestamp, repository_id long, path string, content string, tree string, metadata string"
    parts = [[(1, day, 1, "p", "c1", "t1", "m1"), (2, day, 1, "q", "c1", "t1", "m1"), (3, day, 1, "p", "c1", "t1", "m2")], [(4, day, 1, "p", "c1", "t1", "m3"), (5, day, 1, "q", "c1", "t2", "m1")], [(6, day, 1, "p", "c2", "t1", "m3"), (7, day, 1, "p", "c1", "t1", "m3")]]
    stream = liveness.content_changes(batches(spark, tmp_path, schema, *parts))
    rows = liveness.drained(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert sorted((r["event_id"], r["path"], r["change"]) for r in rows.collect()) == [(1, "p", 1), (2, "q", 1), (5, "q", 2), (6, "p", 2), (7, "p", 3)]
    assert rows.where(F.col("change") > 3).count() == 0


def test_paths_of_one_share_keep_their_own_state_over_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, repository_id long, path string, content string, tree string, metadata string"
    day = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    # 3,000 paths, more than shares, and a repository and a path that are null; the second batch changes the odd ones, the third none.
    at = lambda k, n, c: (3 * k + n, day + dt.timedelta(seconds=n), None if k == 7 else (1 << 60) + k % 10, None if k == 8 else f"p{k}", c, None, "m")
    parts = [[at(k, 0, "a") for k in range(3000)], [at(k, 1, "b" if k % 2 else "a") for k in range(3000)], [at(k, 2, "b" if k % 2 else "a") for k in range(3000)]]
    stream = liveness.content_changes(batches(spark, tmp_path, schema, *parts))
    rows = liveness.drained(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()
    want = [(3 * k, None if k == 7 else (1 << 60) + k % 10, None if k == 8 else f"p{k}", 1) for k in range(3000)]
    want += [(3 * k + 1, r, p, 2) for k, (_, r, p, _) in enumerate(want) if k % 2]
    assert sorted(map(tuple, rows), key=lambda r: r[0]) == sorted(want)
    # A path has no group of its own, whose table would cost more than its rows.
    assert liveness.SHARES < 3000
