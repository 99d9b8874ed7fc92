"""Small cases of faults that only odd inputs or larger tables show."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from arborlens.functions import embedding, specs, text
from arborlens.operators import ancestry, architecture, graph, identity, relational, resolve, vectors, versions, workspace


def test_a_placement_that_goes_for_two_reasons_goes_once(spark):
    gone = spark.createDataFrame([(1,), (7,)], "id long")
    views = spark.createDataFrame([(50, 1), (60, 2)], "id long, owner_element_id long")
    placements = spark.createDataFrame([(50, 7), (50, 8), (60, 7), (60, 9)], "view_id long, element_id long")
    connectors = spark.createDataFrame([(3, 60, 9, 7), (4, 50, 8, 8), (5, 60, 9, 9)], "id long, view_id long, source_element_id long, target_element_id long")
    got = sorted((r["kind"], r["id"]) for r in workspace.cascade(gone, placements, connectors, views).collect())
    assert got == [("connector", "3"), ("connector", "4"), ("element", "1"), ("element", "7"), ("placement", "50:7"), ("placement", "50:8"), ("placement", "60:7"), ("view", "50")]


def test_polls_are_counted_without_a_row_for_each(spark):
    far = 400_000_000_000
    events = [(1, 0), (1, far), (2, 5), (2, 6), (2, 65), (2, 200), (3, 7), (None, 3), (4, None)]
    e = spark.createDataFrame(events, "repository_id long, second long")
    got = {r["repository_id"]: (r["due"], r["skipped"]) for r in versions.poll_ticks(e, 1, 60).collect()}
    # From the first event to the last, every second; sixty seconds from each event on are skipped, those of two events once.
    assert got == {1: (far + 1, 61), 2: (196, 121), 3: (1, 1), None: (1, 0)}
    got = {r["repository_id"]: (r["due"], r["skipped"]) for r in versions.poll_ticks(e, 60, 60).collect()}
    assert got == {1: (far // 60 + 1, 2 if far % 60 == 0 else 1), 2: (4, 2), 3: (1, 1), None: (1, 0)}


def test_a_name_of_many_views_and_elements_makes_no_pairs(spark):
    k = F.col("id")
    views = spark.range(300_000).select(k, F.lit(None).cast("long").alias("owner"), F.when(k == 7, "b").when(k == 8, "c").otherwise("a").alias("name"), F.lit("x").alias("label"))
    elements = spark.range(300_000).select(F.concat(F.lit("r"), k.cast("string")).alias("ref"), k, F.when(k == 5, "b").when(k == 6, "c").otherwise("a").alias("name"), F.when(k == 6, "y").otherwise("x").alias("label"))
    none = spark.createDataFrame([], "view_id long, element_id long")
    assert sorted(tuple(r) for r in workspace.view_owners(views, elements, none).collect()) == [(7, "r5", 3), (8, "r6", 4)]


def test_entities_that_are_alike_are_scored_once(spark):
    k = F.col("id")
    row = lambda n, key: spark.range(n).select(k.alias(key), F.lit("r").alias("repo"), F.lit("a b").alias("name"))
    components = row(50_000, "key").withColumn("tokens", F.array(F.lit("a"), F.lit("b")))
    targets = row(300_000, "id").withColumns({"repo": F.when(k == 9, "r").otherwise("q"), "tokens": F.when(k == 9, F.array(F.lit("a"), F.lit("b"))).when(k % 100 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("z")))})
    got = resolve.linked_entities(components, targets).groupBy("id", "score", "rank").agg(F.countDistinct("key").alias("n")).collect()
    assert sorted(tuple(r) for r in got) == sorted([(9, 0.92, 1, 50_000), *((100 * i, 0.72, i + 2, 50_000) for i in range(11))])


def test_lines_and_ranges_of_one_file_make_no_pairs(spark):
    k = F.col("id")
    symbols = spark.range(300_000).select(k.alias("key"), F.lit("f").alias("path"), F.when(k == 3, 0).otherwise(k % 50 + 1).alias("start_line"), F.when(k == 4, 2).otherwise(k % 50 + 100).alias("end_line"), F.when(k % 2 == 0, 5).cast("long").alias("old_start"), F.when(k % 2 == 0, 6).cast("long").alias("old_end"))
    lines = spark.range(1_000_000).select(F.lit("f").alias("path"), (k % 100).alias("line"), F.when(k % 200 < 100, "added").otherwise("removed").alias("kind"))
    got = {r["key"]: (r["added"], r["removed"]) for r in versions.attributed_lines(symbols, lines).where("key < 60").collect()}
    # Five thousand lines of either kind by number; a range that starts below 1 or ends before its start holds none.
    assert got == {i: (0 if i in (3, 4) else 5000 * (99 - i % 50), 10_000 if i % 2 == 0 else 0 if i == 3 else 5000 * (99 - i % 50)) for i in range(60)}


def test_components_and_targets_of_one_folder_make_no_pairs(spark):
    k = F.col("id")
    components = spark.range(40_000).select(k.alias("key"), F.lit("r").alias("repo"), F.lit("Api").alias("name"), F.array(F.lit("x")).alias("tokens"), F.array(F.lit("src/app/main.go")).alias("paths"))
    targets = spark.range(300_000).select(k, F.lit("r").alias("repo"), F.when(k == 8, "symbol").otherwise("file").alias("type"), F.when(k == 8, "api").otherwise("other").alias("name"), F.array(F.lit("y")).alias("tokens"), F.when(k % 100_000 == 9, "src/app/main.go").otherwise("src/app/other.go").alias("path"))
    got = architecture.bindings(components, targets).groupBy("id", "score", "rank").agg(F.countDistinct("key").alias("n")).collect()
    # One by name, symbol and folder; three by their path; the others are only in the same folder.
    assert sorted(tuple(r) for r in got) == [(8, 0.94, 1, 40_000), (9, 0.82, 2, 40_000), (100_009, 0.82, 3, 40_000), (200_009, 0.82, 4, 40_000)]


def test_nulls_keep_rows_apart(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, None, "a")], "id long, x string, y string")
    distinct, of = relational.alike(rows, "id", "c")
    assert distinct.count() == 2 and of.groupBy("c").count().count() == 2


def test_features_of_a_text_are_computed_once(spark):
    k = F.col("id")
    word = "func large ring return if while "
    rows = spark.range(100_000).select(k, F.when(k == 7, None).when(k % 3 == 0, F.lit(word * 60)).otherwise(F.lit("func b(c)")).alias("body"))
    one = rows.where("id in (0, 1)")
    due = {(r["id"], r["idx"]): r["value"] for r in embedding.sparse_vectors(embedding.features(one, "id", "body"), "id").collect()}
    got = embedding.text_vectors(rows, "id", "body")
    assert {(r["id"], r["idx"]): r["value"] for r in got.where("id < 2").collect()} == due
    n = [sum(1 for i, _ in due if i == j) for j in (0, 1)]
    assert got.count() == 33_334 * n[0] + 66_665 * n[1]


def test_levels_of_long_chains_take_few_rounds(spark):
    k = F.col("id")
    n = 20_000
    chain = spark.range(n).select(F.lit(1).cast("long").alias("view_id"), k.alias("source"), (k + 1).alias("target"))
    more = spark.createDataFrame([(1, 0, 9_000), (2, 1, 2), (2, 2, 3), (2, 3, 1), (2, 3, 4), (2, 8, 9)], "view_id long, source long, target long")
    got = {(r["view_id"], r["element_id"]): r["level"] for r in graph.levels(chain.unionByName(more)).collect()}
    # The second view: a cycle of 1, 2 and 3 with 4 behind it, and 8 before 9.
    assert got == {**{(1, i): i for i in range(n + 1)}, **{(2, i): 5 for i in (1, 2, 3, 4)}, (2, 8): 0, (2, 9): 1}


def test_similar_vectors_are_not_gathered_in_rows_that_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    x = np.random.default_rng(5).standard_normal((600, 8))
    # A third of the rows are one vector, some are zero: a list of several shelves, and ties.
    x[:200], x[590:] = x[0], 0
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    index = vectors.build(t)
    shelves = vectors.shelves_of(index)
    held = {}
    for c, on in shelves.items():
        assert len(on) == -(-index.sizes[c] // 100)
        for s in on:
            held[s] = held.get(s, 0) + index.sizes[c] / len(on)
    assert sorted(held) == list(range(len(held))) and max(held.values()) <= 100 and sum(held.values()) == 600
    found = vectors.similar(index, t.where("id % 20 = 0 OR id = 595"), 10)
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    due = set()
    for q in [*range(0, 600, 20), 595]:
        cos = (u @ u[q]).round(6)
        due |= {(q, i, r + 1) for r, i in enumerate([i for i in np.lexsort((np.arange(600), -cos)).tolist() if i != q][:10])}
    assert {(r["query"], r["id"], r["rank"]) for r in found.collect()} == due


def test_facts_of_specifications_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(specs, "CELL_TOKENS", 7)
    monkeypatch.setattr(specs, "TOKEN_BYTES", 40)
    table = [(f"s{k}", "t", [f"w{k % 5}", "all"], ["go"] if k % 3 == 0 else None, ["a"] if k % 4 == 0 else [], ["7"] if k % 5 == 0 else None, None) for k in range(30)]
    files = [(i % 40, "go" if i % 2 else None, f"w{i % 7} all", [["a/b", None], ["a.c"], ["ab"], None][i % 4]) for i in range(80)]
    f = spark.createDataFrame(files, "path long, language string, content string, signals array<string>")
    got = specs.facts(f, spark.createDataFrame(table, specs.SPECS))
    # The last exchange is what stands before the facts are made.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan.split("MapInArrow")[0]
    due = {}
    for path, language, content, signals in files:
        for name, _, tokens, languages, triggers, path_tokens, _ in table:
            told = not triggers or any(s is not None and (s == "a" or s.startswith(("a/", "a."))) for s in signals or [])
            if (not languages or language in languages) and told and (not path_tokens or "7" in str(path)):
                held = [tokens.index(w) for w in tokens if w in content]
                if held:
                    due[path, name] = min(due.get((path, name), 9), held[0])
    rows = [(r["path"], r["enricher"], r["name"]) for r in got.collect()]
    assert sorted(rows) == sorted((p, s, table[int(s[1:])][2][i]) for (p, s), i in due.items())


def test_specifications_that_are_alike_are_looked_at_once(spark, monkeypatch):
    monkeypatch.setattr(specs, "MEMBERS", 50)
    # Of three kinds only id, type and tags differ; one id stands twice, one is null, and two specifications have nothing to look for.
    table = [(f"s{k // 2 if k == 9 else k}", f"t{k % 3}", [["x", "y"], ["y"], ["y"]][k % 3], [None, [], ["go"]][k % 3], None, None, ["tag"] if k % 2 else None) for k in range(600)]
    table += [(None, "t", ["x", "y"], None, None, None, None), ("no", "t", [], None, None, None, None), ("none", "t", None, None, None, None, None)]
    s = spark.createDataFrame(table, specs.SPECS)
    rows = specs.kinds(s).collect()
    assert len({str((r["tokens"], r["languages"])) for r in rows}) == 3 and 12 <= len(rows) <= 15
    assert sum(len(r["members"]) for r in rows) == 601 and max(len(r["members"]) for r in rows) < 100
    files = [(f"p{i}", "go" if i % 2 else "c", "xy" if i % 3 else "y", None) for i in range(30)]
    got = specs.facts(spark.createDataFrame(files, "path string, language string, content string, signals array<string>"), s)
    # Facts are unfolded behind the Python step, which tells members and what holds their kind.
    assert "inline" in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    due = []
    for path, language, content, _ in files:
        for id_, type_, tokens, languages, *_, tags in table:
            held = [w for w in tokens or [] if w in content]
            if held and (not languages or language in languages):
                due.append((path, str(id_), type_, held[0], tuple(tags or ())))
    assert sorted((r["path"], str(r["enricher"]), r["type"], r["name"], tuple(r["tags"])) for r in got.collect()) == sorted(due)


def test_a_row_unfolds_to_a_bounded_number_of_facts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(specs, "FACTS", 20)
    member = lambda n: [{"enricher": f"e{i}", "type": "t", "tags": []} for i in range(n)]
    cell = specs._Cell(pa.table({"tokens": [["a", "b"], ["c"], ["d"]], "languages": [None] * 3, "triggers": [None] * 3, "path_tokens": [None] * 3, "members": [member(6), member(30), member(1)]}))
    found = [(f"p{i}", np.array([0, 2] if i % 2 else [1, 2, 3])) for i in range(50)]
    rows = specs._facts_of(cell, found, pa.string()).to_pylist()
    assert all(len(r["members"]) * len(r["held"]) <= 20 or len(r["held"]) == 1 for r in rows)
    facts = sorted((h["path"], h["name"], len(r["members"])) for r in rows for h in r["held"])
    assert facts == sorted((path, "abcd"[k], (6, 6, 30, 1)[k]) for path, places in found for k in places)


def test_open_symbols_and_identities_are_found_once(spark):
    row = "string, file string, kind string, line long, hash string, qualified_name string"
    symbols = [("a", "f", "k", 1, "h", "p.getAll"), ("b", "f", "k", 2, None, "p.b"), ("c", "g", None, 3, "h", None), ("d", "g", "k", 9, "m", "q.read_it")]
    # Two identities have the key of a: the smaller is taken, the other stays open; one has none, two stand in a file that is gone.
    known = [("i2", "a", "f", "k", 1, "h", "p.getAll"), ("i1", "a", "f", "k", 1, "h", "p.getAll"), ("i3", "x", "f", "k", 2, None, "p.b"), ("i4", None, "gone", "k", 8, "m", "q.it_read"), ("i5", "y", None, "k", 99, "m", "z.other")]
    s, i = spark.createDataFrame(symbols, f"key {row}"), spark.createDataFrame(known, f"identity string, current_key {row}")
    found = identity.candidates(s, i)
    assert sorted(tuple(r) for r in found.collect()) == [("b", "i3", 1.0), ("d", "i4", 1.0), ("d", "i5", 0.8)]
    # The plan reads what was stored: no aggregate or outer join of the inputs is repeated in it.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "Window" not in plan


def test_tokens_of_names(spark):
    names = [("getAll_X.y-z  a",), ("",), (None,), ("_a_A",), ("..",)]
    got = spark.createDataFrame(names, "n string").select(text.identifier_tokens(F.col("n")).alias("t")).collect()
    assert [r["t"] for r in got] == [["a", "all", "get", "x", "y", "z"], [], None, ["a"], []]


def _rounds(monkeypatch, module, name):
    made, true = [], getattr(graph, name)
    monkeypatch.setattr(module, name, lambda df: made.append(1) or true(df))
    return made


def test_visibility_of_long_chains_takes_few_rounds(spark, monkeypatch):
    k, n = F.col("id"), 300
    seeds = spark.range(n).select(k, F.when(k == 0, 1.0).when(k == 200, -0.5).otherwise(0.5).alias("base"), (k == 250).alias("forced"))
    # 400 and 401 are a cycle; 500 wants both ends of two references, of which one is behind it; 600 has a source that is no item.
    more = spark.createDataFrame([(400, 0.0, False), (401, 0.0, False), (500, -1.0, False), (501, 0.2, False), (600, 0.0, False)], "id long, base double, forced boolean")
    chain = spark.range(1, n).select((k - 1).alias("source"), k.alias("target"))
    refs = chain.unionByName(spark.createDataFrame([(400, 401), (401, 400), (150, 500), (260, 500), (500, 501), (900, 600)], "source long, target long"))
    made = _rounds(monkeypatch, graph, "checkpointed")
    got = {r["id"]: (r["visible"], r["score"]) for r in graph.visibility(seeds.unionByName(more), refs).collect()}
    due = {i: (True, 1.5) for i in range(n)}
    due |= {0: (True, 1.0), 200: (False, 0.5), **{i: (False, 0.5) for i in range(201, 250)}, 250: (True, 0.5)}
    due |= {400: (False, 0.0), 401: (False, 0.0), 500: (True, 1.0), 501: (True, 1.2), 600: (False, 0.0)}
    assert got == due and len(made) < 25


def test_depths_of_chains_and_cycles_make_no_tables_of_ancestors(spark, monkeypatch):
    k = F.col("id")
    parents = spark.range(1000).select(k, F.when(k > 0, k - 1).alias("parent"))
    more = spark.createDataFrame([(2003, 2001), (2001, 2002), (2002, 2003), (2004, 2002), (3000, 9999)], "id long, parent long")
    monkeypatch.setattr(ancestry, "_doubled", None)
    got = {r["id"]: (r["root"], r["depth"]) for r in ancestry.rooted(parents)[1].collect()}
    assert got == {i: (0, i) for i in range(1000)}
    monkeypatch.undo()
    got = {r["id"]: (r["root"], r["depth"]) for r in ancestry.rooted(parents.unionByName(more))[1].where("id >= 2000").collect()}
    assert got == {2001: (2001, 0), 2003: (2001, 1), 2002: (2001, 2), 2004: (2001, 3), 3000: (3000, 0)}


def test_intervals_and_points_make_no_pairs(spark):
    # Nested, equal, crossing, open, turned and blank ones, in files of one and of many blocks.
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([f"n{r.randrange(9)}", f"m{i}"]), r.choice([None, *[r.randrange(60)] * 9]), r.choice([None, *[r.randrange(70)] * 7])) for i in range(120)]
    asked = [(f, n) for f in ("a", "b", "c", None) for n in [None, *range(-3, 75)]] * 2
    i = spark.createDataFrame(rows, "file string, name string, start long, end long")
    due = {}
    for f, n in asked:
        held = [(-s, m) for g, m, s, e in rows if None not in (f, n, s) and g == f and s <= n and (e is None or n <= e)]
        if held:
            due[f, n] = (min(held)[1], -min(held)[0])
    for block in (8, 4096):
        found = resolve.enclosing(spark.createDataFrame(asked, "file string, line int"), i, block)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = [tuple(x) for x in found.select("file", "line", "name", "start").collect()]
        assert len(got) == len(due) and {(f, n): (m, s) for f, n, m, s in got} == due


def test_lines_of_one_group_are_hashed_in_ranges(spark):
    k = F.col("id")
    rows = spark.range(5_000).select(F.when(k % 10 == 0, None).when(k % 10 == 1, 2).otherwise(1).alias("g"), (k * 7 % 5_000).alias("o"), F.concat(F.lit("l"), k.cast("string")).alias("l"))
    found = versions.chunked_hash(rows, "g", ["o", F.col("l")], F.col("l"), 300)
    # No window goes over the groups; the one left is over the counts of ranges.
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
    due = {}
    for g, test in ((None, lambda i: i % 10 == 0), (2, lambda i: i % 10 == 1), (1, lambda i: i % 10 > 1)):
        lines = [f"l{i}" for i in sorted(filter(test, range(5_000)), key=lambda i: i * 7 % 5_000)]
        chunks = [hashlib.sha256("\n".join(lines[a : a + 300]).encode()).hexdigest() for a in range(0, len(lines), 300)]
        due[g] = hashlib.sha256("\n".join(chunks).encode()).hexdigest()
    assert {r["g"]: r["hash"] for r in found.collect()} == due


def test_lint_deals_views_and_ends_once_each(spark):
    from arborlens.operators import lint

    k = F.col("id")
    elements = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    views = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, None)], "id long, owner_element_id long")
    placements = spark.createDataFrame([(10, 1)] * 3 + [(None, 2)], "view_id long, element_id long")
    many = spark.range(200_000).select(k, F.lit(20).cast("long").alias("view_id"), F.lit(1).cast("long").alias("source_element_id"), F.when(k == 7, 9).when(k == 8, None).otherwise(2).cast("long").alias("target_element_id"))
    odd = spark.createDataFrame([(300_000, None, 8, 9), (300_001, 20, None, None)], "id long, view_id long, source_element_id long, target_element_id long")
    connectors = many.union(odd)
    empty, dangling = (lint.RULES[x][1](elements, views, placements, connectors) for x in ("empty_view", "dangling_connector"))
    assert [r["location"] for r in empty.collect()] == [3]
    assert sorted(r["location"] for r in dangling.collect()) == [7, 8, 300_000, 300_001]
    # What a view or an element is in comes to it as one row, not as one for each connector, which one task would sort.
    for rows, name in ((empty, "view_id"), (dangling, "ends")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan[plan.index("LeftAnti") :], name
