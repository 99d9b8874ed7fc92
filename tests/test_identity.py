"""Identities across renames and moves: fixtures, and the serial walk over the SQL's candidates."""

import duckdb
import pytest
from pyspark.sql import functions as F

from arborlens.operators import identity
from arborlens.plans import registry

D = "/root/testdata/sf0.001"
SYMBOLS = "key string, file string, kind string, line long, hash string, qualified_name string"
IDENTITIES = "identity string, current_key string, file string, kind string, line long, hash string, qualified_name string"


def walk(found, places):
    """Keys by place, each taking its best identity that is free."""
    by_key, used, out = {}, set(), {}
    for key, who, score in found:
        by_key.setdefault(key, []).append((-score, who))
    for key in sorted(by_key, key=places.get):
        for score, who in sorted(by_key[key]):
            if who not in used:
                used.add(who)
                out[key] = (who, -score)
                break
    return out


def test_matches_equal_a_serial_walk(spark):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "customer", "orders", "lineitem", "documents", "labels", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    found = con.execute(registry.ORACLE_SQL["identity_candidates"]).fetchall()
    symbols = con.execute("SELECT l_orderkey || ':' || l_linenumber AS key, min(l_suppkey), l_orderkey % 500, l_linenumber = 3 FROM lineitem GROUP BY 1, 3, 4").fetchall()
    due = walk(found, {k: (f, n, k) for k, f, n, _ in symbols})
    got = registry.identity_matches(spark, D).collect()
    assert len(got) == len({r["key"] for r in got}) == len({r["identity"] for r in got}) == len(symbols)
    assert {r["key"]: (r["identity"], r["score"]) for r in got if r["state"] == "renamed"} == due
    assert {r["key"] for r in got if r["state"] == "kept"} == {k for k, _, _, exact in symbols if exact}
    assert all(r["identity"] == ("i" + r["key"] if r["state"] == "kept" else r["key"]) for r in got if r["state"] != "renamed")
    # Keys are turned away, so that the walk is more than a best candidate for each.
    best = {}
    for key, who, score in found:
        best[key] = min(best.get(key, (0, "")), (-score, who))
    assert sum(best[k][1] != who for k, (who, _) in due.items()) > 20


def test_a_chain_of_refusals(spark):
    # Each key wants the identity that the one before it takes.
    n = 12
    found = [(f"k{i:02d}", f"i{j:02d}", 0.9) for i in range(n) for j in range(n)]
    t = spark.createDataFrame(found, "key string, identity string, score double")
    order = t.select("key", t.key.alias("place")).distinct()
    assert {r["key"]: r["identity"] for r in identity.one_to_one(t, order).collect()} == {f"k{i:02d}": f"i{i:02d}" for i in range(n)}
    assert identity.one_to_one(t.where("false"), order).collect() == []


def test_rounds_leave_no_candidates_on_disk(spark):
    from pathlib import Path

    from arborlens.operators.graph import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    t = spark.createDataFrame([(f"k{i}", f"i{j}", 0.9) for i in range(6) for j in range(6)], "key string, identity string, score double")
    got = identity.one_to_one(t, t.select("key", t.key.alias("place")).distinct())
    assert {r["key"]: r["identity"] for r in got.collect()} == {f"k{i}": f"i{i}" for i in range(6)}
    made = set(folder.iterdir()) - before
    assert made and all("place" not in spark.read.parquet(str(m)).columns for m in made)


def test_a_round_deals_candidates_by_key_and_by_identity_once_each(spark, monkeypatch):
    plans = []

    def kept(df, stored=identity.stored):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    monkeypatch.setattr(identity, "stored", kept)
    n = 6
    # Every symbol has the hash of every identity, whose file is gone, so that keys turn each other away; two keys are known, one of them by two identities.
    symbols = [(f"k{i}", "f", "func", i, "h", f"p.k{i}") for i in range(n)] + [("same", "f", "func", 50, "s", "p.same"), ("twice", "f", "func", 60, "t", "p.twice")]
    known = [(f"i{j}", "old", "gone", "func", 100, "h", "q.x") for j in range(n - 1)] + [("j1", "same", "f", "func", 50, "s", "p.same"), ("j3", "twice", "f", "func", 60, "t", "p.twice"), ("j2", "twice", "f", "func", 90, "t", "p.twice"), ("j4", None, "f", "func", 99, "z", "p.z")]
    got = identity.matched(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(known, IDENTITIES))
    assert sorted((r["key"], r["identity"], r["state"]) for r in got.collect()) == [*((f"k{i}", f"i{i}", "renamed") for i in range(n - 1)), ("k5", "k5", "new"), ("same", "j1", "kept"), ("twice", "j2", "kept")]
    # Both tables meet once by key; of the rounds the first one reads the joins that find candidates, and no other joins anything.
    assert "Join" not in plans[0] and "Join" not in plans[1]
    rounds = [p for p in plans[2:] if "Window" in p]
    assert len(rounds) > 2 and not any("Join" in p for p in rounds[1:])
    assert all(p.count("RepartitionByExpression") == 1 for p in rounds[1:])


def test_rename_in_place_and_move_keep_the_identity(spark):
    symbols = [("main.Main", "main.go", "func", 3, "m2", "main.Main"), ("main.LoadUser", "main.go", "func", 7, "l", "main.LoadUser"), ("users.LoadAccount", "pkg/users.go", "func", 7, "body", "users.LoadAccount"), ("x.Far", "main.go", "func", 40, "f", "x.Far"), ("x.Near", "main.go", "func", 20, "n", "x.Near")]
    known = [("i1", "main.Main", "main.go", "func", 3, "m1", "main.Main"), ("i2", "main.FetchUser", "main.go", "func", 7, "x", "main.FetchUser"), ("i3", "users.FetchUser", "gone.go", "func", 5, "body", "users.FetchUser"), ("i4", "y.Far", "main.go", "func", 44, "f", "y.Far"), ("i5", "x.Was", "main.go", "func", 22, "other", "x.Was"), ("i6", "g.E", "gone.go", "func", 7, "", "g.E")]
    got = {r["key"]: (r["identity"], r["score"], r["state"]) for r in identity.matched(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(known, IDENTITIES)).collect()}
    assert got == {
        "main.Main": ("i1", 1.0, "kept"),
        "main.LoadUser": ("i2", 0.8, "renamed"),  # .35 place, .35 line, .1 parent
        "users.LoadAccount": ("i3", 0.95, "renamed"),  # .8, .1 parent, .05 line; {load, account} and {fetch, user} are not alike
        "x.Far": ("x.Far", None, "new"),  # four lines apart
        "x.Near": ("x.Near", None, "new"),  # .35, .2 near, .1 parent: below .7
    }


@pytest.mark.parametrize("text,parent,tokens", [("a.b.Load_user", "a.b", ["load", "user"]), ("Load", "", ["load"]), (".x", "", ["x"]), ("pkg/users.FetchUser", "pkg/users", ["fetch", "user"])])
def test_name_parts(spark, text, parent, tokens):
    row = spark.createDataFrame([(text,)], "q string").select(identity.qualifier_parent(F.col("q")).alias("p"), identity.own_name_tokens(F.col("q")).alias("t")).first()
    assert (row["p"], row["t"]) == (parent, tokens)
