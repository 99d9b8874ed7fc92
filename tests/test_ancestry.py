"""Binary lifting on chains, cycles and random forests, against walks."""

import random

from arborlens.operators import ancestry

PARENTS = "id long, parent long"


def test_a_chain_of_five_thousand_takes_log_rounds(spark):
    n = 5000
    lift = ancestry.lifting(spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], PARENTS))
    assert lift.powers == 13 and lift.up.count() == sum(n - (1 << k) for k in range(13))
    assert {r["id"]: (r["depth"], r["root"]) for r in lift.nodes.collect()} == {i: (i, 0) for i in range(n)}
    pairs = [(4999, 0), (4999, 4998), (17, 17), (1234, 4321), (0, 0)]
    got = {(r["a"], r["b"]): (r["lca"], r["distance"]) for r in ancestry.common_ancestors(lift, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(a, b): (min(a, b), abs(a - b)) for a, b in pairs}
    wanted = spark.createDataFrame([(4999, 0), (4999, 4999), (4999, 5000), (100, 37), (100, 60000)], "id long, steps long")
    assert {(r["id"], r["steps"]): r["ancestor"] for r in ancestry.ancestor_at(lift, wanted).collect()} == {(4999, 0): 4999, (4999, 4999): 0, (100, 37): 63}


def test_a_random_forest_against_walks(spark):
    rng = random.Random(7)
    parent = {i: None if i % 40 == 0 else rng.randrange(i - i % 40, i) for i in range(400)}
    above = lambda i: [i] if parent[i] is None else [i, *above(parent[i])]
    lift = ancestry.lifting(spark.createDataFrame(list(parent.items()), PARENTS))
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(600)] + [(5, 30)] * 3
    due = {}
    for a, b in pairs:
        x, y = above(a), above(b)
        common = next((i for i in x if i in y), None)
        if common is not None:
            due[a, b] = (common, x.index(common) + y.index(common))
    got = ancestry.common_ancestors(lift, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(due) and {(r["a"], r["b"]): (r["lca"], r["distance"]) for r in got} == due
    assert {r["id"]: r["depth"] for r in lift.nodes.collect()} == {i: len(above(i)) - 1 for i in parent}


def test_cycles_are_cut_above_their_smallest_member(spark):
    # 3-4-5 and 8 with itself are cycles; 6 and 7 hang below one; 9's parent is no node; 1 has two parents.
    rows = [(1, None), (2, 1), (3, 4), (4, 5), (5, 3), (6, 4), (7, 6), (8, 8), (9, 99), (2, 5)]
    lift = ancestry.lifting(spark.createDataFrame(rows, PARENTS))
    assert {r["id"]: (r["depth"], r["root"]) for r in lift.nodes.collect()} == {1: (0, 1), 2: (1, 1), 3: (0, 3), 5: (1, 3), 4: (2, 3), 6: (3, 3), 7: (4, 3), 8: (0, 8), 9: (0, 9)}


def test_no_parents_at_all(spark):
    lift = ancestry.lifting(spark.createDataFrame([(1, None), (2, None)], PARENTS))
    assert lift.powers == 0 and lift.up.count() == 0 and lift.nodes.count() == 2
    got = ancestry.common_ancestors(lift, spark.createDataFrame([(1, 1), (1, 2)], "a long, b long")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 0)]
    assert ancestry.lifting(spark.createDataFrame([], PARENTS)).nodes.count() == 0
