"""Line diffs against a classic table of common subsequences; the vector index against exact search."""

import random

import numpy as np

from arborlens.operators import linediff, vectors


def classic(a, b):
    """Length of the longest common subsequence, by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def applied(old, new, hunks):
    """old with the hunks replaced by new's lines."""
    out, at = [], 0
    for o, n, p, m in sorted(hunks):
        start = o - 1 if n else o
        out += old[at:start] + new[p - 1 : p - 1 + m] * (m > 0)
        at = start + n
    return out + old[at:]


def files(seed, n, lines):
    rng = random.Random(seed)
    out = {}
    for f in range(n):
        old = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, lines))]
        new = list(old)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(new))
            kind = rng.random()
            if kind < 0.4:
                new.insert(at, rng.choice("abcxyz"))
            elif kind < 0.7 and new:
                new.pop(min(at, len(new) - 1))
            elif new:
                new.insert(at, new.pop(rng.randrange(len(new))))
        out[f"f{f}"] = (old, new)
    return out


def table(spark, made, side):
    rows = [(f, i + 1, x) for f, pair in made.items() for i, x in enumerate(pair[side])]
    return spark.createDataFrame(rows, "file string, number long, line string")


def by_file(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["file"], []).append(tuple(r)[1:])
    return out


def test_hunks_equal_a_classic_diff(spark):
    made = files(1, 60, 40) | {"same": (["x", "y"], ["x", "y"]), "new": ([], ["p", "q"]), "gone": (["p", "q"], []), "swapped": (["a", "b", "c"], ["a", "c", "b"])}
    got = by_file(linediff.hunks(table(spark, made, 0), table(spark, made, 1)))
    assert "same" not in got and got["new"] == [(0, 0, 1, 2)] and got["gone"] == [(1, 2, 0, 0)] and len(got["swapped"]) == 2
    for f, (old, new) in made.items():
        hunks, kept = got.get(f, []), classic(old, new)
        assert applied(old, new, hunks) == new
        assert sum(h[1] for h in hunks) == len(old) - kept and sum(h[3] for h in hunks) == len(new) - kept


def test_hunks_of_files_that_are_cut_at_anchors(spark):
    rng = random.Random(2)
    old = [f"line {i}" if i % 3 else "}" for i in range(900)]
    new = old[:100] + ["more", "}"] + old[100:400] + old[430:700] + old[760:800] + old[700:760] + old[800:]
    new[5] = "changed"
    made = {"big": (old, new), **files(3, 20, 60), "other": (["}"] * 40, ["{"] + ["}"] * 39), "rewritten": ([f"a{i}" for i in range(60)], [f"b{rng.random()}" for _ in range(70)])}
    got = by_file(linediff.hunks(table(spark, made, 0), table(spark, made, 1), small=10))
    for f, (o, n) in made.items():
        assert applied(o, n, got.get(f, [])) == n
    assert sum(h[1] for h in got["big"]) == len(old) - classic(old, new)
    assert got["rewritten"] == [(1, 60, 1, 70)] and linediff.hunks(table(spark, {"e": ([], [])}, 0), table(spark, {"e": ([], [])}, 1)).collect() == []


def test_common_lines_in_halves(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        for cells in (1 << 31, 20):
            monkeypatch.setattr(linediff, "CELLS", cells)
            pairs = linediff.common_lines(a, b)
            assert len(pairs) == classic(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def exact(rows, asked, k):
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows], float)
    n = np.linalg.norm(v, axis=1)
    u = np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0)
    out = set()
    for q in asked:
        cos = (u @ u[ids.index(q)]).round(6)
        order = [i for i in sorted(range(len(ids)), key=lambda i: (-cos[i], ids[i])) if ids[i] != q][:k]
        out |= {(q, ids[i], rank + 1) for rank, i in enumerate(order)}
    return out


def test_exact_search_skips_lists_and_probes_find_most(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((20, 16))
    rows = [(i, (centre[i % 20] + rng.standard_normal(16) * 0.15).tolist()) for i in range(1500)] + [(1500, [0.0] * 16), (1501, [0.0] * 16)]
    asked = [*range(0, 1500, 20), 1500]
    t = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    odd = spark.createDataFrame([(9000, [1.0]), (9001, None), (9002, [])], "id long, vector array<double>")
    index = vectors.build(t.union(odd), lists=20)
    q = t.where(t.id.isin(asked))
    found = vectors.similar(index, q, 5)
    assert {(r["query"], r["id"], r["rank"]) for r in found.collect()} == exact(rows, asked, 5)
    two = vectors.similar(index, q.where("id < 1500"), 5, probes=2)
    assert vectors.recall(two, found.where("query < 1500")) >= 0.9
    assert vectors.similar(index, q.where("false"), 5).collect() == []
    assert vectors.similar(vectors.build(t.where("false")), q, 5).collect() == []
