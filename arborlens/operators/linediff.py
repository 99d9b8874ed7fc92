"""Line diffs of files as ordered hunks.

Files of up to SMALL lines, both versions together, are compared by their longest common subsequence. In larger ones, lines that stand
once in either version are anchors: the longest run of them that keeps its order (a longest increasing subsequence over line
numbers) cuts the file into gaps, and each gap is compared by itself, in its own task. So a task holds the numbers of a file's anchors, or the lines of a gap.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALL = 2000
#: Cells of a comparison that is kept whole; larger ones are halved first.
CELLS = 1 << 31

HUNKS = "file string, old_start long, old_lines long, new_start long, new_lines long"


def _rows(a: list, b: list) -> list[int]:
    """Bit rows of the longest common subsequence's lengths, one for each line of a: bit j is 0 where b[j] makes it longer."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full, row, out = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        out.append(row)
    return out


def _lengths(row: int, n: int) -> np.ndarray:
    """Length of the common subsequence with each prefix of b, from the last row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) of a longest common subsequence of two lists, in order."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    before = [(k, k) for k in range(head)]
    after = [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y:
        return before + after
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        left = _lengths(_rows(x[:half], y)[-1], len(y))
        right = _lengths(_rows(x[half:][::-1], y[::-1])[-1], len(y))[::-1]
        cut = int(np.argmax(left + right))
        found = common_lines(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in common_lines(x[half:], y[cut:])]
    else:
        rows, found, i, j = _rows(x, y), [], len(x), len(y)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not (i and not rows[i - 1] >> (j - 1) & 1):
                    j -= 1
                    found.append((i, j))
        found.reverse()
    return before + [(head + i, head + j) for i, j in found] + after


def increasing(numbers: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    ends, last, back = [], [], []
    for k, x in enumerate(numbers):
        at = bisect_left(ends, x)
        back.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [x], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def _anchors(pairs: pa.Table) -> pa.Table:
    pairs = pairs.sort_by("old")
    return pairs.take(pa.array(increasing(pairs["new"].to_pylist()), pa.int64()))


def _gap(lines: pa.Table) -> pa.Table:
    """One gap's lines of both versions -> its hunks."""
    lines = lines.sort_by([("side", "ascending"), ("number", "ascending")])
    side = lines["side"].to_numpy()
    number, text = lines["number"].to_numpy(), lines["line"].to_pylist()
    n = int((side == 0).sum())
    old, new = number[:n], number[n:]
    # Lines before the gap: the numbers of a version run without holes.
    base = lines["old_base"][0].as_py(), lines["new_base"][0].as_py()
    out, i, j = [], 0, 0
    for p, q in [*common_lines(text[:n], text[n:]), (n, len(new))]:
        if p > i or q > j:
            out.append((int(old[i]) if p > i else base[0] + i, p - i, int(new[j]) if q > j else base[1] + j, q - j))
        i, j = p + 1, q + 1
    file = lines["file"][0].as_py()
    columns = list(zip(*out)) or [[]] * 4
    return pa.table({"file": pa.array([file] * len(out), pa.string()), **{c: pa.array(v, pa.int64()) for c, v in zip(("old_start", "old_lines", "new_start", "new_lines"), columns)}})


def hunks(before: DataFrame, after: DataFrame, small: int = SMALL) -> DataFrame:
    """before, after(file, number: from 1 without holes, line) -> file, old_start, old_lines, new_start, new_lines.

    A start is the first line's number, or, where a version has no line in the hunk, the number of the line before it.
    Files of one version only are one hunk. Files that are equal have none.
    """
    side = lambda df, k: df.select("file", F.col("number").cast("long").alias("number"), "line", F.lit(k).alias("side"))
    both = side(before, 0).unionByName(side(after, 1))
    large = both.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > small).select("file")
    once = lambda k, name: both.where(F.col("side") == k).join(large, "file", "left_semi").groupBy("file", "line").agg(F.count("*").alias("n"), F.min("number").alias(name)).where("n = 1").drop("n")
    pairs = once(0, "old").join(once(1, "new"), ["file", "line"]).select("file", "old", "new")
    anchors = pairs.groupBy("file").applyInArrow(_anchors, "file string, old long, new long")
    # A line's gap is the last anchor before it; anchors themselves are in no gap.
    marks = anchors.select("file", F.lit(0).alias("side"), F.col("old").alias("number"), F.struct("old", "new").alias("mark")).unionByName(anchors.select("file", F.lit(1).alias("side"), F.col("new").alias("number"), F.struct("old", "new").alias("mark")))
    placed = both.join(marks, ["file", "side", "number"], "left")
    w = Window.partitionBy("file", "side").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    # Only files with anchors go through the window.
    cut = placed.join(large, "file", "left_semi").withColumn("last", F.last("mark", ignorenulls=True).over(w)).where("mark IS NULL").drop("mark")
    whole = both.join(large, "file", "left_anti").withColumn("last", F.lit(None).cast("struct<old:bigint,new:bigint>"))
    zero = F.lit(0).cast("long")
    rows = cut.unionByName(whole).select("file", "side", "number", "line", F.coalesce("last.old", zero).alias("old_base"), F.coalesce("last.new", zero).alias("new_base"))
    return rows.groupBy("file", "old_base").applyInArrow(_gap, HUNKS)
