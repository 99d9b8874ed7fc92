"""Approximate nearest neighbours: stable projections indexed by a kd-tree, verified until a chi-square test holds.

Vectors are projected on DIMENSIONS random directions with normal (2-stable)
entries. Of a vector at distance d the projected distance, squared and divided by d
squared, follows the chi-square law of DIMENSIONS degrees of freedom. Projected neighbours are
therefore verified (exact distance of the whole vectors) in growing projected
distance r, until chi-square(r^2 / d_k^2) reaches CONFIDENCE, d_k being the
distance of the k-th found so far: what is then still unverified and nearer than d_k
has been passed over with a chance of 1 - CONFIDENCE at most, each.

Over Spark: equal vectors are one, with the k + 1 smallest of their ids (no others can be among anyone's k
nearest; a third of all rows may be one vector). The upper part of the kd-tree is
fitted on SAMPLE vectors at most, picked by hash, and cuts the projected space in CELLS cells at
most; a cell of more than BLOCK_ROWS vectors is dealt over blocks by hash. Every vector is in one block. A query first
searches one block of its own cell, which bounds d_k; then it visits the blocks
of just those cells whose box passes the test at that bound. A block's vectors and the
queries that visit it meet in one task, the vectors first: the task builds the
lower part of the kd-tree and takes leaves by their box's distance. A block
that more than VISITS queries visit is copied for every VISITS of them.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do rows without id and, of a table with several lengths, those that have not the commonest
(the longest of equally common ones). Wholly repeated rows are one. A query's neighbours exclude its own
id. Ties go to the smaller id. A query with no candidate has no row; an empty table gives none.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import exact_key, lists, prepare, stored

DIMENSIONS = 8
CONFIDENCE = 0.98
SAMPLE = 32_768
CELLS = 1024
BLOCK_ROWS = 16_384
LEAF_ROWS = 32
VISITS = 4096
SEED = 20
#: Projected coordinates of one vector may differ so much, by the order of additions.
SLACK = 1e-9

PROJECTED = "cell int, v array<double>, p array<double>, ids array<long>"
FOUND = "q1 long, q2 long, vec_id long, score double"


def chi_square(x: float, dimensions: int) -> float:
    """The chi-square law's distribution function, for an even number of dimensions."""
    term = total = 1.0
    for k in range(1, dimensions // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def stopping_ratio(confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS) -> float:
    """Where the chi-square law reaches the confidence: verifying may end beyond this ratio of r^2 to d_k^2."""
    low, high = 0.0, 1.0
    while chi_square(high, dimensions) < confidence:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dimensions) < confidence else (low, mid)
    return high


def directions(length: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, dimensions))


def kd_cuts(points: np.ndarray, leaves: int, least: int) -> list[tuple[int, float, int, int]]:
    """The upper kd-tree: nodes (dimension, value, left, right); a child below 0 is the leaf -1 - child. Halves the largest part at its widest dimension."""
    parts, nodes = [(np.arange(len(points)), None, 0)], []
    done: list[tuple] = []
    while parts and len(parts) + len(done) < leaves:
        parts.sort(key=lambda x: len(x[0]))
        rows, above, side = parts.pop()
        x = points[rows]
        dim = int(np.argmax(np.ptp(x, axis=0))) if len(x) else 0
        value = float(np.median(x[:, dim])) if len(x) else 0.0
        left = x[:, dim] <= value
        if len(rows) < 2 * least or left.all():
            done.append((rows, above, side))
            continue
        nodes.append([dim, value, 0, 0])
        if above is not None:
            nodes[above][2 + side] = len(nodes) - 1
        parts += [(rows[left], len(nodes) - 1, 0), (rows[~left], len(nodes) - 1, 1)]
    for leaf, (_, above, side) in enumerate(parts + done):
        if above is not None:
            nodes[above][2 + side] = -1 - leaf
    return [tuple(n) for n in nodes]


def cells_of(points: np.ndarray, cuts: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64) if cuts else np.full(len(points), -1)
    while (open_ := np.flatnonzero(at >= 0)).size:
        dim, value, left, right = (np.array([c[k] for c in cuts]) for k in range(4))
        node = at[open_]
        at[open_] = np.where(points[open_, dim[node]] <= value[node], left[node], right[node])
    return -1 - at


class Block:
    """The lower kd-tree of one block: rows in leaves with boxes, in projected space."""

    def __init__(self, vectors: np.ndarray, projected: np.ndarray, ids: list[np.ndarray]):
        pieces, leaves = [np.arange(len(vectors))], []
        while pieces:
            rows = pieces.pop()
            x = projected[rows]
            dim = int(np.argmax(np.ptp(x, axis=0)))
            if len(rows) <= LEAF_ROWS:
                leaves.append(rows)
                continue
            order = np.argpartition(x[:, dim], len(rows) // 2)
            pieces += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
        order = np.concatenate(leaves)
        self.end = np.cumsum([len(x) for x in leaves])
        self.start = np.concatenate([[0], self.end[:-1]])
        self.vectors, self.projected, self.ids = vectors[order], projected[order], [ids[i] for i in order]
        self.low, self.high = np.minimum.reduceat(self.projected, self.start), np.maximum.reduceat(self.projected, self.start)

    def nearest(self, vector: np.ndarray, projected: np.ndarray, bound: float, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(distances, ids) of the k nearest found within the bound, by distance and id; the number of vectors verified."""
        gap = np.maximum(np.maximum(self.low - projected, projected - self.high), 0)
        far = (gap * gap).sum(axis=1)
        order, slack = np.argsort(far, kind="stable"), SLACK * (1 + np.abs(projected).max())
        dist, ids, at, step, verified = np.zeros(0), np.zeros(0, np.int64), 0, 1, 0
        while at < len(order) and math.sqrt(far[order[at]]) <= math.sqrt(ratio) * bound + slack:
            rows = np.concatenate([np.arange(self.start[x], self.end[x]) for x in order[at : at + step].tolist()])
            at, step = at + step, step * 2
            near = self.projected[rows] - projected
            rows = rows[np.sqrt((near * near).sum(axis=1)) <= math.sqrt(ratio) * bound + slack]
            verified += len(rows)
            apart = self.vectors[rows] - vector
            exact = np.sqrt((apart * apart).sum(axis=1))
            keep = exact <= bound
            own = [self.ids[i] for i in rows[keep].tolist()]
            dist = np.concatenate([dist, np.repeat(exact[keep], [len(x) for x in own])])
            ids = np.concatenate([ids, *own])
            best = np.lexsort((ids, dist))[:k]
            dist, ids = dist[best], ids[best]
            if len(dist) == k:
                bound = min(bound, float(dist[-1]))
        return dist, ids, verified


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _search(batches: Iterator[pa.RecordBatch], k: int, ratio: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, vectors before the queries that visit them: builds one block at a time."""
    now, held, block = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "part", "kind")], axis=1)
        for piece in np.split(np.arange(len(keys)), np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1):
            if not len(piece):
                continue
            rows, key = batch.slice(int(piece[0]), len(piece)), tuple(keys[piece[0]].tolist())
            if key[:3] != now:
                now, held, block = key[:3], [], None
            if key[3] == 0:
                held.append(rows)
                continue
            if not held:
                continue
            if block is None:
                ids = [np.asarray(x.values) for r in held for x in r.column("ids")]
                block = Block(np.concatenate([_matrix(r.column("v")) for r in held]), np.concatenate([_matrix(r.column("p")) for r in held]), ids)
            v, p = _matrix(rows.column("v")), _matrix(rows.column("p"))
            bound, q1, q2 = (rows.column(c).to_numpy() for c in ("bound", "q1", "q2"))
            found = [block.nearest(v[i], p[i], float(bound[i]), k, ratio)[:2] for i in range(len(v))]
            n = [len(x[0]) for x in found]
            yield pa.record_batch({"q1": np.repeat(q1, n), "q2": np.repeat(q2, n), "vec_id": np.concatenate([x[1] for x in found]).astype(np.int64), "score": np.concatenate([x[0] for x in found])})


def _usable(rows: DataFrame, vector: str, length: int | None = None) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    out = rows.select(F.col("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0")
    # A component that is null, NaN or infinite has no finite magnitude; a zero vector has no component above 0.
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    out = out.where(finite & F.exists("v", lambda x: F.abs(x) > 0))
    return out if length is None else out.where(F.size("v") == length)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS) -> DataFrame:
    """vectors(id, vector), queries(id, vector) -> (query_id, rank, vec_id, score): each query's k nearest found, without its own id."""
    spark = vectors.sparkSession
    prepare(spark)
    ratio = stopping_ratio(confidence, dimensions)
    usable = _usable(vectors, vector)
    lengths = usable.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = lengths[0] if lengths else 1
    first = Window.partitionBy("v").orderBy("id")
    same = usable.where(F.size("v") == length).distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    distinct = stored(same.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    n = distinct.count()

    own, matrix = [*exact_key("v")], directions(length, dimensions)
    least = SAMPLE / max(n, 1)
    sample = distinct.select("v") if least >= 1 else distinct.select("v").where(F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(1 << 30)) < int(least * (1 << 30)))
    picked = np.array([r[0] for r in sample.collect()], np.float64).reshape(-1, length) @ matrix
    cells = min(CELLS, max(1, math.ceil(n / BLOCK_ROWS)))
    cuts = kd_cuts(picked, cells, max(1, len(picked) // (4 * cells)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                p = _matrix(b.column("v")) @ matrix
                rest = {name: b.column(name) for name in b.schema.names}
                yield pa.record_batch({"cell": pa.array(cells_of(p, cuts).astype(np.int32)), "p": lists(p.ravel(), np.full(len(b), dimensions)), **rest})

    points = stored(distinct.mapInArrow(project, "cell int, p array<double>, v array<double>, ids array<long>"), "points")
    asked = _usable(queries, vector, length).select(F.col("id").alias("query_id"), "v", own[0].alias("q1"), own[1].alias("q2")).distinct()
    # Equal queries search once.
    once = asked.select("v", "q1", "q2").dropDuplicates(["q1", "q2"]).mapInArrow(project, "cell int, p array<double>, v array<double>, q1 long, q2 long")
    once = stored(once, "queries")
    # One row for each of CELLS cells at most.
    extent = [f(F.col("p")[i]).alias(f"{name}{i}") for i in range(dimensions) for name, f in (("low", F.min), ("high", F.max))]
    box = {r["cell"]: r for r in points.groupBy("cell").agg(F.count("*").alias("n"), *extent).collect()}
    blocks = {c: math.ceil(r["n"] / BLOCK_ROWS) for c, r in box.items()}
    low, high = (np.array([[r[f"{name}{i}"] for i in range(dimensions)] for r in box.values()]).reshape(-1, dimensions) for name in ("low", "high"))
    names = np.array(list(box), np.int64)
    of_cell = F.create_map(*[F.lit(x) for c, m in blocks.items() for x in (c, m)]) if blocks else F.create_map(F.lit(0), F.lit(1))
    placed = points.withColumn("block", F.pmod(F.xxhash64("v"), of_cell[F.col("cell")]).cast("int"))
    columns = ["cell", "block", "part", "kind", "v", "p", "ids", "bound", "q1", "q2"]

    def found_in(visits: DataFrame) -> DataFrame:
        """visits(cell, block, v, p, bound, q1, q2) -> FOUND."""
        counts = visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts"))
        a = placed.join(counts, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        a = a.withColumns({"kind": F.lit(0), "bound": F.lit(0.0), "q1": F.lit(0).cast("long"), "q2": F.lit(0).cast("long")}).select(columns)
        b = visits.join(counts, ["cell", "block"]).withColumn("part", F.pmod("q2", F.col("parts")).cast("int"))
        b = b.withColumns({"kind": F.lit(1), "ids": F.array().cast("array<long>")}).select(columns)
        met = a.unionByName(b).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "kind")
        return met.mapInArrow(lambda it: _search(it, k + 1, ratio), FOUND)

    at_home = once.where(F.col("cell").isin([int(c) for c in names])).withColumn("block", F.pmod("q1", of_cell[F.col("cell")]).cast("int")).withColumn("bound", F.lit(float("inf")))
    by_distance = Window.partitionBy("q1", "q2").orderBy("score", "vec_id")
    home = stored(found_in(at_home), "found_at_home")
    seen = home.groupBy("q1", "q2").agg(F.count("*").alias("n"), F.max("score").alias("most"))
    bounded = once.join(seen, ["q1", "q2"], "left").withColumn("bound", F.when(F.col("n") > k, F.col("most")).otherwise(F.lit(float("inf")))).drop("n", "most")

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, bound = _matrix(b.column("p")), b.column("bound").to_numpy()
            for at in range(len(b)):
                gap = np.maximum(np.maximum(low - p[at], p[at] - high), 0)
                near = names[np.sqrt((gap * gap).sum(axis=1)) <= math.sqrt(ratio) * bound[at] + SLACK * (1 + np.abs(p[at]).max())]
                to = [(c, m) for c in near.tolist() for m in range(blocks[c])]
                rows = b.slice(at, 1).take(pa.array(np.zeros(len(to), np.int64)))
                yield pa.record_batch({"cell": pa.array([c for c, _ in to], pa.int32()), "block": pa.array([m for _, m in to], pa.int32()), **{c: rows.column(c) for c in ("v", "p", "bound", "q1", "q2")}})

    wide = bounded.select("v", "p", "bound", "q1", "q2").mapInArrow(visited, "cell int, block int, v array<double>, p array<double>, bound double, q1 long, q2 long")
    # What was verified at home under a wider bound counts too.
    best = found_in(stored(wide, "visits")).union(home).distinct().withColumn("place", F.row_number().over(by_distance)).where(F.col("place") <= k + 1)
    answer = best.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    told = asked.select("query_id", "q1", "q2").join(answer, ["q1", "q2"])
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return told.select("query_id", F.posexplode(others).alias("place", "x")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def recall(found: DataFrame, vectors: DataFrame, query_ids: list[int], k: int = 10, vector: str = "embedding") -> float:
    """Of the k true nearest of each of a few queries (a stated list), the share that was found; the whole table is read, a batch at a time."""
    usable = _usable(vectors, vector)
    asked = {r["id"]: np.array(r["v"]) for r in usable.where(F.col("id").isin(query_ids)).collect()}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                ids, v = b.column("id").to_numpy(), _matrix(b.column("v"))
                for q, x in asked.items():
                    d = np.sqrt(((v - x) ** 2).sum(axis=1))
                    at = np.lexsort((ids, d))[: k + 1]
                    at = at[ids[at] != q]
                    yield pa.record_batch({"query_id": np.full(len(at), q), "vec_id": ids[at], "score": d[at]})

    exact = usable.mapInArrow(best, "query_id long, vec_id long, score double")
    exact = exact.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("place") <= k)
    due = exact.count()
    return exact.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").count() / max(due, 1)
