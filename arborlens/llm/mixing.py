"""Mixing sources to target weights by pivotal dependent rounding.

A document of source s should be taken target(s) / size(s) times on average. The
whole part is fixed; the fractions are rounded dependently: a document and the
pool of smaller ones pass mass (fraction x size) from one to the other, in a random direction
that keeps both expectations, until one side is integral. What stays open in a
chunk of CHUNK documents goes up a reduction tree of fan-in FAN, so a hot
source is many chunks and no task sees more than CHUNK documents. Only the last open
fraction of a source is drawn alone: a source's taken words differ from its
target by less than one document. All draws follow from hashes: reruns agree.

Defined results: a null or blank text has size 0 and is never taken; null source
is a source of its own, last in order; wholly repeated rows (doc_id, source,
text) share one decision; an empty table gives an empty table. Extra columns stay in apply_mix.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import WORD_RE, exact_key, prepare, stored

WEIGHTS = (1, 2, 3)
CAP = 3
CHUNK = 4096
FAN = 64
EPS = 1e-9


def targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> + target: shares by weight in code-point order, capped, the excess reshared by weight."""
    whole = Window.orderBy(F.col("source").asc_nulls_last())
    t = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(whole) - 1) % len(weights) + 1).cast("int")).cast("double"))
    t = t.withColumn("cap", F.col("source_size").cast("double") * cap).withColumn("fills_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    all_ = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.sum("source_size").over(all_) - before) / rest)
    # The first source that the level does not fill sets it for all that follow.
    t = t.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("fills_at"), F.col("level")), F.when(F.col("level") <= F.col("fills_at"), F.col("fills_at"))).over(all_))
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def pivot(sizes, fractions, rng: random.Random):
    """Round fractions dependently, keeping sum(size x fraction): (0, 1 or -1 for the one left open, its fraction).

    sizes descend. With equal fractions (a source's documents) each document is paired with the pool of all
    smaller ones: mass goes up to it or down to the pool until it, or the whole pool, is integral. So
    what stays open at the end is small. Unequal fractions (what the tree passes up) are paired two by two.
    """
    live = [b for b in fractions if EPS < b < 1 - EPS]
    if live and max(live) - min(live) > EPS:
        return _two_by_two(sizes, fractions, rng)
    taken = np.zeros(len(sizes), np.int64)
    todo = [j for j, b in enumerate(fractions) if EPS < b < 1 - EPS]
    for j, b in enumerate(fractions):
        taken[j] = b >= 1 - EPS
    room = float(sum(sizes[j] for j in todo))
    mass = float(sum(sizes[j] * fractions[j] for j in todo))
    # The fraction of a document still in the pool is scale x its first fraction + shift.
    scale, shift = 1.0, 0.0
    for at, j in enumerate(todo):
        s, f = sizes[j], min(max(scale * fractions[j] + shift, 0.0), 1.0)
        room, mass = room - s, mass - s * f
        if at == len(todo) - 1:
            if EPS < f < 1 - EPS:
                taken[j] = -1
                return taken, f
            taken[j] = f > 0.5
            return taken, 0.0
        up, down = min((1 - f) * s, max(mass, 0.0)), min(f * s, max(room - mass, 0.0))
        if up + down <= EPS:
            taken[j] = f > 0.5
            continue
        if rng.random() * (up + down) < down:
            keep = 1 - up / mass if mass > 0 else 0.0
            scale, shift, mass, f = scale * keep, shift * keep, mass - up, f + up / s
        else:
            keep = 1 - down / (room - mass) if room > mass else 0.0
            scale, shift, mass, f = scale * keep, shift * keep + 1 - keep, mass + down, f - down / s
        if EPS < f < 1 - EPS:
            for k in todo[at + 1 :]:
                taken[k] = scale * fractions[k] + shift > 0.5
            taken[j] = -1
            return taken, f
        taken[j] = f > 0.5
    return taken, 0.0


def _two_by_two(sizes, fractions, rng: random.Random):
    taken = np.zeros(len(sizes), np.int64)
    i, a = -1, 0.0
    for j, b in enumerate(fractions):
        if b <= EPS or b >= 1 - EPS:
            taken[j] = b > 0.5
            continue
        if i < 0:
            i, a = j, b
            continue
        s, t = sizes[i], sizes[j]
        up, down = min((1 - a) * s, b * t), min(a * s, (1 - b) * t)
        move = up if rng.random() * (up + down) < down else -down
        a, b = a + move / s, b - move / t
        if EPS < a < 1 - EPS:
            taken[j] = b > 0.5
            continue
        taken[i] = a > 0.5
        i, a = j, b
        if b <= EPS or b >= 1 - EPS:
            taken[j] = b > 0.5
            i = -1
    if i >= 0:
        taken[i] = -1
    return taken, a


def _level(seed: int, level: int, last: bool):
    """Rows sorted by chunk, heaviest first -> the same rows with fraction, up and open of this level; one chunk in memory at a time."""

    def rounded(parts):
        table = pa.Table.from_batches(parts)
        size, m, fraction, s1, s2, chunk = (table.column(c).to_numpy() for c in ("size", "m", "fraction", "s1", "s2", "chunk"))
        rng = random.Random(f"{seed} {level} {s1[0]} {s2[0]} {chunk[0]}")
        taken, left = pivot((size * m).astype(float).tolist(), fraction.tolist(), rng)
        is_open = taken < 0
        fraction = np.where(is_open, left, fraction)
        if last and is_open.any():
            taken[is_open] = int(rng.random() < left)
            is_open[:] = False
        for name, values in (("fraction", fraction), ("up", np.maximum(taken, 0)), ("open", is_open)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
        return table.to_batches()

    def run(batches):
        key, parts = None, []
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("s1", "s2", "chunk")]
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cuts = [0, *edge.tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:]):
                mine = tuple(int(k[a]) for k in keys)
                if parts and mine != key:
                    yield from rounded(parts)
                    parts = []
                key = mine
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from rounded(parts)

    return run


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = 17, chunk: int = CHUNK) -> DataFrame:
    """docs(doc_id, source, text, ...) -> (doc_id, source, k1, k2, m, size, source_size, target, copies).

    One row for each distinct (doc_id, source, text); m such rows exist. k1, k2 name the text.
    """
    prepare(docs.sparkSession)
    k1, k2 = exact_key("text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), k1.alias("k1"), k2.alias("k2"), size.alias("size"))
    units = stored(rows.groupBy("doc_id", "source", "k1", "k2").agg(F.count("*").alias("m"), F.first("size").alias("size")), "units")
    per = stored(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum(F.lit(1)).alias("n")).select("source", "source_size"), weights, cap), "targets")
    s1, s2 = exact_key("source")
    counts = units.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "s")
    plan = per.join(counts, F.col("source").eqNullSafe(F.col("s"))).select(F.col("s"), s1.alias("s1"), s2.alias("s2"), "source_size", "target", F.ceil(F.col("n") / chunk).alias("chunks"))
    plan = stored(plan, "plan")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + EPS)
    todo = units.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "k1", "k2", "m", "size", "source_size", "target", "s1", "s2", "chunks",
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "k1", "k2"), "chunks").alias("chunk"),
        base.alias("base"), F.when(F.col("size") > 0, F.greatest(rate - base, F.lit(0.0))).otherwise(0.0).alias("fraction"), F.lit(0).cast("long").alias("up"), F.lit(True).alias("open"))
    most = plan.agg(F.max("chunks")).first()[0] or 1
    level, parts = 0, []
    while True:
        last = most <= 1
        ordered = todo.repartition("s1", "s2", "chunk").sortWithinPartitions("s1", "s2", "chunk", (F.col("size") * F.col("m")).desc(), F.col("doc_id").asc_nulls_last(), "k1", "k2")
        done = stored(ordered.mapInArrow(_level(seed, level, last), todo.schema), f"round{level}")
        parts.append(done.where("not open"))
        if last:
            break
        todo = done.where("open").withColumn("chunk", F.floor(F.col("chunk") / FAN))
        most, level = -(-most // FAN), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("up")).otherwise(0)
    return out.select("doc_id", "source", "k1", "k2", "m", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken (words, repeats counted)."""
    out = mix(docs, **options).withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as it is taken, all its columns kept."""
    picked = mix(docs, **options).where("copies > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), "copies")
    k1, k2 = exact_key("text")
    # The row travels as one column, so its own columns may have any names.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), k1.alias("k1"), k2.alias("k2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(picked, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")) & F.col("id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
