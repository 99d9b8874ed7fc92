"""MinHash near-duplicates by a chosen-path set similarity join.

Every document is a set of word shingles. Independent trees start with all
distinct sets in one node; a node picks minwise tokens and its members branch to
one child for each picked token's value, so similar sets meet again and others
part. After START_LEVELS the nodes are nearly all empty; nodes of up to
NODE_LIMIT members are compared exhaustively, larger ones in pairs of blocks. TREES trees
bring the chance that a pair at a similarity of 0.8 never meets below 1e-6
(miss(TREES, START_LEVELS)). Pairs are confirmed on the full sets.

Defined results: null, empty or blank text has an empty set, is linked with
nothing and kept. Fewer words than a shingle make one shingle. Equal sets
(repeated rows included) are one member. Rows with a null doc_id take part;
their component's smallest doc_id is taken over the others. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import similarity as sim
from .core import blobs, chunks, combine, drop_stored, exact_key, lists, prepare, set_names, shingled, signed, stored, text_buffers, words

TREES = 14
START_LEVELS = 3


def miss(trees: int, levels: int, similarity: float = 0.8) -> float:
    """Chance that a pair of this similarity shares no node of this level in any tree (a branching process)."""
    dead = 0.0
    for _ in range(levels):
        one = 1 - similarity + similarity * dead
        dead = 0.75 * one + 0.25 * one * one
    return dead**trees


def tree_keys(low: np.ndarray, trees: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) that each row of minwise values reaches after this many levels of each tree, by row."""
    row = np.repeat(np.arange(len(low)), trees)
    node = combine(np.tile(np.arange(trees, dtype=np.uint64), len(low)), np.full(len(row), 0x7EE, np.uint64))
    for _ in range(levels):
        at, node = sim.branch_keys(node, low, row)
        row = row[at]
    order = np.argsort(row, kind="stable")
    return row[order], node[order]


def _sketch(size: int, trees: int, levels: int):
    def run(batches):
        for batch in batches:
            for at, data, offsets in chunks(*text_buffers(batch.column("text"))):
                hashes, _, _, first = words(data, offsets)
                values, counts = shingled(hashes, first[:-1], first[1:], size)
                low = sim.minwise(values, counts)
                row, node = tree_keys(low, trees, levels)
                n = len(counts)
                own = [batch.column(c).slice(at, n) for c in ("doc_id", "k1", "k2")]
                keys = lists(signed(node), np.bincount(row, minlength=n))
                yield pa.RecordBatch.from_arrays([*own, pa.array(set_names(values, counts)), pa.array(counts.astype(np.int64)), keys, blobs([x.tobytes() for x in low.astype(np.uint8)])], ["doc_id", "k1", "k2", "item", "n_shingles", "keys", "sig"])

    return run


def _full(size: int):
    def run(batches):
        for batch in batches:
            for _, data, offsets in chunks(*text_buffers(batch.column("text"))):
                hashes, _, _, first = words(data, offsets)
                values, counts = shingled(hashes, first[:-1], first[1:], size)
                yield pa.RecordBatch.from_arrays([pa.array(set_names(values, counts)), blobs([x.tobytes() for x in np.split(values, np.cumsum(counts)[:-1])])], ["item", "content"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, trees: int = TREES, levels: int = START_LEVELS) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per row: doc_id, n_shingles, component_id, kept, k1, k2, cluster.

    component_id is the smallest doc_id reachable; k1, k2 name the text, cluster the component.
    """
    prepare(docs.sparkSession)
    k1, k2 = exact_key(F.coalesce("text", F.lit("")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), "text")
    made = stored(docs.mapInArrow(_sketch(shingle, trees, levels), "doc_id long, k1 long, k2 long, item long, n_shingles long, keys array<long>, sig binary"), "sketches")
    sets = made.where("n_shingles > 0").groupBy("item").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    sets = stored(sets, "sets")
    rows = stored(made.select("doc_id", "k1", "k2", "item", "n_shingles"), "rows")
    drop_stored(made)
    nodes = sets.select(F.explode("keys").alias("node"), "item")

    def full(items: DataFrame) -> DataFrame:
        holders = sets.join(items, "item", "left_semi").select(F.col("doc_id").alias("holder")).distinct()
        texts = docs.select("doc_id", "text").join(holders, F.col("doc_id").eqNullSafe(F.col("holder")), "left_semi")
        return texts.mapInArrow(_full(shingle), "item long, content binary").join(items, "item", "left_semi").groupBy("item").agg(F.first("content").alias("content"))

    roots = sim.clusters(nodes, sets.select("item", "sig"), full)
    smallest = roots.join(sets.select(F.col("item").alias("node"), "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = roots.join(smallest, "root").select(F.col("node").alias("item"), "root", "component_id")
    label = sets.select("item", F.col("doc_id").alias("own")).join(label, "item", "left").select("item", F.coalesce("root", "item").alias("cluster"), F.when(F.col("root").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"))
    out = rows.join(label, "item", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component) | (F.col("n_shingles") == 0)).alias("kept"), "k1", "k2", "cluster")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, one row for each group of near duplicates: its smallest doc_id (then text hash); all rows without words."""
    found = stored(near_duplicates(docs, **options), "classes")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    best = found.where("n_shingles > 0").groupBy("cluster").agg(F.min(place).alias("p")).select("p.doc_id", "p.k1", "p.k2", F.lit(False).alias("blank"))
    blank = found.where("n_shingles = 0").select("doc_id", "k1", "k2", F.lit(True).alias("blank")).distinct()
    keep = best.union(blank).select(F.col("doc_id").alias("d"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), "blank")
    k1, k2 = exact_key(F.coalesce("text", F.lit("")))
    # The row travels as one column, so its own columns may have any names.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(keep, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")) & F.col("id").eqNullSafe(F.col("d")))
    # of wholly repeated rows, one
    again = F.row_number().over(Window.partitionBy("k1", "k2", "d").orderBy(F.lit(1)))
    return rows.withColumn("again", again).where("blank or again = 1").select("row.*")
