"""Substring deduplication by paragraph MinHash banding.

Texts are cut into paragraphs: at line ends, and in long lines after a word
that ends a sentence and whose hash selects it (one in CUT), so a passage is cut
alike wherever it stands. Each paragraph of MIN_WORDS words or more gets minwise
values banded for high recall (tune_bands); paragraphs that collide in a band
are compared, confirmed by exact Jaccard similarity of five-word shingles (0.8
or more), and clustered by components. Each cluster keeps its first occurrence
(smallest doc_id, then position) and the other occurrences are removed.
Shorter paragraphs (a common line, a licence note) are no passages and stay.

A passage that repeats inside running text need not hold a whole paragraph. So all
runs of UNIT words that have the smallest hash among WINDOW successive ones are units
too (winnowing): of a passage of UNIT + WINDOW - 1 words that repeats, wherever it
starts, all but WINDOW - 1 words at each end lie in units that are the same in
each copy. Of equal units the first outside removed paragraphs stays. Units that
follow each other within UNIT words are removed where they hold MIN_WORDS words or more
together, which those of any repeated passage of MIN_WORDS + 2 * (WINDOW - 1) words do.

A unit that a share of all texts holds is found while texts are cut; its rows are dealt over tasks
and its first place comes from a minimum, so no task gathers them.

Defined results: null and empty texts have no paragraphs and stay as they are.
Repeated rows and equal doc_ids count as documents of their own (told apart by
64 bits of their text's hash; of wholly equal rows all keep or lose the same paragraphs).
Null doc_ids come last among occurrences. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import similarity as sim
from .core import blobs, chunks, combine, drop_stored, hot_keys, join_copies, lists, mix, prepare, release, set_names, shingled, signed, stored, text_buffers, words

SHINGLE = 5
#: Words of a passage that counts as one; a bit more than half of the 50 that a passage worth removing has.
MIN_WORDS = 32
CUT = 8
ROWS_PER_BAND = 2
RECALL = 0.9995
UNIT = 16
WINDOW = 8


def tune_bands(rows: int = ROWS_PER_BAND, similarity: float = 0.8, recall: float = RECALL) -> int:
    """The fewest bands of this many rows that find a pair at this similarity with this recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def paragraphs(data: np.ndarray, offsets: np.ndarray):
    """(row, first word, end word) of all paragraphs of a chunk; with its words' hashes, places and rows."""
    hashes, start, end, first = words(data, offsets)
    n = len(start)
    if not n:
        return np.zeros((0, 3), np.int64), hashes, start, end, first
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data == 10) | (data == 13), out=lines[1:])
    stop = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8)) & (mix(hashes + np.uint64(3)) % np.uint64(CUT) == 0)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = (lines[start[1:]] > lines[end[:-1]]) | stop[:-1]
    cut[first] = True
    cut[n] = True
    edges = np.flatnonzero(cut)
    row = np.searchsorted(first, edges[:-1], "right") - 1
    return np.column_stack([row, edges[:-1], edges[1:]]), hashes, start, end, first


def units(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the runs of UNIT words that are the (leftmost) smallest of a window of WINDOW runs; none crosses rows."""
    n, k = len(hashes) - UNIT + 1, 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    run = hashes
    while k < UNIT:
        run, k = combine(run[:-k], run[k:]), 2 * k
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    # The upper half of the hash orders runs; the lower half holds the place, so a minimum names its place.
    low = run & ~np.uint64(0xFFFFFFFF)
    low[left < UNIT] = ~np.uint64(0xFFFFFFFF)
    low |= np.arange(n, dtype=np.uint64)
    edge = np.full(WINDOW - 1, ~np.uint64(0))
    low, k = np.concatenate([edge, low, edge]), 1
    while k < WINDOW:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    at = np.unique(low[low != edge[0]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[left[at] >= UNIT]
    return at, run[at]


PART_SCHEMA = "frequent boolean, doc_id long, k1 long, item long, lo int, hi int, n long, keys array<long>"


def _cut(min_words: int, bands: int, rows: int, buckets: int):
    """(doc_id, k1, text) -> a row for each paragraph: its set's name, place (bytes), words and band keys.

    And rows (frequent) with units frequent in a chunk and their number n, and the chunk's number of units under a null item.
    """

    def run(batches):
        for batch in batches:
            for at, data, offsets in chunks(*text_buffers(batch.column("text"))):
                parts, hashes, start, end, first = paragraphs(data, offsets)
                _, often = units(hashes, first)
                often, n = np.unique(often, return_counts=True)
                total, keep = int(n.sum()), n >= max(2, n.sum() / (8 * buckets))
                often, n = often[keep], n[keep]
                m = len(often) + 1
                none = pa.nulls(m, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([*signed(often).tolist(), None], pa.int64()), none, none, pa.array([*n.tolist(), total], pa.int64()), pa.nulls(m, pa.list_(pa.int64()))], PART_COLUMNS)
                parts = parts[parts[:, 2] - parts[:, 1] >= min_words]
                values, counts = shingled(hashes, parts[:, 1], parts[:, 2], SHINGLE)
                low = sim.minwise(values, counts, bands * rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(low), bands))
                for r in range(rows):
                    key = combine(key, low[:, r : bands * rows : rows].astype(np.uint64))
                row = parts[:, 0]
                base, take = offsets[row], pa.array(row + at)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(row), bool)), *(batch.column(c).take(take) for c in ("doc_id", "k1")), pa.array(set_names(values, counts)), pa.array((start[parts[:, 1]] - base).astype(np.int32)), pa.array((end[parts[:, 2] - 1] - base).astype(np.int32)), pa.array(parts[:, 2] - parts[:, 1]), lists(signed(key.reshape(-1)), np.full(len(low), bands))], PART_COLUMNS)

    return run


PART_COLUMNS = ["frequent", "doc_id", "k1", "item", "lo", "hi", "n", "keys"]


def _units(batches):
    """(doc_id, k1, text) -> a row for each unit: its hash, and its place (bytes) as one number."""
    for batch in batches:
        for at, data, offsets in chunks(*text_buffers(batch.column("text"))):
            hashes, start, end, first = words(data, offsets)
            word, run = units(hashes, first)
            row = np.searchsorted(first, word, "right") - 1
            base, take = offsets[row], pa.array(row + at)
            span = (start[word] - base) << 32 | (end[word + UNIT - 1] - base)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("doc_id", "k1")), pa.array(signed(run)), pa.array(span)], ["doc_id", "k1", "unit", "span"])


def _spans(batches):
    """(text, places: item, lo, hi) -> (item, sig, content) of the paragraphs at those places."""
    for batch in batches:
        items, parts = [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
            raw = text.encode()
            for place in places:
                items.append(place["item"]), parts.append(raw[place["lo"] : place["hi"]])
        for at, data, offsets in chunks(*text_buffers(blobs(parts))):
            hashes, _, _, first = words(data, offsets)
            values, counts = shingled(hashes, first[:-1], first[1:], SHINGLE)
            low, edge = sim.minwise(values, counts), np.cumsum(counts)
            content = [values[b - n : b].tobytes() for n, b in zip(counts.tolist(), edge.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(items[at : at + len(counts)], pa.int64()), blobs([x.tobytes() for x in low.astype(np.uint8)]), blobs(content)], ["item", "sig", "content"])


def _kept_runs(raw: bytes, spans: list, min_words: int) -> list[tuple[int, int]]:
    """The spans (lo, hi, sure) to remove: sure ones, and those of neighbours that hold min_words words or more together."""
    out = [(s["lo"], s["hi"]) for s in spans if s["sure"]]
    runs: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans if not s["sure"]):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    near: list[list[int]] = []
    for run in [*runs, None]:
        if near and (run is None or len(raw[near[-1][1] : run[0]].split()) > UNIT):
            if sum(len(raw[a:b].split()) for a, b in near) >= min_words:
                out += [tuple(x) for x in near]
            near = []
        if run:
            near.append(run)
    return sorted(out)


def _rewrite(min_words: int):
    """(doc_id, text, spans) -> what is left of each text."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_removed", "removed_bytes", "kept", "kept_sha256")}
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, at, kept, gone, n = (text or "").encode(), 0, [], 0, 0
                for lo, hi in _kept_runs(raw, spans or [], min_words):
                    if lo >= at:
                        kept.append(raw[at:lo])
                        at, n = lo, n + 1
                    gone, at = gone + max(0, hi - at), max(at, hi)
                rest = b"".join([*kept, raw[at:]])
                out["n_removed"].append(n), out["removed_bytes"].append(gone)
                out["kept"].append(rest.decode()), out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["n_removed"], pa.int64()), pa.array(out["removed_bytes"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["kept_sha256"], pa.string())], ["doc_id", "n_removed", "removed_bytes", "kept", "kept_sha256"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k1", F.xxhash64("text"))


def cut_texts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The stored rows of _cut for docs(doc_id, text, ...)."""
    spark = docs.sparkSession
    prepare(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored(_texts(docs).select("doc_id", "k1", "text").mapInArrow(_cut(min_words, tune_bands(), ROWS_PER_BAND, buckets), PART_SCHEMA), "paragraphs")


def duplicate_paragraphs(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) and their cut_texts -> each paragraph to remove: doc_id, k1, lo, hi (bytes)."""
    texts, parts = _texts(docs), cut.where("not frequent")
    # One row for each distinct paragraph; its keys follow from its set.
    made = stored(parts.groupBy("item").agg(F.first("keys").alias("keys")), "bands")
    nodes = stored(sim.sized(made.select(F.explode("keys").alias("node"), "item")).select("node", "item"), "colliding")
    drop_stored(made)
    # Signatures and sets only of paragraphs that collide, each read at one of its places.
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "lo", "hi")
    one = parts.join(nodes.select("item").distinct(), "item", "left_semi").groupBy("item").agg(F.min(at).alias("p"))
    places = one.groupBy(F.col("p.doc_id").alias("d"), F.col("p.k1").alias("h1")).agg(F.collect_list(F.struct("item", F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))).alias("places"))
    sets = stored(texts.join(places, _same()).select("text", "places").mapInArrow(_spans, "item long, sig binary, content binary").dropDuplicates(["item"]), "sets")

    del one, places
    release(docs.sparkSession)

    def full(items: DataFrame) -> DataFrame:
        return sets.select("item", "content").join(items, "item", "left_semi")

    roots = sim.clusters(nodes, sets.select("item", "sig"), full)
    drop_stored(nodes, sets)
    named = parts.join(roots.withColumnRenamed("node", "item"), "item", "left").withColumn("cluster", F.coalesce("root", "item"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "lo")
    named = stored(named.select("cluster", "doc_id", "k1", "lo", "hi"), "named")
    drop_stored(roots)
    first = stored(named.groupBy("cluster").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1"), "first")
    every = join_copies(named, first.select("cluster", "first"), ["cluster"], "doc_id", hot_keys(first, ["cluster"]))
    return every.where(place != F.col("first")).select("doc_id", "k1", "lo", "hi")


def _same():
    return F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("h1"))


def _by_text(gone: DataFrame) -> DataFrame:
    """Places (doc_id, k1, lo, hi, sure) -> d, h1, spans: the places of each text."""
    return gone.groupBy(F.col("doc_id").alias("d"), F.col("k1").alias("h1")).agg(F.collect_set(F.struct("lo", "hi", "sure")).alias("spans"))


def frequent_units(cut: DataFrame) -> DataFrame:
    """(unit): those that may be 1 / (4 x partitions) of all units; 8 x partitions of them at most."""
    found = cut.where("frequent").groupBy("item").agg(F.sum("n").alias("n"))
    total = found.where("item is null").first()
    least = 8 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.where(F.col("item").isNotNull() & (F.col("n") * least >= (total["n"] if total else 0))).select(F.col("item").alias("unit"))


def repeated_units(docs: DataFrame, often: DataFrame) -> DataFrame:
    """The stored places of units that occur twice or more, or are among the frequent ones: doc_id, k1, unit, often, lo, hi."""
    every = _texts(docs).select("doc_id", "k1", "text").mapInArrow(_units, "doc_id long, k1 long, unit long, span long")
    every = every.join(F.broadcast(often.withColumn("often", F.lit(True))), "unit", "left").withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("doc_id", "k1"), F.lit(64))).otherwise(0))
    again = every.withColumn("n", F.count("*").over(Window.partitionBy("unit", "salt"))).where("n > 1 or often")
    return stored(again.select("doc_id", "k1", "unit", F.col("often").isNotNull().alias("often"), F.shiftright("span", 32).cast("int").alias("lo"), F.col("span").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("hi")), "units")


def duplicate_units(docs: DataFrame, cut: DataFrame, gone: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), their cut_texts, the paragraphs to remove -> each unit to remove besides: doc_id, k1, lo, hi (bytes)."""
    often = stored(frequent_units(cut), "frequent")
    again = repeated_units(docs, often)
    drop_stored(often, cut)
    found = stored(_later_units(again, gone), "gone_units")
    drop_stored(again)
    return found


def _later_units(again: DataFrame, gone: DataFrame) -> DataFrame:
    """Of repeated_units, all but the first of each that lies outside the paragraphs to remove: doc_id, k1, lo, hi."""
    # A unit that a removed paragraph touches is no first occurrence: what it holds may be kept nowhere else.
    touched = F.exists("spans", lambda s: (s["lo"] < F.col("hi")) & (s["hi"] > F.col("lo")))
    again = again.join(_by_text(gone), _same(), "left").select("doc_id", "k1", "unit", "often", "lo", "hi", F.coalesce(touched, F.lit(False)).alias("cut"))
    place = F.struct("cut", F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "lo")
    order = Window.partitionBy("unit").orderBy("cut", F.col("doc_id").isNull(), "doc_id", "k1", "lo")
    ranked = again.where("not often").withColumn("rank", F.rank().over(order)).withColumn("lost", F.first("cut").over(order))
    found = ranked.where("rank > 1 and not lost").select("doc_id", "k1", "lo", "hi")
    # Frequent units: a minimum, combined before the shuffle, of a bounded number of them.
    hot = again.where("often")
    first = F.broadcast(hot.groupBy("unit").agg(F.min(place).alias("first")))
    return found.union(hot.join(first, "unit").where((place != F.col("first")) & ~F.col("first.cut")).select("doc_id", "k1", "lo", "hi"))


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per row: doc_id, n_removed (stretches), removed_bytes, kept (the text left), kept_sha256."""
    cut = cut_texts(docs, min_words)
    gone = stored(duplicate_paragraphs(docs, cut).withColumn("sure", F.lit(True)), "gone")
    release(docs.sparkSession)
    spans = _by_text(gone.union(duplicate_units(docs, cut, gone).withColumn("sure", F.lit(False))))
    joined = _texts(docs).join(spans, _same(), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_rewrite(min_words), "doc_id long, n_removed long, removed_bytes long, kept string, kept_sha256 string")
