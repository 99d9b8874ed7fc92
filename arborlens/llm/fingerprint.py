"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines; a text without a line end
is one, an empty text has none). Each paragraph is hashed to a wide vector: 8 lanes of 64 bits
from its whole bytes, and LANES lanes of 32 bits that count its distinct
two-word shingles with pseudo-random signs. A fingerprint is the sum over
paragraphs, modulo 2**64 and 2**32, and the paragraphs' number: order does not matter, and a paragraph is
inserted or deleted by adding or subtracting its vector (combined). Equal
multisets have equal fingerprints; others differ but for chance 2**-512.

likeness: the sign lanes estimate squared distances between shingle multisets,
so 1 - |a - b|^2 / (|a|^2 + |b|^2), clipped to 0..1, is about the share of common shingles.

Defined results: null is empty; equal texts have likeness 1, two empty ones too;
equal doc_ids are ordered by their text's hash; null doc_ids come last in
descending order; a single row's next document is itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import chunks, exact_key, mix, prepare, shingled, text_buffers, words

LANES = 128
WIDE = 8
BYTES = 8 * WIDE + 4 * LANES + 8


def sums(texts: list[str]) -> np.ndarray:
    """Fingerprints (n x BYTES, uint8) of whole texts."""
    n = len(texts)
    wide = np.zeros((n, WIDE), np.uint64)
    count = np.zeros(n, np.uint64)
    for i, text in enumerate(texts):
        if not text:
            continue
        lines = text.split("\n")
        count[i] = len(lines)
        v = np.frombuffer(b"".join([hashlib.blake2b(x.encode(), digest_size=8 * WIDE).digest() for x in lines]), "<u8")
        wide[i] = v.reshape(-1, WIDE).sum(axis=0, dtype=np.uint64)
    signs = np.zeros((n, LANES), np.int64)
    column = pa.array(texts, pa.large_string())
    for at, data, offsets in chunks(*text_buffers(column)):
        hashes, start, end, first = words(data, offsets, lower=False)
        if not len(hashes):
            continue
        feeds = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 10, out=feeds[1:])
        cut = np.zeros(len(start) + 1, bool)
        cut[1:-1] = feeds[start[1:]] > feeds[end[:-1]]
        cut[first] = True
        cut[-1] = True
        edges = np.flatnonzero(cut)
        values, counts = shingled(hashes, edges[:-1], edges[1:], 2)
        line_row = np.searchsorted(first, edges[:-1], "right") - 1
        rows = np.repeat(line_row, counts)
        for i in range(0, len(values), 4096):
            v, r = values[i : i + 4096], rows[i : i + 4096]
            lanes = np.stack([mix(v + np.uint64(0x9E37 * (k + 1))) for k in range(LANES // 64)], axis=1)
            bits = np.unpackbits(lanes.view(np.uint8), axis=1)
            edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            total = np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
            signs[at + r[edge]] += 2 * total - np.diff(np.append(edge, len(r)))[:, None]
    return np.concatenate([wide.astype("<u8").view(np.uint8), (signs & 0xFFFFFFFF).astype("<u4").view(np.uint8), count.astype("<u8")[:, None].view(np.uint8)], axis=1)


def _lanes(f: np.ndarray):
    f = np.ascontiguousarray(f)
    return f[:, : 8 * WIDE].copy().view("<u8"), f[:, 8 * WIDE : 8 * WIDE + 4 * LANES].copy().view("<u4"), f[:, -8:].copy().view("<u8")


def combined(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """The fingerprints of a with the paragraphs of b inserted (sign 1) or deleted (sign -1)."""
    parts = [x + y if sign > 0 else x - y for x, y in zip(_lanes(a), _lanes(b))]
    return np.concatenate([p.view(np.uint8).reshape(len(a), -1) for p in parts], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated likeness of fingerprints, row by row: 1 if equal, else below."""
    x, y = (_lanes(f)[1].view("<i4").astype(np.float64) for f in (a, b))
    apart, whole = ((x - y) ** 2).sum(axis=1), (x * x).sum(axis=1) + (y * y).sum(axis=1)
    equal = (a == b).all(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.clip(np.where(whole > 0, 1 - apart / whole, 0.0), 0.0, 1.0 - 1e-9)
    return np.where(equal, 1.0, out)


def _hex(f: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in f]


def edit(text: str, following: str) -> str:
    """The last half of a text's code points replaced by the first as many (or all) of another's."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches):
    """Rows (doc_id, text, guest) in descending order, guests last -> fingerprints of each own row and its edit."""
    held: list[tuple] = []

    def done(pairs):
        texts = [p[1] for p in pairs]
        following = [p[2] for p in pairs]
        edited = [edit(t, f) for t, f in zip(texts, following)]
        own = sums([*texts, following[-1]])
        changed = sums(edited)
        # the next document of a row is the row after it, but for the last of these
        own, after = own[:-1], own[1:]
        return pa.RecordBatch.from_arrays([
            pa.array([p[0] for p in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(_hex(own)), pa.array(_hex(changed)),
            pa.array(likeness(own, changed)), pa.array(likeness(own, after))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ended = False
    for batch in batches:
        if ended:
            continue
        rows = list(zip(batch.column("doc_id").to_pylist(), (t or "" for t in batch.column("text").to_pylist()), batch.column("guest").to_pylist()))
        rows = held + rows
        pairs = []
        for a, b in zip(rows, rows[1:]):
            if a[2]:
                ended = True
                break
            pairs.append((a[0], a[1], b[1]))
        held = rows[-1:]
        if pairs:
            yield done(pairs)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are dealt to ranges of doc_id at approximate quantiles, which move each text
    once; the first row of each range also goes, as a guest, to the range before it.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k1, k2 = exact_key("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"))
    edges = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or [] if n > 1 else []
    cuts = F.array(*[F.lit(x).cast("long") for x in sorted(set(edges))]) if edges else F.array().cast("array<long>")
    last = len(set(edges))
    # 0 holds the largest doc_ids; null ones are in the last.
    bucket = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.lit(last) - F.size(F.filter(cuts, lambda e: e < F.col("doc_id"))))
    rows = rows.withColumn("bucket", bucket)
    place = F.struct(F.col("doc_id").isNull().alias("n"), (-F.col("doc_id")).alias("d"), "k1", "k2")
    # One row for each range: n at most.
    heads = sorted((r["bucket"], *r["head"]) for r in rows.groupBy("bucket").agg(F.min(place).alias("head")).collect())
    if not heads:
        return rows.select("doc_id", "text", F.lit(False).alias("guest")).mapInArrow(_pairs, _SCHEMA)
    to = {b: heads[i - 1][0] for i, (b, *_) in enumerate(heads)}
    table = spark.createDataFrame([(b, None if null else -d, a, c, to[b]) for b, null, d, a, c in heads], "hb int, hd long, h1 long, h2 long, goes int")
    is_head = (F.col("bucket") == F.col("hb")) & F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("goes").alias("bucket"), F.lit(True).alias("guest"))
    dealt = rows.join(F.broadcast(table), is_head, "left").withColumn("at", F.explode(F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    dealt = dealt.select("at.bucket", "at.guest", "doc_id", "text", "k1", "k2").repartitionById(last + 1, F.col("bucket"))
    ordered = dealt.sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), "k1", "k2")
    return ordered.select("doc_id", "text", "guest").mapInArrow(_pairs, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
