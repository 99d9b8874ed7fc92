"""Quality classifier by positive-unlabelled learning.

A logistic model on features of the whole text (byte frequencies and a few
ratios) minimises the non-negative unbiased risk

    prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0))

over trusted positives (labels.quality = 1) and unlabelled texts. The prior is
estimated as the share of 1 among the labelled rows that may be learned from; beside it
the model carries an estimate that needs positives and unlabelled texts only
(unlabelled_prior), to compare.
Rows whose crc32(doc_id as text) mod 3 is 1 are held out: neither their labels nor
their texts are used to fit. The fit takes POSITIVES and UNLABELLED rows at
most, picked by hash from all rows; every row is scored, in one pass without a shuffle.

Defined results: null and empty texts get the features of no text; without
positives the score is the prior (0.5 without labels) everywhere; repeated
labels count once by their largest quality; a null doc_id is not held out and not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import chunks, prepare, text_buffers, words

POSITIVES = 6000
UNLABELLED = 12000
STEPS = 800
RATE = 0.05
DECAY = 1e-4
EXTRA = 12


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text of a chunk."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    bytes_ = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256).astype(np.float32)
    share = bytes_ / np.maximum(size, 1)[:, None]
    hashes, start, end, first = words(data, offsets)
    count = np.diff(first)
    word_row = np.repeat(np.arange(n), count)
    per = lambda v, rows: np.bincount(rows, v, n) / np.maximum(count, 1)
    length = end - start
    out = np.zeros((n, EXTRA))
    out[:, 0] = np.log1p(count)
    out[:, 1] = per(length, word_row)
    if len(hashes) > 1:
        again = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
        out[:, 2] = per(again, word_row[1:])
    final = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    begin = data[start] if len(start) else np.zeros(0, np.uint8)
    plain = lambda b: ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    out[:, 3] = per(~plain(final), word_row)
    out[:, 4] = per(~plain(begin), word_row)
    out[:, 5] = per((begin >= 65) & (begin <= 90), word_row)
    out[:, 6] = per((final >= 65) & (final <= 90), word_row)
    out[:, 7] = per(length == 1, word_row)
    order = np.lexsort((hashes, word_row))
    new = np.ones(len(order), bool)
    h, r = hashes[order], word_row[order]
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    out[:, 8] = per(new, r)
    out[:, 9] = per((data[np.maximum(end - 2, 0)] == final) & (length > 1) & ~plain(final) if len(end) else np.zeros(0), word_row)
    out[:, 10] = np.bincount(row, ~plain(data) & (data > 32), n) / np.maximum(size, 1)
    out[:, 11] = count == 0
    return np.concatenate([np.sqrt(share), np.sqrt(np.abs(out[:, 2:10])), out], axis=1).astype(np.float32)


WIDTH = 256 + 8 + EXTRA


def _featurise(batches):
    for batch in batches:
        for at, data, offsets in chunks(*text_buffers(batch.column("text"))):
            f = features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("role").slice(at, len(f)), pa.array([x.tobytes() for x in f], pa.binary())], ["role", "f"])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> dict:
    """A logistic model under the non-negative risk, by full-batch Adam from a fixed start."""
    # One single-precision array, standardised in place: the driver holds no second copy.
    both = np.ones((len(positive) + len(unlabelled), positive.shape[1] + 1), np.float32)
    both[: len(positive), :-1], both[len(positive) :, :-1] = positive, unlabelled
    x = both[:, :-1]
    mean = x.mean(axis=0, dtype=np.float64)
    x -= mean
    scale = np.sqrt(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x)) + 1e-3
    x /= scale
    p, u = both[: len(positive)], both[len(positive) :]
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        single = w.astype(np.float32)
        sp, su = sigmoid((p @ single).astype(np.float64)), sigmoid((u @ single).astype(np.float64))
        # logistic loss: as 1, -log s with gradient s - 1; as 0, -log(1 - s) with gradient s
        as_one = p.T @ (sp - 1).astype(np.float32) / len(p)
        p_zero, u_zero = p.T @ sp.astype(np.float32) / len(p), u.T @ su.astype(np.float32) / len(u)
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        # below zero the negative part is driven back up instead (the non-negative correction)
        g = prior * as_one + (u_zero - prior * p_zero) if negative >= 0 else -(u_zero - prior * p_zero)
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "w": w, "pu_prior": unlabelled_prior(p @ w.astype(np.float32), u @ w.astype(np.float32))}


def unlabelled_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from scores alone: the least ratio of the two shares above a threshold that at least `least` of the positives pass.

    Above a threshold that negatives do not pass, the unlabelled rows are positives only, so the ratio is the prior.
    """
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 50))
    share = lambda x: 1 - np.searchsorted(np.sort(x), cuts) / len(x)
    return float(min(1.0, (share(unlabelled) / share(positive)).min()))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """Fit on a bounded sample of rows that are not held out."""
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    n, ones = seen.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("int"))).first()
    prior = min(max((ones or 0) / n, 0.05), 0.95) if n else 0.5
    at = F.xxhash64(F.lit(11), "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    p = seen.where("quality = 1").select("doc_id").orderBy(at, "doc_id").limit(positives).withColumn("role", F.lit(1))
    u = rows.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(12), "doc_id"), "doc_id").limit(unlabelled).withColumn("role", F.lit(0))
    # At most positives + unlabelled ids and a role: some hundred KB.
    picked = rows.join(F.broadcast(p.union(u)), "doc_id").select("text", "role")
    got = picked.mapInArrow(_featurise, "role int, f binary").collect()
    x = [np.frombuffer(b"".join(r["f"] for r in got if r["role"] == k), np.float32).reshape(-1, WIDTH) for k in (1, 0)]
    del got
    if not len(x[0]) or not len(x[1]):
        return {"constant": prior}
    return fit(x[0], x[1], prior) | {"prior": prior}


def _score(model: dict, name: str):
    def run(batches):
        for batch in batches:
            for at, data, offsets in chunks(*text_buffers(batch.column("text"))):
                n = len(offsets) - 1
                if "constant" in model:
                    s = np.full(n, model["constant"])
                else:
                    z = ((features(data, offsets) - model["mean"]) / model["scale"]) @ model["w"][:-1] + model["w"][-1]
                    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, n) for c in batch.schema.names), pa.array(s)], [*batch.schema.names, name])

    return run


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of docs has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def scored(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """All columns of docs and a score from 0 to 1, in a column that docs does not have (see free_name)."""
    if free_name(docs, name) != name:
        raise ValueError(f"docs already has a column {name}")
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    prepare(docs.sparkSession)
    return docs.mapInArrow(_score(model, name), schema)
