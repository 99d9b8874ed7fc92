"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of up to PASSAGE words. Their TF-IDF
matrix (document frequencies from all passages of the corpus) gets a randomised
SVD, computed by two distributed passes of subspace iteration. Corpus windows
of two passages' length, half overlapping, so that each holds any passage whole, are folded into the latent
space; pairs of cosine COSINE or more are candidates, and those whose window holds HELD of
the passage's weight, however much else it holds. A candidate is confirmed by
the longest common subsequence of words: at least STRONG of the item's words in
order, or WEAK of them if WEAK of its answer is there too (column `answer`, else
the last third of the item), so paraphrases with words changed or left out are found.

The benchmark is the query set: it is read in blocks of BLOCK_PASSAGES at most. The rank of a block is
RANK_SHARE of its passages: what passages have in common is kept, the least part of each is not. Every
passage keeps LEAST_KEPT of its length, by a direction of its own if need be, so a window that holds it whole always passes the second rule. The
corpus is read once for the frequencies of up to VOCABULARY words of many blocks, and once for each
MODEL_BYTES of their models (vocabulary x rank floats: some MB each), which go to all executors; words are
cut once for all models of a pass, and nothing is shuffled.

Defined results: null, empty and blank texts and items match nothing; items shorter
than MIN_WORDS words must be there in full; repeated rows are reported each; repeated
item ids count as items of their own. Other columns stay in decontaminated().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import blobs, chunks, prepare, text_buffers, words

PASSAGE = 48
#: Of a block's passages, the share that is its rank; at least LEAST_RANK (or all of them).
RANK_SHARE = 0.75
LEAST_RANK = 16
#: A passage that keeps less of its length than this gets a direction of its own beside the singular ones.
LEAST_KEPT = 0.6
#: What the second rule lets through below HELD, for what the projection takes from a window and not from the passage.
SLACK = 0.8
COSINE = 0.35
HELD = 0.4
STRONG = 0.8
WEAK = 0.6
MIN_WORDS = 6
BLOCK_PASSAGES = 256
#: Different words of the blocks whose frequencies are counted in one pass, and bytes of models that one pass takes.
VOCABULARY = 1_000_000
MODEL_BYTES = 64 << 20


def item_words(texts: list[str]) -> list[np.ndarray]:
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    h, _, _, first = words(data, offsets)
    return [h[a:b] for a, b in zip(first[:-1], first[1:])]


def pieces(w: np.ndarray) -> list[np.ndarray]:
    return np.array_split(w, -(-len(w) // PASSAGE)) if len(w) else []


def _half_passages(hashes, first):
    """The number of the half window (PASSAGE words, from a row's start) of each word, and its row."""
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    halves = -(-count // PASSAGE)
    base = np.concatenate([[0], np.cumsum(halves)])
    return base[row] + (np.arange(len(hashes)) - first[row]) // PASSAGE, base


def _frequencies(vocabulary: np.ndarray):
    def run(batches):
        n, seen = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, data, offsets in chunks(*text_buffers(batch.column("text"))):
                hashes, _, _, first = words(data, offsets)
                half, base = _half_passages(hashes, first)
                n += int(base[-1])
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = vocabulary[at] == hashes
                pair = np.unique(half[hit] * len(vocabulary) + at[hit])
                seen += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], ["word", "n"])

    return run


def _normal_pass(z: np.ndarray):
    """Rows (words, weights) of A -> the rows of A'(A z) that they touch."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, x in zip(batch.column("words").to_pylist(), batch.column("weights").to_pylist()):
                y = np.array(x) @ z[w]
                for k, v in zip(w, x):
                    total[k] = total[k] + v * y if k in total else v * y
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), blobs([v.tobytes() for v in total.values()])], ["word", "v"])

    return run


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch.column("word").to_pylist(), batch.column("v").to_pylist()):
            x = np.frombuffer(v)
            total[k] = total[k] + x if k in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), blobs([v.tobytes() for v in total.values()])], ["word", "v"])


def randomised_svd(matrix: DataFrame, width: int, rank: int, seed: int = 5) -> np.ndarray:
    """The right singular vectors (width x rank or fewer) of a matrix of rows (words, weights)."""
    rank = min(rank, width)
    q = np.random.default_rng(seed).standard_normal((width, rank))
    for _ in range(2):
        q, z = np.linalg.qr(q)[0], np.zeros((width, rank))
        for r in matrix.mapInArrow(_normal_pass(q), "word long, v binary").repartition("word").mapInArrow(_add, "word long, v binary").collect():
            z[r["word"]] = np.frombuffer(r["v"])
        basis, q = q, z
    values, vectors = np.linalg.eigh(basis.T @ z)
    keep = values > values.max(initial=0) * 1e-9
    return (basis @ vectors[:, keep]).astype(np.float32)


def longest_common(masks: dict[int, int], n: int, window: list[int]) -> int:
    """The length of the longest common subsequence, bit-parallel; masks: places of each word in the passage."""
    full = (1 << n) - 1
    s = full
    for w in window:
        m = masks.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def _masks(w: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(w.tolist()):
        out[x] = out.get(x, 0) | 1 << i
    return out


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many passages of the corpus each word of a sorted vocabulary stands, and their number."""
    found = docs.select("text").mapInArrow(_frequencies(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out, n = np.zeros(len(vocabulary), np.int64), 0
    for r in found.collect():
        if r["word"] < 0:
            n = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, n


def build(spark: SparkSession, items: list[tuple], every: np.ndarray, seen: np.ndarray, n: int, share: float = RANK_SHARE) -> dict | None:
    """The retrieval model of a block of items (item_id, text, answer or None); every, seen, n: a vocabulary that holds theirs, with its frequencies."""
    all_words = item_words([t or "" for _, t, _ in items])
    answers = item_words([a or "" for _, _, a in items])
    kept = [i for i, w in enumerate(all_words) if len(w)]
    if not kept:
        return None
    vocabulary = np.unique(np.concatenate([all_words[i] for i in kept]))
    idf = np.log((1 + n) / (1 + seen[np.searchsorted(every, vocabulary)])) + 1
    rows, owner, bodies, norms = [], [], [], []
    for i in kept:
        for piece in pieces(all_words[i]):
            at, tf = np.unique(np.searchsorted(vocabulary, piece), return_counts=True)
            x = tf * idf[at]
            norms.append(np.linalg.norm(x))
            rows.append((at.tolist(), (x / norms[-1]).tolist()))
            owner.append(i)
            bodies.append(piece)
    matrix = spark.createDataFrame(rows, "words array<int>, weights array<double>").repartition(max(1, len(rows) // 64))
    latent = randomised_svd(matrix, len(vocabulary), min(len(rows), max(LEAST_RANK, int(np.ceil(share * len(rows))))))
    plain = np.zeros((len(rows), len(vocabulary)), np.float32)
    for k, (at, x) in enumerate(rows):
        plain[k, at] = x
    folded = plain @ latent
    lost = np.linalg.norm(folded, axis=1) < LEAST_KEPT
    if lost.any():
        rest = np.linalg.qr((plain[lost] - folded[lost] @ latent.T).T)[0]
        latent = np.concatenate([latent, rest.astype(np.float32)], axis=1)
        folded = plain @ latent
    kept_length = np.linalg.norm(folded, axis=1)
    folded /= np.maximum(kept_length, 1e-12)[:, None]
    sizes = np.array([len(all_words[i]) for i in owner])
    due = np.where(sizes < MIN_WORDS, 1.0, WEAK) * sizes
    need = np.maximum(1, np.ceil(due - (sizes - np.array([len(b) for b in bodies])) - 1e-9))
    tail = [answers[i] if len(answers[i]) else w[len(w) - -(-len(w) // 3) :] for i, w in enumerate(all_words)]
    return {"vocabulary": vocabulary, "weighted": (latent * idf[:, None]).astype(np.float32), "folded": folded, "least": (SLACK * HELD * kept_length * np.array(norms)).astype(np.float32), "owner": owner, "ids": [t[0] for t in items], "sizes": [len(w) for w in all_words], "pieces": [(_masks(np.searchsorted(vocabulary, b)), len(b)) for b in bodies], "member": plain > 0, "overlap": (plain > 0).T.astype(np.float32), "need": need.astype(np.float32), "tails": [([(_masks(x), len(x)) for x in pieces(t)], len(t)) for t in tail]}


def matches(model: dict, hashes: np.ndarray, first: np.ndarray):
    """Confirmed (row, item, cosine, share in order, share of the answer) of a chunk's words."""
    vocabulary, weighted, owner = model["vocabulary"], model["weighted"], model["owner"]
    if not len(hashes):
        return []
    half, base = _half_passages(hashes, first)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[at] == hashes
    hit, code = np.flatnonzero(known), np.where(known, at, -1)
    # The weights of a half window's words in the latent space, and how many of them stand in each passage.
    sums, common = (np.zeros((int(base[-1]), m.shape[1]), np.float32) for m in (weighted, model["overlap"]))
    for i in range(0, len(hit), 4096):
        part = hit[i : i + 4096]
        h = half[part]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sums[h[edge]] += np.add.reduceat(weighted[at[part]], edge, axis=0)
        common[h[edge]] += np.add.reduceat(model["overlap"][at[part]], edge, axis=0)
    row_of = np.repeat(np.arange(len(base) - 1), np.diff(base))
    both, shared = sums.copy(), common.copy()
    if len(sums) > 1:
        same = row_of[1:] == row_of[:-1]
        both[:-1][same] += sums[1:][same]
        shared[:-1][same] += common[1:][same]
    norm = np.linalg.norm(both, axis=1)
    live = np.flatnonzero(norm > 0)
    best: dict[tuple[int, int], dict] = {}
    for i in range(0, len(live), 8192):
        some = live[i : i + 8192]
        dot = both[some] @ model["folded"].T
        cosine = dot / norm[some, None]
        # A window that shares fewer words with a passage than its item needs of it cannot confirm it.
        for a, p in zip(*np.nonzero(((cosine >= COSINE) | (dot >= model["least"])) & (shared[some] >= model["need"]))):
            half_no = int(some[a])
            row = int(row_of[half_no])
            start = int(first[row]) + (half_no - int(base[row])) * PASSAGE
            stop = min(start + 2 * PASSAGE, int(first[row + 1]))
            item = owner[p]
            masks, n = model["pieces"][p]
            got = best.setdefault((row, item), {"cosine": 0.0, "pieces": {}, "windows": set()})
            got["cosine"] = max(got["cosine"], float(cosine[a, p]))
            got["windows"].add((start, stop))
            # Only words of the passage can be in common, and no more of them than the window has.
            own = code[start:stop]
            own = own[own >= 0]
            own = own[model["member"][p, own]]
            if len(own) > got["pieces"].get(int(p), 0):
                got["pieces"][int(p)] = max(got["pieces"].get(int(p), 0), longest_common(masks, n, own.tolist()))
    out = []
    for (row, item), got in sorted(best.items()):
        share = sum(got["pieces"].values()) / model["sizes"][item]
        if share < (1 if model["sizes"][item] < MIN_WORDS else WEAK):
            continue
        parts, size = model["tails"][item]
        windows = [hashes[x:y].tolist() for x, y in sorted(got["windows"])]
        tail = sum(max(longest_common(masks, n, w) for w in windows) for masks, n in parts) / size
        if model["sizes"][item] < MIN_WORDS or share >= STRONG or tail >= WEAK:
            out.append((row, item, got["cosine"], share, tail))
    return out


def _leaks(models: list[dict]):
    def run(batches):
        for batch in batches:
            found = []
            for at, data, offsets in chunks(*text_buffers(batch.column("text"))):
                hashes, _, _, first = words(data, offsets)
                for model in models:
                    found += [(at + r, model["ids"][i], *rest) for r, i, *rest in matches(model, hashes, first)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))], ["doc_id", "item_id", "cosine", "in_order", "answer"])

    return run


def _clean(models: list[dict]):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for at, data, offsets in chunks(*text_buffers(batch.column("text"))):
                hashes, _, _, first = words(data, offsets)
                for model in models:
                    for r, *_ in matches(model, hashes, first):
                        keep[at + r] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame):
    """Items in blocks of BLOCK_PASSAGES at most (or one longer item), read one partition at a time."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text", answer).orderBy("item_id", "text").toLocalIterator():
        more = len(pieces(item_words([r[1] or ""])[0]))
        if block and size + more > BLOCK_PASSAGES:
            yield block
            block, size = [], 0
        block.append(tuple(r))
        size += more
    if block:
        yield block


def _models(docs: DataFrame, benchmark: DataFrame):
    """Lists of models that one pass over the corpus takes."""
    def made(blocks, every):
        if not len(every):
            return
        seen, n = frequencies(docs, every)
        models, held = [], 0
        for block in blocks:
            model = build(docs.sparkSession, block, every, seen, n)
            if model is None:
                continue
            if models and held + model["weighted"].nbytes > MODEL_BYTES:
                yield models
                models, held = [], 0
            models.append(model)
            held += model["weighted"].nbytes
        if models:
            yield models

    blocks, every = [], np.zeros(0, np.uint64)
    for block in _blocks(benchmark):
        own = np.unique(np.concatenate([np.zeros(0, np.uint64), *item_words([t or "" for _, t, _ in block])]))
        if blocks and len(every) + len(own) > VOCABULARY:
            yield from made(blocks, every)
            blocks, every = [], np.zeros(0, np.uint64)
        blocks.append(block)
        every = np.union1d(every, own)
    yield from made(blocks, every)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, cosine, in_order, answer (shares of its words)."""
    spark = docs.sparkSession
    prepare(spark)
    schema = "doc_id long, item_id long, cosine double, in_order double, answer double"
    out = spark.createDataFrame([], schema)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for models in _models(docs, benchmark):
        out = out.union(texts.mapInArrow(_leaks(models), schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    prepare(docs.sparkSession)
    out = docs
    for models in _models(docs, benchmark):
        out = out.mapInArrow(_clean(models), docs.schema)
    return out
