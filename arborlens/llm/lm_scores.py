"""Stupid-backoff language-model scores, computed relationally.

Every word after the one before it (the first after a start mark) is a bigram.
Its score is that of the other documents: with this document's own counts taken
off, count(previous, word) / count(previous) if the bigram occurs elsewhere,
else ALPHA * count(word) / N from the unigram table of the whole corpus. A
document's score is the sum of the logarithms.

Relations are kept as packed blocks: a chunk of rows explodes into one block for each
hash bucket. Bigram blocks are dealt by the hash of the previous word, so the
table of a bucket holds both counts; the bigrams of hot previous words (1 / (4 x
buckets) of all or more: at most 4 x buckets of them, and 4 x HOT_BUCKETS, 16 bytes each) are dealt by the whole bigram and
their counts are broadcast. There is a bucket for each BUCKET_BYTES of text, so what a task
holds does not grow with the corpus; unigrams, of which there are as many as different words, have UNIGRAM_BUCKETS at most. Bigrams not seen elsewhere go on, as requests, to
the unigram table, dealt by the word's hash. Sums return to their chunk and are added per document.

Defined results: a null, empty or blank text has no words and score 0; repeated
rows are documents of their own; case of A-Z is ignored. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import blobs, combine, drop_stored, prepare, stored, text_buffers, words

ALPHA = 0.4
START = np.uint64(0x57A27)
#: Text that a map task explodes into one set of blocks.
GROUP_BYTES = 4 << 20
#: Text that one bucket of bigrams stands for.
BUCKET_BYTES = 2 << 20
UNIGRAM_BUCKETS = 1024
#: Buckets beyond which more of them make no more words hot.
HOT_BUCKETS = 1 << 20
#: Requests for unigrams that a task answers at once.
ASKED = 1 << 20
_LOW40 = np.uint64((1 << 40) - 1)


def _groups(batches):
    """Runs of whole batches of about GROUP_BYTES of text, cut at 60,000 rows."""
    held, size, rows = [], 0, 0
    for batch in batches:
        held.append(batch)
        size, rows = size + batch.nbytes, rows + batch.num_rows
        if size >= GROUP_BYTES or rows >= 50_000:
            table, held, size, rows = pa.Table.from_batches(held).combine_chunks(), [], 0, 0
            yield table
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _words(table):
    """(document, hash) of the words of a table, with each document's number of words."""
    hashes, counts = [], []
    data, offsets = text_buffers(table.column("text"))
    step = 1 << 20
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, min(n, int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1))
        h, _, _, first = words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        hashes.append(h), counts.append(np.diff(first))
        row = end
    h, c = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (counts, np.int64)))
    return np.repeat(np.arange(n), c), h, c


def _pack(*arrays) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], "<u4").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(body: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(body, "<u4", len(kinds))
    at, out = 4 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(body, kind, n, at))
        at += n * width
    return out


def _five(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)


def _eight(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = b.reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _bigrams(table):
    """Distinct (document, previous, word) with its count, and the document's count of previous; words of each document."""
    doc, word, counts = _words(table)
    prev = np.empty_like(word)
    prev[1:] = word[:-1]
    first = np.cumsum(counts) - counts
    prev[first[counts > 0]] = START
    order = np.lexsort((word, prev, doc))
    doc, prev, word = doc[order], prev[order], word[order]
    new_prev = np.ones(len(doc), bool)
    new_prev[1:] = (doc[1:] != doc[:-1]) | (prev[1:] != prev[:-1])
    new = new_prev.copy()
    new[1:] |= word[1:] != word[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(doc)))
    group = np.cumsum(new_prev) - 1
    own = np.bincount(group)[group[at]] if len(at) else at
    return doc[at], prev[at], word[at], tf, own, counts


def _frequent(buckets: int):
    """Words frequent enough in a run of rows that they may be hot, as (word, n)."""

    def run(batches):
        for table in _groups(batches):
            _, h, counts = _words(table)
            values, n = np.unique(h, return_counts=True)
            keep = n >= max(2, len(h) / (8 * buckets))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(values[keep], np.uint64(0)).view(np.int64)), pa.array(np.append(n[keep], len(h))), pa.array(np.append(np.zeros(int(keep.sum()), bool), True))], ["word", "n", "all"])

    return run


def _previous(hot: np.ndarray):
    """Exact counts of hot words as the first of a bigram, and of documents with words."""

    def run(batches):
        for table in _groups(batches):
            _, h, counts = _words(table)
            last = np.cumsum(counts)[counts > 0] - 1
            values, n = np.unique(np.delete(h, last), return_counts=True)
            mine = np.isin(values, hot)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(values[mine], START).view(np.int64)), pa.array(np.append(n[mine], int((counts > 0).sum())))], ["word", "n"])

    return run


def _explode(buckets: int, hot: np.ndarray):
    """Texts -> bigram blocks (bucket, chunk, body), and the list of a chunk's documents under a bucket of its own below 0."""

    def exploded(table, chunk):
        doc, prev, word, tf, own, counts = _bigrams(table)
        key = np.where(np.isin(prev, hot), combine(prev, word), prev)
        bucket = (key >> np.uint64(20)) % np.uint64(buckets)
        order = np.lexsort((word, prev, bucket))
        doc, prev, word, tf, own, bucket = (x[order] for x in (doc, prev, word, tf, own, bucket))
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
        ids = table.column("doc_id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        out = [(-1 - chunk, _pack(ids.fill_null(0).to_numpy().astype("<i8"), null, counts.astype("<i8")))]
        for a, b in zip(at, np.append(at[1:], len(bucket))):
            p = prev[a:b]
            starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            out.append((int(bucket[a]), _pack(p[starts], np.diff(np.append(starts, b - a)).astype("<u4"), _five(word[a:b]), doc[a:b].astype("<u2"), tf[a:b].astype("<u4"), own[a:b].astype("<u4"))))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([chunk] * len(out), pa.int64()), blobs([x[1] for x in out])], ["bucket", "chunk", "body"])

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, table in enumerate(_groups(batches)):
            # The arrays of one group are gone before the next is read.
            yield exploded(table, (part << 24) + number)

    return run


def _unigrams(buckets: int):
    """Texts -> unigram count blocks (bucket, -1, body), by the low 40 bits of the words' hashes."""

    def run(batches):
        for table in _groups(batches):
            _, h, _ = _words(table)
            values, n = np.unique(h & _LOW40, return_counts=True)
            bucket = values % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            rows = [(b, _pack(_five(values[order[cut[b] : cut[b + 1]]]), n[order[cut[b] : cut[b + 1]]].astype("<u4"))) for b in range(buckets) if cut[b] < cut[b + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([-1] * len(rows), pa.int64()), blobs([r[1] for r in rows])], ["bucket", "chunk", "body"])

    return run


def _by_bucket(batches):
    bucket, held = None, []
    for batch in batches:
        for b, c, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if b != bucket:
                if held:
                    yield bucket, held
                bucket, held = b, []
            held.append((c, body))
    if held:
        yield bucket, held


def _sums(kind, chunk, bucket, doc, value) -> tuple:
    """Sums per document of one chunk as a block."""
    if not len(doc):
        return kind, bucket, chunk, _pack(np.zeros(0, "<u2"), np.zeros(0, "<f8"))
    total = np.bincount(doc, value)
    some = np.unique(doc)
    return kind, bucket, chunk, _pack(some.astype("<u2"), total[some].astype("<f8"))


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), len(x)) if len(x) else np.zeros(1, int)


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), blobs([r[3] for r in rows])], ["kind", "bucket", "chunk", "body"])


def _join_bigrams(buckets: int, hot_words: np.ndarray, hot_counts: np.ndarray):
    """Blocks of a bucket -> kind 0: sums per chunk; kind 1: requests for unigrams, by their bucket (of `buckets`). Hot words come sorted."""

    def run(batches):
        for bucket, blocks in _by_bucket(batches):
            if bucket < 0:
                yield _rows([(2, bucket, chunk, body) for chunk, body in blocks])
                continue
            parts = [_unpack(body, "<u8", "<u4", "u1", "<u2", "<u4", "<u4") for _, body in blocks]
            prev = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
            word = np.concatenate([_eight(p[2]) for p in parts])
            tf = np.concatenate([p[4] for p in parts]).astype(np.int64)
            own = np.concatenate([p[5] for p in parts]).astype(np.int64)
            _, at = np.unique(combine(prev, word), return_inverse=True)
            pair = np.bincount(at, tf).astype(np.int64)[at] - tf
            values, at = np.unique(prev, return_inverse=True)
            before = np.bincount(at, tf).astype(np.int64)
            place = np.minimum(np.searchsorted(hot_words, values), max(0, len(hot_words) - 1))
            if len(hot_words):
                is_hot = hot_words[place] == values
                before[is_hot] = hot_counts[place[is_hot]]
            before = before[at] - own
            seen = pair > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                value = tf * np.log(pair / before)
            end = 0
            for (chunk, _), p in zip(blocks, parts):
                a, end = end, end + len(p[3])
                s = seen[a:end]
                yield _rows([_sums(0, chunk, -1, p[3][s].astype(np.int64), value[a:end][s])])
            # One row for each unigram bucket asked, whatever the number of chunks.
            ask = np.flatnonzero(~seen)
            place = np.repeat(np.arange(len(parts)), [len(p[3]) for p in parts])[ask]
            chunk_of = np.array([chunk for chunk, _ in blocks], "<i8")
            w, d, t = word[ask], np.concatenate([p[3] for p in parts])[ask], tf[ask].astype("<u4")
            target = (w % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            cuts = _cuts(target[order])
            out = []
            for i, j in zip(cuts, cuts[1:]):
                o = order[i:j]
                runs = _cuts(place[o])
                out.append((1, int(target[o[0]]), bucket, _pack(chunk_of[place[o[runs[:-1]]]], np.diff(runs).astype("<u4"), _five(w[o]), d[o], t[o])))
            if out:
                yield _rows(out)

    return run


def _join_unigrams(total: int, alpha: float):
    """Count blocks (chunk -1, first) and requests of a bucket -> sums per chunk, of ASKED requests at a time."""

    def answered(values, n, asked):
        chunk, w, d, t = (np.concatenate(x) for x in zip(*asked))
        value = t * np.log(alpha * n[np.searchsorted(values, w)] / total)
        order = np.argsort(chunk, kind="stable")
        cuts = _cuts(chunk[order])
        return _rows([_sums(0, int(chunk[order[i]]), -1, d[order[i:j]].astype(np.int64), value[order[i:j]]) for i, j in zip(cuts, cuts[1:])])

    def run(batches):
        bucket, tables, table, asked, held = None, [], None, [], 0
        for batch in batches:
            for b, c, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if asked and (b != bucket or held >= ASKED):
                    yield answered(*table, asked)
                    asked, held = [], 0
                if b != bucket:
                    bucket, tables, table = b, [], None
                if c < 0:
                    tables.append(_unpack(body, "u1", "<u4"))
                    continue
                if table is None:
                    values, at = np.unique(np.concatenate([_eight(t[0]) for t in tables]), return_inverse=True)
                    table, tables = (values, np.bincount(at, np.concatenate([t[1] for t in tables]))), []
                ids, runs, w, d, t = _unpack(body, "<i8", "<u4", "u1", "<u2", "<u4")
                asked.append((np.repeat(ids, runs), _eight(w), d, t))
                held += len(d)
        if asked:
            yield answered(*table, asked)

    return run


def _add(batches):
    """Blocks of a chunk, its documents last -> a row for each document."""
    chunk, total = None, None
    for batch in batches:
        for kind, c, body in zip(*(batch.column(x).to_pylist() for x in ("kind", "chunk", "body"))):
            if c != chunk:
                chunk, total = c, np.zeros(1 << 16)
            if kind == 0:
                d, v = _unpack(body, "<u2", "<f8")
                total[d] += v
            else:
                ids, null, counts = _unpack(body, "<i8", "u1", "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null == 1), pa.array(counts), pa.array(total[: len(ids)].copy())], ["doc_id", "n_words", "log_score"])


def _dealt(blocks: DataFrame, tasks: int) -> DataFrame:
    """Buckets dealt in turn: as many to each task, which hashing them would not give."""
    return blocks.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int"))


def backoff_scores(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, log_score (natural logarithm, sum over the words), mean_log_score (per word; 0 without words)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts, parts = rows.select("text"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(parts, -(-size // BUCKET_BYTES))
    single, tasks, often = min(parts, UNIGRAM_BUCKETS), max(parts, buckets // 8), min(buckets, HOT_BUCKETS)
    seen = stored(texts.mapInArrow(_frequent(often), "word long, n long, all boolean").groupBy("all", "word").agg(F.sum("n").alias("n")), "frequent")
    total = seen.where("all").agg(F.sum("n")).first()[0] or 0
    # Words of at least 1 / (4 x often) of all: 4 x often of them at most.
    top = seen.where(~F.col("all") & (F.col("n") >= 2) & (F.col("n") * (4 * often) >= F.lit(total))).collect()
    hot = np.array(sorted({r["word"] & ((1 << 64) - 1) for r in top} | {int(START)}), np.uint64)
    counted = {r["word"] & ((1 << 64) - 1): r["n"] for r in texts.mapInArrow(_previous(hot), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    words_, counts = np.array(sorted(counted), np.uint64), np.array([counted[w] for w in sorted(counted)], np.int64)
    block = "bucket long, chunk long, body binary"
    joined = stored(_dealt(rows.mapInArrow(_explode(buckets, hot), block), tasks).sortWithinPartitions("bucket", "chunk").mapInArrow(_join_bigrams(single, words_, counts), f"kind int, {block}"), "bigram_sums")
    drop_stored(seen)
    requests = joined.where("kind = 1").select("bucket", "chunk", "body").union(texts.mapInArrow(_unigrams(single), block))
    backed = _dealt(requests, single).sortWithinPartitions("bucket", "chunk").mapInArrow(_join_unigrams(total, alpha), f"kind int, {block}")
    sums = joined.where("kind <> 1").union(backed)
    out = sums.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_add, "doc_id long, n_words long, log_score double")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0))
