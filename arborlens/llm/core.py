"""Shared pieces: session settings, shared-folder tables, vectorised word hashing.

Text rules used by every operator here: a word is a run of bytes other than
0x20 and 0x09-0x0D; a null text counts as an empty one.
"""

from __future__ import annotations

import gc
import hashlib
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_RE = r"[^\x20\x09-\x0D]+"
#: Rows of text in an Arrow batch: bounds a Python worker's memory with long texts.
BATCH_ROWS = 1000
#: And bytes: packed blocks are large rows, of which a batch of BATCH_ROWS would be held by Spark and Python at once.
BATCH_BYTES = "4m"
#: Tasks that the rows of one hot key are dealt over in a join.
SALTS = 16
#: Bytes of text that the vectorised routines take at once.
CHUNK_BYTES = 1 << 20


def prepare(spark: SparkSession) -> str:
    """Set the Arrow batch sizes and return the folder that all executors share.

    The folder is spark.checkpoint.dir; where that is unset, a folder under /tmp
    on one machine (a local master), and an error on a cluster.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        got = sc._jsc.sc().getCheckpointDir()
        if not got.isDefined() and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = got.get() if got.isDefined() else f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{prepare(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let shuffle files go: Spark's cleaner removes them once the driver has collected the plans they belong to, so a collection is asked for; else they would stay until the driver's memory is short."""
    # What a just finished query leaves is reachable during the first collection and goes with the second.
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables made by stored() that nothing reads any more, and release what their making shuffled."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(tables[0].sparkSession)


def hot_keys(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of counts(keys..., copies), the keys of 1 / (8 x partitions) of all rows or more: 8 x partitions of them at most, fit to be broadcast."""
    least = 8 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("copies")).first()[0] or 0
    return counts.where((F.col("copies") > SALTS) & (F.col("copies") * least >= total)).select(*keys)


def join_copies(rows: DataFrame, about: DataFrame, keys: list[str], spread: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with about, which has one row for each value of keys; rows of hot keys (a bounded table) are dealt over SALTS tasks by `spread`."""
    is_hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    one = rows.join(is_hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0)).drop("_hot")
    two = about.join(is_hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("_hot")
    return one.withColumn("_salt", F.col("_salt").cast("long")).join(two, [*keys, "_salt"], how).drop("_salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# -- vectorised text ---------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a run that are hashed block by block; what is longer goes through a library hash.
LONG = 64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered combination of two hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA0761D6478BD642F)))


def blocks_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as a number; zeros follow the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run [start, end) of bytes: its length, then block after block of eight bytes, scrambled in between."""
    size, eight = end - start, blocks_of(data)
    out = mix(size.astype(np.uint64) + np.uint64(0x1D))
    live = np.flatnonzero(size > 0)
    for k in range(0, LONG, 8):
        if not len(live):
            return out
        block = eight[start[live] + k] & MASKS[np.minimum(size[live] - k, 8)]
        out[live] = combine(out[live], block)
        live = live[size[live] > k + 8]
    body = memoryview(np.ascontiguousarray(data))
    rest = b"".join(hashlib.blake2b(body[a + LONG : b], digest_size=8).digest() for a, b in zip(start[live].tolist(), end[live].tolist()))
    out[live] = combine(out[live], np.frombuffer(rest, "<u8"))
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of length n + 1) of an Arrow string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray):
    """Cut a column into runs of rows of about CHUNK_BYTES: yields (first row, bytes, offsets)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """(hash, start, end, first word of each row) of all words of a chunk; no word crosses rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.ones(n + 1, bool)
    edge[1:n] = _SPACE[data[:-1]]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    ink = ~_SPACE[data]
    start = np.flatnonzero(ink & edge[:n])
    last = np.ones(n, bool)
    last[:-1] = ~ink[1:]
    last[(offsets[1:] - 1)[offsets[1:] > 0]] = True
    end = np.flatnonzero(ink & last) + 1
    return run_hashes(_LOWER[data] if lower else data, start, end), start, end, np.searchsorted(start, offsets)


def shingled(hashes: np.ndarray, first: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of groups of words [first, end): (values, sorted within each group; their number in each).

    A group of fewer words than a shingle has them all as its one shingle; one without words has none.
    """
    length = end - first
    counts = np.maximum(length - size + 1, 0)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
    group = np.repeat(np.arange(len(first)), counts)
    values = hashes[at]
    for k in range(1, size):
        values = combine(values, hashes[at + k])
    for n in range(1, size):
        short = np.flatnonzero(length == n)
        if len(short):
            v = hashes[first[short]]
            for k in range(1, n):
                v = combine(v, hashes[first[short] + k])
            values, group = np.concatenate([values, combine(v, np.full(len(v), n, np.uint64))]), np.concatenate([group, short])
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    return values[keep], np.bincount(group[keep], minlength=len(first))


def set_names(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; two of n different sets share one by chance with probability n**2 / 2**65."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(0x51)), dtype=np.uint64)])
    end = np.cumsum(counts)
    return signed(combine(total[end] - total[end - counts], counts.astype(np.uint64)))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: np.ndarray, counts) -> pa.Array:
    """An Arrow list column from flat values and the length of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def exact_key(*columns) -> list:
    """Two 64-bit hashes of a row's values; together they name the value."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols, F.lit(1))]
