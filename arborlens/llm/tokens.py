"""Token-id files: one zstandard frame a document, under a shared trained dictionary.

Documents are encoded with a tokenizer file (a parameter; it is not stored
here), an end id is appended, and the ids are serialised little-endian in 2 bytes (vocabularies up to
65,536) or 4. A dictionary is trained on the serialised ids of SAMPLE documents
picked by hash (those of up to SAMPLE_BYTES of text: at most 16 MB go to the
driver). Documents are encoded where they lie; their frames are range-partitioned by doc_id, and each partition writes segments:

    magic "IDSEG1" and id width (2 bytes) | SHA-256 of the dictionary (32) | documents (4) |
    index: doc_id, valid, ids, offset, length of each | frames

so that one document is read from one segment, by its index, without the others. Segments
are rows of Parquet files with the smallest and largest doc_id as columns, so a
lookup by id reads the segments whose range holds it. A folder holds them and
the dictionary, and is read without anything kept from its writing (open_tokens).

The pre-tokenizer cuts before every single space that precedes a visible character, and where an ASCII
letter is followed by an ASCII character that is none, so a text is encoded piece by piece through a bounded cache of whole pieces, found by 64-bit
hashes and compared byte by byte; texts with other white space after a space, or with the strings of special ids, are encoded whole.

Defined results: null text is empty and holds the end id alone. Rows come in
ascending doc_id order, null doc_ids first, equal ones by their text's hash.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import LONG, MASKS, blobs, blocks_of, chunks, drop_stored, prepare, run_hashes, stored, text_buffers

SAMPLE = 256
SAMPLE_BYTES = 1 << 16
DICT_BYTES = 1 << 16
SEGMENT_BYTES = 4 << 20
CACHE_PIECES = 1_000_000
MAGIC = b"IDSEG1"
_HEAD = struct.Struct("<6sH32sI")
#: Bytes of ASCII white space, as the pre-tokenizer sees it.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128)
_SEEN = (np.arange(256) > 32) & (np.arange(256) < 127)
INDEX = np.dtype([("doc_id", "<i8"), ("valid", "u1"), ("ids", "<u4"), ("offset", "<u8"), ("length", "<u4")])


SEGMENT_SCHEMA = "part int, number int, before long, ids long, first_id long, last_id long, body binary"
SEGMENT_COLUMNS = ["part", "number", "before", "ids", "first_id", "last_id", "body"]


class Encoder:
    """Texts to serialised ids, with a cache of pieces. Each Python worker has its own."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        state = self.tokenizer.pre_tokenizer.__class__.__name__
        self.by_piece = state == "ByteLevel" and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.names, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.first = np.zeros(0, self.kind), np.zeros(1, np.int64)
        self.body, self.at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        # A few at a time: the library's results take about a thousand bytes each.
        return [np.array(e.ids, self.kind) for i in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte of each piece, whether each row may be cut): a piece starts with a row, at each space and at other sure edges."""
        n = len(data)
        size = np.diff(offsets)
        may = np.full(len(size), self.by_piece)
        begin = np.zeros(n, bool)
        begin[offsets[:-1][size > 0]] = True
        space = np.flatnonzero(data == 32)
        after = np.zeros(n + 3, np.uint8)
        after[:n] = data
        one, two = after[space + 1], after[space + 2]
        odd = _BLANK[one] | ((one == 0xC2) & ((two == 0x85) | (two == 0xA0))) | ((one == 0xE1) & (two == 0x9A)) | ((one == 0xE2) & (two <= 0x81)) | ((one == 0xE3) & (two == 0x80))
        odd |= begin[space] | np.isin(space + 1, offsets)
        may[np.searchsorted(offsets, space[odd], "right") - 1] = False
        body = data.tobytes()
        for token in self.special:
            at = body.find(token)
            while at >= 0:
                may[np.searchsorted(offsets, at, "right") - 1] = False
                at = body.find(token, at + 1)
        begin[space] = True
        # Also sure edges of the pre-tokenizer: an ASCII letter and then no letter; after a single line end between visible ASCII.
        begin[1:] |= _LETTER[data[:-1]] & ~_LETTER[data[1:]] & (data[1:] < 128)
        begin[2:] |= _SEEN[data[:-2]] & (data[1:-1] == 10) & _SEEN[data[2:]]
        return np.flatnonzero(begin), may

    def _pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, ids in each, whether its bytes are those that were encoded)."""
        names = run_hashes(data, start, end)
        values, at, back = np.unique(names, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.names, values)
        place = np.full(len(values), -1)
        known = np.flatnonzero(slot < len(self.names))
        known = known[self.names[slot[known]] == values[known]]
        place[known] = self.place[slot[known]]
        new = np.flatnonzero(place < 0)
        if len(new):
            body = data.tobytes()
            raw = [body[start[i] : end[i]] for i in at[new].tolist()]
            made = self._whole([x.decode() for x in raw])
            place[new] = len(self.first) - 1 + np.arange(len(new))
            self.names, self.place = np.insert(self.names, slot[new], values[new]), np.insert(self.place, slot[new], place[new])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in made])])
            self.flat = np.concatenate([self.flat, *made])
            size = np.array([len(x) for x in raw])
            self.at, self.size = np.concatenate([self.at, len(self.body) + np.cumsum(size) - size]), np.concatenate([self.size, size])
            self.body = np.concatenate([self.body, np.frombuffer(b"".join(raw), np.uint8)])
        place = place[back]
        same = self._equal(data, start, end, place)
        n = self.first[place + 1] - self.first[place]
        take = np.repeat(self.first[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.flat[take], n, same

    def _equal(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each piece has the very bytes of the cached one at its place."""
        same = self.size[place] == end - start
        mine, theirs = blocks_of(data), blocks_of(self.body)
        live = np.flatnonzero(same)
        for k in range(0, LONG, 8):
            left = np.minimum(end[live] - start[live] - k, 8)
            differ = (mine[start[live] + k] ^ theirs[self.at[place[live]] + k]) & MASKS[left]
            same[live[differ != 0]] = False
            live = live[(differ == 0) & (end[live] - start[live] > k + 8)]
        for i in live.tolist():
            at = self.at[place[i]]
            same[i] = np.array_equal(data[start[i] + LONG : end[i]], self.body[at + LONG : at + end[i] - start[i]])
        return same

    def encode(self, column: pa.Array) -> list[bytes]:
        """Serialised ids of each text of a column."""
        out: list[bytes] = []
        for _, data, offsets in chunks(*text_buffers(column)):
            start, may = self._cut(data, offsets)
            row = np.searchsorted(offsets, start, "right") - 1
            end = np.append(start[1:], len(data))
            cut = may[row]
            if len(self.place) > CACHE_PIECES:
                self.forget()
            ids, n, same = self._pieces(data, start[cut], end[cut])
            edge = self.width * np.concatenate([[0], np.cumsum(np.bincount(row[cut], n, len(may)).astype(np.int64))])
            body = ids.tobytes()
            got = [body[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            # Two different pieces of one hash: their rows are encoded whole.
            may[row[cut][~same]] = False
            rest = np.flatnonzero(~may)
            text = data.tobytes()
            for i, x in zip(rest.tolist(), self._whole([text[offsets[i] : offsets[i + 1]].decode() for i in rest])):
                got[i] = x.tobytes()
            out += got
        return out


def train(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; with too few samples to train one, their plain bytes."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES] or bytes(8)


def segment(rows: list[tuple], digest: bytes, width: int) -> bytes:
    """rows: (doc_id or None, ids, frame)."""
    index = np.zeros(len(rows), INDEX)
    at = 0
    for i, (doc_id, n, frame) in enumerate(rows):
        index[i] = (doc_id or 0, doc_id is not None, n, at, len(frame))
        at += len(frame)
    return _HEAD.pack(MAGIC, width, digest, len(rows)) + index.tobytes() + b"".join(r[2] for r in rows)


def opened(body: bytes, dictionary: bytes):
    """(index, a function from an index row to its ids) of a segment; a foreign dictionary is refused."""
    magic, width, digest, n = _HEAD.unpack_from(body)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a segment of this dictionary")
    index = np.frombuffer(body, INDEX, n, _HEAD.size)
    start = _HEAD.size + index.nbytes
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(i: int) -> np.ndarray:
        row = index[i]
        frame = body[start + int(row["offset"]) : start + int(row["offset"]) + int(row["length"])]
        return np.frombuffer(reader.decompress(frame, max_output_size=int(row["ids"]) * width), f"<u{width}")

    return index, ids


def read_document(body: bytes, dictionary: bytes, doc_id: int) -> np.ndarray | None:
    index, ids = opened(body, dictionary)
    at = np.flatnonzero((index["doc_id"] == doc_id) & (index["valid"] == 1))
    return ids(int(at[0])) if len(at) else None


def _sample_ids(path: str):
    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([blobs(encoder.encode(batch.column("text")))], ["ids"])

    return run


def _frames(path: str, end: int, dictionary: bytes):
    """(doc_id, k1, text) -> (doc_id, k1, n, frame): the number of ids with the end id, and their compressed frame."""

    def run(batches):
        encoder = Encoder.of(path)
        stop = np.array([end], encoder.kind).tobytes()
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=3)
        writer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True, write_checksum=False)
        for batch in batches:
            ids = [x + stop for x in encoder.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), pa.array([len(x) // encoder.width for x in ids], pa.int64()), blobs([writer.compress(x) for x in ids])], ["doc_id", "k1", "n", "frame"])

    return run


def _segments(path: str, dictionary: bytes):
    """(doc_id, n, frame) in order -> segments of about SEGMENT_BYTES."""

    def run(batches):
        width, digest = Encoder.of(path).width, hashlib.sha256(dictionary).digest()
        part, rows, held, number, before = TaskContext.get().partitionId(), [], 0, 0, 0

        def flush():
            nonlocal before
            ids, n = [r[0] for r in rows if r[0] is not None], sum(r[1] for r in rows)
            before += n
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before - n], pa.int64()), pa.array([n], pa.int64()), pa.array([min(ids, default=None)], pa.int64()), pa.array([max(ids, default=None)], pa.int64()), blobs([segment(rows, digest, width)])], SEGMENT_COLUMNS)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "frame"))):
                rows.append(row)
                held += len(row[2])
                if held >= SEGMENT_BYTES:
                    yield flush()
                    rows, held, number = [], 0, number + 1
        if rows:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 2, folder: str | None = None) -> tuple[DataFrame, bytes]:
    """Encode docs(doc_id, text, ...) into a folder (a new shared one by default): its segments and its dictionary; returns open_tokens of it."""
    spark = docs.sparkSession
    shared = prepare(spark)
    folder = folder or f"{shared}/token_ids-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    few = rows.where(F.octet_length("text") <= SAMPLE_BYTES).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(SAMPLE)
    dictionary = train([bytes(r[0]) for r in few.mapInArrow(_sample_ids(tokenizer), "ids binary").collect()])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Frames are made where the texts lie, and only they are sorted: a fraction of the texts' bytes.
    frames = stored(rows.select("doc_id", F.xxhash64("text").alias("k1"), "text").mapInArrow(_frames(tokenizer, end, dictionary), "doc_id long, k1 long, n long, frame binary"), "frames")
    ordered = frames.repartitionByRange(n, "doc_id", "k1").sortWithinPartitions("doc_id", "k1").select("doc_id", "n", "frame")
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{folder}/dictionary")
    ordered.mapInArrow(_segments(tokenizer, dictionary), SEGMENT_SCHEMA).write.parquet(f"{folder}/segments")
    drop_stored(frames)
    return open_tokens(spark, folder)


def open_tokens(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes]:
    """The segments (part, number, before: ids before it in its part, ids, first_id, last_id, body) and the dictionary of a written folder."""
    dictionary, sha256 = spark.read.parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(dictionary).hexdigest() != sha256:
        raise ValueError("the dictionary is damaged")
    return spark.read.schema(SEGMENT_SCHEMA).parquet(f"{folder}/segments"), bytes(dictionary)


def find_document(segments: DataFrame, dictionary: bytes, doc_id: int) -> np.ndarray | None:
    """The ids of the first document of this id; only segments whose range of ids holds it are read."""
    near = segments.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("part", "number", "body").orderBy("part", "number")
    for row in near.toLocalIterator():
        if (found := read_document(bytes(row["body"]), dictionary, doc_id)) is not None:
            return found
    return None


def _read(dictionary: bytes):
    def run(batches):
        for batch in batches:
            for base, body in zip(batch.column("base").to_pylist(), batch.column("body").to_pylist()):
                index, ids = opened(body, dictionary)
                n = index["ids"].astype(np.int64)
                crc = [zlib.crc32(ids(i).astype("<u4").tobytes()) for i in range(len(index))]
                yield pa.RecordBatch.from_arrays([pa.array(index["doc_id"], mask=index["valid"] == 0), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(segments: DataFrame, dictionary: bytes) -> DataFrame:
    """Segments -> doc_id, start, n_tokens, ids_crc32, decoded from the files."""
    # One row for each partition of the writing, so fit to be broadcast; places within one were counted while it was written.
    parts = segments.groupBy("part").agg(F.sum("ids").alias("n"))
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    placed = segments.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("before")).alias("base"), "body")
    return placed.mapInArrow(_read(dictionary), "doc_id long, start long, n_tokens long, ids_crc32 long")
