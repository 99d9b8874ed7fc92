"""Exact repeated-substring removal on Burrows-Wheeler transforms.

Which bytes stand in a string of `length` bytes that also starts elsewhere?
Each window of that length is owned by its smallest ANCHOR-byte hash, and the
windows that one anchor owns are a contiguous stretch of text. Equal windows have
equal anchors, so stretches are dealt by the anchor's hash and compared only with
stretches of the same anchor. Stretches equal as a whole are one member with a
count. The others go, concatenated, into a Burrows-Wheeler transform; a
breadth-first backward extension derives all common-prefix lengths by increasing
value and stops at `length`: neighbours whose value is not reached share the window.

A stretch whose anchor is common (HOT members or more) is split further: its
windows fall into classes by the power of two of their bytes right of the anchor,
and the bytes that all windows of a class hold are part of the key. Members of one
key beyond GROUP_BYTES (a passage that a share of all texts holds, each time beside other
text) are not held in a task: their windows are hashed one by one and counted with DataFrame
operations. Stretches are named by hashes of 64 bits of the anchor and of 64
bits of the bytes in order.

Defined results: null is empty; texts shorter than `length` keep all; equal
texts (repeated rows) are removed as a whole if long enough; overlaps of a
string with itself count. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import SALTS, blobs, chunks, combine, drop_stored, exact_key, hot_keys, join_copies, mix, prepare, signed, stored, text_buffers

LENGTH = 200
ANCHOR = 32
HOT = 512
BLOCK_BYTES = 1 << 20
#: Bytes of the members of one key that a task compares; beyond, their windows are counted one by one by the engine.
GROUP_BYTES = 8 << 20
#: Symbols that a level of the backward extension adds at most.
STEP = 8
#: Windows of a long text that are looked at together.
SLICE = 1 << 20


def doubled(h: np.ndarray, width: int, to: int) -> np.ndarray:
    """Ordered hashes of runs of `width` units -> those of runs of `to` (both powers of two), by doubling."""
    while width < to:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    return h


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` bytes (a power of two), by doubling; not scrambled at the end."""
    return doubled(mix(data.astype(np.uint64) + np.uint64(1)), 1, width)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    k, m = 1, x
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    rest = width - k
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def stretches(data: np.ndarray, length: int):
    """(first window, number of bytes, anchor's place, anchor's hash, the bytes' hash) of all stretches of one text.

    The bytes' hash takes them in order: it combines those of four runs that cover the stretch (shorter than twice `length`),
    each of the largest power of two not above `length`. With the anchor's hash and place and the size, it names the stretch. A window's anchor is the leftmost of its smallest 40-bit hashes, so equal windows have equal anchors at equal places.
    """
    out, run = [], 1 << length.bit_length() - 1
    for at in range(0, max(0, len(data) - length + 1), SLICE):
        own = data[at : at + SLICE + length - 1]
        raw = rolling(own, ANCHOR)
        h, wide = mix(raw), doubled(raw, ANCHOR, run)
        place = (sliding_min(h & ~np.uint64(0xFFFFFF) | np.arange(len(h), dtype=np.uint64), length - ANCHOR + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        size = np.append(first[1:], len(place)) - first + length - 1
        name = mix(wide[first])
        for k in range(1, 4):
            name = combine(name, wide[first + k * (size - run) // 3])
        out.append((first + at, size, place[first] + at, h[place[first]], name))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes (symbols 0 to 256) in the order of their first `depth` symbols at least, by doubling; what stands alone is not sorted again."""
    n, k = len(text), 7
    first = np.zeros(n, np.int64)
    for i in range(k):
        first <<= 9
        first[: n - i] |= text[i:]
    order = np.argsort(first)
    edge = np.ones(n, bool)
    edge[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int64)
    while k < depth:
        alone = edge.copy()
        alone[:-1] &= edge[1:]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        rank[order] = np.cumsum(edge)
        mine = order[at]
        after = mine + k
        key = rank[mine] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        by = np.argsort(key)
        order[at], key = mine[by], key[by]
        edge[at[1:]] |= key[1:] != key[:-1]
        k *= 2
    return order


def bounded_lcp(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True where a row of the sorted rotations shares `length` symbols or more with the row before.

    Breadth-first backward extension on the transform, with runs of `step` symbols as its alphabet (the largest divisor of
    length up to STEP), so a level adds that many: the rows of w, split by the symbol before, are the rows of cw for
    every symbol c; a border between two strings of length l becomes a border between strings of l + step at the next
    row that has the same symbol. The step from a row of cw to its row of w is read from the inverse order, which equals a stable sort of
    the transform. Levels are taken all at once, shortest common prefixes first; the search stops when none is new or at `length`.
    """
    n = len(order)
    step = max(k for k in range(1, STEP + 1) if length % k == 0)
    inverse = np.empty(n, np.int32)
    inverse[order] = np.arange(n, dtype=np.int32)
    psi = inverse[(order + step) % n]
    symbol = np.ones(n, bool)
    differ = np.zeros(n - 1, bool)
    for i in range(step):
        own = text[(order + i) % n]
        differ |= own[1:] != own[:-1]
    symbol[1:] = differ
    border, passed = symbol.copy(), np.empty(n, np.int32)
    before = int(np.count_nonzero(border))
    for _ in range(length // step - 1):
        np.cumsum(border, dtype=np.int32, out=passed)
        seen = passed.take(psi)
        border[1:] = seen[1:] != seen[:-1]
        border |= symbol
        if (now := int(np.count_nonzero(border))) == before:
            break
        before = now
    return ~border


def repeated_windows(members: list[bytes], length: int) -> list[np.ndarray]:
    """For each member, whether each of its windows also starts elsewhere among the members."""
    sizes = np.array([len(m) for m in members])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.frombuffer(b"\0".join(members) + b"\0", np.uint8).astype(np.int16) + 1
    text[begin[1:] - 1] = 0
    order = suffix_array(text, length)
    same = bounded_lcp(text, order, length)
    twice = np.zeros(len(text), bool)
    twice[order[same]] = True
    twice[order[np.flatnonzero(same) - 1]] = True
    return [twice[b : b + max(0, s - length + 1)] for b, s in zip(begin.tolist(), sizes.tolist())]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows at these sorted places."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), (starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length).tolist()))


def _stretch(length: int):
    def run(batches):
        for batch in batches:
            for at, data, offsets in chunks(*text_buffers(batch.column("text"))):
                rows, parts = [], []
                for i in range(len(offsets) - 1):
                    first, size, place, h, name = stretches(data[offsets[i] : offsets[i + 1]], length)
                    if len(first):
                        rows.append(np.full(len(first), at + i)), parts.append((first, size, place - first, h, name))
                if rows:
                    take = pa.array(np.concatenate(rows))
                    first, size, place, h, name = (np.concatenate(x) for x in zip(*parts))
                    yield pa.RecordBatch.from_arrays([batch.column("k1").take(take), batch.column("k2").take(take), pa.array(signed(h)), pa.array(signed(name)), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))], ["k1", "k2", "h", "c", "lo", "n", "place"])

    return run


def _fetch(length: int, hot: int):
    """(text, wanted) -> the bytes of wanted stretches; those of common anchors by class."""

    def run(batches):
        for batch in batches:
            keys, h_out, c_out, off, body, full = [], [], [], [], [], []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = (text or "").encode()
                for w in wanted:
                    part = raw[w["lo"] : w["lo"] + w["n"]]
                    if w["members"] < hot:
                        keys.append(w["h"]), h_out.append(w["h"]), c_out.append(w["c"]), off.append(0), body.append(part), full.append(w["w"] > 1)
                        continue
                    for key, a, b in classes(part, w["h"], w["place"], length):
                        keys.append(key), h_out.append(w["h"]), c_out.append(w["c"]), off.append(a), body.append(part[a:b]), full.append(w["w"] > 1)
                if len(body) > 20000:
                    yield _members(keys, h_out, c_out, off, body, full)
                    keys, h_out, c_out, off, body, full = [], [], [], [], [], []
            yield _members(keys, h_out, c_out, off, body, full)

    return run


def _members(keys, h, c, off, body, full):
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(off, pa.int32()), blobs(body), pa.array(full, pa.bool_())], ["key", "h", "c", "off", "body", "full"])


def classes(part: bytes, h: int, place: int, length: int):
    """(key, from, to) of the pieces of a stretch, by how many bytes its windows hold right of the anchor."""
    right = lambda o: o + length - place - ANCHOR
    last = len(part) - length
    low, high = 0, 0
    while low <= length - ANCHOR:
        a, b = max(0, low - right(0)), min(last, high - right(0))
        if a <= b:
            held = part[max(0, place - (length - ANCHOR - min(high, length - ANCHOR))) : place + ANCHOR + low]
            key = int.from_bytes(hashlib.blake2b(held + b"%d %d" % (low, h), digest_size=8).digest(), "little", signed=True)
            yield key, a, b + length
        low, high = high + 1, 2 * high + 1


def _holders(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """One row (text, wanted) for each text that wanted(k1, k2, ...) names."""
    lists_ = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "n", "place", "w", "lo", "members")).alias("wanted"))
    holders = texts.where(F.octet_length("text") >= length).select("k1", "k2", "text").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    return holders.join(lists_, ["k1", "k2"]).select("text", "wanted")


def window_names(part: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each window of `length` bytes, from two runs of a power of two that cover it."""
    run = 1 << length.bit_length() - 1
    wide = doubled(mix(part.astype(np.uint64) + np.uint64(seed)), 1, run)
    last = len(part) - length + 1
    return signed(combine(wide[:last], wide[length - run : length - run + last]))


BLOCK_SCHEMA = "h long, c long, lo int, hi int, x long, y long, full boolean"


def _block(length: int, limit: int):
    """Members sorted by key -> (h, c, lo, hi) of those that are not full: byte runs that recur.

    A key with more than `limit` bytes of members is not held: each of its windows goes out as a row with two hashes (x, y) instead.
    """

    def rows(h, c, lo, hi, x=None, y=None, full=None):
        n = len(h)
        more = [pa.array(x), pa.array(y), pa.array(full)] if x is not None else [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), *more], ["h", "c", "lo", "hi", "x", "y", "full"])

    def solve(groups):
        flat = [m for g in groups for m in g]
        found = repeated_windows([m[2] for m in flat], length)
        h, c, lo, hi = [], [], [], []
        for (h0, c0, _, off, full), twice in zip(flat, found):
            if not full:
                for a, b in runs(np.flatnonzero(twice), length):
                    h.append(h0), c.append(c0), lo.append(off + a), hi.append(off + b)
        return rows(h, c, lo, hi)

    def windows(members):
        cols = []
        for h0, c0, body, off, full in members:
            part = np.frombuffer(body, np.uint8)
            n = len(part) - length + 1
            lo = np.arange(off, off + n, dtype=np.int32)
            cols.append((np.full(n, h0), np.full(n, c0), lo, lo + length, window_names(part, length, 1), window_names(part, length, 0x5EED), np.full(n, full)))
        return rows(*(np.concatenate(x) for x in zip(*cols)))

    def run(batches):
        groups, group, held, own, key = [], [], 0, 0, None
        for batch in batches:
            for k, h, c, body, off, full in zip(*(batch.column(i).to_pylist() for i in ("key", "h", "c", "body", "off", "full"))):
                if k != key:
                    if own <= limit and len(group) > 1 and not all(m[4] for m in group):
                        groups.append(group)
                        held += own
                    elif own > limit and group:
                        yield windows(group)
                    if held > BLOCK_BYTES:
                        yield solve(groups)
                        groups, held = [], 0
                    group, own, key = [], 0, k
                group.append((h, c, body, off, full))
                own += len(body)
                # A group beyond the limit leaves as windows, some members at a time.
                if own > limit and len(group) >= 256:
                    for i in range(0, len(group), 256):
                        yield windows(group[i : i + 256])
                    group = []
        if own <= limit and len(group) > 1 and not all(m[4] for m in group):
            groups.append(group)
        elif own > limit and group:
            yield windows(group)
        if groups:
            yield solve(groups)

    return run


def _counted(each: DataFrame) -> DataFrame:
    """Window rows of _block -> (h, c, lo, hi) of those that occur twice or more and are not full.

    Counts are added up before the shuffle, and the rows of one window are dealt over SALTS tasks, so a passage that a share of all texts holds is no task's alone.
    """
    again = each.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    found = each.where("not full").withColumn("salt", F.pmod(F.xxhash64("h", "c"), F.lit(SALTS))).join(again, ["x", "y", "salt"]).select("h", "c", "lo", "hi").distinct()
    island = F.col("lo") - F.row_number().over(Window.partitionBy("h", "c").orderBy("lo"))
    return found.withColumn("island", island).groupBy("h", "c", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("h", "c", "lo", "hi")


def _strip(batches):
    for batch in batches:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, merged = (text or "").encode(), []
            for s in sorted((x["lo"], x["hi"]) for x in spans or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            at, kept = 0, []
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            rest = b"".join([*kept, raw[at:]])
            out["n_bytes"].append(len(raw)), out["n_removed"].append(len(raw) - len(rest)), out["n_spans"].append(len(merged))
            out["spans"].append([{"lo": a, "hi": b} for a, b in merged]), out["kept"].append(rest), out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["spans"], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), blobs(out["kept"]), pa.array(out["kept_sha256"], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, limit: int = GROUP_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per row: doc_id, n_bytes, n_removed, n_spans, spans, kept (binary), kept_sha256."""
    prepare(docs.sparkSession)
    k1, k2 = exact_key("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k1", k1).withColumn("k2", k2)
    found = texts.where(F.octet_length("text") >= length).select("text", "k1", "k2").mapInArrow(_stretch(length), "k1 long, k2 long, h long, c long, lo int, n int, place int")
    # Copies of a whole text fall together here, before anything is compared.
    each = stored(found.groupBy("k1", "k2", "h", "c", "lo", "n", "place").agg(F.least(F.count("*"), F.lit(2)).alias("m")), "stretches")
    # An anchor that a share of all stretches has (a run of one character) is dealt over tasks.
    common = stored(each.groupBy("h").agg(F.sum("m").alias("total"), F.count("*").alias("copies")).where("total > 1"), "common")
    hot_anchors = stored(hot_keys(common, ["h"]), "hot")
    places = stored(join_copies(each, common.select("h"), ["h"], "c", hot_anchors), "places")
    drop_stored(each)
    members = stored(places.groupBy("h", "c", "n", "place").agg(F.least(F.sum("m"), F.lit(2)).alias("w"), F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "lo")).alias("at")), "members")
    # Only anchors with members of their own need comparing; equal stretches are known to recur.
    open_ = members.groupBy("h").agg(F.count("*").alias("members"), F.min("w").alias("least")).where("members > 1 and least = 1").select("h", "members")
    wanted = join_copies(members, open_, ["h"], "c", hot_anchors).select("h", "c", "n", "place", "w", "members", "at.k1", "at.k2", "at.lo")
    bodies = _holders(texts, wanted, length).mapInArrow(_fetch(length, hot), "key long, h long, c long, off int, body binary, full boolean")
    shared = stored(bodies.repartition("key").sortWithinPartitions("key", "h", "c").mapInArrow(_block(length, limit), BLOCK_SCHEMA), "shared")
    hits = members.where("w > 1").select("h", "c", F.lit(0).alias("lo"), F.col("n").alias("hi")).union(shared.where("x is null").select("h", "c", "lo", "hi"))
    if not shared.where("x is not null").isEmpty():
        hits = hits.union(_counted(shared.where("x is not null")))
    hits = hits.groupBy("h", "c").agg(F.collect_set(F.struct("lo", "hi")).alias("hits"))
    # A stretch that stands in very many places (copies of a passage, a run of one character) is dealt over tasks.
    hot_members = stored(hot_keys(members.groupBy("h", "c").agg(F.sum("copies").alias("copies")), ["h", "c"]), "hot")
    spans = join_copies(places.select("h", "c", "k1", "k2", F.col("lo").alias("base")), hits, ["h", "c"], "base", hot_members).select("k1", "k2", "base", F.explode("hits").alias("hit"))
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct((F.col("base") + F.col("hit.lo")).alias("lo"), (F.col("base") + F.col("hit.hi")).alias("hi"))).alias("spans"))
    # Only texts that may hold something are joined; copies of one text are dealt over tasks.
    long_ = F.octet_length("text") >= length
    hot_texts = hot_keys(stored(texts.where(long_).groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1"), "copies"), ["k1", "k2"])
    joined = join_copies(texts.where(long_), spans, ["k1", "k2"], "doc_id", hot_texts, "left").select("doc_id", "text", "spans")
    joined = joined.union(texts.where(~long_).select("doc_id", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans")))
    return joined.mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:int,hi:int>>, kept binary, kept_sha256 string")
