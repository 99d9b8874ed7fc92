"""Exact similarity join inside candidate nodes, shared by the two near-duplicate operators.

A caller supplies candidate nodes (node, item) and 256-byte minwise signatures.
Nodes with equal members are compared once. Inside a node, signatures estimate
all similarities; pairs estimated below LEAST are out, the others are candidates.
Only components are wanted, so each member's best partners are confirmed first, on
the full sets. Where a candidate still crosses two components, the member of the smaller one
is held against all members of the other, in blocks of BLOCK sets. No candidate
that could join two components is left out; the first step costs a group of n copies
about n confirmations, and the second only the members not linked to it.
A node whose sets are of HELD_BYTES together at most does this in one task, which tells a link
for each two components that it joins; so of many components that are nearly similar no pair is ever a row.
In the first step a large node's members are dealt into shares, each member into one, and
dealt anew in every node; only the second, which knows the components, holds all blocks of a large
node that still has several against each other. So the pairs of a group grow with its size, not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .core import combine, drop_stored, mix, prepare, signed, stored

#: Minwise values of a signature; one byte of each is kept for estimates.
WIDTH = 256
#: Four standard deviations of an estimate below the threshold of 0.8.
LEAST = 0.70
#: Members of a node that one task compares; larger ones are compared block by block.
NODE_LIMIT = 4096
PAIR_CHUNK = 256

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(1, 1 << 32, WIDTH, dtype=np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, WIDTH, dtype=np.uint64).astype(np.uint32)


def minwise(values: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The first `width` of WIDTH minwise values (uint32) of each set of 64-bit hashes; an empty set has the largest ones."""
    low = np.full((len(counts), width), 0xFFFFFFFF, np.uint32)
    x = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    group = np.repeat(np.arange(len(counts)), counts)
    for i in range(0, len(x), 1024):
        y = x[i : i + 1024, None] * _A[:width] + _B[:width]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        g = group[i : i + 1024]
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        low[g[at]] = np.minimum(low[g[at]], np.minimum.reduceat(y, at, axis=0))
    return low


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarities of a signature to others, corrected for equal bytes by chance."""
    equal = np.count_nonzero(many == one, axis=1) / WIDTH
    return (equal - 1 / 256) * (256 / 255)


BEST, ACROSS = range(2)
#: Sets of a component that one task compares with.
BLOCK = 256
GOOD = 0.9
#: Bytes of a node's full sets that one task may hold.
HELD_BYTES = 16 << 20
#: Equal hashes of one set and those of a node that are looked at together.
HELD_SHARED = 1 << 20


def node_pairs(sigs: np.ndarray, labels: np.ndarray, mode: int) -> tuple[list, list, bool]:
    """Candidate pairs (places) of a node between different labels, and whether there are more.

    BEST: each member's best so far; one that has a partner of GOOD needs no search of its own. ACROSS: for two labels,
    the best of each member of the smaller one.
    """
    n = len(sigs)
    names, labels = np.unique(labels, return_inverse=True)
    size = np.bincount(labels)
    rank = np.empty(len(names), int)
    rank[np.lexsort((np.arange(len(names)), size))] = np.arange(len(names))
    found, pairs, alone = 0, set(), len(names) == n
    best, partner = np.zeros(n), np.full(n, -1)
    for x in range(n):
        if mode == BEST and best[x] >= GOOD:
            found += n
            continue
        if mode == BEST and alone:
            others = np.arange(x + 1, n)
            est = estimates(sigs[x], sigs[x + 1 :])
        else:
            others = np.flatnonzero(rank[labels] > rank[labels[x]])
            est = estimates(sigs[x], sigs[others])
        near = est >= LEAST
        others, est = others[near], est[near]
        if not len(others):
            continue
        found += len(others)
        if mode == ACROSS:
            order = np.lexsort((-est, labels[others]))
            firsts = order[np.concatenate([[True], np.diff(labels[others][order]) != 0])]
            pairs.update((x, int(y)) for y in others[firsts])
        else:
            top = int(np.argmax(est))
            if est[top] > best[x]:
                best[x], partner[x] = est[top], others[top]
            gain = est > best[others]
            best[others[gain]], partner[others[gain]] = est[gain], x
    if mode == BEST:
        pairs = {(min(x, int(y)), max(x, int(y))) for x, y in enumerate(partner) if y >= 0}
    return [p[0] for p in pairs], [p[1] for p in pairs], found > len(pairs)


def _compare(mode: int):
    """Rows (node, item, sig, label) sorted by node.

    BEST: pairs (a, b), and (node, null) where candidates are left. ACROSS: (a, label) of members with a candidate in another component.
    """

    def run(batches):
        node, items, sigs, labels = None, [], [], []

        def done():
            if len(items) < 2:
                return None
            x, y, more = node_pairs(np.frombuffer(b"".join(sigs), np.uint8).reshape(len(items), WIDTH), np.array(labels, np.int64), mode)
            i = np.array(items, np.int64)
            a, b = i[x], i[y]
            if mode == ACROSS:
                return a.tolist(), np.array(labels, np.int64)[y].tolist()
            return np.minimum(a, b).tolist() + [node] * more, np.maximum(a, b).tolist() + [None] * more

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([v for o in out for v in o[0]], pa.int64()), pa.array([v for o in out for v in o[1]], pa.int64())], ["a", "b"])

        for batch in batches:
            out = []
            for k, i, s, label in zip(*(batch.column(c).to_pylist() for c in ("node", "item", "sig", "label"))):
                if k != node:
                    out.append(done())
                    node, items, sigs, labels = k, [], [], []
                items.append(i), sigs.append(s), labels.append(label)
            yield batch_of([o for o in out if o])
        if last := done():
            yield batch_of([last])

    return run


def branch_keys(node: np.ndarray, values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each node for a member whose signature is values[row]: a node picks one coordinate, or two with a chance of one in four.

    Returns (place in node, child). The picks depend on the node alone, so two members that
    agree on a picked coordinate stay together; 1.25 branches at a similarity of
    0.8 keep the expected number of common children at one a level.
    """
    rows, out = [], []
    for k in range(2):
        pick = combine(node, np.full(len(node), 101 + k, np.uint64))
        has = np.arange(len(node)) if k == 0 else np.flatnonzero((mix(pick) >> np.uint64(62)) == 0)
        at = (pick[has] % np.uint64(WIDTH)).astype(np.int64)
        rows.append(has)
        out.append(combine(combine(node[has], at.astype(np.uint64)), values[row[has], at].astype(np.uint64)))
    return np.concatenate(rows), np.concatenate(out)


def _branch(batches):
    for batch in batches:
        if batch.num_rows:
            node = batch.column("node").to_numpy().view(np.uint64)
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, WIDTH)
            row, child = branch_keys(node, sig, np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(child)), batch.column("item").take(pa.array(row))], ["node", "item"])


def sized(nodes: DataFrame) -> DataFrame:
    """Nodes of two members or more, one of those with equal members: (node, n, item)."""
    about = nodes.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "item")).alias("y")).where("n > 1")
    one = about.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node", "n")
    return nodes.join(one, "node")


def node_shares(level: DataFrame, limit: int) -> DataFrame:
    """level(node, n, item), as sized() gives it -> (node, item, share): members of a node in shares of about half of `limit`, each member in one; a smaller node is one share, of its own name."""
    shares = F.ceil(2 * F.col("n") / limit)
    mine = F.pmod(F.xxhash64("node", "item"), shares)
    return level.select("node", "item", F.when(F.col("n") <= limit, F.col("node")).otherwise(F.xxhash64("node", F.lit(11), mine)).alias("share"))


def node_members(level: DataFrame, sigs: DataFrame, max_levels: int = 0, limit: int = NODE_LIMIT) -> DataFrame:
    """level(node, n, item), as sized() gives it -> (node, item) of the nodes to compare, of about `limit` members at most: larger ones as all pairs of their blocks.

    With max_levels they branch on first, which loses one in six of the pairs at a similarity of 0.8 at each level.
    """
    small = []
    for _ in range(max_levels):
        small.append(level.where(F.col("n") <= limit).select("node", "item"))
        large = level.where(F.col("n") > limit)
        if large.isEmpty():
            break
        children = large.join(sigs, "item").select("node", "item", "sig").mapInArrow(_branch, "node long, item long").distinct()
        level = stored(sized(children), "nodes")
    else:
        # All pairs of blocks, each block pair a node of its own.
        blocks = F.ceil(2 * F.col("n") / limit)
        mine = F.pmod(F.xxhash64("item"), blocks)
        each = level.where(F.col("n") > limit).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        small.append(each.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "item"))
        small.append(level.where(F.col("n") <= limit).select("node", "item"))
    members = small[0]
    for more in small[1:]:
        members = members.union(more)
    return members


def candidates(members: DataFrame, sigs: DataFrame, mode: int) -> DataFrame:
    """members(node, item, label) -> stored distinct rows of _compare."""
    rows = members.join(sigs, "item").select("node", "item", "sig", "label").repartition("node").sortWithinPartitions("node", "item")
    return stored(rows.mapInArrow(_compare(mode), "a long, b long").distinct(), "pairs")


def _confirm(batches):
    """Rows (a, part, role, item, content) sorted by (a, part, role): the hub's set, then those to compare."""
    key = hub = None
    for batch in batches:
        a_out, b_out = [], []
        for a, part, role, item, content in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if role == 0:
                key, hub = (a, part), np.frombuffer(content, np.uint64)
            elif key == (a, part):
                other = np.frombuffer(content, np.uint64)
                shared = len(hub) + len(other) - len(np.union1d(hub, other))
                if 100 * shared >= 80 * (len(hub) + len(other) - shared):
                    a_out.append(a), b_out.append(item)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])


def confirm(pairs: DataFrame, full_sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Those of pairs(a, b) whose full sets have a Jaccard similarity of 0.8 or more.

    full_sets maps a table of items to (item, content: sorted 64-bit hashes). A
    hub's set is sent once for each PAIR_CHUNK of its pairs, so a hub of many
    pairs is split over tasks.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PAIR_CHUNK)).alias("part"))
    sets = stored(full_sets(pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct()), "sets")
    hubs = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("item", "a"), "a").select("a", "part", F.lit(0).alias("role"), F.col("a").alias("item"), "content")
    rest = dealt.join(sets.withColumnRenamed("item", "b"), "b").select("a", "part", F.lit(1).alias("role"), F.col("b").alias("item"), "content")
    return hubs.union(rest).repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(_confirm, "a long, b long")


def _hold(batches):
    """Rows (label, block, role, item, content) sorted: a block's sets, then the sets held against it -> a link for each that has one."""
    key, sets, names, built = None, [], [], None
    for batch in batches:
        a_out, b_out = [], []
        for label, block, role, item, content in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (label, block) != key:
                key, sets, names, built = (label, block), [], [], None
            if role == 0:
                sets.append(np.frombuffer(content, np.uint64)), names.append(item)
                continue
            if not sets:
                continue
            if built is None:
                sizes = np.array([len(x) for x in sets])
                flat = np.concatenate(sets)
                order = np.argsort(flat)
                built = flat[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes
            values, owner, sizes = built
            own = np.frombuffer(content, np.uint64)
            low, high = np.searchsorted(values, own), np.searchsorted(values, own, "right")
            n = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            shared = np.bincount(owner[at], minlength=len(sizes))
            hit = np.flatnonzero(100 * shared >= 80 * (sizes + len(own) - shared))
            if len(hit):
                a_out.append(item), b_out.append(names[hit[0]])
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])


def held_against(queries: DataFrame, members: DataFrame, full_sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) of queries(a, label), each held against all members(item, label) of that label, in blocks."""
    sizes = members.join(queries.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sizes = stored(sizes, "sizes")
    sets = stored(full_sets(members.join(sizes, "label").select("item").union(queries.select("a")).distinct()), "sets")
    one = members.join(sizes, "label").select("label", F.pmod(F.xxhash64("item"), "blocks").alias("block"), F.lit(0).alias("role"), "item").join(sets, "item").select("label", "block", "role", "item", "content")
    two = queries.join(sizes, "label").select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), F.col("a").alias("item")).join(sets, "item").select("label", "block", "role", "item", "content")
    return one.union(two).repartition("label", "block").sortWithinPartitions("label", "block", "role", "item").mapInArrow(_hold, "a long, b long")


def joined_labels(sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Links (places) between sets of a similarity of 0.8 or more that join different labels, one for each join: all that any pair of these sets can join."""
    names, labels = np.unique(labels, return_inverse=True)
    size = np.bincount(labels)
    rank = np.empty(len(names), int)
    rank[np.lexsort((np.arange(len(names)), size))] = np.arange(len(names))
    rank, root, links = rank[labels], np.arange(len(names)), []
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    values, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
    for x in np.argsort(rank, kind="stable").tolist():
        # Each pair of labels is looked at from the members of the smaller one.
        open_ = (rank > rank[x]) & (root[labels] != root[labels[x]])
        if not open_.any():
            continue
        own, shared = sets[x], np.zeros(len(sets), np.int64)
        low = np.searchsorted(values, own)
        n = np.searchsorted(values, own, "right") - low
        step = np.cumsum(n) // HELD_SHARED
        for k in np.unique(step).tolist():
            at, m = low[step == k], n[step == k]
            at = np.repeat(at - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum()))
            shared += np.bincount(owner[at], minlength=len(sets))
        for y in np.flatnonzero(open_ & (100 * shared >= 80 * (sizes + len(own) - shared))).tolist():
            mine, other = root[labels[x]], root[labels[y]]
            if mine != other:
                root[root == other] = mine
                links.append((x, y))
    return links


def _join(batches):
    """Rows (node, item, label, content) sorted by node -> links (a, b) of items."""
    node, items, labels, sets = None, [], [], []

    def done():
        found = joined_labels(sets, np.array(labels, np.int64)) if len(set(labels)) > 1 else []
        return [items[x] for x, _ in found], [items[y] for _, y in found]

    for batch in batches:
        a_out, b_out = [], []
        for k, i, label, content in zip(*(batch.column(c).to_pylist() for c in ("node", "item", "label", "content"))):
            if k != node:
                a, b = done()
                a_out += a
                b_out += b
                node, items, labels, sets = k, [], [], []
            items.append(i), labels.append(label), sets.append(np.frombuffer(content, np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])
    a, b = done()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def joined(left: DataFrame, full_sets: Callable[[DataFrame], DataFrame], limit: int = HELD_BYTES) -> tuple[DataFrame, DataFrame]:
    """left(node, item, label) of nodes with several labels -> their links (a, b), and the rows of nodes whose sets are beyond `limit` bytes, which are not looked at."""
    sets = stored(full_sets(left.select("item").distinct()), "sets")
    sizes = left.join(sets.select("item", F.octet_length("content").alias("bytes")), "item").groupBy("node").agg(F.sum("bytes").alias("bytes"))
    sizes = stored(sizes, "sizes")
    rows = left.join(sizes.where(F.col("bytes") <= limit), "node").join(sets, "item").select("node", "item", "label", "content")
    links = stored(rows.repartition("node").sortWithinPartitions("node", "item").mapInArrow(_join, "a long, b long"), "links")
    beyond = stored(left.join(sizes.where(F.col("bytes") > limit).select("node"), "node", "left_semi"), "left")
    drop_stored(sets, sizes)
    return links, beyond


def clusters(nodes: DataFrame, sigs: DataFrame, full_sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of items linked, directly or through others, by confirmed similarities."""
    prepare(nodes.sparkSession)
    level = stored(sized(nodes), "nodes")
    shares = node_shares(level, NODE_LIMIT)
    rows = candidates(shares.select(F.col("share").alias("node"), "item", F.col("item").alias("label")), sigs, BEST)
    links = stored(confirm(rows.where("b is not null"), full_sets), "links")
    roots = stored(components(links), "roots")
    named = roots.select(F.col("node").alias("item"), F.col("root").alias("label"))
    # Small nodes with candidates left, and the large ones, whose shares have not met, where their members are of several components.
    more = level.join(rows.where("b is null").select(F.col("a").alias("node")), "node", "left_semi").where(F.col("n") <= NODE_LIMIT).unionByName(level.where(F.col("n") > NODE_LIMIT))
    if more.isEmpty():
        drop_stored(level, rows, links)
        return roots
    label = F.coalesce("label", "item")
    open_ = stored(more.join(named, "item", "left").groupBy("node").agg(F.min(label).alias("x"), F.max(label).alias("y")).where("x <> y").select("node"), "open")
    left = node_members(level.join(open_, "node", "left_semi"), sigs).join(named, "item", "left").select("node", "item", label.alias("label"))
    left = stored(left, "left")
    drop_stored(level, rows, open_)
    mixed = left.groupBy("node").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("node")
    found, beyond = joined(left.join(mixed, "node").select("node", "item", "label"), full_sets)
    if beyond.isEmpty():
        whole = stored(components(links.union(found)), "roots")
        drop_stored(left, links, found, beyond, roots)
        return whole
    across = candidates(beyond, sigs, ACROSS)
    queries = across.where("b is not null").select("a", F.col("b").alias("label"))
    everyone = named.union(left.select("item", "label")).distinct()
    held = stored(held_against(queries, everyone, full_sets), "links")
    whole = stored(components(links.union(found).union(held)), "roots")
    drop_stored(left, links, found, beyond, across, held, roots)
    return whole
