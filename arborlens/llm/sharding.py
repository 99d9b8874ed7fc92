"""Sharding in Hilbert-curve order, with DataFrame functions only.

Metadata dimensions (source, lang, size in bytes) are quantised at approximate
quantiles, the cells get their index on a Hilbert curve of DIMS dimensions, rows
are sorted by that index and cut into runs, so a shard holds a compact
region of all dimensions and files can be pruned by any of them. Law `rows`: counts differ by
one at most. Equal texts stand next to each other (a group's cell comes from its
smallest values), so a group is cut only where a run ends.

Order within a run is total up to wholly equal rows: index, text checksum and hash, doc_id.
The sort is a range exchange with doc_id in its key, so a hot cell or group is
spread over tasks; positions come from the exchange's own row counts.

Defined results: null text has size 8 and checksum 0; null dimensions sort
first; repeated rows take a slot each; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import exact_key, hot_keys, join_copies, prepare, stored

SHARDS = 24
DIMS = 3
BITS = 5
#: Bytes counted for a row besides its text.
ROW_BYTES = 8


def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """The Hilbert curve as a state machine: (digit, next state) at [state * 2**dims + corner].

    A state is a pair (entry corner e, direction d), numbered e * dims + d. A
    corner is flipped by e and rotated by d + 1; its rank in Gray-code order is the digit.
    """
    n, size = dims, 1 << dims
    mask = size - 1
    left = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & mask
    gray = lambda i: i ^ (i >> 1)
    rank = {gray(i): i for i in range(size)}
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    ones = lambda i: (~i & (i + 1)).bit_length() - 1
    direction = lambda i: 0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % n
    digits, states = [], []
    for e in range(size):
        for d in range(n):
            for corner in range(size):
                w = rank[left(corner ^ e, n - (d + 1) % n)]
                digits.append(w)
                states.append((e ^ left(entry(w), d + 1)) * n + (d + direction(w) + 1) % n)
    return digits, states


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The index on the curve of a cell given by integer coordinates below 2**bits."""
    n = len(cells)
    digits, states = (F.array(*[F.lit(x).cast("long") for x in t]) for t in curve_table(n))

    def step(acc, level):
        corner = F.lit(0).cast("long")
        for i, c in enumerate(cells):
            corner = corner.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", c.cast("long"), level).bitwiseAND(F.lit(1).cast("long")), F.lit(i)))
        at = (acc["state"] * (1 << n) + corner + 1).cast("int")
        return F.struct(F.element_at(states, at).alias("state"), (acc["index"] * (1 << n) + F.element_at(digits, at)).alias("index"))

    levels = F.array(*[F.lit(b) for b in reversed(range(bits))])
    return F.aggregate(levels, F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("index")), step)["index"]


def _ordinal(column: Column) -> Column:
    """A number for a string: its first six bytes in order, then 14 bits of the whole's hash, so strings of one beginning still differ."""
    head = F.conv(F.rpad(F.substring(F.hex(column), 1, 12), 12, "0"), 16, 10).cast("long")
    return F.coalesce(head * (1 << 14) + F.xxhash64(column).bitwiseAND(F.lit((1 << 14) - 1)), F.lit(-1).cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """docs(doc_id, text, source, lang, ...) -> doc_id, size, text_crc32, curve_index, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    prepare(spark)
    k1, k2 = exact_key("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), k1.alias("k1"), k2.alias("k2"), _ordinal(F.col("source")).alias("d0"), _ordinal(F.col("lang")).alias("d1"))
    rows = stored(rows, "rows")
    groups = stored(rows.groupBy("k1", "k2").agg(F.min("d0").alias("d0"), F.min("d1").alias("d1"), F.first("size").alias("d2"), F.count("*").alias("copies")), "groups")
    hot = stored(hot_keys(groups, ["k1", "k2"]), "hot")
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    edges = groups.agg(*[F.percentile_approx(f"d{i}", cuts, 2000).alias(f"d{i}") for i in range(DIMS)]).first()
    cell = lambda i: F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in sorted(set(edges[i]))]), lambda e: e < F.col(f"d{i}"))) if edges[i] else F.lit(0)
    groups = groups.withColumns({f"c{i}": cell(i) for i in range(DIMS)}).withColumn("curve_index", hilbert_index([F.col(f"c{i}") for i in range(DIMS)], bits))
    # The copies of one text are dealt over tasks, however many there are.
    keyed = join_copies(rows.select("doc_id", "size", "text_crc32", "k1", "k2"), groups.select("k1", "k2", "curve_index"), ["k1", "k2"], "doc_id", hot)
    order = ["curve_index", "text_crc32", "k1", "k2", "doc_id"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", "curve_index", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    run = stored(run, "curve")
    # A row for each partition: offsets are sums over at most n rows.
    counts = run.groupBy("part").agg(F.count("*").alias("rows"))
    offsets = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("offset"), F.sum("rows").over(Window.partitionBy(F.lit(1))).alias("total"))
    placed = run.join(F.broadcast(offsets), "part").withColumn("place", F.col("offset") + F.col("at"))
    return placed.withColumn("shard", F.expr(f"cast(place * {int(shards)} div total as int)")).select("doc_id", "size", "text_crc32", "curve_index", F.lit("rows").alias("law"), "shard", F.expr(f"place - (shard * total + {int(shards) - 1}) div {int(shards)}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
