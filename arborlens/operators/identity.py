"""Identities that survive renames and moves (J14): scored candidates and a one-to-one match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions.text import identifier_tokens, token_jaccard
from arborlens.operators.graph import dropped, stored

#: What a candidate's parts score, and the least total that counts.
SAME_PLACE, SAME_LINE, NEAR_LINE, SAME_HASH, SAME_PARENT = 0.35, 0.35, 0.2, 0.2, 0.1
MOVED, MOVED_PARENT, MOVED_NAME, MOVED_LINE = 0.8, 0.1, 0.05, 0.05
LEAST = 0.70
NEAR, MOVED_NEAR, LIKE_NAME = 3, 5, 0.5


def qualifier_parent(c: Column) -> Column:
    """What stands before the last dot, if that is not the first character; else empty."""
    return F.regexp_extract(c, r"^(.+)\.[^.]*$", 1)


def own_name_tokens(c: Column) -> Column:
    """Tokens of what stands behind the last dot or slash."""
    return identifier_tokens(F.regexp_extract(c, r"([^./]*)$", 1))


def _described(rows: DataFrame, name: str, prefix: str = "") -> DataFrame:
    return rows.select(F.col(name).alias(prefix + name), *[F.coalesce(c, d).alias(prefix + n) for n, c, d in (
        ("file", F.col("file"), F.lit(None)), ("kind", F.col("kind"), F.lit(None)), ("line", F.col("line"), F.lit(None)), ("hash", F.col("hash").cast("string"), F.lit("")),
        ("parent", qualifier_parent(F.col("qualified_name")), F.lit("")), ("tokens", own_name_tokens(F.col("qualified_name")), F.array().cast("array<string>")),
    )])


#: What a stored row is: a symbol or an identity that is open, or an identity whose current key a symbol has.
SYMBOL, IDENTITY, TAKEN = 0, 1, 2


def _looked(symbols: DataFrame, identities: DataFrame) -> DataFrame:
    """role, key, identity, file, kind, line, hash, qualified_name: what is open, and the smallest identity of each key that a symbol has, found by one deal of both tables by key and stored."""
    rest = ["file", "kind", "line", "hash", "qualified_name"]
    one = symbols.select(F.lit(SYMBOL).alias("role"), "key", F.lit(None).cast(identities.schema["identity"].dataType).alias("identity"), *rest)
    two = identities.select(F.lit(IDENTITY).alias("role"), F.col("current_key").alias("key"), "identity", *rest)
    by_key, named = Window.partitionBy("key"), F.col("key").isNotNull()
    first = F.when(named & (F.min("role").over(by_key) == SYMBOL), F.min("identity").over(by_key))
    met = one.unionByName(two).withColumn("first", first).where((F.col("role") == IDENTITY) | F.col("first").isNull())
    role = F.when(F.col("identity") == F.col("first"), TAKEN).otherwise(F.col("role")).alias("role")
    # Each row keeps what is read of it only.
    kept = met.select(role, "key", "identity", *rest)
    return stored(kept.select("role", F.when(F.col("role") != IDENTITY, F.col("key")).alias("key"), "identity", *[F.when(F.col("role") != TAKEN, F.col(c)).alias(c) for c in rest]))[0]


def candidates(symbols: DataFrame, identities: DataFrame) -> DataFrame:
    """symbols(key, file, kind, line, hash, qualified_name), identities(identity, current_key, the same) -> key, identity, score.

    Exact keys are matched already, so neither their symbols nor their identities are candidates. In one file and kind, a pair up to three lines apart scores for
    the line, the hash and the parent of the name; apart from each other it reaches the least score with the same hash only. So the pairs come from two equal joins: on the line, or on
    the hash. An identity whose file has no symbol any more is a candidate for symbols of its kind and (not empty) hash. An identity has one row.
    """
    return _scored(_looked(symbols, identities), symbols).select("key", "identity", "score")


def _scored(looked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Of _looked: key, file and line of a symbol, identity, score."""
    # What is stored looks small enough to be broadcast, as it is compressed, which the hints forbid; the files alone may be.
    here = stored(symbols.select(F.col("file").alias("i_file")).distinct())[0].withColumn("here", F.lit(True))
    s = _described(looked.where(F.col("role") == SYMBOL), "key").hint("merge")
    i = _described(looked.where(F.col("role") == IDENTITY), "identity", "i_")
    gone = i.where("i_hash <> ''").join(here, "i_file", "left").where("here IS NULL").drop("here").hint("merge")
    i = i.hint("merge")
    apart = F.abs(F.col("line") - F.col("i_line"))
    parent = (F.col("parent") != "") & (F.col("parent") == F.col("i_parent"))
    points = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0.0))
    place = (F.col("file") == F.col("i_file")) & (F.col("kind") == F.col("i_kind"))
    # Keys first; the tokens travel only with candidates of moved files, where they count.
    narrow = [c for c in s.columns if c != "tokens"], [c for c in i.columns if c != "i_tokens"]
    on_line = s.select(narrow[0]).join(i.select(narrow[1]), place & (F.col("line") == F.col("i_line")))
    on_hash = s.select(narrow[0]).join(i.select(narrow[1]), place & (F.col("hash") == F.col("i_hash"))).where(apart.between(1, NEAR))
    near = on_line.unionByName(on_hash).select("key", "file", "line", F.col("i_identity").alias("identity"), (F.lit(SAME_PLACE) + F.when(apart == 0, SAME_LINE).otherwise(NEAR_LINE) + points(F.col("hash") == F.col("i_hash"), SAME_HASH) + points(parent, SAME_PARENT)).alias("score"))
    moved = s.where("hash <> ''").join(gone, (F.col("kind") == F.col("i_kind")) & (F.col("hash") == F.col("i_hash")))
    moved = moved.select("key", "file", "line", F.col("i_identity").alias("identity"), (F.lit(MOVED) + points(parent, MOVED_PARENT) + points(token_jaccard(F.col("tokens"), F.col("i_tokens")) >= LIKE_NAME, MOVED_NAME) + points(apart <= MOVED_NEAR, MOVED_LINE)).alias("score"))
    # A pair comes from one line or one hash of one file, or from a file that is gone: never twice.
    return near.union(moved).withColumn("score", F.round("score", 6)).where(F.col("score") >= LEAST)


def one_to_one(found: DataFrame, order: DataFrame) -> DataFrame:
    """found(key, identity, score), order(key, place: any orderable value, unique) -> key, identity, score: what a serial walk over the keys by place gives, each taking its best free identity."""
    return _walked(found.join(order, "key"), "place", "key")


def _walked(found: DataFrame, *place: str) -> DataFrame:
    """found(key, identity, score, and the columns that keys go by, in order, key last) -> key, identity, score, as one_to_one says.

    By rounds of proposals: every key proposes to the best identity that is left to it (by score, then identity); an identity keeps the
    first proposer by place, and is no longer left to any later key. As every identity ranks keys alike, that ends in the serial walk's result. Where no earlier key has an
    identity left at all, its match is settled, and no candidate of its key or of the identity goes into the next round. A
    round deals candidates by key and by identity once each, and drops those of the round before; the number of rounds is that of the longest chain of keys that turn each other away.
    """
    spark = found.sparkSession
    # Columns instead of a struct, which Spark sorts without prefixes. Rows are dealt before a window, which would deal what it compares beside what that is made of.
    by_key, by_identity, at = Window.partitionBy(*place), Window.partitionBy("identity"), F.struct(*place)
    left, before, settled = found.select(*place, "identity", "score").repartition(*place), None, []
    while True:
        best = F.min(F.struct((-F.col("score")).alias("s"), "identity")).over(by_key)
        asks = left.withColumn("asks", best["identity"] == F.col("identity")).repartition("identity")
        asked = asks.withColumns({"first": F.min(F.when(F.col("asks"), at)).over(by_identity), "lowest": F.min(at).over(by_identity), "several": F.sum(F.col("asks").cast("long")).over(by_identity) > 1})
        wins, sure = F.col("asks") & (at == F.col("first")), F.col("first") == F.col("lowest")
        # Of an identity with a sure match that match stays, to tell its key; of another, what stands before its first proposer, and that.
        kept = asked.where(F.col("first").isNull() | (at <= F.col("first"))).select(*place, "identity", "score", wins.alias("wins"), (wins & sure).alias("sure"), (wins & F.col("several")).alias("turned"))
        judged, folder = stored(kept)
        last = judged.where("turned").isEmpty()
        settled.append(stored(judged.where("wins" if last else "sure").select("key", "identity", "score"))[0])
        if before:
            dropped(spark, before)
        if last:
            dropped(spark, folder)
            break
        # A sure match tells its key no more than that it is done.
        told = judged.select(*place, *[F.when(~F.col("sure"), F.col(c)).alias(c) for c in ("identity", "score")], "sure")
        left, before = told.withColumn("done", F.max("sure").over(by_key)).where("NOT done").select(*place, "identity", "score"), folder
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def matched(symbols: DataFrame, identities: DataFrame) -> DataFrame:
    """Every symbol's identity: key, identity, score, state (kept: its current key; renamed: by score; new: its own key). Symbols go by file, line and key."""
    looked = _looked(symbols, identities)
    exact = looked.where(F.col("role") == TAKEN).select("key", "identity", F.lit(1.0).alias("score"), F.lit("kept").alias("state"))
    found = _walked(_scored(looked, symbols).where("key IS NOT NULL"), "file", "line", "key")
    open_ = looked.where(F.col("role") == SYMBOL).select("key").hint("merge")
    new = open_.join(found.select("key"), "key", "left_anti").select("key", F.col("key").alias("identity"), F.lit(None).cast("double").alias("score"), F.lit("new").alias("state"))
    return exact.unionByName(found.withColumn("state", F.lit("renamed"))).unionByName(new)
