"""Enrichers: declarative token patterns and route expressions over source text, facts as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {".c": "c", ".cc": "cpp", ".cpp": "cpp", ".go": "go", ".h": "c", ".java": "java", ".js": "javascript", ".py": "python", ".rs": "rust", ".ts": "typescript", ".tsx": "typescript"}


def without_comments(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?m)//.*$", ""), r"(?m)#.*$", "")


def route_facts(files: DataFrame, pattern: str, method_group: int | None, path_group: int, method: str = "ANY") -> DataFrame:
    """Every match of a route expression: name 'METHOD path', confidence .90, hint 1."""
    all_ = lambda g: F.regexp_extract_all("content", F.lit(pattern), F.lit(g))
    found = F.arrays_zip(all_(method_group or path_group).alias("m"), all_(path_group).alias("p"))
    rows = files.select("path", F.posexplode(found).alias("ordinal", "r"))
    verb = F.upper(F.col("r.m")) if method_group else F.lit(method)
    return rows.select("path", F.col("ordinal").cast("long").alias("ordinal"), F.concat_ws(" ", verb, F.col("r.p")).alias("name"), F.lit(0.90).alias("confidence"), F.lit(1.0).alias("hint"))


#: The type of a fact that is no fact of the code, and what each part of a score weighs.
VERSION_TYPE = "watch.enrichment.version"
HIGH_SIGNAL, DEPENDENCY, PROXIMITY, SELECTED = 1.5, 0.2, 1.0, 100.0


def fact_scores(facts: DataFrame, high: Column, dependency: Column, symbols: DataFrame, files: DataFrame, expansions: DataFrame, threshold: float | None = 1.0) -> DataFrame:
    """facts(id, type, subject_kind, subject_key, path, confidence, hint), symbols(key) and files(path) that show, expansions(path of a file or folder, tier) -> id, score, tier, visible.

    1.5 x confidence of a high-signal fact, else .2 x of a dependency, 1 if its subject is a symbol that shows, 1 if its file shows, 100 if
    its file or a folder above it is expanded (tier: the largest), and the enricher's hint. Only high-signal facts and dependencies show: expanded ones, and those
    that reach the threshold (all, where there is none).
    """
    f = facts.where(F.col("type") != VERSION_TYPE).withColumns({"high": F.coalesce(high, F.lit(False)), "dep": F.coalesce(dependency, F.lit(False))})
    f = f.join(symbols.select(F.col("key").alias("subject_key"), F.lit(PROXIMITY).alias("subject")).distinct(), "subject_key", "left").join(files.select("path", F.lit(PROXIMITY).alias("file")).distinct(), "path", "left")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    tiers = f.select("path").distinct().select("path", F.explode(above).alias("up")).join(expansions.groupBy(F.col("path").alias("up")).agg(F.max("tier").alias("t")), "up").groupBy("path").agg(F.max("t").alias("t"))
    f = f.join(tiers, "path", "left").withColumn("tier", F.greatest(F.coalesce("t", F.lit(0)), F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    own = F.when(F.col("high"), HIGH_SIGNAL * F.col("confidence")).when(F.col("dep"), DEPENDENCY * F.col("confidence"))
    score = zero(own) + zero(F.when(F.col("subject_kind") == "symbol", F.col("subject"))) + zero(F.col("file")) + F.when(F.col("tier") > 0, SELECTED).otherwise(0.0) + zero(F.col("hint"))
    shown = F.lit(True) if threshold is None else (F.col("tier") > 0) | (F.col("score") >= threshold)
    return f.withColumn("score", F.round(score, 6)).select("id", "score", "tier", ((F.col("high") | F.col("dep")) & shown).alias("visible"))


def active(enrichers: DataFrame, signals: DataFrame) -> DataFrame:
    """Enrichers(id, trigger) with a trigger that equals a signal or is a /-prefix of it."""
    parts = F.split("signal", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return enrichers.join(signals.select(up.alias("trigger")).distinct(), "trigger", "left_semi").select("id").distinct()
