"""Path rules as a relation (J16, P11): the last rule that matches a path, by equal joins on what a rule spells out.

A rule is a path pattern with * (within a segment), ** (across segments) and ?; with a slash in front or inside it is anchored at the root, else it matches at any depth; it holds
for what lies below a match too. Of each rule one literal piece is its key, the most telling it has: its first segments, if it is anchored and they are spelled
out; else its longest spelled-out segment; else the longest run of three or more letters within a segment; else, as for * alone, none. Paths
offer their prefixes, segments and runs of letters as keys, so a rule meets the paths that hold its key, and a regular expression decides. Rules
without a key meet every path; of equal patterns only the last counts, so these are few, however many rules there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.functions.text import glob_regex

_WILD = re.compile(r"[*?]")
#: Letters of a run that is a key.
RUN = 3


def compiled(pattern: str) -> tuple[str, str]:
    """(key, regular expression) of a pattern."""
    p = pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    parts = p.split("/")
    regex = f"{'^' if anchored else '^(?:.*/)?'}{glob_regex(p)[1:-1]}(?:/.*)?$"
    # Behind ** inside a segment the next one need not start a segment of the path.
    whole = all(x == "**" or "**" not in x for x in parts)
    plain = [x for x in parts if whole and x and not _WILD.search(x)]
    head = []
    for x in parts if whole else []:
        if not x or _WILD.search(x):
            break
        head.append(x)
    if anchored and head:
        return "p:" + "/".join(head), regex
    if plain:
        return "s:" + max(plain, key=len), regex
    runs = [x for part in parts for x in _WILD.split(part) if len(x) >= RUN]
    return ("r:" + max(runs, key=len)[:RUN] if runs else "any"), regex


def keyed(rules: DataFrame) -> DataFrame:
    """rules(number, pattern, ...) with key and regex; of equal patterns the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [compiled(p) for p in b["pattern"]]
            yield pd.DataFrame({"pattern": b["pattern"], "key": [k for k, _ in found], "regex": [r for _, r in found]})

    filled = rules.where("pattern IS NOT NULL AND trim(BOTH '/' FROM pattern) <> ''")
    last = filled.groupBy("pattern").agg(F.max("number").alias("number"))
    patterns = last.select("pattern").mapInPandas(run, "pattern string, key string, regex string")
    return filled.join(last, ["pattern", "number"]).join(patterns, "pattern")


def _offers(paths: DataFrame) -> DataFrame:
    """path, key: every key that a rule matching the path may have."""
    parts = F.split("path", "/")
    at = F.sequence(F.lit(1), F.size(parts))
    prefixes = F.transform(at, lambda k: F.concat(F.lit("p:"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    segments = F.transform(parts, lambda x: F.concat(F.lit("s:"), x))
    runs = F.flatten(F.transform(parts, lambda x: F.when(F.length(x) >= RUN, F.transform(F.sequence(F.lit(1), F.length(x) - RUN + 1), lambda k: F.concat(F.lit("r:"), F.substring(x, k, F.lit(RUN))))).otherwise(F.array().cast("array<string>"))))
    return paths.select("path").distinct().select("path", F.explode(F.array_distinct(F.flatten(F.array(F.array(F.lit("any")), prefixes, segments, runs)))).alias("key"))


def matches(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(path) x rules(number, pattern, ...) -> path and the rule's columns, for the rules that match."""
    k = keyed(rules)
    # Only keys that some rule has travel.
    wanted = _offers(paths).join(k.select("key").distinct(), "key", "left_semi")
    return wanted.join(k, "key").where("path RLIKE regex").drop("key", "regex")


def last_match(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(path), rules(number, pattern, owner) -> path, owner: of the rules that match, the one with the largest number; null where none does."""
    best = matches(paths, rules).groupBy("path").agg(F.max_by("owner", "number").alias("owner"))
    return paths.join(best, "path", "left")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(path), rules(number, pattern, implicit) -> path, ignored: any implicit rule ignores for good; else the last that matches decides, and one with ! in front takes back."""
    r = rules.select("number", F.regexp_replace("pattern", "^!", "").alias("pattern"), F.coalesce("implicit", F.lit(False)).alias("implicit"), F.col("pattern").startswith("!").alias("back"))
    r = r.where("NOT implicit OR NOT back")
    implicit = matches(paths, r.where("implicit")).select("path").distinct().withColumn("always", F.lit(True))
    last = matches(paths, r.where("NOT implicit")).groupBy("path").agg(F.max_by("back", "number").alias("back"))
    both = paths.join(implicit, "path", "left").join(last, "path", "left")
    return both.withColumn("ignored", F.coalesce("always", F.lit(False)) | F.coalesce(~F.col("back"), F.lit(False))).drop("always", "back")
