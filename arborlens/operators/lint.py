"""Lint and validation rules as a registry of DataFrame functions giving (rule, location)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES: dict[str, tuple[int, Callable[..., DataFrame]]] = {}


def rule(code: str, level: int = 1):
    def add(f):
        RULES[code] = level, f
        return f

    return add


@rule("density")
def dense(e, v, p, c, strict=False):
    n = p.groupBy("view_id").agg(F.count("*").alias("n"))
    return n.where(F.col("n") > (15 if strict else 20)).select(F.col("view_id").alias("location"))


@rule("isolated")
def isolated(e, v, p, c, strict=False):
    ends = c.select(F.explode(F.array("source_element_id", "target_element_id")).alias("id")).distinct()
    return e.join(ends, "id", "left_anti").select(F.col("id").alias("location"))


@rule("shared_context", 2)
def shared(e, v, p, c, strict=False):
    return p.groupBy("element_id").agg(F.countDistinct("view_id").alias("n")).where("n > 1").select(F.col("element_id").alias("location"))


@rule("low_insight", 2)
def low_insight(e, v, p, c, strict=False):
    n = p.groupBy("view_id").agg(F.count("*").alias("n"))
    m = c.groupBy("view_id").agg(F.count("*").alias("m"))
    return n.join(m, "view_id", "left").where(2 * F.coalesce("m", F.lit(0)) < F.col("n")).select(F.col("view_id").alias("location"))


@rule("dead_end", 2)
def dead_end(e, v, p, c, strict=False):
    into = c.select(F.col("target_element_id").alias("id")).distinct()
    out = c.select(F.col("source_element_id").alias("id")).distinct()
    return into.join(out, "id", "left_anti").select(F.col("id").alias("location"))


@rule("missing_description", 2)
def undescribed(e, v, p, c, strict=False):
    return e.where(F.coalesce(F.trim("description"), F.lit("")) == "").select(F.col("id").alias("location"))


@rule("missing_technology", 3)
def no_technology(e, v, p, c, strict=False):
    return e.where(F.coalesce(F.trim("technology"), F.lit("")) == "").select(F.col("id").alias("location"))


@rule("missing_label", 2)
def no_label(e, v, p, c, strict=False):
    return c.where(F.coalesce(F.trim("label"), F.lit("")) == "").select(F.col("id").alias("location"))


@rule("duplicate_name")
def duplicate_name(e, v, p, c, strict=False):
    return e.groupBy(F.lower("name").alias("n")).agg(F.count("*").alias("k"), F.min("id").alias("location")).where("k > 1").select("location")


@rule("dangling_connector")
def dangling(e, v, p, c, strict=False):
    ids = e.select("id")
    # An end that many connectors have is looked up once; only connectors with an unknown end, a null one too, are rows.
    ends = c.select(F.explode(F.array("source_element_id", "target_element_id")).alias("id")).distinct()
    lost = ends.join(ids, "id", "left_anti").select(F.col("id").alias("end"), F.lit(True).alias("lost"))
    rows = c.select("id", F.explode(F.array("source_element_id", "target_element_id")).alias("end"))
    known = rows.where("end is not null").join(lost, "end").select("id")
    return known.union(rows.where("end is null").select("id")).distinct().select(F.col("id").alias("location"))


@rule("flat_hierarchy")
def flat(e, v, p, c, strict=False):
    """More than one element owns a view, and no owner stands in an owned view."""
    owned = v.where("owner_element_id is not null").select("id", "owner_element_id")
    nested = p.join(owned.select(F.col("id").alias("view_id")), "view_id", "left_semi").join(owned.select(F.col("owner_element_id").alias("element_id")), "element_id", "left_semi")
    n = owned.agg(F.count_distinct("owner_element_id").alias("n"), F.min("id").alias("location"))
    return n.crossJoin(nested.agg(F.count("*").alias("nested"))).where("n > 1 and nested = 0").select("location")


@rule("empty_view")
def empty_view(e, v, p, c, strict=False):
    # Views are few, so what stands in one is made one row before it is dealt by view.
    used = p.select("view_id").distinct().union(c.select("view_id").distinct()).select(F.col("view_id").alias("id"))
    return v.where("owner_element_id is not null").join(used, "id", "left_anti").select(F.col("owner_element_id").alias("location"))


@rule("abstraction_leak")
def leak(e, v, p, c, strict=False):
    """Functions and classes that stand in the root view, or nowhere."""
    root = v.where("owner_element_id is null").select(F.col("id").alias("view_id"))
    low = e.where(F.lower("kind").isin("function", "class")).select(F.col("id").alias("element_id"))
    top = low.join(p.join(root, "view_id", "left_semi"), "element_id", "left_semi")
    return top.union(low.join(p, "element_id", "left_anti")).distinct().select(F.col("element_id").alias("location"))


#: Labels and parts of names that say nothing.
GENERIC_LABELS, GENERIC_NAMES = ["calls", "uses", "connects", "links"], ["module", "stuff", "thing"]


@rule("generic_label", 3)
def generic_label(e, v, p, c, strict=False):
    return c.where(F.lower("label").isin(GENERIC_LABELS)).select(F.col("id").alias("location"))


@rule("generic_name", 3)
def generic_name(e, v, p, c, strict=False):
    return e.where(F.lower("name").rlike("|".join(GENERIC_NAMES))).select(F.col("id").alias("location"))


def unknown_technology(elements: DataFrame, catalog: DataFrame) -> DataFrame:
    """Elements with a part of their technology (cut at , / ; |) that the catalogue(alias, lower case) does not know: location, part."""
    part = F.explode(F.filter(F.transform(F.split("technology", "[,/;|]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")).alias("part")
    return elements.where("technology is not null").select(F.col("id").alias("location"), part).join(catalog.select(F.col("alias").alias("part")), "part", "left_anti").select("location", "part")


def strict_low_insight(e: DataFrame, p: DataFrame, c: DataFrame, structural: tuple[str, ...] = ("struct", "interface", "type", "file", "folder")) -> DataFrame:
    """Views with fewer than half a connector for each element, unless more than four in five of them are structure."""
    kinds = p.join(e.select(F.col("id").alias("element_id"), F.lower("kind").alias("kind")), "element_id", "left")
    n = kinds.groupBy("view_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin(*structural)).alias("s"))
    m = c.groupBy("view_id").agg(F.count("*").alias("m"))
    return n.join(m, "view_id", "left").where((2 * F.coalesce("m", F.lit(0)) < F.col("n")) & (F.col("s") <= F.floor(F.col("n") * 8 / 10))).select(F.col("view_id").alias("location"))


def lint(elements, views, placements, connectors, level: int = 2, include=(), exclude=(), strict: bool = False) -> DataFrame:
    """All active rules: those of this level and below or included, but for excluded ones."""
    out = None
    for code, (at, check) in sorted(RULES.items()):
        if code in exclude or (at > level and code not in include):
            continue
        rows = check(elements, views, placements, connectors, strict).select(F.lit(code).alias("rule"), F.col("location").cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


def validate(elements: DataFrame, connectors: DataFrame, symbols: DataFrame) -> DataFrame:
    """What is wrong with a workspace before it is planned: rule, ref.

    elements(ref, name, kind, symbol, file_path), connectors(ref, source, target), symbols(path, name): required_field (no name or
    kind), duplicate_name (all but the first ref of a name), dangling_reference (an end that is no element), conflict_marker (in a
    name or kind), missing_symbol (a named symbol that its file does not have).
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    named = elements.where(~blank("name"))
    first = named.groupBy(F.lower(F.trim("name")).alias("n")).agg(F.min("ref").alias("first"))
    refs = elements.select("ref")
    ends = connectors.select("ref", F.explode(F.array("source", "target")).alias("end"))
    asked = elements.where(~blank("symbol"))
    found = {
        "required_field": elements.where(blank("name") | blank("kind")).select("ref"),
        "duplicate_name": named.withColumn("n", F.lower(F.trim("name"))).join(first, "n").where("ref <> first").select("ref"),
        "dangling_reference": ends.join(refs.select(F.col("ref").alias("end")), "end", "left_anti").select("ref").distinct(),
        "conflict_marker": elements.where(F.concat_ws("\n", "name", "kind").rlike(r"(?m)^(<{7}|={7}|>{7})")).select("ref"),
        "missing_symbol": asked.join(symbols.select(F.col("path").alias("file_path"), F.col("name").alias("symbol")), ["file_path", "symbol"], "left_anti").select("ref"),
    }
    out = None
    for code, rows in sorted(found.items()):
        one = rows.select(F.lit(code).alias("rule"), "ref")
        out = one if out is None else out.union(one)
    return out
