"""Density projection of views: signals, scores, soft-capped ranks, quantile levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.operators.relational import numbered

#: Element and connector caps by density level.
CAPS = {-2: (4, 8), -1: (8, 16), 0: (12, 24), 1: (32, 64), 2: (None, None)}


def signals(decisions: DataFrame, links: DataFrame) -> DataFrame:
    """element_id, filter_score, tier, confidence over all runs."""
    d = decisions.groupBy("element_id").agg(F.max("score").alias("filter_score"), F.min("tier").alias("tier"))
    a = links.groupBy("element_id").agg(F.max("confidence").alias("confidence"))
    return d.join(a, "element_id", "full_outer")


def filled(df: DataFrame, name: str) -> Column:
    """Whether a column is there and holds something; false where the relation has none of that name."""
    if name not in df.columns:
        return F.lit(False)
    kind = df.schema[name].dataType.typeName()
    return F.coalesce(F.size(name) > 0 if kind == "array" else F.trim(F.col(name).cast("string")) != "", F.lit(False))


def worth(degree: Column, has_view: Column, described: Column, tagged: Column, located: Column, place: Column, delta: Column, digits: int = 6) -> Column:
    """12 x degree, 30 x filter score, 5 x (10 - tier), 20 x confidence, 20 for an own view, 4 described, 3 tagged, 2 with a file, 100 x delta."""
    score = 12 * degree + 30 * F.coalesce("filter_score", F.lit(0.0)) + F.when(F.col("tier").isNotNull(), 5 * F.greatest(F.lit(0), 10 - F.col("tier"))).otherwise(0)
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = score + 20 * F.coalesce("confidence", F.lit(0.0)) + points(has_view, 20) + points(described, 4) + points(tagged, 3) + points(located, 2)
    return F.round(score - 0.001 * F.log1p(F.greatest(F.lit(0), place).cast("double")) + 100 * delta, digits)


def soft_cap(df: DataFrame, view: str, score: str, tie: str, cap: int | None, full: bool) -> DataFrame:
    """Rows by score within a view: past the cap only promoted ones (delta > 0); -4 never, and at full density no demoted ones."""
    rows = df.where("delta > -4" + (" and delta >= 0" if full else ""))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(view).orderBy(F.col(score).desc(), F.col(tie))))
    return rows if cap is None else rows.where((F.col("rank") <= cap) | (F.col("delta") > 0))


def view_elements(placements: DataFrame, elements: DataFrame, views: DataFrame, connectors: DataFrame, signal: DataFrame, overrides: DataFrame, level: int, digits: int = 6) -> DataFrame:
    """The elements shown in each view at a density level: view_id, element_id, name, score, rank. The id that counts in the score is the placement's (placement_id), where placements have one."""
    ends = connectors.select("view_id", F.explode(F.array("source_element_id", "target_element_id")).alias("element_id")).groupBy("view_id", "element_id").agg(F.count("*").alias("degree"))
    owners = views.where("owner_element_id is not null").select(F.col("owner_element_id").alias("element_id"), F.lit(True).alias("has_view")).distinct()
    rows = placements.join(elements, F.col("element_id") == F.col("id")).join(ends, ["view_id", "element_id"], "left").join(owners, "element_id", "left").join(signal, "element_id", "left").join(overrides, ["view_id", "element_id"], "left")
    rows = rows.withColumn("delta", F.coalesce("delta", F.lit(0)))
    score = worth(F.coalesce("degree", F.lit(0)), F.coalesce("has_view", F.lit(False)), filled(elements, "description"), filled(elements, "tags"), filled(elements, "file_path"), F.col("placement_id" if "placement_id" in placements.columns else "element_id"), F.col("delta"), digits)
    return soft_cap(rows.withColumn("score", score), "view_id", "score", "element_id", CAPS[level][0], level == 2).select("view_id", "element_id", "name", "score", F.col("rank").cast("long").alias("rank"))


def view_connectors(connectors: DataFrame, shown: DataFrame, level: int, signal: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Connectors of a view between shown elements, by score, up to the cap.

    30 x filter score, the tier, 20 x confidence (signal(id, filter_score, tier, confidence)), 10 with a relationship, 6 with a label,
    3 described, 100 x delta (overrides(view_id, id, delta)).
    """
    s = shown.select("view_id", F.col("element_id").alias("e"))
    rows = connectors.join(s.withColumnRenamed("e", "source_element_id"), ["view_id", "source_element_id"], "left_semi").join(s.withColumnRenamed("e", "target_element_id"), ["view_id", "target_element_id"], "left_semi")
    told = F.lit(0.0)
    if signal is not None:
        rows = rows.join(signal, "id", "left")
        told = 30 * F.coalesce("filter_score", F.lit(0.0)) + F.coalesce("tier", F.lit(0)) + 20 * F.coalesce("confidence", F.lit(0.0))
    rows = rows.withColumn("delta", F.lit(0)) if overrides is None else rows.join(overrides, ["view_id", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0)))
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = told + points(F.col("relationship").isNotNull(), 10) + points(F.col("label").isNotNull(), 6) + points(filled(connectors, "description"), 3)
    score = F.round(score - 0.001 * F.log1p(F.col("id").cast("double")) + 100 * F.col("delta"), 6)
    out = soft_cap(rows.withColumn("score", score), "view_id", "score", "id", CAPS[level][1], level == 2)
    return out.select("view_id", "id", "score", F.col("rank").cast("long").alias("rank"))


def admitted(connectors: DataFrame, shown: DataFrame, cap: int | None = None) -> DataFrame:
    """Admission in order of score within a view: promoted connectors bring their ends, for later ones only; then both ends must show; then the cap.

    connectors(view_id, id, source_element_id, target_element_id, score, delta), shown(view_id, element_id) -> view_id, id. An
    end shows if it did at first or if the first promoted connector at it comes before; what is so eligible is
    admitted up to the cap, promoted ones beyond it too: no state has to be carried along.
    """
    at = F.struct((-F.col("score")).alias("s"), F.col("id"))
    ends = F.explode(F.array("source_element_id", "target_element_id"))
    brought = connectors.where("delta > 0").select("view_id", ends.alias("e"), at.alias("at")).groupBy("view_id", "e").agg(F.min("at").alias("first"))
    known = shown.select("view_id", F.col("element_id").alias("e"), F.lit(True).alias("shown")).distinct().join(brought, ["view_id", "e"], "full_outer")
    side = lambda p: known.select("view_id", F.col("e").alias(f"{p}_element_id"), F.col("shown").alias(f"{p}_shown"), F.col("first").alias(f"{p}_first"))
    j = connectors.withColumn("at", at).join(side("source"), ["view_id", "source_element_id"], "left").join(side("target"), ["view_id", "target_element_id"], "left")
    seen = lambda p: F.coalesce(F.col(f"{p}_shown"), F.lit(False)) | F.coalesce(F.col(f"{p}_first") < F.col("at"), F.lit(False))
    able = j.where((F.col("delta") > 0) | (seen("source") & seen("target")))
    ranked = able.withColumn("rank", F.row_number().over(Window.partitionBy("view_id").orderBy(F.col("score").desc(), "id")))
    return (ranked if cap is None else ranked.where((F.col("rank") <= cap) | (F.col("delta") > 0))).select("view_id", "id")


def view_scores(placements: DataFrame, signal: DataFrame) -> DataFrame:
    """Mean per element of the signals it has, then mean per view over elements that have any."""
    parts = F.array_compact(F.array("filter_score", F.greatest(F.lit(0), 10 - F.col("tier")) / F.lit(10.0), "confidence"))
    each = signal.withColumn("p", parts).where(F.size("p") > 0).select("element_id", (F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p")).alias("s"))
    return placements.join(each, "element_id").groupBy("view_id").agg(F.round(F.avg("s"), 6).alias("score"))


def density_levels(views: DataFrame, scores: DataFrame) -> DataFrame:
    """Five even buckets of the scored views in order, -2 to 2; one scored view and those without signals get 0."""
    n = scores.agg(F.count("*").alias("n"))
    ranked = numbered(scores, ["score", "view_id"]).crossJoin(F.broadcast(n))
    level = F.when(F.col("n") == 1, 0).otherwise(F.floor(F.col("place") * 5 / F.col("n")) - 2)
    ranked = ranked.select("view_id", level.cast("int").alias("level"))
    return views.join(ranked, F.col("id") == F.col("view_id"), "left").select(F.col("id").alias("view_id"), F.coalesce("level", F.lit(0)).alias("level"))
