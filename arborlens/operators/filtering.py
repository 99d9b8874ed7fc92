"""What of a code graph is shown: seed scores, forced ends, decisions on references, fact caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions.naming import exported, utility
from arborlens.operators.relational import degrees

#: Weights of the seed score, thresholds of noise, fact types that always count as signals.
WEIGHTS = {"exported": 1.2, "outgoing": 1.0, "high_signal": 1.5, "dependency": 0.2, "forced": 100.0, "high_degree": -1.5, "utility": -0.8}
MAX_OUT, MAX_IN, MAX_UTILITY = 40, 25, 8
HIGH_SIGNAL_TYPES = ["http.route", "frontend.route", "orm.query"]
#: Kinds of facts that make an architecture.
FACT_KINDS = {
    "component": ["runtime.component", "grpc.server", "grpc.contract", "datastore.dependency", "external.dependency"],
    "connection": ["runtime.connection", "runtime.endpoint_ref", "grpc.client", "http.client"],
    "volume": ["runtime.volume"],
    "endpoint": ["runtime.endpoint"],
    "import": ["dependency.import"],
}


def high_signal(type_: Column, hint: Column) -> Column:
    return (F.coalesce(hint, F.lit(0.0)) > 0) | type_.isin(HIGH_SIGNAL_TYPES)


def dependency(type_: Column) -> Column:
    return type_.startswith("dependency.")


def fact_kind(type_: Column) -> Column:
    """import, connection, volume, endpoint or component; null for other facts."""
    out = F.lit(None).cast("string")
    for kind, types in FACT_KINDS.items():
        out = F.when(type_.isin(types), kind).otherwise(out)
    return out


def seeds(symbols: DataFrame, references: DataFrame, facts: DataFrame, forced: DataFrame) -> DataFrame:
    """Seed scores: id, base, forced.

    symbols(id, name, path), references(source, target; parallel ones count), facts(id, type,
    hint, confidence) of symbols, forced(id): changed, marked or expanded ones, each adding once.
    """
    d = degrees(references.select(F.col("source").alias("source_element_id"), F.col("target").alias("target_element_id")))
    high = high_signal(F.col("type"), F.col("hint"))
    worth = F.when(high, WEIGHTS["high_signal"] * F.col("confidence")).when(dependency(F.col("type")), WEIGHTS["dependency"] * F.col("confidence")).otherwise(0.0)
    told = facts.groupBy("id").agg(F.sum(worth).alias("told"))
    rows = symbols.join(d, F.col("id") == F.col("element_id"), "left").join(told, "id", "left").join(forced.select("id", F.lit(True).alias("forced")).distinct(), "id", "left")
    out, into = F.coalesce("out_degree", F.lit(0)), F.coalesce("in_degree", F.lit(0))
    base = (F.when(exported(F.col("name")), WEIGHTS["exported"]).otherwise(0.0) + F.when(out > 0, WEIGHTS["outgoing"]).otherwise(0.0) + F.coalesce("told", F.lit(0.0))
            + F.when(F.col("forced"), WEIGHTS["forced"]).otherwise(0.0) + F.when((out > MAX_OUT) | (into > MAX_IN), WEIGHTS["high_degree"]).otherwise(0.0)
            + F.when(utility(F.col("name"), F.col("path")) & (out + into > MAX_UTILITY), WEIGHTS["utility"]).otherwise(0.0))
    return rows.select("id", F.round(base, 8).alias("base"), F.coalesce("forced", F.lit(False)).alias("forced"))


def forced_ends(references: DataFrame, changed: DataFrame) -> DataFrame:
    """Both ends of every reference that touches a changed symbol: id."""
    out = references.join(changed.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    into = references.join(changed.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
    return out.union(into).distinct()


def reference_decisions(references: DataFrame, visible: DataFrame, hidden: DataFrame) -> DataFrame:
    """references(id, source, target) -> id, decision, reason: shown where both ends are and nobody hid it."""
    a = visible.select(F.col("id").alias("source"), F.lit(True).alias("s")).distinct()
    b = visible.select(F.col("id").alias("target"), F.lit(True).alias("t")).distinct()
    h = hidden.select("id", F.lit(True).alias("h")).distinct()
    j = references.join(a, "source", "left").join(b, "target", "left").join(h, "id", "left")
    reason = F.when(F.col("h"), "user marked as noise").when(F.col("s") & F.col("t"), "connects visible symbols").otherwise("unresolved or hidden endpoint")
    return j.select("id", F.when(reason == "connects visible symbols", "visible").otherwise("hidden").alias("decision"), reason.alias("reason"))


def capped_facts(facts: DataFrame, per_view: int = 50) -> DataFrame:
    """facts(id, path, type) -> + rank, shown: a file shows max(3, per_view / 3) facts in order of type and id; the others are summed up."""
    most = max(3, per_view // 3)
    ranked = facts.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy("type", "id")).cast("long"))
    return ranked.withColumn("shown", F.col("rank") <= most)


def first_rows(symbols: DataFrame, order: list, most: int = 5000) -> DataFrame:
    """The first `most` symbols in canonical order: those that get an embedding."""
    return symbols.orderBy(*order).limit(most)
