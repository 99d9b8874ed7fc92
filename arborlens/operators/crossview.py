"""Connectors seen from another view: ends are lifted to what is visible there, and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlens.operators.graph import checkpointed


def lifted(placements: DataFrame, closure: DataFrame, views: DataFrame) -> DataFrame:
    """element_id, view_id, proxy: in each view above an element, the placed owner that stands for it."""
    owner = views.select(F.col("id").alias("child"), "owner_element_id")
    own = placements.select("element_id", "view_id", F.col("element_id").alias("proxy"))
    up = placements.select("element_id", F.col("view_id").alias("v")).join(closure, F.col("v") == F.col("view_id")).drop("view_id")
    step = up.join(owner, F.col("ancestor_id") == F.col("child")).where("owner_element_id is not null")
    seen = placements.select(F.col("element_id").alias("owner_element_id"), F.col("view_id"))
    return own.union(step.join(seen, "owner_element_id").select("element_id", "view_id", F.col("owner_element_id").alias("proxy"))).distinct()


def proxy_connectors(connectors: DataFrame, placements: DataFrame, closure: DataFrame, views: DataFrame, budget: int = 50) -> DataFrame:
    """Per view and unordered pair of proxies: how many connectors they stand for; the `budget` largest of a view.

    Pairs whose ends fall on one proxy, and those drawn natively, are left out. Connectors are merged by their
    ends before they are lifted, so the join grows with distinct pairs.
    """
    ends = connectors.groupBy(F.least("source_element_id", "target_element_id").alias("x"), F.greatest("source_element_id", "target_element_id").alias("y")).agg(F.count("*").alias("n"))
    up = lifted(placements, closure, views)
    a = up.select(F.col("element_id").alias("x"), "view_id", F.col("proxy").alias("px"))
    b = up.select(F.col("element_id").alias("y"), "view_id", F.col("proxy").alias("py"))
    j = ends.join(a, "x").join(b, ["y", "view_id"]).where("px <> py and not (px = x and py = y)")
    g = j.groupBy("view_id", F.least("px", "py").alias("source"), F.greatest("px", "py").alias("target")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("view_id").orderBy(F.col("n").desc(), "source", "target")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= budget)


def distances(closure: DataFrame, view: int) -> DataFrame:
    """From one view to every view with a common ancestor: view_id, distance, lca_depth (of the lowest common ancestor below its root)."""
    own = closure.where(F.col("view_id") == view).select("ancestor_id", F.col("depth").alias("da"))
    most = own.agg(F.max("da").alias("most"))
    j = closure.join(F.broadcast(own), "ancestor_id").groupBy("view_id").agg(F.min("da").alias("da"), F.min("depth").alias("db"))
    return j.crossJoin(F.broadcast(most)).select("view_id", (F.col("da") + F.col("db")).alias("distance"), (F.col("most") - F.col("da")).alias("lca_depth"))


def best_placement(placements: DataFrame, closure: DataFrame, focus: int, owner: int) -> DataFrame:
    """element_id, view_id: the place of each element that is nearest to the focused view.

    The focus costs 0, the owner's view 10, views below the focus 50 and their depth below it, others 200 + 10 x distance to the
    focus + 2 x distance to the owner's view - depth of the common ancestor; ties go to the smallest view.
    """
    below = closure.where((F.col("ancestor_id") == focus) & (F.col("depth") > 0)).select("view_id", F.col("depth").alias("below"))
    a, b = distances(closure, focus), distances(closure, owner).select("view_id", F.col("distance").alias("to_owner"))
    j = placements.join(below, "view_id", "left").join(a, "view_id", "left").join(b, "view_id", "left")
    far = 200 + 10 * F.coalesce("distance", F.lit(1000)) + 2 * F.coalesce("to_owner", F.lit(1000)) - F.coalesce("lca_depth", F.lit(0))
    cost = F.when(F.col("view_id") == focus, 0).when(F.col("view_id") == owner, 10).when(F.col("below").isNotNull(), 50 + F.col("below")).otherwise(far)
    return j.groupBy("element_id").agg(F.min_by("view_id", F.struct(cost.alias("cost"), F.col("view_id"))).alias("view_id"))


def zoom_proxies(connectors: DataFrame, placements: DataFrame, closure: DataFrame, views: DataFrame, shown: DataFrame, deepest: int = 2) -> DataFrame:
    """Connectors seen at a zoom where only some elements show: source, target, n, kind.

    Each end stands for the `deepest` lowest shown members of its path (itself, then owners of the views above); all pairs of
    such members but those on one element and the natively drawn one. Ends are merged before they are paired.
    """
    root = closure.groupBy("view_id").agg(F.max("depth").alias("height"))
    above = placements.join(closure, "view_id").select("element_id", F.col("ancestor_id").alias("id")).join(views.select("id", "owner_element_id"), "id").where("owner_element_id is not null")
    above = above.join(root.select(F.col("view_id").alias("id"), "height"), "id").select("element_id", F.col("owner_element_id").alias("proxy"), F.col("height").alias("depth"))
    own = placements.select("element_id", F.col("element_id").alias("proxy"), F.lit(1000).alias("depth"))
    path = own.union(above).distinct().join(shown.select(F.col("element_id").alias("proxy")), "proxy", "left_semi")
    low = path.withColumn("r", F.row_number().over(Window.partitionBy("element_id").orderBy(F.col("depth").desc(), "proxy"))).where(F.col("r") <= deepest).select("element_id", "proxy")
    ends = connectors.groupBy("source_element_id", "target_element_id").agg(F.count("*").alias("c"))
    a = low.select(F.col("element_id").alias("source_element_id"), F.col("proxy").alias("source"))
    b = low.select(F.col("element_id").alias("target_element_id"), F.col("proxy").alias("target"))
    j = ends.join(a, "source_element_id").join(b, "target_element_id").where("source <> target and not (source = source_element_id and target = target_element_id)")
    g = j.groupBy("source", "target").agg(F.sum("c").alias("n"))
    return g.withColumn("kind", F.when(F.col("n") == 1, "single").otherwise("group"))


def omitted(proxies: DataFrame, budget: int) -> DataFrame:
    """proxies(view_id, source, target, n) of all pairs -> view_id, shown, omitted: pairs within the budget and connectors beyond it."""
    w = Window.partitionBy("view_id").orderBy(F.col("n").desc(), "source", "target")
    r = proxies.withColumn("r", F.row_number().over(w))
    return r.groupBy("view_id").agg(F.count_if(F.col("r") <= budget).alias("shown"), F.coalesce(F.sum(F.when(F.col("r") > budget, F.col("n"))), F.lit(0)).alias("omitted"))


def context_proxies(connectors: DataFrame, placements: DataFrame, closure: DataFrame, views: DataFrame, view: int, max_depth: int = 3) -> DataFrame:
    """One view with what lies around it: inside, outside, n, collapsed.

    An end inside the view, or lifted to a placed owner, is `inside`; the other end, if neither, is context: the element itself, or
    the owner of its view where two or more such elements share it. Connectors with no end inside are left out, and so are
    outside ends more than max_depth below their root.
    """
    up = lifted(placements, closure, views).where(F.col("view_id") == view).select("element_id", "proxy").distinct()
    ends = connectors.groupBy("source_element_id", "target_element_id").agg(F.count("*").alias("c"))
    both = ends.select(F.col("source_element_id").alias("x"), F.col("target_element_id").alias("y"), "c").union(ends.select("target_element_id", "source_element_id", "c"))
    a = up.select(F.col("element_id").alias("x"), F.col("proxy").alias("inside"))
    off = both.join(a, "x").join(up.select(F.col("element_id").alias("y")), "y", "left_anti")
    height = closure.groupBy("view_id").agg(F.max("depth").alias("d"))
    home = placements.join(height.where(F.col("d") <= max_depth), "view_id").groupBy(F.col("element_id").alias("y")).agg(F.min("view_id").alias("home"))
    home = home.join(views.select(F.col("id").alias("home"), F.col("owner_element_id").alias("owner")), "home", "left").select("y", "owner")
    off = off.join(home, "y")
    shared = off.select("owner", "y").distinct().groupBy("owner").agg(F.count("*").alias("k")).where("owner is not null and k > 1").select("owner", F.lit(True).alias("collapsed"))
    rows = off.join(shared, "owner", "left").withColumn("collapsed", F.coalesce("collapsed", F.lit(False)))
    return rows.groupBy("inside", F.when(F.col("collapsed"), F.col("owner")).otherwise(F.col("y")).alias("outside"), "collapsed").agg(F.sum("c").alias("n")).select("inside", "outside", "n", "collapsed")


#: What a proxy's distance from the middle of the viewport counts, in the nearest-first and the inward order.
NEAR, FAR, INSIDE, BOTH_INSIDE = 1000.0, 320.0, 300.0, 160.0
INNER_FAR, INNER_INSIDE = 400.0, 250.0


def viewport_proxies(connectors: DataFrame, placements: DataFrame, closure: DataFrame, views: DataFrame, boxes: DataFrame, viewports: DataFrame, budget: int = 50, inward: bool = False) -> tuple[DataFrame, DataFrame]:
    """Proxies of all views in the order of their viewport: ((view_id, source, target, n, source_depth, target_depth, score, rank), (view_id, shown, omitted)).

    boxes(view_id, element_id, x, y, w, h), viewports(view_id, min_x, min_y, max_x, max_y). A proxy whose ends' boxes both have their middle outside the viewport is left out. The others are
    ordered by score (distances over the viewport's diagonal), then by connectors, depths and ends, and the first `budget` of a view are kept; `omitted` counts the
    different connectors that stand behind the others, each once, however many of these pairs it is in.
    """
    ends = connectors.groupBy(F.least("source_element_id", "target_element_id").alias("x"), F.greatest("source_element_id", "target_element_id").alias("y")).agg(F.count("*").alias("n"))
    owner = views.select(F.col("id").alias("ancestor_id"), F.col("owner_element_id").alias("proxy")).where("proxy IS NOT NULL")
    up = placements.select("element_id", F.col("view_id").alias("v")).join(closure.select(F.col("view_id").alias("v"), "ancestor_id", "depth"), "v").join(owner, "ancestor_id")
    up = up.join(placements.select(F.col("element_id").alias("proxy"), "view_id"), "proxy").select("element_id", "view_id", "proxy", F.col("depth") + 1)
    own = placements.select("element_id", "view_id", F.col("element_id").alias("proxy"), F.lit(0).alias("depth"))
    lift = own.union(up).groupBy("element_id", "view_id", "proxy").agg(F.min("depth").alias("depth"))
    side = lambda e, p, q: lift.select(F.col("element_id").alias(e), "view_id", F.col("proxy").alias(p), F.col("depth").alias(q))
    leaves = ends.join(side("x", "px", "dx"), "x").join(side("y", "py", "dy"), ["y", "view_id"]).where("px <> py AND NOT (px = x AND py = y)")
    first = F.col("px") < F.col("py")
    leaves = leaves.select("view_id", "x", "y", "n", F.least("px", "py").alias("source"), F.greatest("px", "py").alias("target"), F.when(first, F.col("dx")).otherwise(F.col("dy")).alias("ds"), F.when(first, F.col("dy")).otherwise(F.col("dx")).alias("dt"))
    pairs = leaves.groupBy("view_id", "source", "target").agg(F.sum("n").alias("n"), F.min("ds").alias("source_depth"), F.min("dt").alias("target_depth"))
    middle = lambda e, p: boxes.select("view_id", F.col("element_id").alias(e), (F.col("x") + F.col("w") / 2).alias(f"{p}x"), (F.col("y") + F.col("h") / 2).alias(f"{p}y"))
    at = pairs.join(viewports, "view_id").join(middle("source", "s"), ["view_id", "source"]).join(middle("target", "t"), ["view_id", "target"])
    diagonal = F.greatest(F.lit(1.0), F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))
    away = lambda p: F.hypot(F.col(f"{p}x") - (F.col("min_x") + F.col("max_x")) / 2, F.col(f"{p}y") - (F.col("min_y") + F.col("max_y")) / 2) / diagonal
    inside = lambda p: (F.col(f"{p}x").between(F.col("min_x"), F.col("max_x")) & F.col(f"{p}y").between(F.col("min_y"), F.col("max_y"))).cast("int")
    at = at.withColumns({"a": F.least(away("s"), away("t")), "b": F.greatest(away("s"), away("t")), "inside": inside("s") + inside("t")}).where("inside > 0")
    if inward:
        score = (F.col("a") + F.col("b")) * NEAR + F.col("b") * INNER_FAR - F.col("inside") * INNER_INSIDE
    else:
        score = F.col("a") * NEAR - F.col("b") * FAR - INSIDE + F.when(F.col("inside") == 2, BOTH_INSIDE).otherwise(0.0)
    deep = F.greatest("source_depth", "target_depth")
    w = Window.partitionBy("view_id").orderBy("score", F.col("n").desc(), deep, F.col("source_depth") + F.col("target_depth"), "source", "target")
    ranked = checkpointed(at.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(w).cast("long")).select("view_id", "source", "target", "n", "source_depth", "target_depth", "score", "rank"))
    beyond = leaves.join(ranked.where(F.col("rank") > budget).select("view_id", "source", "target"), ["view_id", "source", "target"], "left_semi")
    # A pair of ends stands for its connectors, so different pairs of ends count each connector once.
    omitted = beyond.select("view_id", "x", "y", "n").distinct().groupBy("view_id").agg(F.sum("n").alias("omitted"))
    shown = ranked.groupBy("view_id").agg(F.count_if(F.col("rank") <= budget).alias("shown"))
    return ranked.where(F.col("rank") <= budget), shown.join(omitted, "view_id", "left").select("view_id", "shown", F.coalesce("omitted", F.lit(0)).alias("omitted"))
