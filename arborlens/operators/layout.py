"""Placing elements: level columns, grids, a hit index, the next free cell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The width and height of a cell, rows of a column.
CELL_X, CELL_Y, COLUMN_ROWS = 260, 160, 6
#: What an edge crossing costs against a step of distance.
CROSSING = 10_000


def level_columns(levels: DataFrame, rows: int = COLUMN_ROWS) -> DataFrame:
    """levels(view_id, element_id, level) -> x, y: a column for each level, of `rows` rows at most, further ones beside it; by id within a level."""
    w = Window.partitionBy("view_id", "level")
    each = levels.withColumn("r", F.row_number().over(w.orderBy("element_id")) - 1).withColumn("n", F.count("*").over(w))
    wide = levels.groupBy("view_id", "level").agg(F.ceil(F.count("*") / rows).alias("columns"))
    before = wide.withColumn("before", F.sum("columns").over(Window.partitionBy("view_id").orderBy("level")) - F.col("columns")).select("view_id", "level", "before")
    x = (F.col("before") + F.floor(F.col("r") / rows)) * CELL_X
    return each.join(before, ["view_id", "level"]).select("view_id", "element_id", x.cast("long").alias("x"), (F.col("r") % rows * CELL_Y).cast("long").alias("y"))


def grid(placements: DataFrame, columns: int) -> DataFrame:
    """Cells in order of id: x, y and the cell's key."""
    r = F.row_number().over(Window.partitionBy("view_id").orderBy("element_id")) - 1
    col, row = F.col("r") % columns, F.floor(F.col("r") / columns)
    return placements.withColumn("r", r).select("view_id", "element_id", (col * CELL_X).cast("long").alias("x"), (row * CELL_Y).cast("long").alias("y"), F.concat_ws(":", col.cast("string"), row.cast("string")).alias("cell"))


def hit_index(boxes: DataFrame, size: int) -> DataFrame:
    """boxes(element_id, x, y, w, h) -> a row for each square of the index that a box touches: cell_x, cell_y, element_id. A point is then looked up in one square."""
    span = lambda a, w: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(a) + F.col(w)) / size))
    return boxes.withColumn("cell_x", F.explode(span("x", "w"))).withColumn("cell_y", F.explode(span("y", "h"))).select("cell_x", "cell_y", "element_id")


def _crosses(a, b, c, d) -> bool:
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    if len({a, b, c, d}) < 4:
        return False
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def free_cell(pdf: pd.DataFrame, columns: int = 8) -> pd.DataFrame:
    """The best cell for the one new element of a view, for applyInPandas.

    Rows of one view: kind place (element_id, x, y in cells; x null for the new one) and kind edge (source, target). The free cell among
    the rows in use and one more that has the least distance to its neighbours plus CROSSING for each edge crossed; ties by row, then column.
    """
    places = pdf[(pdf["kind"] == "place") & pdf["x"].notna()]
    new = int(pdf[(pdf["kind"] == "place") & pdf["x"].isna()]["element_id"].min())
    at = {int(r.element_id): (int(r.x), int(r.y)) for r in places.itertuples()}
    edges = [(int(r.source), int(r.target)) for r in pdf[pdf["kind"] == "edge"].itertuples()]
    drawn = [(at[s], at[t]) for s, t in edges if s in at and t in at]
    near = [at[t] if s == new else at[s] for s, t in edges if (s == new and t in at) or (t == new and s in at)]
    taken = set(at.values())
    best = None
    for y in range(max((p[1] for p in taken), default=0) + 2):
        for x in range(columns):
            if (x, y) in taken:
                continue
            cost = sum(abs(x - a) + abs(y - b) for a, b in near) + CROSSING * sum(_crosses((x, y), p, c, d) for p in near for c, d in drawn)
            if best is None or cost < best[0]:
                best = cost, x, y
    return pd.DataFrame([(pdf["view_id"].iloc[0], new, best[1], best[2])], columns=["view_id", "element_id", "x", "y"])


def zoom_layout(placements: DataFrame, closure: DataFrame, views: DataFrame, scale: float = 0.25) -> DataFrame:
    """placements(view_id, element_id, x, y) -> x, y, size on one canvas, where a view is drawn inside its owner at `scale`.

    A view's origin is the sum over the views on its way from the root of where each one's owner stands in the view above, each
    in that view's scale; so it is a sum over the lineage, not a walk down the tree.
    """
    height = closure.groupBy("view_id").agg(F.max("depth").alias("d"))
    up = closure.where("depth = 1").select(F.col("view_id").alias("step"), F.col("ancestor_id").alias("above"))
    owner = views.where("owner_element_id is not null").select(F.col("id").alias("step"), F.col("owner_element_id").alias("element_id"))
    stands = up.join(owner, "step").join(placements.select(F.col("view_id").alias("above"), "element_id", "x", "y"), ["above", "element_id"]).join(height.select(F.col("view_id").alias("above"), "d"), "above")
    offset = stands.select("step", (F.col("x") * F.pow(F.lit(scale), "d")).alias("ox"), (F.col("y") * F.pow(F.lit(scale), "d")).alias("oy"))
    origin = closure.select("view_id", F.col("ancestor_id").alias("step")).join(offset, "step", "left").groupBy("view_id").agg(F.coalesce(F.sum("ox"), F.lit(0.0)).alias("ox"), F.coalesce(F.sum("oy"), F.lit(0.0)).alias("oy"))
    size = F.pow(F.lit(scale), "d")
    return placements.join(origin, "view_id").join(height, "view_id").select("view_id", "element_id", F.round(F.col("ox") + F.col("x") * size, 6).alias("x"), F.round(F.col("oy") + F.col("y") * size, 6).alias("y"), size.alias("size"))
