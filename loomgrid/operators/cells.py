"""Polygons cut up by a grid: which cells an edge passes, and an index of a roster whose cells hold only what crosses them.

A cell of the index has, for a unit, the edges that pass it and whether its lower left corner lies inside. From there a point of the cell is reached by a step up
and a step right, and every edge crossed on the way changes the side. So a point meets the few edges of its cell and not its unit's whole outline, and the index grows with the
number of edges. Which side of an edge a corner lies on is asked in one way only, so the two steps never disagree about an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import grid
from loomgrid.operators.spatial import bounds, edges, is_empty, segment_distance

#: Room for rounding, in cells, when an edge is followed through the grid.
_MARGIN = 1e-9


def walked(lines: DataFrame, cell: float, reach: float = 0.0, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """`lines` (x1, y1, x2, y2 and others), a row for each grid cell (cx, cy) that a line passes, or comes within `reach` of; with a `box` (least x and y, greatest x and y) only cells that meet it.

    A line is followed row by row: in each it covers a stretch of x, so a long diagonal passes a number of cells that goes by its length and not by its bounding box.
    Of a box it may get a cell at the border that it does not pass.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    margin = reach + _MARGIN * cell
    bottom, top = F.least(y1, y2), F.greatest(y1, y2)
    if box:
        x_lo, y_lo, x_hi, y_hi = (F.lit(v) for v in box)
        lines = lines.filter((F.greatest(x1, x2) >= x_lo) & (F.least(x1, x2) <= x_hi) & (top >= y_lo) & (bottom <= y_hi))
        bottom, top = F.greatest(bottom, y_lo), F.least(top, y_hi)
    rows = F.sequence(F.floor((bottom - margin) / cell), F.floor((top + margin) / cell))
    each = lines.withColumn("cy", F.explode(rows))
    low, high = F.col("cy") * cell - margin, (F.col("cy") + 1) * cell + margin
    # Where the line enters and leaves the row: a share of its way, between 0 and 1.
    share = lambda y: F.when(y2 != y1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - y1) / (y2 - y1))))
    at_low, at_high = x1 + F.coalesce(share(low), F.lit(0.0)) * (x2 - x1), x1 + F.coalesce(share(high), F.lit(1.0)) * (x2 - x1)
    left, right = F.least(at_low, at_high), F.greatest(at_low, at_high)
    if box:
        left, right = F.least(F.greatest(left, x_lo), x_hi), F.greatest(F.least(right, x_hi), x_lo)
    return each.withColumn("cx", F.explode(F.sequence(F.floor((left - margin) / cell), F.floor((right + margin) / cell))))


def left_of(x: Column, y: Column, e: dict[str, Column]) -> Column:
    """Whether the point lies left of an edge as seen along it; the one test of sides.

    A point on an edge is taken to lie a little higher, and much less to the right, as in the comparisons that ask whether an edge spans it.
    """
    east, north = e["x2"] - e["x1"], e["y2"] - e["y1"]
    cross = east * (y - e["y1"]) - north * (x - e["x1"])
    return (cross > 0) | ((cross == 0) & ((east > 0) | ((east == 0) & (north < 0))))


def grid_for(units: DataFrame) -> float:
    """The side of a cell that gives a roster about as many cells as it has edges, so that the index grows in proportion to them."""
    boxed = units.filter(~is_empty(F.col("rings"))).select(F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r["points"])).alias("n"), *[c.alias(k) for k, c in bounds(F.col("rings")).items()])
    found = boxed.agg(F.sum("n").alias("n"), F.sum((F.col("x_hi") - F.col("x_lo")) * (F.col("y_hi") - F.col("y_lo"))).alias("area")).first()
    side = (found["area"] / max(4, found["n"])) ** 0.5 if found["area"] else 0.0
    return side if 0 < side < float("inf") else 1.0


def roster_index(units: DataFrame, cell: float) -> DataFrame:
    """(cx, cy, AREA_CODE, corner, edges): for each unit the cells that it meets; `corner` says whether the cell's lower left corner lies inside, `edges` has what passes the cell."""
    e = edges(units.select(F.col("AREA_CODE").alias("id"), "rings")).select(F.col("id").alias("AREA_CODE"), "x1", "y1", "x2", "y2")
    edge = F.struct("x1", "y1", "x2", "y2")
    passing = walked(e, cell).select("AREA_CODE", "cx", "cy", edge.alias("edge"), F.lit(False).alias("inside"))
    # Along the line below each row of cells: the first corner that has an edge behind it, for every edge that crosses the line. Corners from an odd one to the next lie inside.
    crossing = e.filter("y1 <> y2").withColumn("cy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))
    line = F.col("cy") * cell
    crossing = crossing.filter((F.col("y1") > line) != (F.col("y2") > line))
    near = F.round((F.col("x1") + (line - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))) / cell).cast("long")
    own = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    # A point lies to the right of an edge that climbs if it is not to its left as seen along it, and the other way round.
    beyond = left_of(F.col("near") * cell, line, own) == (F.col("y2") < F.col("y1"))
    crossing = crossing.withColumn("near", near).withColumn("from", F.when(beyond, F.col("near")).otherwise(F.col("near") + 1))
    starts = crossing.groupBy("AREA_CODE", "cy").agg(F.array_sort(F.collect_list("from")).alias("at"))
    stretch = F.expr("filter(transform(sequence(0, size(at) div 2 - 1), i -> struct(at[2 * i] as a, at[2 * i + 1] - 1 as b)), s -> s.a <= s.b)")
    inside = starts.filter("size(at) > 1").withColumn("s", F.explode(stretch))
    inside = inside.select("AREA_CODE", F.explode(F.sequence("s.a", "s.b")).alias("cx"), "cy", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>").alias("edge"), F.lit(True).alias("inside"))
    return passing.unionByName(inside).groupBy("AREA_CODE", "cx", "cy").agg(F.bool_or("inside").alias("corner"), F.collect_list("edge").alias("edges"))  # a list leaves nulls out


def within(corner: Column, edge_list: Column, x: Column, y: Column, x0: Column, y0: Column) -> Column:
    """Whether a point lies inside and not on the boundary, by the edges of its cell with the lower left corner (x0, y0)."""

    def step(acc: Column, e: Column) -> Column:
        own = {c: e[c] for c in ("x1", "y1", "x2", "y2")}
        start, turn, end = left_of(x0, y0, own), left_of(x0, y, own), left_of(x, y, own)
        up = ((own["x1"] > x0) != (own["x2"] > x0)) & (start != turn)
        right = ((own["y1"] > y) != (own["y2"] > y)) & (turn != end)
        cross = (own["x2"] - own["x1"]) * (y - own["y1"]) - (own["y2"] - own["y1"]) * (x - own["x1"])
        on = (cross == 0) & x.between(F.least(own["x1"], own["x2"]), F.greatest(own["x1"], own["x2"])) & y.between(F.least(own["y1"], own["y2"]), F.greatest(own["y1"], own["y2"]))
        return F.struct((acc["odd"] != (up != right)).alias("odd"), (acc["on"] | on).alias("on"))

    found = F.aggregate(edge_list, F.struct(corner.alias("odd"), F.lit(False).alias("on")), step)
    return found["odd"] & ~found["on"]


def locate(points: DataFrame, units: DataFrame, cell: float | None = None, how: str = "left", most: int | None = None) -> DataFrame:
    """Adds AREA_CODE: the unit that a point (x, y) lies within, the least code if several; null outside all (`left`), or left out (`inner`).

    A cell of the index is one row with its units, so points are never multiplied. The index is broadcast if it has at most `most` edges and cells (points are not shuffled then); beyond
    that points meet it by an equality join on the cell, which the optimiser splits at a crowded one. The cell is derived from the roster unless given.
    """
    cell = cell or grid_for(units)
    index = roster_index(units, cell)
    size = index.agg(F.coalesce(F.sum(F.size("edges") + 1), F.lit(0)).alias("n")).first()["n"]
    by_cell = index.groupBy("cx", "cy").agg(F.collect_list(F.struct("AREA_CODE", "corner", "edges")).alias("units_here"))
    by_cell = F.broadcast(by_cell) if size <= (grid.BROADCAST_ROWS if most is None else most) else by_cell
    x, y = F.col("x"), F.col("y")
    at = points.withColumns({"cx": F.floor(x / cell), "cy": F.floor(y / cell)})
    inside = F.filter("units_here", lambda u: within(u["corner"], u["edges"], x, y, F.col("cx") * cell, F.col("cy") * cell))
    found = at.join(by_cell, ["cx", "cy"], how).withColumn("AREA_CODE", F.array_min(F.transform(inside, lambda u: u["AREA_CODE"]))).drop("cx", "cy", "units_here")
    return found if how == "left" else found.filter("AREA_CODE is not null")


def snap(points: DataFrame, units: DataFrame, most: float) -> DataFrame:
    """(p_id, AREA_CODE, DISTANCE): the unit whose boundary is nearest to a point outside all units, if within `most`; distances equal to nine decimals are a tie, which goes by code.

    Edges are followed through a grid of cells of the size `most`, with those within reach of them, so a point meets near edges only.
    """
    reach = walked(edges(units.select(F.col("AREA_CODE").alias("id"), "rings")), most, most).withColumnRenamed("id", "AREA_CODE").drop("ring", "e", "side")
    at = points.withColumns({"cx": F.floor(F.col("x") / most), "cy": F.floor(F.col("y") / most)})
    far = at.join(reach, ["cx", "cy"]).withColumn("d", segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]))
    return far.filter(F.col("d") <= most).groupBy("p_id").agg(F.min(F.struct(F.round("d", 9).alias("d"), "AREA_CODE")).alias("m")).select("p_id", F.col("m.AREA_CODE"), F.col("m.d").alias("DISTANCE"))
