"""What a layer and a roster share besides area: contacts along edges and in corners, and the lengths of lines inside units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.cells import grid_for, locate, walked
from loomgrid.operators.grid import bounded, merged
from loomgrid.operators.spatial import bounds, edges, is_empty, overlap

_XY = ("x1", "y1", "x2", "y2")


def _turn(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    return (bx - ax) * (y - ay) - (by - ay) * (x - ax)


def _extent(units: DataFrame) -> tuple[float, float, float, float] | None:
    """Least x and y, greatest x and y of a roster."""
    b = bounds(F.col("rings"))
    found = units.filter(~is_empty(F.col("rings"))).agg(F.min(b["x_lo"]), F.min(b["y_lo"]), F.max(b["x_hi"]), F.max(b["y_hi"])).first()
    return None if None in found else tuple(found)


def contacts(layer: DataFrame, units: DataFrame) -> DataFrame:
    """(id, AREA_CODE, LENGTH): the boundary that a feature and a unit have in common, for every pair whose boundaries meet; 0 where they meet in points only.

    Edges of either side are followed through one grid, within the roster's extent, and meet by equality on the cells that both pass; the roster's are broadcast, so nothing is shuffled
    but what meets. Stretches count where edges lie on one line exactly, as neighbours do that were drawn with the same corners.
    """
    cell, extent = grid_for(units), _extent(units)

    def drawn(features: DataFrame, key: str, mark: str) -> DataFrame:
        return walked(edges(features, key), cell, box=extent).select(key, "cx", "cy", F.struct("ring", "e").alias(f"{mark}_edge"), *[F.col(c).alias(f"{mark}_{c}") for c in _XY])

    mine, theirs = [F.col(f"l_{c}") for c in _XY], [F.col(f"u_{c}") for c in _XY]
    span = lambda a, b, c, d: F.least(F.greatest(a, b), F.greatest(c, d)) - F.greatest(F.least(a, b), F.least(c, d))
    dx, dy = span(mine[0], mine[2], theirs[0], theirs[2]), span(mine[1], mine[3], theirs[1], theirs[3])
    met = drawn(layer, "id", "l").join(bounded(drawn(units, "AREA_CODE", "u")), ["cx", "cy"]).filter((dx >= 0) & (dy >= 0)).drop("cx", "cy").repartition("id", "AREA_CODE")
    # From here on no row leaves its partition: the comparison of two edges is compiled apart from the walk, as the compiler skips methods that are too long.
    u1, u2, l1, l2 = _turn(*mine, *theirs[:2]), _turn(*mine, *theirs[2:]), _turn(*theirs, *mine[:2]), _turn(*theirs, *mine[2:])
    on_line = (u1 == 0) & (u2 == 0) & (l1 == 0) & (l2 == 0)
    meets = (F.signum(u1) * F.signum(u2) <= 0) & (F.signum(l1) * F.signum(l2) <= 0)
    length = F.when(on_line, F.sqrt(dx * dx + dy * dy)).when(meets, 0.0)
    # Edges may share several cells, and their stretch counts once; points add nothing, however often they come.
    stretch = met.select("id", "AREA_CODE", "l_edge", "u_edge", length.alias("LENGTH")).withColumn("edges", F.when(F.col("LENGTH") > 0, F.struct("l_edge", "u_edge")))
    once = stretch.groupBy("id", "AREA_CODE", "edges").agg(F.max("LENGTH").alias("LENGTH"))
    return once.groupBy("id", "AREA_CODE").agg(F.sum("LENGTH").alias("LENGTH")).filter("LENGTH is not null")


def fragments(layer: DataFrame, units: DataFrame, tile: float = 1.0) -> DataFrame:
    """(id, AREA_CODE, KIND, OVERLAP, LENGTH): one row for each feature and unit that have a point in common.

    KIND is `area` where they share some; else `line` where they share a stretch of boundary, of that LENGTH, or `point`. OVERLAP is 0 for the latter two, LENGTH for `area`.
    """
    shared = overlap(layer, units, tile)
    touching = contacts(layer, units).join(merged(shared.select("id", "AREA_CODE")), ["id", "AREA_CODE"], "left_anti")
    touching = touching.select("id", "AREA_CODE", F.when(F.col("LENGTH") > 0, "line").otherwise("point").alias("KIND"), F.lit(0.0).alias("OVERLAP"), "LENGTH")
    return shared.select("id", "AREA_CODE", F.lit("area").alias("KIND"), "OVERLAP", F.lit(0.0).alias("LENGTH")).unionByName(touching)


def segments(lines: DataFrame, key: str = "id", rings: str = "rings") -> DataFrame:
    """(key, part, e, x1, y1, x2, y2): the straight pieces of lines, which are not closed."""
    each = lines.filter(~is_empty(F.col(rings))).select(key, F.posexplode(rings).alias("part", "r")).filter(F.size("r.points") > 1)
    n = F.size("r.points")
    pair = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("r.points", i).alias("p"), F.get("r.points", i + 1).alias("q")))
    each = each.select(key, "part", F.posexplode(pair).alias("e", "s"))
    return each.select(key, "part", "e", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def line_lengths(lines: DataFrame, units: DataFrame) -> DataFrame:
    """(id, AREA_CODE, LENGTH): how much of each line lies inside each unit.

    A straight piece is cut wherever it crosses an edge of the roster, at shares of its way; between two cuts it lies in one unit or in none, and the unit of its middle says in which, the
    least code where units overlap. What runs along a boundary is in no unit. Pieces meet edges by equality on the cells that both pass.
    """
    cell = grid_for(units)
    pieces = segments(lines).filter("x1 <> x2 or y1 <> y2")
    drawn = walked(edges(units.select(F.col("AREA_CODE").alias("id"), "rings")), cell).select("cx", "cy", F.struct("id", "ring", "e").alias("u_edge"), *[F.col(c).alias(f"u_{c}") for c in _XY])
    met = walked(pieces, cell).join(drawn, ["cx", "cy"])
    mine, theirs = [F.col(c) for c in _XY], [F.col(f"u_{c}") for c in _XY]
    a, b, c, d = _turn(*theirs, *mine[:2]), _turn(*theirs, *mine[2:]), _turn(*mine, *theirs[:2]), _turn(*mine, *theirs[2:])
    met = met.filter((F.signum(a) * F.signum(b) <= 0) & (F.signum(c) * F.signum(d) <= 0) & (a != b)).withColumn("cut", a / (a - b))
    # Collinear edges give no cut of their own: the edges before and after them do.
    cuts = met.groupBy("id", "part", "e").agg(F.collect_set("cut").alias("cuts"))
    whole = pieces.join(cuts, ["id", "part", "e"], "left").withColumn("cuts", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("cuts", F.array().cast("array<double>"))))))
    stretch = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), lambda s, i: F.struct(s.alias("s"), F.get("cuts", i + 1).alias("t")))
    cut = whole.withColumn("w", F.explode(stretch)).select("id", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2).alias("full"), ((F.col("w.s") + F.col("w.t")) / 2).alias("m"), (F.col("w.t") - F.col("w.s")).alias("share"), *_XY)
    middle = cut.select("id", (F.col("full") * F.col("share")).alias("LENGTH"), (F.col("x1") + F.col("m") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("m") * (F.col("y2") - F.col("y1"))).alias("y"))
    return locate(middle, units, how="inner").groupBy("id", "AREA_CODE").agg(F.sum("LENGTH").alias("LENGTH"))


def annual(lengths: DataFrame, years: tuple[int, ...], since: str = "SINCE", until: str | None = None) -> DataFrame:
    """(AREA_CODE, YEAR, LENGTH): what stands in each declared year, from rows (AREA_CODE, LENGTH, `since`[, `until`]) that say in which years each line stands.

    Lengths are added up by the year they begin and end in and then run through the years, so a line is one row however long it stands. A null `since` stood from the start, a null `until` stands still.
    """
    first = F.coalesce(F.greatest(F.col(since), F.lit(years[0])), F.lit(years[0]))
    gained = lengths.select("AREA_CODE", first.alias("YEAR"), F.col("LENGTH").alias("step"))
    steps = gained if until is None else gained.unionByName(lengths.filter(F.col(until).isNotNull()).select("AREA_CODE", F.greatest(F.col(until) + 1, first).alias("YEAR"), (-F.col("LENGTH")).alias("step")))
    spark = lengths.sparkSession
    listed = spark.createDataFrame([(y,) for y in years], "YEAR int")
    summed = steps.filter(F.col("YEAR") <= years[-1]).groupBy("AREA_CODE", "YEAR").agg(F.sum("step").alias("step"))
    grid = summed.select("AREA_CODE").distinct().crossJoin(F.broadcast(listed))  # units by declared years
    run = Window.partitionBy("AREA_CODE").orderBy("YEAR").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(summed, ["AREA_CODE", "YEAR"], "left").select("AREA_CODE", "YEAR", F.coalesce(F.sum("step").over(run), F.lit(0.0)).alias("LENGTH"))
