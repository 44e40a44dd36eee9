"""Planar geometry as column expressions and joins: areas, containment, overlap, nearest edge.

A polygon feature is (id, rings), rings an ARRAY<STRUCT<hole BOOLEAN, points ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>>; a ring may or may not repeat its
first point. Multi-part features have several rings that are no holes. Areas ask for valid polygons; `operators.validity` finds
those that are not and replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.grid import bounded, merged

RINGS = "array<struct<hole:boolean,points:array<struct<x:double,y:double>>>>"


class GeometryError(ValueError):
    """A layer that does not hold what it is declared to hold."""


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Rings of a rectangle."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.struct(F.lit(False).alias("hole"), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("points")))


def _turn(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def neighbours(points: Column) -> Column:
    """Pairs of consecutive points, closing the ring."""
    n = F.size(points)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(points, i).alias("p"), F.get(points, (i + 1) % n).alias("q")))


def ring_area(points: Column) -> Column:
    """Signed area of a ring, positive counter-clockwise."""
    return F.when(F.size(points) > 2, F.aggregate(neighbours(points), F.lit(0.0), lambda acc, e: acc + _turn(e["p"], e["q"])) / 2).otherwise(0.0)


def area(rings: Column) -> Column:
    """Area of a feature: its rings less its holes."""
    return F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + F.when(r["hole"], -1).otherwise(1) * F.abs(ring_area(r["points"])))


def is_empty(rings: Column) -> Column:
    return rings.isNull() | (F.size(rings) <= 0)


def edges(features: DataFrame, key: str = "id", rings: str = "rings") -> DataFrame:
    """(key, ring, e, x1, y1, x2, y2, side): one row per edge. `side` is 1 or -1 so that summing side times the area under edges gives the feature's area."""
    each = features.select(key, F.posexplode(rings).alias("ring", "r")).filter(F.size("r.points") > 2)
    turned = F.signum(ring_area(F.col("r.points"))) * F.when(F.col("r.hole"), -1).otherwise(1)
    each = each.select(key, "ring", turned.alias("t"), F.posexplode(neighbours(F.col("r.points"))).alias("e", "s"))
    xy = each.select(key, "ring", "e", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"), "t")
    return xy.withColumn("side", F.col("t") * F.signum(F.col("x1") - F.col("x2"))).drop("t")


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside and not on the boundary: odd crossings of a ray, and on no edge."""

    def step(acc: Column, e: Column) -> Column:
        x1, y1, x2, y2 = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
        spans = (y1 > y) != (y2 > y)
        crosses = F.when(spans, x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)).otherwise(False)
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        touches = (cross == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
        return F.struct((acc["odd"] != crosses).alias("odd"), (acc["on"] | touches).alias("on"))

    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on"))
    all_edges = F.flatten(F.transform(rings, lambda r: neighbours(r["points"])))
    found = F.aggregate(all_edges, start, step)
    return found["odd"] & ~found["on"]


def bounds(rings: Column) -> dict[str, Column]:
    points = F.flatten(F.transform(rings, lambda r: r["points"]))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"x_lo": F.array_min(xs), "y_lo": F.array_min(ys), "x_hi": F.array_max(xs), "y_hi": F.array_max(ys)}


def cell_size(units: DataFrame) -> float:
    """The side of a grid cell that fits a roster: the mean side of the units' bounding boxes, so a unit meets about four cells on average."""
    sides = units.filter(~is_empty(F.col("rings"))).select(*bounds(F.col("rings")).values()).toDF("x0", "y0", "x1", "y1")
    mean = sides.agg(F.avg((F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")) / 2)).first()[0]
    return mean if mean and mean > 0 else 1.0


def unit_cells(units: DataFrame, cell: float) -> DataFrame:
    """Units with the grid cells that their bounding boxes meet; a roster of units is declared and small."""
    boxed = units.filter(~is_empty(F.col("rings"))).withColumns(bounds(F.col("rings")))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    return boxed.withColumn("cx", F.explode(span("x_lo", "x_hi"))).withColumn("cy", F.explode(span("y_lo", "y_hi")))


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length))).otherwise(0.0)
    return F.sqrt((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2)


def box_pairs(layer: DataFrame, units: DataFrame) -> DataFrame:
    """(id, AREA_CODE, x_from, x_to, y_base, least_area): features and units whose bounding boxes share an area, by an equality join on the roster's grid cells."""
    cell = cell_size(units)
    theirs = unit_cells(units, cell).select("AREA_CODE", "cx", "cy", *[F.col(c).alias(f"u_{c}") for c in ("x_lo", "x_hi", "y_lo", "y_hi")], area(F.col("rings")).alias("u_area"))
    mine = unit_cells(layer, cell).select("id", "cx", "cy", "x_lo", "x_hi", "y_lo", "y_hi", area(F.col("rings")).alias("area"))
    # A pair may share several cells; the one where the boxes' common corner lies counts it.
    corner = (F.col("cx") == F.floor(F.greatest("x_lo", "u_x_lo") / cell)) & (F.col("cy") == F.floor(F.greatest("y_lo", "u_y_lo") / cell))
    met = mine.join(bounded(theirs), ["cx", "cy"]).filter(corner & (F.col("x_lo") < F.col("u_x_hi")) & (F.col("u_x_lo") < F.col("x_hi")) & (F.col("y_lo") < F.col("u_y_hi")) & (F.col("u_y_lo") < F.col("y_hi")))
    return met.select("id", "AREA_CODE", F.greatest("x_lo", "u_x_lo").alias("x_from"), F.least("x_hi", "u_x_hi").alias("x_to"), F.least("y_lo", "u_y_lo").alias("y_base"), F.least("area", "u_area").alias("least_area"))


#: An overlap counts if it exceeds this share of the smaller of the two areas; what lies below is rounding.
LEAST_SHARE = 1e-9


def overlap(layer: DataFrame, units: DataFrame, tile: float = 1.0) -> DataFrame:
    """(id, AREA_CODE, OVERLAP): area shared by each feature and unit, where it is positive.

    Only pairs whose bounding boxes meet are compared, each within the boxes' common stretch of x and with heights from its own least y, so that
    large coordinates do not cancel. Both areas are sums of signed trapezoids under edges; the shared area is the sum over a pair's edges of the area
    under the lower of the two. Edges meet by an equality join on the pair and a tile of x. Only the roster is broadcast.
    """
    pairs = box_pairs(layer, units)

    def cut(features: DataFrame, key: str, mark: str) -> DataFrame:
        e = edges(features.select(F.col(key).alias("id"), "rings")).filter("side <> 0").withColumnRenamed("id", key)
        e = pairs.join(bounded(e) if key == "AREA_CODE" else merged(e), key)
        lo, hi = F.greatest(F.least("x1", "x2"), F.col("x_from")), F.least(F.greatest("x1", "x2"), F.col("x_to"))
        e = e.withColumns({"lo": lo, "hi": hi}).filter("lo < hi")
        e = e.withColumn("tile", F.explode(F.sequence(F.floor((F.col("lo") - F.col("x_from")) / tile), F.floor((F.col("hi") - F.col("x_from")) / tile))))
        slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
        a, b = F.greatest("lo", F.col("x_from") + F.col("tile") * tile), F.least("hi", F.col("x_from") + (F.col("tile") + 1) * tile)
        height = lambda x: F.col("y1") - F.col("y_base") + (x - F.col("x1")) * slope
        kept = ["id", "AREA_CODE", "tile", "least_area"] if mark == "l" else ["id", "AREA_CODE", "tile"]
        return e.select(*kept, F.col("side").alias(f"{mark}s"), a.alias(f"{mark}a"), b.alias(f"{mark}b"), height(a).alias(f"{mark}p"), height(b).alias(f"{mark}q")).filter(f"{mark}b > {mark}a")

    met = cut(layer, "id", "l").join(merged(cut(units, "AREA_CODE", "u")), ["id", "AREA_CODE", "tile"]).withColumns({"a": F.greatest("la", "ua"), "b": F.least("lb", "ub")}).filter("b > a")
    on = lambda m, x: F.col(f"{m}p") + (F.col(f"{m}q") - F.col(f"{m}p")) * (F.col(x) - F.col(f"{m}a")) / (F.col(f"{m}b") - F.col(f"{m}a"))
    met = met.withColumns({"l0": on("l", "a"), "l1": on("l", "b"), "u0": on("u", "a"), "u1": on("u", "b")})
    d0, d1 = F.col("u0") - F.col("l0"), F.col("u1") - F.col("l1")
    m0, m1 = F.least("l0", "u0"), F.least("l1", "u1")
    t = F.when(d0 * d1 < 0, d0 / (d0 - d1)).otherwise(0.0)
    middle = F.col("l0") + (F.col("l1") - F.col("l0")) * t
    under = (F.col("b") - F.col("a")) * F.when(d0 * d1 < 0, (t * (m0 + middle) + (1 - t) * (middle + m1)) / 2).otherwise((m0 + m1) / 2)
    summed = met.withColumn("w", F.col("ls") * F.col("us") * under).groupBy("id", "AREA_CODE").agg(F.sum("w").alias("OVERLAP"), F.max("least_area").alias("least_area"))
    return summed.filter(F.col("OVERLAP") > F.lit(LEAST_SHARE) * F.col("least_area")).drop("least_area")


def explode_points(features: DataFrame) -> DataFrame:
    """(id, part, x, y): one row for each point of a multi-point feature (id, points)."""
    return features.select("id", F.posexplode("points").alias("part", "p")).select("id", "part", "p.x", "p.y")


def assert_geometry(layer: DataFrame, allowed: tuple[str, ...], column: str = "geom_type") -> None:
    """Every non-null geometry is of an allowed kind."""
    found = {r[0] for r in layer.select(column).filter(F.col(column).isNotNull()).distinct().limit(20).collect()}
    if not found <= set(allowed):
        raise GeometryError(f"{sorted(found - set(allowed))} in a layer of {sorted(allowed)}")
