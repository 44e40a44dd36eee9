"""Well-known binary, the roster's index, contacts and repairs of polygons, lines inside units, and models of counts, against plain versions."""

import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid import queries
from loomgrid.operators import cells, grid, models, overlay, spatial, validity
from loomgrid.sources import wkb

SHAPES = [
    ("POINT", [(1.5, -2.0)], None), ("MULTIPOINT", [(1.0, 2.0), (3.0, 4.0)], None), ("LINESTRING", None, [(False, [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)])]),
    ("MULTILINESTRING", None, [(False, [(0.0, 0.0), (1.0, 1.0)]), (False, [(5.0, 5.0), (6.0, 6.0)])]),
    ("POLYGON", None, [(False, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]), (True, [(1.0, 0.5), (2.0, 0.5), (2.0, 1.0), (1.0, 0.5)])]),
    ("MULTIPOLYGON", None, [(False, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (False, [(5.0, 5.0), (9.0, 5.0), (9.0, 9.0)]), (True, [(7.0, 6.0), (8.0, 6.0), (8.0, 7.0)])]), ("POINT", [], None),
]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind,points,rings", SHAPES)
def test_wkb_round_trip(kind, points, rings, order):
    assert wkb.decoded(wkb.encoded(kind, points, rings, order)) == (kind, points, rings)


def test_wkb_of_other_makers():
    assert wkb.decoded(bytes.fromhex("0101000000000000000000f03f0000000000000040")) == ("POINT", [(1.0, 2.0)], None)
    assert wkb.decoded(bytes.fromhex("00000000013ff00000000000004000000000000000")) == ("POINT", [(1.0, 2.0)], None)
    assert wkb.decoded(struct.pack("<BIIddd", 1, 0xA0000001, 4326, 1.0, 2.0, 9.0)) == ("POINT", [(1.0, 2.0)], None)  # a reference system and a height
    assert wkb.decoded(struct.pack("<BIdddd", 1, 3001, 1.0, 2.0, 9.0, 8.0)) == ("POINT", [(1.0, 2.0)], None)
    mixed = struct.pack("<BII", 1, 4, 2) + struct.pack(">BIdd", 0, 1, 1.0, 2.0) + struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    assert wkb.decoded(mixed) == ("MULTIPOINT", [(1.0, 2.0), (3.0, 4.0)], None)
    for bad in (b"", b"\1\1\0\0\0", struct.pack("<BIdd", 1, 1, 0, 0) + b"x", struct.pack("<BII", 1, 7, 0), struct.pack("<BII", 1, 4, 1) + struct.pack("<BII", 1, 2, 0)):
        with pytest.raises(spatial.GeometryError):
            wkb.decoded(bad)


def test_wkb_columns(spark):
    rows = [(i, wkb.encoded(*s)) for i, s in enumerate(SHAPES)] + [(99, None)]
    table = spark.createDataFrame(rows, "id int, geometry binary")
    found = wkb.decode(table)
    assert [(r.id, r.geom_type) for r in found.orderBy("id").collect()] == [*[(i, s[0]) for i, s in enumerate(SHAPES)], (99, None)]
    assert sorted(map(tuple, wkb.encode(found).collect())) == sorted(rows)
    points = table.filter("id in (0, 6)")
    assert [len(r.points) for r in wkb.decode(points).orderBy("id").collect()] == [1, 0] and wkb.decode(points.limit(0)).count() == 0
    assert wkb.decode(points.filter("id = 0")).first().points[0].asDict() == {"x": 1.5, "y": -2.0}


def star(rng, x, y, size, n):
    """A ring with corners at random distances, some of them on whole numbers."""
    out = []
    for k in range(n):
        r, turn = size * rng.uniform(0.3, 1), 2 * math.pi * k / n
        p = (x + r * math.cos(turn), y + r * math.sin(turn))
        out.append((float(round(p[0])), float(round(p[1]))) if rng.random() < 0.3 else p)
    return out


def roster(spark, seed=3, corners=14):
    rng = random.Random(seed)
    units = [(f"U{i}", [(False, star(rng, 20 * (i % 3), 20 * (i // 3), 12, corners))]) for i in range(9)]
    units += [("B1", [(False, [(60.0, 0.0), (70.0, 0.0), (70.0, 10.0), (60.0, 10.0)]), (True, [(62.0, 2.0), (62.0, 8.0), (68.0, 8.0), (68.0, 2.0)])]), ("B2", [(False, [(60.0, 10.0), (60.0, 20.0), (70.0, 20.0), (70.0, 10.0)]), (False, [(80.0, 0.0), (90.0, 0.0), (85.0, 5.0)])])]
    return spark.createDataFrame(units, f"AREA_CODE string, rings {spatial.RINGS}")


@pytest.mark.parametrize("cell", [None, 1.0, 5.0, 7.3, 200.0])
@pytest.mark.parametrize("most", [None, 0])
def test_points_in_the_index_equal_the_whole_outline(spark, cell, most):
    rng = random.Random(8)
    at = [(rng.uniform(-15, 95), rng.uniform(-15, 55)) for _ in range(300)] + [(float(x), float(y)) for x in range(-10, 92, 3) for y in range(-10, 50, 5)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "p_id int, x double, y double")
    units = roster(spark)
    met = points.crossJoin(units).filter(spatial.contains(F.col("rings"), F.col("x"), F.col("y"))).groupBy("p_id").agg(F.min("AREA_CODE").alias("c"))
    want = {r.p_id: r.c for r in met.collect()}
    got = {r.p_id: r.AREA_CODE for r in cells.locate(points, units, cell, most=most).collect()}
    assert len(got) == len(at) and {k: v for k, v in got.items() if v} == want and len(want) > 150
    assert {r.p_id: r.AREA_CODE for r in cells.locate(points, units, cell, "inner", most).collect()} == want


def test_the_index_grows_with_the_edges(spark):
    size = lambda u: cells.roster_index(u, cells.grid_for(u)).agg(F.sum(F.size("edges") + 1)).first()[0]
    ring = lambda n: spark.createDataFrame([(f"U{k}", [(False, [(100 * k + 40 * math.cos(2 * math.pi * i / n), 40 * math.sin(2 * math.pi * i / n)) for i in range(n)])]) for k in range(4)], f"AREA_CODE string, rings {spatial.RINGS}")
    few, many = size(ring(500)), size(ring(4000))
    assert few < 6 * 4 * 500 and many < 6 * 4 * 4000 and many / few < 9


def test_edges_are_walked_and_not_boxed(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 7071.0, 7071.0), (2, 0.0, 3.0, 9.0, 3.0), (3, 4.0, 0.0, 4.0, 9.0), (4, 2.0, 2.0, 2.0, 2.0)], "id int, x1 double, y1 double, x2 double, y2 double")
    counts = {r.id: r["count"] for r in cells.walked(lines, 5.0).groupBy("id").count().collect()}
    assert 1415 <= counts[1] <= 4 * 1415 and 2 <= counts[2] <= 3 and 2 <= counts[3] <= 3 and counts[4] == 1  # an end on a grid line is in both cells
    met = {(r.cx, r.cy) for r in cells.walked(lines.filter("id = 1"), 5.0, 5.0).collect()}
    assert {(k, k + s) for k in range(1414) for s in (-1, 0, 1)} <= met and len(met) < 10 * 1415


def test_snapping_to_long_edges(spark):
    units = spark.createDataFrame([("A", [(False, [(0.0, 0.0), (900.0, 700.0), (0.0, 700.0)])])], f"AREA_CODE string, rings {spatial.RINGS}")
    rng = random.Random(1)
    at = [(rng.uniform(0, 900), rng.uniform(-20, 700)) for _ in range(400)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "p_id int, x double, y double")
    lost = cells.locate(points, units).filter("AREA_CODE is null").drop("AREA_CODE")
    got = {r.p_id: r.DISTANCE for r in cells.snap(lost, units, 5.0).collect()}
    far = {i: (700 * x - 900 * y) / math.hypot(700, 900) for i, (x, y) in enumerate(at)}
    want = {i: d for i, d in far.items() if 0 <= d <= 5}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-8 for i in want) and len(want) > 2


def test_fragments_by_kind(spark):
    box = lambda x, y, w, h: [(False, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)])]
    units = spark.createDataFrame([("A", box(0.0, 0.0, 10.0, 10.0)), ("B", box(10.0, 0.0, 10.0, 10.0))], f"AREA_CODE string, rings {spatial.RINGS}")
    layer = [(1, box(8.0, 8.0, 4.0, 1.0)), (2, box(2.0, 10.0, 3.0, 2.0)), (3, box(10.0, 10.0, 5.0, 5.0)), (4, box(20.0, 10.0, 1.0, 1.0)), (5, box(30.0, 0.0, 1.0, 1.0)), (6, [(False, [(5.0, 12.0), (6.0, 10.0), (7.0, 12.0)])]), (7, box(0.0, 2.0, 10.0, 2.0))]
    found = overlay.fragments(spark.createDataFrame(layer, f"id int, rings {spatial.RINGS}"), units, 5.0)
    assert sorted((r.id, r.AREA_CODE, r.KIND, round(r.OVERLAP, 9), r.LENGTH) for r in found.collect()) == [
        (1, "A", "area", 2, 0), (1, "B", "area", 2, 0), (2, "A", "line", 0, 3), (3, "A", "point", 0, 0), (3, "B", "line", 0, 5), (4, "B", "point", 0, 0), (6, "A", "point", 0, 0), (7, "A", "area", 20, 0), (7, "B", "line", 0, 2)]


def plain_contacts(layer, units):
    """Lengths of common boundary by comparing every edge with every other, in whole numbers."""
    edges_of = lambda rings: [e for _, r in rings for e in zip(r, r[1:] + r[:1], strict=True)]
    turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    sign = lambda v: (v > 0) - (v < 0)
    out = {}
    for i, rings in layer:
        for code, others in units:
            for a, b in edges_of(rings):
                for c, d in edges_of(others):
                    dx, dy = (min(max(a[k], b[k]), max(c[k], d[k])) - max(min(a[k], b[k]), min(c[k], d[k])) for k in (0, 1))
                    sides = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
                    if dx >= 0 and dy >= 0 and sign(sides[0]) * sign(sides[1]) <= 0 and sign(sides[2]) * sign(sides[3]) <= 0:
                        out[i, code] = out.get((i, code), 0.0) + (math.hypot(dx, dy) if not any(sides) else 0.0)
    return out


def test_contacts_are_those_of_all_edges(spark, monkeypatch):
    """Slanted shapes and boxes, one far beyond the roster, and a roster that is too large to broadcast."""
    rng = random.Random(7)
    box = lambda x, y, w, h: [(False, [(x, y), (x + w, y), (x + w, y + h), (x, y + h)])]
    shape = lambda: [(False, [(rng.randint(0, 40), rng.randint(0, 20)) for _ in range(rng.randint(3, 5))])]
    units = [(f"U{i}{j}", box(i * 10, j * 4, 10, 4)) for i in range(3) for j in range(3)] + [("V", shape()), ("W", shape())]
    layer = [(i, shape()) for i in range(60)] + [(100 + i, box(rng.randint(0, 40), rng.randint(0, 20), rng.randint(1, 30), rng.randint(1, 6))) for i in range(60)]
    layer += [(200, box(-3_000_000, -5, 6_000_000, 9)), (201, [(False, [(-3_000_000, -3_000_000), (3_000_000, 3_000_000), (3_000_000, -7)])]), (202, box(31, 0, 5, 5)), (203, [(False, [(0, 0), (1, 1)])])]
    float_rings = lambda rings: [(hole, [(float(x), float(y)) for x, y in r]) for hole, r in rings]
    features = spark.createDataFrame([(i, float_rings(r)) for i, r in layer] + [(300, None)], f"id int, rings {spatial.RINGS}")
    roster = spark.createDataFrame([(c, float_rings(r)) for c, r in units], f"AREA_CODE string, rings {spatial.RINGS}")
    want = plain_contacts([f for f in layer if f[0] != 203], units)
    assert sum(v > 0 for v in want.values()) > 50 and sum(v == 0 for v in want.values()) > 50
    for rows in (grid.BROADCAST_ROWS, 0):
        monkeypatch.setattr(grid, "BROADCAST_ROWS", rows)
        got = {(r.id, r.AREA_CODE): r.LENGTH for r in overlay.contacts(features, roster).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert overlay.contacts(features, roster.limit(0)).isEmpty()


def test_lines_are_walked_within_a_box(spark):
    rng = random.Random(3)
    at = [tuple(rng.uniform(-90, 90) for _ in range(4)) for _ in range(40)] + [(-40.0, 7.0, 60.0, 7.0), (3.0, -50.0, 3.0, 50.0), (-1e9, -1e9, 1e9, 1e9 + 5)]
    lines = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id int, x1 double, y1 double, x2 double, y2 double")
    inside = lambda c: 0 <= c[1] <= 4 and 0 <= c[2] <= 2
    every = {(r.id, r.cx, r.cy) for r in cells.walked(lines.filter("id < 42"), 5.0).collect()}
    within = {(r.id, r.cx, r.cy) for r in cells.walked(lines, 5.0, box=(1.0, 2.0, 22.0, 13.0)).collect()}
    assert all(map(inside, within)) and {c for c in every if inside(c) and c[0] in {w[0] for w in within}} <= within
    assert {c[0] for c in every if 0 < c[1] < 4 and c[2] == 1} <= {w[0] for w in within} and len([w for w in within if w[0] == 42]) <= 15


def test_no_layer_is_broadcast_to_meet_a_roster(spark):
    """However small the files of a layer, its rows go to no driver: only the roster, which is no file here, is broadcast."""
    plan = queries.QUERIES["op_SJ4_touch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    sent = [i for i, line in enumerate(plan) if "BroadcastExchange" in line]
    assert sent and any("FileScan" in line for line in plan)
    for i in sent:
        below = itertools.takewhile(lambda j: depth[j] > depth[i], range(i + 1, len(plan)))  # noqa: B023
        assert not [plan[j] for j in below if "FileScan" in plan[j]]


def odd_share(rings, n=220, side=12.0):
    points = [((i + 0.513) * side / n, (j + 0.487) * side / n) for i in range(n) for j in range(n)]
    return sum(sum(validity._inside(r, x, y) for r in rings) % 2 for x, y in points) * (side / n) ** 2


CASES = {
    "bow tie": [[(0, 0), (2, 2), (2, 0), (0, 2)]], "pentagram": [[(0, 3), (6, 3), (1, 6.5), (3, 0), (5, 6.5)]],
    "hole that leaves its ring": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(3, 1), (5, 1), (5, 3), (3, 3)]], "nested parts": [[(0, 0), (9, 0), (9, 9), (0, 9)], [(2, 2), (7, 2), (7, 7), (2, 7)], [(3, 3), (5, 3), (5, 5), (3, 5)]],
    "part drawn twice": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (4, 4), (0, 4)]], "parts side by side": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(4, 0), (8, 0), (8, 4), (4, 4)]],
    "edge in part along another": [[(0, 0), (8, 0), (8, 4), (0, 4)], [(2, 4), (5, 4), (5, 7), (2, 7)]], "figure of eight": [[(0, 0), (4, 0), (4, 4), (8, 4), (8, 8), (4, 8), (4, 4), (0, 4)]], "spike": [[(0, 0), (4, 0), (9, 0), (4, 0), (4, 4), (0, 4)]],
}


@pytest.mark.parametrize("name", CASES)
def test_repairs_are_the_even_odd_interior(name):
    rings = [[tuple(map(float, p)) for p in r] for r in CASES[name]]
    made = validity.even_odd(rings)
    area = sum((-1 if hole else 1) * abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1], strict=True))) / 2 for hole, r in made)
    assert area == pytest.approx(odd_share(rings), rel=0.02, abs=0.02)
    assert [d % 2 == 1 for d in validity.depths([r for _, r in made])] == [hole for hole, _ in made]
    assert validity.even_odd([r for _, r in made]) is not None and all(len(set(r)) == len(r) for _, r in made)


def test_random_tangles(spark):
    rng = random.Random(4)
    for _ in range(15):
        rings = [[(rng.uniform(0, 12), rng.uniform(0, 12)) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 3))]
        made = validity.even_odd(rings)
        area = sum((-1 if hole else 1) * abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1], strict=True))) / 2 for hole, r in made)
        assert area == pytest.approx(odd_share(rings, 160), abs=0.8)


def test_which_features_are_invalid(spark):
    ring = lambda hole, *points: (hole, [tuple(map(float, p)) for p in points])
    outer, inner, away = [(0, 0), (9, 0), (9, 9), (0, 9)], [(2, 2), (7, 2), (7, 7), (2, 7)], [(20, 0), (22, 0), (22, 2), (20, 2)]
    features = [(1, [ring(False, *outer)]), (2, [ring(False, *outer), ring(True, *inner)]), (3, [ring(False, *outer), ring(False, *inner)]), (4, [ring(False, *outer), ring(True, *away)]), (5, [ring(False, *outer), ring(False, *away)]), (6, [ring(False, (0, 0), (2, 2), (2, 0), (0, 2))]), (7, None), (8, [])]
    table = spark.createDataFrame(features, f"id int, rings {spatial.RINGS}")
    assert sorted(r.id for r in validity.invalid(table).collect()) == [3, 4, 6]
    areas = {r.id: r.a for r in validity.repaired(table.filter("id < 7")).select("id", spatial.area(F.col("rings")).alias("a")).collect()}
    assert areas == {1: 81, 2: 56, 3: 56, 4: 85, 5: 85, 6: 2}


def test_validity_broadcasts_no_layer(spark, tmp_path):
    """Edges of a layer are more than its file lets the optimiser expect, so no join of them is left to it; features of few and of many edges are judged alike."""
    k = F.col("id")
    spark.range(2000).write.parquet(f"{tmp_path}/layer")
    many = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct((k + 4 * F.cos(i * math.pi / 10)).alias("x"), (4 * F.sin(i * math.pi / 10)).alias("y")))
    few = F.slice(many, 1, 5)
    swapped = lambda ring: F.concat(F.slice(ring, 1, 1), F.slice(ring, 3, 1), F.slice(ring, 2, 1), F.slice(ring, 4, 30))
    ring = F.when(k % 4 == 0, few).when(k % 4 == 1, swapped(few)).when(k % 4 == 2, many).otherwise(swapped(many))
    layer = spark.read.parquet(f"{tmp_path}/layer").select("id", F.array(F.struct(F.lit(False).alias("hole"), ring.alias("points"))).alias("rings"))
    assert sorted(r.id for r in validity.invalid(layer).collect()) == [i for i in range(2000) if i % 2]
    for found in (validity.invalid(layer), validity.repaired(layer)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_long_outline_is_repaired_in_proportion(spark):
    """A ring of many corners that crosses itself once: seconds, where all pairs of edges would be 5 * 10^9."""
    n = 100_000
    ring = [(50 * math.cos(2 * math.pi * i / n), 50 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    ring[10], ring[11] = ring[11], ring[10]
    table = spark.createDataFrame([(1, [(False, ring)])], f"id int, rings {spatial.RINGS}")
    assert validity.invalid(table).count() == 1
    assert validity.repaired(table).select(spatial.area(F.col("rings"))).first()[0] == pytest.approx(math.pi * 2500, rel=1e-6)


def test_lengths_of_lines_inside_units(spark):
    units = roster(spark)
    rng = random.Random(5)
    lines = [(i, [(False, [(rng.uniform(-12, 95), rng.uniform(-12, 52)) for _ in range(rng.randint(2, 4))]) for _ in range(rng.randint(1, 2))]) for i in range(25)] + [(90, []), (91, None), (92, [(False, [(5.0, 5.0)])])]
    got = {(r.id, r.AREA_CODE): r.LENGTH for r in overlay.line_lengths(spark.createDataFrame(lines, f"id int, rings {spatial.RINGS}"), units).collect()}
    shapes = {r.AREA_CODE: [[(p.x, p.y) for p in x.points] for x in r.rings] for r in units.collect()}
    want = {}
    for i, rings in lines[:25]:
        for _, points in rings:
            for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
                for k in range(4000):
                    x, y = ax + (k + 0.5) / 4000 * (bx - ax), ay + (k + 0.5) / 4000 * (by - ay)
                    for code in sorted(shapes):
                        if not (abs(x - shapes[code][0][0][0]) < 60 and abs(y - shapes[code][0][0][1]) < 60):
                            continue
                        if sum(_plain_inside(r, x, y) for r in shapes[code]) % 2:
                            want[i, code] = want.get((i, code), 0) + math.hypot(bx - ax, by - ay) / 4000
                            break
    assert all(abs(got.get(k, 0) - v) < 0.3 for k, v in want.items()) and all(v < 0.3 for k, v in got.items() if k not in want) and len(want) > 40


def _plain_inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def test_annual_series(spark):
    rows = [("A", 2.0, None, None), ("A", 3.0, 2001, 2002), ("A", 5.0, 1990, 2000), ("A", 7.0, 2003, None), ("B", 1.0, 2009, None), ("C", 4.0, 1980, 1990)]
    got = overlay.annual(spark.createDataFrame(rows, "AREA_CODE string, LENGTH double, SINCE int, UNTIL int"), (2000, 2001, 2002, 2003), until="UNTIL").collect()
    assert sorted(map(tuple, got))[:4] == [("A", 2000, 7.0), ("A", 2001, 5.0), ("A", 2002, 5.0), ("A", 2003, 9.0)]


def test_poisson_equals_a_plain_fit(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(800, 3)) * [1, 50, 0.01]
    exposure = rng.uniform(0.5, 20, 800)
    y = rng.poisson(exposure * np.exp(0.3 + x @ [0.4, -0.01, 20]))
    design = np.column_stack([np.ones(800), x])
    beta = np.zeros(4)
    for _ in range(60):  # Newton's steps, halved until the likelihood rises
        mean = exposure * np.exp(design @ beta)
        step = np.linalg.solve(design.T @ (design * mean[:, None]), design.T @ (y - mean))
        like = lambda b: (y * (design @ b)).sum() - (exposure * np.exp(np.minimum(design @ b, 50))).sum()
        while like(beta + step) < like(beta) - 1e-9:
            step = step / 2
        beta = beta + step
    rows = [(int(k), *map(float, r), float(e)) for k, r, e in zip(y, x, exposure, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0), (3, 1.0, 1.0, 1.0, 0.0), (-1, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "y int, a double, b double, c double, e double")
    fit = models.poisson(table, "y", {"one": F.lit(1.0), "a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, F.col("e"))
    assert fit.rows == 800 and np.allclose(list(fit.coefficients.values()), beta, rtol=1e-8, atol=1e-10)
    spread = np.sqrt(np.diag(np.linalg.inv(design.T @ (design * (exposure * np.exp(design @ beta))[:, None]))))
    assert np.allclose(list(fit.errors.values()), spread, rtol=1e-6)
    with pytest.raises(models.ModelError):
        models.poisson(table, "y", {"one": F.lit(1.0), "two": F.lit(2.0)})
    with pytest.raises(models.ModelError):
        models.poisson(table.limit(0), "y", {"one": F.lit(1.0)})


def test_rounds_of_a_fit_compute_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        read.add(1)
        return float(v % 7)

    table = spark.range(0, 200, 1, 2).select(seen("id").alias("y"), (F.col("id") % 5).alias("a"))
    assert models.poisson(table, "y", {"one": F.lit(1.0), "a": F.col("a")}).rounds > 2
    assert read.value <= 2 * 200  # the filter and the value of each row, whatever the number of rounds


def test_held_tables_are_computed_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(v):
        read.add(1)
        return v

    with grid.held(spark.range(0, 100, 1, 2).select(seen("id").alias("v"))) as (table,):
        assert [table.agg(F.sum("v")).first()[0] for _ in range(3)] == [4950] * 3 and read.value == 100
    assert not table.is_cached


def test_two_way_effects_equal_dummies(spark):
    rng = np.random.default_rng(9)
    units, years = 12, 7
    unit, year = np.repeat(np.arange(units), years), np.tile(np.arange(years), units)
    x = rng.normal(size=(units * years, 2))
    y = x @ [1.5, -2] + unit * 3.0 + year**2 + rng.normal(size=units * years) * 0.1
    dummies = np.column_stack([x, unit[:, None] == np.arange(units), (year[:, None] == np.arange(1, years))]).astype(float)
    want, *_ = np.linalg.lstsq(dummies, y, rcond=None)
    rest = y - dummies @ want
    errors = np.sqrt((rest @ rest) / (len(y) - dummies.shape[1]) * np.diag(np.linalg.inv(dummies.T @ dummies)))[:2]
    table = spark.createDataFrame([(int(u), int(t), float(k), *map(float, r)) for u, t, k, r in zip(unit, year, y, x, strict=True)], "u int, t int, y double, a double, b double")
    fit = models.two_way(table, "y", ["a", "b"], ("u", "t"))
    assert np.allclose(list(fit.coefficients.values()), want[:2], rtol=1e-9) and np.allclose(list(fit.errors.values()), errors, rtol=1e-8)
    with pytest.raises(models.ModelError):
        models.within(table.limit(20), ["y"], ("u", "t"))


def test_broadcasts_are_bounded(spark, monkeypatch):
    table = spark.range(10)
    assert "broadcast" in grid.bounded(table)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(grid, "BROADCAST_ROWS", 9)
    assert "broadcast" not in grid.bounded(table)._jdf.queryExecution().logical().toString().lower()
