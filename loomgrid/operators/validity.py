"""Polygons that are not valid: which ones, and what they are replaced by.

A feature is valid if no two of its edges cross and every ring is what its depth says: a part inside an even number of the other rings, a hole inside an odd one. An invalid
feature is replaced by its even-odd interior, the points that a ray from outside reaches over an odd number of edges. Its edges are split where they meet; stretches drawn twice cancel; what is left
is traced into rings that touch in points at most, turning as sharply as possible to one side; and the depth of each ring makes it a part or a hole. Edges meet by a
grid as fine as they are long, so a feature of n edges takes about n steps and not n squared.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators.cells import walked
from loomgrid.operators.spatial import RINGS, edges, is_empty, neighbours

Ring = list[tuple[float, float]]


#: Features of up to so many edges are compared pair by pair within their row.
FEW_EDGES = 16


def _crosses(a: Column, b: Column) -> Column:
    """Whether two edges cross inside both."""
    side = lambda e, p: F.signum((e["q"]["x"] - e["p"]["x"]) * (p["y"] - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (p["x"] - e["p"]["x"]))
    return (side(a, b["p"]) * side(a, b["q"]) < 0) & (side(b, a["p"]) * side(b, a["q"]) < 0)


def self_crossings(features: DataFrame) -> DataFrame:
    """(id): features of whose edges two cross inside both. Edges of a feature of more than `FEW_EDGES` meet by equality on the cells they pass; cells have about the mean length of its edges.

    The join is a merge join by hint: the optimiser takes a table of edges to be as small as the features' columns in the file and would broadcast it.
    """
    some = features.select("id", F.filter("rings", lambda r: F.size(r["points"]) > 2).alias("rings"))
    few = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r["points"])) <= FEW_EDGES
    drawn = F.flatten(F.transform("rings", lambda r: neighbours(r["points"])))
    # Arrays are handed to lambdas, so that they are made once a row and not once a pair.
    after = lambda es: F.transform(F.sequence(F.lit(0), F.size(es) - 1), lambda i: F.struct(F.get(es, i).alias("e"), F.slice(es, i + 2, F.lit(FEW_EDGES)).alias("others")))
    pairwise = F.exists(F.array(drawn), lambda es: F.exists(after(es), lambda x: F.exists(x["others"], lambda o: _crosses(x["e"], o))))
    small = some.filter(few & (F.size("rings") > 0)).filter(pairwise).select("id")
    length = lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])
    mean = F.aggregate(drawn, F.lit(0.0), lambda acc, e: acc + length(e)) / F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r["points"]))
    many = some.filter(~few).select(F.struct("id", mean.alias("s_cell")).alias("id"), "rings")
    unit = edges(many).filter("id.s_cell > 0").select("id.id", "ring", "e", *[(F.col(c) / F.col("id.s_cell")).alias(c) for c in ("x1", "y1", "x2", "y2")])
    cut = walked(unit, 1.0)
    other = cut.select(*[F.col(c).alias(f"o_{c}") for c in ("id", "ring", "e", "x1", "y1", "x2", "y2", "cx", "cy")])
    edge = lambda x1, y1, x2, y2: F.struct(F.struct(F.col(x1).alias("x"), F.col(y1).alias("y")).alias("p"), F.struct(F.col(x2).alias("x"), F.col(y2).alias("y")).alias("q"))
    met = cut.join(other.hint("merge"), (F.col("id") == F.col("o_id")) & (F.col("cx") == F.col("o_cx")) & (F.col("cy") == F.col("o_cy")) & (F.struct("ring", "e") < F.struct("o_ring", "o_e")))
    large = met.filter(_crosses(edge("x1", "y1", "x2", "y2"), edge("o_x1", "o_y1", "o_x2", "o_y2"))).select("id")
    return small.unionByName(large).distinct()


def _inside(points: Ring, x: float, y: float) -> bool:
    xs, ys = np.array(points, float).T
    x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
    spans = (ys > y) != (y2 > y)
    xs, ys, x2, y2 = xs[spans], ys[spans], x2[spans], y2[spans]
    return bool((x < xs + (y - ys) * (x2 - xs) / (y2 - ys)).sum() % 2)


def depths(rings: list[Ring]) -> list[int]:
    """In how many of the other rings each ring lies. Rings do not cross; a ring is asked at the middle of its longest edge, which no other ring passes."""
    boxes = np.array([[min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r)] for r in rings]).reshape(-1, 4)
    out = []
    for i, ring in enumerate(rings):
        p, q = max(zip(ring, ring[1:] + ring[:1], strict=True), key=lambda e: math.dist(*e))
        x, y = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2
        around = np.flatnonzero((boxes[:, 0] <= x) & (x <= boxes[:, 2]) & (boxes[:, 1] <= y) & (y <= boxes[:, 3]))
        out.append(sum(_inside(rings[j], x, y) for j in around.tolist() if j != i))
    return out


def _close(ring: Ring) -> Ring:
    """A ring without a repeated first point and without points drawn twice in a row."""
    out = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
    return out[:-1] if len(out) > 1 and out[0] == out[-1] else out


def _meetings(a: np.ndarray, b: np.ndarray) -> dict[int, list[tuple[float, float]]]:
    """The points inside edges, by edge, where they must be split: crossings, and ends of other edges that lie on them."""
    cell = float(np.hypot(*(b - a).T).mean()) or 1.0
    low, high = np.floor(np.minimum(a, b) / cell).astype(np.int64), np.floor(np.maximum(a, b) / cell).astype(np.int64)
    cells: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        (ax, ay), (bx, by) = a[i].tolist(), b[i].tolist()
        for cy in range(y0, y1 + 1):
            if y0 == y1 or ay == by:
                first, last = x0, x1
            else:  # the stretch of the row that the edge passes
                t = sorted(max(0.0, min(1.0, (y * cell - ay) / (by - ay))) for y in (cy, cy + 1))
                ends = sorted(ax + u * (bx - ax) for u in t)
                first, last = math.floor(ends[0] / cell - 1e-9), math.floor(ends[1] / cell + 1e-9)
            for cx in range(first, last + 1):
                cells[cx, cy].append(i)
    found: dict[int, list[tuple[float, float]]] = defaultdict(list)
    seen: set[tuple[int, int]] = set()
    for members in cells.values():
        for k, i in enumerate(members):
            for j in members[k + 1 :]:
                if (i, j) in seen or (high[i] < low[j]).any() or (high[j] < low[i]).any():
                    continue
                seen.add((i, j))
                _meet(a[i], b[i], a[j], b[j], i, j, found)
    return found


def _meet(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, i: int, j: int, found: dict[int, list[tuple[float, float]]]) -> None:
    (px, py), (qx, qy), (rx, ry), (sx, sy) = p.tolist(), q.tolist(), r.tolist(), s.tolist()
    turn = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    r_side, s_side, p_side, q_side = turn(px, py, qx, qy, rx, ry), turn(px, py, qx, qy, sx, sy), turn(rx, ry, sx, sy, px, py), turn(rx, ry, sx, sy, qx, qy)
    if r_side * s_side < 0 and p_side * q_side < 0:
        t = p_side / (p_side - q_side)
        at = (px + t * (qx - px), py + t * (qy - py))
        found[i].append(at)
        found[j].append(at)
        return
    for side, x, y, own, (ax, ay), (bx, by) in ((r_side, rx, ry, i, (px, py), (qx, qy)), (s_side, sx, sy, i, (px, py), (qx, qy)), (p_side, px, py, j, (rx, ry), (sx, sy)), (q_side, qx, qy, j, (rx, ry), (sx, sy))):
        if side == 0 and (x, y) not in ((ax, ay), (bx, by)) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            found[own].append((x, y))


def even_odd(rings: list[Ring]) -> list[tuple[bool, Ring]]:
    """(hole, points) of valid rings around the even-odd interior of the given ones; none if it is empty."""
    drawn = [e for r in map(_close, rings) if len(r) > 2 for e in zip(r, r[1:] + r[:1], strict=True)]
    if not drawn:
        return []
    a, b = np.array([e[0] for e in drawn], float), np.array([e[1] for e in drawn], float)
    cuts = _meetings(a, b)
    pieces: dict[tuple, int] = defaultdict(int)
    for i, (p, q) in enumerate(drawn):
        chain = [p, *sorted(set(cuts.get(i, ())), key=lambda c, p=p: math.dist(p, c)), q]
        for u, v in zip(chain, chain[1:], strict=False):
            if u != v:
                pieces[(u, v) if u < v else (v, u)] += 1
    around: dict[tuple, dict[tuple, float]] = defaultdict(dict)
    for (u, v), times in pieces.items():
        if times % 2:
            around[u][v] = math.atan2(v[1] - u[1], v[0] - u[0])
            around[v][u] = math.atan2(u[1] - v[1], u[0] - v[0])
    traced: list[Ring] = []
    for start in list(around):
        while around[start]:
            ring, at, after = [start], start, next(iter(around[start]))
            while True:
                back = around[after].pop(at)
                around[at].pop(after)
                at = after
                if at == start:
                    break
                ring.append(at)
                after = min(around[at], key=lambda v, at=at, back=back: (around[at][v] - back) % (2 * math.pi))
            traced += _simple(ring)
    return [(depth % 2 == 1, ring) for depth, ring in zip(depths(traced), traced, strict=True)]


def _simple(ring: Ring) -> list[Ring]:
    """A traced ring cut into rings that pass no point twice."""
    out, path, place = [], [], {}
    for p in ring:
        if p in place:
            at = place[p]
            loop = path[at:]
            for x in loop[1:]:
                del place[x]
            path = path[: at + 1]
            out.append(loop)
            continue
        place[p] = len(path)
        path.append(p)
    out.append(path)
    return [r for r in out if len(r) > 2]


def _nesting(features: DataFrame) -> DataFrame:
    """`features` with `v_flags`, whether each ring of three points or more is a hole by its depth."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for rings in batch["rings"].to_pylist():
                own = [_close([(p["x"], p["y"]) for p in r["points"]]) for r in rings]
                real = [i for i, r in enumerate(own) if len(r) > 2]
                depth = dict(zip(real, depths([own[i] for i in real]), strict=True))
                flags.append([depth.get(i, int(rings[i]["hole"])) % 2 == 1 for i in range(len(own))])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("id", "rings")], pa.array(flags, pa.list_(pa.bool_()))], names=["id", "rings", "v_flags"])

    narrow = features.select("id", "rings")
    return narrow.mapInArrow(judge, f"id {narrow.schema['id'].dataType.simpleString()}, rings {RINGS}, v_flags array<boolean>")


def invalid(features: DataFrame) -> DataFrame:
    """(id): features that are not valid, among those that have a geometry."""
    some = features.select("id", "rings").filter(~is_empty(F.col("rings")))
    several = _nesting(some.filter((F.size("rings") > 1) | F.col("rings")[0]["hole"]))
    wrong = several.filter(F.col("v_flags") != F.transform("rings", lambda r: r["hole"])).select("id")
    return self_crossings(some).union(wrong).distinct()


def repaired(features: DataFrame) -> DataFrame:
    """(id, rings): invalid features are replaced by their even-odd interior, the others stay; one that has no interior is left out."""
    bad = invalid(features).hint("merge")  # there may be as many as features
    own = features.select("id", "rings")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [even_odd([[(p["x"], p["y"]) for p in r["points"]] for r in rings]) for rings in batch["rings"].to_pylist()]
            kept = [i for i, rings in enumerate(made) if rings]
            shaped = [[{"hole": hole, "points": [{"x": x, "y": y} for x, y in ring]} for hole, ring in made[i]] for i in kept]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(kept, pa.int64())), pa.array(shaped, batch["rings"].type)], names=["id", "rings"])

    shape = f"id {own.schema['id'].dataType.simpleString()}, rings {RINGS}"
    return own.join(bad, "id", "left_anti").unionByName(own.join(bad, "id", "left_semi").mapInArrow(repair, shape))
