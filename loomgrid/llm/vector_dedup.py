"""Embedding near-duplicates: an exact metric range join.

Vectors are scaled to length one, where cosine c is Euclidean distance sqrt(2 - 2c). Pivots partition them: a vector's home is
the cell of its nearest pivot. By the triangle inequality, of two vectors within r of each other either is no further from the other's
pivot than from its own plus 2r, and no further than the radius of the other's cell plus r. So a vector is sent to every cell that meets
both bounds, and two linked vectors always meet. Cells are cut into blocks of bounded size; a pair of blocks is compared once for
both sides, within bands of distance to a pivot that differ by r at most. Equal vectors are one vertex with a count, and a pair of blocks hands on
counts and a spanning forest, never all pairs.

How many pivots there are goes by the data: several numbers are tried on a bounded sample, and the one with the least estimated work is used. Which
pivots are chosen affects the work only, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from loomgrid.llm.common import join_classes, materialize
from loomgrid.llm.components import components

MIN_COSINE = 0.95
#: Vectors sampled to choose pivots from, numbers of pivots tried, and vectors in a block.
PIVOT_SAMPLE, PIVOTS, BLOCK = 2048, (1, 4, 16, 64, 256, 512), 8192
#: Estimated seconds of comparing two vectors and of sending one: they weigh fewer comparisons against more copies.
COMPARE_COST, SEND_COST = 1.2e-8, 3e-6
#: Beyond this distance from the bound a single-precision cosine decides; nearer, it is taken again in double precision.
DOUBT = 1e-4
#: Added to the replication bounds for rounding.
SLACK = 1e-6


def scaled(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; a row that cannot be (zero, or not finite) is all NaN."""
    values = np.ascontiguousarray(values, np.float64)
    with np.errstate(all="ignore"):
        length = np.sqrt((values * values).sum(axis=1))
        odd = np.isfinite(values).all(axis=1) & ~(np.isfinite(length) & (length > 0))  # squares beyond a double's range, or zero
        if odd.any():
            values[odd] /= np.abs(values[odd]).max(axis=1, keepdims=True)
            length[odd] = np.sqrt((values[odd] * values[odd]).sum(axis=1))
        return values / np.where(length > 0, length, np.nan)[:, None]


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, type]:
    """(v_id, v_raw, v_unit) and the number type of v_raw: the components as given and scaled to length one, as bytes; both null for vectors that link with nothing."""
    kind = np.float32 if vectors.schema[vec_col].dataType == ArrayType(FloatType(), vectors.schema[vec_col].dataType.containsNull) else np.float64

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["v"]
            flat = np.asarray(column.values.to_numpy(zero_copy_only=False), kind)
            start, stop = np.asarray(column.offsets)[:-1], np.asarray(column.offsets)[1:]
            size = np.where(np.asarray(column.is_valid()), stop - start, 0)
            raw, unit = [None] * batch.num_rows, [None] * batch.num_rows
            for n in np.unique(size[size > 0]).tolist():  # one length in an ordinary table
                rows = np.flatnonzero(size == n)
                given = flat[start[rows][:, None] + np.arange(n)]
                units = scaled(given.copy())
                for i, a, b, ok in zip(rows.tolist(), given, units, np.isfinite(units).all(axis=1).tolist(), strict=True):
                    if ok:
                        raw[i], unit[i] = a.tobytes(), b.tobytes()
            yield pa.RecordBatch.from_arrays([batch["v_id"], pa.array(raw, pa.binary()), pa.array(unit, pa.binary())], names=["v_id", "v_raw", "v_unit"])

    narrow = vectors.select(F.col(id_col).alias("v_id"), F.col(vec_col).cast("array<float>" if kind is np.float32 else "array<double>").alias("v"))
    return narrow.mapInArrow(scale, f"v_id {narrow.schema['v_id'].dataType.simpleString()}, v_raw binary, v_unit binary"), kind


def _units(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a binary column, all of one length, scaled to length one."""
    return scaled(np.stack([np.frombuffer(x.as_buffer(), kind) for x in column]))


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (units @ pivots.T)))


def choose_pivots(distinct: DataFrame, count: int, kind: type, radius: float) -> np.ndarray:
    """Pivots from a bounded sample by farthest-first traversal, as many as make the least estimated work."""
    share = max(1, count // PIVOT_SAMPLE)
    rows = distinct.filter(F.pmod(F.xxhash64("v_key"), F.lit(share)) == 0).select("v_raw").limit(2 * PIVOT_SAMPLE).collect() or [distinct.select("v_raw").first()]
    sample = scaled(np.stack([np.frombuffer(r[0], kind) for r in rows]))
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(max(PIVOTS), len(sample)):
        far = np.minimum(far, 1 - sample @ sample[chosen[-1]])
        chosen.append(int(far.argmax()))
    distances = _distances(sample, sample[chosen])

    def work(pivots: int) -> float:
        own = distances[:, :pivots]
        nearest = own.min(axis=1, keepdims=True)
        sizes = np.bincount(own.argmin(axis=1), minlength=pivots) * (count / len(sample))
        reach = own <= nearest + 2 * radius
        return float((reach @ (COMPARE_COST * sizes + SEND_COST * np.ceil(sizes / BLOCK))).mean())

    best = min((p for p in PIVOTS if p <= len(chosen)), key=work)
    return sample[chosen[:best]]


def _pairs(linked: np.ndarray, x_key: np.ndarray, y_key: np.ndarray, root_of: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of keys that join whatever `linked` joins: labels spread over links until none changes, then every vertex goes to its group's root.

    `root_of` has, for each y, the root that it was last given (0: none yet); a y that had another root is not repeated, the two roots are joined.
    """
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not len(rows):
        return
    near = linked[np.ix_(rows, cols)]
    x_label, most = np.arange(len(rows)), len(rows)
    while True:
        y_label = np.where(near, x_label[:, None], most).min(axis=0)
        new = np.minimum(x_label, np.where(near, y_label[None, :], most).min(axis=1))
        if (new == x_label).all():
            break
        x_label = new
    roots = x_key[rows]
    yield np.stack([roots, roots[x_label]], axis=1)
    old, to = root_of[cols], roots[y_label]
    yield np.stack([np.where(old == 0, y_key[cols], old), to], axis=1)
    root_of[cols] = to


def compare_blocks(x: np.ndarray, y: np.ndarray, x_key: np.ndarray, y_key: np.ndarray, x_rows: np.ndarray, y_rows: np.ndarray, pivot: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows linked with each x, rows linked with each y, pairs of keys that span the links) of two blocks of unit vectors."""
    radius = float(np.sqrt(2 - 2 * min_cosine)) + SLACK
    x_far, y_far = _distances(x, pivot[None])[:, 0], _distances(y, pivot[None])[:, 0]
    x_order, y_order = np.argsort(x_far, kind="stable"), np.argsort(y_far, kind="stable")
    x, x_key, x_far, y, y_key, y_far = x[x_order], x_key[x_order], x_far[x_order], y[y_order], y_key[y_order], y_far[y_order]
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    x_count, y_count, y_weight, x_weight = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), y_rows[y_order], x_rows[x_order]
    root_of, pairs = np.zeros(len(y), np.int64), []
    for part in range(0, len(x), 512):
        at = slice(part, part + 512)
        low, high = np.searchsorted(y_far, x_far[at][0] - radius), np.searchsorted(y_far, x_far[at][-1] + radius, side="right")
        near = slice(low, high)
        cosine = x32[at] @ y32[near].T
        linked = cosine >= min_cosine + DOUBT
        unsure_x, unsure_y = np.nonzero((cosine >= min_cosine - DOUBT) & ~linked)
        linked[unsure_x, unsure_y] = (x[at][unsure_x] * y[near][unsure_y]).sum(axis=1) >= min_cosine
        x_count[at] = linked @ y_weight[near]
        y_count[near] += x_weight[at] @ linked
        pairs += _pairs(linked, x_key[at], y_key[near], root_of[near])
    x_back, y_back = np.empty_like(x_count), np.empty_like(y_count)
    x_back[x_order], y_back[y_order] = x_count, y_count
    return x_back, y_back, np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)


def neighbours(distinct: DataFrame, count: int, kind: type, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(a, b, n): rows linked with vertex a that one pair of blocks found (b = a), and pairs (a, b) that together span every group (n = 0).

    `distinct` has (v_key long, v_rows long, v_raw binary), one row for each vector. The sum of n over a counts a's own rows too.
    """
    context = distinct.sparkSession.sparkContext
    radius = float(np.sqrt(2 - 2 * min_cosine))
    pivots = context.broadcast(choose_pivots(distinct, count, kind, radius))

    def place(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distances to the pivots, home cell, cells within reach by the pivots' bound) of a batch."""
        far = _distances(_units(batch["v_raw"], kind), pivots.value)
        return far, far.argmin(axis=1), far <= far.min(axis=1, keepdims=True) + 2 * radius + SLACK

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far, cell, _ = place(batch)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far[np.arange(len(cell)), cell])], names=["cell", "far"])

    # One row for each cell, at most as many as pivots.
    met = distinct.select("v_raw").mapInArrow(survey, "cell long, far double").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    spread, blocks = np.full(len(pivots.value), -np.inf), np.zeros(len(pivots.value), np.int64)
    for r in met:
        spread[r.cell], blocks[r.cell] = r.far, -(-r.n // BLOCK)
    first = np.cumsum(blocks) - blocks  # number of a cell's first block
    plan = context.broadcast((spread, blocks, first, np.repeat(np.arange(len(blocks)), blocks)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for every pair of its own block and a block of a cell that it reaches."""
        spread, blocks, first, _ = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            far, cell, reach = place(batch)
            reach &= (far <= spread + radius + SLACK) & (blocks > 0)
            reach[np.arange(len(cell)), cell] = True
            mixed = (np.asarray(batch["v_key"]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            own = first[cell] + mixed % blocks[cell]
            row, to = np.nonzero(reach)
            times = blocks[to]
            row, other = np.repeat(row, times), np.repeat(first[to] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            left, right, side = np.minimum(own[row], other), np.maximum(own[row], other), (own[row] > other).astype(np.int32)
            for part in range(0, len(row), 10_000):
                at = slice(part, part + 10_000)
                taken = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (left, right, side)] + [batch[c].take(taken) for c in ("v_key", "v_rows", "v_raw")], names=["left", "right", "side", "v_key", "v_rows", "v_raw"])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        left, right = (k.as_py() for k in key)
        table = table.combine_chunks()
        side = np.asarray(table["side"])
        keys, rows = np.asarray(table["v_key"]), np.asarray(table["v_rows"])
        units = _units(table["v_raw"].combine_chunks() if isinstance(table["v_raw"], pa.ChunkedArray) else table["v_raw"], kind)
        mine, theirs = (side == 0, side == 0) if left == right else (side == 0, side == 1)
        if not mine.any() or not theirs.any():
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n")})
        pivot = pivots.value[plan.value[3][left]]
        x_count, y_count, pairs = compare_blocks(units[mine], units[theirs], keys[mine], keys[theirs], rows[mine], rows[theirs], pivot, min_cosine)
        counted = [(keys[mine], x_count)] + ([] if left == right else [(keys[theirs], y_count)])
        a = np.concatenate([k[n > 0] for k, n in counted])
        n = np.concatenate([n[n > 0] for _, n in counted])
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        none = np.zeros(len(pairs), np.int64)
        return pa.table({"a": np.concatenate([a, pairs[:, 0]]), "b": np.concatenate([a, pairs[:, 1]]), "n": np.concatenate([n, none])})

    # A group holds two blocks of about BLOCK vectors each, whatever the input.
    visits = distinct.mapInArrow(visit, "left long, right long, side int, v_key long, v_rows long, v_raw binary")
    return visits.groupBy("left", "right").applyInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per vector: (v_id, n_links, component_id, kept).

    Vectors that are null, zero, or hold null or non-finite components link with nothing; so do vectors of different
    lengths with each other. Rows with equal vectors link with each other. A null id never names a component; a component
    without any other id is null, and `kept` is then false. An empty table gives an empty result. Other columns are not read.
    """
    units, kind = unit_vectors(vectors, id_col, vec_col)
    units = materialize(units)
    usable = units.filter("v_unit is not null")
    grouped = materialize(usable.groupBy("v_unit").agg(F.min("v_id").alias("v_low"), F.count("*").alias("v_rows"), F.min("v_raw").alias("v_raw")))
    for seed in range(8):  # a key of 64 bits, not 0, for each distinct vector; another seed if two of them ever share one
        key = F.xxhash64(F.lit(seed), "v_unit")
        classes = grouped.withColumn("v_key", key)
        if classes.groupBy("v_key").count().filter("count > 1 or v_key = 0").isEmpty():
            break
    found, total = None, 0
    # One join for each length of vectors (one length in an ordinary table).
    for size, count, rows in classes.groupBy(F.length("v_unit")).agg(F.count("*"), F.sum("v_rows")).collect():
        part = neighbours(classes.filter(F.length("v_unit") == size).select("v_key", "v_rows", "v_raw"), count, kind, min_cosine)
        found, total = part if found is None else found.union(part), total + rows
    if found is None:
        return units.select("v_id", F.lit(0).cast("long").alias("n_links"), F.col("v_id").alias("component_id"), F.col("v_id").isNotNull().alias("kept"))
    found = materialize(found)
    counts = found.groupBy("a").agg((F.sum("n") - 1).alias("n_links"))
    reached = components(found.filter("a <> b"))
    rooted = classes.select("v_key", "v_low", "v_rows").join(reached, F.col("v_key") == F.col("node"), "left").select("v_key", "v_low", "v_rows", F.coalesce("component", "v_key").alias("v_root"))
    low = rooted.groupBy(F.col("v_root").alias("v_of")).agg(F.min("v_low").alias("component_id"))
    named = rooted.join(low, F.col("v_root") == F.col("v_of")).join(counts, F.col("v_key") == F.col("a")).select(F.col("v_key").alias("v_named"), "v_rows", "component_id", "n_links")
    keyed = units.filter("v_unit is not null").select("v_id", key.alias("v_key"))
    linked = join_classes(keyed, materialize(named), "v_key", "v_named", "v_rows", total).select("v_id", "n_links", "component_id")
    alone = units.filter("v_unit is null").select("v_id", F.lit(0).cast("long").alias("n_links"), F.col("v_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("v_id") == F.col("component_id"), F.lit(False)))


ORACLE = f"""
with recursive e as (select vec_id, embedding::double[] as v from embeddings),
ok as (select * from e where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= {MIN_COSINE}),
r(id, x) as (select vec_id, vec_id from e union select r.id, l.b from r join l on l.a = r.x)
select e.vec_id, (select count(*) from l where l.a = e.vec_id)::bigint as n_links, c.low::bigint as component_id, e.vec_id = c.low as kept
from e join (select id, min(x) as low from r group by id) c on c.id = e.vec_id
"""
