"""SimHash near-duplicates: fingerprints embedded by per-segment bit counts, joined on a grid, verified exactly.

A fingerprint's bit counts in sixteen segments of four bits are a point of a 16-dimensional grid. Changing one bit moves one
coordinate by one, so the Manhattan distance of two points is at most the Hamming distance of the fingerprints: fingerprints
that differ in two bits at most lie two steps apart at most, and then share a point that is at most one step from either.
Each distinct fingerprint is sent to its own point and the points one step away, fingerprints that meet at a point are
compared exactly, and a point's links are handed on as a forest, never as all pairs.

A point where more than `CROWD` fingerprints meet is crowded. Its fingerprints are joined by another exact grid, the
fingerprints themselves and those one bit away: two that differ in two bits at most share one of these, and at any of these only
65 different fingerprints can meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomgrid.llm.common import join_classes, materialize, text_batches
from loomgrid.llm.components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
SEGMENTS, SEGMENT_BITS = 16, 4
#: Most fingerprints compared at one grid point; a fuller point goes to the bit-flip grid, without loss.
CROWD = 256
#: Crowded points up to this number are broadcast to find their rows; beyond it they are joined by a shuffle.
BROADCAST_POINTS = 100_000
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as an unsigned integer; 0 if it has no words.

    Words lie between ASCII white space, A-Z lower-cased; shingles are `SHINGLE` consecutive words, repeats included, or
    all words if there are fewer. A bit is 1 if it is set in over half of the shingles' XXH64.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()[SHINGLE - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=False)], np.uint64)
    total = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        some = np.ascontiguousarray(hashes[part : part + (1 << 14)].astype("<u8"))
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * total > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sim_id, sim_fp): the fingerprint of every row as a signed 64-bit integer."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch["x"]), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["sim_id"], pa.array(found)], names=["sim_id", "sim_fp"])

    narrow = text_batches(docs).select(F.col(id_col).alias("sim_id"), F.col(text_col).alias("x"))
    return narrow.mapInArrow(score, f"sim_id {narrow.schema['sim_id'].dataType.simpleString()}, sim_fp long")


def with_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the fingerprint of every row as sim_fp."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch[text_col]), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "sim_fp"])

    return text_batches(docs).mapInArrow(score, StructType([*docs.schema.fields, StructField("sim_fp", LongType())]))


def grid_point(fp: Column) -> Column:
    """The bit counts of the sixteen segments, each in its own four bits of a 64-bit integer (none exceeds four, so the sign bit stays clear)."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * s).bitwiseAND(F.lit(0xF))).cast("long") for s in range(SEGMENTS)]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(c, SEGMENT_BITS * s) for s, c in enumerate(counts)])


def near_points(point: Column) -> Column:
    """A grid point and those one step away."""
    steps = []
    for s in range(SEGMENTS):
        shift = SEGMENT_BITS * s
        count = F.shiftrightunsigned(point, shift).bitwiseAND(F.lit(0xF))
        steps.append(F.when(count < SEGMENT_BITS, point + F.lit(1 << shift)))
        steps.append(F.when(count > 0, point - F.lit(1 << shift)))
    return F.array_compact(F.array(point, *steps))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each list of fingerprints, links of a spanning forest of those at most `MAX_BITS` bits apart."""
    for batch in batches:
        left: list[int] = []
        right: list[int] = []
        for many in batch["sim_many"]:
            values = np.unique(np.asarray(many.values, np.int64)).view(np.uint64)
            near = np.bitwise_count(values[:, None] ^ values[None, :]) <= MAX_BITS
            if near.sum() == len(values):
                continue
            todo = np.ones(len(values), bool)
            for start in range(len(values)):
                if not todo[start]:
                    continue
                todo[start] = False
                edge = [start]
                while edge:
                    at = edge.pop()
                    new = np.flatnonzero(near[at] & todo)
                    todo[new] = False
                    edge += new.tolist()
                    signed = values.view(np.int64)
                    left += [int(signed[at])] * len(new)
                    right += signed[new].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (sim_fp) that span every group linked at `MAX_BITS` bits or fewer."""
    points = distinct.select("sim_fp", grid_point(F.col("sim_fp")).alias("sim_point"))
    sent = materialize(points.select("sim_fp", F.explode(near_points(F.col("sim_point"))).alias("sim_at")))
    crowd = sent.groupBy("sim_at").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(crowd)
    crowded = shared.filter(F.col("n") > CROWD).select("sim_at")
    few = crowded.limit(BROADCAST_POINTS + 1).count() <= BROADCAST_POINTS
    crowded = F.broadcast(crowded) if few else crowded
    calm = sent.join(crowded, "sim_at", "left_anti").join(shared.filter(F.col("n") <= CROWD).select("sim_at"), "sim_at", "left_semi")
    met = calm.groupBy("sim_at").agg(F.collect_list("sim_fp").alias("sim_many"))
    links = met.select("sim_many").mapInArrow(_forest, "a long, b long")
    if not shared.filter(F.col("n") > CROWD).isEmpty():
        dense = sent.join(crowded, "sim_at", "left_semi").select("sim_fp").distinct()
        flips = F.array(F.col("sim_fp"), *[F.col("sim_fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
        met = dense.select("sim_fp", F.explode(flips).alias("sim_at")).groupBy("sim_at").agg(F.collect_list("sim_fp").alias("sim_many")).filter(F.size("sim_many") > 1)
        links = links.union(met.select("sim_many").mapInArrow(_forest, "a long, b long"))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (sim_id, sim_fp, sim_component)."""
    return groups(docs, id_col, text_col).drop("sim_root")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (sim_id, sim_fp, sim_root, sim_component). sim_root is a fingerprint of the group and names no other group.

    sim_component is the smallest id reachable over links. Documents with one fingerprint are one vertex and are told
    apart only at the end, so copies are never paired. Null and empty texts have fingerprint 0 and link like any other; rows with a
    null id get a component too, but never name one: it is null if no id is reachable. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col))
    classes = materialize(prints.groupBy("sim_fp").agg(F.min("sim_id").alias("sim_low"), F.count("*").alias("sim_rows")))
    reached = components(near_links(classes.select("sim_fp")))
    rooted = classes.join(reached, F.col("sim_fp") == F.col("node"), "left").select("sim_fp", "sim_low", "sim_rows", F.coalesce("component", "sim_fp").alias("sim_root"))
    rooted = materialize(rooted)
    low = rooted.groupBy(F.col("sim_root").alias("sim_of")).agg(F.min("sim_low").alias("sim_component"))
    named = rooted.join(low, F.col("sim_root") == F.col("sim_of"), "inner").select(F.col("sim_fp").alias("sim_key"), "sim_rows", "sim_root", "sim_component")
    total = classes.agg(F.sum("sim_rows")).first()[0] or 0
    return join_classes(prints, materialize(named), "sim_fp", "sim_key", "sim_rows", total).select("sim_id", "sim_fp", "sim_root", "sim_component")
