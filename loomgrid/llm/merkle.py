"""Merkle manifest of a table: a root digest, and for every row a path that proves the row against it.

The nodes of a tree form a sparse forest: a set of digests keyed by tree, level and index. Adding forests is associative and commutative, since
the number of a tree's leaves says how many children every node has: as soon as a run of siblings is complete it gives way to its parent. So rows are
range-sorted by tree and key, every task folds its rows into the few nodes that it cannot resolve (at most seven at either end of a level), and a tree of
merges over neighbouring parts, a shuffle of those few nodes each, resolves the rest. The roots of the trees are the leaves of one more tree, built alike.

Paths are read off blocks of 4,096 leaves, which are whole subtrees: a block meets one row that has the runs above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import materialize, rank_rows

#: Children of a node, fields of a leaf, and levels of a block of leaves whose paths are worked out together.
ARITY, FIELDS, BLOCK_LEVELS = 8, ("doc_id", "source", "lang", "n_chars", "text"), 4
BLOCK = ARITY**BLOCK_LEVELS
#: Leaves of a range partition, and parts that one merge takes.
PART_ROWS, FAN = 8 * BLOCK, 16
#: A step of a path: the siblings before and after a node, as hex text.
PATH = "array<struct<before:string,after:string>>"
_NODE = "n_group long, n_tree string, n_level int, n_index long, n_total long, n_digest binary, n_new boolean, n_open boolean"


def digest(parts: list[bytes]) -> bytes:
    """sha256 of digests, which are taken as hex text."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def level_size(total: int, level: int) -> int:
    """Nodes of a level in a tree with `total` leaves."""
    return -(-total // ARITY**level)


class Forest:
    """Nodes whose siblings are not all known; `add` resolves every run that it completes."""

    def __init__(self) -> None:
        self.runs: dict[tuple[str, int, int], dict[int, bytes]] = {}
        self.totals: dict[str, int] = {}
        self.made: list[tuple[str, int, int, bytes]] = []

    def add(self, tree: str, level: int, index: int, value: bytes, total: int, new: bool = False) -> None:
        """Take a node; nodes that it completes, and those given as `new`, go to `made` too."""
        self.totals[tree] = total
        while True:
            if new:
                self.made.append((tree, level, index, value))
            size = level_size(total, level)
            if size == 1:
                return
            parent = index // ARITY
            run = self.runs.setdefault((tree, level, parent), {})
            run[index] = value
            if len(run) < min(ARITY, size - ARITY * parent):
                return
            del self.runs[tree, level, parent]
            level, index, value, new = level + 1, parent, digest([run[i] for i in sorted(run)]), True

    def rows(self, group: int) -> pa.RecordBatch:
        """The nodes that are not resolved yet (open), and those made here (new) that paths of blocks may ask for."""
        still = {(t, level, i): v for (t, level, _), run in self.runs.items() for i, v in run.items()}
        out = [(t, level, i, v, True, (t, level, i) in still) for t, level, i, v in self.made if level >= BLOCK_LEVELS or (t, level, i) in still or level_size(self.totals[t], level) == 1]
        for t, level, i, *_ in out:
            still.pop((t, level, i), None)
        out += [(*k, v, False, True) for k, v in still.items()]
        t, level, i, v, new, is_open = zip(*out, strict=True) if out else [()] * 6
        columns = [pa.array([group] * len(out), pa.int64()), pa.array(t, pa.string()), pa.array(level, pa.int32()), pa.array(i, pa.int64()), pa.array([self.totals[x] for x in t], pa.int64()), pa.array(v, pa.binary()), pa.array(new, pa.bool_()), pa.array(is_open, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["n_group", "n_tree", "n_level", "n_index", "n_total", "n_digest", "n_new", "n_open"])


def leaf(values: dict[str, Column]) -> Column:
    """A row's digest: sha256 of its values in order, each `-` if null, else its UTF-8 length in bytes, `:` and itself."""
    text = [c.cast("string") for c in values.values()]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256))


def _ranked(leaves: DataFrame) -> DataFrame:
    """`leaves` (m_tree not null, m_key, m_leaf, m_row and others) with m_part, m_rank from 0 within the tree, and m_total, the tree's leaves. m_row tells equal rows apart."""
    found = rank_rows(leaves, "m_tree", [F.col("m_key").asc_nulls_first(), F.col("m_leaf"), F.col("m_row")], PART_ROWS)
    return found.withColumnsRenamed({"r_part": "m_part", "r_rank": "m_rank", "r_total": "m_total"})


def _grown(ranked: DataFrame) -> DataFrame:
    """(n_tree, n_level, n_index, n_total, n_digest): all nodes from the height of a block up, and roots."""

    def fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, part = Forest(), None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("m_part", "m_tree", "m_rank", "m_leaf", "m_total")]
            for own, tree, rank, value, total in zip(*columns, strict=True):
                part = own if part is None else part
                forest.add(tree, 0, rank, value, total, total == 1)
        if part is not None:
            yield forest.rows(part // FAN)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        forest = Forest()
        for tree, level, index, value, total in zip(*[table[c].to_pylist() for c in ("n_tree", "n_level", "n_index", "n_digest", "n_total")], strict=True):
            forest.add(tree, level, index, value, total)
        return pa.Table.from_batches([forest.rows(key[0].as_py() // FAN)])

    rounds = [materialize(ranked.select("m_part", "m_tree", "m_rank", "m_leaf", "m_total").mapInArrow(fold_rows, _NODE))]
    while not (rest := rounds[-1].filter("n_open")).isEmpty():
        rounds.append(materialize(rest.groupBy("n_group").applyInArrow(merge, _NODE)))
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    return found.filter("n_new").select("n_tree", "n_level", "n_index", "n_total", "n_digest")


def _is_root() -> Column:
    return F.col("n_total") <= F.pow(F.lit(float(ARITY)), F.col("n_level"))


def _paths(ranked: DataFrame, nodes: DataFrame, over: DataFrame) -> DataFrame:
    """The columns of `ranked`, and m_path, m_subroot and m_root of each row. `over` has (o_tree, o_path, o_root) for each tree: its path in the tree above."""
    top = nodes.filter(_is_root()).select(F.col("n_tree").alias("o_of"), F.col("n_digest").alias("o_subroot"), F.col("n_total").alias("o_total"))
    blocks = top.join(over, F.col("o_of") == F.col("o_tree")).select("o_tree", "o_path", "o_root", "o_subroot", "o_total", F.explode(F.sequence(F.lit(0), F.expr(f"(o_total - 1) div {BLOCK}"))).alias("o_block"))
    # What stands above a block: the run that holds its ancestor, at each level from the block's own on.
    runs = nodes.filter(F.col("n_level") >= BLOCK_LEVELS).groupBy("n_tree", "n_level", F.expr(f"n_index div {ARITY}").alias("n_parent")).agg(F.sort_array(F.collect_list(F.struct("n_index", "n_digest")))["n_digest"].alias("n_run"))
    levels = F.expr(f"explode(filter(sequence({BLOCK_LEVELS}, 20), l -> pow({ARITY}D, l) < o_total))")
    steps = blocks.filter(f"o_total > {BLOCK}").select("o_tree", "o_block", levels.alias("o_level"))
    steps = steps.withColumn("o_parent", F.expr(f"o_block div cast(pow({ARITY}D, o_level - {BLOCK_LEVELS - 1}) as bigint)"))
    above = steps.join(runs, (F.col("o_tree") == F.col("n_tree")) & (F.col("o_level") == F.col("n_level")) & (F.col("o_parent") == F.col("n_parent")))
    above = above.groupBy(F.col("o_tree").alias("a_tree"), F.col("o_block").alias("a_block")).agg(F.sort_array(F.collect_list(F.struct("o_level", "n_run")))["n_run"].alias("a_runs"))
    blocks = blocks.join(above, (F.col("o_tree") == F.col("a_tree")) & (F.col("o_block") == F.col("a_block")), "left").select("o_tree", "o_block", "o_path", "o_root", "o_subroot", "o_total", "a_runs")
    names = [c for c in ranked.columns if c not in ("m_part", "m_rank", "m_total", "m_row")]

    def walk(key: tuple, rows: pa.Table, upper: pa.Table) -> pa.Table:
        block = key[1].as_py()
        rows = rows.sort_by("m_rank")
        above = upper.to_pylist()[0]
        level, many = rows["m_leaf"].to_pylist(), len(rows)
        whole, level_at, picks, before, after = above["o_total"], 0, [], [], []

        def step(run: list[bytes]) -> None:
            text = [d.hex() for d in run]
            before.extend("".join(text[:i]) for i in range(len(run)))
            after.extend("".join(text[i + 1 :]) for i in range(len(run)))

        at = np.arange(many)
        while level_at < BLOCK_LEVELS and level_size(whole, level_at) > 1:
            picks.append(len(before) + at)
            above_level = []
            for i in range(0, len(level), ARITY):
                step(level[i : i + ARITY])
                above_level.append(digest(level[i : i + ARITY]))
            level, at, level_at = above_level, at // ARITY, level_at + 1
        place = block
        for run in above["a_runs"] or []:
            picks.append(np.full(many, len(before) + place % ARITY))
            step(run)
            place //= ARITY
        for one in above["o_path"]:
            picks.append(np.full(many, len(before)))
            before.append(one["before"])
            after.append(one["after"])
        flat = pa.array(np.stack(picks, axis=1).ravel() if picks else np.zeros(0, np.int64))
        path = pa.StructArray.from_arrays([pa.array(x, pa.string()).take(flat) for x in (before, after)], ["before", "after"])
        path = pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * len(picks), pa.int32()), path)
        out = rows.select(names)
        for name, column in (("m_path", path), ("m_subroot", pa.array([above["o_subroot"]] * many, pa.binary())), ("m_root", pa.array([above["o_root"]] * many, pa.binary()))):
            out = out.append_column(name, column)
        return out

    shape = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in names) + f", m_path {PATH}, m_subroot binary, m_root binary"
    left = ranked.withColumn("m_block", F.expr(f"m_rank div {BLOCK}")).groupBy("m_tree", "m_block")
    return left.cogroup(blocks.groupBy("o_tree", "o_block")).applyInArrow(walk, shape)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf (binary) leads to along a path, as hex text."""
    return F.aggregate(path, F.lower(F.hex(start)), lambda value, step: F.sha2(F.concat(step["before"], value, step["after"]), 256))


def path_digest(path: Column) -> Column:
    """sha256 over all siblings of a path, level by level and from left to right, as hex text."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS, suspect: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of `docs`: (m_id, m_leaf, m_path, m_subroot, m_root, m_other), digests as binary.

    Rows with one value of `tree_col` form a tree, in the order of their ids (no id first; rows of one id by their digests); the roots of the trees, ordered by
    that value (null first, then bytewise), form the tree above. m_other is the leaf of a copy of the row in which the columns that `suspect` names hold those
    expressions, to be checked by `fold(m_other, m_path)`; null where it equals m_leaf. Nulls in any field are told apart from empty values; equal rows are leaves each; an empty
    table has no rows and no root. Other columns are not read.
    """
    given = {f: F.col(f"`{f}`") for f in fields}
    other = leaf(given | suspect) if suspect else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("+"), F.col(f"`{tree_col}`").cast("string")), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("m_key"), tree.alias("m_tree"), leaf(given).alias("m_leaf"), other.alias("m_other"))
    leaves = materialize(rows.withColumn("m_other", F.when(F.col("m_other") != F.col("m_leaf"), F.col("m_other"))).withColumn("m_row", F.monotonically_increasing_id()))
    ranked = _ranked(leaves)
    nodes = _grown(ranked)
    # The tree above, over one leaf for each tree.
    roots = materialize(nodes.filter(_is_root()).select(F.lit("").alias("m_tree"), F.col("n_tree").alias("m_key"), F.col("n_digest").alias("m_leaf"), F.lit(0).cast("long").alias("m_row")))
    above = _ranked(roots)
    upper = _grown(above)
    alone = upper.filter(_is_root()).select(F.lit("").alias("o_tree"), F.expr(f"cast(array() as {PATH})").alias("o_path"), F.col("n_digest").alias("o_root"))
    over = materialize(_paths(above, upper, alone).select(F.col("m_key").alias("o_tree"), F.col("m_path").alias("o_path"), F.col("m_subroot").alias("o_root")))
    return _paths(ranked, nodes, over).select(F.col("m_key").alias("m_id"), "m_leaf", "m_path", "m_subroot", "m_root", "m_other")


def tampered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest of `docs`, with copies to check whose text is lower-cased in A-Z where 3 divides the crc32 of the decimal id (a null id: never)."""
    from loomgrid.llm.common import ascii_lower
    from loomgrid.llm.common import fold as id_fold

    lowered = F.when(F.coalesce(id_fold(F.col(id_col), 3) == 0, F.lit(False)), ascii_lower(F.col(text_col))).otherwise(F.col(text_col))
    return manifest(docs, id_col, suspect={text_col: lowered})


ORACLE = """
with recursive x as (
    select doc_id, lang, concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-')) as head, text,
           list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
                       lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))) as crc
    from documents),
l as (
    select doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
           sha256(head || coalesce(strlen(text) || ':' || case when doc_id is not null and xor(crc, 4294967295) % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end, '-')) as other from x),
r as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from l),
n(lang, level, i, size, d) as (
    select lang, 0, i, n, leaf from r
    union all select lang, level + 1, i // 8, (max(size) + 7) // 8, sha256(string_agg(d, '' order by i)) from n where size > 1 group by lang, level, i // 8),
s as (select lang, d as subroot, row_number() over (order by lang nulls first) - 1 as j, count(*) over () as m from n where size = 1),
t(level, i, size, d) as (
    select 0, j, m, subroot from s
    union all select level + 1, i // 8, (max(size) + 7) // 8, sha256(string_agg(d, '' order by i)) from t where size > 1 group by level, i // 8),
p(lang, leaf_at, level, i, size, others, folded) as (
    select lang, i, 0, i, n, '', other from r
    union all
    select p.lang, leaf_at, p.level + 1, p.i // 8, (max(p.size) + 7) // 8, max(others) || coalesce(string_agg(n.d, '' order by n.i) filter (n.i <> p.i), ''), sha256(string_agg(case when n.i = p.i then folded else n.d end, '' order by n.i))
    from p join n on n.lang is not distinct from p.lang and n.level = p.level and n.i // 8 = p.i // 8 where p.size > 1 group by p.lang, leaf_at, p.level, p.i),
q(lang, leaf_at, level, i, size, others, folded) as (
    select p.lang, leaf_at, 0, j, m, others, folded from p join s on s.lang is not distinct from p.lang where p.size = 1
    union all
    select lang, leaf_at, q.level + 1, q.i // 8, (max(q.size) + 7) // 8, max(others) || coalesce(string_agg(t.d, '' order by t.i) filter (t.i <> q.i), ''), sha256(string_agg(case when t.i = q.i then folded else t.d end, '' order by t.i))
    from q join t on t.level = q.level and t.i // 8 = q.i // 8 where q.size > 1 group by lang, leaf_at, q.level, q.i)
select doc_id, leaf, subroot, (select d from t where size = 1) as root, sha256(others) as proof_sha256, folded as folded_root, folded = (select d from t where size = 1) as verified
from r join q on q.size = 1 and q.lang is not distinct from r.lang and q.leaf_at = r.i join s on s.lang is not distinct from r.lang
"""
