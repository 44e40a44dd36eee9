"""The Merkle manifest, line dedup and whitening against plain versions: many parts and merges, ways beyond a broadcast, nulls, ties, repeats and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import line_dedup, merkle, whitening
from loomgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level, marks):
    """The root over a list of digests, and for each of `marks` the list of (before, after) on its way."""
    paths, at = {m: [] for m in marks}, {m: m for m in marks}
    while len(level) > 1:
        for m in marks:
            run = at[m] // 8 * 8
            paths[m].append(("".join(level[run : at[m]]), "".join(level[at[m] + 1 : run + 8])))
            at[m] //= 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def plain_manifest(rows):
    """(doc_id, source, lang, n_chars, text) rows to a multiset of what op11 returns."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {lang: climb([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])], range(len(trees[lang]))) for lang in order}
    root, above = climb([built[lang][0] for lang in order], range(len(order)))
    out = []
    for k, lang in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(trees[lang], key=lambda x: x[:3])):
            path = built[lang][1][i] + above[k]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            value = plain_leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))) if changed else leaf
            for before, after in path:
                value = sha(before + value + after)
            out.append((r[0], leaf, built[lang][0], root, sha("".join(a + b for a, b in path)), value, value == root))
    return Counter(out)


DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_of(spark, monkeypatch, rows, schema=DOCUMENTS):
    spark.createDataFrame(rows, schema).createOrReplaceTempView("manifest_rows")
    monkeypatch.setattr("loomgrid.llm.queries.table", lambda *_: spark.table("manifest_rows"))
    found = QUERIES["op11_merkle_manifest"](spark, "")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(map(tuple, found.collect()))


@pytest.mark.parametrize("count,part_rows,fan", [(9_500, 700, 2), (5_000, 100_000, 16), (64, 10, 3), (1, 10, 2)])
def test_manifest_equals_plain_trees(spark, monkeypatch, count, part_rows, fan):
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    monkeypatch.setattr(merkle, "FAN", fan)
    rows = [(i * 7919 % 100_003, f"s{i % 3}", ["en", "en", "de", None, "", f"x{i % 11}é"][i % 6], i % 50, f"Text {i} É") for i in range(count)]
    rows = [r if i % 97 else (r[0], None, r[2], None, None) for i, r in enumerate(rows)]
    assert manifest_of(spark, monkeypatch, rows) == plain_manifest(rows)


def test_manifest_of_one_hot_tree_with_equal_rows(spark, monkeypatch):
    """A third of all rows are one row; ids repeat with other texts; rows have no id, or nothing at all."""
    monkeypatch.setattr(merkle, "PART_ROWS", 300)
    rows = [(7, "s", "en", 3, "Abc")] * 700 + [(i // 2, "s", "en", i, f"T {i}") for i in range(1_300)] + [(None, "s", None, 1, "x"), (None, None, None, None, None), (None, None, None, None, None), (5, "", "", 0, "")]
    assert manifest_of(spark, monkeypatch, rows) == plain_manifest(rows)


def test_manifest_with_clashing_columns_and_empty(spark, monkeypatch):
    extra = ", m_id long, m_key long, m_leaf string, m_rank int, m_tree int, leaf int, root string, level int, n_tree string, o_path int"
    rows = [(i, "a", "en", 1, "x" * (200_000 if i == 3 else i), *range(4), 5, 6, "7", 8, "9", 10) for i in range(20)]
    rows = [(*r[:5], 1, 2, "3", 4, 5, 6, "7", 8, "9", 10) for r in rows]
    assert manifest_of(spark, monkeypatch, rows, DOCUMENTS + extra) == plain_manifest([r[:5] for r in rows])
    assert manifest_of(spark, monkeypatch, []) == Counter()


def test_forest_takes_nodes_in_any_order():
    rng = np.random.default_rng(1)
    leaves = [bytes([i % 256, i // 256] * 16) for i in range(700)]
    want = climb([v.hex() for v in leaves], [])[0]
    for _ in range(5):
        parts = [merkle.Forest() for _ in range(4)]
        for i in rng.permutation(700).tolist():
            parts[rng.integers(4)].add("t", 0, i, leaves[i], 700)
        whole = merkle.Forest()
        for p in rng.permutation(4).tolist():
            for (tree, level, _), run in parts[p].runs.items():
                for i, value in run.items():
                    whole.add(tree, level, i, value, 700)
        assert not whole.runs and whole.made[-1][3].hex() == want


def plain_lines(rows):
    strip = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), strip(line))
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    keeper = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


def line_rows():
    rng = np.random.default_rng(3)
    shared = [f"  This Is the shared line number {k} with Ünïcode and more words " for k in range(60)]
    rows = []
    for i in range(400):
        lines = [f"own line {i} {j} " + "x" * int(rng.integers(60)) for j in range(3)]
        lines += [shared[k] if rng.random() < 0.5 else "\t" + shared[k].strip().upper().replace("Ü", "ü").replace("Ï", "ï").replace("Ü".lower().upper(), "Ü") + "\r" for k in rng.integers(60, size=int(rng.integers(6)))]
        rows.append((int(rng.integers(300)), "\n".join(lines[j] for j in rng.permutation(len(lines)))))
    hot = "a hot line that a third of all documents have in common"
    rows = [(i, t + "\n" + hot if k % 3 == 0 else t) for k, (i, t) in enumerate(rows)]
    rows += [(None, hot + "\n" + shared[1]), (None, "only rows without an id have this one, five of them")] + [(None, "only rows without an id have this one, five of them")] * 4
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, hot), (1003, hot), (1004, "é" * 39 + "\n" + "é" * 39), *[(1100 + k, "é" * 39 + "\n" + "é" * 40) for k in range(6)], (2000, "\n".join(shared * 300))]
    return rows


@pytest.mark.parametrize("broadcast,shard,probes", [(500_000, 1 << 16, 500_000), (3, 4, 100), (0, 1 << 16, 500_000), (20, 1, 10)])
def test_lines_equal_brute_force(spark, monkeypatch, broadcast, shard, probes):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard)
    monkeypatch.setattr(line_dedup, "PROBES", probes)
    rows = line_rows()
    found = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("l_id", "l_lines", "l_dropped", "sha2(coalesce(l_text, ''), 256)", "l_text is null")
    got = [tuple(r) for r in found.collect()]
    assert Counter(r[:4] for r in got) == plain_lines(rows) and sum(r[2] for r in got) > 300
    assert [r[0] for r in got if r[4]] == [1000]


def test_lines_with_clashing_columns_and_empty(spark):
    extra = "l_id long, l_in string, l_more int, l_text string, l_lines int, x string, line string"
    table = spark.createDataFrame([(1, "a", 2, "b", 3, "c", 4, "d", "e")], f"doc_id long, text string, {extra}".replace("l_more int", "l_more long").replace("l_lines int", "l_lines long"))
    assert [tuple(r) for r in line_dedup.drop_repeated_lines(table).collect()] == [(1, 1, 0, "a")]
    assert [tuple(r) for r in line_dedup.drop_repeated_lines(table, carry=("x",)).collect()] == [(1, "d", 1, 0, "a")]
    assert line_dedup.drop_repeated_lines(table.limit(0)).count() == 0


@pytest.mark.parametrize("count", [0, 1, 2, 63, 5_000])
def test_perfect_hash_is_minimal_and_refuses_others(count):
    rng = np.random.default_rng(count)
    high, low, other = (rng.integers(1 << 63, size=count + 1, dtype=np.uint64) for _ in range(3))
    high, low = high[:count], low[:count]
    sizes, bits, place = line_dedup.build_shard(high, low)
    assert sorted(place.tolist()) == list(range(count))
    order = np.argsort(place)
    row = {"i_shard": 0, "i_sizes": sizes, "i_bits": bits.tobytes(), "i_prints": high[order].tobytes(), "i_counts": np.ones(count, np.uint32).tobytes(), "i_keepers": np.zeros(count, np.int64).tobytes()}
    probe = line_dedup.Probe([row] if count else [], 1)
    assert (probe.find(high, low) == place).all() and (probe.find(other, other) == -1).all()
    assert 64 * sum(sizes) <= 4 * count + 64 * 20


def plain_white(vectors):
    """{id: (n, deviation, projections by component)} by exact integers and numpy's own solver."""
    good = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in vectors if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, good.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float) - np.array([s / n for s in sums])
    values, axes = np.linalg.eigh(x.T @ x / n)
    return good, n, sums, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("tasks,fan", [(1, 16), (40, 2)])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_equals_plain(spark, monkeypatch, tasks, fan, kind):
    monkeypatch.setattr(whitening, "FAN", fan)
    rng = np.random.default_rng(6)
    base = (rng.normal(size=(300, 7)) @ np.diag([9, 5, 3, 2, 1, 1, 0.5]) + rng.normal(size=7) * 100).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(150)]
    vectors += [(-1, None), (-2, [1.0] * 6 + [float("nan")]), (-3, [1.0] * 6 + [None]), (-4, [float("inf")] + [0.0] * 6), (5, base[9].tolist()), (None, base[8].tolist()), (-5, [-0.0] * 7)]
    good, n, sums, values, axes = plain_white([v for v in vectors if v[0] != 5] + [(5, base[5].tolist())])
    table = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").repartition(tasks)
    rows = whitening.whiten(table).collect()
    assert len(rows) == 4 * (len(vectors) - 4)
    sign = {}
    for r in rows:
        if r.w_id == 5:
            continue
        x, k = good[r.w_id], r.w_component - 1
        assert (r.w_n, r.w_deviation) == (n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
        want = (np.array(x) - np.array([s / n for s in sums])) @ axes[:, k] / np.sqrt(values[k])
        if abs(want) > 1e-3:
            sign.setdefault(k, np.sign(want) * np.sign(r.w_value))
        assert abs(r.w_value - want * sign.get(k, 1)) < 1e-8 and abs(r.w_explained - values[k] / values.sum()) < 1e-12 and r.w_identity_error < 1e-9


def test_whitening_on_the_given_table(spark):
    rows = QUERIES["op13_embedding_whitening"](spark, SF).collect()
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    good, n, sums, values, axes = plain_white(given)
    assert len(rows) == 4 * len(good) and {r.n for r in rows} == {n}
    for k in range(4):
        got = {r.vec_id: r.whitened for r in rows if r.component == k + 1}
        want = {i: float((np.array(x) - np.array([s / n for s in sums])) @ axes[:, k] / np.sqrt(values[k])) for i, x in good.items()}
        sign = np.sign(sum(got[i] * want[i] for i in want))
        assert max(abs(got[i] * sign - want[i]) for i in want) < 1e-7
    assert all(r.deviation == sum((n * a - s) ** 2 for a, s in zip(good[r.vec_id], sums, strict=True)) for r in rows)


def test_whitening_without_spread(spark):
    """Equal vectors, fewer dimensions than components, several lengths, values beyond a long, and nothing at all."""
    table = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.0], 0), (3, [0.0, 1.0], 0), (4, [1.0, 1.0], 0), (5, [1e300], 0), (6, [-1e300], 0), (7, [], 0)], "vec_id long, embedding array<double>, w_n int")
    rows = sorted(whitening.whiten(table).collect(), key=lambda r: (r.w_id, r.w_component))
    assert [(r.w_id, r.w_component, r.w_n, r.w_deviation) for r in rows] == [(1, 1, 1, 0), (1, 2, 1, 0), (1, 3, 1, 0), (2, 1, 1, 0), (2, 2, 1, 0), (2, 3, 1, 0), (3, 1, 2, 65536), (3, 2, 2, 65536), (4, 1, 2, 65536), (4, 2, 2, 65536), (5, 1, 2, None), (6, 1, 2, None)]
    assert [r.w_value for r in rows] == [None] * 6 + [-1.0, None, 1.0, None, 1.0, -1.0]
    assert whitening.whiten(table.limit(0)).columns == whitening.whiten(table).columns and whitening.whiten(table.limit(0)).count() == 0


def test_eigen_solver():
    rng = np.random.default_rng(2)
    near = rng.normal(size=(60, 60))
    cases = [np.zeros((3, 3)), np.eye(5), np.diag([3.0, 1.0, 2.0]), np.ones((6, 6)), near @ near.T, near[:, :5] @ near[:, :5].T, 1e-12 * (near + near.T), np.diag([1e9, 1.0, 1e-9]), np.array([[2.0]]), np.kron(np.eye(4), np.array([[2.0, 1], [1, 2]]))]
    for a in cases:
        values, axes = whitening.symmetric_eigen(a)
        size = np.abs(a).max() or 1
        assert np.abs(axes @ axes.T - np.eye(len(a))).max() < 1e-12 and np.abs(axes @ a @ axes.T - np.diag(values)).max() < 1e-12 * size * len(a)
        assert (np.diff(values) <= 0).all() and np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-12 * size * len(a)


def test_moments_of_integers_are_exact():
    own = whitening.Moments(2)
    rows = np.array([[1 << 61, -1], [1 << 61, 5], [1 << 61, 2]])
    own.update(rows)
    assert own.sums == [3 << 61, 6] and own.n == 3


def test_names_of_internal_columns_do_not_clash(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0], 1, 2, 3), (2, [2.0, 5.0], 1, 2, 3)], "vec_id long, embedding array<double>, w_id long, w_x long, v long")
    assert sorted(r.w_id for r in whitening.whiten(table.withColumn("w_dims", F.lit(1))).collect()) == [1, 1, 2, 2]
