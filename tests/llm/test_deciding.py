"""Queries whose rules decide nothing on the small given tables, against their SQL on made tables where they do: lines are removed and documents rejected, vectors are linked."""

import duckdb
import numpy as np
import pyarrow as pa

from loomgrid.llm.queries import ORACLE_SQL, QUERIES


def both(spark, monkeypatch, name, table, rows, schema, arrow):
    spark.createDataFrame(rows, schema).createOrReplaceTempView("made_rows")
    monkeypatch.setattr("loomgrid.llm.queries.table", lambda *_: spark.table("made_rows"))
    found = QUERIES[name](spark, "")
    con = duckdb.connect()
    con.register(table, pa.Table.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow))
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    return sorted(tuple(r[c] for c in columns) for r in found.collect()), sorted(result.fetchall()), columns


def test_rejections_of_the_line_rule_equal_sql(spark, monkeypatch):
    own = lambda i, n: "\n".join(" ".join(f"w{(i * 7919 + j * 104729 + k) % 99991}" for k in range(10)) for j in range(n))
    rows = [(i, own(i, 6) + ("\nRead  more of this" if i % 20 == 0 else ""), "en", "hot") for i in range(400)]
    rows += [(1000 + i, own(1000 + i, 4) + "\nread more\tof this" * (3 + i), "en", "hot") for i in range(6)] + [(2000 + i, own(2000 + i, 4) + "\nRead more of this" * 4, "en", "cold") for i in range(3)]
    rows += [(3000 + i, "few words", "en", None) for i in range(4)] + [(4000, None, "en", None), (4001, own(9, 8), None, None)]
    rows = [(*r, len(r[1] or "")) for r in rows]
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    got, want, columns = both(spark, monkeypatch, "op4_quality_rules", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long", arrow)
    assert got == want
    kept, failed, key = (columns.index(c) for c in ("kept", "base_failed", "doc_id"))
    assert {r[key] for r in got if not r[kept] and not r[failed]} == {1000 + i for i in range(6)}


def test_links_of_vectors_equal_sql(spark, monkeypatch):
    rng = np.random.default_rng(11)
    tight = np.repeat(rng.normal(size=(40, 16)), 4, axis=0) + rng.normal(scale=0.06, size=(160, 16))
    angle = np.arccos(0.96) * np.arange(6)
    path = np.zeros((6, 16))
    path[:, 0], path[:, 1] = np.cos(angle), np.sin(angle)
    x = np.concatenate([tight, path, np.repeat(rng.normal(size=(1, 16)), 30, axis=0), rng.normal(size=(60, 16)), np.zeros((1, 16))]).astype(np.float32)
    rows = [(int(i), v.tolist(), 0) for i, v in zip(rng.permutation(len(x)), x, strict=True)] + [(9000, None, 0), (9001, [float("nan")] * 16, 0)]
    arrow = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    got, want, columns = both(spark, monkeypatch, "op6_embedding_near_dedup", "embeddings", rows, "vec_id long, embedding array<float>, label int", arrow)
    assert got == want
    links, kept = columns.index("n_links"), columns.index("kept")
    assert sum(r[links] > 0 for r in got) > 100 and sum(not r[kept] for r in got) > 60


def test_dropped_lines_equal_sql(spark, monkeypatch):
    shared = [f"A line that several documents hold, number {k}, and that is long enough" for k in range(9)]
    rows = [(i, "\n".join([f"own {i}", *[s if i % 2 else f"  {s.upper()}\r" for k, s in enumerate(shared) if i % (k + 2) == 0]]), "en", "a", 1) for i in range(60)] + [(None, shared[0], None, None, None), (61, None, "en", "a", 0), (5, shared[0] + "\n\n", "en", "a", 1)]
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    key = lambda r: tuple(str(x) for x in r)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").createOrReplaceTempView("made_rows")
    monkeypatch.setattr("loomgrid.llm.queries.table", lambda *_: spark.table("made_rows"))
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow))
    for name in ("op12_line_dedup", "op11_merkle_manifest"):
        result = con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in result.description]
        got = sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, "").collect()), key=key)
        assert got == sorted(result.fetchall(), key=key)
        assert name[:4] != "op12" or sum(r[columns.index("n_dropped")] for r in got) > 50
