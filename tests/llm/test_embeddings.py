"""Embedding links against all pairs, compared outright."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pairlens.llm import embeddings
from pairlens.llm.common import Written
from pairlens.llm.embeddings import near_vectors
from pairlens.llm.queries import ORACLE_SQL, QUERIES


def plain(rows):
    ok = [r for r in rows if r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    x = [np.array(r[1], dtype=float) for r in ok]
    links = {i: set() for i, r in enumerate(ok)}
    for i in range(len(ok)):
        for j in range(i):
            if ok[i][2] == ok[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.sqrt(x[i] @ x[i]) * np.sqrt(x[j] @ x[j])) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    label = [r[0] for r in ok]
    moved = True
    while moved:
        moved = False
        for i, near in links.items():
            low = min([label[i], *(label[j] for j in near)])
            if low < label[i]:
                label[i], moved = low, True
    out = [(r[0], len(links[i]), label[i], r[0] == label[i]) for i, r in enumerate(ok)]
    return sorted(out + [(r[0], 0, r[0], True) for r in rows if all(r is not o for o in ok)])


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_all_pairs(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert rows_of(QUERIES["op2_embeddings"](spark, sf)) == plain([(r.vec_id, r.embedding, r.label) for r in table.collect()])


@pytest.mark.parametrize("block", [16, 512])
def test_clusters_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "FAN", 2)
    monkeypatch.setattr(embeddings, "LEAF", 4)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 12))
    rows = []
    for i in range(400):
        x = centres[rng.integers(30)] + rng.normal(size=12) * rng.choice([0, 0.1, 0.3])
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(i % 3 == 0)))
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (401, [0.0] * 12, 1), (402, [nan] * 12, 1), (403, [inf] + [1.0] * 11, 1), (404, [1.0] * 12, None), (405, [None] + [1.0] * 11, 1), (406, [], 0), (407, [1.0, 2.0], 0), (408, [2.0, 4.0], 0)]
    rows += [(399, [3.0, 1.0], 0), (399, [-1.0, 5.0], 0), (399, [-1.0, 5.1], 0)]  # an id of several vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS block", "2 AS rep")
    assert rows_of(near_vectors(df)) == plain(rows)
    assert rows_of(near_vectors(df.limit(0))) == []


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({ORACLE_SQL['op2_embeddings']})").fetchall()
    assert rows_of(QUERIES["op2_embeddings"](spark, sf)) == sorted(want)


def test_most_blocks_of_clusters_never_meet(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = (centres[rng.integers(50, size=50_000)] + rng.normal(size=(50_000, 64)) * 0.03).astype(np.float32)
    pq.write_table(pa.table({"rep": pa.array(range(50_000), pa.int64()), "embedding": pa.array(list(x))}), str(tmp_path / "x.parquet"))
    classes = spark.read.parquet(str(tmp_path / "x.parquet")).selectExpr("1 AS label", "64 AS dim", "rep", "1L AS n", "embedding")
    eps, written = float(np.sqrt(2 - 2 * embeddings.COSINE)), Written(spark)
    blocks = written.table(embeddings.in_blocks(classes, embeddings.principal_axes(classes), eps))
    n = blocks.select("block").distinct().count()
    kept = {tuple(r) for r in embeddings.near_blocks(blocks, eps, written).select("a_block", "b_block").collect()}
    assert len(kept) < 0.4 * n * (n + 1) / 2
    # no link is lost: those of some vectors, against all
    at = {r.rep: r.block for r in blocks.select("rep", "block").collect()}
    u = embeddings.units(x.astype(float))
    for i in range(0, 50_000, 500):
        for j in np.flatnonzero(u @ u[i] >= embeddings.COSINE).tolist():
            assert (min(at[i], at[j]), max(at[i], at[j])) in kept


def test_large_and_small_components(spark):
    rows = [(1, [1e200, 0.0], 1), (2, [1e-200, 1e-201], 1), (3, [0.0, 1e200], 1), (4, [93e198, float(np.sqrt(1 - 0.93**2)) * 1e200], 1)]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[2] >= 1 and got[3] == 0


def test_null_ids_are_vectors_like_any_other(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (3, [1.0, 0.02], 1), (None, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (None, [-1.0, 0.0], 1), (None, None, 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = [(None, 2, 3, False), (None, 2, 3, False), (3, 2, 3, True), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (None, 0, None, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
