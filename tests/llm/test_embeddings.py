import numpy as np
import pytest
from tallylens.llm import embedding_dedup as E
from tallylens.llm.components import connected_components


def brute(rows, threshold=0.9):
    """(vec_id, n_links, component_id) of distinct ids by all pairs."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    pairs = []
    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return {(i, links[i], label[i]) for i, _ in rows}


def test_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = {(r.vec_id, r.n_links, r.component_id) for r in E.link_vectors(table).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("bucket", [8, 1024])
def test_large_groups_are_dealt_into_blocks(spark, monkeypatch, bucket):
    monkeypatch.setattr(E, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((3, 16))
    rows = [(int(k), [float(x) for x in base[k % 3] + 0.08 * rng.standard_normal(16)]) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.n_links, r.component_id) for r in E.link_vectors(table).collect()} == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [1.0, 0.0]), (7, [2.0, -0.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [1e300, 1e-300])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, id string, links int")
    assert {(r.vec_id, r.n_links, r.component_id) for r in E.link_vectors(table).collect()} == brute(rows[:-1]) - {(6, 1, 6), (7, 1, 6)} | {(6, 2, 6), (7, 2, 6), (10, 2, 6)}
    assert E.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned, signs, factor = E.codes(x, E.rotation(64))
    near, width = E.estimate(turned, signs, factor)
    off = ~np.eye(400, dtype=bool)
    error = (near - x @ x.T)[off]
    assert abs(error.mean()) < 0.003
    assert (np.abs(near - x @ x.T) <= width)[off].mean() > 0.995


def test_bands_reach_recall():
    rng, bits = np.random.default_rng(2), 10
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    planes = rng.standard_normal((E.bands(bits) * bits, 64))
    same = ((a @ planes.T >= 0) == (b @ planes.T >= 0)).reshape(4000, -1, bits).all(2).any(1)
    assert same.mean() >= 0.98


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 20), (30, None), (4, 1)] + [(100, k) for k in range(101, 140)]
    got = {(r.id, r.component) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(k, 1) for k in (1, 2, 3, 4)} | {(k, 8) for k in (8, 9, 10)} | {(k, 100) for k in range(100, 140)}


def test_oracle(spark):
    import duckdb
    from tallylens.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = {(r[0], r[1], r[2], r[3]) for r in duckdb.sql(ORACLE_SQL["op10_embedding_dedup"]).fetchall()}
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in QUERIES["op10_embedding_dedup"](spark, sf).collect()}
    assert got == want
