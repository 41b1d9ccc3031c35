import numpy as np
import pytest

from strikeflow.llm import embedding_dedup as E


def brute(ids, x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= threshold) & ~np.eye(len(x), dtype=bool)
    return near


def test_links(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 32))
    x = [rng.standard_normal((400, 32))]
    for c, n in zip(centres, [3] * 20 + [12] * 9 + [80], strict=True):
        x.append(c + 0.15 * rng.standard_normal((n, 32)))
    x = np.concatenate(x).astype(np.float32).astype(np.float64)
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in E.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    near = brute(range(len(x)), x, 0.9)
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum()
    assert got[5]["n_links"] == 2 and got[7]["component_id"] == 5 and not got[7]["kept"] and got[5]["kept"]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]), (10, [1e300, 0.0]), (11, [1e-300, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, node long, exact string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.embedding_near_dedup(df).collect()), key=str)
    want = [(1, 5, 1, True), (2, 5, 1, False), (2, 5, 1, False), (10, 5, 1, False), (11, 5, 1, False), (None, 5, 1, False), (None, 0, None, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted(want, key=str)
    assert E.embedding_near_dedup(df.limit(0)).count() == 0


def test_audit(spark):
    x = np.eye(8)
    x[1] = x[0] + [0, 0.1, 0, 0, 0, 0, 0, 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "node long, exact binary")
    counts = spark.createDataFrame([(0, 1), (1, 1)], "node long, n long")
    assert E.audit_recall(nodes, counts, nodes, 0.9) == 1.0
    assert E.audit_recall(nodes, counts.limit(1), nodes, 0.9) == 0.5
    assert E.audit_recall(nodes, counts.limit(0), nodes, 0.9) == 0.0


@pytest.mark.parametrize("pairs", [15, 100])
def test_isolated_pairs_are_found(spark, pairs):
    rng = np.random.default_rng(pairs)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = rng.standard_normal((pairs, 64))
    v -= (v * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    x[pairs : 2 * pairs] = 0.92 * x[:pairs] + np.sqrt(1 - 0.92**2) * v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in E.embedding_near_dedup(df).where("n_links > 0").collect()}
    assert all(r["n_links"] == 1 and r["component_id"] == i % pairs for i, r in got.items())
    assert len(got) >= 0.97 * 2 * pairs


@pytest.mark.parametrize(("dense", "block"), [(E.DENSE, E.DENSE_BLOCK), (40, 64)])
def test_large_cluster_is_counted_in_full(spark, monkeypatch, dense, block):
    monkeypatch.setattr(E, "DENSE", dense)
    monkeypatch.setattr(E, "DENSE_BLOCK", block)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal(24) + 0.2 * rng.standard_normal((1000, 24)), rng.standard_normal((300, 24))])
    x[7] = x[9]
    near = brute(None, x, 0.95)
    # A cosine of 0.95 within rounding may fall on either side.
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert not (np.abs(u @ u.T - 0.95) < 1e-12).any()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in E.embedding_near_dedup(df, 0.95).collect()}
    links, want = np.array([got[i]["n_links"] for i in range(len(x))]), near.sum(1)
    assert (links <= want).all() and links.sum() >= 0.97 * want.sum() and want.max() > 300
    many = want >= 1.2 * dense
    assert many.sum() > 100 and (links[many] >= 0.97 * want[many]).all()


def test_trees():
    linked = np.zeros((9, 9), bool)
    for a, b in ((8, 3), (3, 5), (5, 0), (1, 7), (7, 2)):
        linked[a, b] = linked[b, a] = True
    assert E._trees(linked).tolist() == [0, 1, 1, 0, 4, 0, 6, 1, 0]


def test_few_vectors_in_many_partitions(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = E.embedding_near_dedup(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 1)]


def test_a_cosine_of_just_the_threshold_links(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [2.9999, 4.0]), (4, [-1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.6).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (0, 4)}


def test_a_search_that_does_not_get_there_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(E, "ROUNDS_MAX", 4)
    monkeypatch.setattr(E, "audit_recall", lambda *_: 0.5)
    x = np.random.default_rng(1).standard_normal((60, 8))
    with pytest.raises(RuntimeError, match="recall"):
        E.embedding_near_dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).count()


def test_clusters_that_no_list_joins(spark, monkeypatch):
    """Two clusters whose vectors have full lists of nearer ones of their own: the fresh pair joins them, and all links between them count."""
    monkeypatch.setattr(E, "DENSE", 12)
    monkeypatch.setattr(E, "JOINED", 4)
    rng = np.random.default_rng(2)
    d, n = 24, 60
    a = np.zeros(d)
    a[0] = 1
    b = np.zeros(d)
    b[0], b[1] = 0.935, np.sqrt(1 - 0.935**2)
    x = np.concatenate([c + 0.02 * rng.standard_normal((n, d)) for c in (a, b)])
    near = brute(range(2 * n), x, 0.9)
    assert near[:n, n:].mean() > 0.9
    got = {r["vec_id"]: r["n_links"] for r in E.embedding_near_dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.97 * near.sum() and all(got[i] <= near[i].sum() for i in got)
    clusters = spark.createDataFrame([(i, i // n) for i in range(2 * n)], "node long, cluster long")
    pairs = spark.createDataFrame([(3, 70, 0.93), (5, 90, 0.92), (1, 2, 0.99), (4, 80, 0.5)], "a long, b long, sim float")
    assert [tuple(r) for r in E._joins(pairs, clusters, 0.9).collect()] == [(3, 70)]
