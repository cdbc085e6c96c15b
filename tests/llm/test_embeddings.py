"""Links and groups against all pairs."""

import numpy as np
import pytest

from trendloom.llm import embeddings

from .brute import components

SCHEMA = "vec_id long, embedding array<float>, label int, rep string"


def brute(rows, cosine=0.9):
    ok = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = []
    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine * np.linalg.norm(ok[a]) * np.linalg.norm(ok[b]):
                links.append((a, b))
    return components([i for i, _ in rows], links), links


def fixture(n=300, dim=64):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(n // 3):
        base = rng.normal(size=dim)
        for noise in (0.0, 0.2, 0.4):
            rows.append((base + noise * rng.normal(size=dim)).tolist())
    rows += [rows[0], rows[0], (np.array(rows[1]) * 1e3).tolist(), None, [], [0.0] * dim, [float("nan")] * dim, [None] + [1.0] * (dim - 1), [float("inf")] * dim, [1.0, 2.0], [2.0, 4.0]]
    return [(i * 7, v) for i, v in enumerate(rows)]


def test_recall_and_precision(spark):
    rows = fixture()
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)).collect()}
    classes, links = brute(rows)
    count = {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and all(got[i]["n_links"] <= count[i] for i in got) and found >= 0.97 * 2 * len(links)
    assert all(classes[r["component_id"]] == classes[i] for i, r in got.items()) and all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    for i, v in rows[-8:-2]:
        assert (got[i]["n_links"], got[i]["component_id"]) == (0, i)


@pytest.mark.parametrize("dim", [2, 4, 6, 8, 16, 32, 33, 64, 384])
def test_recall_in_any_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    rows = []
    for i in range(60):
        a = rng.normal(size=dim)
        a /= np.linalg.norm(a)
        b = rng.normal(size=dim)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.91 * a + np.sqrt(1 - 0.91**2) * b).tolist())]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA), tile_rows=16).collect()}
    links = brute(rows)[1]
    assert sum(got.values()) <= 2 * len(links) and sum(got.values()) >= (2 if dim < embeddings.EXACT_BELOW else 0.95 * 2) * len(links)


def test_tiles_of_hot_filters(spark):
    rows = fixture(90)
    d = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    a, b = (sorted(map(tuple, embeddings.near_vectors(d, tile_rows=t).collect())) for t in (1024, 8))
    assert a == b


def test_given_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(d).collect()}
    rows = [(r["vec_id"], list(r["embedding"])) for r in d.collect()]
    _, links = brute(rows)
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * 2 * len(links)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0])]])
def test_small_tables(spark, rows):
    got = embeddings.near_vectors(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)).collect()
    assert len(got) == len(rows)


@pytest.mark.parametrize("words", [64, 128])
def test_caps_find_new_pairs_as_often_as_fitted(words):
    """Other random pairs than those that the threshold is fitted to, also with more code words."""
    rng = np.random.default_rng(99)
    for dim in (6, 12, 64):
        a, b = rng.normal(size=(2, 300, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
        t = embeddings.cap_threshold(dim, 8, words, 42, 0.9, 0.99)
        x, y = (embeddings.decode(u, 8, words, t, 42) for u in (a, b))
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y)]) >= 0.96
