import math

import numpy as np
import pytest

from opquality.llm import queries
from opquality.llm.whitening import refined_eigenvectors, whiten


def turned(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))
    a = (q * np.asarray(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 40, 40), [1 + 1e-9 * k for k in range(10)] + list(range(2, 30)), [1.0] * 12, [5.0] * 6 + [3.0] * 6 + [1.0], np.geomspace(1e-9, 1, 40), [0.0] * 4, [2.0], [1e-300, 1.0, 1e300],
])
def test_eigenvectors_to_the_precision_of_a_double(values):
    a = turned(values)
    x = refined_eigenvectors(a).astype(np.float64)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14
    assert np.abs((a / scale) @ x - x * np.diagonal(x.T @ (a / scale) @ x)).max() < 1e-14


def test_close_eigenvalues_are_told_apart():
    values = np.array([1.0, 1 + 1e-11, 1 + 2e-11, 4.0])
    a = turned(values)
    x = refined_eigenvectors(a)
    off = np.abs(x.T @ a.astype(np.longdouble) @ x - np.diag(np.diagonal(x.T @ a.astype(np.longdouble) @ x))).max()
    assert off < 1e-17


def rows_of(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, "own") for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, id string").repartition(3)


def plain(vectors, most=32):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:most]
    order = order[e[order] > len(v) * 2.3e-16 * e.max()]
    return (((n * x - s) ** 2).sum(axis=1)), centred @ u[:, order] / np.sqrt(e[order]), e[order], np.trace(v)


def test_whitened_as_by_a_plain_solver(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(400, 12)) * np.geomspace(0.5, 20, 12)).tolist()
    vectors += vectors[:3]
    left_out = [None, [1.0] * 11, [], [float("nan")] + [0.0] * 11, [math.inf] * 12, [None] * 12]
    ids = list(range(len(vectors))) + [7, None, 900, 901, 902, 903]
    frame, model, error = whiten(rows_of(spark, vectors + left_out, ids), most=5)
    deviation, whitened, e, trace = plain(vectors, 5)
    got = sorted((r.id, r.deviation, list(r.whitened)) for r in frame.collect())
    assert [g[0] for g in got] == list(range(len(vectors))) and [g[1] for g in got] == deviation.tolist()
    found = np.array([g[2] for g in got])
    found *= np.sign((found * whitened).sum(axis=0))
    assert np.abs(found - whitened).max() < 1e-10
    assert model.n == len(vectors) and np.allclose(model.eigenvalues, e, rtol=1e-12) and abs(model.trace / trace - 1) < 1e-12 and error < 1e-10


def test_flat_dimensions_are_no_components(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-50, 50, size=(100, 3)) / 64
    vectors = np.concatenate([base, base[:, :1], np.full((100, 2), 0.5)], axis=1).tolist()
    frame, model, error = whiten(rows_of(spark, vectors))
    assert len(model.eigenvalues) == 3 and error < 1e-9 and {len(r.whitened) for r in frame.collect()} == {3}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_nothing_to_whiten(spark, vectors):
    frame, model, error = whiten(rows_of(spark, vectors))
    assert error == 0.0 and len(model.eigenvalues) == 0
    assert [(r.deviation, r.whitened) for r in frame.collect()] == [(0, [])] * len([v for v in vectors if v])


def test_entries_beyond_a_long_and_large_deviations(spark):
    frame, model, _ = whiten(rows_of(spark, [[1e30, 0.0], [1e14, 0.0], [-1e14, 1.0], [0.0, 0.5]]))
    got = {r.id: r.deviation for r in frame.collect()}
    assert set(got) == {1, 2, 3} and got[1] is None and got[2] is None


def test_the_query_on_its_table(spark, tmp_path):
    vectors = np.random.default_rng(3).normal(size=(300, 40)).tolist()
    rows_of(spark, vectors + [None]).drop("id").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op12_whitening(spark, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = got.collect()
    deviation, whitened, e, trace = plain(vectors)
    assert len(rows) == 300 * 32 and {r.n for r in rows} == {300} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-4
    assert all(abs(r.explained - e[r.component - 1] / trace) <= 1e-12 for r in rows) and all(r.deviation == deviation[r.vec_id] for r in rows)
    found = np.zeros((300, 32))
    for r in rows:
        found[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.abs(found) - np.abs(whitened)).max() < 1e-9
