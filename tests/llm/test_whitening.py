"""Whitening and its eigensolver against numpy's."""

import numpy as np
import pandas as pd
import pytest

from tapeweave.llm import whitening
from tapeweave.llm.spectral import divide, eigen, polar


def spectra():
    n = 24
    yield "geometric", 2.0 ** -np.arange(n)
    yield "groups", np.repeat([3.0, 2.0, 1.0, 0.0], n // 4)
    yield "one large", np.r_[1e6, np.ones(n - 1)]
    yield "multiple of one", np.full(n, 7.0)
    yield "zero", np.zeros(n)
    yield "close", 1 + 1e-10 * np.arange(n)
    yield "low rank", np.r_[np.arange(1, 5), np.zeros(n - 4)]
    yield "indefinite", np.linspace(-5, 5, n)


@pytest.mark.parametrize(("name", "values"), list(spectra()))
def test_eigen(name, values):
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values), len(values))))[0]
    a = (q * values) @ q.T
    found, vectors = eigen(a)
    size = max(1e-300, np.abs(values).max())
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * size


def test_eigenvectors_equal_those_of_a_plain_solver():
    for d in (1, 2, 3, 17, 64):
        x = np.random.default_rng(d).standard_normal((400, d)) * np.linspace(1, 3, d)
        a = np.cov(x.T, bias=True).reshape(d, d)
        _, vectors = eigen(a)
        plain = np.linalg.eigh(a)[1][:, ::-1]
        plain *= np.sign(plain[np.abs(plain).argmax(axis=0), np.arange(d)])
        assert np.abs(vectors - plain).max() < 1e-11


def test_polar_and_division():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    u = polar(a)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(u - (vectors * np.sign(values)) @ vectors.T).max() < 1e-12
    upper, lower = divide(a, 1e-12, rng)
    assert np.linalg.norm(lower.T @ a @ upper) < 1e-12
    assert np.linalg.eigvalsh(upper.T @ a @ upper).min() > np.linalg.eigvalsh(lower.T @ a @ lower).max()
    assert divide(np.eye(4) * 5, 1e-12, rng) is None
    assert eigen(np.zeros((0, 0)))[0].size == 0


def plain(vectors):
    x = np.floor(1024 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    centred = x - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:8], directions[:, ::-1][:, :8]
    return n, deviation, centred @ directions / np.sqrt(values), values / (centred**2).sum() * n


def test_query_equals_the_plain_version(spark, sf):
    table = pd.read_parquet(f"{sf}/embeddings.parquet")
    n, deviation, whitened, explained = plain(np.stack(table["embedding"]))
    rows = whitening.op12_embedding_whitening(spark, sf).toPandas()
    assert len(rows) == 8 * len(table) and set(rows["n"]) == {n} and rows["identity_error"].nunique() == 1
    assert rows["identity_error"].iloc[0] < 1e-10
    assert dict(zip(rows["vec_id"], rows["deviation"])) == dict(zip(table["vec_id"], deviation))
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[table["vec_id"]].to_numpy()
    signs = np.sign((wide * whitened).sum(axis=0))
    assert np.abs(wide * signs - whitened).max() < 1e-9
    shares = rows.groupby("component")["explained"].agg(["min", "max"])
    assert np.allclose(shares["min"], explained, rtol=1e-10) and (shares["min"] == shares["max"]).all()


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, n string, v string, id string, whitened int"
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [1.0, 2.0], [3.0, -1.0], [0.5, 0.25], None, [], [1.0, None], [nan, 1.0], [1.0, -inf], [1e30, 0.0], [1.0]]
    rows = [(k if k != 3 else None, v, 1, "x", "x", "x", 1) for k, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows, schema).repartition(3)).orderBy("vec_id").collect()
    assert [r.vec_id for r in found] == [None, 0, 1, 2]
    n, deviation, whitened, explained = plain([vectors[k] for k in (3, 0, 1, 2)])
    assert [int(r.deviation) for r in found] == deviation and {r.n for r in found} == {4}
    assert np.allclose(np.abs([r.whitened for r in found]), np.abs(whitened)) and np.allclose(found[0].explained, explained)
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_no_variance_and_low_rank(spark):
    schema = "vec_id long, embedding array<double>"
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5, 1.0])] * 3, schema)).collect()
    assert len(one) == 3 and all(r.whitened == [0.0] * 3 and r.explained == [0.0] * 3 and r.identity_error == 0 and r.deviation == 0 for r in one)
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], schema)).collect()
    assert all(r.whitened[1:] == [0.0, 0.0] and r.identity_error < 1e-12 for r in line)
    assert abs(line[0].explained[0] - 1) < 1e-12


def test_deviation_is_exact_beyond_longs():
    model = whitening.Whitening(10**7, np.array([10**12, -(10**12)]), np.zeros((2, 0)), np.zeros(0), 1.0)
    x = np.array([[10**9, -(10**9)], [100_000, 0]])
    assert model.deviation(x) == [sum((10**7 * int(a) - s) ** 2 for a, s in zip(row, (10**12, -(10**12)))) for row in x]
