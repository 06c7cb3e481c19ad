"""Huber and logistic rounds: against plain iterations, and keys cut into pieces against whole keys."""

import numpy as np
import pytest

from tapeweave.operators import estimators as est
from tapeweave.operators import rounds


def plain_huber(x, y, alpha):
    """Textbook reweighted ridge, one penalty at a time."""
    y = y - y.mean()
    b, delta = np.zeros(x.shape[1]), 1.345 * max(y.std(), 1e-12)
    for _ in range(30):
        r = np.abs(y - x @ b)
        w = np.minimum(1.0, delta / np.maximum(r, 1e-12))
        b = np.linalg.inv((x * w[:, None]).T @ x / len(y) + alpha * np.eye(len(b))) @ ((x * w[:, None]).T @ y / len(y))
    return b


def huber_gradient(x, y, b, alpha):
    y = y - y.mean()
    delta = 1.345 * y.std()
    r = y - x @ b
    return -x.T @ np.clip(r, -delta, delta) / len(y) + alpha * b


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(5)
    rows, data = [], {}
    for key, n in (("small", 40), ("large", 900), ("even", 60), ("flat", 50)):
        x = rng.normal(size=(n, 3))
        y = x @ [1.0, -2.0, 0.0] + rng.standard_t(2, size=n)
        if key == "flat":
            y[:] = 1.0
        data[key] = x, y
        rows += [(key, k, 0, "fit", x[k].tolist(), float(y[k])) for k in range(n)]
    rows.append(("small", 99, 0, "score", [0.0] * 3, 1.0))
    return spark.createDataFrame(rows, "key string, pos long, fold int, role string, x array<double>, y double").repartition(5), data


def solved(design, head):
    out = {}
    for r in est.fit_iterative(design, ["key"], head).collect():
        assert (r.key, r.alpha) not in out
        out[r.key, r.alpha] = np.array([*r.coefficients, r.intercept])
    return out


def test_huber_equals_plain_iterations_and_is_optimal(design):
    frame, data = design
    found = solved(frame, "huber")
    assert len(found) == len(data) * len(est.GRIDS["huber"])
    for (key, alpha), values in found.items():
        x, y = data[key]
        np.testing.assert_allclose(values[:-1], plain_huber(x, y, alpha), atol=1e-9)
        assert values[-1] == pytest.approx(y.mean())
        if key != "flat":
            assert np.abs(huber_gradient(x, y, values[:-1], alpha)).max() < 1e-6


@pytest.mark.parametrize("head", ["huber", "logistic"])
def test_pieces_in_a_barrier_stage_give_the_same_as_whole_keys(spark, design, monkeypatch, head):
    frame = design[0]
    if head == "logistic":
        frame = frame.selectExpr("key", "pos", "fold", "role", "x", "CAST(y > 0.3 AS DOUBLE) AS y")
    monkeypatch.setattr(rounds.HEADS[head], "rounds", 7)  # an exchange takes a second
    whole = solved(frame, head)
    monkeypatch.setattr(rounds, "PIECE_ROWS", 100)
    cut = rounds.pieces(frame.filter("role = 'fit'").select("key", "fold", "pos", "x", "y"), ["key", "fold"])
    assert {r.key: r["count"] for r in cut.select("key", "piece").distinct().groupBy("key").count().collect()} == {
        "small": 1, "large": 9, "even": 1, "flat": 1,
    }
    # The pieces of the large key lie in several tasks.
    assert cut.filter("key = 'large'").repartition(4, "key", "fold", "piece").selectExpr("spark_partition_id()").distinct().count() > 1
    in_pieces = solved(frame, head)
    assert in_pieces.keys() == whole.keys()
    for key, values in whole.items():
        np.testing.assert_allclose(in_pieces[key], values, rtol=1e-8, atol=1e-8)


def test_no_rows(spark, design):
    frame = design[0].limit(0)
    assert solved(frame, "huber") == {} and solved(frame, "logistic") == {}
