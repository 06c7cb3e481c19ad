"""Estimators, folds, geometry and bootstrap against direct numpy computations."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeweave.functions.vectors import moments, unpack
from tapeweave.operators import bootstrap as boot
from tapeweave.operators import correlation
from tapeweave.operators import estimators as est
from tapeweave.operators import geometry, probe_data, report, splits


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(11)
    n, d = 150, 4
    x = rng.normal(size=(n, d)) * [1, 5, 0.2, 3] + 2
    x[:, 3] = np.where(rng.random(n) < 0.1, np.nan, x[:, 3])
    y = np.nan_to_num(x) @ [0.5, -0.2, 1.0, 0.0] + rng.normal(size=n)
    y[::17] += 15
    role = np.where(np.arange(n) < 120, "fit", "score")
    rows = [
        ("k", 0, role[i], day(i), i, float(y[i]), [None if np.isnan(v) else float(v) for v in x[i]] + [None])
        for i in range(n)
    ]
    frame = spark.createDataFrame(rows, "key string, fold int, role string, date date, pos int, y double, x array<double>")
    return frame, x, y, role


def standardized(x, fit):
    middle = np.nanmedian(x[fit], axis=0)
    filled = np.where(np.isfinite(x), x, middle)
    return (filled - filled[fit].mean(axis=0)) / filled[fit].std(axis=0)


def test_standardize(problem):
    frame, x, _, role = problem
    got = est.standardize(frame, ["key"]).orderBy("pos").toPandas()
    np.testing.assert_allclose(np.stack(got.x), standardized(x, role == "fit"), atol=1e-9)


def test_heads_match_direct_solutions(problem):
    frame, x, y, role = problem
    fit = role == "fit"
    z = standardized(x, fit)[fit]
    centered = y[fit] - y[fit].mean()
    scaled = est.standardize(frame, ["key"])
    got = {(r.model_name, r.alpha, r.l1_ratio): r for r in est.fit(scaled, ["key"], est.REGRESSION_HEADS).collect()}
    assert len(got) == 7 + 6 + 15
    gram = z.T @ z / len(z)
    for alpha in est.GRIDS["ridge"]:
        want = np.linalg.solve(gram + alpha * np.eye(4), z.T @ centered / len(z))
        np.testing.assert_allclose(got["ridge", alpha, None].coefficients, want, atol=1e-9)
    for alpha, ratio in ((0.01, 0.5), (1.0, 0.9), (0.1, 0.1)):
        b = np.zeros(4)
        for _ in range(100):
            old = b.copy()
            for j in range(4):
                rho = z[:, j] @ (centered - z @ b + z[:, j] * b[j]) / len(z)
                b[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / ((z[:, j] ** 2).mean() + alpha * (1 - ratio))
            if np.abs(b - old).max() < 1e-8:
                break
        np.testing.assert_allclose(got["elastic_net", alpha, ratio].coefficients, b, atol=1e-7)
    assert got["huber", 0.01, None].intercept == pytest.approx(y[fit].mean())
    ridge, huber = got["ridge", 0.0001, None].coefficients, got["huber", 0.0001, None].coefficients
    truth = np.array([0.5, -0.2, 1.0]) * np.nanstd(x[fit], axis=0)[:3]
    assert np.abs(np.array(huber)[:3] - truth).sum() < np.abs(np.array(ridge)[:3] - truth).sum() + 0.5


def test_ridge_ignores_row_duplication(problem):
    frame, *_ = problem
    twice = frame.unionByName(frame)
    one, two = (est.fit(est.standardize(f, ["key"]), ["key"], ("ridge",)) for f in (frame, twice))
    a = {r.alpha: r.coefficients for r in one.collect()}
    b = {r.alpha: r.coefficients for r in two.collect()}
    for alpha in a:
        np.testing.assert_allclose(a[alpha], b[alpha], atol=1e-9)


def test_logistic_follows_plain_gradient_steps():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + rng.normal(size=80) > 0.3).astype(float)
    b, intercept = est.logistic_coefficients(x, y, np.array([0.01, 1.0]))
    w, c = np.zeros(3), np.log(y.mean() / (1 - y.mean()))
    for _ in range(400):
        error = 1 / (1 + np.exp(-np.clip(c + x @ w, -35, 35))) - y
        c -= 0.2 * error.mean()
        w -= 0.2 * (x.T @ error / 80 + 0.01 * w)
    np.testing.assert_allclose(b[0], w, atol=1e-12)
    assert intercept[0] == pytest.approx(c)


def test_selection_takes_first_best_and_falls_back(spark):
    scores = spark.createDataFrame(
        [("a", "ridge", a, None, i, f, s) for i, (a, s) in enumerate(((0.0001, 2.0), (0.1, 1.0), (1.0, 1.0))) for f in (1, 2, 3)],
        "key string, model_name string, alpha double, l1_ratio double, grid_order int, fold int, score double",
    )
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    got = {r.key: r for r in est.select_parameters(scores, keys, ["key"], ("ridge",)).collect()}
    assert got["a"].selected_alpha == 0.1 and not got["a"].selected_at_grid_boundary
    assert got["b"].selected_alpha == 1.0 and got["b"].selection_status == "insufficient_history_fallback"


@pytest.mark.parametrize("horizon", [21, 63])
def test_folds_are_chronological_and_purged(spark, horizon):
    rows = spark.createDataFrame([("w", i, horizon) for i in range(400)], "w string, pos int, horizon int")
    got = splits.expanding_folds(rows, ["w"]).toPandas()
    late = np.arange(horizon + 20, 400)
    for fold, block in enumerate(np.array_split(late, 3), start=1):
        mine = got[got.fold == fold]
        assert sorted(mine[mine.role == "score"].pos) == list(block)
        assert mine[mine.role == "fit"].pos.max() == block[0] - horizon - 1
    short = spark.createDataFrame([("w", i, horizon) for i in range(horizon + 21)], "w string, pos int, horizon int")
    assert splits.expanding_folds(short, ["w"]).count() == 0


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 3
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>").repartition(4)
    pca = geometry.fit_pca(rows, "v", 3)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = vt[:3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])[:, None]
    np.testing.assert_allclose(pca.components, want, atol=1e-8)
    np.testing.assert_allclose(pca.ratio, (s**2 / (s**2).sum())[:3], atol=1e-10)
    got = geometry.apply_pca(rows, "v", pca).orderBy("id").toPandas()
    np.testing.assert_allclose(np.stack(got.z), (x - x.mean(axis=0)) @ want.T, atol=1e-8)
    with pytest.raises(ValueError):
        geometry.fit_pca(rows, "v", 6)


def test_moments_merge_over_partitions_and_keys(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    keys = np.where(rng.random(300) < 0.7, "hot", "cold")
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in zip(keys, x)], "k string, v array<double>").repartition(6)
    for row in moments(rows, ["k"], "v", geometry=True).collect():
        part = x[keys == row.k]
        m = unpack(row.moments, 3, True)
        np.testing.assert_allclose(m.covariance, np.cov(part, rowvar=False), atol=1e-10)
        u = part / np.linalg.norm(part, axis=1, keepdims=True)
        c = (u @ u.T)[np.triu_indices(len(u), 1)]
        np.testing.assert_allclose(geometry.cosine_moments(m), (c.mean(), c.std()), atol=1e-10)


def test_pairwise_cosines_with_blocks_and_zero_rows(spark, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 4))
    x[7] = 0.0
    keys = ["a"] * 60 + ["b"] * 30
    rows = spark.createDataFrame([(k, i, [float(v) for v in r]) for i, (k, r) in enumerate(zip(keys, x))], "k string, id int, v array<double>")
    for row in geometry.pairwise_cosine_summary(rows, ["k"], "id", "v").collect():
        part = x[np.array(keys) == row.k]
        n = np.linalg.norm(part, axis=1, keepdims=True)
        u = np.divide(part, n, out=np.zeros_like(part), where=n > 0)
        c = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert row.pair_count == len(c)
        got = [row.similarity_mean, row.similarity_median, row.similarity_std, row.similarity_min, row.similarity_max]
        np.testing.assert_allclose(got, [c.mean(), np.median(c), c.std(), c.min(), c.max()], atol=1e-9)


def test_history_percentile_counts_ties(spark):
    rows = [("w", -1, 2.0)] + [("w", i, v) for i, v in enumerate((1.0, 2.0, 3.0, 4.0))]
    metrics = spark.createDataFrame(rows, "validation_window_name string, block int, m double")
    row = geometry.compare_with_history(metrics, ["m"]).first()
    assert row.validation_percentile == 50.0 and row.matched_train_median == 2.5


def test_bootstrap_draws_equal_direct_resampling(spark):
    rng = np.random.default_rng(12)
    frames = []
    for name, n in (("w1", 17), ("w2", 9)):
        a = rng.normal(size=n)
        frames.append(pd.DataFrame({
            "validation_window_name": name, "combination": "c", "date": [day(i) for i in range(n)], "horizon_days": 5,
            "actual": a, "prediction": a + rng.normal(size=n), "hand_prediction": a + rng.normal(size=n),
        }))
    frame = pd.concat(frames)
    aligned = spark.createDataFrame(frame)
    keys = ["combination"]
    got = boot.regression_draws(aligned, keys, boot.pooled_segment(keys), 40, 3).toPandas().set_index("draw")
    shapes = spark.createDataFrame([(0, 17, 5), (1, 9, 5)], "segment int, n int, block_length int")
    starts = boot.block_starts_by_shape(shapes, 40, 3).toPandas()
    assert (starts.start + starts.length <= starts.n).all()
    for draw, part in starts.groupby("draw"):
        picked = []
        for s in part.itertuples():
            source = frames[s.segment]
            picked.append(source.iloc[s.start : s.start + s.length])
        sample = pd.concat(picked)
        assert len(sample) == 26
        rmse = [np.sqrt(((sample.actual - sample[c]) ** 2).mean()) for c in ("prediction", "hand_prediction")]
        assert got.rmse_difference_vs_hand[draw] == pytest.approx(rmse[0] - rmse[1], abs=1e-9)
        assert got.pearson_correlation[draw] == pytest.approx(np.corrcoef(sample.actual, sample.prediction)[0, 1], abs=1e-9)


def test_bootstrap_auc_draws(spark):
    rng = np.random.default_rng(13)
    n = 30
    y = (rng.random(n) < 0.4).astype(float)
    p = np.round(rng.random(n), 1)
    frame = pd.DataFrame({"k": "c", "date": [day(i) for i in range(n)], "horizon_days": 7, "actual": y, "prediction": p, "hand_prediction": 0.5})
    got = boot.classification_draws(spark.createDataFrame(frame), ["k"], boot.window_segment(), 25, 3).toPandas().set_index("draw")
    starts = boot.block_starts_by_shape(spark.createDataFrame([(0, n, 7)], "segment int, n int, block_length int"), 25, 3).toPandas()
    for draw, part in starts.groupby("draw"):
        index = np.concatenate([np.arange(s.start, s.start + s.length) for s in part.itertuples()])
        ys, ps = y[index], np.clip(p[index], 1e-12, 1 - 1e-12)
        pos, neg = ys.sum(), (1 - ys).sum()
        ranks = pd.Series(ps).rank(method="average").to_numpy()
        want = (ranks[ys == 1].sum() - pos * (pos + 1) / 2) / (pos * neg) if pos * neg else 0.5
        assert got.roc_auc[draw] == pytest.approx(want)
        assert got.brier_score_difference_vs_hand[draw] == pytest.approx(((ps - ys) ** 2).mean() - ((0.5 - ys) ** 2).mean())


def test_labels_use_train_rows_only(spark):
    rows = [("w", "future_trend_score_21d", float(v)) for v in range(-5, 6)]
    train = spark.createDataFrame(rows, "validation_window_name string, raw_target string, raw_value double")
    got = {r.classification_label: r.threshold for r in probe_data.label_thresholds(train, ["validation_window_name"]).collect()}
    values = np.arange(-5, 6)
    assert got["strong_trend_21d"] == pytest.approx(np.quantile(values, 0.8))
    assert got["weak_or_chop_21d"] == pytest.approx(np.quantile(np.abs(values), 0.2))
    assert probe_data.label_thresholds(train.limit(2), ["validation_window_name"]).count() == 0


@pytest.mark.parametrize(
    "task, values, want",
    [
        ("regression", (3, 2, 0.9, 1.05, True, False, None), "SUPPORTED"),
        ("regression", (3, 2, 0.9, 1.2, True, False, None), "PROMISING"),
        ("regression", (3, 2, 0.9, 1.0, False, False, None), "INCONCLUSIVE"),
        ("regression", (3, 0, 1.2, 1.4, True, False, None), "FAILED"),
        ("regression", (3, 2, 0.9, 1.05, True, False, False), "PROMISING"),
        ("regression", (3, 2, 0.9, 1.05, True, True, None), "INVALID"),
        ("classification", (3, 2, 0.6, 0.52, True, False, None), "SUPPORTED"),
        ("classification", (3, 0, 0.45, 0.4, True, False, None), "FAILED"),
        ("classification", (3, 1, 0.52, 0.4, True, False, None), "INCONCLUSIVE"),
    ],
)
def test_result_labels(spark, task, values, want):
    windows, improved, primary, worst, stable, invalid, supported = (
        F.lit(v) if v is not None else F.lit(None).cast("boolean") for v in values
    )
    label = report.result_label(task, windows, improved, primary, worst, stable, invalid, supported)
    assert spark.range(1).select(label.alias("l")).first().l == want


def test_classification_point_estimates(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame(
        {
            "k": rng.choice(["a", "b"], 400),
            "actual": (rng.random(400) < 0.4).astype(float),
            "prediction": np.round(rng.random(400), 2),
            "hand_prediction": rng.random(400),
        }
    )
    got = {r.k: r for r in boot.classification_estimates(spark.createDataFrame(frame), ["k"]).collect()}
    for key, g in frame.groupby("k"):
        pos, neg = g[g.actual == 1].prediction.to_numpy(), g[g.actual == 0].prediction.to_numpy()
        wins = (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2
        brier = ((g.actual - g.prediction) ** 2).mean() - ((g.actual - g.hand_prediction) ** 2).mean()
        assert got[key].aligned_row_count == len(g)
        assert got[key].roc_auc == pytest.approx(wins) and got[key].brier_score_difference_vs_hand == pytest.approx(brier)


def test_all_pairs_statistics_multiply_few_blocks(spark, monkeypatch):
    """Rows in tight bundles: exact order statistics from a part of the block pairs, at any group size."""
    monkeypatch.setattr(geometry, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    x = np.repeat(centres, 120, axis=0) + 0.01 * rng.normal(size=(480, 6))
    x[5] = 0.0
    rows = spark.createDataFrame([("k", i, [float(v) for v in r]) for i, r in enumerate(x)], "k string, id int, v array<double>").repartition(5)
    rows = rows.unionByName(spark.createDataFrame([("one", 1, [1.0, 0.0])], rows.schema))
    got = geometry.pairwise_order_stats(rows, ["k"], "id", "v").collect()
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    c = (u @ u.T)[np.triu_indices(len(u), 1)]
    assert [r.k for r in got] == ["k"] and got[0].pair_count == len(c)
    np.testing.assert_allclose(
        [got[0].similarity_median, got[0].similarity_min, got[0].similarity_max], [np.median(c), c.min(), c.max()], atol=1e-12
    )
    blocks = geometry.row_blocks(rows, ["k"], "id", "v").cache()
    bounds = geometry.block_bounds(blocks, ["k"])
    wanted, counted = geometry.straddling(bounds, ["k"])
    row = counted.first()
    assert row.multiplied == wanted.count() < 0.8 * row.block_pairs
    assert max(r.n for r in blocks.collect()) <= 40
    held = {r.row_block: [np.array(v) for v in r.vectors] for r in blocks.filter("k = 'k'").collect()}
    for r in bounds.collect():  # every product is within its bounds
        a, b = (geometry._unit_rows(held[k]) for k in (r.row_block, r.other_block))
        products = (a @ b.T)[np.triu_indices(len(a), 1)] if r.row_block == r.other_block else (a @ b.T).ravel()
        assert len(products) == r["count"] and r.least <= products.min() and products.max() <= r.greatest


def tasks_of(df):
    """Tasks of the query's last stage but those that adaptive execution puts together."""
    return df.rdd.getNumPartitions()


def test_pair_correlations_are_dealt_over_all_tasks(spark):
    rows = [("all", "level", f"z_{i}", "f", day(j), float(i * j % 7), float(j)) for i in range(12) for j in range(6)]
    pairs = spark.createDataFrame(rows, "segment string, transform string, coordinate string, feature string, date date, x double, y double")
    for table in (correlation.correlations(pairs), correlation.detrended(pairs)):
        assert tasks_of(table) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_draws_of_few_keys_are_dealt_over_all_tasks(spark):
    rows = [("w", f"c{k}", day(i), 5, float((i + k) % 2), (i * k % 10) / 10, 0.5) for k in range(12) for i in range(20)]
    aligned = spark.createDataFrame(
        rows, "validation_window_name string, k string, date date, horizon_days int, actual double, prediction double, hand_prediction double"
    )
    for draw in (boot.regression_draws, boot.classification_draws):
        got = draw(aligned, ["k"], boot.pooled_segment(["k"]), 10, 3)
        assert got.groupBy("k").count().filter("count = 10").count() == 12
    # Of the regression draws adaptive execution may collect whichever side of the join it finds small.
    assert tasks_of(got) > 1


def test_heads_by_key_equal_heads_one_at_a_time(problem):
    """Rows standardized once for all heads give what a design of its own gives each head."""
    frame, *_ = problem
    inner = frame.filter("role = 'fit'").selectExpr(
        "key", "1 AS fold", "IF(pos < 90, 'fit', 'score') AS role", "date", "pos", "y", "x"
    )
    design = frame.select(*inner.columns).unionByName(inner)
    heads = ("ridge", "huber")
    scaled = est.standardize(design, ["key"]).withColumn("head", F.explode(F.array(*[F.lit(h) for h in heads])))
    selection, predictions = est.run_scaled(scaled, ["key", "head"], heads, "head")
    chosen = {r.model_name: r for r in selection.collect()}
    assert sorted(chosen) == sorted(heads) and all(r["head"] == h for h, r in chosen.items())
    for head in heads:
        one, alone = est.run_heads(design, ["key"], (head,))
        assert one.first().selected_alpha == chosen[head].selected_alpha
        want = alone.orderBy("date", "y").toPandas()
        got = predictions.filter(F.col("model_name") == head).orderBy("date", "y").toPandas()
        np.testing.assert_allclose(got.prediction, want.prediction, atol=1e-9)
