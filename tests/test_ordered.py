"""Exact order statistics: the bucketed path must equal the plain one, hot keys included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeweave.functions import ordered, ranks
from tapeweave.operators import metrics


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    keys = np.where(rng.random(6000) < 0.6, "hot", rng.choice(["a", "b", "c"], 6000))
    values = np.round(rng.lognormal(0, 3, 6000), 2)
    values[:1500] = 1.25
    frame = pd.DataFrame({"k": keys, "v": values, "id": np.arange(6000), "y": (rng.random(6000) < 0.3).astype(float)})
    return spark.createDataFrame(frame).cache()


def test_percentiles_by_buckets(rows):
    shares = [0.005, 0.25, 0.5, 0.75, 0.995]
    plain = {r.k: r for r in ordered.exact_percentiles(rows, ["k"], "v", shares).collect()}
    split = {r.k: r for r in ordered.exact_percentiles(rows, ["k"], "v", shares, rows_per_bucket=200).collect()}
    frame = rows.toPandas()
    assert plain.keys() == split.keys() == set(frame.k)
    for key, group in frame.groupby("k"):
        want = np.quantile(group.v, shares)
        np.testing.assert_allclose(plain[key].percentiles, want, rtol=1e-12)
        np.testing.assert_allclose(split[key].percentiles, want, rtol=1e-12)
        assert split[key].value_count == len(group)


@pytest.mark.parametrize("limit", [10**9, 150])
def test_average_ranks(rows, limit):
    got = ordered.average_ranks(rows, ["k"], {"v": "rank"}, limit).toPandas().sort_values("id")
    want = rows.toPandas().sort_values("id")
    want["rank"] = want.groupby("k").v.rank(method="average")
    np.testing.assert_allclose(got["rank"], want["rank"])


@pytest.mark.parametrize("limit", [10**9, 150])
def test_average_ranks_of_two_columns_keep_heavy_ties_apart(spark, limit):
    """Values that hold whole buckets, nulls in keys and values"""
    rng = np.random.default_rng(5)
    n = 5000
    frame = pd.DataFrame({"k": rng.choice(["a", "b"], n).astype(object), "v": np.round(rng.normal(size=n), 3), "w": rng.normal(size=n), "id": np.arange(n)})
    frame.loc[rng.random(n) < 0.5, "v"] = 0.25
    frame.loc[rng.random(n) < 0.4, "w"] = -1.0
    rows = [(None if i % 7 == 0 else r.k, None if i % 50 == 0 else r.v, r.w, i) for i, r in enumerate(frame.itertuples())]
    df = spark.createDataFrame(rows, "k string, v double, w double, id int")
    got = ordered.average_ranks(df, ["k"], {"v": "rv", "w": "rw"}, limit).toPandas().sort_values("id")
    want = df.toPandas().sort_values("id")
    for value, rank in (("v", "rv"), ("w", "rw")):
        ranks = want.groupby("k", dropna=False)[value].rank(method="average", na_option="top")
        np.testing.assert_allclose(got[rank], ranks)


@pytest.mark.parametrize("limit", [10**9, 150])
def test_running_sums(rows, limit):
    ties = ordered.tie_counts(rows, ["k"], "v", total=F.col("y"))
    got = ordered.running_before(ties, ["k"], "v", ["ties", "total"], limit).toPandas()
    for _, g in got.sort_values("v").groupby("k"):
        np.testing.assert_allclose(g.ties_before, g.ties.cumsum() - g.ties)
        np.testing.assert_allclose(g.total_before, g.total.cumsum() - g.total)


@pytest.mark.parametrize("limit", [10**9, 150])
def test_classification_curves(rows, limit):
    scored = rows.select("k", "id", F.col("y").alias("actual"), (F.col("v") / (F.col("v") + 1)).alias("prediction"))
    auc = {r.k: r.roc_auc for r in metrics.roc_auc(scored, ["k"], limit).collect()}
    precision = {r.k: r.pr_auc for r in metrics.average_precision(scored, ["k"], "id", limit).collect()}
    for key, g in scored.toPandas().groupby("k"):
        p = np.clip(g.prediction, 1e-12, 1 - 1e-12)
        ranks = p.rank(method="average")
        pos, neg = int(g.actual.sum()), int((1 - g.actual).sum())
        assert auc[key] == pytest.approx((ranks[g.actual == 1].sum() - pos * (pos + 1) / 2) / (pos * neg))
        s = g.assign(p=p).sort_values(["p", "id"], ascending=[False, True]).actual.to_numpy()
        assert precision[key] == pytest.approx((s * s.cumsum() / (np.arange(len(s)) + 1)).sum() / pos)


def test_lowest_by_hash_is_exact(rows):
    keyed = rows.withColumn("digest", F.sha2(F.col("id").cast("string"), 256))
    got = ordered.lowest_by_hash(keyed, ["k"], "digest", 100).toPandas()
    want = keyed.toPandas().sort_values("digest").groupby("k").head(100)
    assert sorted(got.id) == sorted(want.id)


def test_constant_sides_score_zero(spark):
    frame = pd.DataFrame({"k": ["a"] * 4, "actual": [1.0, 1.0, 1.0, 1.0], "prediction": [1.0, 2.0, 3.0, None]})
    row = metrics.full_regression_metrics(spark.createDataFrame(frame), ["k"]).first()
    assert (row.scored_count, row.r2, row.pearson_correlation, row.spearman_correlation) == (3, 0.0, 0.0, 0.0)


def test_positions_follow_the_order_of_strings(spark):
    names = [f"{c}{i}" for c in "Zaä" for i in range(150)] + ["", "Z", "é"]
    frame = spark.createDataFrame([(n, len(n)) for n in reversed(names)], "name string, size int").repartition(7)
    placed = ordered.with_positions(frame, ["name"], "place")
    assert placed.columns == ["name", "size", "place"]
    got = sorted(placed.collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(len(names)))
    assert [r.name for r in got] == sorted(names, key=lambda n: n.encode())
    assert ordered.with_positions(frame.limit(0), ["name"], "place").count() == 0


@pytest.fixture(scope="module")
def listed(spark):
    """Outcomes with heavy ties, two group columns with nulls, predictors that are missing, infinite, tied and constant."""
    rng = np.random.default_rng(3)
    n = 4000
    actual = np.where(rng.random(n) < 0.3, 0.0, np.round(rng.normal(size=n), 2))
    noisy, tied = actual * 0.5 + rng.normal(size=n), np.where(rng.random(n) < 0.4, -0.0, np.round(rng.normal(size=n), 1))
    rows = [
        (
            "ab"[i % 3 // 2],
            None if i % 4 == 0 else "ab"[i % 2],
            None if i % 37 == 0 else float(actual[i]),
            [None if i % 11 == 0 else float(noisy[i]), float("inf") if i % 13 == 0 else float(tied[i]), 1.5],
        )
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k string, m string, actual double, listed array<double>").cache()


@pytest.mark.parametrize("limit", [10**9, 150, 30])
def test_listed_ranks_of_every_predictor(listed, limit):
    names = ["noisy", "tied", "constant"]
    got = {
        (r.k, r.m, r.predictor_name): r.spearman_correlation
        for r in metrics.listed_spearman(listed, ["k", "m"], "listed", names, limit).collect()
    }
    frame = listed.select("k", "m", "actual", *[F.col("listed")[i].alias(n) for i, n in enumerate(names)]).toPandas()
    frame = frame.replace([np.inf], np.nan)
    wanted = {}
    for (k, m), g in frame.groupby(["k", "m"], dropna=False):
        for name in names:
            known = g[["actual", name]].dropna()
            level = known.actual.rank().corr(known[name].rank()) if known[name].nunique() > 1 else 0.0
            wanted[k, None if pd.isna(m) else m, name] = level
    assert got.keys() == wanted.keys() and len(got) == 18
    for key, level in wanted.items():
        assert got[key] == pytest.approx(level, abs=1e-12), key
    assert {got[k] for k in got if k[2] == "constant"} == {0.0}


def test_ranks_sort_an_outcome_once_in_blocks(listed):
    """A task ships blocks of rows, not rows, and heavy ties as sums."""
    _, sums = ranks.rank_sums(listed, ["k", "m"], "actual", "listed", 3, 150)
    found = sums.toPandas()
    assert found[found._place == 0]._n.sum() == listed.filter("actual IS NOT NULL AND listed[0] IS NOT NULL").count()
    constant = found[found._place == 2]
    assert (constant._b % 2 == 1).any() and (constant._sbb == 0).all() and len(constant) < 400


def test_groups_of_shifted_nulls_stay_apart(spark):
    rows = [("a", None, float(i), float(i)) for i in range(9)] + [(None, "a", float(i), float(-i)) for i in range(9)]
    frame = spark.createDataFrame(rows, "k string, m string, actual double, prediction double")
    got = {(r.k, r.m): r.spearman_correlation for r in metrics.spearman(frame, ["k", "m"]).collect()}
    assert got == {("a", None): pytest.approx(1.0), (None, "a"): pytest.approx(-1.0)}
