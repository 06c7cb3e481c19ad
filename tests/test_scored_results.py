"""Results of long prediction tables: row counts and identity without sorting the rows, ranks made before."""

import pytest
from pyspark.sql import functions as F

from tapeweave.operators import metrics, probes, report


@pytest.fixture(scope="module")
def predictions(spark):
    """One target, two predictors; a key whose rows disagree on the head's name, one invalid and one missing prediction."""
    rows = [("w", "future_return_5d", n, i % 2, float(i), None if i == 3 else i * s) for n, s in (("train_mean", 0.0), ("m", 0.5)) for i in range(8)]
    frame = spark.createDataFrame(rows, "validation_window_name string, target string, predictor_name string, odd int, actual double, prediction double")
    return frame.select(
        "*",
        F.col("target").alias("raw_target"),
        F.lit("raw").alias("target_transform"),
        F.lit("regression").alias("task_type"),
        F.lit("original").alias("score_space"),
        F.col("target").alias("score_target_name"),
        F.lit(5).alias("horizon_days"),
        F.lit("model").alias("predictor_kind"),
        F.when(F.col("odd") == 1, "zeta").otherwise("alpha").alias("model_name"),
        F.lit("constant").alias("feature_family"),
        F.col("prediction").isNull().alias("invalid_prediction"),
        (F.col("prediction") > 3).alias("inverse_prediction_clipped"),
    )


def test_counts_keep_the_least_identity_without_sorting_rows(predictions):
    counted = probes._counted(predictions)
    assert "SortAggregate" not in counted._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]
    got = {r.predictor_name: r for r in counted.collect()}
    assert {r.model_name for r in got.values()} == {"alpha"} and got.keys() == {"train_mean", "m"}
    m = got["m"]
    assert (m.validation_count, m.invalid_prediction_count, m.inverse_prediction_clip_count) == (8, 1, 1)


def test_results_take_ranks_made_before(predictions):
    ranks = metrics.spearman(predictions, probes.CORE)
    plain = probes.regression_results(predictions)
    given = probes.regression_results(predictions, ranks)
    assert plain.columns == given.columns and sorted(plain.collect()) == sorted(given.collect())
    pooled = report.pooled_results(predictions, ranks=metrics.spearman(predictions, report.POOLED_KEYS))
    assert sorted(pooled.collect()) == sorted(report.pooled_results(predictions).collect())


def test_a_constant_side_scores_zero_however_its_parts_are_merged(spark):
    rows = spark.range(3000).repartition(7).select(
        (F.col("id") % 40).alias("k"), (F.col("id") * 0.37).alias("actual"), (F.col("id") % 40 / 7 + 0.1).alias("prediction")
    )
    forth = metrics.regression_metrics(rows, ["k"]).collect()
    assert {(r.prediction_std, r.pearson_correlation, r.std_ratio) for r in forth} == {(0.0, 0.0, 0.0)} and len(forth) == 40
    turned = rows.select("k", F.col("prediction").alias("actual"), F.col("actual").alias("prediction"))
    assert {(r.actual_std, r.r2, r.std_ratio) for r in metrics.regression_metrics(turned, ["k"]).collect()} == {(0.0, 0.0, 0.0)}
