"""Split protection, robust normalization, target blocks and patch masks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeweave.operators import blocks, normalize, samples, splits, states


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def manifest(spark):
    dates = spark.createDataFrame([(day(i),) for i in range(40)], "date date")
    spine = splits.date_spine(dates, "2020-01-01")
    eligible = splits.with_sample_eligibility(
        spine, dates.filter(F.dayofmonth("date") != 13), "2020-01-05"
    )
    windows = [("w1", str(day(10)), str(day(14))), ("w2", str(day(18)), str(day(20)))]
    return splits.date_manifest(eligible, windows, lookback=4, horizon=3).toPandas().sort_values("date_idx")


def test_protection_regions(manifest):
    m = manifest.set_index("date_idx")
    assert list(m.index[m.validation_sample]) == [10, 11, 13, 14, 18, 19, 20]
    assert list(m.index[m.protected_input_lookback]) == [7, 8, 9, 15, 16, 17]
    assert list(m.index[m.protected_forward_target]) == [21, 22, 23]
    # Inside the window but not eligible: named, not flagged, still open to training.
    assert m.validation_window_name[12] == "w1" and m.train_fact_allowed[12]
    assert m.validation_window_name[16] == "w1|w2"
    assert (m.train_fact_allowed == ~m.validation_fact_allowed).all()


def test_window_without_dates_is_an_error(spark):
    dates = spark.createDataFrame([(day(i),) for i in range(5)], "date date")
    eligible = splits.with_sample_eligibility(splits.date_spine(dates, "2020-01-01"), dates, "2020-01-01")
    windows = [("late", "2021-01-01", "2021-02-01")]
    with pytest.raises(ValueError):
        splits.require_windows(splits.window_bounds(eligible, windows), windows)


def test_feature_manifest_rules():
    families = {"asset": [{"feature_family": "p", "series_source": "s", "names": ["open", "close"]}]}
    rows = splits.feature_rows(families, {"log": ["*"], "log1p": ["cl*"]})
    assert [(r[1], r[2], r[5]) for r in rows] == [(0, "open", "log"), (1, "close", "log1p")]
    families["asset"].append({"feature_family": "q", "series_source": "s", "names": ["open"]})
    with pytest.raises(ValueError):
        splits.feature_rows(families, {})


def test_normalization_fit_and_mask(spark):
    values = [float(v) for v in range(1, 102)] + [float("nan"), None, -5.0, float("inf")]
    rows = spark.createDataFrame([(v, 3.0) for v in values], "x double, flat double")
    features = [normalize.Feature("x", "log"), normalize.Feature("flat")]
    stats = normalize.fit(rows, features, (0.0, 1.0))
    scales = normalize.collect_scales(stats, features)
    logs = np.log(np.arange(1, 102))
    assert scales["x"].center == pytest.approx(np.median(logs))
    assert scales["x"].scale == pytest.approx(np.subtract(*np.quantile(logs, [0.75, 0.25])))
    assert scales["flat"].scale == 1.0
    out = rows.select("x", *normalize.value_mask_pairs([features[0]], scales)[1:], normalize.normalized(features[0], scales["x"]).alias("z"))
    bad = [r for r in out.collect() if not r["x__valid"]]
    assert len(bad) == 4 and all(r.z == 0.0 for r in bad)
    with pytest.raises(ValueError):
        normalize.collect_scales(normalize.fit(rows.limit(0), features, (0.0, 1.0)), features)


CONFIG = samples.WindowConfig(lookback=50, patch_len=1, min_masked=5, max_masked=15)


def test_target_draws_keep_their_bounds():
    eligible = np.ones(50, dtype=bool)
    eligible[[3, 9, 30]] = False
    counts = set()
    for seed in range(100):
        ids = blocks.draw_targets(eligible, np.ones(50, dtype=bool), CONFIG, np.random.default_rng(seed))
        runs = 1 + int((np.diff(ids) > 1).sum())
        assert 5 <= len(ids) <= 15 and runs <= 2 and eligible[ids].all() and (np.diff(ids) > 0).all()
        counts.add(len(ids))
    assert len(counts) > 3


def test_target_draws_fall_back():
    scattered = np.zeros(10, dtype=bool)
    scattered[::2] = True
    config = samples.WindowConfig(lookback=10, patch_len=1, min_masked=5, max_masked=5, min_blocks=2, max_blocks=2)
    ids = blocks.draw_targets(scattered, np.ones(10, dtype=bool), config, np.random.default_rng(0))
    assert list(ids) == [0, 2, 4, 6, 8]
    with pytest.raises(ValueError):
        blocks.draw_targets(scattered, scattered, config, np.random.default_rng(0))


def test_block_counts_match_enumeration():
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(30):
        eligible = rng.random(11) < 0.7
        targets = int(rng.integers(1, 6))
        ways = blocks.layout_counts(eligible, targets, 2)
        seen = {1: 0, 2: 0}
        for chosen in combinations(np.flatnonzero(eligible), targets):
            runs = 1 + sum(b - a > 1 for a, b in zip(chosen, chosen[1:]))
            if runs in seen:
                seen[runs] += 1
        assert seen == {1: ways[0, targets, 1], 2: ways[0, targets, 2]}


def test_patch_masks_equal_dense_computation(spark):
    config = samples.WindowConfig(
        lookback=12, patch_len=4, min_days_per_asset_patch=2, min_dates_in_patch=3, min_asset_fraction=0.5, min_masked=1, max_masked=2
    )
    rng = np.random.default_rng(5)
    days, assets = 30, 5
    valid = rng.random((days, assets)) < 0.45
    market = rng.random(days) < 0.6
    allowed = rng.random(days) < 0.9
    dates = spark.createDataFrame([(i, bool(allowed[i])) for i in range(days)], "date_idx int, train_fact_allowed boolean")
    asset_facts = spark.createDataFrame(
        [("train", d, a, True) for d in range(days) for a in range(assets) if valid[d, a]],
        "split string, date_idx int, asset_id int, valid_asset boolean",
    )
    streams = "split string, date_idx int, valid_date boolean"
    market_facts = spark.createDataFrame([("train", d, bool(market[d])) for d in range(days)], streams)
    macro_facts = spark.createDataFrame([], streams)
    requests = spark.createDataFrame([("train", d) for d in range(11, days)], "split string, sample_date_idx int")
    axis = spark.createDataFrame([(a,) for a in range(assets)], "asset_id int")
    validity = samples.date_validity(dates, asset_facts, market_facts, macro_facts)
    got = samples.patch_masks(requests, asset_facts, validity, axis, config).toPandas()
    assert len(got) == len(range(11, days)) * 3
    usable = market | valid.any(axis=1)
    for row in got.itertuples():
        span = slice(row.sample_date_idx - 11 + row.patch * 4, row.sample_date_idx - 11 + row.patch * 4 + 4)
        fraction = (valid[span].sum(axis=0) >= 2).mean()
        assert row.valid_asset_fraction == pytest.approx(fraction)
        assert row.patch_context == usable[span].any()
        assert row.patch_target_eligible == (usable[span].sum() >= 3 and fraction >= 0.5 and allowed[span].all())


def test_views_and_dropout_are_keyed(spark):
    facts = spark.createDataFrame(
        [("train", 5, a, True) for a in range(20)], "split string, date_idx int, asset_id int, valid_asset boolean"
    )
    requests = spark.createDataFrame([("train", 5, day(5))], "split string, sample_date_idx int, sample_date date")

    def ids(df):
        return sorted(r.asset_id for r in df.collect())

    fixed = ids(samples.fixed_view(requests, facts, "v", 6))
    assert fixed == ids(samples.fixed_view(requests.repartition(3), facts.repartition(5), "v", 6)) and len(fixed) == 6
    assert fixed != ids(samples.fixed_view(requests, facts, "v", 6, 1))
    assert ids(samples.random_view(requests, facts, 6, 1, 0)) != ids(samples.random_view(requests, facts, 6, 1, 1))
    manifest = spark.createDataFrame([("g", f"f{i}") for i in range(10)], "input_group string, feature_name string")
    config = samples.WindowConfig()
    sets = [
        frozenset(r.feature_name for r in samples.dropped_features(manifest, config, e).collect()) for e in range(5)
    ]
    assert all(len(s) == 2 for s in sets) and len(set(sets)) == 5


def test_views_refuse_samples_with_too_few_assets(spark):
    schema = "split string, date_idx int, asset_id int, valid_asset boolean"
    facts = spark.createDataFrame([("train", 5, a, a != 2) for a in range(4)] + [("train", 6, 0, True)], schema)
    requests = spark.createDataFrame(
        [("train", i, day(i)) for i in (5, 6, 7)], "split string, sample_date_idx int, sample_date date"
    )
    short = {(r.sample_date_idx, r.n_endpoint_valid_assets) for r in samples.short_views(requests, facts, 3).collect()}
    assert short == {(6, 1), (7, 0)}
    with pytest.raises(ValueError, match="2 samples have fewer than 3"):
        samples.fixed_view(requests, facts, "v", 3)
    with pytest.raises(ValueError, match="2 samples have fewer than 3"):
        samples.random_view(requests, facts, 3, seed=1)
    kept = samples.fixed_view(requests, facts, "v", 3, short="keep").groupBy("sample_date_idx").count().collect()
    assert {(r.sample_date_idx, r["count"]) for r in kept} == {(5, 3), (6, 1)}
    assert samples.fixed_view(requests.filter("sample_date_idx = 5"), facts, "v", 3).count() == 3
    with pytest.raises(ValueError, match="none of"):
        samples.random_view(requests, facts, 3, seed=1, short="drop")


def test_short_history_is_refused_or_dropped(spark):
    config = samples.WindowConfig(lookback=12, patch_len=4)
    requests = spark.createDataFrame([("train", i) for i in (10, 11, 12)], "split string, sample_date_idx int")
    with pytest.raises(ValueError, match="1 endpoints lack 12 days"):
        samples.with_history(requests, config)
    kept = samples.with_history(requests, config, "drop")
    assert sorted(r.sample_date_idx for r in kept.collect()) == [11, 12]
    assert samples.with_history(kept, config).count() == 2


def test_invalid_last_patch_is_refused_or_dropped(spark):
    vectors = spark.createDataFrame(
        [("train", s, p, [float(p), 1.0]) for s in (1, 2) for p in (0, 1)],
        "split string, sample_date_idx int, patch int, patch_vector array<double>",
    )
    masks = spark.createDataFrame(
        [("train", 1, 0, True), ("train", 1, 1, True), ("train", 2, 0, True), ("train", 2, 1, False)],
        "split string, sample_date_idx int, patch int, patch_context boolean",
    )
    assert [r.sample_date_idx for r in states.invalid_endpoints(masks, 2).collect()] == [2]
    with pytest.raises(ValueError, match="1 samples end in a patch"):
        states.pooled_states(vectors, masks, 2, 2)
    (row,) = states.pooled_states(vectors, masks, 2, 2, "drop").collect()
    assert row.sample_date_idx == 1 and row.pooled_state == [0.5, 1.0, 1.0, 1.0]
