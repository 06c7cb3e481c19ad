"""Canonical tables over the driver tables, each layer written once and then read back.

The layers feed each other: bars, panel, date features, manifests and facts. A layer is
built from the given tables on first use in a session and written to the shared folder,
so that no job scans the raw tables twice and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.operators import crosssec, dims, macro, normalize, panel, samples, splits, targets
from tapeweave.session import folder_mark, scratch_path
from tapeweave.sources import driver_tables as src

SERIES_NAMES = [name for _, _, name, _, _ in src.SERIES]

Builder = Callable[[SparkSession, str], DataFrame]
_WRITTEN: dict[tuple[str, str, str, str], tuple[str, object]] = {}


def layer(build: Builder) -> Builder:
    """Write the table a builder describes on first use and read it back from then on.

    A changed file in the source folder makes a new layer.
    """

    def table(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, folder_mark(spark, sf), build.__name__)
        if key not in _WRITTEN:
            df = build(spark, sf)
            path = scratch_path(spark, build.__name__)
            df.write.option("compression", "zstd").parquet(path)
            _WRITTEN[key] = (path, df.schema)
        path, schema = _WRITTEN[key]
        return spark.read.schema(schema).parquet(path)

    table.__name__ = build.__name__
    table.__doc__ = build.__doc__
    return table


@layer
def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars: no other layer scans the line items."""
    return src.bars(spark, sf)


def prices(spark: SparkSession, sf: str) -> DataFrame:
    return src.normalized_prices(bars(spark, sf), "lineitem")


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return dims.trading_days(bars(spark, sf))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return dims.symbol_manifest(prices(spark, sf), src.symbol_metadata(spark, sf))


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    return panel.align(prices(spark, sf), calendar(spark, sf), manifest(spark, sf))


def ticker_features(spark: SparkSession, sf: str) -> DataFrame:
    return panel.asset_features(aligned(spark, sf))


def market_features(spark: SparkSession, sf: str) -> DataFrame:
    return crosssec.cross_section(crosssec.stock_rows(ticker_features(spark, sf)))


def available_macro(spark: SparkSession, sf: str) -> DataFrame:
    return macro.with_availability(src.macro_observations(spark, sf), src.series_definitions(spark))


def macro_features(spark: SparkSession, sf: str) -> DataFrame:
    return macro.macro_features(available_macro(spark, sf), calendar(spark, sf), SERIES_NAMES)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return crosssec.date_features(market_features(spark, sf), macro_features(spark, sf))


def market_targets(spark: SparkSession, sf: str) -> DataFrame:
    return targets.future_targets(ticker_features(spark, sf), src.MARKET_SYMBOL)


# --- model dataset ------------------------------------------------------------------

# Date ranges, validation windows, features and transforms of the dataset.
CONTEXT_START = "1995-01-05"
SAMPLE_START = "1995-04-03"
LOOKBACK = 126
HORIZON = 63
WINDOWS = [
    ("early_cycle", "1997-03-03", "1997-07-31"),
    ("mid_cycle", "1999-01-04", "1999-05-31"),
    ("late_cycle", "2000-09-01", "2001-01-31"),
]
MINIMUM_TRAIN_ROWS = 63
WINSORIZE = (0.005, 0.995)
CHANGES = [f"change_{k}d" for k in macro.CHANGE_WINDOWS]
FAMILIES = {
    "asset": [
        {"feature_family": "price", "series_source": "bars", "names": ["open", "high", "low", "close"]},
        {"feature_family": "volume", "series_source": "bars", "names": ["volume"]},
    ],
    "market": [
        {"feature_family": "dispersion", "series_source": "market", "names": ["xs_dispersion_1d", "xs_iqr_1d"]},
        {"feature_family": "breadth", "series_source": "market", "names": ["breadth_1d", "pct_above_ma_63d"]},
        {"feature_family": "coverage", "series_source": "market", "names": ["n_assets"]},
    ],
    "macro": [
        {"feature_family": "macro", "series_source": "macro", "names": [f"vix_{s}" for s in ("level", *CHANGES)]},
        {
            "feature_family": "rates",
            "series_source": "macro",
            "names": [
                *[
                    f"{name}_{s}"
                    for name in ("treasury_3m", "treasury_2y", "treasury_10y", "treasury_30y", "fed_funds")
                    for s in ("level", *CHANGES)
                ],
                "yield_curve_10y_2y",
                "yield_curve_10y_3m",
                "yield_curve_30y_10y",
            ],
        },
    ],
}
TRANSFORMS = {"log": ["open", "high", "low", "close"], "log1p": ["volume", "vix_level"]}
SAMPLES = samples.WindowConfig(lookback=LOOKBACK, patch_len=6, min_masked=3, max_masked=8)
DATASET_VERSION = "panel-v1"


def feature_list(group: str) -> list[normalize.Feature]:
    return [
        normalize.Feature(name, transform)
        for g, _, name, _, _, transform in splits.feature_rows(FAMILIES, TRANSFORMS)
        if g == group
    ]


def feature_names(group: str) -> list[str]:
    return [f.name for f in feature_list(group)]


@layer
def panel_table(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned panel with every feature."""
    return ticker_features(spark, sf)


@layer
def features_table(spark: SparkSession, sf: str) -> DataFrame:
    """Market and macro state per date."""
    market = crosssec.cross_section(crosssec.stock_rows(panel_table(spark, sf)))
    return crosssec.date_features(market, macro_features(spark, sf))


def eligible_dates(spark: SparkSession, sf: str) -> DataFrame:
    observed = panel_table(spark, sf).filter((F.col("symbol") == src.MARKET_SYMBOL) & F.col("valid_observation"))
    return splits.with_sample_eligibility(
        splits.date_spine(calendar(spark, sf), CONTEXT_START), observed, SAMPLE_START
    )


@layer
def date_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return splits.date_manifest(eligible_dates(spark, sf), WINDOWS, LOOKBACK, HORIZON)


@layer
def asset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return splits.asset_manifest(
        manifest(spark, sf),
        panel_table(spark, sf),
        date_manifest(spark, sf),
        include_types=["stock", "etf", "index"],
        minimum=MINIMUM_TRAIN_ROWS,
    )


def train_rows(spark: SparkSession, sf: str, group: str) -> DataFrame:
    if group == "asset":
        return normalize.asset_train_rows(
            panel_table(spark, sf), date_manifest(spark, sf), asset_manifest(spark, sf)
        )
    return normalize.date_train_rows(features_table(spark, sf), date_manifest(spark, sf))


def fitted(spark: SparkSession, sf: str, group: str) -> DataFrame:
    return normalize.fit(train_rows(spark, sf, group), feature_list(group), WINSORIZE)


@layer
def asset_scales(spark: SparkSession, sf: str) -> DataFrame:
    return fitted(spark, sf, "asset")


@layer
def market_scales(spark: SparkSession, sf: str) -> DataFrame:
    return fitted(spark, sf, "market")


@layer
def macro_scales(spark: SparkSession, sf: str) -> DataFrame:
    return fitted(spark, sf, "macro")


SCALES = {"asset": asset_scales, "market": market_scales, "macro": macro_scales}


def build_facts(spark: SparkSession, sf: str, group: str) -> DataFrame:
    wanted = feature_list(group)
    scales = normalize.collect_scales(SCALES[group](spark, sf), wanted)
    if group == "asset":
        return normalize.asset_facts(
            panel_table(spark, sf), date_manifest(spark, sf), asset_manifest(spark, sf), wanted, scales
        )
    return normalize.date_facts(features_table(spark, sf), date_manifest(spark, sf), wanted, scales)


@layer
def asset_facts(spark: SparkSession, sf: str) -> DataFrame:
    return build_facts(spark, sf, "asset")


@layer
def market_facts(spark: SparkSession, sf: str) -> DataFrame:
    return build_facts(spark, sf, "market")


@layer
def macro_facts(spark: SparkSession, sf: str) -> DataFrame:
    return build_facts(spark, sf, "macro")


FACTS = {"asset": asset_facts, "market": market_facts, "macro": macro_facts}


def all_requests(spark: SparkSession, sf: str) -> DataFrame:
    return samples.request_index(date_manifest(spark, sf), asset_facts(spark, sf))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoints with a full lookback."""
    return samples.with_history(all_requests(spark, sf), SAMPLES, "drop")


def validity(spark: SparkSession, sf: str) -> DataFrame:
    return samples.date_validity(
        date_manifest(spark, sf), asset_facts(spark, sf), market_facts(spark, sf), macro_facts(spark, sf)
    )


@layer
def patch_masks(spark: SparkSession, sf: str) -> DataFrame:
    return samples.patch_masks(
        requests(spark, sf), asset_facts(spark, sf), validity(spark, sf), asset_manifest(spark, sf), SAMPLES
    )
