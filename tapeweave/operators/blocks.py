"""Random target blocks over a sample's eligible patches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeweave.operators.samples import SAMPLE, WindowConfig
from tapeweave.session import spread


def layout_counts(eligible: np.ndarray, targets: int, blocks: int) -> np.ndarray:
    """ways[p, t, b]: layouts of t targets in b separated runs using patches p onwards.

    Counting layouts, rather than testing each draw, makes every feasible layout equally
    likely and needs no retries. Counts are floats; only their ratios matter.
    """
    n = eligible.size
    ways = np.zeros((n + 2, targets + 1, blocks + 1))
    ways[:, 0, 0] = 1.0
    for p in range(n - 1, -1, -1):
        ways[p] = ways[p + 1]
        run = 0
        while p + run < n and run < targets and eligible[p + run]:
            run += 1
            after = min(p + run + 1, n + 1)
            ways[p, run:, 1:] += ways[after, : targets + 1 - run, :blocks]
    return ways


def draw_blocks(
    eligible: np.ndarray, targets: int, min_blocks: int, max_blocks: int, rng: np.random.Generator
) -> np.ndarray | None:
    """Patch numbers of one random layout with an allowed number of blocks, or None."""
    ways = layout_counts(eligible, targets, max_blocks)
    feasible = [b for b in range(min_blocks, max_blocks + 1) if ways[0, targets, b] > 0]
    if not feasible:
        return None
    b = int(rng.choice(feasible))
    chosen: list[int] = []
    p, t = 0, targets
    n = eligible.size
    while t:
        options = [(0, ways[p + 1, t, b])]
        run = 0
        while p + run < n and run < t and eligible[p + run]:
            run += 1
            options.append((run, ways[min(p + run + 1, n + 1), t - run, b - 1]))
        weights = np.array([w for _, w in options])
        length = options[int(rng.choice(len(options), p=weights / weights.sum()))][0]
        if length == 0:
            p += 1
            continue
        chosen.extend(range(p, p + length))
        p = min(p + length + 1, n + 1)
        t -= length
        b -= 1
    return np.array(chosen, dtype=np.int64)


def draw_targets(
    eligible: np.ndarray, context: np.ndarray, config: WindowConfig, rng: np.random.Generator
) -> np.ndarray:
    """Target patches: a binomial count in its bounds, placed in blocks if that can be done.

    Falls back to one block and then to any eligible patches.
    """
    ids = np.flatnonzero(eligible)
    most = min(ids.size, int(context.sum()) - 1, config.max_masked)
    if most < config.min_masked:
        raise ValueError("sample cannot give the fewest targets and keep visible context")
    count = min(max(int(rng.binomial(ids.size, config.mask_ratio)), config.min_masked), most)
    for low, high in ((config.min_blocks, config.max_blocks), (1, 1)):
        chosen = draw_blocks(eligible, count, low, high, rng)
        if chosen is not None:
            return chosen
    return np.sort(rng.choice(ids, size=count, replace=False))


def sample_rng(*key: object) -> np.random.Generator:
    """Generator fixed by the row's key, whatever the partitioning."""
    digest = hashlib.sha256("|".join(map(str, key)).encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:16], "big"))


def target_masks(masks: DataFrame, config: WindowConfig, epoch: int = 0) -> DataFrame:
    """Adds target ids, target mask and remaining context to the mask arrays of each viable sample.

    One row per sample goes in and out; a row's draw depends on its key alone.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, targets, visible = [], [], []
            for row in batch.itertuples(index=False):
                eligible = np.asarray(row.eligible, dtype=bool)
                context = np.asarray(row.context, dtype=bool)
                step = epoch if row.split == "train" else 0
                chosen = draw_targets(
                    eligible, context, config, sample_rng(config.seed, row.split, row.sample_date_idx, step, "targets")
                )
                mask = np.zeros(eligible.size, dtype=bool)
                mask[chosen] = True
                ids.append(chosen.astype("int32"))
                targets.append(mask)
                visible.append(context & ~mask)
            yield batch.assign(target_ids=ids, target=targets, visible=visible)

    schema = T.StructType(
        [
            *[masks.schema[c] for c in (*SAMPLE, "context", "eligible")],
            T.StructField("target_ids", T.ArrayType(T.IntegerType())),
            T.StructField("target", T.ArrayType(T.BooleanType())),
            T.StructField("visible", T.ArrayType(T.BooleanType())),
        ]
    )
    return spread(masks.select(*SAMPLE, "context", "eligible"), *SAMPLE).mapInPandas(draw, schema)
