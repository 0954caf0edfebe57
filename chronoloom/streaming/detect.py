"""Detectors over unbounded signals: the same rules as on tables, with a watermark and state for each asset.

An extension: the batch operators are the reference for what these give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDGES = "asset_id string, t double, delta double"
ANCHORS = "asset_id string, t double"


def luma_edges(luma: DataFrame, edge: float = 40.0) -> DataFrame:
    """Steps of the mean luma of a stream (asset_id, t, yavg); rows of one asset arrive in time order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("t").itertuples():
            if last is not None and abs(row.yavg - last) >= edge:
                out.append((key[0], row.t, abs(row.yavg - last)))
            last = row.yavg
        state.update((last,))
        yield pd.DataFrame(out, columns=["asset_id", "t", "delta"])

    return luma.groupBy("asset_id").applyInPandasWithState(step, EDGES, "yavg double", "append", GroupStateTimeout.NoTimeout)


def cluster(cuts: DataFrame, window: float = 0.5) -> DataFrame:
    """Anchored clusters of a stream of cuts (asset_id, t): a time over window past the anchor opens a new one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor = state.get[0] if state.exists else None
        out = []
        for t in sorted(pd.concat(list(batches))["t"]):
            if anchor is None or t - anchor > window:
                anchor = t
                out.append((key[0], t))
        state.update((anchor,))
        yield pd.DataFrame(out, columns=["asset_id", "t"])

    return cuts.groupBy("asset_id").applyInPandasWithState(step, ANCHORS, "anchor double", "append", GroupStateTimeout.NoTimeout)

