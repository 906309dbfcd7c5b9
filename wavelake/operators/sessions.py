"""Kernels over whole sessions: rows come sorted by session, many sessions to a call.

A group function per session costs more than a short session's kernel.  Here Spark deals out and sorts
the rows, and a kernel gets a frame of whole sessions with the places where each begins.  A task holds
a batch of rows, or one longer session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Kernel = Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]


def whole_sessions(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(frame, starts) of whole sessions from sorted frames that may end inside one; null keys are a session too."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        edge = pd.concat([held[-1].iloc[-1:], frame]) if held else frame
        code = edge.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
        starts = np.flatnonzero(np.r_[not held, np.diff(code) != 0])
        if held:
            starts -= 1  # places in the frame: the row before it was added for the comparison
        before = sum(map(len, held))
        if not len(starts) or (not held and len(starts) == 1):
            held.append(frame)
            continue
        begun = np.r_[0, starts + before] if held else starts
        last = starts[-1]
        yield pd.concat([*held, frame.iloc[:last]], ignore_index=True), begun[:-1]
        held = [frame.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True), np.zeros(1, np.int64)


def by_session(df: DataFrame, keys: Sequence[str], order: Sequence[str], kernel: Kernel, schema: T.StructType) -> DataFrame:
    """Rows of ``schema`` from ``kernel`` on whole sessions, each in the given order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_sessions(frames, keys):
            yield kernel(frame, starts)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
