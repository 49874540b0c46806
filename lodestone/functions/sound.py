"""Resampling of sound by a polyphase windowed-sinc filter."""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Zero crossings of the sinc on either side, and the Kaiser window's shape: some 90 dB beyond the pass band.
CROSSINGS, SHAPE = 24, 9.0
#: The pass band's share of the lower of both half rates.
BAND = 0.945


@lru_cache(maxsize=16)
def _phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """The filter of each phase (row) and how many input samples it looks back; every phase sums to one."""
    cut = BAND / max(up, down)
    half = int(np.ceil(CROSSINGS / cut / up)) * up
    t = np.arange(-half, half + up)
    taps = cut * up * np.sinc(cut * t) * np.where(np.abs(t) <= half, np.i0(SHAPE * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(SHAPE), 0)
    rows = taps.reshape(-1, up).T[:, ::-1]  # phase, then from the latest sample back
    return np.ascontiguousarray(rows / rows.sum(1, keepdims=True)), half // up


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """``samples`` at the rate ``to``: ceil(n * to / rate) of them, level and pitch kept; beyond the ends is silence."""
    if rate <= 0 or to <= 0:
        raise ValueError("rates must be positive")
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    samples = np.asarray(samples, float)
    if up == down or not len(samples):
        return samples.copy()
    taps, look = _phases(up, down)
    n = -(-len(samples) * up // down)
    width = taps.shape[1]
    padded = np.concatenate([np.zeros(width - 1 - look), samples, np.zeros(look + down + width)])
    # output k stands at k * down / up: a whole input place and a phase; outputs of one phase are ``up`` apart
    out = np.empty(n)
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    for first in range(min(up, n)):
        place, phase = divmod(first * down, up)
        out[first::up] = windows[place :: down][: len(range(first, n, up))] @ taps[phase]
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resampled(samples: pd.Series, rate: pd.Series, to: pd.Series) -> pd.Series:
    """Samples at another rate; null samples or rates give null, a null sample in an array is silence."""
    return pd.Series([None if s is None or pd.isna(r) or pd.isna(o) else resample(np.nan_to_num(np.asarray(s, float)), int(r), int(o)) for s, r, o in zip(samples, rate, to, strict=True)], dtype=object)
