"""Order-dependent signal kernels that SQL cannot express, in NumPy on one channel of one session.

Spark deals out and sorts the sessions (`sessions.by_session`); a kernel sees one channel of one session,
8 bytes a sample.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .sessions import by_session


def butterworth(order: int, cutoff: float | tuple[float, float], rate: float, kind: str) -> list[np.ndarray]:
    """Second-order sections [b0 b1 b2 1 a1 a2] of a digital Butterworth filter by the bilinear transform.

    ``kind`` is ``band`` (cutoff = low, high), ``high`` or ``low``.
    """
    theta = np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)
    poles = np.exp(1j * theta)  # analogue prototype, cutoff 1
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if kind == "band":
        lo, hi = (warp(f) for f in cutoff)
        width, centre2 = hi - lo, lo * hi
        half = poles * width / 2
        root = np.sqrt(half**2 - centre2)
        poles, zeros, at = np.concatenate([half + root, half - root]), np.concatenate([np.ones(order), -np.ones(order)]), np.sqrt(cutoff[0] * cutoff[1])
        at = rate / np.pi * np.arctan(np.sqrt(centre2) / (2 * rate))
    elif kind == "high":
        poles, zeros, at = warp(cutoff) / poles, np.ones(order), rate / 2
    else:
        poles, zeros, at = warp(cutoff) * poles, -np.ones(order), 0.0
    z = (2 * rate + poles) / (2 * rate - poles)
    z = z[np.argsort(-z.imag)]
    pairs = [(p, np.conj(p)) for p in z if p.imag > 1e-12]
    real = sorted(p.real for p in z if abs(p.imag) <= 1e-12)
    pairs += [(real[i], real[i + 1]) for i in range(0, len(real) - 1, 2)]
    if len(real) % 2:
        pairs.append((real[-1], None))
    left = sorted(zeros)
    sections = []
    for a, b in pairs:
        if b is None:
            s = np.array([1, -left.pop(), 0, 1, -a, 0])
        else:
            u, v = (left.pop(), left.pop(0)) if kind == "band" else (left.pop(), left.pop())
            s = np.array([1, -(u + v), u * v, 1, -(a + b).real, (a * b).real])
        sections.append(s)
    w = np.exp(-2j * np.pi * at / rate)
    gain = abs(np.prod([(s[0] + s[1] * w + s[2] * w * w) / (1 + s[4] * w + s[5] * w * w) for s in sections]))
    sections[0][:3] /= gain
    return sections


def _steady(s: np.ndarray) -> np.ndarray:
    """State of a section (transposed direct form) that a constant input 1 leaves unchanged."""
    b0, b1, b2, _, a1, a2 = s
    out = (b0 + b1 + b2) / (1 + a1 + a2)
    z2 = b2 - a2 * out
    return np.array([b1 - a1 * out + z2, z2])


def _recursion(f: np.ndarray, a1: float, a2: float, block: int = 128) -> np.ndarray:
    """y[n] = f[n] - a1 y[n-1] - a2 y[n-2] from rest.

    Blocks are answered from rest by one matrix product; what the two values before a block add to it
    is carried from block to block.
    """
    n = len(f)
    blocks = np.zeros((-(-n // block), block))
    blocks.ravel()[:n] = f
    h = np.zeros(block + 1)  # impulse response, and one step more
    h[0] = 1.0
    for i in range(1, block + 1):
        h[i] = -a1 * h[i - 1] - (a2 * h[i - 2] if i > 1 else 0.0)
    at = np.arange(block)
    answer = np.where(at[:, None] >= at[None, :], h[np.abs(at[:, None] - at[None, :])], 0.0)
    y = blocks @ answer.T
    # the answer to y[-1] = u, y[-2] = v is u h[i + 1] - a2 v h[i]
    e1, e2, f1, f2 = float(h[block]), float(h[block - 1]), float(h[block - 1]), float(h[block - 2])
    u = v = 0.0
    carried = np.empty((len(y), 2))
    for i, (last, before) in enumerate(y[:, [-1, -2]].tolist()):
        carried[i] = u, v
        u, v = last + u * e1 - a2 * v * e2, before + u * f1 - a2 * v * f2
    y += carried[:, :1] * h[1:] - a2 * carried[:, 1:] * h[:-1]
    return y.ravel()[:n]


def _run(sections: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    y = x.astype(float)
    for s in sections:
        b0, b1, b2, _, a1, a2 = (float(v) for v in s)
        z1, z2 = _steady(s) * y[0]
        f = b0 * y
        f[1:] += b1 * y[:-1]
        f[2:] += b2 * y[:-2]
        f[0] += z1
        f[1] += z2
        y = _recursion(f, a1, a2)
    return y


def zero_phase(sections: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Filter forwards and backwards, the ends extended by odd reflection; too short a signal is returned as it is."""
    pad = 3 * (2 * len(sections) + 1)
    if len(x) <= pad:
        return np.asarray(x, float)
    x = np.asarray(x, float)
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return _run(sections, _run(sections, long)[::-1])[::-1][pad:-pad]


def find_peaks(x: np.ndarray, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Indices of local maxima (middle of plateaus), at least ``distance`` apart, of at least ``prominence``.

    Higher peaks win the distance rule, later ones among equals; prominence is the height over the higher of the two least
    values between the peak and the next higher ground (or the end) on each side.
    """
    x = np.asarray(x, float)
    if len(x) < 3:
        return np.zeros(0, int)
    edge = np.flatnonzero(np.diff(x) != 0)
    begin, end = np.r_[0, edge + 1], np.r_[edge, len(x) - 1]
    level = x[begin]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (begin[top] + end[top]) // 2
    if distance > 1 and len(peaks):
        place = peaks.tolist()
        keep = [True] * len(place)
        for k in np.argsort(x[peaks], kind="stable")[::-1].tolist():
            if keep[k]:
                for step in (-1, 1):
                    j = k + step
                    while 0 <= j < len(place) and abs(place[j] - place[k]) < distance:
                        keep[j] = False
                        j += step
        peaks = peaks[np.array(keep)]
    if prominence > 0 and len(peaks):
        tops = np.unique(np.r_[0, (begin[top] + end[top]) // 2, len(x) - 1])
        heights, valleys = x[tops], np.minimum.reduceat(x, tops[:-1])  # the last one reaches the end
        left = _least_since_higher(heights, valleys)
        right = _least_since_higher(heights[::-1], valleys[::-1])[::-1]
        at = np.searchsorted(tops, peaks)
        peaks = peaks[x[peaks] - np.maximum(left, right)[at] >= prominence]
    return peaks


def _least_since_higher(heights: np.ndarray, valleys: np.ndarray) -> np.ndarray:
    """For each top the least value back to the next strictly higher top, or to the beginning; ``valleys`` lie between tops."""
    out, stack = [], []
    for h, low in zip(heights.tolist(), [float("inf"), *valleys.tolist()], strict=True):
        low = min(low, h)
        while stack and stack[-1][0] <= h:
            low = min(low, stack.pop()[1])
        stack.append((h, low))
        out.append(low)
    return np.array(out)


def box_same(x: np.ndarray, k: int) -> np.ndarray:
    """Sums over a centred box of k, zeros beyond the ends."""
    return np.convolve(x, np.ones(k), "same")


def heart_rate(bvp: np.ndarray, rate: float) -> np.ndarray:
    """Beats per minute at each sample: peaks of the centred signal in an 8-second box."""
    x = np.asarray(bvp, float)
    if not len(x):
        return x
    x = x - np.median(x)
    peaks = find_peaks(x, max(1, int(0.35 * rate)), max(0.25 * x.std(), 1e-6))
    hits = np.zeros(len(x))
    hits[peaks] = 1
    return box_same(hits, int(8 * rate))[: len(x)] / 8.0 * 60.0


def fft_resample(x: np.ndarray, n: int) -> np.ndarray:
    """Band-limited resampling to n points over the same span."""
    x = np.asarray(x, float)
    if n <= 0 or not len(x):
        return np.zeros(0)
    spectrum = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    m = min(len(spectrum), len(out))
    out[:m] = spectrum[:m]
    low = min(len(x), n)
    if low % 2 == 0 and n != len(x):
        out[low // 2] *= 0.5 if n > len(x) else 2.0
        if n < len(x):
            out[low // 2] = out[low // 2].real
    return np.fft.irfft(out, n) * (n / len(x))


def per_session(df: DataFrame, keys: Sequence[str], index: str, value: str, kernel: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """(keys, index, name): a kernel that keeps the length, applied to each session's channel in order."""
    kept = [f for f in df.schema.fields if f.name in (*keys, index)]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])

    def run(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        x = np.split(frame[value].to_numpy(float), starts[1:])
        return frame[[f.name for f in kept]].assign(**{name: np.concatenate([kernel(part) for part in x])})

    return by_session(df.select(*keys, index, value), keys, [index], run, schema)


def resample_sessions(df: DataFrame, keys: Sequence[str], index: str, value: str, targets: DataFrame, n: str = "n") -> DataFrame:
    """(keys, index, value) with each session resampled to its length in ``targets`` (keys, n) by FFT."""
    kept = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType([*kept, T.StructField(index, T.LongType()), T.StructField(value, T.DoubleType())])

    def run(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        wanted = frame[n].to_numpy()[starts]
        y = [fft_resample(part, int(m)) for part, m in zip(np.split(frame[value].to_numpy(float), starts[1:]), wanted, strict=True)]
        lengths = [len(part) for part in y]
        out = frame[[f.name for f in kept]].iloc[np.repeat(starts, lengths)].reset_index(drop=True)
        return out.assign(**{index: np.concatenate([np.arange(m) for m in lengths]), value: np.concatenate(y)})

    return by_session(df.select(*keys, index, value).join(targets, list(keys)), keys, [index], run, schema)


def band_pass(rate: float) -> Callable[[np.ndarray], np.ndarray]:
    """Third-order 2 to 8 Hz band-pass, zero phase."""
    sections = butterworth(3, (2.0, 8.0), rate, "band")
    return lambda x: zero_phase(sections, x)


def high_pass(rate: float) -> Callable[[np.ndarray], np.ndarray]:
    """Second-order 0.05 Hz high-pass, zero phase."""
    sections = butterworth(2, 0.05, rate, "high")
    return lambda x: zero_phase(sections, x)
