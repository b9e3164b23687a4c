"""Slow, direct versions of the peak and segment rules, written from their definitions."""

from __future__ import annotations

import numpy as np
import pandas as pd


def maxima(x):
    """Middle indices of runs that are strictly higher than both neighbouring runs."""
    runs, i = [], 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        runs.append((i, j))
        i = j + 1
    return [
        (a + b) // 2
        for k, (a, b) in enumerate(runs)
        if 0 < k < len(runs) - 1 and x[a] > x[runs[k - 1][0]] and x[a] > x[runs[k + 1][0]]
    ]


def spaced(peaks, heights, distance):
    """Greedy choice by height; of equal heights the later one is chosen first."""
    order = sorted(range(len(peaks)), key=lambda i: (heights[i], i), reverse=True)
    gone = set()
    for i in order:
        if i not in gone:
            gone |= {j for j in range(len(peaks)) if j != i and abs(peaks[j] - peaks[i]) < distance}
    return [p for i, p in enumerate(peaks) if i not in gone]


def prominence(x, p):
    def floor(step):
        low, i = x[p], p
        while 0 <= i < len(x) and x[i] <= x[p]:
            low = min(low, x[i])
            i += step
        return low

    return x[p] - max(floor(-1), floor(1))


def find(x, min_prominence=5.0, distance=20):
    x = list(map(float, x))
    peaks = maxima(x)
    near = spaced(peaks, [x[p] for p in peaks], distance)
    return [p for p in near if prominence(x, p) >= min_prominence]


def slope(hours, y):
    hours, y = np.asarray(hours, float), np.asarray(y, float)
    dx = hours - hours.mean()
    return float((dx * (y - y.mean())).sum() / (dx * dx).sum())


def analyze(ts, values, prominence=5.0, distance=20, min_points=20):
    """(smooth frame, minima, maxima, segments) of one series, or None for too little data."""
    if len(ts) < 100:
        return None
    s = pd.Series(values, index=pd.DatetimeIndex(ts)).dropna().sort_index(kind="stable")
    residual = s - s.rolling("300s", center=True, min_periods=1).median()
    scale = np.median(np.abs(residual - residual.median()))
    if scale == 0:
        scale = residual.std(ddof=0)
    s = s[(residual.abs() <= 6.0 * scale).values]
    if len(s) < 50:
        return None
    smooth = s.rolling("600s", center=True, min_periods=1).median()
    x, t = smooth.values, smooth.index
    top = find(x, prominence, distance)
    low = find(-x, prominence, distance)
    spans = []
    for m in low:
        after = [p for p in top if p > m]
        if after and after[0] - m + 1 >= min_points and t[after[0]] - t[m] >= pd.Timedelta("3h"):
            spans.append((m, after[0]))
    segments = []

    def add(ident, a, b, current):
        hours = (t[a:b + 1] - t[a]).total_seconds() / 3600
        k = slope(hours, x[a:b + 1])
        if k > 0:
            segments.append(dict(
                id=ident() if callable(ident) else ident, start_time=t[a], end_time=t[b],
                start_distance_mm=x[a], end_distance_mm=x[b], slope_mm_per_hr=k,
                duration_hours=hours[-1], n_points=b - a + 1, is_current=current, begin_index=a))

    for number, (a, b) in enumerate(spans, 1):
        add(number, a, b, False)
    if low:
        a, b = low[-1], len(x) - 1
        if b - a + 1 >= min_points and t[b] - t[a] >= pd.Timedelta("1h"):
            add(lambda: len(segments) + 1, a, b, True)
    return smooth, low, top, pd.DataFrame(segments)
