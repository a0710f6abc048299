"""Numpy kernels of the sliding-window MAD detector.

Used inside Spark tasks only: by the streaming state processors (per key
and micro-batch) and by the batch ``engine="numpy"`` (per series chunk).
Same arithmetic, in the same order, as the column-expression form in
``vigil.operators.mad``, so all forms agree bit for bit.
"""

from __future__ import annotations

import numpy as np

from vigil.config import MAD_CONSISTENCY, MODE_BOTH, MODE_DOWN, MadConfig


def _median(sorted_vals: list[float]) -> float:
    n = len(sorted_vals)
    if n == 0:
        return 0.0
    if n % 2 == 1:
        return sorted_vals[(n + 1) // 2 - 1]
    return (sorted_vals[n // 2 - 1] + sorted_vals[n // 2]) / 2


def window_stats(vals: list[float], value: float, cfg: MadConfig):
    """(n, baseline, mad, lower, upper, is_anomaly) for a window that ends
    with ``value``; same arithmetic as the batch expression."""
    n = len(vals)
    if n < cfg.warmup:
        return n, 0.0, 0.0, 0.0, 0.0, False
    base = _median(sorted(vals))
    mad = _median(sorted(abs(x - base) for x in vals))
    if mad < cfg.min_mad:
        mad = cfg.min_mad
    delta = cfg.threshold_k * (MAD_CONSISTENCY * mad)
    upper, lower = base + delta, base - delta
    mode = cfg.effective_mode
    if mode == MODE_DOWN:
        hit = value < lower
    elif mode == MODE_BOTH:
        hit = value > upper or value < lower
    else:
        hit = value > upper
    if cfg.min_delta > 0 and abs(value - base) < cfg.min_delta:
        hit = False
    return n, base, mad, lower, upper, hit


def _sorted_median(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Row-wise median of ascending rows whose first n[i] entries are valid."""
    rows = np.arange(len(n))
    lo = s[rows, (n - 1) // 2]
    hi = s[rows, n // 2]
    return np.where(n % 2 == 1, lo, (lo + hi) / 2)


#: Cells of a block of windows that the batch form sorts at a time.
BLOCK_CELLS = 500_000


def _median_and_mad(allv: np.ndarray, start: np.ndarray, n: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and raw MAD of the windows ``allv[start:start + n]``, by a padded
    W-column matrix."""
    cols = np.arange(w)
    pos = start[:, None] + cols[None, :]
    valid = cols[None, :] < n[:, None]
    mat = np.where(valid, allv[np.minimum(pos, len(allv) - 1)], np.inf)
    base = _sorted_median(np.sort(mat, axis=1), n)
    dev = np.where(valid, np.abs(mat - base[:, None]), np.inf)
    return base, _sorted_median(np.sort(dev, axis=1), n)


def window_stats_batch(history: np.ndarray, hist_ts: np.ndarray, values: np.ndarray,
                       ts: np.ndarray, cfg: MadConfig, gap: int | None, last_ts):
    """Statistics for ``values`` (in order) continuing a window whose previous
    contents are ``history``. Returns (n, base, mad, lower, upper, hit, reset,
    new_history, new_last_ts). Vectorised over blocks of rows, so that the
    windows in memory don't grow with the rows; idle gaps cut the window exactly
    like the row-by-row form."""
    w = cfg.window_size
    allv = np.concatenate([history, values])
    h, m = len(history), len(values)
    # segment start (index into allv) for each new row
    prev_ts = np.concatenate([[last_ts if last_ts is not None else ts[0]], ts[:-1]]).astype(np.int64)
    reset = np.zeros(m, dtype=bool)
    if gap is not None and m:
        reset = (ts - prev_ts) > gap
        if last_ts is None:
            reset[0] = False
    idx = h + np.arange(m)
    seg_start = np.where(reset, idx, 0)
    seg_start = np.maximum.accumulate(seg_start) if m else seg_start
    start = np.maximum(seg_start, idx - w + 1)
    n = (idx - start + 1).astype(np.int64)
    step = max(1, BLOCK_CELLS // w)
    blocks = [_median_and_mad(allv, start[i:i + step], n[i:i + step], w) for i in range(0, m, step)]
    base, mad = (np.concatenate(c) for c in zip(*blocks)) if blocks else (np.zeros(0), np.zeros(0))
    mad = np.where(mad < cfg.min_mad, cfg.min_mad, mad)
    delta = cfg.threshold_k * (MAD_CONSISTENCY * mad)
    upper, lower = base + delta, base - delta
    mode = cfg.effective_mode
    if mode == MODE_DOWN:
        hit = values < lower
    elif mode == MODE_BOTH:
        hit = (values > upper) | (values < lower)
    else:
        hit = values > upper
    if cfg.min_delta > 0:
        hit = hit & ~(np.abs(values - base) < cfg.min_delta)
    warm = n < cfg.warmup
    zero = np.zeros(m)
    out = (n.astype(np.int32), np.where(warm, zero, base), np.where(warm, zero, mad),
           np.where(warm, zero, lower), np.where(warm, zero, upper), ~warm & hit, reset)
    keep_from = max(int(start[-1]) if m else 0, len(allv) - w)
    new_hist = allv[keep_from:] if m else history
    new_last = int(ts[-1]) if m else last_ts
    return (*out, new_hist, new_last)


