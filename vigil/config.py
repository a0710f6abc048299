"""Detector parameters and their defaulting rules."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

# --- fixed values (must equal the reference for identical results) ---------
MODE_UP = "MODE_UP"
MODE_DOWN = "MODE_DOWN"
MODE_BOTH = "MODE_BOTH"
MAD_CONSISTENCY = 1.4826          # MAD -> sigma for normal data
LIBRARY_WINDOW = 50
LIBRARY_WARMUP = 20
LIBRARY_K = 6.0
LIBRARY_MIN_MAD = 1.0
SERVICE_K = 3.0
SERVICE_MIN_DELTA = 10.0
DETECTOR_NAME = "MAD"
EVENT_TYPE = "anomaly.detected"
EVENT_VERSION = 2
STALE_AFTER_SECONDS = 3600        # idle series lose their window after 1 h
ENV_WINDOW, ENV_WARMUP, ENV_K = "MAD_WINDOW_SIZE", "MAD_WARMUP", "MAD_THRESHOLD_K"
ENV_MODE, ENV_MIN_MAD, ENV_MIN_DELTA = "MAD_MODE", "MIN_MAD", "MIN_DELTA"
# ---------------------------------------------------------------------------

# Our own producer label (the producing component name is deployment config).
DEFAULT_PRODUCER = "vigil-detector"


@dataclass(frozen=True)
class MadConfig:
    """Sliding-window MAD detector configuration.

    Construct directly and call :meth:`normalized` (or use the factories) to
    apply the library's defaulting: non-positive window/warm-up/K/min-MAD fall
    back to defaults, a negative deadband becomes 0, an empty mode is UP and
    warm-up is capped at the window size.
    """

    window_size: int = LIBRARY_WINDOW
    warmup: int = LIBRARY_WARMUP
    threshold_k: float = LIBRARY_K
    mode: str = MODE_UP
    min_mad: float = LIBRARY_MIN_MAD
    min_delta: float = 0.0

    def normalized(self) -> "MadConfig":
        w = self.window_size if self.window_size > 0 else LIBRARY_WINDOW
        wu = self.warmup if self.warmup > 0 else LIBRARY_WARMUP
        k = self.threshold_k if self.threshold_k > 0 else LIBRARY_K
        mode = self.mode or MODE_UP
        mm = self.min_mad if self.min_mad > 0 else LIBRARY_MIN_MAD
        md = self.min_delta if self.min_delta >= 0 else 0.0
        wu = min(wu, w)
        return MadConfig(int(w), int(wu), float(k), mode, float(mm), float(md))

    @property
    def effective_mode(self) -> str:
        """Unknown modes detect upward spikes, like an empty one."""
        return self.mode if self.mode in (MODE_DOWN, MODE_BOTH) else MODE_UP

    def with_(self, **kw) -> "MadConfig":
        return replace(self, **kw).normalized()

    @classmethod
    def library_defaults(cls) -> "MadConfig":
        return cls().normalized()

    @classmethod
    def service_defaults(cls) -> "MadConfig":
        return cls(LIBRARY_WINDOW, LIBRARY_WARMUP, SERVICE_K, MODE_BOTH,
                   LIBRARY_MIN_MAD, SERVICE_MIN_DELTA).normalized()

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> "MadConfig":
        """Service configuration: environment overrides on the service
        defaults; a value that does not parse keeps the default."""
        env = os.environ if env is None else env
        d = cls.service_defaults()

        def num(key, default, conv):
            raw = env.get(key, "")
            if raw == "":
                return default
            try:
                return conv(raw)
            except ValueError:
                return default

        mode = env.get(ENV_MODE, "")
        if mode not in (MODE_UP, MODE_DOWN, MODE_BOTH):
            mode = d.mode
        return cls(num(ENV_WINDOW, d.window_size, int), num(ENV_WARMUP, d.warmup, int),
                   num(ENV_K, d.threshold_k, float), mode,
                   num(ENV_MIN_MAD, d.min_mad, float),
                   num(ENV_MIN_DELTA, d.min_delta, float)).normalized()
