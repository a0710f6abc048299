from vigil.config import MODE_BOTH, MODE_UP, MadConfig


def test_library_defaults():
    c = MadConfig(0, 0, 0, "", 0, -1).normalized()
    assert (c.window_size, c.warmup, c.threshold_k, c.mode, c.min_mad, c.min_delta) == \
        (50, 20, 6.0, MODE_UP, 1.0, 0.0)


def test_warmup_capped_at_window():
    assert MadConfig(window_size=10, warmup=30).normalized().warmup == 10


def test_service_defaults_and_env():
    d = MadConfig.service_defaults()
    assert (d.window_size, d.warmup, d.threshold_k, d.mode, d.min_mad, d.min_delta) == \
        (50, 20, 3.0, MODE_BOTH, 1.0, 10.0)
    e = MadConfig.from_env({"MAD_WINDOW_SIZE": "30", "MAD_THRESHOLD_K": "x", "MAD_MODE": "nope",
                            "MIN_DELTA": "2.5"})
    assert (e.window_size, e.threshold_k, e.mode, e.min_delta) == (30, 3.0, MODE_BOTH, 2.5)


def test_unknown_mode_detects_up():
    assert MadConfig(mode="sideways").normalized().effective_mode == MODE_UP
