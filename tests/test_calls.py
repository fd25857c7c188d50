"""Plug-in calls: window in flight, order, retries, time limit, rate; failures are kept, never lost."""

import time

from logsift.operators import assess as A
from logsift.operators.calls import Caller, CallPolicy


def test_window_and_order():
    def slow(x):
        time.sleep(0.05 if x % 2 else 0.1)
        return x
    t = time.monotonic()
    got = Caller(slow, CallPolicy(width=8)).all((i,) for i in range(32))
    took = time.monotonic() - t
    assert got == [(i, None) for i in range(32)]
    assert took < 0.075 * 32 / 8 * 2.5  # calls / width, not calls


def test_retries_and_backoff():
    asked, at = [], []

    def flaky(x):
        asked.append(x)
        at.append(time.monotonic())
        if x == "never" or x == "third" and asked.count(x) < 3:
            raise ValueError(f"no {asked.count(x)}")
        return x.upper()
    got = Caller(flaky, CallPolicy(attempts=3, backoff=0.05)).all([("once",), ("third",), ("never",)])
    assert got == [("ONCE", None), ("THIRD", None), (None, "ValueError: no 3")]
    assert at[2] - at[1] >= 0.05 and at[3] - at[2] >= 0.1


def test_time_limit():
    def hang(x):
        time.sleep(x)
        return x
    t = time.monotonic()
    got = Caller(hang, CallPolicy(width=3, time_limit=0.2)).all([(0.0,), (5.0,), (0.01,)])
    assert got == [(0.0, None), (None, "TimeoutError: no answer in 0.2 s"), (0.01, None)] and time.monotonic() - t < 3


def test_rate():
    starts = []
    Caller(lambda x: starts.append(time.monotonic()), CallPolicy(width=8, per_second=50)).all((i,) for i in range(10))
    assert max(starts) - min(starts) >= 9 / 50 * 0.9


def test_every_digest_is_answered_or_kept(spark):
    rows = [(i, f"text {i}", 10 + i, 3, i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "period_end long, digest_text string, total_lines long, distinct_patterns long, elevated_count long").selectExpr("period_end as period_start", "*").coalesce(1)

    def client():
        class Busy(A.ElevatedCountAssessor):
            def assess(self, digest_text, stats):
                time.sleep(0.02)
                if stats["total_lines"] % 7 == 0:
                    raise RuntimeError("down")
                return super().assess(digest_text, stats)
        return Busy()
    out = A.assess_with(df, client, policy=CallPolicy(width=10, attempts=2, backoff=0.01)).collect()
    assert [r.period_start for r in out] == list(range(60))
    assert all((r.error == "RuntimeError: down" and r.payload_json is None) if r.total_lines % 7 == 0 else (r.error is None and r.payload_json) for r in out)
