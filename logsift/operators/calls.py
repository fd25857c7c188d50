"""Plug-in calls with a window in flight, retries, a time limit and a rate, in the order of the rows."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass


@dataclass(frozen=True)
class CallPolicy:
    """How a task calls its plug-in; several tasks of a job do so at once.

    ``width`` calls are in flight at a time. A call that raises, or takes longer than ``time_limit``
    seconds, is tried again up to ``attempts`` times in all, after ``backoff`` seconds and twice as
    long each further time. At most ``per_second`` calls are started in a second. A call beyond
    its time limit can't be stopped; its answer is ignored, and its thread ends with the call.
    """
    width: int = 1
    time_limit: float | None = None
    attempts: int = 1
    backoff: float = 1.0
    per_second: float | None = None


class _Rate:
    def __init__(self, per_second: float | None) -> None:
        self.gap, self.next, self.lock = (1 / per_second if per_second else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            at = max(time.monotonic(), self.next)
            self.next = at + self.gap
        time.sleep(max(0.0, at - time.monotonic()))


def _limited(call: Callable, args: tuple, limit: float | None):
    if limit is None:
        return call(*args)
    answer: list = []

    def run() -> None:
        try:
            answer.append((call(*args), None))
        except Exception as e:
            answer.append((None, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(limit)
    if not answer:
        raise TimeoutError(f"no answer in {limit:g} s")
    value, error = answer[0]
    if error is not None:
        raise error
    return value


class Caller:
    """Calls of one task."""

    def __init__(self, call: Callable, policy: CallPolicy) -> None:
        self.call, self.policy, self.rate = call, policy, _Rate(policy.per_second)

    def _tried(self, args: tuple) -> tuple[object, str | None]:
        p = self.policy
        for k in range(max(1, p.attempts)):
            if k:
                time.sleep(p.backoff * 2 ** (k - 1))
            self.rate.wait()
            try:
                return _limited(self.call, args, p.time_limit), None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        return None, error

    def all(self, requests: Iterable[tuple]) -> list[tuple[object, str | None]]:
        """``(answer, None)`` or ``(None, error of the last attempt)`` for each request, in order."""
        if self.policy.width <= 1:
            return [self._tried(r) for r in requests]
        with ThreadPoolExecutor(self.policy.width) as pool:
            return list(pool.map(self._tried, requests))
