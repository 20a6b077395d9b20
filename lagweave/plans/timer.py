"""A stopwatch that adds up several runs."""

from __future__ import annotations

import time


class Timer:
    def __init__(self):
        self.reset()

    def start(self) -> None:
        self._since = time.perf_counter()

    def stop(self) -> None:
        self._total += time.perf_counter() - self._since

    def reset(self) -> None:
        self._total = self._since = 0.0

    def elapsed(self) -> float:
        """Milliseconds between all starts and stops."""
        return self._total * 1000
