"""Per-stage times of a composed job."""

from __future__ import annotations

import time
from contextlib import contextmanager


class Stages:
    """Collects milliseconds per named stage: ``with stages("retrieval"): ...``."""

    def __init__(self) -> None:
        self.ms: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str):
        start = time.perf_counter()
        try:
            yield self
        finally:
            self.ms[name] = round(self.ms.get(name, 0.0) + (time.perf_counter() - start) * 1000, 2)

    @property
    def total_ms(self) -> float:
        return round(sum(self.ms.values()), 2)
