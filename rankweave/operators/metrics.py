"""Timers and counters of a sorter's phases."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class SortMetrics:
    """Seconds by phase (local_sort, sampling, splitters, partition, packing, exchange, ...) and counts."""

    seconds: dict[str, float] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def add(self, name: str, n: int) -> None:
        self.counts[name] = self.counts.get(name, 0) + n
