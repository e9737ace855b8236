"""Progress events of a running job, at most one in 50 ms besides the first and the last."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from ..model import MIB, Progress


class Throttle:
    def __init__(self, emit: Callable[[Progress], None] | None, interval: float = 0.05, clock: Callable[[], float] = time.monotonic):
        self.emit, self.interval, self.clock = emit, interval, clock
        self.began, self.last, self.state = clock(), None, Progress()

    def update(self, **changes) -> None:
        now = self.clock()
        elapsed = now - self.began
        self.state = replace(self.state, **changes)
        self.state = replace(self.state, throughput_mibps=self.state.processed_bytes / MIB / elapsed if elapsed > 0 else 0.0)
        if self.last is None or now - self.last >= self.interval:
            self._send(now)

    def flush(self) -> None:
        self._send(self.clock())

    def _send(self, now: float) -> None:
        self.last = now
        if self.emit:
            self.emit(self.state)
