"""Requests that are retried within bounds, at one rate for all tasks of a job.

The rate is kept by lanes: the work is dealt into at most ``lanes`` tasks, which begin one after the other and each leave
``lanes`` intervals between their requests. So all together they send one request an interval, without talking to each
other, wherever they run.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

T = TypeVar("T")


class Refused(Exception):
    """A request that failed in a way that may pass: a status and, if the server named one, the seconds to wait."""

    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(status, retry_after)
        self.status, self.retry_after = status, retry_after

    @property
    def may_pass(self) -> bool:
        return self.status in (408, 429) or 500 <= self.status < 600


@dataclass(frozen=True)
class Pace:
    """Seconds between two requests of all lanes, the number of lanes, attempts, and waits in seconds."""

    interval: float = 3.0
    lanes: int = 4
    attempts: int = 3
    first_wait: float = 2.0
    longest_wait: float = 60.0

    def __post_init__(self):
        if self.interval < 0 or self.lanes < 1 or self.attempts < 1:
            raise ValueError("a pace needs an interval, a lane and an attempt")


class Lane:
    """The requests of one task."""

    def __init__(self, pace: Pace, number: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pace, self.clock, self.sleep = pace, clock, sleep
        self.free = clock() + number % pace.lanes * pace.interval

    def _turn(self) -> None:
        if (left := self.free - self.clock()) > 0:
            self.sleep(left)
        self.free = self.clock() + self.pace.lanes * self.pace.interval

    def request(self, send: Callable[[], T]) -> T:
        """What ``send`` gives; a refusal that may pass, or a lost connection, is waited out, the server's wait before our own."""
        for attempt in range(1, self.pace.attempts + 1):
            self._turn()
            try:
                return send()
            except Refused as refusal:
                if not refusal.may_pass or attempt == self.pace.attempts:
                    raise
                wait = refusal.retry_after if refusal.retry_after is not None else self.pace.first_wait * 2 ** (attempt - 1)
            except (ConnectionError, TimeoutError):
                if attempt == self.pace.attempts:
                    raise
                wait = self.pace.first_wait * 2 ** (attempt - 1)
            self.sleep(min(max(0.0, wait), self.pace.longest_wait))
        raise AssertionError("unreachable")
