"""When pipelines run: schedules, a loop with backoff, a pool of pipelines under leases."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from rillstack.delivery import Fence
from rillstack.state import StateBackend

#: After n errors in a row the wait is FIRST * 2 ** (n - 1) seconds, MOST at most; after LIMIT it ends.
FIRST, MOST, LIMIT = 60.0, 600.0, 5


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b or (high if step else a)))
        if not low <= first <= last <= high or (step and int(step) < 1):
            raise ValueError(f"{part!r} is not between {low} and {high}")
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def next_cron(text: str, after: datetime) -> datetime:
    """The first minute after the given one that fits minute, hour, day, month and weekday (0: Sunday)."""
    parts = text.split()
    if len(parts) != 5:
        raise ValueError("a cron text has five fields")
    minutes, hours, days, months, weekdays = (_field(p, a, b) for p, (a, b) in zip(parts, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
    weekdays = {d % 7 for d in weekdays}
    either = parts[2] != "*" and parts[4] != "*"
    t = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 5):
        if t.month in months:
            by_day, by_week = t.day in days, t.isoweekday() % 7 in weekdays
            if (by_day or by_week) if either else (by_day and by_week):
                for h in sorted(x for x in hours if x >= t.hour):
                    first = t.minute if h == t.hour else 0
                    if m := [x for x in sorted(minutes) if x >= first]:
                        return t.replace(hour=h, minute=m[0])
        t = t.replace(hour=0, minute=0) + timedelta(days=1)
    raise ValueError(f"{text!r} never comes")


@dataclass(frozen=True)
class Schedule:
    """`every` waits after a run has ended; `continuous` doesn't wait; `once` runs a single time."""

    kind: str
    seconds: float = 0.0
    text: str = ""

    @classmethod
    def every(cls, seconds: float) -> Schedule:
        if seconds <= 0:
            raise ValueError("an interval is positive")
        return cls("every", seconds)

    @classmethod
    def cron(cls, text: str) -> Schedule:
        next_cron(text, datetime(2024, 1, 1))
        return cls("cron", text=text)

    @classmethod
    def continuous(cls) -> Schedule:
        return cls("continuous")

    @classmethod
    def once(cls) -> Schedule:
        return cls("once")

    def wait(self, now: datetime) -> float | None:
        """Seconds until the next run, None for no more."""
        if self.kind == "once":
            return None
        return (next_cron(self.text, now) - now).total_seconds() if self.kind == "cron" else self.seconds

    def trigger(self) -> dict:
        """The trigger of a streaming query that comes nearest."""
        return {"availableNow": True} if self.kind in ("once", "cron") else {"processingTime": f"{self.seconds} seconds"}


@dataclass
class Loop:
    """Runs a pipeline by its schedule until it has failed LIMIT times in a row, or is stopped."""

    run: Callable[[], object]
    schedule: Schedule
    sleep: Callable[[float], object] | None = None
    now: Callable[[], datetime] = datetime.now
    stopped: threading.Event = field(default_factory=threading.Event)
    runs: int = 0
    errors: int = 0

    def start(self, most: int | None = None) -> int:
        sleep = self.sleep or self.stopped.wait
        if self.schedule.kind == "cron":
            sleep(self.schedule.wait(self.now()) or 0.0)
        while not self.stopped.is_set() and (most is None or self.runs < most):
            self.runs += 1
            try:
                self.run()
                self.errors = 0
                wait = self.schedule.wait(self.now())
            except Exception:
                self.errors += 1
                if self.errors >= LIMIT:
                    raise
                wait = min(MOST, FIRST * 2 ** (self.errors - 1))
                if self.schedule.kind == "once":
                    raise
            if wait is None:
                break
            if wait:
                sleep(wait)
        return self.runs


@dataclass
class Coordinator:
    """Leases of pipelines among drivers that share a state backend."""

    backend: StateBackend
    owner: str
    seconds: float = 30.0
    now: Callable[[], float] = time.time

    def acquire(self, name: str) -> Fence | None:
        if not self.backend.set_if_absent(f"lease:{name}", self.owner, self.seconds) and self.backend.get(f"lease:{name}") != self.owner:
            return None
        self.renew(name)
        return Fence.take(self.backend, name)

    def renew(self, name: str) -> None:
        self.backend.set(f"lease:{name}", self.owner, self.seconds)

    def release(self, name: str) -> None:
        if self.backend.get(f"lease:{name}") == self.owner:
            self.backend.delete(f"lease:{name}")


@dataclass
class WorkerPool:
    """Several pipelines of one session at once; each only while its lease is ours."""

    pipelines: dict[str, Callable[[], object]]
    coordinator: Coordinator | None = None
    size: int = 4

    def run_once(self) -> dict[str, object]:
        def one(item: tuple[str, Callable[[], object]]) -> tuple[str, object]:
            name, run = item
            fence = self.coordinator.acquire(name) if self.coordinator else None
            if self.coordinator and fence is None:
                return name, "leased elsewhere"
            try:
                return name, run()
            except Exception as e:  # noqa: BLE001  one pipeline's failure is its result
                return name, e
            finally:
                if self.coordinator:
                    self.coordinator.release(name)

        with ThreadPoolExecutor(self.size) as pool:
            return dict(pool.map(one, self.pipelines.items()))
