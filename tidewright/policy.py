"""Settings, results, staleness, and the debounced scheduler."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from .plans.spec import COLD_READS, FEEDS, STRATEGIES


class NotMaterialized(RuntimeError):
    """The call needs a built view."""


class AlreadyRefreshing(RuntimeError):
    """Another refresh of the view holds the lease."""


class RefreshError(RuntimeError):
    """A refresh failed; the cause is chained and kept as the view's last error."""


class DataDrift(RuntimeError):
    """Stored and live results differ."""


@dataclass
class Config:
    """``state_dir``: where views, log and queues live (shared by driver and executors)."""

    state_dir: str
    default_max_staleness: float | None = None
    default_strategy: str = "async"
    default_debounce: float = 2.0
    default_cold_read: str = "read_through"
    default_feed: str = "managed"
    max_tracked_keys: int = 1000
    resident_rows: int = 0  # stored views up to this size are answered from a copy in the driver
    staleness_budget: float = 0.0  # seconds by which a replica may lag
    lease_seconds: float = 3600.0
    pool: str = "views"
    parallel: int = 4
    clock: Callable[[], float] = time.time

    def __post_init__(self):
        for value, known, what in ((self.default_strategy, STRATEGIES, "default_strategy"), (self.default_cold_read, COLD_READS, "default_cold_read"), (self.default_feed, FEEDS, "default_feed")):
            if value not in known:
                raise ValueError(f"{what} {value!r} is none of {', '.join(known)}")
        if self.max_tracked_keys < 1 or self.default_debounce < 0 or self.staleness_budget < 0:
            raise ValueError("max_tracked_keys must be positive; debounce and budget can't be negative")


@dataclass(frozen=True)
class RefreshResult:
    view: str
    path: str  # rebuild, delta, scoped, widen, noop, skipped
    row_count: int = 0
    duration_ms: float = 0.0
    refreshed_at: float | None = None
    keys: int | None = None

    @property
    def skipped(self) -> bool:
        return self.path == "skipped"


@dataclass(frozen=True)
class ReconcileResult:
    view: str
    repaired: int = 0
    checked: int = 0
    deferred: bool = False
    skipped: bool = False
    error: str | None = None


def stale(last: float | None, dirty: bool, max_staleness: float | None, budget: float, now: float) -> bool:
    """Dirty, never brought up to date, or older than allowed (less what a replica may lag)."""
    if dirty or last is None:
        return True
    return max_staleness is not None and last < now - max(0.0, max_staleness - budget)


class Scheduler:
    """Runs refreshes at once, after a pause without further changes, or not at all.

    A view waits once however often it is asked for; each request restarts the pause.
    """

    def __init__(self, refresh: Callable[[str], None]):
        self.refresh, self._waiting, self._timer = refresh, {}, None
        self._lock, self._paused = threading.Lock(), False
        self.errors: dict[str, Exception] = {}

    def schedule(self, view: str, strategy: str, debounce: float) -> None:
        if strategy == "manual":
            return
        if strategy == "immediate":
            self.refresh(view)
            return
        with self._lock:
            self._waiting[view] = debounce
            if self._timer:
                self._timer.cancel()
            if not self._paused:
                self._timer = threading.Timer(max(self._waiting.values()), self.flush)
                self._timer.daemon = True
                self._timer.start()

    def pending_count(self) -> int:
        return len(self._waiting)

    def pause(self) -> None:
        with self._lock:
            self._paused = True
            if self._timer:
                self._timer.cancel()

    def resume(self) -> None:
        self._paused = False

    def reset(self) -> None:
        with self._lock:
            self._waiting.clear()
            if self._timer:
                self._timer.cancel()

    def flush(self) -> int:
        """Refreshes all waiting views now; how many. A view that fails doesn't stop others."""
        with self._lock:
            views = list(self._waiting)
            self._waiting.clear()
        for view in views:
            try:
                self.refresh(view)
                self.errors.pop(view, None)
            except Exception as e:
                self.errors[view] = e
        return len(views)
