"""Lifecycle events: read, refresh, maintenance, reconcile.

Payload keys are part of the interface. Nothing is computed for events nobody listens to.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

NAMES = ("read", "refresh", "maintenance", "reconcile")


class Events:
    def __init__(self):
        self._listeners: dict[str, list[Callable[[str, dict], None]]] = {}
        self._lock = threading.Lock()

    def subscribe(self, name: str, listener: Callable[[str, dict], None]) -> Callable[[], None]:
        """Calls ``listener(name, payload)`` on each such event; returns how to stop that."""
        if name not in NAMES:
            raise ValueError(f"event {name!r} is none of {', '.join(NAMES)}")
        with self._lock:
            self._listeners.setdefault(name, []).append(listener)
        return lambda: self._listeners[name].remove(listener)

    def heard(self, name: str) -> bool:
        return bool(self._listeners.get(name))

    def emit(self, name: str, payload: dict | Callable[[], dict]) -> None:
        if listeners := list(self._listeners.get(name, ())):
            value = payload() if callable(payload) else payload
            for x in listeners:
                x(name, value)
