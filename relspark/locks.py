"""Table locks in two phases: reserve, then hold; and the states of a transaction."""

from __future__ import annotations

import itertools
import threading
from enum import Enum, IntEnum

from .errors import EngineError


class LockType(Enum):
    RESERVED_READ_ONLY = 1
    RESERVED_READ_WRITE = 2
    SHARED = 3
    EXCLUSIVE = 4


class Priority(IntEnum):
    """Who goes first where several wait; those before USER_QUERY are urgent."""

    OBSERVER = 0
    EXTERNAL_CHANGE = 1
    USER_QUERY = 2
    TRANSACTION = 2


class _Entry:
    def __init__(self):
        self.reserved_ro: set = set()
        self.shared: set = set()
        self.reserved_rw = None
        self.exclusive = None


class LockManager:
    """``request`` answers at once; ``acquire`` waits: by priority, then in the order of coming."""

    def __init__(self):
        self._tables: dict[str, _Entry] = {}
        self._changed = threading.Condition()
        self._waiting: list[tuple[int, int, set[str]]] = []
        self._number = itertools.count()

    def _can(self, e: _Entry, task, kind: LockType) -> bool:
        if kind is LockType.EXCLUSIVE:
            return not (e.shared or e.reserved_ro) and e.exclusive is None and e.reserved_rw is task
        if kind is LockType.SHARED:
            return e.exclusive is None and e.reserved_rw is None and task in e.reserved_ro
        if kind is LockType.RESERVED_READ_ONLY:
            return e.reserved_rw is None
        return not e.reserved_ro and e.reserved_rw in (None, task)

    def request(self, task, tables: set[str], kind: LockType) -> bool:
        with self._changed:
            entries = [self._tables.setdefault(t, _Entry()) for t in tables]
            if not all(self._can(e, task, kind) for e in entries):
                return False
            for e in entries:
                if kind is LockType.EXCLUSIVE:
                    e.exclusive, e.reserved_rw = task, None
                elif kind is LockType.SHARED:
                    e.shared.add(task)
                    e.reserved_ro.discard(task)
                elif kind is LockType.RESERVED_READ_ONLY:
                    e.reserved_ro.add(task)
                else:
                    e.reserved_rw = task
            return True

    def acquire(self, task, tables: set[str], write: bool, priority: Priority = Priority.TRANSACTION) -> None:
        """Waits for both locks; a task lets those before it that want some of the same tables go first."""
        reserve, hold = (LockType.RESERVED_READ_WRITE, LockType.EXCLUSIVE) if write else (LockType.RESERVED_READ_ONLY, LockType.SHARED)
        with self._changed:
            me = (int(priority), next(self._number), set(tables))
            self._waiting.append(me)
        if priority < Priority.USER_QUERY:
            self.clear_reserved(tables)
        try:
            with self._changed:
                while any(w[:2] < me[:2] and w[2] & me[2] for w in self._waiting) or not (self.request(task, tables, reserve) and self.request(task, tables, hold)):
                    self._changed.wait(1.0)
        finally:
            with self._changed:
                self._waiting.remove(me)
                self._changed.notify_all()

    def release(self, task, tables: set[str]) -> None:
        with self._changed:
            for t in tables:
                e = self._tables.get(t)
                if e:
                    e.reserved_ro.discard(task), e.shared.discard(task)
                    e.reserved_rw = None if e.reserved_rw is task else e.reserved_rw
                    e.exclusive = None if e.exclusive is task else e.exclusive
            self._changed.notify_all()

    def clear_reserved(self, tables: set[str]) -> None:
        """For urgent tasks."""
        with self._changed:
            for t in tables:
                if t in self._tables:
                    self._tables[t].reserved_rw = None
            self._changed.notify_all()


_NEXT = {
    "CREATED": ("ACQUIRING_SCOPE", "EXECUTING_AND_COMMITTING"), "ACQUIRING_SCOPE": ("ACQUIRED_SCOPE",), "ACQUIRED_SCOPE": ("EXECUTING_QUERY", "COMMITTING", "ROLLING_BACK"),
    "EXECUTING_QUERY": ("ACQUIRED_SCOPE", "FINALIZED"), "EXECUTING_AND_COMMITTING": ("FINALIZED",), "COMMITTING": ("FINALIZED",), "ROLLING_BACK": ("FINALIZED",), "FINALIZED": (),
}


class TransactionState:
    def __init__(self):
        self.now = "CREATED"

    def to(self, state: str) -> None:
        if state not in _NEXT[self.now]:
            raise EngineError(107, self.now, state)
        self.now = state
