"""Small driver-side state: key-value entries with an optional expiry, in memory or in a SQLite file,
and views of it by namespace. Large key sets belong in tables (`operators/dedup.py`)."""

from __future__ import annotations

import json
import sqlite3
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol


class StateBackend(Protocol):
    def get(self, key: str) -> object: ...
    def set(self, key: str, value: object, ttl: float | None = None) -> None: ...
    def set_if_absent(self, key: str, value: object, ttl: float | None = None) -> bool: ...
    def delete(self, key: str) -> None: ...
    def count_prefix(self, prefix: str) -> int: ...
    def delete_prefix(self, prefix: str) -> int: ...


@dataclass
class MemoryState:
    """With max_size, the entry that was read or written longest ago goes first."""

    max_size: int | None = None
    now: Callable[[], float] = time.time
    entries: OrderedDict = field(default_factory=OrderedDict)

    def _live(self, key: str):
        found = self.entries.get(key)
        if found is None or (found[1] is not None and found[1] <= self.now()):
            self.entries.pop(key, None)
            return None
        self.entries.move_to_end(key)
        return found

    def get(self, key: str) -> object:
        found = self._live(key)
        return None if found is None else json.loads(found[0])

    def set(self, key: str, value: object, ttl: float | None = None) -> None:
        self.entries[key] = (json.dumps(value), None if ttl is None else self.now() + ttl)
        self.entries.move_to_end(key)
        while self.max_size is not None and len(self.entries) > self.max_size:
            self.entries.popitem(last=False)

    def set_if_absent(self, key: str, value: object, ttl: float | None = None) -> bool:
        if self._live(key) is not None:
            return False
        self.set(key, value, ttl)
        return True

    def delete(self, key: str) -> None:
        self.entries.pop(key, None)

    def count_prefix(self, prefix: str) -> int:
        return sum(self._live(k) is not None for k in list(self.entries) if k.startswith(prefix))

    def delete_prefix(self, prefix: str) -> int:
        keys = [k for k in self.entries if k.startswith(prefix)]
        for k in keys:
            del self.entries[k]
        return len(keys)


class SQLiteState:
    """The same in a file of the driver."""

    def __init__(self, path: str, now: Callable[[], float] = time.time):
        self.now = now
        self.db = sqlite3.connect(path, isolation_level=None, check_same_thread=False)
        self.db.execute("create table if not exists entries (name text primary key, body text not null, until real)")

    def get(self, key: str) -> object:
        row = self.db.execute("select body from entries where name = ? and (until is null or until > ?)", (key, self.now())).fetchone()
        return None if row is None else json.loads(row[0])

    def set(self, key: str, value: object, ttl: float | None = None) -> None:
        self.db.execute("insert or replace into entries values (?, ?, ?)", (key, json.dumps(value), None if ttl is None else self.now() + ttl))

    def set_if_absent(self, key: str, value: object, ttl: float | None = None) -> bool:
        self.db.execute("delete from entries where name = ? and until <= ?", (key, self.now()))
        until = None if ttl is None else self.now() + ttl
        return self.db.execute("insert or ignore into entries values (?, ?, ?)", (key, json.dumps(value), until)).rowcount == 1

    def delete(self, key: str) -> None:
        self.db.execute("delete from entries where name = ?", (key,))

    def _range(self, prefix: str) -> tuple[str, str]:
        return prefix, prefix + "\U0010ffff"

    def count_prefix(self, prefix: str) -> int:
        return self.db.execute("select count(*) from entries where name >= ? and name < ? and (until is null or until > ?)", (*self._range(prefix), self.now())).fetchone()[0]

    def delete_prefix(self, prefix: str) -> int:
        return self.db.execute("delete from entries where name >= ? and name < ?", self._range(prefix)).rowcount

    def close(self) -> None:
        self.db.close()


@dataclass
class TTLStore:
    """Values of one namespace with one lifetime."""

    backend: StateBackend
    namespace: str
    ttl: float | None = None

    def get(self, key: str) -> object:
        return self.backend.get(f"{self.namespace}:{key}")

    def set(self, key: str, value: object) -> None:
        self.backend.set(f"{self.namespace}:{key}", value, self.ttl)


@dataclass
class MembershipStore:
    """A set of keys in one namespace."""

    backend: StateBackend
    namespace: str
    ttl: float | None = None

    def exists(self, key: object) -> bool:
        return self.backend.get(f"{self.namespace}:{key}") is not None

    def add(self, key: object) -> None:
        self.backend.set(f"{self.namespace}:{key}", 1, self.ttl)

    def mark_if_new(self, key: object) -> bool:
        return self.backend.set_if_absent(f"{self.namespace}:{key}", 1, self.ttl)

    def size(self) -> int:
        return self.backend.count_prefix(f"{self.namespace}:")
