"""HTTP sources: pages fetched with throttle, retries, cache and circuit breaker, read as a Spark data
source with one partition for each start address, so tasks fetch in parallel and a lost one starts its
address again."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rillstack.delivery import RetryPolicy, retry
from rillstack.state import MemoryState, StateBackend

#: Seconds that a cached page is good for where the caller says nothing: seven days.
CACHE_TTL = 7 * 24 * 3600.0


class StopFetching(Exception):
    """A batch function has no more."""


class CircuitOpen(ConnectionError):
    pass


class Refused(ConnectionError):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


@dataclass
class CircuitBreaker:
    """After so many failures in a row calls are refused for a time; then one is let through, and so many
    successes close the circuit again, while a failure opens it anew."""

    failure_threshold: int = 5
    timeout: float = 60.0
    success_threshold: int = 2
    now: Callable[[], float] = time.monotonic
    state: str = "closed"
    failures: int = 0
    successes: int = 0
    opened: float = 0.0

    def call(self, fn: Callable[[], object]) -> object:
        if self.state == "open":
            if self.now() - self.opened < self.timeout:
                raise CircuitOpen("the circuit is open")
            self.state, self.successes = "half-open", 0
        try:
            out = fn()
        except Exception:
            self.failures += 1
            if self.state == "half-open" or self.failures >= self.failure_threshold:
                self.state, self.opened = "open", self.now()
            raise
        self.failures = 0
        if self.state == "half-open":
            self.successes += 1
            if self.successes >= self.success_threshold:
                self.state = "closed"
        return out


@dataclass
class HttpCache:
    """Pages by a digest of source, address, parameters and headers."""

    backend: StateBackend = field(default_factory=MemoryState)
    ttl: float = CACHE_TTL
    hits: int = 0
    misses: int = 0

    @staticmethod
    def key(source: str, url: str, params: dict | None = None, headers: dict | None = None) -> str:
        parts = [source, url, json.dumps(sorted((params or {}).items())), json.dumps(sorted((headers or {}).items()))]
        return f"http:{source}:{hashlib.sha256(chr(0).join(parts).encode()).hexdigest()}"

    def get(self, key: str) -> object:
        found = self.backend.get(key)
        self.hits, self.misses = self.hits + (found is not None), self.misses + (found is None)
        return found

    def set(self, key: str, value: object, ttl: float | None = None) -> None:
        self.backend.set(key, value, self.ttl if ttl is None else ttl)

    def bulk_write(self, pages: dict[str, object]) -> None:
        for k, v in pages.items():
            self.set(k, v)

    def invalidate(self, key: str) -> None:
        self.backend.delete(key)

    def evict_source(self, source: str) -> int:
        return self.backend.delete_prefix(f"http:{source}:")

    def stats(self) -> dict:
        return {"entries": self.backend.count_prefix("http:"), "hits": self.hits, "misses": self.misses}

    def reset(self) -> None:
        self.backend.delete_prefix("http:")
        self.hits = self.misses = 0


def fetch(method: str, url: str, body: bytes | None, headers: dict, timeout: float) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=timeout) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


@dataclass
class HttpClient:
    """GETs are cached, POSTs never; each attempt waits for its turn; connection errors, 429 and 5xx are
    tried again."""

    base_url: str
    requests_per_second: float = 1.0
    timeout: float = 30.0
    max_retries: int = 3
    headers: dict = field(default_factory=dict)
    breaker: CircuitBreaker | None = None
    cache: HttpCache | None = None
    transport: Callable[[str, str, bytes | None, dict, float], tuple[int, str]] = fetch
    sleep: Callable[[float], None] = time.sleep
    now: Callable[[], float] = time.monotonic
    next_turn: float = 0.0

    def _send(self, method: str, url: str, body: bytes | None) -> str:
        def once() -> str:
            wait = self.next_turn - self.now()
            if wait > 0:
                self.sleep(wait)
            self.next_turn = max(self.now(), self.next_turn) + 1 / self.requests_per_second
            status, text = self.transport(method, url, body, self.headers, self.timeout)
            if status >= 400:
                raise Refused(status)
            return text

        def again(e: BaseException) -> bool:
            return not isinstance(e, CircuitOpen) and (not isinstance(e, Refused) or e.status == 429 or e.status >= 500) and isinstance(e, OSError)

        policy = RetryPolicy(self.max_retries + 1, classifier=again)
        return retry((lambda: self.breaker.call(once)) if self.breaker else once, policy, self.sleep)  # type: ignore[return-value,union-attr]

    def get(self, path: str, params: dict | None = None) -> object:
        url = self.base_url.rstrip("/") + path
        key = HttpCache.key(self.base_url, url, params, self.headers)
        found = self.cache.get(key) if self.cache else None
        if found is None:
            found = json.loads(self._send("GET", url + (f"?{urllib.parse.urlencode(sorted(params.items()))}" if params else ""), None))
            if self.cache:
                self.cache.set(key, found)
        return found

    def post(self, path: str, body: object) -> object:
        return json.loads(self._send("POST", self.base_url.rstrip("/") + path, json.dumps(body).encode()))


@dataclass
class HttpSource:
    """fetch_batch(client, start, state) gives records and may keep its place in the state dict; it is
    called until it raises StopFetching. make_client is called once for each start address."""

    make_client: Callable[[], HttpClient]
    fetch_batch: Callable[[HttpClient, str, dict], list[dict]]
    schema: str
    starts: tuple[str, ...] = ("",)

    def read(self, spark: SparkSession) -> DataFrame:
        make, batch_of = self.make_client, self.fetch_batch
        arrow = to_arrow_schema(StructType.fromDDL(self.schema))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start in b.column(0).to_pylist():
                    client, state = make(), {}
                    try:
                        while True:
                            rows = batch_of(client, start, state)
                            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], schema=arrow)
                    except StopFetching:
                        pass

        starts = spark.createDataFrame([(s,) for s in self.starts], "start string").repartition(len(self.starts), "start")
        return starts.mapInArrow(run, self.schema)
