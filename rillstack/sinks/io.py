"""Sinks for people and services: standard output, the log, webhooks.

Standard output is written by the driver from an iterator, a partition at a time. Log lines and posts
are sent by the tasks; each post's result comes back as a row, so a refused batch is counted.
"""

from __future__ import annotations

import json
import logging
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstack.sinks.base import Capabilities, Sink, Written


@dataclass
class StdoutSink(Sink):
    prefix: str = "▶ "
    stream: object = None
    name: str = "stdout"
    capabilities: Capabilities = field(default_factory=lambda: Capabilities(parallel_safe=False, ordered=True))

    def write(self, df: DataFrame, run_id: str = "") -> Written:
        out, n = self.stream or sys.stdout, 0
        for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            out.write(f"{self.prefix}{r.j}\n")
            n += 1
        return Written(self.name, n)


@dataclass
class LogSink(Sink):
    """One log entry a record, by the task that has it."""

    event: str = "record"
    level: str = "info"
    extra: Callable[[dict], dict] | None = None
    logger: str = "rillstack.sink"
    name: str = "log"

    def write(self, df: DataFrame, run_id: str = "") -> Written:
        event, level, extra, logger = self.event, logging.getLevelName(self.level.upper()), self.extra, self.logger

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            log, n = logging.getLogger(logger), 0
            for batch in batches:
                for r in batch.to_pylist():
                    log.log(level, "%s %s", event, json.dumps(extra(r) if extra else r, default=str))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        return Written(self.name, df.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)


def hidden_url(url: str) -> str:
    """A URL without its user and query, for logs and errors."""
    x = urlsplit(url)
    host = x.netloc.rpartition("@")[2]
    return urlunsplit((x.scheme, f"***@{host}" if "@" in x.netloc else host, x.path, "***" if x.query else "", ""))


def http_post(url: str, body: bytes, headers: dict, timeout: float) -> int:
    """The status of a POST."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code


@dataclass
class WebhookSink(Sink):
    """POSTs JSON: an object for each record, or with `batch` a list of so many. 429 and 5xx are tried
    again after 1, 2, 4, ... seconds; another 4xx fails the records at once. A batch that is refused
    is errored and the others go on."""

    url: str
    batch: int | None = None
    retries: int = 3
    timeout: float = 10.0
    headers: dict = field(default_factory=dict)
    post: Callable[[str, bytes, dict, float], int] = http_post
    sleep: Callable[[float], None] = time.sleep
    name: str = "webhook"

    def write(self, df: DataFrame, run_id: str = "") -> Written:
        url, size, retries, timeout, post, sleep = self.url, self.batch, self.retries, self.timeout, self.post, self.sleep
        headers = {"Content-Type": "application/json", **self.headers}

        def send(body: bytes) -> str | None:
            for attempt in range(retries + 1):
                try:
                    status = post(url, body, headers, timeout)
                except OSError as e:
                    status, text = 599, type(e).__name__
                else:
                    text = f"status {status}"
                if status < 300:
                    return None
                if status != 429 and status < 500:
                    return text
                if attempt < retries:
                    sleep(2.0**attempt)
            return text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            good, bad, why = 0, 0, None
            for batch in batches:
                rows = batch.column(0).to_pylist()
                for k in range(0, len(rows), size or 1):
                    part = rows[k : k + (size or 1)]
                    error = send((("[" + ",".join(part) + "]") if size else part[0]).encode())
                    good, bad, why = (good + len(part), bad, why) if error is None else (good, bad + len(part), error)
            yield pa.RecordBatch.from_arrays([pa.array([good]), pa.array([bad]), pa.array([why], pa.string())], ["good", "bad", "why"])

        text = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
        r = text.mapInArrow(run, "good long, bad long, why string").agg(F.sum("good"), F.sum("bad"), F.max("why")).first()
        if r[1] and not r[0]:
            raise ConnectionRefusedError(f"{hidden_url(url)} refused all records: {r[2]}")
        return Written(self.name, r[0] or 0, r[1] or 0, r[2])
