"""What a run leaves behind: metrics over runs, status, Prometheus text, health pages, spans."""

from __future__ import annotations

import hmac
import json
import threading
import time
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from rillstack.operators.pipeline import Summary

RUNNING, IDLE, OK, DEGRADED, FAILING = "running", "idle", "ok", "degraded", "failing"


@dataclass
class PipelineStats:
    runs: int = 0
    failed_runs: int = 0
    consumed: int = 0
    written: int = 0
    dropped: int = 0
    errored: int = 0
    seconds: float = 0.0
    last_error: str | None = None
    last: Summary | None = None
    active: int = 0
    stages: Counter = field(default_factory=Counter)

    @property
    def status(self) -> str:
        if self.active:
            return RUNNING
        if not self.runs:
            return IDLE
        if self.last is None:
            return FAILING
        rate = self.last.success_rate
        return OK if not self.last.errored else DEGRADED if rate >= 0.5 else FAILING

    @property
    def pending(self) -> int:
        return self.consumed - self.written - self.dropped - self.errored


@dataclass
class Collector:
    """Stats of all pipelines of this driver."""

    stats: dict[str, PipelineStats] = field(default_factory=dict)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def of(self, pipeline_id: str) -> PipelineStats:
        return self.stats.setdefault(pipeline_id, PipelineStats())

    @contextmanager
    def run(self, pipeline_id: str):
        """Counts a run; the summary is put into the dict that it gives, under `summary`."""
        out: dict = {}
        began = time.monotonic()
        with self.lock:
            self.of(pipeline_id).active += 1
        try:
            yield out
        except BaseException as e:
            with self.lock:
                s = self.of(pipeline_id)
                s.failed_runs, s.last_error, s.last = s.failed_runs + 1, f"{type(e).__name__}: {e}", None
            raise
        finally:
            with self.lock:
                s = self.of(pipeline_id)
                s.active, s.runs, s.seconds = s.active - 1, s.runs + 1, s.seconds + time.monotonic() - began
                done: Summary | None = out.get("summary")
                if done is not None:
                    s.last, s.last_error = done, None
                    for k in ("consumed", "written", "dropped", "errored"):
                        setattr(s, k, getattr(s, k) + getattr(done, k))
                    for stage, counts in done.by_stage.items():
                        for outcome, n in counts.items():
                            s.stages[stage, outcome] += n


def _label(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def prometheus(collector: Collector) -> str:
    out = []
    for name, kind, of in (
        ("runs_total", "counter", lambda s: s.runs), ("failed_runs_total", "counter", lambda s: s.failed_runs), ("records_consumed_total", "counter", lambda s: s.consumed),
        ("records_written_total", "counter", lambda s: s.written), ("records_dropped_total", "counter", lambda s: s.dropped), ("records_errored_total", "counter", lambda s: s.errored),
        ("run_seconds_total", "counter", lambda s: round(s.seconds, 3)), ("active_runs", "gauge", lambda s: s.active),
    ):
        out.append(f"# TYPE rillstack_{name} {kind}")
        out += [f'rillstack_{name}{{pipeline="{_label(p)}"}} {of(s)}' for p, s in sorted(collector.stats.items())]
    out.append("# TYPE rillstack_stage_records_total counter")
    for p, s in sorted(collector.stats.items()):
        out += [f'rillstack_stage_records_total{{pipeline="{_label(p)}",stage="{_label(k)}",outcome="{o}"}} {n}' for (k, o), n in sorted(s.stages.items())]
    return "\n".join(out) + "\n"


@dataclass
class AIMetrics:
    calls: int = 0
    cache_hits: int = 0
    prompt_tokens: int = 0
    answer_tokens: int = 0
    cost: float = 0.0
    categories: Counter = field(default_factory=Counter)

    def absorb(self, other: AIMetrics) -> AIMetrics:
        return AIMetrics(*(getattr(self, k) + getattr(other, k) for k in ("calls", "cache_hits", "prompt_tokens", "answer_tokens", "cost", "categories")))


def category_counts(df, column: str) -> dict[str, int]:
    """How many records each category has: a row a category reaches the driver."""
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


@dataclass(frozen=True)
class Span:
    name: str
    start: float
    seconds: float
    attributes: dict
    error: str | None = None
    parent: str | None = None


class NoopTracer:
    @contextmanager
    def span(self, name: str, **attributes: object):
        yield None


@dataclass
class MemoryTracer:
    spans: list[Span] = field(default_factory=list)
    stack: list[str] = field(default_factory=list)

    @contextmanager
    def span(self, name: str, **attributes: object):
        parent, began, error = (self.stack[-1] if self.stack else None), time.time(), None
        self.stack.append(name)
        try:
            yield attributes
        except BaseException as e:
            error = type(e).__name__
            raise
        finally:
            self.stack.pop()
            self.spans.append(Span(name, began, time.time() - began, attributes, error, parent))


class OtelTracer:
    """Spans of the OpenTelemetry API, where that package is installed."""

    def __init__(self, name: str = "rillstack"):
        from opentelemetry import trace

        self.tracer = trace.get_tracer(name)

    @contextmanager
    def span(self, name: str, **attributes: object):
        with self.tracer.start_as_current_span(name, attributes=attributes) as s:
            yield s


@dataclass(frozen=True)
class HealthSnapshot:
    healthy: bool
    component: str
    detail: str = ""


@dataclass(frozen=True)
class RecoveryContract:
    """What a component promises after a failure."""

    component: str
    resumable: bool
    replay_safe: bool
    cursor: str | None = None


@dataclass(frozen=True)
class AcceptanceReport:
    component: str
    checks: dict[str, bool]

    @property
    def accepted(self) -> bool:
        return all(self.checks.values())


class HealthServer:
    """/health, /ready and /metrics of a driver; with a token the last needs it as a bearer."""

    def __init__(self, collector: Collector, port: int = 0, token: str | None = None, host: str = "127.0.0.1"):
        outer = self
        self.collector, self.token, self.ready = collector, token, True

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                status, kind, body = outer.page(self.path, self.headers.get("Authorization"))
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_: object) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_port

    def page(self, path: str, authorization: str | None = None) -> tuple[int, str, str]:
        kind = "application/json"
        states = {p: s.status for p, s in self.collector.stats.items()}
        if path == "/health":
            bad = FAILING in states.values()
            return (503 if bad else 200), kind, json.dumps({"status": FAILING if bad else OK, "pipelines": states})
        if path == "/ready":
            return (200 if self.ready else 503), kind, json.dumps({"ready": self.ready})
        if path == "/metrics":
            if self.token is not None and not hmac.compare_digest(authorization or "", f"Bearer {self.token}"):
                return 401, kind, json.dumps({"error": "unauthorized"})
            return 200, "text/plain; version=0.0.4", prometheus(self.collector)
        return 404, kind, json.dumps({"error": "not found"})

    def __enter__(self) -> HealthServer:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        self.server.shutdown()
        self.server.server_close()
