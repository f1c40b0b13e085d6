"""What every sink has: a name, capabilities, and one write of a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Capabilities:
    """planes: row, batch or arrow; what a second write of the same records does."""

    planes: tuple[str, ...] = ("row", "batch", "arrow")
    parallel_safe: bool = True
    ordered: bool = False
    replay_safe: bool = False
    idempotent: bool = False


@dataclass(frozen=True)
class Written:
    sink: str
    written: int
    errored: int = 0
    error: str | None = None


def results_of(value: object, n: int) -> list[bool]:
    """Per-record results of a batch write: None says that all went well."""
    if value is None:
        return [True] * n
    out = [bool(x) for x in value]  # type: ignore[attr-defined]
    if len(out) != n:
        raise ValueError(f"{len(out)} results for {n} records")
    return out


class Sink:
    name = "sink"
    capabilities = Capabilities()

    def write(self, df: DataFrame, run_id: str = "") -> Written:
        raise NotImplementedError

    def failed(self, error: str) -> Written:
        return Written(self.name, 0, 0, error)


@dataclass
class NullSink(Sink):
    """Runs the plan and keeps nothing."""

    name: str = "noop"
    capabilities: Capabilities = field(default_factory=lambda: Capabilities(replay_safe=True, idempotent=True))

    def write(self, df: DataFrame, run_id: str = "") -> Written:
        return Written(self.name, df.count())
