"""Pipelines from TOML: component registries, import references, profiles and environment overlays.

A document names its version, `defaults`, `profiles`, `environments` and `pipelines`. A pipeline's
settings are the defaults, its profile, its own, then the environment's for it; tables are merged, lists
are replaced as a whole.
"""

from __future__ import annotations

import importlib
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.delivery import DeliveryConfig
from rillstack.operators import dedup, pipeline
from rillstack.sinks import files as file_sinks
from rillstack.sinks import io as io_sinks
from rillstack.sinks.base import NullSink, Sink
from rillstack.sources import files as file_sources

VERSION = "rillstack/v1"
GROUPS = ("source", "stage", "sink", "dedup_store", "dedup_strategy", "state", "provider", "schedule", "tracer", "metrics")
_REF = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*:[A-Za-z_]\w*\Z")


class ConfigError(ValueError):
    pass


def import_ref(ref: str) -> object:
    """`package.module:name`, identifiers only."""
    if not _REF.match(ref):
        raise ConfigError(f"{ref!r} is not of the form package.module:name")
    module, name = ref.split(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise ConfigError(f"{ref} can't be imported: {e}") from e


@dataclass
class Registry:
    """Factories by group and key; installed packages may add theirs under `rillstack.<group>`."""

    factories: dict[str, dict[str, Callable]] = field(default_factory=lambda: {g: {} for g in GROUPS})

    def register(self, group: str, key: str, factory: Callable, replace: bool = False) -> None:
        if group not in self.factories:
            raise ConfigError(f"unknown group {group}")
        if key in self.factories[group] and not replace:
            raise ConfigError(f"{group} {key} is registered already")
        self.factories[group][key] = factory

    def get(self, group: str, key: str) -> Callable:
        if ":" in key:
            return import_ref(key)  # type: ignore[return-value]
        if key not in self.factories[group]:
            for e in entry_points(group=f"rillstack.{group}", name=key):
                self.factories[group][key] = e.load()
        try:
            return self.factories[group][key]
        except KeyError:
            raise ConfigError(f"no {group} named {key}; there are {', '.join(sorted(self.factories[group])) or 'none'}") from None

    def create(self, group: str, settings: dict, **given: object) -> object:
        if "type" not in settings:
            raise ConfigError(f"a {group} needs a type")
        rest = {k: v for k, v in settings.items() if k != "type"}
        return self.get(group, settings["type"])(**rest, **given)

    def names(self) -> dict[str, list[str]]:
        return {g: sorted(x) for g, x in self.factories.items()}


def standard() -> Registry:
    r = Registry()
    for key in ("csv", "jsonl", "parquet"):
        r.register("source", key, lambda key=key, **s: file_sources.FileSource(format=key, **s))
    r.register("sink", "parquet", file_sinks.ParquetSink)
    r.register("sink", "csv", file_sinks.CsvSink)
    r.register("sink", "jsonl", file_sinks.JsonLinesSink)
    r.register("sink", "dlq", file_sinks.DeadLetterSink)
    r.register("sink", "stdout", io_sinks.StdoutSink)
    r.register("sink", "log", io_sinks.LogSink)
    r.register("sink", "webhook", io_sinks.WebhookSink)
    r.register("sink", "noop", NullSink)
    r.register("stage", "filter", lambda where, name="filter": pipeline.filter_stage(F.expr(where), name))
    r.register("stage", "map", lambda columns, name="map": pipeline.map_stage(name=name, **{k: F.expr(v) for k, v in columns.items()}))
    r.register("stage", "validate", lambda rule, on_error="drop", name="validate", coerce=None: pipeline.validate_stage(F.expr(rule), on_error, name, coerce))
    r.register("stage", "dedup", lambda key, order, name="dedup": pipeline.dedup_stage(F.expr(key), *([order] if isinstance(order, str) else order), name=name))
    r.register("stage", "dedup_fuzzy", lambda text, order, threshold=0.82, name="dedup_fuzzy": dedup.fuzzy_stage(F.expr(text), order, threshold, name))
    r.register("dedup_store", "table", dedup.TableStore)
    r.register("dedup_strategy", "exact", dedup.ExactMatch)
    r.register("dedup_strategy", "fuzzy", dedup.FuzzyMatch)
    return r


def deep_merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str) -> dict:
    with open(path, "rb") as f:
        doc = tomllib.load(f)
    if doc.get("version") != VERSION:
        raise ConfigError(f"the version must be {VERSION}")
    if not doc.get("pipelines"):
        raise ConfigError("no pipelines")
    return doc


def resolve(doc: dict, name: str, environment: str | None = None) -> dict:
    if name not in doc["pipelines"]:
        raise ConfigError(f"no pipeline {name}; there are {', '.join(sorted(doc['pipelines']))}")
    own = doc["pipelines"][name]
    out = doc.get("defaults", {})
    if "profile" in own:
        if own["profile"] not in doc.get("profiles", {}):
            raise ConfigError(f"no profile {own['profile']}")
        out = deep_merge(out, doc["profiles"][own["profile"]])
    out = deep_merge(out, own)
    if environment is not None:
        if environment not in doc.get("environments", {}):
            raise ConfigError(f"no environment {environment}")
        over = doc["environments"][environment]
        out = deep_merge(deep_merge(out, {k: v for k, v in over.items() if k != "pipelines"}), over.get("pipelines", {}).get(name, {}))
    for need in ("source", "sinks"):
        if need not in out:
            raise ConfigError(f"pipeline {name} has no {need}")
    return out


def build(spark: SparkSession, settings: dict, name: str, registry: Registry | None = None) -> pipeline.BoundPipeline:
    r = registry or standard()
    source = r.create("source", settings["source"])
    df = source if isinstance(source, DataFrame) else source.read(spark)  # type: ignore[union-attr]
    flow = pipeline.Pipeline(df.drop("_row"), pipeline_id=name)
    if "limit" in settings:
        flow = flow.limit(settings["limit"])
    for s in settings.get("stages", []):
        flow = flow.pipe(r.create("stage", s), s.get("name"))  # type: ignore[arg-type]
    sinks: list[Sink] = [r.create("sink", s) for s in settings["sinks"]]  # type: ignore[misc]
    dlq = r.create("sink", settings["dlq"]) if "dlq" in settings else None
    return flow.fan_out(*sinks, config=DeliveryConfig(**settings.get("delivery", {})), dlq=dlq)  # type: ignore[arg-type]


@dataclass
class Container:
    """Named things made once, when they are first asked for."""

    makers: dict[str, Callable[[Container], object]] = field(default_factory=dict)
    made: dict[str, object] = field(default_factory=dict)

    def provide(self, name: str, make: Callable[[Container], object]) -> None:
        self.makers[name] = make
        self.made.pop(name, None)

    def get(self, name: str) -> object:
        if name not in self.made:
            if name not in self.makers:
                raise ConfigError(f"nothing provides {name}")
            self.made[name] = self.makers[name](self)
        return self.made[name]
