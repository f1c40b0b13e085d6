"""Stages that ask a language or embedding model, with cache, budget and safe templates.

A provider is made once a task by a factory, so nothing that holds a connection is sent to executors.
Answers are cached by a digest of the whole request, within a task and, with a path, in a table that
later runs join first; only distinct prompts without an answer are asked.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstack.functions.scalar import cosine_similarity
from rillstack.operators.pipeline import Stage, checked_policy, named
from rillstack.operators.stages import _stage

_SLOT = re.compile(r"\{([^{}]*)\}")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


@dataclass(frozen=True)
class Answer:
    text: str
    prompt_tokens: int = 0
    answer_tokens: int = 0


class Provider(Protocol):
    def complete(self, prompt: str, system: str | None = None, temperature: float = 0.0) -> Answer: ...
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class StubProvider:
    """Answers by a plain function and embeds by hashing: for tests, without a network."""

    answer: Callable[[str], str] = lambda p: json.dumps({"echo": p})
    size: int = 16
    calls: int = 0

    def complete(self, prompt: str, system: str | None = None, temperature: float = 0.0) -> Answer:
        self.calls += 1
        text = self.answer(prompt)
        return Answer(text, estimate_tokens(prompt), estimate_tokens(text))

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


def estimate_tokens(text: str) -> int:
    """About four characters a token; none for an empty text."""
    return math.ceil(len(text) / 4) if text else 0


def render(template: str, record: dict) -> str:
    """Plain {name} slots only. A name that the record lacks, an attribute or an index stays as it is;
    values are put in as text and not looked into again."""
    return _SLOT.sub(lambda m: str(record[m[1]]) if _NAME.match(m[1]) and m[1] in record else m[0], template)


def parsed_json(text: str) -> dict:
    """The object in an answer, with or without a code fence around it."""
    body = text.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[1] if "\n" in body else ""
        body = body.rsplit("```", 1)[0]
    out = json.loads(body)
    if not isinstance(out, dict):
        raise ValueError("the answer is not an object")
    return out


def cache_key(**request: object) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class AnswerCache:
    """In a task; the answer read longest ago goes first beyond max_size."""

    max_size: int = 1000
    entries: OrderedDict = field(default_factory=OrderedDict)
    hits: int = 0

    def get(self, key: str) -> str | None:
        if key not in self.entries:
            return None
        self.entries.move_to_end(key)
        self.hits += 1
        return self.entries[key]

    def set(self, key: str, value: str) -> None:
        self.entries[key] = value
        self.entries.move_to_end(key)
        if len(self.entries) > self.max_size:
            self.entries.popitem(last=False)


class BudgetExceeded(RuntimeError):
    pass


@dataclass
class Budget:
    """Costs per 1,000 tokens against a limit, for each record, or with scope `run` for a task's whole
    share: tasks don't see each other's costs, so a run's limit is given divided by its tasks."""

    limit: float
    prompt_cost: float = 0.0
    answer_cost: float = 0.0
    scope: str = "record"
    spent: float = 0.0

    def before(self, prompt: str) -> None:
        cost = estimate_tokens(prompt) / 1000 * self.prompt_cost
        if (self.spent if self.scope == "run" else 0.0) + cost > self.limit:
            raise BudgetExceeded(f"{cost:.6f} more is over the limit of {self.limit}")

    def after(self, answer: Answer) -> None:
        cost = answer.prompt_tokens / 1000 * self.prompt_cost + answer.answer_tokens / 1000 * self.answer_cost
        self.spent += cost
        if (self.spent if self.scope == "run" else cost) > self.limit:
            raise BudgetExceeded(f"{cost:.6f} is over the limit of {self.limit}")


@dataclass
class Asker:
    """A provider with its cache and budget."""

    provider: Provider
    cache: AnswerCache | None = field(default_factory=AnswerCache)
    budget: Budget | None = None
    system: str | None = None
    temperature: float = 0.0

    def ask(self, prompt: str) -> str:
        key = cache_key(prompt=prompt, system=self.system, temperature=self.temperature)
        found = self.cache.get(key) if self.cache else None
        if found is not None:
            return found
        if self.budget:
            self.budget.before(prompt)
        answer = self.provider.complete(prompt, self.system, self.temperature)
        if self.budget:
            self.budget.after(answer)
        if self.cache:
            self.cache.set(key, answer.text)
        return answer.text


Factory = Callable[[], Asker]


def _each(make: Factory, fn: Callable[[Asker, dict], dict | None], schema: str, name: str, on_error: str) -> Stage:
    def start():
        asker = make()

        def work(rows: list[dict]) -> list:
            out: list = []
            for r in rows:
                try:
                    out.append(fn(asker, r))
                except Exception as e:  # noqa: BLE001  the record's result
                    out.append(e)
            return out

        return work

    return _stage(start, schema, name, checked_policy(on_error), 1000, "model")


def enrich(make: Factory, template: str, output_fields: list[str], schema: str, name: str = "ai_enrich", on_error: str = "passthrough") -> Stage:
    """The answer to the rendered template is JSON; its named fields are merged into the record."""

    def fn(asker: Asker, r: dict) -> dict:
        got = parsed_json(asker.ask(render(template, r)))
        return {**r, **{k: got[k] for k in output_fields if k in got}}

    return _each(make, fn, schema, name, on_error)


def extract(make: Factory, source: str, fields: list[str], schema: str, name: str = "ai_extract", on_error: str = "passthrough") -> Stage:
    """Fields found in a text; a record with a blank one passes. Nulls in the answer are kept."""

    def fn(asker: Asker, r: dict) -> dict:
        text = r.get(source)
        if not text or not str(text).strip():
            return r
        got = parsed_json(asker.ask(f"Extract {', '.join(fields)} as a JSON object from:\n{text}"))
        return {**r, **{k: got[k] for k in fields if k in got}}

    return _each(make, fn, schema, name, on_error)


def classify(make: Factory, fields: list[str], categories: list[str], schema: str, target: str = "category", name: str = "ai_classify", on_error: str = "passthrough") -> Stage:
    """One of the categories and a confidence; an answer that is none of them is the first, with 0."""

    def fn(asker: Asker, r: dict) -> dict:
        text = " | ".join(str(r[f]) for f in fields if r.get(f))
        got = parsed_json(asker.ask(f"Give category (one of {json.dumps(categories)}) and confidence as a JSON object for:\n{text}"))
        known = got.get("category") in categories
        return {**r, target: got["category"] if known else categories[0], f"{target}_confidence": round(float(got.get("confidence", 0.0)), 4) if known else 0.0}

    return _each(make, fn, schema, name, on_error)


def classify_vectors(vector: Column, categories: dict[str, list[float]], target: str = "category", name: str = "ai_classify") -> Stage:
    """The category whose vector is nearest by cosine, the first of equals: in expressions only."""

    def run(df: DataFrame) -> DataFrame:
        scores = [F.struct(cosine_similarity(vector, F.array(*(F.lit(float(x)) for x in v))).alias("s"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, (c, v) in enumerate(categories.items())]
        best = F.array_max(F.array(*scores))
        return df.withColumn("_best", best).withColumns({target: F.col("_best.c"), f"{target}_confidence": F.bround(F.col("_best.s"), 4)}).drop("_best")

    return named(run, name)


def translate(make: Factory, fields: list[str], language: str, schema: str, prefix: str = "", name: str = "ai_translate", on_error: str = "passthrough") -> Stage:
    """The non-empty fields in another language, in place or under a prefix."""

    def fn(asker: Asker, r: dict) -> dict:
        some = {f: r[f] for f in fields if r.get(f)}
        if not some:
            return r
        got = parsed_json(asker.ask(f"Translate the values to {language}, as the same JSON object:\n{json.dumps(some, ensure_ascii=False)}"))
        return {**r, **{prefix + f: got[f] for f in some if f in got}}

    return _each(make, fn, schema, name, on_error)


def validate(make: Factory, rule: str, schema: str, least: float = 0.8, on_invalid: str = "flag", flag: str = "ai_valid", name: str = "ai_validate", on_error: str = "passthrough") -> Stage:
    """Valid if the answer says so with enough confidence; else flagged, dropped or an error."""
    checked_policy(on_invalid, "flag", "drop", "raise")

    def fn(asker: Asker, r: dict) -> dict | None:
        got = parsed_json(asker.ask(f"Give valid (true or false) and confidence as a JSON object. Rule: {rule}\nRecord: {json.dumps(r, default=str, ensure_ascii=False)}"))
        good = bool(got.get("valid")) and float(got.get("confidence", 0.0)) >= least
        if good or on_invalid == "flag":
            return {**r, flag: good}
        if on_invalid == "raise":
            raise ValueError("the record is not valid")
        return None

    return _each(make, fn, schema, name, "raise" if on_invalid == "raise" else on_error)


def batched(make: Factory, template: str, output_fields: list[str], schema: str, size: int = 20, name: str = "ai_batch", on_error: str = "passthrough") -> Stage:
    """Up to `size` records in one request, answered by a list of as many objects; another number, or an
    error, is each of these records' error."""

    def start():
        asker = make()

        def work(rows: list[dict]) -> list:
            try:
                got = json.loads(asker.ask(json.dumps([render(template, r) for r in rows], ensure_ascii=False)))
                if not isinstance(got, list) or len(got) != len(rows):
                    raise ValueError(f"not one answer for each of {len(rows)} records")
                return [{**r, **{k: g[k] for k in output_fields if k in g}} for r, g in zip(rows, got, strict=True)]
            except Exception as e:  # noqa: BLE001
                return [e] * len(rows)

        return work

    return _stage(start, schema, name, checked_policy(on_error), size, "model")


def cached_answers(df: DataFrame, prompt: Column, make: Factory, path: str, target: str = "answer") -> DataFrame:
    """df with the answer to each prompt, through a table of answers by digest: distinct prompts that it
    lacks are asked once and appended, whatever the number of records that have them."""
    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    keyed = df.withColumn("_key", F.sha2(prompt, 256))

    def stored() -> DataFrame:
        try:
            return spark.read.schema("key string, answer string").parquet(path).groupBy("key").agg(F.min("answer").alias("answer"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "key string, answer string")

    asked = keyed.groupBy(F.col("_key").alias("key")).agg(F.min(prompt).alias("prompt")).join(stored(), "key", "left_anti")

    def run(batches):
        import pyarrow as pa

        asker = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([asker.ask(p or "") for p in b.column("prompt").to_pylist()], pa.string())], ["key", "answer"])

    asked.mapInArrow(run, "key string, answer string").write.mode("append").parquet(path)
    return keyed.join(stored().select(F.col("key").alias("_key"), F.col("answer").alias(target)), "_key", "left").drop("_key")
