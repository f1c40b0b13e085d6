"""Scalar functions as columns; only Jaro-Winkler and slugs need Python, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

EARTH_METERS = 6_371_000.0


def cosine_similarity(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is 0; raises where lengths differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)


def haversine_meters(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_METERS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def jaro_winkler_value(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_value(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def _without_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ"))


def to_slug(text: Column, size: int = 80) -> Column:
    bare = _without_marks(F.regexp_replace(F.lower(text), "đ", "d"))
    words = F.regexp_replace(F.regexp_replace(bare, r"[^A-Za-z0-9_\s-]", ""), r"[\s_-]+", "-")
    return F.substring(F.regexp_replace(words, "^-+|-+$", ""), 1, size)


def estimate_prompt_tokens(text: Column) -> Column:
    """About four characters a token; an empty or null text has none."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def cache_key(**parts: Column) -> Column:
    """SHA-256 of the named parts as one JSON object in the order of their names; null and the text
    "null" differ."""
    return F.sha2(F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"}), 256)


def safe_path(path: Column) -> Column:
    """A relative path without empty, `.` and `..` parts and drive letters; signs other than letters,
    digits, dot, hyphen and underscore become underscores. Raises where nothing is left."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[A-Za-z]:", ""), "/")
    clean = F.transform(F.filter(parts, lambda p: ~F.trim(p).isin("", ".", "..")), lambda p: F.regexp_replace(F.trim(p), r"[^\p{L}\p{N}._-]", "_"))
    out = F.array_join(clean, "/")
    return F.when(out == "", F.raise_error(F.lit("the path has no name")).cast("string")).otherwise(out)


def merge(df: DataFrame, updates: dict[str, Column], closed: bool = False) -> DataFrame:
    """df with the updates; a closed record type takes only those of columns that it has."""
    return df.withColumns({k: v for k, v in updates.items() if not closed or k in df.columns}) if updates else df


def redacted_url(url: Column) -> Column:
    """A URL without its user and query."""
    return F.regexp_replace(F.regexp_replace(url, r"(?<=://)[^/@]*@", "***@"), r"\?.*$", "?***")
