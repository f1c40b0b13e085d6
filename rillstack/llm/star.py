"""Links within buckets without all pairs of a bucket, in DataFrame functions only.

Each bucket has a hub: the member whose buckets hold most entries together, so the text that a group
of copies was made from comes before the copies. Every other member is judged against the hub, and the
links found make connected groups. A bucket whose members are all in one group is settled. The members
of the others go, with their groups, to a search of the caller's that finds every link between different
groups without trying all pairs. So every two linked texts that share a bucket are in one connected
group; links within a group that change no group are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstack.llm.common import drop, put
from rillstack.llm.components import components


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def shared_entries(entries: DataFrame) -> DataFrame:
    """entries (key, id: long), each at most once, to (key, id, w) of those in buckets of two or more; w ranks ids by the sizes of all their
    buckets, ties by hash."""
    sizes = put(entries.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "n"), "bucket-sizes")
    shared = put(entries.join(sizes, "key"), "bucket-entries")
    drop(sizes)
    tie = F.pmod(F.xxhash64("id"), F.lit(1 << 16))
    weights = put(shared.groupBy("id").agg(F.sum("n").alias("n")).select("id", (F.col("n") * (1 << 16) + tie).alias("w")), "bucket-weights")
    out = put(shared.select("key", "id").join(weights, "id"), "bucket-entries")
    drop(shared)
    drop(weights)
    return out


def links(shared: DataFrame, judge: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A table of shared_entries(), which is used up, to groups (node, root) of the linked ids.

    judge takes distinct (a, b) and returns those that are linked. rest takes the members (id, root) of
    unsettled buckets and returns links (a, b) between different roots, enough of them to join all that are
    linked (None: the caller looks for these links).
    """
    hubs = shared.groupBy("key").agg(F.max_by("id", "w").alias("hub"))
    tried = put(shared.select("key", "id").join(hubs, "key").where("id <> hub").select(*_ordered("id", "hub")).distinct(), "bucket-tries")
    found = put(judge(tried).select("a", "b"), "bucket-links")
    drop(tried)
    groups = components(found)
    if rest is None:
        drop(shared)
        drop(found)
        return groups
    rooted = put(shared.select("key", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "bucket-roots")
    drop(shared)
    unsettled = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    ids = put(rooted.join(unsettled, "key").select("id", "root").distinct(), "unsettled-ids")
    drop(rooted)
    if ids.isEmpty():
        return groups
    more = rest(ids)
    return groups if more.isEmpty() else components(found.union(more))
