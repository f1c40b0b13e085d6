"""Operator 3: benchmark decontamination by templates, in DataFrame functions only.

Numbers, units and names become typed placeholders; other words are lowered and lose their outer
punctuation. A capitalised word at the start of a sentence may be a name or not: in a second template
all of these are names, and a window meets in either. Windows of eight template words of every benchmark item meet those of every document
in a hash join (benchmark windows are broadcast below a checked size). The slots of a copy of the
item in a document, or of all copies, must be consistent over all matched windows: no value of the
item's slots stands for two values in the document. A document is contaminated by an item if it
matches consistently, or word for word, in so many different windows of the item.
Items shorter than a window are one window as a whole.

Defined results: a null or empty text matches nothing; items of fewer than four words are not
looked for; repeated windows of an item count once; rows of one ``doc_id`` are one document, rows with
a null one are one for each text; an
empty benchmark gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstack.llm.common import LAST, documents, put, small
from rillstack.llm.quality import words_of

WINDOW = 8
#: Different windows of an item that a document holds (or all, where the item has fewer).
HITS = 4
MIN_WORDS = 4
#: Words of a window that aren't placeholders; with fewer, the placeholders' values must be equal.
LITERALS = 4
#: Units of measure that become a placeholder (fixed list).
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "miles", "mile", "meters", "metres", "g", "kg", "mg", "pounds",
    "ml", "l", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "years", "dollars", "euros", "cents", "percent",
)
#: Signs at the end of a word after which a sentence starts.
ENDS = (".", "!", "?", ":", '"', "”", "»")
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def _template(df: DataFrame, key: str) -> DataFrame:
    """From df (key, w: words) for each word a struct (t: template word, v: slot value or null, and t2,
    v2: the same with capitalised words at the start of a sentence as names), in column x. Each step is
    a column of its own, so that no expression is evaluated twice a word."""
    bare = F.transform("w", lambda w: F.when(w.rlike("^[A-Za-z0-9]+$"), w).otherwise(F.regexp_replace(w, EDGE, "")))
    ends = F.transform("w", lambda w: F.substring(w, -1, 1).isin(*ENDS))
    # zipped, not looked up: an array that a lambda refers to would be made anew for each word
    starts = F.concat(F.array(F.lit(True)), F.slice(ends, F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))))

    def seen(b: Column, starts: Column) -> Column:
        own = b.endswith("'s") | b.endswith("’s")
        return F.struct(
            F.lower(b).alias("low"), b.rlike(r"^\p{N}[\p{N}.,]*$").alias("number"), own.alias("own"),
            b.rlike(r"^\p{Lu}\p{Ll}+(['’]s)?$").alias("name"), starts.alias("starts"),
        )

    df = df.select(key, F.zip_with(bare, starts, seen).alias("x"))

    def kinds(x: Column) -> Column:
        kind = F.when(x["number"], F.lit("<num>")).when(x["low"].isin(*UNITS), F.lit("<unit>"))
        kind = kind.when(x["name"], F.when(x["own"], F.lit("<name>'s")).otherwise(F.lit("<name>")))
        value = F.when(x["own"], F.regexp_replace(x["low"], "['’]s$", "")).otherwise(x["low"])
        lone = x["starts"] & x["name"] & ~x["number"] & ~x["low"].isin(*UNITS)
        return F.struct(x["low"].alias("low"), kind.alias("kind"), value.alias("value"), F.coalesce(lone, F.lit(False)).alias("lone"))

    df = df.select(key, F.transform("x", kinds).alias("x"))

    def both(x: Column) -> Column:
        second = x["kind"].isNotNull()
        first = second & ~x["lone"]
        return F.struct(
            F.when(first, x["kind"]).otherwise(x["low"]).alias("t"), F.when(first, x["value"]).alias("v"),
            F.coalesce(x["kind"], x["low"]).alias("t2"), F.when(second, x["value"]).alias("v2"),
        )

    return df.select(key, F.filter(F.transform("x", both), lambda x: x["t"] != "").alias("x"))


def templates(df: DataFrame, key: str) -> DataFrame:
    return _template(df.select(key, words_of(F.col("text")).alias("w")), key).select(key, *(F.col(f"x.{c}").alias(c) for c in ("t", "v", "t2", "v2")))


def windows(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, h, at, second) of all windows, and once more of those that the second template makes
    different; df is made by templates(). Rows are narrow: what a window holds is looked up by slots()."""
    df = df.select(key, *(F.transform(t, lambda x: F.xxhash64(x)).alias(r) for t, r in (("t", "r1"), ("t2", "r2"))))
    # outer: else a filter on the array would be inferred, pushed down, and repeat all that makes it
    starts = F.when(F.size("r1") >= size, F.sequence(F.lit(0), F.size("r1") - size))
    df = df.select(key, "r1", "r2", F.explode_outer(starts).alias("at"))
    # of each row of its own, in compiled code: a lambda over the array is not compiled
    codes = [F.when(F.col("at").isNotNull(), F.xxhash64(*(F.get(r, F.col("at") + i) for i in range(size)))).alias(h) for r, h in (("r1", "h1"), ("r2", "h2"))]
    flat = df.select(key, "at", *codes)
    one, two = (F.struct(F.lit(x).alias("second"), F.col(h).alias("h")) for x, h in ((False, "h1"), (True, "h2")))
    flat = flat.select(key, "at", F.explode(F.when(F.col("h1") == F.col("h2"), F.array(one)).otherwise(F.array(one, two))).alias("x"))
    return flat.select(key, F.col("x.h").alias("h"), "at", F.col("x.second").alias("second"))


def slots(df: DataFrame, key: str, size: int, hits: DataFrame) -> DataFrame:
    """hits (key, at, second, ...) with the slots of their windows, and whether they are dense (have few
    literals); df is made by templates(), each key on one row."""
    places = hits.groupBy(key).agg(F.collect_set("at").alias("places"))  # one text's windows
    cut = F.transform("places", lambda p: F.struct(p.alias("at"), F.slice("v", p + 1, F.lit(size)).alias("s1"), F.slice("v2", p + 1, F.lit(size)).alias("s2")))
    each = df.select(key, "v", "v2").join(places, key).select(key, F.explode(cut).alias("x")).select(key, F.col("x.at").alias("at"), F.col("x.s1").alias("s1"), F.col("x.s2").alias("s2"))
    dense = F.size(F.array_compact("s1")) > size - min(LITERALS, size - 1)
    each = put(each.withColumn("dense", dense), "window-slots")
    return hits.join(each, [key, "at"]).withColumn("slots", F.when(F.col("second"), F.col("s2")).otherwise(F.col("s1"))).drop("s1", "s2")


def _consistent(met: DataFrame, *part: str) -> DataFrame:
    """(doc_id, row, item_id, n_windows) of the groups in which no slot value of the item stands for two
    values of the document."""
    pairs = F.filter(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"].isNotNull())
    sums = met.groupBy("doc_id", "row", "item_id", *part).agg(F.count_distinct("window").alias("n_windows"), F.flatten(F.collect_set(pairs)).alias("pairs"))
    fits = F.size(F.array_distinct("pairs")) == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))
    return sums.where(fits).select("doc_id", "row", "item_id", "n_windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hits: int = HITS) -> DataFrame:
    """(doc_id, item_id, n_windows, row): consistent window matches of each document with each item; row
    is a hash of the text where the doc_id is null, and null elsewhere."""
    items = put(templates(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id"), "items").where(F.size("t") >= MIN_WORDS)
    doc = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"))
    texts = templates(docs.select(doc.alias("doc"), "text"), "doc")
    sizes = [window] + [k for k in range(MIN_WORDS, window) if items.where(F.size("t") == k).limit(1).count()]
    out = None
    for size in sizes:
        mine = items if size == window else items.where(F.size("t") == size)
        least = F.least(F.lit(hits), F.col("n_item")) if size == window else F.lit(1)
        parts = put(slots(mine, "item_id", size, put(windows(mine, "item_id", size).where("h is not null"), "item-windows")), "item-windows")
        # a window goes by its first template, whichever meets; with few literals also by their values
        place = Window.partitionBy("item_id", "at")
        own = F.when(F.col("dense"), F.xxhash64("h", F.concat_ws(" ", "slots"))).otherwise(F.col("h"))
        parts = parts.withColumn("window", F.max(F.when(~F.col("second"), own)).over(place)).where(~(F.col("dense") & F.col("second")))
        counts = parts.groupBy("item_id").agg(F.count_distinct("window").alias("n_item"))
        sought = parts.select("item_id", "h", "window", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("dense").alias("item_dense"))
        fits = F.when(F.col("item_dense") | F.col("dense"), F.col("item_dense") & F.col("dense") & ~F.col("second") & (F.concat_ws(" ", "slots") == F.concat_ws(" ", "item_slots"))).otherwise(True)
        met = put(windows(texts, "doc", size).join(small(sought), "h"), "met-windows")
        there = put(met.select("doc").distinct(), "met-documents")
        # only the documents that met anything are looked into
        some = docs.select(doc.alias("doc"), "text").join(small(there), "doc", "left_semi").dropDuplicates(["doc"])
        met = slots(templates(some, "doc"), "doc", size, met).where(fits).select("doc", "at", "slots", "item_id", "window", "item_at", "item_slots")
        met = met.withColumn("doc_id", F.col("doc.doc_id")).withColumn("row", F.when(F.col("doc_id").isNull(), F.col("doc.row"))).withColumn("off", F.col("at") - F.col("item_at"))
        same = met.where(F.col("item_slots").eqNullSafe(F.col("slots"))).groupBy("doc_id", "row", "item_id").agg(F.count_distinct("window").alias("n_windows"))
        # where a window meets the item at several places, the one that most windows agree on
        one = ["doc", "item_id"]
        met = met.withColumn("votes", F.count("*").over(Window.partitionBy(*one, "off")))
        best = Window.partitionBy(*one, "at").orderBy(F.desc("votes"), "off", F.desc(F.size(F.array_compact("slots"))))
        met = met.withColumn("best", F.row_number().over(best)).where("best = 1")
        # a part is one copy of the item: its windows are shifted by less than a window
        along = Window.partitionBy(*one).orderBy("off", "at")
        met = met.withColumn("jump", (F.col("off") - F.lag("off").over(along) >= size).cast("int"))
        met = put(met.withColumn("part", F.sum(F.coalesce("jump", F.lit(0))).over(along)), "aligned-windows")
        good = same.union(_consistent(met, "doc", "part")).union(_consistent(met))
        good = good.groupBy("doc_id", "row", "item_id").agg(F.max("n_windows").alias("n_windows")).join(counts, "item_id")
        good = good.where(F.col("n_windows") >= least).select("doc_id", "item_id", "n_windows", "row")
        out = good if out is None else out.union(good)
    return out


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents; rows with a null doc_id are told apart by their text."""
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    found = put(contaminated(docs, benchmark), "contaminated")
    gone = found.select(place.alias("__ord"), F.coalesce("row", F.lit(0)).alias("__row")).distinct()
    keyed = docs.withColumn("__ord", place).withColumn("__row", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0))
    return keyed.join(small(gone), ["__ord", "__row"], "left_anti").select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
