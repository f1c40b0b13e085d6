"""Operator 3 against exact windows on whole sf0.001, and planted re-parameterised questions."""

import re

from rillstack.llm.decontaminate import contaminated

WORD, EDGE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"^[\W_]+|[\W_]+$")
D = "/root/testdata/sf0.001"


def words(text: str | None) -> list[str]:
    return [w for w in (EDGE.sub("", x).lower() for x in WORD.findall(text or "")) if w]


def test_exact_passages(spark):
    docs, items = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    where = {}
    for r in items.collect():
        w = words(r.text)
        for k in range(len(w) - 7):
            where.setdefault(tuple(w[k : k + 8]), set()).add(r.item_id)
    seen = {}
    for r in docs.collect():
        w = words(r.text)
        for k in range(len(w) - 7):
            for i in where.get(tuple(w[k : k + 8]), ()):
                seen.setdefault((r.doc_id, i), set()).add(tuple(w[k : k + 8]))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()}
    assert got == {k for k, v in seen.items() if len(v) >= 4}


def test_templates(spark):
    item = "A train leaves the station with Maria and 40 boxes, then Maria gives away 12 boxes; how many boxes does Maria still have left"
    other = item.replace("Maria", "Omar").replace("40", "95").replace("12", "31")
    broken = item.replace("and 40", "and 95").replace("then Maria", "then Omar").replace("does Maria", "does Peter")
    rows = [(1, item), (2, other), (3, broken), (4, None), (5, ""), (None, other), (6, "words " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "two words")], "item_id long, text string")
    got = {r.doc_id for r in contaminated(docs, bench).collect()}
    assert {1, 2} <= got and not got & {4, 5, 6}
    assert contaminated(docs, bench.where("item_id < 0")).count() == 0
