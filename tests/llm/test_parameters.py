"""Operator 3 on questions with other names and numbers."""

import pytest

from rillstack.llm.decontaminate import contaminated

QUESTIONS = [
    "Maria runs 12 miles on Monday. Omar runs 7 miles on Friday. Maria rests. How far do they run?",
    "Maria sold 48 clips in April. Omar sold half as many. Maria then bought 6 more. How many are left?",
    "Maria's box holds 12 red pens. Omar's box holds 7 pens more than Maria's box. How many pens do they have?",
]


def other(text: str) -> str:
    for x, y in (("Maria", "Lena"), ("Omar", "Paul"), ("12", "15"), ("48", "72"), ("7 ", "9 ")):
        text = text.replace(x, y)
    return text


@pytest.fixture(scope="module")
def found(spark):
    def run(texts: list[str], items: list[str]) -> set[tuple[int, int]]:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        return {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}

    return run


def test_names_that_begin_sentences(found):
    texts = [other(q) for q in QUESTIONS]
    assert found([*texts, "Before it. " + texts[0] + " After it."], QUESTIONS) == {(0, 0), (1, 1), (2, 2), (3, 0)}


def test_slots_over_the_whole_match(found):
    item = "A train leaves the station with Maria and 40 boxes, then Maria gives away 12 boxes; how many boxes does Maria still have left"
    broken = item.replace("and 40", "and 95").replace("then Maria", "then Omar").replace("does Maria", "does Peter")
    twice = item.replace("Maria", "Omar") + ". " + item.replace("Maria", "Lena")
    longer = item.replace("Maria", "Omar").replace("gives", "quickly gives")
    assert found([broken, twice, longer], [item]) == {(1, 0), (2, 0)}


def test_items_of_numbers_and_units(found):
    items = ["Compute 12 + 7 * 3 - 44 / 2 + 19 - 6 * 8 + 5", "Order 3 kg 5 dollars, 7 kg 9 dollars, 12 kg 14 dollars, 20 kg 25 dollars"]
    changed = [x.replace("7", "8").replace("12", "13").replace("44", "45").replace("5", "6") for x in items]
    assert found([*items, *changed], items) == {(0, 0), (1, 1)}
