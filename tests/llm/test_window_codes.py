"""Operator 3: the hashes of windows tell runs of template words apart, and few steps of them are left to lambdas."""

from pyspark.sql import functions as F

from rillstack.llm.decontaminate import templates, windows

TEXTS = [(1, "Then Maria gives away 12 boxes. Peter has 40 of them left today"), (2, "then Maria gives away 95 boxes. Nobody has 31 of them left today"), (3, "two words"), (4, None)]


def test_windows_are_runs_of_words(spark):
    made = templates(spark.createDataFrame(TEXTS, "id long, text string"), "id").cache()
    runs = {}
    for r in made.collect():
        for at in range(len(r.t) - 7):
            first, second = tuple(r.t[at : at + 8]), tuple(r.t2[at : at + 8])
            runs[r.id, at, False] = first
            if first != second:
                runs[r.id, at, True] = second
    got = {(r.id, r.at, r.second): r.h for r in windows(made, "id", 8).where("h is not null").collect()}
    assert set(got) == set(runs) and any(second for _, _, second in runs)
    assert len(set(got.values())) == len(set(runs.values())) == len(set(zip(got.values(), (runs[k] for k in got), strict=True)))


def test_one_lambda_a_word_and_template(spark):
    made = spark.createDataFrame([(1, ["a"], ["a"])], "id long, t array<string>, t2 array<string>")
    plan = windows(made, "id", 8).where(F.col("h") != 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(xxhash64") <= 2, plan
