"""Texts without a clue are left out before windows are made: few are left, and none that holds an item."""

import pytest
from pyspark.sql import functions as F

from terrane.llm import common, decontamination

ITEMS = [
    (1, "Maria Lopez bought twenty 3 red apples and gave 5 of them to her friend Anna before the long walk home"),
    (2, "A train leaves at 7 and travels 60 miles each hour until the last station of the line is reached"),
    (3, "Yes indeed"),
    (4, "one two three four"),
    (5, "Paris 3 Rome 4 Oslo 5 Bern 6 Wien 7"),
]
DOCS = [
    (1, "So then Peter Smith bought 9 red apples and gave twenty one of them to her friend Eva before the long walk home."),
    (2, "A TRAIN LEAVES AT 7 AND TRAVELS 60 MILES EACH HOUR UNTIL THE LAST STATION OF THE LINE IS REACHED"),
    (3, "yes, indeed!"),
    (4, "paris 3 rome 4 oslo 5 bern 6 wien 7"),
    (5, "The line of the last train is long and the station is far; yes indeed, each hour."),
    (6, "Nothing of the kind is said here, and the walk home was long before the friend came."),
    (7, None),
    (8, ""),
    (9, "One, two, three, four."),
]


def _found(spark, docs, items):
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, decontamination.decontaminate(df, bench).drop("text").collect()))


@pytest.mark.parametrize("items", [[i for i in ITEMS if i[0] != 4], ITEMS], ids=["all have clues", "one has none"])
def test_nothing_is_lost_by_clues(spark, monkeypatch, items):
    joined = decontamination.suspects
    given = {}
    for name, find in (("plan", joined), ("join", lambda b, c: joined(b, c, 0)), ("every text", lambda b, c: b)):
        monkeypatch.setattr(decontamination, "suspects", find, raising=False)
        given[name] = _found(spark, DOCS, items)
    assert given["plan"] == given["join"] == given["every text"]
    assert {r[0] for r in given["plan"] if r[1]} >= {1, 2, 3, 4}


def test_few_texts_are_looked_at_closely(spark):
    bench = spark.createDataFrame([i for i in ITEMS if i[0] != 4], "item_id long, text string")
    items = common.materialize(decontamination.benchmark_items(bench))
    windows = [w.withColumn("exact", F.lit(e)) for w, e in ((decontamination.benchmark_windows(items), False), (decontamination.literal_windows(items), True))]
    found = decontamination.clues(items, windows[0].unionByName(windows[1]))
    body = spark.createDataFrame([(t,) for _, t in DOCS], "_text string")
    for most in (0, 5000):
        assert {r[0] for r in decontamination.suspects(body, found, most).collect()} == {DOCS[i][1] for i in range(4)}


def test_words_keep_points_between_digits(spark):
    rows = [("1.2.3,4.5 \U0001d7cf.\U0001d7d0,\U0001d7d1 .5. 6., 7,8.,9 a.b x",)]
    words = spark.createDataFrame(rows, "text string").select(decontamination.words_of(F.col("text"))).first()[0]
    p = decontamination._POINT
    assert words == [f"1{p}2{p}3{p}4{p}5", f"\U0001d7cf{p}\U0001d7d0{p}\U0001d7d1", "5", "6", f"7{p}8", "9", "a", "b", "x"]
