"""Runs of cells against cells counted one by one, and states as aggregates."""

import random
from collections import Counter
from datetime import date

from pyspark.sql import functions as F

from terrane.functions import dates
from terrane.operators import aggregates, coverage
from terrane.plans import registry
from tests.test_operators import polygons


def test_runs_equal_counted_cells(spark):
    rng = random.Random(3)
    spans = []
    for _ in range(200):
        first = rng.randrange(60)
        spans.append((rng.randrange(6), first, first + rng.randrange(20), rng.randrange(3)))
    spans += [(9, 0, 0, 1), (9, 1, 1, 1), (9, 0, 0, 1)]
    want = Counter()
    for row in {s[0] for s in spans}:
        cells = {}
        for r, a, b, slot in spans:
            if r == row:
                for c in range(a, b + 1):
                    cells.setdefault(c, [0, 0, 0])[slot] += 1
        for counts in cells.values():
            want[row, *counts] += 1
    df = spark.createDataFrame(spans, "row long, first long, last long, slot int")
    got = coverage.runs(df, 3).where("c0 + c1 + c2 > 0")
    assert {(r["row"], r.c0, r.c1, r.c2): r.n for r in got.groupBy("row", "c0", "c1", "c2").agg(F.sum("n").alias("n")).collect()} == dict(want)
    assert coverage.runs(df.where("false"), 3).count() == 0


def test_rows_grow_with_boundaries_not_with_area(spark):
    """Ten times finer cells give ten times the rows of the grid, not a hundred times the rows of the sweep."""
    shapes = polygons(spark, [("a", 0, "a", (0, 0, 0.5, 0.5)), ("b", 1, "b", (0.2, 0.2, 0.9, 0.9))])
    sizes = {}
    for cell_m in (2000.0, 200.0):
        grid = coverage.grid_over(shapes, cell_m=cell_m)
        sizes[cell_m] = coverage.runs(coverage.burn(shapes, F.lit(0), grid), 1).count()
    assert sizes[200.0] <= 11 * sizes[2000.0]


def test_timeline_of_unsorted_years_with_undated_features(spark):
    ext = polygons(spark, [("E", 0, "e", (0, 0, 1, 1))])
    rows = polygons(spark, [("a", 0, "a", (0, 0, 0.5, 1)), ("b", 1, "b", (0.25, 0, 0.75, 1)), ("c", 2, "c", (0.9, 0, 1, 1))])
    day = F.when(F.col("fid") == "a", F.lit("1990-05-01")).when(F.col("fid") == "b", F.lit("2001-01-01")).cast("date")
    line = coverage.timeline({"ext": ext, "m": rows.withColumn("dated", day)}, "ext", [2001, 1980, 1990], cell_m=2000.0)
    pct = {r.year: r.pct for r in line.collect()}
    for year, share in ((1980, 0), (1990, 50), (2001, 75), (None, 85)):
        assert abs(pct[year] - share) < 2.5, (year, pct)


def test_states_as_aggregates_equal_states_of_lists(spark):
    rng = random.Random(1)
    rows = [(i % 20, rng.randrange(1, 5), date(2000 + rng.randrange(9), 1, 1), rng.choice([None, date(2000 + rng.randrange(12), 6, 1)])) for i in range(150)]
    rows += [(99, 3, None, None), (99, None, date(2001, 1, 1), None)]
    df = spark.createDataFrame(rows, "id int, stage int, valid_from date, valid_to date")
    day = F.lit(date(2004, 3, 1))
    one = df.groupBy("id").agg(aggregates.reached(F.col("stage"), F.col("valid_from"), day).alias("a"), aggregates.standing(F.col("stage"), F.col("valid_from"), F.col("valid_to"), day).alias("b"))
    lists = df.groupBy("id").agg(F.collect_list(F.struct("stage", "valid_from", "valid_to")).alias("h"))
    two = lists.select("id", dates.stage_at(F.col("h"), day).alias("a"), dates.stage_within(F.col("h"), day).alias("b"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_no_lists_in_the_plans_of_states(spark):
    for name in ("stage_as_of", "interval_state"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_" not in plan and "max(" in plan
