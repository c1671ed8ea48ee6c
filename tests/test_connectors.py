"""Landing files, and the small rules of state and position."""

from datetime import date

from pyspark.sql import functions as F

from terrane.functions import dates, values
from terrane.operators import provenance, search
from terrane.sources.fetch import Fetcher


def test_fetcher_throttles_and_caches(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    now, slept = [0.0], []
    fetcher = Fetcher(str(tmp_path / "landed"), clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    url = (tmp_path / "a.txt").as_uri()
    assert fetcher.download(url, "x/a.txt").read_text() == "abc"
    fetcher.download(url, "x/a.txt")
    fetcher.download(url, "x/a.txt", force=True)
    assert slept == [1.5]
    rows = fetcher.manifest(spark).collect()
    assert [(r.filename, r.bytes) for r in rows] == [("x/a.txt", 3)] * 2


def test_small_rules(spark):
    history = F.array(F.struct(F.lit(2).alias("stage"), F.lit("1990-05-01").cast("date").alias("valid_from")))
    none = F.lit(None).cast("date")
    late = F.lit("1999-01-01").cast("date")
    row = spark.range(1).select(
        dates.visible_extent(history, late, 1990), dates.visible_extent(history, late, 1989), dates.visible_extent(history, none, 1980),
        dates.minimum_stage(3, late, F.array(F.lit("e")))[0]["valid_from"],
        values.depopulation(F.lit("gone"), F.lit("1948-05"), ("gone",))["mechanism"], values.depopulation(F.lit("gone"), F.lit("1967"), ("gone",))["mechanism"],
        values.shown_position(True, F.lit(None).cast("int"), F.lit(1)), values.not_true(F.lit(None).cast("boolean")),
    ).first()
    assert tuple(row) == (True, False, True, date(1999, 1, 1), "depopulation_1948", None, 1, True)


def test_attach_and_lookup(spark):
    rows, table = provenance.hoist(provenance.attach(spark.range(3), "s", "t", document_date="2020-01-01"))
    assert table.count() == 1 and rows.where("size(evidence_ref) = 1").count() == 3
    a, b = (spark.createDataFrame([("x", n)], "id string, name string") for n in ("first", "second"))
    assert search.by_id([a, b], "x", ["name"]).first().name == "first"
