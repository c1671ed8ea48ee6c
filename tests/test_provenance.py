"""Evidence hoisted from any depth."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from terrane.operators import explainers, provenance

E = "array<struct<source_id:string,title:string,url:string,document_date:date,retrieved:date,note:string>>"


def ev(source, day=date(2020, 1, 1)):
    return (source, "t", None, day, date(2024, 1, 1), None)


def test_evidence_leaves_every_depth(spark):
    schema = f"id int, evidence {E}, steps array<struct<n:int,evidence:{E},inner:struct<evidence:{E},deep:array<struct<evidence:{E}>>>>>, named map<string,struct<evidence:{E},v:int>>, evidences string, other array<struct<a:int>>"
    rows = [
        (1, [ev("a"), ev("b"), ev("a")], [(1, [ev("c")], ([ev("d")], [([ev("e")],), (None,)])), (2, None, None)], {"k": ([ev("f")], 3), "n": None}, "kept", [(1,)]),
        (2, None, None, None, None, None),
        (3, [], [], {}, "", []),
    ]
    out, table = provenance.hoist_nested(spark.createDataFrame(rows, schema))
    assert {r.source_id for r in table.collect()} == set("abcdef") and table.count() == 6
    assert "evidence:" not in out.schema.simpleString() and out.schema.simpleString().count("evidence_ref") == 5
    by = {r.id: r for r in out.collect()}
    ids = {r.source_id: r.evidence_id for r in table.collect()}
    one = by[1]
    assert one.evidence_ref == [ids["a"], ids["b"]] and one.steps[0].evidence_ref == [ids["c"]] and one.steps[0].inner.evidence_ref == [ids["d"]]
    assert one.steps[0].inner.deep[0].evidence_ref == [ids["e"]] and one.named["k"].evidence_ref == [ids["f"]] and one.named["k"].v == 3 and one.named["n"] is None
    assert one.steps[1].n == 2 and one.steps[1].inner is None and one.evidences == "kept" and one.other[0].a == 1
    assert by[2].evidence_ref is None and by[2].steps is None and by[3].evidence_ref == []
    refs = out.select("id", F.explode("steps").alias("s")).select("id", F.col("s.evidence_ref").alias("evidence_ref"))
    assert provenance.dangling(refs, table.where("source_id <> 'c'"), "id").count() == 1
    empty, none = provenance.hoist_nested(spark.createDataFrame([], schema))
    assert empty.count() == 0 and none.count() == 0
    with pytest.raises(ValueError, match="holds"):
        provenance.hoist_nested(spark.range(1))


def test_undated_citations_of_claims(spark):
    claim = f"struct<text:string,evidence:{E}>"
    rows = [("x", [("one", [ev("a")]), ("two", [ev("b", None)])]), ("y", [])]
    told, table = explainers.published(spark.createDataFrame(rows, f"id string, claims array<{claim}>"))
    assert [r.claim_id for r in explainers.undated(told, table).collect()] == ["x:1"]
    assert [r.id for r in explainers.without_claims(told).collect()] == ["y"]
