import datetime as dt
import json
import random

import pytest

from rankloom.operators import schema_drift as sd

SCHEMA = "record_id long, feed string, file_no int, file_name string, uploaded_at timestamp, line_no int, payload string"


def rows(feed, files):
    out = []
    for n, recs in files.items():
        for i, r in enumerate(recs):
            out.append((len(out) + 1, feed, n, f"{feed}_{n}", dt.datetime(2024, 1, 30 - n), i + 1, r if r is None or isinstance(r, str) else json.dumps(r, ensure_ascii=False)))
    return out


@pytest.fixture(scope="module")
def drifting():
    rng = random.Random(5)
    first, cities = ["Ana", "Björn", "Çelik", "Dora", "Elif"], ["Oslo, Norway", "Lima, Peru", "Cork, Ireland"]
    def rec(first_name="FirstName", **more):
        return {first_name: rng.choice(first), "Location": rng.choice(cities), **more}
    f1 = [rec(Pay=rng.randint(10, 99) * 1000) for _ in range(12)] + ['{"FirstName": "Zo', "[1]", None, '"text"']
    f2 = [rec("Vorname", Pay=str(rng.randint(10, 99) * 1000)) for _ in range(12)]
    f2 = f2 + f2  # the whole file came twice
    f3 = [{"Vorname": [rng.choice(first)], "Pay": None, "Start": "2024-01-0%d" % (i % 9 + 1)} for i in range(12)]
    f4 = [{"Vorname": [rng.choice(first)], "Pay": {"amount": 5, "unit": "EUR"}, "Start": "2024-02-0%d" % (i % 9 + 1), "fname": None} for i in range(12)]
    return rows("a", {1: f1, 2: f2, 3: f3, 4: f4, 6: f4, 7: ["broken"]})


def test_report(spark, drifting):
    df = spark.createDataFrame(drifting, SCHEMA).selectExpr("*", "1 as kind", "'x' as field")
    got = sorted(map(tuple, sd.report_changes(df).collect()))
    assert got == [
        ("a", 2, "renamed", "FirstName", "Vorname"),
        ("a", 2, "retyped", "Pay", ""),
        ("a", 3, "added", "Start", ""),
        ("a", 3, "removed", "Location", ""),
        ("a", 3, "retyped", "Vorname", ""),
        ("a", 4, "added", "fname", ""),
    ]


def test_unify(spark, drifting):
    df = spark.createDataFrame(drifting, SCHEMA)
    out = sd.unify(df).cache()
    assert out.filter("file_no = 2").select("line_no", "canonical").distinct().count() == out.filter("file_no = 2").count()  # copies once
    assert {r.canonical for r in out.filter("file_no = 3").select("canonical").distinct().collect()} == {"FirstName", "Pay", "Start"}
    one = out.filter("file_no = 4 and canonical = 'Pay'").first()
    assert (one.kind, one.as_number, json.loads(one.as_object), one.canonical_text) == ("object", None, {"amount": 5, "unit": "EUR"}, "5 EUR")
    one = out.filter("file_no = 4 and canonical = 'FirstName'").first()
    assert one.kind == "list" and one.canonical_text == json.loads(one.as_list)[0]
    one = out.filter("file_no = 1 and canonical = 'Pay'").first()
    assert one.kind == "number" and float(one.canonical_text) == one.as_number


def test_alternatives_per_path(spark):
    """Every type of a path, also one that a single record has, at any depth; and when it appears."""
    files = {1: [{"a": 1, "o": {"x": [1, 2]}}, {"a": 2}], 2: [{"a": 1, "o": {"x": ["t", None, {"y": True}]}}, {"a": "odd"}, "broken"]}
    df = spark.createDataFrame(rows("f", files) + rows("f", files)[:1], SCHEMA)
    got = {(r.file_no, r.path, r.kind): (r.n, r.appears) for r in sd.alternatives(df).collect()}
    assert got == {
        (1, "a", "number"): (2, False), (1, "o", "object"): (1, False), (1, "o.x", "list"): (1, False), (1, "o.x[]", "number"): (2, False),
        (2, "a", "number"): (1, False), (2, "a", "text"): (1, True), (2, "o", "object"): (1, False), (2, "o.x", "list"): (1, False), (2, "o.x[]", "text"): (1, True), (2, "o.x[]", "object"): (1, True), (2, "o.x[].y", "boolean"): (1, True),
    }
    typed = {(r.file_no, r.path, r.kind): (r.as_text, r.as_number, r.as_boolean) for r in sd.typed_paths(df).filter("file_no = 2").collect()}
    assert typed[2, "o.x[]", "text"] == ("t", None, None) and typed[2, "o.x[].y", "boolean"] == (None, None, True) and typed[2, "a", "number"] == (None, 1.0, None)


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sd.report_changes(empty).count() == 0
    assert sd.unify(empty).count() == 0 and sd.alternatives(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, 1, None, None, None, '{"a": 1}'), (2, "f", None, None, None, 1, "{}"), (3, "f", 1, None, None, 1, "{}")], SCHEMA)
    assert sd.report_changes(nulls).count() == 0
