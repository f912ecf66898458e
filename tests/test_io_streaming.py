import json

import pytest

from rankloom.operators import ledger
from rankloom.sources import readers
from rankloom.streaming import ledger as stream


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_text('First Name,Title\n"Ana, A","Head ""x"""\n')
    assert readers.read_upload(spark, str(tmp_path / "a.csv")).collect()[0].asDict() == {"FirstName": "Ana, A", "Designation": 'Head "x"'}
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"FirstName": "Bo", "n": 1}]}))
    assert readers.read_upload(spark, str(tmp_path / "b.json")).first().asDict() == {"FirstName": "Bo", "n": "1"}
    with pytest.raises(readers.UnsupportedUpload):
        readers.read_upload(spark, str(tmp_path / "c.pdf"))
    (tmp_path / "d.csv").write_text("Name\n")
    with pytest.raises(readers.EmptyUpload):
        readers.read_upload(spark, str(tmp_path / "d.csv"))
    nodes = spark.createDataFrame([("a", "global", "A", -1, "x", False), ("b", None, None, None, None, None)], "node_id string, node_type string, label string, layer int, sector string, is_ghost boolean")
    edges = spark.createDataFrame([("a", "b"), ("a", "gone"), ("a", "b")], "parent_id string, child_id string")
    for k in ("one", "two", "one"):
        readers.write_graph(nodes, edges, str(tmp_path / "g"), k)
    n, e = readers.read_graph(spark, str(tmp_path / "g"), "one")
    assert n.count() == 2 and [tuple(r) for r in e.collect()] == [("a", "b")]


def test_stream_promotes_only_unanimous_patterns(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    row = lambda t, lv, i: json.dumps({"correction_id": i, "archetype": "a", "region": "EU", "original_title_native": t, "corrected_level": lv, "corrected_function": "HR", "analyst_id": "x"})
    (log / "1.json").write_text("\n".join([row("Chef", 1, 1), row("Boss", 1, 2), "not json"]))
    args = (spark, str(log), str(tmp_path / "out"), str(tmp_path / "cp"), 2)
    stream.promote_continuously(*args).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/batch=0")).count() == 0
    (log / "2.json").write_text("\n".join([row("chef ", 1, 3), row("Boss", 2, 4)]))
    stream.promote_continuously(*args).awaitTermination()
    assert [r.title_l for r in spark.read.parquet(str(tmp_path / "out/batch=1")).collect()] == ["chef"]
    assert ledger.summary(readers.read_log(spark, str(log))).filter("kind = 'total'").first().n == 4
