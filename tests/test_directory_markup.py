import json

from pyspark.sql import functions as F

from rankloom.functions import markup as m
from rankloom.operators import directory as d
from rankloom.operators import reports
from rankloom.sources import library, readers

CARD = '<div class="team card"><h3>Ana Krol</h3><p>Chief Grid Officer</p></div><div class="card"><h3>NEWS 2020</h3><p>x</p></div>'
LD = '<script type="application/ld+json">{"@type":"Organization","member":[{"@type":"Person","name":"Bo Lim","jobTitle":"CEO"}]}</script>'


def test_people_of_pages(spark):
    assert m.people_of_page(LD + CARD) == [("Bo Lim", "CEO")]
    assert m.people_of_page(CARD) == [("Ana Krol", "Chief Grid Officer")]
    assert m.people_of_page('<li itemtype="http://schema.org/Person"><b itemprop="name">Cy Da</b><i itemprop="jobTitle">CTO</i></li>') == [("Cy Da", "CTO")]
    assert m.people_of_page("<h2>Di Ek</h2><h4>Head of Grid</h4><h2>Some long heading about the firm and more</h2>") == [("Di Ek", "Head of Grid")]
    assert m.people_of_page('<p class="profile-name">Ed Fu</p><p class="profile-title">Chair</p>') == [("Ed Fu", "Chair")]
    assert m.people_of_page("<p>unclosed <b>") == m.people_of_page("") == m.people_of_page(None) == []
    page = '<script id="__NEXT_DATA__" type="application/json">{"a":[{"fullName":"Ana Krol","role":"CEO"}]}</script><script>window.__STATE__ = {"x":{"name":"Bo Lim","title":"CFO"}};</script> "directors": [{"name":"Cy Da","position":"x"}]'
    assert m.page_data(page) == [("Ana Krol", "CEO"), ("Bo Lim", "CFO"), ("Cy Da", "x")]
    deep: dict = {"name": "Too Deep", "title": "x"}
    for _ in range(8):
        deep = {"k": deep}
    assert m.walk_people(deep) == [] and m.walk_people(None) == []
    assert m.tolerant_json('Sure:\n```json\n{"board_of_directors":[{"name":"A B"}],"executive_management":[{"name":"C D"}]}\n```') == [{"name": "A B", "is_board": True}, {"is_board": False, "name": "C D"}]
    assert m.tolerant_json("nothing") == m.tolerant_json(None) == []
    df = spark.createDataFrame([(CARD,), (None,), ("",)], "h string")
    assert [len(r[0]) for r in df.select(m.people_in_page("h")).collect()] == [1, 0, 0]


def test_sections_and_evidence(spark):
    df = spark.createDataFrame([(1, "x\nBoard of Directors\nAna Krol\n\nHistory\ny"), (2, None), (3, "")], "id long, t string")
    assert [tuple(r) for r in m.carve_sections(df, "id", "t").collect()] == [(1, 2, "Board of Directors"), (1, 3, "Ana Krol")]
    t = "a" * 300 + "Item 10 people" + "b" * 50 + "ITEM 11 rest"
    row = spark.createDataFrame([(t, "none")], "a string, b string").select(m.between_markers("a").alias("x"), m.between_markers("b").alias("y"), m.marker_slice("a", "item 10", 5, 9).alias("z"), m.marker_slice("b", "item").alias("n")).first()
    assert row.x == "a" * 100 + "Item 10 people" + "b" * 50 and row.y == "none" and row.z == "aaaaaItem 10 p" and row.n is None
    long = " x" * 120
    ev = [("José Nuñez", "jose nunez" + long, True), ("Ana M. Krol", "krol, ana m." + long, True), ("C. Scharf", "scharf" + long, True), ("Ana Li", "nobody" + long, False), ("Ana Li", "short", True), (None, "x" + long, False), ("Ana Li", None, True)]
    got = [r[0] for r in spark.createDataFrame([e[:2] for e in ev], "n string, s string").select(m.name_evidence("n", "s")).collect()]
    assert got == [e[2] for e in ev]
    u = spark.createDataFrame([("see https://www.linkedin.com/in/ana-krol-1 and https://linkedin.com/in/bo-lim and https://linkedin.com/in/bo-lim", "Ana Krol"), ("x", "Ana Krol")], "t string, n string").withColumn("u", m.linkedin_urls("t"))
    assert [(len(r.u), r.x) for r in u.select("u", m.url_for_name(F.col("u"), F.col("n")).alias("x")).collect()] == [(2, "https://www.linkedin.com/in/ana-krol-1"), (0, None)]
    assert spark.createDataFrame([("<script>" + "x" * 900 + "</script>hi",), (None,)], "h string").select(m.is_js_shell("h")).collect()[0][0] is True


def directory(spark):
    return d.Directory(
        spark.createDataFrame([("bank", "company", "bank"), ("bank", "designation", "loan officer"), ("shop", "industry_hint", "retail")], "industry string, kind string, keyword string"),
        spark.createDataFrame([("bank", 3, "Loan Director"), ("bank", 7, "Branch Manager"), ("shop", 6, "Store Lead")], "industry string, layer int, name string"),
        spark.createDataFrame([("bank", "Lending", "loan"), ("bank", "Branches", "branch office"), ("shop", "Stores", "store")], "industry string, dept string, keyword string"),
        spark.createDataFrame([("bank", 5, "^vault .*")], "industry string, layer int, pattern string"),
    )


def test_directory(spark):
    dr = directory(spark)
    r = spark.createDataFrame([(1, "Loan Officer", "Olix Bank", None), (2, "x", "Banknote", "Retail"), (3, None, None, None)], "id long, designation string, company string, industry_hint string")
    assert {x.id: (x.industry, x.score) for x in d.best_industry(r, dr.detection).collect()} == {1: ("bank", 35.0), 2: ("shop", 25.0)}
    q = spark.createDataFrame([(1, "loan director", "bank"), (2, "Deputy Branch Manager", None), (3, "Vault Keeper", "bank"), (4, "Manager of Branch", None), (5, "Poet", None), (6, None, None), (7, "Store Lead", "bank")], "id long, designation string, industry string")
    got = {x.id: (x.layer, x.stage, x.confidence) for x in d.layers(q, dr).collect()}
    assert got[1] == (3, "exact", 1.0) and got[2] == (7, "substring", round(0.88 * 0.82, 6)) and got[3][:2] == (5, "pattern") and got[4][:2] == (7, "fuzzy") and got[5] == (5, "fallback", 0.6) and got[7][1] == "fallback" and 6 not in got
    depts = {x.id: (x.dept, x.how) for x in d.departments(q, dr, [("Arts", "poet")]).collect()}
    assert depts[1] == ("Lending", "industry") and depts[7] == ("Stores", "any") and depts[5] == ("Arts", "rule") and depts[6] == ("Operations", "default")
    tax = spark.createDataFrame([json.dumps(x) for x in ({"l1": "Money", "l1_keywords": [], "departments": [{"name": "Loans", "keywords": ["loan"], "sub_depts": [{"name": "Homes", "keywords": ["home"], "teams": [{"name": "North", "keywords": ["n"]}]}]}]}, {"l1": "Corporate & Executive", "l1_keywords": [], "departments": [{"name": "Law", "keywords": ["law"], "sub_depts": [{"name": "Patents", "keywords": ["patent"], "teams": []}]}]})], "string")
    schema = "l1 string, l1_keywords array<string>, departments array<struct<name string, keywords array<string>, sub_depts array<struct<name string, keywords array<string>, teams array<struct<name string, keywords array<string>>>>>>>"
    flat = {(r.primary, r.secondary): list(r.keywords) for r in d.flatten_taxonomy(tax.select(F.from_json("value", schema).alias("x")).select("x.*")).collect()}
    assert flat == {("Money", "Loans"): ["loan", "homes", "home", "north", "n"], ("Law", ""): ["law"], ("Law", "Patents"): ["patent"]}
    a = spark.createDataFrame([("Banking",), ("the retail trade",), ("x",), (None,)], "a string")
    assert [r[0] for r in a.select(d.known_industry(F.col("a"), ["Banking", "Retail"])).collect()] == ["Banking", "Retail", None, None]
    t = spark.createDataFrame([("Tax Clerk", "Finance"), ("Tax Clerk", "tax"), ("x", "y")], "t string, p string")
    assert [r[0] for r in t.select(d.tertiary_label(F.col("t"), F.col("p"), [("Tax", "tax"), ("Clerks", "clerk")])).collect()] == ["Tax", "Clerks", ""]


def test_library_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "bank", "detection_keywords": {"company": ["bank"]}, "hierarchy": [{"layer": 1, "canonical": ["CEO"], "patterns": ["^ceo"]}], "departments": [{"primary": "Lending", "keywords": ["loan"]}]}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.txt").write_text("no")
    dr = library.read_directory(spark, str(tmp_path))
    assert (dr.detection.count(), dr.canonical.count(), dr.keywords.count(), dr.pattern.count()) == (1, 1, 1, 1)
    g = spark.createDataFrame([(1, "G3", "Senior Vice President (SVP)"), (2, "g 4", "x"), (3, "G4", "VP / Head, Chief"), (4, "G9", "svp"), (5, None, "y")], "ord long, grade string, title string")
    assert {r.title: r.grade for r in library.grades_of_book(g).collect()} == {"senior vice president": 3, "svp": 3, "vp": 4, "head": 4, "chief": 4}
    assert library.from_request(spark, [{"a": 1, "z": 2}, {}], "a long, b string").collect() == [(1, None), (None, None)]
    p = spark.createDataFrame([("f", i, "x" * 10_000, i) for i in range(6)], "firm string, rank int, text string, n_people int")
    assert library.within_budget(p).count() == 3 and library.first_page_with_people(p).first().rank == 2
    n = spark.createDataFrame([("a", "person", "x", 1, "s", False, 1), ("a", "person", "y", 1, "s", False, 2)], "node_id string, node_type string, label string, layer int, sector string, is_ghost boolean, ord int")
    e = spark.createDataFrame([("a", "a"), ("a", "a"), ("a", "gone")], "parent_id string, child_id string")
    readers.write_graph(n, e, str(tmp_path / "g"), "one", "ord")
    nodes, edges = readers.read_graph(spark, str(tmp_path / "g"), "one")
    assert [r.label for r in nodes.collect()] == ["y"] and edges.count() == 1
    assert not library.dataset_exists(spark, str(tmp_path / "g"), "one") and not library.dataset_exists(spark, str(tmp_path / "none"), "one")


def test_reports(spark):
    p = spark.createDataFrame([("a", "Ana", "CEO", "F", 1, "x", 1), ("b", "Bo", None, "F", 2, "x", 2)], "id string, name string, title string, function string, level int, region string, ord long")
    up = spark.createDataFrame([("a", None), ("b", "a")], "id string, parent_id string")
    assert {r.id: r.chain for r in reports.chains(p, up).collect()} == {"a": "CEO", "b": "Ana (CEO) > "}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    assert reports.chains(p, loop, 3).count() == 2
    j = {r.id: json.loads(r.json) for r in reports.canonical_json(p, up).collect()}
    assert j["a"]["direct_reports_ids"] == ["b"] and j["b"]["direct_reports_ids"] == []
    r = spark.createDataFrame([("left", "F", "A", 1, 1), ("moved", "F", "A", 2, 1)], "type string, companyName string, personName string, id long, received_at long")
    assert reports.last_change(r).first().type == "moved" and reports.change_counts(r).count() == 2
    n = spark.createDataFrame([(i, f"Ana {i}", "s") for i in range(20)], "nth int, label string, sector string")
    assert reports.client_search(n, "an").count() == 8 and reports.client_search(n, "a").count() == 0


def test_small_functions(spark, tmp_path):
    from rankloom.functions import misc

    df = spark.createDataFrame([("#3491E8", "a"), ("FFFFFF", None), ("#12", "c"), (None, None)], "c string, x string")
    got = [tuple(r) for r in df.select(misc.rgb("c").alias("r"), misc.luminance("c")).collect()]
    assert tuple(got[0][0]) == (0x34, 0x91, 0xE8) and got[1][1] == 1.0 and got[2] == (None, None) and got[3] == (None, None)
    packed = df.select(misc.pack_metadata("c", "x").alias("m")).select(misc.unpack_metadata("m", "x string, other int").alias("u")).select("u.*").collect()
    assert [tuple(r) for r in packed] == [("a", None), (None, None), ("c", None), (None, None)]
    assert df.select(misc.unpack_metadata(F.lit("{broken"), "x string").alias("u")).first().u is None or df.select(misc.unpack_metadata(F.lit("{broken"), "x string").alias("u")).first().u.x is None
    assert spark.range(1).select(misc.utc_stamp(F.lit("2024-01-02 03:04:05").cast("timestamp"))).first()[0] == "2024-01-02T03:04:05Z"
    v = library.map_headers(spark.createDataFrame([("a", "b", "c", "d")], "`Full Name` string, name string, `JOB TITLE` string, odd string"))
    assert v.columns == ["name", "title", "odd"] and v.first()[0] == "a"
    spark.range(1).createOrReplaceTempView("gone")
    library.reset(spark)
    assert not [t for t in spark.catalog.listTables() if t.name == "gone"]
    f = tmp_path / "demo.json"
    f.write_text(json.dumps([{"FirstName": "Ana", "Designation": "CEO"}]))
    assert library.load_demo(spark, str(f)).count() == 1
    w = reports.wire_nodes(spark.createDataFrame([("1", None, "Ana", "x")], "id string, label string, name string, layer string")).first()
    assert (w.node_id, w.label, w.layer) == ("1", "Ana", 10)
