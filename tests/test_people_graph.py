import pytest
from pyspark.sql import functions as F

from rankloom.operators import graph, layout, ledger, people, taxonomy

SCHEMA = "row_id long, FirstName string, LastName string, Designation string, Company string, LinkedInURL string, Location string, Industry_Hint string, id string, layer string"


def test_layers(spark):
    want = {
        "SVP Global Supply Chain": 3, "Vice President, EV Engineering": 4, "Senior Director, PowerTrain Systems": 5, "Deputy General Manager": 4, "Associate Director": 6, "GM - India": 4, "DGM, North": 10,
        "MD, APAC": 2, "VP": 4, "CEO": 1, "VP – CTO Office": 4, "": 10, "Chairman": 0, "Analyst": 10, "Team Lead": 7,
    }
    df = spark.createDataFrame(list(want.items()), "t string, n int")
    got = {r.t: r.l for r in df.select("t", people.layer(F.col("t")).alias("l")).collect()}
    assert got == want
    fin = {r.t: r.l for r in spark.createDataFrame([("MD, APAC",), ("VP",)], "t string").select("t", people.layer(F.col("t"), True).alias("l")).collect()}
    assert fin == {"MD, APAC": 3, "VP": 6}


def test_normalise_fan_out_and_filters(spark):
    rows = [
        (1, " Ana ", "Krol", "CEO and CHRO", "Olix AI", None, "Cork, Ireland", None, "", ""), (2, None, "nan", None, None, None, None, None, "", ""), (3, "Bo", None, "Former CEO", "x", None, " / ", None, "", ""),
        (4, "Cy", "D", "Head of Sales and Marketing at Olix", "x", None, "Romania", None, "", ""), (5, "E", "F", "sales", "", "", "", "", "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    p = people.normalize(df)
    assert {r.id: r.full_name for r in p.collect()} == {"p1": "Ana Krol", "p2": "Unknown", "p3": "Bo", "p4": "Cy D", "p5": "E F"}
    cur = people.current(p)
    assert {r.id for r in cur.collect()} == {"p1", "p4", "p5"}
    assert sorted((r.id, r.part, r.designation) for r in people.fan_out(cur).collect()) == [("p1", 1, "CEO"), ("p1", 2, "CHRO"), ("p4", 1, "Head of Sales and Marketing"), ("p5", 1, "sales")]
    c = {r.id: r for r in people.classify(cur).collect()}
    assert (c["p5"].dept_primary, c["p5"].layer) == ("Sales & Business Development", 10) and c["p1"].region == "Europe" and c["p4"].region == "Europe" and c["p1"].sector == "Technology"
    assert people.classify(people.current(people.normalize(df.limit(0)))).count() == 0


def test_headers(spark):
    df = spark.createDataFrame([("a", "b", "c")], "`First Name` string, Title string, Position string")
    assert people.canonical_headers(df).columns == ["FirstName", "Designation"]
    assert people.coverage(df) == {"name": True, "title": True, "company": False, "location": False, "linkedin": False}


@pytest.fixture(scope="module")
def org(spark):
    titles = ["CEO", "Vice President, Payroll", "Director of Payroll", "Manager, Payroll", "Manager, Payroll", "Grid Planning Analyst", "Independent Director", "Australia CEO"]
    rows = [(i, f"P{i}", "X", t, "Olix", None, "", "", "", "") for i, t in enumerate(titles)]
    placed = people.place(people.classify(people.normalize(spark.createDataFrame(rows, SCHEMA)))).withColumn("ord", F.substring("id", 2, 9).cast("long")).cache()
    nodes, edges = graph.build(placed)
    return placed, nodes.cache(), edges.cache()


def test_graph_holds_together(org):
    placed, nodes, edges = org
    d = graph.depths(nodes, edges)
    assert d.count() == nodes.count()  # everything hangs under the root
    assert graph.repair(nodes, edges).exceptAll(edges).count() == 0 and edges.exceptAll(graph.repair(nodes, edges)).count() == 0
    parents = {r.child_id: r.parent_id for r in edges.collect()}
    layers = {r.node_id: r.layer for r in nodes.collect()}
    assert parents["p0"] == "dept__executive_management" and parents["p2"].startswith("ghost") is True and layers[parents["p3"]] == layers[parents["p4"]] == 7
    assert layers["p7"] == 2 and layers["p6"] == 3
    chain = {r.node_id: r.chain for r in graph.reporting_chain(nodes, edges).collect()}
    assert chain["p3"].endswith("P2 X") and chain["p0"] == ""
    s = graph.stats(nodes, edges).first()
    assert s.total_people == 8 and s.total_edges == nodes.count() - 1


def test_cycles_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c")], "parent_id string, child_id string")
    got = sorted((r.node_id, r.depth) for r in graph.descend(edges, spark.createDataFrame([("a",)], "node_id string")).collect())
    assert got == [("a", 0), ("b", 1), ("c", 1)]


def test_search_wildcards(org):
    _, nodes, _ = org
    assert graph.search(nodes, "p0").filter("node_id = 'p0'").count() == 1 and graph.search(nodes, "\\").count() == 0 and graph.search(nodes, "P_ X").filter("node_type = 'person'").count() == 8


def test_spread_and_promotion(spark):
    assert layout.spread(2, 5) == [(0, 2), (2, 5)]
    cols = "correction_id long, archetype string, region string, sub_industry string, original_title_native string, corrected_level int, corrected_function string, analyst_id string"
    rows = [(i, "a", "EU", None, " Chef ", 1, "HR", f"an{i % 3}") for i in range(20)] + [(100 + i, "a", "EU", None, "Boss", 1 + i % 2, "HR", "x") for i in range(20)] + [(200 + i, "a", "EU", None, "Few", 1, "HR", "x") for i in range(19)]
    c = spark.createDataFrame(rows, cols)
    o = spark.createDataFrame([("nobody", "EU", "a", None)], "title_raw string, region string, archetype_id string, sub_industry string")
    got = ledger.promotions(c, o).collect()
    assert [(r.title_l, r.corrections, r.n_analysts) for r in got] == [("chef", 20, 3)]
    assert [r.title_l for r in ledger.disagreements(c).collect()] == ["boss"]
    held = spark.createDataFrame([("CHEF", "EU", "a", "")], "title_raw string, region string, archetype_id string, sub_industry string")
    assert ledger.promotions(c, held).count() == 0


def test_vendor_and_parents(spark):
    cols = "id string, title string, vendor_function string, vendor_level string, vendor_persona string"
    r = spark.createDataFrame([("a", "Warehouse Lead", "Operations", "VP", None), ("b", "x", "engineering", None, "General Staff"), ("c", "Property head", "IT", "?", ""), ("d", None, None, None, None)], cols)
    got = {x.id: (x.v_function, x.v_level) for x in taxonomy.vendor_classes(r).collect()}
    assert got == {"a": ("Supply Chain", 3), "b": ("Engineering", 9), "c": ("Facilities, Real Estate & Workplace", None), "d": (None, None)}
    p = spark.createDataFrame([("x", "HR", 2, "Global", 1), ("y", "HR", 3, "EU", 2), ("z", "HR", 5, "EU", 3), ("w", "HR", 5, "US", 4), ("v", "IT", 5, "EU", 5), ("u", "HR", 1, "EU", 6)], "id string, function string, level int, region string, ord int")
    assert {x.id: x.parent_id for x in taxonomy.find_parents(p).collect()} == {"x": "u", "y": "u", "z": "y", "w": "x", "v": None, "u": None}
