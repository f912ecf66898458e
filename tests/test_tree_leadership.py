from pyspark.sql import functions as F

from rankloom.operators import graph, layout, leadership, tree
from rankloom.operators.ranks import numbered

N = "node_id string, node_type string, label string, layer int, is_ghost boolean"
E = "parent_id string, child_id string"


def chart(spark):
    nodes = [("r", "global", "Org", -1, False), ("d1", "dept_primary", "Marketing", 1, False), ("d2", "dept_primary", "Finance & Accounting", 1, False), ("s", "dept_secondary", "Tax", 2, False), ("g", "ghost", "Director ✦", 5, True), ("p1", "person", "Bo", 4, False), ("p2", "person", "Al", 4, False), ("p3", "person", "Cy", 6, False)]
    edges = [("r", "d1"), ("r", "d2"), ("d2", "s"), ("s", "p1"), ("d1", "p1"), ("d1", "p2"), ("d1", "g"), ("p1", "p3")]
    return spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)


def test_nested_tree_keeps_paths(spark):
    n, e = chart(spark)
    rows = tree.subtree(n, e, "r").collect()
    assert sorted("/".join(r.path) for r in rows if r.node_id == "p3") == ["r/d1/p1/p3", "r/d2/s/p1/p3"] and not any(r.has_more for r in rows)
    cut = {r.node_id: r.has_more for r in tree.subtree(n, e, "r", 1).collect()}
    assert cut == {"r": False, "d1": True, "d2": True}
    nested = tree.nest(rows)
    assert [c["node_id"] for c in nested["children"]] == ["d2", "d1"] and [c["node_id"] for c in nested["children"][1]["children"]] == ["p2", "p1", "g"]
    assert tree.nest([]) == {} and tree.subtree(n, e, "nobody").count() == 0
    loop = spark.createDataFrame([("r", "d1"), ("d1", "r")], E)
    assert tree.paths(loop, n.filter("node_id = 'r'").select("node_id"), 5).count() == 6


def test_department_tree(spark):
    n, e = chart(spark)
    got = {"/".join(r.path): (r.headcount, r.has_more) for r in tree.department_tree(n, e, "r").collect()}
    assert got == {"r": (3, False), "r/d1": (2, False), "r/d2": (1, False), "r/d2/s": (1, False), "r/d1/g": (0, False)}
    cut = {r.node_id: (r.headcount, r.has_more) for r in tree.department_tree(n, e, "r", 1).collect()}
    assert cut == {"r": (2, False), "d1": (2, False), "d2": (0, True)}
    assert [(r.node_id, r.nth) for r in tree.visit_order(n, e, "r").orderBy("nth").collect()] == [("d1", 0), ("d2", 1)]
    assert {tuple(r) for r in tree.people_under(n, e, n.filter("node_id = 'd2'").select("node_id")).collect()} == {("d2", "p1")}
    assert tree.merge_children(n, n.withColumn("label", F.lit("x")).unionByName(spark.createDataFrame([("new", "person", "N", 3, False)] * 2, N))).count() == 9


def test_panel_trees(spark):
    p = spark.createDataFrame([("b", "h1", 1, "A", "CEO"), ("b", "h2", 1, "B", "CFO")] + [("b", f"m{i}", 3, f"C{i}", "Clerk") for i in range(5)] + [("x", "z", None, "Z", None)], "panel string, id string, layer int, label string, title string")
    got = {r.id: (r.parent_id, r.skipped) for r in tree.layer_tree(p).collect()}
    assert got == {"h1": (None, False), "h2": (None, False), "m0": ("h1", True), "m1": ("h1", True), "m2": ("h1", True), "m3": ("h2", True), "m4": ("h2", True), "z": (None, False)}
    led = {r.id: r.parent_id for r in tree.executive_tree(p).collect()}
    assert led["h1"] is None and led["h2"] == "h1" and led["m4"] == "h2" and led["z"] is None
    flat = {r.id: r.parent_id for r in tree.executive_tree(p.withColumn("title", F.lit("Clerk"))).collect()}
    assert set(flat.values()) == {None}
    board = {r.id: r.parent_id for r in tree.board_tree(p.withColumn("layer", F.when(F.col("id") == "h2", 0).otherwise(F.col("layer")))).collect()}
    assert board["h1"] == "h2" and board["h2"] is None and board["z"] is None
    assert tree.layer_tree(p.limit(0)).count() == tree.executive_tree(p.limit(0)).count() == 0


def test_numbers_of_a_hot_group(spark):
    df = spark.range(5_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), (5_000 - F.col("id")).alias("o"))
    got = numbered(df, ["k"], ["o"]).filter("k = 0").orderBy("j").collect()
    assert [r.j for r in got] == list(range(4_500)) and [r.o for r in got] == sorted(r.o for r in got) and got[0].m == 4_500
    heads, members = spark.range(2).select(F.lit("d").alias("dept"), F.col("id").cast("string").alias("id"), F.col("id").alias("ord")), spark.range(5).select(F.lit("d").alias("dept"), (F.col("id") + 10).cast("string").alias("id"), F.col("id").alias("ord"))
    assert sorted(tuple(r) for r in layout.spread_under(heads, members, "dept").collect()) == [("10", "0"), ("11", "0"), ("12", "1"), ("13", "1"), ("14", "1")]


L = "ord long, name string, title string, is_board boolean, linkedin_url string, region string"


def test_injection_and_upgrade(spark):
    leaders = spark.createDataFrame(
        [(1, "Ana Krol", "Chairman of the Board", True, None, "x"), (2, "Ana Krol", "CEO", False, None, "x"), (3, "Bo Lim", "CEO Australia", False, "u", "x"), (4, "Bo Lim", "CFO", False, None, "x"), (5, "Cy Da", "CTO", False, None, "x"), (6, "Single", "CTO", False, None, "x"), (7, None, "CTO", None, None, "x"), (8, "Di Ek", None, True, None, "x"), (9, "Ed Fu", "Vice Chair", True, None, "x")], L
    )
    people = spark.createDataFrame([(1, "Ana Krol", "old"), (2, "ana krol", "new"), (3, "Cy Da", "")], "ord long, full_name string, linkedin_url string")
    got = {(r.full_name, r.dept): (r.at_layer, r.linkedin_url) for r in leadership.injected(leaders, people).collect()}
    assert got == {("Ana Krol", leadership.BOARD): (0, "new"), ("Ana Krol", leadership.EXECUTIVE): (1, "new"), ("Bo Lim", leadership.EXECUTIVE): (2, "u"), ("Ed Fu", leadership.BOARD): (1, "")}
    nodes = spark.createDataFrame([("a", 2, "Bo Lim", "llm_leadership_ai", ""), ("b", 1, "Bo Lim", "llm_leadership_ai", ""), ("c", 3, "Cy Da", "csv", "")], "id string, ord long, full_name string, method string, linkedin_url string")
    assert {r.id: (r.method, r.linkedin_url) for r in leadership.upgraded(nodes, leaders).collect()} == {"a": ("llm_leadership_ai", ""), "b": ("llm_leadership_web", "u"), "c": ("csv", "")}
    assert leadership.injected(leaders.limit(0), people).count() == 0


def test_purge_promotion_and_branches(spark):
    nodes = spark.createDataFrame([("e", "dept_primary", leadership.EXECUTIVE, ""), ("o", "dept_primary", "Operations", ""), ("w", "person", leadership.BOARD, "llm_leadership_web"), ("c1", "person", leadership.EXECUTIVE, "csv"), ("c2", "person", leadership.EXECUTIVE, None)], "node_id string, node_type string, dept string, method string")
    edges = spark.createDataFrame([("e", "c1"), ("e", "c2"), ("o", "c2"), ("e", "w")], E)
    n, e = leadership.purge(nodes, edges)
    assert {r.node_id for r in n.collect()} == {"e", "o", "w", "c2"} and {tuple(r) for r in e.collect()} == {("o", "c2"), ("e", "w")}
    same = leadership.purge(nodes.filter("node_id <> 'w'"), edges)
    assert same[1].count() == 4
    P = "id string, ord long, full_name string, designation string, layer int, dept_primary string"
    people = spark.createDataFrame([("1", 1, "Ana Krol", "CEO", 1, "Executive Management"), ("2", 2, "Bo Lim", "Head of Sales", 4, "Sales"), ("3", 3, "Cy Da", "Sales Clerk", 10, "Sales"), ("4", 4, "Di Ek", "Independent Director", 0, "Board of Management"), ("5", 5, "", "Chairman", 0, "Board"), ("6", 6, "Ed Fu", "Chairman", 0, "Board"), ("7", 7, "Ed Fu", "Poet", 10, "Poems")], P)
    got = {(r.id, r.dept): r.at_layer for r in leadership.promoted(people).collect()}
    assert got == {("6", leadership.BOARD): 0, ("4", leadership.BOARD): 1, ("1", leadership.EXECUTIVE): 1, ("2", leadership.EXECUTIVE): 4, ("7", leadership.EXECUTIVE): 4}
    assert {r.dept for r in leadership.promoted(people, have_board=people.select("full_name")).collect()} == {leadership.EXECUTIVE}
    assert leadership.promoted(people.limit(0)).count() == 0
    top = {r.name: (r.level, r.reports_to) for r in leadership.chief_first(spark.createDataFrame([(1, "A", "CFO", False), (2, "B", "President", False), (3, "C", "Chair", True), (4, "B", "Poet", None)], "ord long, name string, title string, is_board boolean"), "f").collect()}
    assert top == {"B": (1, None), "A": (2, "L2"), "C": (1, None)}
    nobody = leadership.chief_first(spark.createDataFrame([], "ord long, name string, title string, is_board boolean"), "f").collect()
    assert [(r.id, r.level) for r in nobody] == [("L_root", 1)]


def test_enrichment(spark):
    P = "id string, ord long, full_name string, designation string, layer int, dept_primary string, linkedin_url string"
    people = spark.createDataFrame([("1", 1, "Ana Krol", "CEO", 1, "Executive Management", ""), ("2", 2, "Di Ek", "Chairman", 0, "Board", "")], P)
    board = spark.createDataFrame([(1, "Bo Lim", "Chairman", True)], "ord long, name string, title string, is_board boolean")
    got = {(r.full_name, r.dept, r.method) for r in leadership.enrich(people, board).collect()}
    assert got == {("Bo Lim", leadership.BOARD, "llm_leadership_web"), ("Ana Krol", leadership.EXECUTIVE, leadership.UPLOADED)}
    assert leadership.enrich(people.limit(0), board.limit(0)).count() == 0


def test_ghost_chains_in_one_plan(spark):
    P = "id string, ord long, dept string, sub_dept string, at_layer int, designation string, sector string, dept_primary string, dept_secondary string"
    rows = [("a", 1, "Sales", "", 4, "Head", "s", "Sales", ""), ("b", 2, "Sales", "", 7, "Manager", "s", "Sales", ""), ("c", 3, "Sales", "", 10, "Clerk", "s", "Sales", ""), ("d", 4, "Ops", "", 6, "Director", "s", "Ops", ""), ("e", 5, "Ops", "", 4, "Chief of Staff", "s", "Ops", ""), ("f", 6, "Ops", "", 2, "EVP", "s", "Ops", "")]
    parents, ghosts = graph.chains(spark.createDataFrame(rows, P))
    got = {r.id: r.parent for r in parents.collect()}
    g = {r.node_id: (r.parent, r.layer) for r in ghosts.collect()}
    assert got["a"] == "dept__sales" and got["b"].endswith("__6") and got["c"].endswith("__9") and got["f"] == "dept__ops" and got["d"].endswith("__5")
    assert g[got["b"]][0].endswith("__5") and [v for k, v in g.items() if k.endswith("sales__5")] == [("a", 5)] and len(g) == 6
