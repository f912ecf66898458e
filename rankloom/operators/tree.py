"""Nested trees as rows: paths with sibling order, cuts at a depth, department trees with headcounts, and the trees of the panels.

A tree is a row per path: the same node under two parents is two rows, as a nested answer shows it twice. Levels
are joined one after another down to ``most``, which also ends walks of cyclic data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.people import exec_flags
from rankloom.operators.ranks import numbered
from rankloom.session import cut

MOST_DEPTH = 20
DEPARTMENTS = ("dept_primary", "dept_secondary", "dept_tertiary")
#: Places of primary departments among their siblings (fixed values); others stand at 50.
DEPARTMENT_ORDER = {
    "board of management": 0, "board of directors": 0, "board": 0, "executive management": 1, "c-suite": 1, "finance & accounting": 10, "human resources": 11, "people & culture": 11, "legal & compliance": 12, "risk management": 13, "engineering / it": 14, "product management": 17, "strategy": 18, "corporate development": 19,
    "operations": 20, "manufacturing": 21, "supply chain": 22, "procurement": 23, "sales": 24, "marketing": 25, "customer success": 26, "sustainability": 30, "research & development": 32, "actuarial": 35, "underwriting": 36, "claims": 37, "investment management": 38,
}


def sibling_order(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``place`` and ``place_label``: departments by their table, people by layer, ghosts late, then by label."""
    label = F.regexp_replace(F.lower(F.translate("label", "İ", "I")), " *✦$", "")
    table = F.create_map(*[F.lit(x) for kv in DEPARTMENT_ORDER.items() for x in kv])
    place = (
        F.when(F.coalesce("is_ghost", F.lit(False)), 900)
        .when(F.col("node_type") == "dept_primary", F.coalesce(F.try_element_at(table, label), F.lit(50)))
        .when(F.col("node_type").isin("dept_secondary", "dept_tertiary"), 50)
        .when(F.col("node_type") == "person", F.lit(100) + F.coalesce("layer", F.lit(99)))
        .otherwise(500)
    )
    return nodes.withColumn("place", place).withColumn("place_label", label)


def paths(edges: DataFrame, start: DataFrame, most: int = MOST_DEPTH, beyond: Column | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """``path`` (ids from the start on), ``node_id``, ``depth`` of every path down from the rows of ``start`` (``node_id``), down to ``most``.

    ``beyond`` (with ``nodes``, whose columns it reads): nodes below which no path goes. Paths aren't merged.
    """
    level = cut(start.select(F.array("node_id").alias("path"), "node_id", F.lit(0).alias("depth")))
    out = level
    stop = None if beyond is None else nodes.filter(beyond).select("node_id")
    for d in range(1, most + 1):
        at = level if stop is None else level.join(stop, "node_id", "left_anti")
        level = cut(at.join(edges.select(F.col("parent_id").alias("node_id"), "child_id"), "node_id").select(F.concat("path", F.array("child_id")).alias("path"), F.col("child_id").alias("node_id"), F.lit(d).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def subtree(nodes: DataFrame, edges: DataFrame, root: str, most: int = MOST_DEPTH) -> DataFrame:
    """Rows of the nested tree below ``root``: ``path, node_id, parent_id, depth, place, place_label, has_more``; ``has_more`` only at the cut, if there are children."""
    start = nodes.filter(F.col("node_id") == root).select("node_id")
    p = paths(edges, start, most)
    parents = edges.select(F.col("parent_id").alias("node_id")).distinct().withColumn("kids", F.lit(True))
    return (
        p.join(sibling_order(nodes).select("node_id", "place", "place_label"), "node_id", "left").join(parents, "node_id", "left")
        .select("path", "node_id", F.try_element_at("path", F.lit(-2)).alias("parent_id"), "depth", "place", "place_label", ((F.col("depth") == most) & F.coalesce("kids", F.lit(False))).alias("has_more"))
    )


def department_tree(nodes: DataFrame, edges: DataFrame, root: str, most: int = MOST_DEPTH) -> DataFrame:
    """The tree without people: ``path, node_id, depth, headcount, has_more``.

    People are counted at every path above them, and nobody below a person. At the cut only a node's own people are
    counted, and ``has_more`` says whether departments follow.
    """
    start = nodes.filter(F.col("node_id") == root).select("node_id")
    person = F.col("node_type") == "person"
    walk = paths(edges, start, most + 1, person, nodes).join(nodes.select("node_id", "node_type"), "node_id")
    shown = walk.filter(~person & (F.col("depth") <= most))
    heads = walk.filter(person).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.slice("path", F.lit(1), i))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("headcount"))
    more = walk.filter((F.col("depth") == most + 1) & F.col("node_type").isin("global", *DEPARTMENTS)).select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct().withColumn("has_more", F.lit(True))
    return shown.join(heads, "path", "left").join(more, "path", "left").select("path", "node_id", "depth", F.coalesce("headcount", F.lit(0)).alias("headcount"), F.coalesce("has_more", F.lit(False)).alias("has_more"))


def nest(rows: Iterable) -> dict:
    """One nested answer from the collected rows of ``subtree``: a page of the service, bounded by its depth and root."""
    made: dict = {}
    root = None
    for r in sorted(rows, key=lambda r: (r["depth"], r["place"] if r["place"] is not None else 999, r["place_label"] or "", r["node_id"])):
        path = tuple(r["path"])
        made[path] = {"node_id": r["node_id"], "children": [], **({"has_more": True} if r["has_more"] else {})}
        if len(path) == 1:
            root = made[path]
        else:
            made[path[:-1]]["children"].append(made[path])
    return root or {}


def department_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of departments and the root, with ``has_more``: whether anything hangs below."""
    below = edges.select(F.col("parent_id").alias("node_id")).distinct().withColumn("b_", F.lit(True))
    return nodes.filter(F.col("node_type").isin("global", *DEPARTMENTS)).join(below, "node_id", "left").select("node_id", "node_type", "label", F.coalesce("b_", F.lit(False)).alias("has_more"))


def merge_children(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Nodes with those of ``more`` whose ids aren't there yet, each id once."""
    return nodes.unionByName(more.join(nodes.select("node_id"), "node_id", "left_anti").dropDuplicates(["node_id"]))


def visible(edges: DataFrame, root: DataFrame, collapsed: DataFrame, most: int = MOST_DEPTH) -> DataFrame:
    """``node_id, depth`` of what a drawn tree shows when the nodes of ``collapsed`` are shut."""
    open_edges = edges.join(collapsed.select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti")
    return paths(open_edges, root, most).groupBy("node_id").agg(F.min("depth").alias("depth"))


def visit_order(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """``node_id, depth, nth``: primary departments in the order a walk by breadth meets them, siblings in order of their ids;
    where there are none, any department right under the root."""
    p = paths(edges, nodes.filter(F.col("node_id") == root).select("node_id"), MOST_DEPTH, F.col("node_type") == "person", nodes)
    met = p.groupBy("node_id").agg(F.min(F.struct("depth", "path")).alias("o"))
    primary = met.join(nodes.filter(F.col("node_type") == "dept_primary").select("node_id"), "node_id", "left_semi")
    top = met.filter("o.depth = 1").join(nodes.filter(F.col("node_type").isin(*DEPARTMENTS)).select("node_id"), "node_id", "left_semi")
    chosen = primary.unionByName(top.join(primary.select(F.lit(1).alias("p_")).limit(1), F.lit(True), "left_anti"))
    return numbered(chosen.select(F.lit(0).alias("all_"), "node_id", F.col("o.depth").alias("depth"), F.col("o.path").alias("at")), ["all_"], ["depth", "at"], "nth", None).select("node_id", "depth", "nth")


def people_under(nodes: DataFrame, edges: DataFrame, start: DataFrame, stop_at_primary: bool = False) -> DataFrame:
    """``start_id, node_id`` of people reached below each start without passing a person (or, if asked, another primary department)."""
    wall = F.col("node_type") == "person"
    if stop_at_primary:
        wall = wall | (F.col("node_type") == "dept_primary")
    inner = edges
    if stop_at_primary:
        inner = edges.join(nodes.filter(F.col("node_type") == "dept_primary").select(F.col("node_id").alias("child_id")), "child_id", "left_anti")
    p = paths(inner, start, MOST_DEPTH, F.col("node_type") == "person", nodes).filter("depth > 0")
    return p.join(nodes.filter(F.col("node_type") == "person").select("node_id"), "node_id", "left_semi").select(F.col("path")[0].alias("start_id"), "node_id").distinct()


def layer_tree(people: DataFrame, panel: str = "panel") -> DataFrame:
    """``id, parent_id, rank, skipped``: of each panel the people of a layer spread in runs of equal length over those of the layer above.

    ``people``: panel, ``id, layer, label``. Runs are as long as the members divided by the heads, rounded up, so the first heads
    get more; ``skipped`` says that a layer is missing between. The top layer has no parent.
    """
    p = people.withColumn("layer", F.coalesce("layer", F.lit(99)))
    layers = p.select(panel, "layer").distinct()
    ranked = numbered(layers, [panel], ["layer"], "rank", None)
    n = numbered(p, [panel, "layer"], ["label", "id"]).join(ranked, [panel, "layer"])
    heads = n.select(panel, (F.col("rank") + 1).alias("rank"), F.col("j").alias("i"), F.col("id").alias("parent_id"))
    above = n.select(panel, (F.col("rank") + 1).alias("rank"), F.col("layer").alias("layer_above"), F.col("m").alias("n_heads")).distinct()
    j = n.join(above, [panel, "rank"], "left").withColumn("i", F.floor(F.col("j") / F.ceil(F.col("m") / F.col("n_heads"))))
    return j.join(heads, [panel, "rank", "i"], "left").select(panel, "id", "parent_id", "rank", F.coalesce(F.col("layer") - F.col("layer_above") > 1, F.lit(False)).alias("skipped"))


def board_tree(people: DataFrame, panel: str = "panel") -> DataFrame:
    """``id, parent_id``: everybody under the first chair (layer 0); other chairs beside; without a chair all flat."""
    chair = people.filter("layer = 0").groupBy(panel).agg(F.min_by("id", F.struct("label", "id")).alias("chair"))
    return people.join(chair, panel, "left").select(panel, "id", F.when(F.coalesce("layer", F.lit(99)) != 0, F.col("chair")).alias("parent_id"))


def executive_tree(people: DataFrame, panel: str = "panel") -> DataFrame:
    """``id, parent_id``: with several people in the top layer, the first chief executive among them heads the panel (all flat if
    there is none) and the rest forms a layer tree below; with one, the layer tree of all. ``people`` also needs ``title``."""
    p = people.withColumn("layer", F.coalesce("layer", F.lit(99)))
    tops = p.groupBy(panel).agg(F.min("layer").alias("top"))
    j = p.join(tops, panel)
    first = F.col("layer") == F.col("top")
    facts = j.filter(first).groupBy(panel).agg(F.count(F.lit(1)).alias("n_top"), F.min_by("id", F.when(exec_flags(F.col("title"))["is_ceo"], F.struct("label", "id"))).alias("ceo"))
    # min_by ignores rows whose order is null only if another is not: without any chief the result must be null
    chiefs = j.filter(first & exec_flags(F.col("title"))["is_ceo"]).select(panel).distinct().withColumn("led", F.lit(True))
    facts = facts.join(chiefs, panel, "left").withColumn("mode", F.when(F.col("n_top") <= 1, "layers").when(F.col("led"), "led").otherwise("flat"))
    j = p.join(facts.select(panel, "mode", "ceo"), panel)
    flat = j.filter("mode = 'flat'").select(panel, "id", F.lit(None).cast("string").alias("parent_id"))
    chief = j.filter("mode = 'led' and id = ceo").select(panel, "id", F.lit(None).cast("string").alias("parent_id"))
    rest = j.filter("mode = 'layers' or (mode = 'led' and id <> ceo)")
    below = layer_tree(rest.select(panel, "id", "layer", "label"), panel).join(facts.select(panel, "mode", "ceo"), panel)
    return flat.unionByName(chief).unionByName(below.select(panel, "id", F.coalesce("parent_id", F.when(F.col("mode") == "led", F.col("ceo"))).alias("parent_id")))
