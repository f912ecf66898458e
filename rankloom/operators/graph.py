"""The organisation as nodes and edges, and queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions import rules as R
from rankloom.session import cut

ROOT = "root_global"
NODE = ("node_id", "node_type", "label", "layer", "sector", "is_ghost")
START = 4  #: first layer below the department tree


def node_id(*parts: Column) -> Column:
    """Parts in lower case, anything but letters, digits and ``_`` replaced, joined by ``__``; empty parts are left out."""
    clean = [F.when(F.coalesce(p, F.lit("")) != "", F.regexp_replace(F.lower(F.trim(p)), "[^a-z0-9_]", "_")) for p in parts]
    return F.concat_ws("__", *clean)


def leaves(placed: DataFrame) -> DataFrame:
    """``placed`` with ``leaf``: the node of its department or sub-department."""
    return placed.withColumn("leaf", F.when(F.col("sub_dept") == "", node_id(F.lit("dept"), F.col("dept"))).otherwise(node_id(F.lit("dept"), F.col("dept"), F.col("sub_dept"))))


def chains(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ghost chains between departments and people below layer 4.

    Returns people's parents (``id, parent``) and ghosts (``node_id, parent, layer, sector``). Layer by layer, a chain of
    people of one leaf and raw department is extended by the first real person of that layer under its end, or else by
    a ghost if anyone deeper needs one. People of a layer are all placed before the next layer looks at them.

    The steps run on one row per chain, which holds the first real person of each layer: people themselves are
    aggregated once and joined once. Chains that share an end meet in a window over it.
    """
    p = leaves(placed.select("id", "ord", "dept", "sub_dept", "at_layer", "designation", "sector", "dept_primary", "dept_secondary")).withColumn("rp", F.col("dept_primary")).withColumn("rs", F.col("dept_secondary"))
    key = ["leaf", "rp", "rs"]
    real = ~F.coalesce(F.lower("designation").rlike(R.STAFF_TITLES), F.lit(False))
    steps = range(START, 10)
    deeper = F.when(F.col("at_layer") > START, F.struct("at_layer", "ord"))
    c = p.filter(F.col("at_layer") >= START).groupBy(*key).agg(F.max("at_layer").alias("deepest"), F.min_by("sector", deeper).alias("sector"), *[F.min(F.when((F.col("at_layer") == n) & real, F.struct("ord", "id"))).alias(f"f{n}") for n in steps]).withColumn(f"e{START}", F.col("leaf"))
    for n in steps:
        goes_on = F.col("deepest") > n
        first = F.min(f"f{n}").over(Window.partitionBy(f"e{n}"))["id"]
        ghost = node_id(F.lit("ghost"), F.col("leaf"), F.col("rp"), F.col("rs"), F.lit(str(n)))
        c = c.withColumn("r_", first).withColumn(f"g{n}", F.when(goes_on & F.col("r_").isNull(), ghost)).withColumn(f"e{n + 1}", F.when(goes_on, F.coalesce("r_", f"g{n}"))).drop("r_")
    c = cut(c.select(*key, "sector", *[f"g{n}" for n in steps], *[f"e{n}" for n in range(START, 11)]))
    end = F.get(F.array(*[F.col(f"e{n}") for n in range(START, 11)]), F.col("at_layer") - START)
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key]
    parents = p.alias("p").join(c.alias("c"), same[0] & same[1] & same[2], "left").select("p.id", F.when(F.col("at_layer") <= START, F.col("p.leaf")).otherwise(end).alias("parent"))
    made = F.array_compact(F.array(*[F.when(F.col(f"g{n}").isNotNull(), F.struct(F.col(f"g{n}").alias("node_id"), F.col(f"e{n}").alias("parent"), F.lit(n).alias("layer"))) for n in steps]))
    return parents, c.select("sector", F.explode(made).alias("g")).select("g.node_id", "g.parent", "g.layer", "sector")


def build(placed: DataFrame, label: str = "Organization") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of placed people (with ``ord``: their order of entry), a table that is cheap to read again. Board and executive panels hang under the
    root, other departments under the executive panel if there is one. Of people with one id the first gives the node."""
    spark = placed.sparkSession
    p = leaves(placed)
    has_em = F.lit(bool(placed.filter(F.col("dept") == "Executive Management").limit(1).count()))
    depts = p.select("dept").distinct()
    subs = p.filter("sub_dept <> ''").select("dept", "sub_dept").distinct()
    parents, ghosts = chains(placed)
    string = lambda c: F.lit(c).cast("string")
    root = spark.range(1).select(string(ROOT).alias("node_id"), string("global").alias("node_type"), string(label).alias("label"), F.lit(-1).alias("layer"), string("All").alias("sector"), F.lit(False).alias("is_ghost"))
    dn = depts.select(node_id(F.lit("dept"), F.col("dept")).alias("node_id"), string("dept_primary").alias("node_type"), F.col("dept").alias("label"), F.lit(1).alias("layer"), string("").alias("sector"), F.lit(False).alias("is_ghost"))
    sn = subs.select(node_id(F.lit("dept"), F.col("dept"), F.col("sub_dept")).alias("node_id"), string("dept_secondary").alias("node_type"), F.col("sub_dept").alias("label"), F.lit(2).alias("layer"), string("").alias("sector"), F.lit(False).alias("is_ghost"))
    pn = p.groupBy("id").agg(F.min_by(F.struct(F.col("full_name").alias("label"), F.col("at_layer").alias("layer"), "sector"), "ord").alias("v")).select(F.col("id").alias("node_id"), string("person").alias("node_type"), "v.label", "v.layer", "v.sector", F.lit(False).alias("is_ghost"))
    gn = ghosts.select("node_id", string("ghost").alias("node_type"), F.concat(R.GHOST_LABELS.column(F.col("layer")), F.lit(" ✦")).alias("label"), "layer", "sector", F.lit(True).alias("is_ghost"))
    nodes = root.unionByName(dn).unionByName(sn).unionByName(pn).unionByName(gn)
    apex = F.col("dept").isin("Board of Management", "Executive Management")
    de = depts.select(F.when(~apex & has_em, node_id(F.lit("dept"), F.lit("Executive Management"))).otherwise(F.lit(ROOT)).alias("parent_id"), node_id(F.lit("dept"), F.col("dept")).alias("child_id"))
    se = subs.select(node_id(F.lit("dept"), F.col("dept")).alias("parent_id"), node_id(F.lit("dept"), F.col("dept"), F.col("sub_dept")).alias("child_id"))
    pe = parents.select(F.col("parent").alias("parent_id"), F.col("id").alias("child_id"))
    ge = ghosts.select(F.col("parent").alias("parent_id"), F.col("node_id").alias("child_id"))
    return nodes, de.unionByName(se).unionByName(pe).unionByName(ge).distinct()


def repair(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with governance restored: panels under the root, other primary departments under the executive panel; a second repair changes nothing."""
    em = node_id(F.lit("dept"), F.lit("Executive Management"))
    dp = nodes.filter("node_type = 'dept_primary'").select(F.col("node_id").alias("child_id"), "label")
    has_em = F.lit(bool(dp.filter("label = 'Executive Management'").limit(1).count()))
    right = dp.select(F.when(F.col("label").isin("Board of Management", "Executive Management") | ~has_em, F.lit(ROOT)).otherwise(em).alias("parent_id"), "child_id")
    return edges.join(dp.select("child_id"), "child_id", "left_anti").select("parent_id", "child_id").unionByName(right).distinct()


def descend(edges: DataFrame, start: DataFrame, most: int = 20, until: Column | None = None) -> DataFrame:
    """``start_id, node_id, depth`` of all nodes below the rows of ``start`` (column ``node_id``), start included at depth 0,
    down to ``most`` levels; every node once per start, at its least depth. ``until``: nodes (a condition on ``node_id``) that aren't entered at all.

    Level by level; each level is written before the next, and a level without new nodes ends the walk, cycles included.
    """
    walls = (lambda df: df) if until is None else (lambda df: df.filter(~until))
    seen = level = cut(start.select(F.col("node_id").alias("start_id"), "node_id", F.lit(0).alias("depth")))
    for d in range(1, most + 1):
        nxt = level.join(edges.withColumnRenamed("parent_id", "node_id"), "node_id").select("start_id", F.col("child_id").alias("node_id")).distinct()
        level = cut(walls(nxt).join(seen.select("start_id", "node_id"), ["start_id", "node_id"], "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def headcount(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, headcount`` of each department: the people below it on paths that pass no other person."""
    people = nodes.filter("node_type = 'person'").select("node_id")
    depts = nodes.filter("node_type like 'dept%'").select("node_id")
    inner = edges.join(people.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_anti")
    below = descend(inner, depts)
    hits = below.join(people, "node_id", "left_semi").groupBy("start_id").agg(F.count(F.lit(1)).alias("headcount"))
    return depts.join(hits.withColumnRenamed("start_id", "node_id"), "node_id", "left").select("node_id", F.coalesce("headcount", F.lit(0)).alias("headcount"))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, depth`` below the root."""
    return descend(edges, nodes.filter(F.col("node_id") == ROOT).select("node_id")).select("node_id", "depth")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_nodes, total_edges, total_people, total_ghosts, max_depth."""
    n = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("node_type") == "person").alias("total_people"), F.count_if("is_ghost").alias("total_ghosts"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("total_edges"))).crossJoin(depths(nodes, edges).agg(F.max("depth").cast("long").alias("max_depth")))


def search(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose label, sector or type holds the text in any case; ``%`` and ``_`` are wildcards, a backslash is itself."""
    like = f"%{text.lower()}%".replace("\\", "\\\\")
    return nodes.filter(F.lower("label").like(like) | F.lower("sector").like(like) | F.lower("node_type").like(like))


def reporting_chain(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """``node_id, chain`` of each person: the labels of the people above, from the top, joined by `` > ``."""
    people = nodes.filter("node_type = 'person'").select("node_id", "label")
    up = edges.groupBy("child_id").agg(F.min("parent_id").alias("parent_id"))  # of several parents the first by id
    walk = cut(people.select("node_id", F.col("node_id").alias("at"), F.lit(0).alias("depth"), F.lit("").alias("chain")))
    done = None
    labels = people.select(F.col("node_id").alias("parent_id"), F.col("label").alias("above"))
    for _ in range(most):
        step = walk.join(up.withColumnRenamed("child_id", "at"), "at", "left")
        ended = step.filter("parent_id is null").select("node_id", "chain")
        done = ended if done is None else done.unionByName(ended)
        walk = cut(step.filter("parent_id is not null").join(labels, "parent_id", "left").select("node_id", F.col("parent_id").alias("at"), (F.col("depth") + 1).alias("depth"), F.when(F.col("above").isNull(), F.col("chain")).when(F.col("chain") == "", F.col("above")).otherwise(F.concat_ws(" > ", "above", "chain")).alias("chain")))
        if walk.isEmpty():
            break
    return done.unionByName(walk.select("node_id", "chain"))


def paged(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of at most 5,000 rows in order."""
    return df.orderBy(*order).offset(offset).limit(min(limit, 5_000))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of each group the first row in order."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn_ = 1").drop("rn_")
