"""Leaders from pages and filings beside uploaded people: injection, upgrade, purge and promotion of the two panels.

Everything meets on folded name keys or departments by equi-joins; per-group choices are aggregations with ``min_by``,
so no panel, however large, is sorted or collected in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions import titles
from rankloom.functions.text import missing_to_null, strip
from rankloom.functions.web import domain, name_key
from rankloom.operators.people import exec_flags
from rankloom.session import cut

BOARD, EXECUTIVE = "Board of Management", "Executive Management"
#: Ways a leader came into the chart from outside (fixed values).
WEB_METHODS = ("llm_leadership_web", "llm_leadership_ai", "llm_leadership_apify", "llm_leadership_knowledge")
UPLOADED = "uploaded_data"
#: Promoted board members at most: the panel's size is a feature.
MOST_BOARD = 20
BOARD_CHAIR = r"\b(?:chair(?:man|woman|person)?|board\s+chair)\b"
BOARD_SEAT = r"\bboard\s+(?:of\s+)?(?:directors?|management|trustees?|governors?|member)\b|\bnon[\s-]?exec(?:utive)?\s+director\b|\bindependent\s+(?:non[\s-]?executive\s+)?director\b|\b(?:outside|lead\s+independent)\s+director\b|\btrustee\b|\bgovernor\b"


def clean_leaders(leaders: DataFrame) -> DataFrame:
    """Leaders that have a title and a name of at least two words; ``key`` is the name's key, ``ord`` the order of entry."""
    n, t = missing_to_null("name"), missing_to_null("title")
    return leaders.withColumn("name", n).withColumn("title", t).filter("name is not null and title is not null").filter(F.size(F.split("name", r"\s+")) >= 2).withColumn("key", name_key("name")).filter("key <> ''")


def injected(leaders: DataFrame, people: DataFrame, method: str = "llm_leadership_web", region: str = "Global HQ") -> DataFrame:
    """Leaders as persons of the panels.

    ``leaders``: ``ord, name, title, is_board`` and, if there is one, ``linkedin_url``. ``people``: those already in the
    chart, ``ord, full_name, linkedin_url``. Board: chair at layer 0, vice and committee chairs at 1, others at 2.
    Executives: regional ones at 2, others at 1. A name joins a panel once, the first entry standing; a name the chart already
    has is left out unless it is on both lists. A missing LinkedIn address is taken from the last upload of that name.
    """
    c = clean_leaders(leaders)
    if "linkedin_url" not in c.columns:
        c = c.withColumn("linkedin_url", F.lit(None).cast("string"))
    f = exec_flags(F.col("title"))
    board = F.coalesce("is_board", F.lit(False))
    layer = F.when(board, F.when(f["is_chairman"], 0).when(f["is_vice_chair"] | f["is_committee_chair"], 1).otherwise(2)).when(f["is_regional"], 2).otherwise(1)
    seats = c.groupBy("key", board.alias("board")).agg(F.min_by(F.struct("ord", "name", "title", "linkedin_url", layer.alias("layer"), F.when(board, f["board_sub_role"]).alias("board_sub_role"), F.when(board, F.lit(region)).otherwise(f["exec_region"]).alias("region")), "ord").alias("v"))
    lists = c.groupBy("key").agg((F.min(board) != F.max(board)).alias("dual"))
    known = people.withColumn("key", name_key("full_name")).filter("key <> ''").groupBy("key").agg(F.max_by("linkedin_url", F.when(F.col("linkedin_url") != "", F.col("ord"))).alias("uploaded_url"))
    return (
        seats.join(lists, "key").join(known.withColumn("known", F.lit(True)), "key", "left")
        .filter("dual or known is null")
        .select(
            F.concat(F.lit("lead_"), F.when(F.col("board"), "b").otherwise("e"), F.col("v.ord").cast("string")).alias("id"), F.col("v.name").alias("full_name"), F.col("v.title").alias("designation"), F.when(F.col("board"), BOARD).otherwise(EXECUTIVE).alias("dept"),
            F.col("v.layer").alias("at_layer"), F.col("v.board_sub_role").alias("board_sub_role"), F.col("v.region").alias("region"), F.coalesce(F.nullif("v.linkedin_url", F.lit("")), "uploaded_url", F.lit("")).alias("linkedin_url"), F.lit(method).alias("method"), F.lit(0.9).alias("confidence"),
        )
    )


def upgraded(nodes: DataFrame, leaders: DataFrame) -> DataFrame:
    """``nodes`` (``id, ord, full_name, method, linkedin_url``) after web leaders confirm those known from a model alone: of
    each confirmed name the first such node becomes a web node and takes the leader's address if it gives one."""
    web = clean_leaders(leaders).groupBy("key").agg(F.min_by("linkedin_url", "ord").alias("web_url") if "linkedin_url" in leaders.columns else F.lit(None).cast("string").alias("web_url"))
    keyed = nodes.withColumn("key", name_key("full_name"))
    first = keyed.filter("method = 'llm_leadership_ai'").groupBy("key").agg(F.min_by("id", "ord").alias("id")).join(web, "key").select("id", "web_url", F.lit(True).alias("hit"))
    return nodes.join(first, "id", "left").withColumn("method", F.when(F.col("hit"), "llm_leadership_web").otherwise(F.col("method"))).withColumn("linkedin_url", F.when(F.col("hit") & (F.coalesce("web_url", F.lit("")) != ""), F.col("web_url")).otherwise(F.col("linkedin_url"))).drop("hit", "web_url")


def purge(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without uploaded people directly under a panel, where any panel has people from outside.

    ``nodes``: ``node_id, node_type, dept, method``. A person who then hangs nowhere goes; one with another parent stays.
    Without people from outside nothing changes.
    """
    panels = nodes.filter(F.col("node_type") == "dept_primary").filter(F.col("dept").isin(BOARD, EXECUTIVE)).select(F.col("node_id").alias("parent_id"))
    outside = nodes.filter((F.col("node_type") == "person") & F.col("dept").isin(BOARD, EXECUTIVE) & F.col("method").isin(*WEB_METHODS)).limit(1).select(F.lit(True).alias("any_"))
    guests = nodes.filter(F.col("node_type") == "person").filter(~F.coalesce(F.col("method"), F.lit("")).isin(*WEB_METHODS, UPLOADED)).select(F.col("node_id").alias("child_id"))
    cut_edges = edges.join(panels, "parent_id", "left_semi").join(guests, "child_id", "left_semi").crossJoin(outside).select("parent_id", "child_id")  # one row at most on the right
    kept = edges.join(cut_edges, ["parent_id", "child_id"], "left_anti").select("parent_id", "child_id")
    orphans = cut_edges.select("child_id").distinct().join(kept, "child_id", "left_anti").withColumnRenamed("child_id", "node_id")
    return nodes.join(orphans, "node_id", "left_anti"), kept


def promoted(people: DataFrame, have_board: DataFrame | None = None, have_executives: DataFrame | None = None) -> DataFrame:
    """Uploaded people put into panels that nobody from outside fills: ``id, full_name, designation, dept, at_layer, confidence, method``.

    ``people``: ``id, ord, full_name, designation, layer, dept_primary``. Board: one chair at layer 0, then people with a
    board seat in order of layer and name, independent ones at 1, others at 2, ``MOST_BOARD`` in all. Executives: the
    first chief executive at 1, then of each department its most senior person at 2 to 4; without a chief executive
    everybody of layer 0 to 2. A name joins a panel once. ``have_*``: people from outside (``full_name``); a panel
    that has any gets nobody.
    """
    p = people.select("id", "ord", "full_name", "designation", "layer", "dept_primary").withColumn("key", name_key("full_name")).filter((strip("full_name") != "") & (F.col("key") != ""))
    p = cut(p.withColumn("t", F.lower("designation")).withColumn("o", F.struct("layer", "full_name", "ord")))  # read six times
    free = lambda df, have: df if have is None else df.join(have.limit(1).select(F.lit(1).alias("h_")), F.lit(True), "left_anti")
    of_name = lambda df: df.groupBy("key").agg(F.min_by(F.struct("id", "ord", "full_name", "designation", "layer", "dept_primary", "t", "o", "rank"), F.struct("rank", "o")).alias("v")).select("key", "v.*")
    chair = F.col("t").rlike(BOARD_CHAIR) & ~F.col("t").rlike(r"\bcommittee\b")
    seat = F.col("t").rlike(BOARD_SEAT) | F.contains(F.lower("dept_primary"), F.lit("board"))
    first_chair = p.filter(chair).orderBy("o").limit(1).withColumn("rank", F.lit(0))
    board = of_name(first_chair.unionByName(p.filter(~chair & seat).withColumn("rank", F.lit(1)))).orderBy("rank", "o").limit(MOST_BOARD)
    board = board.select("id", "full_name", "designation", F.lit(BOARD).alias("dept"), F.when(F.col("rank") == 0, 0).when(F.contains("t", F.lit("independent")), 1).otherwise(2).alias("at_layer"))
    ceo = p.filter(exec_flags(F.col("designation"))["is_ceo"]).orderBy("o").limit(1)
    rest = p.join(ceo.select("id", "ord"), ["id", "ord"], "left_anti")
    heads = rest.filter(~F.lower(strip("dept_primary")).isin("", "executive management", "board of management", "board of directors", "board")).groupBy("dept_primary").agg(F.min_by(F.struct("id", "ord", "key", "full_name", "designation", "layer", "t", "o"), "o").alias("v")).select("v.*", "dept_primary")
    some = ceo.select(F.lit(1).alias("c_"))
    led = ceo.withColumn("rank", F.lit(0)).unionByName(heads.withColumn("rank", F.lit(1)).join(some, F.lit(True), "left_semi"))
    unled = p.filter("layer <= 2").withColumn("rank", F.lit(2)).join(some, F.lit(True), "left_anti")
    executives = of_name(led.unionByName(unled)).select("id", "full_name", "designation", F.lit(EXECUTIVE).alias("dept"), F.when(F.col("rank") == 0, 1).when(F.col("rank") == 1, F.least(F.greatest("layer", F.lit(2)), F.lit(4))).otherwise(F.col("layer")).alias("at_layer"))
    return free(board, have_board).unionByName(free(executives, have_executives)).withColumn("confidence", F.lit(0.7)).withColumn("method", F.lit(UPLOADED))


def enrich(people: DataFrame, leaders: DataFrame) -> DataFrame:
    """The step that follows an upload: leaders from outside in the panels, and uploaded people in a panel that nobody from outside
    fills. ``id, full_name, designation, dept, at_layer, method, confidence``."""
    cols = ("id", "full_name", "designation", "dept", "at_layer", "method", "confidence")
    got = cut(injected(leaders, people).select(*cols))
    of = lambda dept: got.filter(F.col("dept") == dept).select("full_name")
    return got.unionByName(promoted(people, of(BOARD), of(EXECUTIVE)).select(*cols))


def readiness(nodes: DataFrame) -> DataFrame:
    """One row: ``board, executives, ready``: people of the panels that came from outside or were promoted."""
    there = F.col("method").isin(*WEB_METHODS, UPLOADED)
    b = F.contains("dept", F.lit("Board"))
    return nodes.agg(F.count_if(there & b).alias("board"), F.count_if(there & ~b).alias("executives")).withColumn("ready", (F.col("board") > 0) | (F.col("executives") > 0))


def merged_people(first: DataFrame, second: DataFrame) -> DataFrame:
    """People of two sources (``name, title, ord``), a name (its first three words) once, the first source before the second;
    order them by ``layer, name``."""
    key = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}\s]", "")), r"\s+"), 1, 3), " ")
    both = first.select("name", "title", F.struct(F.lit(0).alias("s"), "ord").alias("o")).unionByName(second.select("name", "title", F.struct(F.lit(1).alias("s"), "ord").alias("o")))
    kept = both.withColumn("key", key).filter("key <> ''").groupBy("key").agg(F.min_by(F.struct("name", "title", F.col("o.s").alias("source")), "o").alias("v")).select("key", "v.*")
    return kept.withColumn("layer", titles.quick_layer("title"))


def chief_first(leaders: DataFrame, firm: str) -> DataFrame:
    """The authoritative top of a firm: ``id, name, title, function, level, reports_to``.

    The first non-board leader whose title names a chief executive is the root, else a synthetic one; other leaders
    report to the root at level 2, board members stand at level 1 without a manager; further rows of the chief's name go.
    """
    t = F.lower("title")
    chief = ~F.coalesce("is_board", F.lit(False)) & (t.rlike(r"ceo|chief executive|directeur général") | t.startswith("president") | F.contains("title", F.lit("代表取締役")))
    root = leaders.filter(F.coalesce(chief, F.lit(False))).orderBy("ord").limit(1).select(F.col("ord"), "name", "title")
    synthetic = leaders.sparkSession.createDataFrame([("(CEO not identified)", "CEO")], "name string, title string").select(F.lit(None).cast("long").alias("ord"), "name", "title").join(root.select(F.lit(1).alias("r_")), F.lit(True), "left_anti")
    top = root.unionByName(synthetic).select(F.coalesce(F.concat(F.lit("L"), F.col("ord").cast("string")), F.lit("L_root")).alias("id"), "name", "title")
    others = leaders.join(top.select("name"), "name", "left_anti").crossJoin(top.select(F.col("id").alias("root")))  # one row on the right
    b = F.coalesce("is_board", F.lit(False))
    return top.select("id", "name", "title", F.lit("Strategy").alias("function"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("reports_to")).unionByName(
        others.select(F.concat(F.lit("L"), F.col("ord").cast("string")).alias("id"), "name", "title", titles.leader_function("title").alias("function"), F.when(b, 1).otherwise(2).alias("level"), F.when(~b, F.col("root")).alias("reports_to"))
    )


def with_unassigned(people: DataFrame, parents: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Parents for everybody: who has none, or no function, hangs under a synthetic "<function> — Unassigned" node of the
    region. Returns the synthetic nodes (``id, name, function, region, level, parent_id``) and all parents (``id, parent_id``)."""
    j = people.join(parents, "id", "left").withColumn("lost", (F.col("function") == "Unclassified") | (F.col("level") >= 99))
    fn = F.when(F.col("lost"), "Unclassified").otherwise(F.col("function"))
    branch = F.concat(F.lit("unassigned__"), F.regexp_replace(F.lower(F.concat_ws("__", fn, "region")), "[^a-z0-9_]", "_"))
    needs = F.col("lost") | (F.col("parent_id").isNull() & (F.col("level") > 1))
    placed = j.withColumn("needs", needs).withColumn("fn", fn).withColumn("branch", branch)
    nodes = placed.filter("needs").select(F.col("branch").alias("id"), F.concat("fn", F.lit(" — Unassigned")).alias("name"), F.col("fn").alias("function"), "region", F.lit(2).alias("level"), F.lit(root).alias("parent_id")).distinct()
    return nodes, placed.select("id", F.when(F.col("needs"), F.col("branch")).otherwise(F.col("parent_id")).alias("parent_id"))


def companies(people: DataFrame) -> DataFrame:
    """``company, sector, region, n``: distinct firms with the context of their first person."""
    return people.filter(F.coalesce("company", F.lit("")) != "").groupBy("company").agg(F.min_by(F.struct("sector", "region"), "ord").alias("v"), F.count(F.lit(1)).alias("n")).select("company", "v.sector", "v.region", "n")


def insert_order(people: DataFrame) -> DataFrame:
    """``n``: number of each person, from 1, when people are entered by layer and then in the order they came.

    Counted per layer and partition of ids first, so that no task sorts everybody."""
    b = people.withColumn("b", F.floor(F.col("ord") / 10_000))
    before = b.groupBy("at_layer", "b").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("at_layer", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return b.join(before.select("at_layer", "b", "before"), ["at_layer", "b"]).withColumn("n", F.col("before") + F.row_number().over(Window.partitionBy("at_layer", "b").orderBy("ord"))).drop("b", "before")


def host_firm(url: Column | str) -> Column:
    """The label of a host that names the firm."""
    return F.coalesce(F.element_at(F.split(domain(url), r"\."), -2), F.lit(""))
