"""Exports and layouts of the chart: tables that a renderer only has to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions import rules as R
from rankloom.operators.ranks import numbered


def export(placed: DataFrame, deepest: int = 8) -> DataFrame:
    """People down to a layer, with category and seniority label; ``sort_key`` is the export's order: category, department, name."""
    cat = F.when(F.contains("dept", F.lit("Board")), "Board of Directors").when(F.contains("dept", F.lit("Executive")), "Executive Management").otherwise(F.when(F.col("dept") == "", "Other").otherwise(F.col("dept")))
    return placed.filter(F.col("at_layer") <= deepest).select(
        F.col("full_name").alias("name"), F.col("designation").alias("title"), cat.alias("category"), F.col("dept").alias("department"), R.SENIORITY_LABELS.column(F.col("at_layer")).alias("seniority"), "region", "location", "linkedin_url", F.lit("Uploaded Data").alias("source"), "id",
    )


def ordered_export(df: DataFrame) -> DataFrame:
    return df.orderBy(F.when(F.col("category") == "Board of Directors", 0).when(F.col("category") == "Executive Management", 1).otherwise(2), "department", "name", "id")


def histogram(placed: DataFrame) -> DataFrame:
    """People per layer, with the layer's label."""
    return placed.groupBy("at_layer").agg(F.count(F.lit(1)).alias("n")).select("at_layer", R.SENIORITY_LABELS.column(F.col("at_layer")).alias("label"), "n")


def columns_of_four(placed: DataFrame, per_column: int = 4, per_slide: int = 6) -> DataFrame:
    """``dept, sub_dept, id, col, row, slide``: each sub-department in columns of four, six columns to a slide; all numbers from 0.

    Members are numbered per department; to spare a department of any size one sort, they are first counted by layer and
    name, and only members of equal layer and name are sorted among themselves.
    """
    w = Window.partitionBy("dept", "sub_dept").orderBy("at_layer", "full_name").rowsBetween(Window.unboundedPreceding, -1)
    groups = placed.groupBy("dept", "sub_dept", "at_layer", "full_name").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    rn = F.row_number().over(Window.partitionBy("dept", "sub_dept", "at_layer", "full_name").orderBy("id")) - 1
    cols = placed.groupBy("dept", "sub_dept").agg(F.ceil(F.count(F.lit(1)) / per_column).alias("n_cols"))
    v = Window.partitionBy("dept").orderBy("sub_dept").rowsBetween(Window.unboundedPreceding, -1)
    base = cols.withColumn("first_col", F.coalesce(F.sum("n_cols").over(v), F.lit(0)))
    at = F.col("before") + F.col("rn")
    return (
        placed.select("dept", "sub_dept", "at_layer", "full_name", "id").withColumn("rn", rn)
        .join(groups.select("dept", "sub_dept", "at_layer", "full_name", "before"), ["dept", "sub_dept", "at_layer", "full_name"])
        .join(base.select("dept", "sub_dept", "first_col"), ["dept", "sub_dept"])
        .select("dept", "sub_dept", "id", (F.col("first_col") + F.floor(at / per_column)).cast("long").alias("col"), (at % per_column).cast("long").alias("row"))
        .withColumn("slide", F.floor(F.col("col") / per_slide).cast("long"))
    )


def slides(placed: DataFrame) -> DataFrame:
    """``columns_of_four`` with each department's head (``is_head``: its most senior person) and, for people of no sub-department
    where others of the department have one, ``is_orphan``: they fill columns of their own."""
    heads = placed.groupBy("dept").agg(F.min_by("id", F.struct("at_layer", "full_name", "id")).alias("head"), F.max((F.col("sub_dept") != "").cast("int")).alias("parted"))
    return columns_of_four(placed).join(heads, "dept").select("dept", "sub_dept", "id", "col", "row", "slide", (F.col("id") == F.col("head")).alias("is_head"), ((F.col("sub_dept") == "") & (F.col("parted") == 1)).alias("is_orphan"))


def panel_labels(people: DataFrame) -> DataFrame:
    """``people`` (``dept, at_layer, board_sub_role``) with the ``label`` of its layer in the panel and that of its board role."""
    board = F.contains("dept", F.lit("Board"))
    label = F.when(board, F.coalesce(R.BOARD_LABELS.column(F.col("at_layer")), R.PANEL_LABELS.column(F.col("at_layer")))).otherwise(R.PANEL_LABELS.column(F.col("at_layer")))
    return people.withColumn("label", label).withColumn("role_label", F.coalesce(R.BOARD_ROLE_LABELS.column(F.col("board_sub_role")), F.lit("")))


def spread(heads: int, members: int) -> list[tuple[int, int]]:
    """Which members go under which head: head i gets [i*m//n, (i+1)*m//n)."""
    return [(i * members // heads, (i + 1) * members // heads) for i in range(heads)]


def spread_under(heads: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """``id, head_id``: members of each ``key`` spread evenly over its heads, both in the order of ``ord``.

    Member ``j`` of ``m`` belongs to the head whose share ends first beyond it, which is computed, so that heads and members
    of a key meet one to one and not all with all.
    """
    h = numbered(heads, [key], ["ord"], "i", "n")
    m = numbered(members, [key], ["ord"], "j", "m")
    counts = h.select(key, "n").distinct()
    at = m.join(counts, key).withColumn("i", F.floor(((F.col("j") + 1) * F.col("n") + F.col("m") - 1) / F.col("m")) - 1)
    return at.join(h.select(key, "i", F.col("id").alias("head_id")), [key, "i"]).select("id", "head_id")


def department_heads(placed: DataFrame) -> DataFrame:
    """``dept, id, full_name, at_layer``: of each department the person of the lowest layer, then name, then order of entry."""
    return placed.groupBy("dept").agg(F.min_by(F.struct("id", "full_name", "at_layer"), F.struct("at_layer", "full_name", "ord")).alias("v")).select("dept", "v.*")


def most_common(df: DataFrame, col: str, order: str) -> DataFrame:
    """The commonest non-empty value of a column; of equal ones the first seen."""
    return df.filter(F.coalesce(F.col(col), F.lit("")) != "").groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(1).select("value", "n")


def region_groups(placed: DataFrame) -> DataFrame:
    """``region, n, apex, rank``: regions with a layer-1 person first, then by size, then by name."""
    g = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("at_layer").alias("top"))
    return g.select("region", "n", (F.col("top") <= 1).alias("apex"), F.row_number().over(Window.orderBy((F.col("top") > 1), F.desc("n"), "region")).cast("long").alias("rank"))
