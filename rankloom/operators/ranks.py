"""Numbering of rows that survives groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.session import cut


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "j", total: str | None = "m") -> DataFrame:
    """``df`` with each row's number ``name`` from 0 within its ``keys`` by ``order`` (ascending), and with the group's size ``total``.

    Rows are spread by ranges of keys and order together, so a group of any size is sorted in pieces; a piece's first
    number is the sum of the pieces before it. ``order`` should tell all rows of a group apart: equal rows are numbered in any order.
    The ranges are written once, as numbers and sums have to see the same pieces.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn("piece_", F.spark_partition_id()))
    w = Window.partitionBy(*keys).orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "piece_").agg(F.count(F.lit(1)).alias("c_"))  # a few rows a group: its pieces
    starts = sizes.withColumn("before_", F.coalesce(F.sum("c_").over(w), F.lit(0))).withColumn("total_", F.sum("c_").over(Window.partitionBy(*keys))).drop("c_")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "piece_"]]
    cond = same[0]
    for c in same[1:]:
        cond &= c
    out = ranged.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys, "piece_").orderBy(*order)) - 1).alias("l").join(starts.alias("r"), cond)
    extra = [F.col("r.total_").alias(total)] if total else []
    return out.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("r.before_") + F.col("l.rn_")).cast("long").alias(name), *extra)
