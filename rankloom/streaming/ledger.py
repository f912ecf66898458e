"""The corrections log as a stream: counts per pattern are kept as state and promotions follow each micro-batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import ledger
from rankloom.sources.readers import LEDGER


def stream_log(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """New lines of a folder of JSON-lines files; malformed lines are dropped, as in ``sources.readers.read_log``."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def pattern_counts(log: DataFrame) -> DataFrame:
    """Corrections and distinct outcomes (up to two are told apart) per pattern, as running state."""
    outcome = F.concat_ws("|", F.coalesce(F.col("corrected_level").cast("string"), F.lit("")), F.coalesce("corrected_function", F.lit("")))
    return ledger.keyed(log).groupBy(*ledger.KEY).agg(F.count(F.lit(1)).alias("corrections"), F.min(outcome).alias("least"), F.max(outcome).alias("most"))


def promote_continuously(spark: SparkSession, path: str, out: str, checkpoint: str, threshold: int = ledger.THRESHOLD, overlay: DataFrame | None = None):
    """Read all there is, then stop: unanimous patterns of enough corrections are written to ``out``, by batch. Run again, it reads only what is new.

    A pattern that the overlay (``title_raw, region, archetype_id, sub_industry``) or an earlier batch holds isn't written
    again; a batch that is run again after a failure replaces what it wrote.
    """
    held = None
    if overlay is not None:
        held = overlay.select(F.lower(F.trim("title_raw")).alias("title_l"), "region", F.col("archetype_id").alias("archetype"), F.coalesce("sub_industry", F.lit("")).alias("sub_industry"))

    def write(batch: DataFrame, n: int) -> None:
        new = batch.filter((F.col("corrections") >= threshold) & (F.col("least") == F.col("most")))
        known = [held] if held is not None else []
        try:
            known.append(spark.read.parquet(out).filter(F.col("batch") < n).select(*ledger.KEY))
        except AnalysisException:  # nothing written yet
            pass
        for k in known:
            same = [new[c].eqNullSafe(k[c]) for c in ledger.KEY]
            new = new.join(k, same[0] & same[1] & same[2] & same[3], "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return pattern_counts(stream_log(spark, path)).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
