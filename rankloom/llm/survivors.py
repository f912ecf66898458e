"""One surviving value per field for each group of duplicate records.

``discover`` is truth discovery: every row claims values for its group's fields; sources have a reliability per field.
In turn, each claimed value's support is the sum of its claimants' reliabilities, the value of highest support is
taken as true, and a source's reliability becomes its smoothed rate of true claims, until no reliability moves. Claims
are pre-aggregated per group, field, value and source, so a group of any size meets in sums and maxima only.

Where the survivor is prescribed (the most trusted, then latest, then smallest row, as this project's data demand), no
vote can change it, so ``survive`` takes it directly: one aggregation, without rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import is_blank, squeeze
from rankloom.session import cut

FIELDS = ("title", "age", "pay")

#: Stand-ins for "no title", folded (fixed values); a title without any letter is one too.
NO_TITLE = ("#n/a", "n/a", "n.a.", "na", "nan", "nil", "none", "null", "unknown", "unspecified", "undisclosed", "not disclosed", "not available", "not applicable", "not specified", "not stated", "no title", "tba", "tbc", "tbd", "to be announced", "to be confirmed", "to be determined", "to be defined")

#: Trust tiers by kind of source, told by words in the folded source type (fixed values).
SOURCE_KINDS = (("filing", 1, r"filing|proxy|10-?k|annual report"), ("website", 2, r"website|web site|firm site"), ("linkedin", 3, r"linkedin"))


def source_kind(c: Column | str) -> Column:
    """``filing``, ``website`` or ``linkedin``; null where missing or unknown."""
    s = F.lower(F.regexp_replace(squeeze(c), r"[-_\s]+", " "))
    return F.coalesce(*[F.when(s.rlike(p), F.lit(k)) for k, _, p in SOURCE_KINDS])


def trust_tier(source_type: Column | str, precedence: Column | str) -> Column:
    """1 is the most trusted; the source type decides, ``precedence`` only where it is missing; null comes last."""
    k = source_kind(source_type)
    return F.coalesce(*[F.when(k == n, F.lit(t)) for n, t, _ in SOURCE_KINDS], F.col(precedence).cast("int") if isinstance(precedence, str) else precedence.cast("int"))


def usable_title(c: Column | str) -> Column:
    s = F.lower(squeeze(c))
    return ~is_blank(c) & ~s.isin(*NO_TITLE) & F.coalesce(F.regexp_like(c if isinstance(c, Column) else F.col(c), F.lit(r"\p{L}")), F.lit(False))


_NEEDED = ("candidate_id", "roster_id", "title", "age", "pay", "source_type", "precedence", "verification_status", "extracted_at")


def _best() -> Column:
    """Orders claims by tier, time and id; its maximum is the first in precedence (nulls are least)."""
    return F.struct((-trust_tier("source_type", "precedence")).alias("t"), F.col("extracted_at").alias("at"), (-F.col("candidate_id")).alias("id"))


def _usable() -> dict[str, tuple[Column, Column]]:
    """Of each field whether a row claims a usable value, and the value as text."""
    verified = ~F.coalesce(F.lower(squeeze("verification_status")) == "unverified", F.lit(False))
    pay = (F.col("pay") > 0) & ~F.isnan("pay") & (F.col("pay") < float("inf"))
    return {"title": (verified & usable_title("title"), F.lower(squeeze("title"))), "age": (verified & F.col("age").between(18, 100), F.col("age").cast("string")), "pay": (verified & pay, F.col("pay").cast("string"))}


def survive(df: DataFrame) -> DataFrame:
    """``roster_id, field, candidate_id``: of each group of two rows or more and each field the usable claim of the most
    trusted, then latest (null last), then smallest row; nothing where no claim is usable. Needs the columns of
    ``discover``; others are ignored. One shuffle, with partial maxima: groups of any size."""
    rows = df.filter("roster_id is not null").select(*_NEEDED)
    ok = _usable()
    top = rows.select("roster_id", _best().alias("best"), *[c.alias(f"ok_{f}") for f, (c, _) in ok.items()]).groupBy("roster_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col(f"ok_{f}"), F.col("best"))).alias(f) for f in ok])
    claims = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), (-F.col(f)["id"]).alias("candidate_id"))) for f in ok]))
    return top.filter("n >= 2").select("roster_id", F.explode(claims).alias("c")).select("roster_id", "c.*")


def claims_of(df: DataFrame) -> DataFrame:
    """``g, field, value, src, n, best``: pre-aggregated usable claims of groups of at least two rows."""
    rows = df.filter("roster_id is not null").select(*_NEEDED)
    groups = rows.groupBy("roster_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("roster_id")
    fields = F.array(*[F.when(ok, F.struct(F.lit(f).alias("field"), v.alias("value"))) for f, (ok, v) in _usable().items()])
    return (
        rows.select("roster_id", F.coalesce(source_kind("source_type"), F.lit("other")).alias("src"), _best().alias("best"), F.explode(F.array_compact(fields)).alias("c"))
        .groupBy(F.col("roster_id").alias("g"), F.col("c.field").alias("field"), F.col("c.value").alias("value"), "src")
        .agg(F.count(F.lit(1)).alias("n"), F.max("best").alias("best"))
        .join(groups.withColumnRenamed("roster_id", "g"), "g", "left_semi")
    )


@dataclass
class Truths:
    """``values``: roster_id, field, candidate_id, value, support (0 to 1). ``reliability``: {(source, field): rate}."""

    values: DataFrame
    reliability: dict[tuple[str, str], float]
    rounds: int


def discover(df: DataFrame, most_rounds: int = 20, tolerance: float = 1e-3) -> Truths:
    """Survivors of each group and field of ``df`` (``candidate_id, roster_id, title, age, pay, source_type, precedence,
    verification_status, extracted_at``; other columns are ignored).

    Rows of null ``roster_id`` and groups of one row give nothing; neither does a field without a usable claim.
    Repeated rows of one id count as often as they come. An empty table gives an empty result.
    """
    claims = cut(claims_of(df))
    kinds = [*[k for k, _, _ in SOURCE_KINDS], "other"]
    rate = {(s, f): 0.8 for s in kinds for f in FIELDS}
    rounds = 0
    while True:
        rounds += 1
        weight = F.element_at(F.create_map(*[F.lit(x) for (s, f), w in rate.items() for x in (f"{s} {f}", float(w))]), F.concat_ws(" ", "src", "field"))
        values = claims.groupBy("g", "field", "value").agg(F.sum(F.col("n") * weight).alias("w"), F.max("best").alias("best"))
        truth = values.groupBy("g", "field").agg(F.max(F.struct(F.round("w", 9).alias("r"), "best", "value", "w")).alias("top"), F.sum("w").alias("total"))
        seen = (
            claims.join(truth.select("g", "field", F.col("top.value").alias("t")), ["g", "field"])
            .groupBy("src", "field")
            .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value") == F.col("t"), F.col("n")).otherwise(0)).alias("hit"))
            .collect()  # one row per kind of source and field
        )
        new = rate | {(r["src"], r["field"]): (r["hit"] + 1) / (r["n"] + 2) for r in seen}
        moved = max(abs(new[k] - rate[k]) for k in rate)
        if moved < tolerance or rounds == most_rounds:
            break
        rate = new
    out = truth.select(F.col("g").alias("roster_id"), "field", (-F.col("top.best.id")).alias("candidate_id"), F.col("top.value").alias("value"), F.round(F.col("top.w") / F.col("total"), 6).alias("support"))
    return Truths(out, rate, rounds)
