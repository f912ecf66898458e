"""Titles matched to the ladders of rule libraries, in five tiers behind a guard on seniority."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import titles as T
from rankloom.functions.text import strip

#: Words of rank, the longer first; the first that a title holds must stand in the entry too (fixed values).
SENIORITY = ("chief executive officer", "chief financial officer", "chief operating officer", "chief technology officer", "chief marketing officer", "chief information officer", "chief human resources officer", "executive vice president", "senior vice president", "vice president", "senior director", "managing director", "director", "senior manager", "manager", "head of", "chief", "president", "evp", "svp", "vp", "ceo", "cfo", "coo", "cto", "cio", "cmo", "chro")
STOP = ("the", "a", "an", "of", "and", "&")
_EDGE = r"[ \t\-/().,]"


def words(c: Column) -> Column:
    """Sorted distinct words; slashes and dashes part words."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[/—-]", " "), r"\s+"), lambda x: (x != "") & ~x.isin(*STOP))))


def _stands_in(word: Column, text: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(rf"(?:^|{_EDGE})"), word, F.lit(rf"(?:$|{_EDGE})")))


def seniority(low: Column) -> Column:
    """The first word of rank that stands in a title in lower case; null if none."""
    out = None
    for w in SENIORITY:
        hit = low.rlike(rf"(?:^|{_EDGE}){w}(?:$|{_EDGE})")
        out = F.when(hit, w) if out is None else out.when(hit, w)
    return out


def _grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))


def match(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """``archetype, title, entry, function, level, tier`` of each distinct title that meets an entry of its archetype.

    ``asked``: ``archetype, title``. ``entries``: ``archetype, function, level, entry, pos`` (``pos``: place in the ladder, unique in an archetype).
    Tiers: 1 the same text, or one of an entry's alternatives between slashes (the first entry); 2 the same words (the
    shortest entry), or an entry of two words or more that a title's words cover, if it stands before any of the same
    words; 3 a title of six letters or more within an entry (the shortest); 4 an entry of ten letters or more within
    a title (the longest). Ties go to the earlier entry. An entry without the title's word of rank doesn't count.
    Titles meet entries through shared alternatives, words or three letters only. Null and blank titles match nothing.
    """
    t = asked.select("archetype", "title").filter("title is not null").distinct().withColumn("low", F.lower(strip("title"))).filter("low <> ''").withColumn("tw", words(F.col("title"))).withColumn("rank", seniority(F.col("low")))
    e = entries.select("archetype", "function", "level", "entry", "pos", F.lower("entry").alias("norm")).withColumn("parts", F.transform(F.split("norm", "/"), lambda x: F.trim(x))).withColumn("ew", words(F.col("entry")))
    pair = ["archetype", "title", "pos"]
    key = lambda df, c, *cols: df.select("archetype", *cols, F.explode(c).alias("k"))
    met = (
        key(t, F.array("low"), "title").join(key(e, F.array_union("parts", F.array("norm")), "pos"), ["archetype", "k"]).select(*pair)
        .unionByName(key(t, "tw", "title").join(key(e, F.array_compact(F.array(F.get("ew", F.lit(0)))), "pos"), ["archetype", "k"]).select(*pair))
        .unionByName(key(t, F.transform("tw", lambda x: x), "title").join(key(e, F.array_distinct(F.flatten(F.transform("parts", lambda p: words(p)))), "pos"), ["archetype", "k"]).select(*pair))
        .unionByName(key(t.filter("length(low) >= 6"), F.array(F.substring("low", 1, 3)), "title").join(key(e, _grams(F.col("norm")), "pos"), ["archetype", "k"]).select(*pair))
        .unionByName(key(t, _grams(F.col("low")), "title").join(key(e.filter("length(norm) >= 10"), F.array(F.substring("norm", 1, 3)), "pos"), ["archetype", "k"]).select(*pair))
        .distinct()
    )
    j = met.join(t, ["archetype", "title"]).join(e, ["archetype", "pos"]).filter(F.col("rank").isNull() | _stands_in(F.col("rank"), F.col("norm")))
    n, pos = F.length("entry"), F.col("pos")
    exact = (F.col("low") == F.col("norm")) | F.array_contains("parts", F.col("low"))
    equal = (F.col("tw") == F.col("ew")) | F.exists("parts", lambda p: words(p) == F.col("tw"))
    covered = (F.size("ew") >= 2) & (F.size(F.array_except("ew", "tw")) == 0) & ~equal
    inside = F.contains("norm", F.col("low")) & (F.length("low") >= 6)
    around = F.contains("low", F.col("norm")) & (F.length("norm") >= 10)
    row = lambda *first: F.struct(*[c.alias(f"o{i}") for i, c in enumerate(first)], "pos", "entry", "function", "level")
    best = lambda cond, *first: F.min(F.when(cond, row(*first)))
    hits = j.groupBy("archetype", "title").agg(best(exact, pos).alias("exact"), F.min(F.when(equal, pos)).alias("first_equal"), best(equal, n, pos).alias("equal"), best(covered, pos, n).alias("covered"), best(inside, n, pos).alias("inside"), best(around, -n, pos).alias("around"))
    early = F.col("covered").isNotNull() & (F.col("first_equal").isNull() | (F.col("covered.pos") < F.col("first_equal")))
    plain = lambda c: F.struct(F.col(c)["entry"].alias("entry"), F.col(c)["function"].alias("function"), F.col(c)["level"].alias("level"))
    shorter = F.col("equal").isNotNull() & (F.length(F.col("equal")["entry"]) < F.length(F.col("covered")["entry"]))
    token = F.when(early & ~F.coalesce(shorter, F.lit(False)), plain("covered")).when(F.col("equal").isNotNull(), plain("equal"))
    got = F.coalesce(F.when(F.col("exact").isNotNull(), plain("exact")), token, F.when(F.col("inside").isNotNull(), plain("inside")), F.when(F.col("around").isNotNull(), plain("around")))
    tier = F.when(F.col("exact").isNotNull(), 1).when(token.isNotNull(), 2).when(F.col("inside").isNotNull(), 3).when(F.col("around").isNotNull(), 4)
    return hits.select("archetype", "title", got.alias("g"), tier.alias("tier")).filter("tier is not null").select("archetype", "title", "g.*", "tier")


def is_atypical(title: Column, roles: Column) -> Column:
    """Whether a title holds one of an archetype's atypical roles, or is held by one."""
    t = F.lower(F.trim(title))
    return F.coalesce(F.exists(roles, lambda r: F.contains(t, F.lower(r)) | F.contains(F.lower(r), t)), F.lit(False))


def normalize_titles(people: DataFrame, overlay: DataFrame, entries: DataFrame, mode: str = "v2", translator: Callable[[Column], Column] = T.translate) -> DataFrame:
    """``id, level, function, normalized_title, how`` of people (``id, title, region, archetype, sub_industry``).

    The overlay by the title as it stands; else, for titles that aren't plain English letters, by the translated title;
    else the ladder's cascade. ``translator`` is any function of a column, a Pandas function too. ``how``: ``overlay``, ``translated``, ``cascade`` or null where nothing matches.
    """
    from rankloom.operators.taxonomy import lookup_overlay

    p = people.withColumn("english", translator(F.col("title")))
    first = lookup_overlay(people, overlay, mode).select("id", F.struct("level", "function", "normalized_title", F.lit("overlay").alias("how")).alias("a"))
    foreign = p.filter(F.col("english") != F.col("title")).withColumn("title", F.col("english"))
    second = lookup_overlay(foreign, overlay, mode).select("id", F.struct("level", "function", "normalized_title", F.lit("translated").alias("how")).alias("b"))
    third = match(p.select("archetype", F.col("english").alias("title")), entries).select("archetype", F.col("title").alias("english"), F.struct("level", "function", F.col("entry").alias("normalized_title"), F.lit("cascade").alias("how")).alias("c"))
    return p.join(first, "id", "left").join(second, "id", "left").join(third, ["archetype", "english"], "left").select("id", F.coalesce("a", "b", "c").alias("g")).select("id", "g.*")
