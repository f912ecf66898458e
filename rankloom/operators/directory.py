"""The industry directory: which industry a record is of, and layer and department by that industry's names.

A directory is four dimensions, read from its files by ``sources.library.read_directory`` or made of any tables of that shape:

- ``detection``: ``industry, kind (company | industry_hint | designation), keyword``
- ``canonical``: ``industry, layer, name`` (and ``pattern``: ``industry, layer, pattern``)
- ``keywords``: ``industry, dept, keyword``

Records meet keywords and names through words they share; only texts that aren't decided by that are compared further.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import titles as T

#: Points of a keyword by the field it occurs in, and points from which on an industry counts (fixed values).
POINTS, THRESHOLD = {"company": 20.0, "industry_hint": 25.0, "designation": 15.0}, 10.0
#: Confidence of a stage, and what remains of it where the industry isn't known (fixed values).
STAGES = {"exact": (1.0, 0.9), "pattern": (0.85, 0.85), "substring": (0.88, 0.82), "fuzzy": (0.8, 0.8), "fallback": (0.6, 1.0)}
FUZZY = 80.0


@dataclass
class Directory:
    detection: DataFrame
    canonical: DataFrame
    keywords: DataFrame
    pattern: DataFrame | None = None


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def _holds(text: Column, keyword: Column) -> Column:
    """A phrase occurs anywhere, a word only whole."""
    phrase = keyword.rlike("[ &/-]")
    return F.when(phrase, F.contains(text, keyword)).otherwise(F.array_contains(_words(text), keyword))


def industry_scores(records: DataFrame, detection: DataFrame) -> DataFrame:
    """``id, industry, score`` of ``records`` (``id, designation, company, industry_hint``): the points of the keywords found in each field."""
    fields = F.array(*[F.struct(F.lit(k).alias("kind"), F.lower(F.coalesce(F.col(k), F.lit(""))).alias("text")) for k in POINTS])
    long = records.select("id", F.explode(fields).alias("f")).select("id", "f.*").filter("text <> ''")
    k = detection.select("industry", "kind", F.lower("keyword").alias("kw")).distinct().withColumn("w", F.get(_words(F.col("kw")), F.lit(0))).filter("w is not null")
    texts = long.select("kind", "text").distinct()
    hit = texts.select("kind", "text", F.explode(_words(F.col("text"))).alias("w")).join(k, ["kind", "w"]).filter(_holds(F.col("text"), F.col("kw"))).select("kind", "text", "industry", "kw").distinct().groupBy("kind", "text", "industry").agg(F.count(F.lit(1)).alias("n"))
    points = F.element_at(F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv]), F.col("kind"))
    return long.join(hit, ["kind", "text"]).groupBy("id", "industry").agg(F.sum(F.col("n") * points).alias("score"))


def best_industry(records: DataFrame, detection: DataFrame) -> DataFrame:
    """``id, industry, score`` of the best industry above the threshold; of equal ones the first by name."""
    s = industry_scores(records, detection)
    return s.groupBy("id").agg(F.min_by(F.struct("industry", "score"), F.struct(-F.col("score"), "industry")).alias("v")).select("id", "v.*").filter(F.col("score") >= THRESHOLD)


def layers(records: DataFrame, directory: Directory) -> DataFrame:
    """``id, layer, confidence, stage`` of ``records`` (``id, designation, industry`` or null).

    Stages: a canonical name's whole text; a pattern; the longest canonical name within the title; the likest name by
    shared words (80 of 100 or more); the quick list of ranks. A record of a known industry looks there first, and there alone; of an unknown one in all.
    """
    r = records.select("id", "industry", T.expand("designation").alias("t")).filter("t <> ''")
    asked = r.select("industry", "t").distinct().withColumn("q", F.xxhash64("industry", "t"))
    names = directory.canonical.select(F.col("industry").alias("of"), "layer", T.expand("name").alias("name")).filter("name <> ''").distinct()
    here = F.col("industry").isNull() | (F.col("industry") == F.col("of"))
    exact = asked.join(names.withColumnRenamed("name", "t"), "t").filter(here).groupBy("q").agg(F.min("layer").alias("exact"))
    met = asked.select("q", "industry", "t", F.explode(_words(F.col("t"))).alias("w")).join(names.select("of", "layer", "name", F.explode(_words(F.col("name"))).alias("w")), "w").filter(here).select("q", "t", "layer", "name").distinct()
    inside = met.filter(F.contains(F.concat(F.lit(" "), F.col("t"), F.lit(" ")), F.concat(F.lit(" "), F.col("name"), F.lit(" ")))).groupBy("q").agg(F.min(F.struct((-F.length("name")).alias("n"), "layer")).alias("inside"))
    like = met.join(exact, "q", "left_anti").join(inside.select("q"), "q", "left_anti").withColumn("s", T.token_set_ratio("t", "name")).groupBy("q").agg(F.min(F.struct((-F.col("s")).alias("s"), "layer")).alias("like")).filter(-F.col("like")["s"] >= FUZZY)
    out = asked.join(exact, "q", "left").join(inside, "q", "left").join(like, "q", "left")
    if directory.pattern is not None:
        n = directory.pattern.count()
        if n > 5_000:
            raise ValueError("patterns are sent to every task; 5,000 at most")
        p = F.broadcast(directory.pattern.select(F.col("industry").alias("of"), F.col("layer").alias("pl"), "pattern"))
        hits = asked.join(p, here & F.regexp_like("t", F.col("pattern"))).groupBy("q").agg(F.min("pl").alias("pattern"))  # by a bounded table, whose size is checked
        out = out.join(hits, "q", "left")
    else:
        out = out.withColumn("pattern", F.lit(None).cast("int"))
    stage = F.when(F.col("exact").isNotNull(), "exact").when(F.col("pattern").isNotNull(), "pattern").when(F.col("inside").isNotNull(), "substring").when(F.col("like").isNotNull(), "fuzzy").otherwise("fallback")
    layer = F.coalesce("exact", "pattern", F.col("inside")["layer"], F.col("like")["layer"], T.quick_layer("t"))
    table = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in STAGES.items() for x in (k, v[i])]), stage)
    base = F.when(stage == "fuzzy", -F.col("like")["s"] / 100 * 0.8).otherwise(table(0))
    conf = F.round(base * F.when(F.col("industry").isNull(), table(1)).otherwise(1.0), 6)
    done = out.select("q", layer.cast("int").alias("layer"), conf.alias("confidence"), stage.alias("stage"))
    return r.withColumn("q", F.xxhash64("industry", "t")).join(done, "q").select("id", "layer", "confidence", "stage")


def departments(records: DataFrame, directory: Directory, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """``id, dept, how`` of ``records`` (``id, designation, industry``): the industry's department of most keyword points (a phrase counts
    its words, a word one), else the longest keyword of any industry, else ordered ``rules`` (department, pattern), else Operations."""
    r = records.select("id", "industry", F.lower(F.coalesce("designation", F.lit(""))).alias("t"))
    k = directory.keywords.select(F.col("industry").alias("of"), "dept", F.lower("keyword").alias("kw")).distinct().withColumn("w", F.get(_words(F.col("kw")), F.lit(0))).filter("w is not null")
    asked = r.select("industry", "t").distinct().withColumn("q", F.xxhash64("industry", "t"))
    met = asked.select("q", "industry", "t", F.explode(_words(F.col("t"))).alias("w")).join(k, "w").filter(_holds(F.col("t"), F.col("kw"))).select("q", "industry", "of", "dept", "kw").distinct()
    points = F.when(F.col("kw").rlike("[ &/-]"), F.size(F.split("kw", " +"))).otherwise(1)
    own = met.filter(F.col("of") == F.col("industry")).groupBy("q", "dept").agg(F.sum(points).alias("n")).groupBy("q").agg(F.min_by("dept", F.struct(-F.col("n"), "dept")).alias("own"))
    wide = met.groupBy("q").agg(F.min_by("dept", F.struct(-F.length("kw"), "kw", "dept")).alias("wide"))
    ruled = None
    for d, p in rules or []:
        ruled = F.when(F.col("t").rlike(p), d) if ruled is None else ruled.when(F.col("t").rlike(p), d)
    ruled = F.lit(None).cast("string") if ruled is None else ruled
    done = asked.join(own, "q", "left").join(wide, "q", "left").select("q", F.coalesce("own", "wide", ruled, F.lit("Operations")).alias("dept"), F.when(F.col("own").isNotNull(), "industry").when(F.col("wide").isNotNull(), "any").when(ruled.isNotNull(), "rule").otherwise("default").alias("how"))
    return r.withColumn("q", F.xxhash64("industry", "t")).join(done, "q").select("id", "dept", "how")


def tertiary_label(designation: Column, parent: Column, table: list[tuple[str, str]]) -> Column:
    """The first label of ``table`` (label, pattern) found in a title; empty where none is, or where it is the parent's own name."""
    t, out = F.lower(designation), F.lit("")
    for label, p in reversed(table):
        out = F.when(t.rlike(p) & (F.lower(parent) != label.lower()), label).otherwise(out)
    return out


def flatten_taxonomy(tree: DataFrame, promoted: str = "Corporate & Executive") -> DataFrame:
    """``primary, secondary, keywords`` of a nested taxonomy (``l1, l1_keywords, departments[{name, keywords, sub_depts[{name, keywords, teams[{name, keywords}]}]}]``).

    Of the ``promoted`` first level the second level is the primary department and its sub-departments the secondary ones; else the first
    level is primary and the second secondary. What lies deeper gives its names and keywords to the row above it.
    """
    d = tree.select("l1", "l1_keywords", F.explode("departments").alias("d"))
    deep = lambda s: F.flatten(F.transform(F.coalesce(s["teams"], F.array()), lambda t: F.concat(F.array(F.lower(t["name"])), F.coalesce(t["keywords"], F.array()))))
    subs = F.coalesce(F.col("d.sub_depts"), F.array())
    below = F.flatten(F.transform(subs, lambda s: F.concat(F.array(F.lower(s["name"])), F.coalesce(s["keywords"], F.array()), deep(s))))
    plain = d.filter(F.col("l1") != promoted).select(F.col("l1").alias("primary"), F.col("d.name").alias("secondary"), F.array_distinct(F.concat(F.coalesce(F.col("d.keywords"), F.array()), below)).alias("keywords"))
    top = d.filter(F.col("l1") == promoted)
    own = top.select(F.col("d.name").alias("primary"), F.lit("").alias("secondary"), F.array_distinct(F.coalesce(F.col("d.keywords"), F.array())).alias("keywords"))
    deeper = top.select(F.col("d.name").alias("primary"), F.explode("d.sub_depts").alias("s")).select("primary", F.col("s.name").alias("secondary"), F.array_distinct(F.concat(F.coalesce(F.col("s.keywords"), F.array()), deep(F.col("s")))).alias("keywords"))
    return plain.unionByName(own).unionByName(deeper)


def known_industry(answer: Column, industries: list[str]) -> Column:
    """An answer as one of the known industries: the same name, else the first known one that it holds or that holds it; else null."""
    a = F.lower(F.trim(answer))
    out = None
    for i in industries:
        out = F.when(a == i.lower(), i) if out is None else out.when(a == i.lower(), i)
    for i in industries:
        hit = (a != "") & (F.contains(a, F.lit(i.lower())) | F.contains(F.lit(i.lower()), a))
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out if out is not None else F.lit(None).cast("string")
