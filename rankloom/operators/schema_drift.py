"""Files whose fields drift: one consistent table, and a report of each change.

Tagged-union inference. Every file of a feed has a schema of its own; the schemas are fused into one in which a field
keeps each JSON type it ever had as an alternative (``text``, ``number``, ``boolean``, ``list``, ``object``). A value
is kept in the branch of its type, beside one canonical text. Renamings are found by content: a field that
disappears and one that appears in the same file are the same if the profiles of their values agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.session import cut

#: Least agreement (0 to 1) of two profiles for a renaming.
SAME_CONTENT = 0.35
#: Branches of the tagged union.
TYPES = ("text", "number", "boolean", "list", "object")

_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def explode_payloads(df: DataFrame) -> DataFrame:
    """One row per top-level field of each readable payload: ``record_id, feed, file_no, uploaded_at, line_no, field, kind, value``.

    ``kind`` is a type of ``TYPES`` or null for a JSON null; ``value`` is the field as a variant. A payload that is
    null, isn't JSON, isn't an object or repeats a name is broken and gives no row, and so does an empty object.
    """
    rows = df.select("record_id", "feed", "file_no", "uploaded_at", "line_no", F.expr("try_parse_json(payload)").alias("v")).filter(
        F.expr("v is not null and startswith(schema_of_variant(v), 'OBJECT')")
    )
    t = F.expr("schema_of_variant(value)")
    kind = (
        F.when(t == "STRING", "text").when(t.rlike(_NUMBER), "number").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "object")
    )
    return rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select(
        "record_id", "feed", "file_no", "uploaded_at", "line_no", F.col("key").alias("field"), kind.alias("kind"), "value"
    )


def file_schemas(fields: DataFrame) -> DataFrame:
    """``feed, file_no, field, kind, n``: of each file's fields the commonest type (the first in ``TYPES`` on a tie; null if all values are null)."""
    counts = [F.sum((F.col("kind") == t).cast("long")).alias(t) for t in TYPES]
    most = F.greatest(*[F.coalesce(F.col(t), F.lit(0)) for t in TYPES])
    kind = F.coalesce(*[F.when((F.col(t) == most) & (most > 0), F.lit(t)) for t in TYPES])
    return fields.groupBy("feed", "file_no", "field").agg(F.count(F.lit(1)).alias("n"), *counts).select("feed", "file_no", "field", kind.alias("kind"), "n")


def explode_paths(fields: DataFrame, deepest: int | None = None) -> DataFrame:
    """``fields`` and everything inside their lists and objects: ``record_id, feed, file_no, line_no, path, kind, value``.

    A path is the names on the way, joined by dots, with ``[]`` for the items of a list. Level by level until nothing is
    nested any more (or ``deepest`` levels).
    """
    keep = ("record_id", "feed", "file_no", "line_no")
    level = fields.select(*keep, F.col("field").alias("path"), "kind", "value")
    out, depth = level, 0
    tvf = fields.sparkSession.tvf
    t = F.expr("schema_of_variant(inner)")
    kind = F.when(t == "STRING", "text").when(t.rlike(_NUMBER), "number").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "object")
    while deepest is None or depth < deepest:
        nested = level.filter(F.col("kind").isin("list", "object")).withColumnRenamed("value", "v").withColumnRenamed("kind", "outer_kind")
        inside = nested.lateralJoin(tvf.variant_explode(F.col("v").outer())).withColumnRenamed("value", "inner")
        level = cut(inside.select(*keep, F.when(F.col("outer_kind") == "list", F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.lit("."), "key")).alias("path"), kind.alias("kind"), F.col("inner").alias("value")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
        depth += 1
    return out


def alternatives(df: DataFrame) -> DataFrame:
    """``feed, file_no, path, kind, n, appears``: of each file every type that a path has, however rare, with its number of
    values; ``appears`` tells that the file before in the feed has the path not in that type. Nulls have no type. Copies of a file count as one."""
    once = df.filter("feed is not null and file_no is not null").groupBy("feed", "file_no", "line_no", "payload").agg(F.min("record_id").alias("record_id"), F.min("uploaded_at").alias("uploaded_at"))
    found = cut(explode_paths(explode_payloads(once)).filter("kind is not null").groupBy("feed", "file_no", "path", "kind").agg(F.count(F.lit(1)).alias("n")))
    files = found.select("feed", (F.col("file_no") + 1).alias("file_no")).distinct().withColumn("follows", F.lit(True))
    before = found.select("feed", (F.col("file_no") + 1).alias("file_no"), "path", "kind", F.lit(True).alias("was"))
    j = found.join(files, ["feed", "file_no"], "left").join(before, ["feed", "file_no", "path", "kind"], "left")
    return j.select("feed", "file_no", "path", "kind", "n", (F.coalesce("follows", F.lit(False)) & F.col("was").isNull()).alias("appears"))


def typed_paths(df: DataFrame) -> DataFrame:
    """Every value that isn't a list or object, at any depth, as one row in the branch of its type: ``record_id, feed, file_no, line_no, path, kind, as_text, as_number, as_boolean``."""
    flat = explode_paths(explode_payloads(df.filter("feed is not null and file_no is not null"))).filter("kind in ('text', 'number', 'boolean')")
    text = F.expr("cast(value as string)")
    return flat.select(
        "record_id", "feed", "file_no", "line_no", "path", "kind", F.when(F.col("kind") == "text", text).alias("as_text"),
        F.when(F.col("kind") == "number", F.expr("try_variant_get(value, '$', 'double')")).alias("as_number"), F.when(F.col("kind") == "boolean", F.expr("try_variant_get(value, '$', 'boolean')")).alias("as_boolean"),
    )


def _profiles(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """``feed, file_no, field, part, feature, c``: how often a feature occurs among the values of each wanted field."""
    text = F.when(F.col("kind") == "text", F.expr("cast(value as string)")).otherwise(F.expr("to_json(value)"))
    low = F.lower("x")
    shape = F.regexp_replace(F.regexp_replace("x", r"\p{Lu}+", "A"), r"[\p{Ll}\p{Lo}]+", "a")
    shape = F.when(F.col("kind") == "number", F.regexp_replace("x", r"\d", "9")).otherwise(F.regexp_replace(shape, r"\d+", "9"))
    edged = F.concat(F.lit("^"), low, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(edged) - 2, F.lit(1))), lambda i: F.struct(F.lit("gram").alias("part"), F.substring(edged, i, F.lit(3)).alias("feature")))
    feats = F.concat(F.array(F.struct(F.lit("shape").alias("part"), shape.alias("feature")), F.struct(F.lit("value").alias("part"), low.alias("feature"))), grams)
    return (
        fields.filter("kind is not null")
        .join(wanted, ["feed", "file_no", "field"], "left_semi")
        .select("feed", "file_no", "field", "kind", text.alias("x"))
        .groupBy("feed", "file_no", "field", "kind", "x")
        .agg(F.count(F.lit(1)).alias("m"))
        .select("feed", "file_no", "field", "m", F.explode(feats).alias("f"))
        .groupBy("feed", "file_no", "field", "f.part", "f.feature")
        .agg(F.sum("m").cast("double").alias("c"))
    )


def _pair_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one file's candidate renamings, the best pairs, each field once."""
    pdf = pdf.sort_values(["score", "old", "new"], ascending=[False, True, True])
    olds, news, keep = set(), set(), []
    for i, (o, n) in enumerate(zip(pdf["old"], pdf["new"])):
        if o not in olds and n not in news:
            olds.add(o)
            news.add(n)
            keep.append(i)
    return pdf.iloc[keep][["feed", "file_no", "old", "new", "score"]]


def rename_scores(fields: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """``feed, file_no, old, new, score`` of each field that vanished with each that came in the same file, of one type."""
    pairs = removed.withColumnRenamed("field", "old").join(added.withColumnRenamed("field", "new"), ["feed", "file_no", "kind"])
    before = pairs.select("feed", (F.col("file_no") - 1).alias("file_no"), F.col("old").alias("field"))
    now = pairs.select("feed", "file_no", F.col("new").alias("field"))
    prof = cut(_profiles(fields, before.union(now).distinct()))
    norm = prof.groupBy("feed", "file_no", "field", "part").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    unit = prof.join(norm, ["feed", "file_no", "field", "part"]).select("feed", "file_no", "field", "part", "feature", (F.col("c") / F.col("norm")).alias("u"))
    a = unit.select("feed", (F.col("file_no") + 1).alias("file_no"), F.col("field").alias("old"), "part", "feature", F.col("u").alias("ua"))
    b = unit.select("feed", "file_no", F.col("field").alias("new"), "part", "feature", F.col("u").alias("ub"))
    names = pairs.select("feed", "file_no", "old", "new")
    dots = (
        a.join(names, ["feed", "file_no", "old"])
        .join(b, ["feed", "file_no", "new", "part", "feature"])
        .groupBy("feed", "file_no", "old", "new")
        .agg(F.sum(F.col("ua") * F.col("ub") * F.when(F.col("part") == "shape", 0.35).when(F.col("part") == "gram", 0.55).otherwise(0.1)).alias("score"))
    )
    return dots


def report_changes(df: DataFrame, least: float = SAME_CONTENT) -> DataFrame:
    """``feed, file_no, change, field, new_field`` of each file against the one before it in its feed.

    ``df`` needs ``record_id, feed, file_no, uploaded_at, line_no, payload``; other columns are ignored. Files are
    told by ``feed`` and ``file_no``, so copies are one file. A file without a readable payload has no schema: it and
    its successor report nothing. Rows with null ``feed`` or ``file_no`` belong to no file.
    """
    fields = cut(explode_payloads(df.filter("feed is not null and file_no is not null")))
    schemas = cut(file_schemas(fields))
    files = schemas.select("feed", "file_no").distinct()
    steps = files.join(files.select("feed", (F.col("file_no") + 1).alias("file_no")), ["feed", "file_no"])
    now = schemas.select("feed", "file_no", "field", F.col("kind").alias("k_now"), F.lit(True).alias("is_now")).join(steps, ["feed", "file_no"], "left_semi")
    old = schemas.select("feed", (F.col("file_no") + 1).alias("file_no"), "field", F.col("kind").alias("k_old"), F.lit(True).alias("is_old")).join(steps, ["feed", "file_no"], "left_semi")
    both = cut(old.join(now, ["feed", "file_no", "field"], "full"))
    removed = both.filter("is_now is null").select("feed", "file_no", "field", F.col("k_old").alias("kind"))
    added = both.filter("is_old is null").select("feed", "file_no", "field", F.col("k_now").alias("kind"))
    retyped = both.filter("k_now <> k_old").select("feed", "file_no", F.lit("retyped").alias("change"), "field", F.lit("").alias("new_field"))
    renamed = cut(
        rename_scores(fields, removed, added)
        .filter(F.col("score") >= least)
        .groupBy("feed", "file_no")
        .applyInPandas(_pair_up, "feed string, file_no int, old string, new string, score double")
    )
    gone = removed.join(renamed.withColumnRenamed("old", "field"), ["feed", "file_no", "field"], "left_anti")
    came = added.join(renamed.withColumnRenamed("new", "field"), ["feed", "file_no", "field"], "left_anti")
    return (
        renamed.select("feed", "file_no", F.lit("renamed").alias("change"), F.col("old").alias("field"), F.col("new").alias("new_field"))
        .unionByName(retyped)
        .unionByName(gone.select("feed", "file_no", F.lit("removed").alias("change"), "field", F.lit("").alias("new_field")))
        .unionByName(came.select("feed", "file_no", F.lit("added").alias("change"), "field", F.lit("").alias("new_field")))
    )


def _trace(pdf: pd.DataFrame) -> pd.DataFrame:
    """A feed's renamings, in order of file: which file's name stands for which first name, until the name goes."""
    out, names = [], {}
    for n, o, w in sorted(zip(pdf["file_no"], pdf["field"], pdf["new_field"])):
        names[w] = names.pop(o, o)
        out.append((pdf["feed"].iloc[0], n, w, names[w]))
    return pd.DataFrame(out, columns=["feed", "from_file", "name", "first_name"])


def canonical_names(schemas: DataFrame, changes: DataFrame) -> DataFrame:
    """``feed, file_no, field, canonical``: the name by which each file's field first came in its feed."""
    traced = changes.filter("change = 'renamed'").groupBy("feed").applyInPandas(_trace, "feed string, from_file int, name string, first_name string")
    w = Window.partitionBy("feed", "file_no", "field").orderBy(F.col("from_file").desc_nulls_last())
    return (
        schemas.select("feed", "file_no", "field")
        .join(traced.withColumnRenamed("name", "field"), ["feed", "field"], "left")
        .filter("from_file is null or from_file <= file_no or first_name is not null")
        .withColumn("from_file", F.when(F.col("from_file") <= F.col("file_no"), F.col("from_file")))
        .withColumn("rn", F.row_number().over(w))
        .filter("rn = 1")
        .select("feed", "file_no", "field", F.when(F.col("from_file").isNotNull(), F.col("first_name")).otherwise(F.col("field")).alias("canonical"))
    )


def unify(df: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Every readable field as one row of one table: ``record_id, feed, file_no, line_no, field, canonical, kind`` and a
    branch per type (``as_text, as_number, as_boolean, as_list, as_object``: only that of the value's type is filled;
    lists and objects as JSON) beside ``canonical_text``, the value as text whatever its type (the parts of a list or object joined by a space).
    Of a file's copies the one uploaded first is kept (line by line)."""
    src = df.filter("feed is not null and file_no is not null")
    changes = cut(report_changes(src)) if changes is None else changes
    once = src.groupBy("feed", "file_no", "line_no", "payload").agg(F.min_by("record_id", F.struct("uploaded_at", "record_id")).alias("record_id"), F.min("uploaded_at").alias("uploaded_at"))
    fields = explode_payloads(once)
    names = canonical_names(file_schemas(fields), changes)
    json = F.expr("to_json(value)")
    text = F.expr("cast(value as string)")
    scalars = F.filter(F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*":?|[^\[\]{},":]+'), F.lit(0)), lambda x: ~x.endswith('":'))
    parts = F.array_join(F.transform(scalars, lambda x: F.regexp_replace(x, '^"|"$', "")), " ")
    return (
        fields.join(names, ["feed", "file_no", "field"])
        .select(
            "record_id", "feed", "file_no", "line_no", "field", "canonical", "kind",
            F.when(F.col("kind") == "text", text).alias("as_text"),
            F.when(F.col("kind") == "number", F.expr("try_variant_get(value, '$', 'double')")).alias("as_number"),
            F.when(F.col("kind") == "boolean", F.expr("try_variant_get(value, '$', 'boolean')")).alias("as_boolean"),
            F.when(F.col("kind") == "list", json).alias("as_list"),
            F.when(F.col("kind") == "object", json).alias("as_object"),
            F.when(F.col("kind").isin("list", "object"), parts).when(F.col("kind").isNotNull(), text).alias("canonical_text"),
        )
    )
