"""Variant spellings of people's names, linked within firms.

Names are compared in an edit metric (insertions, deletions, replacements and unrestricted swaps) on surnames freed of
transliteration differences. Cells of the metric space are the strings with one letter left out: any two surnames
within one edit of each other share such a cell, so names are replicated to all cells within their reach and an exact
join runs within each. From nine letters on, where two edits are allowed, surnames also meet in cells of their first
letters with two left out. The firm is part of every cell, by keys that all spellings of one firm share, so that a common
surname pairs nobody across firms. (Cells around sampled pivots, with
boundary names replicated by the triangle inequality, were tried and left: distances between surnames are so alike
that most names lie within the boundary of most cells; figures are in the README.)

Candidates by name are verified on surname, given name and firm; candidates by equal profile ids on the firm alone.
Which given names are usual, and which are short for which, is learned from the rows themselves.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.functions.text import is_blank
from rankloom.llm import names
from rankloom.session import cut

#: Usual given names: borne by so many rows, and as a given name so many times as often as as a surname. A name within one edit
#: of another that is ``TYPO`` times as frequent is taken for a typo of it.
LEAST_BEARERS, RATHER, TYPO = 8, 2, 20
#: Short forms: seen beside the full name in so many families and firms, so many times as often as chance has it, the full name so many
#: times as frequent. A pair of a family of up to ``FAMILY`` given names weighs one ``UNIT``, of a larger one less.
SEEN, LIFT, RARER, FAMILY, UNIT = 2, 5.0, 5.0, 8, 10**9
#: Letters of a beginning of which two are left out where the firm is in the key, too.
NEARER = 7
#: Formerly the people from which on a surname cell was parted by firm; nothing depends on it now, tests set it.
CROWDED = 64
#: People that share a key of their firm are compared in one task; where they are more, by the beginnings of their surnames: so many letters with
#: one left out, of surnames from ``FAR`` letters on so many with two. Both ways find the same pairs.
BLOCK, BEGINS, BEGINS_FAR = 50_000, 4, 4

#: Letters from which on surnames may differ by two edits (see ``names.same_surname``).
FAR = 9


def profile_id(c: Column | str) -> Column:
    """The last part of a personal page's address if it ends in an id; else null."""
    return F.nullif(F.regexp_extract(F.lower(c), r"/in/([^/?#\s]*-[0-9a-f]{4,})/?\s*$", 1), F.lit(""))


def cells(c: Column, least: int = 4) -> Column:
    """Hashes of a string and, from ``least`` letters on, of it with each letter left out; any two strings within one edit share one."""
    n = F.length(c)
    less = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    return F.when(n >= least, F.array_distinct(F.transform(F.concat(F.array(c), less), lambda x: F.xxhash64(x)))).otherwise(F.array(F.xxhash64(c)))


def far_cells(c: Column, letters: int = FAR) -> Column:
    """Hashes of a string's first ``letters`` letters with each two left out, none for strings shorter than ``FAR``; any two strings of
    ``FAR`` letters or more within two edits share one, as each edit costs their beginnings one common letter at most."""
    n = F.lit
    less = [F.concat(F.substring(c, n(1), n(i - 1)), F.substring(c, n(i + 1), n(j - i - 1)), F.substring(c, n(j + 1), n(letters - j))) for j in range(2, letters + 1) for i in range(1, j)]
    return F.when(F.length(c) >= FAR, F.array_distinct(F.transform(F.array(*less), lambda x: F.xxhash64(x))))


def far_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``s_a, s_b`` of each two different strings ``s`` of two tables that have ``FAR`` letters or more and lie within two edits; written once.

    Two plain edits are told by a built-in function; only where swaps may count, four plain edits at most, Python looks.
    """
    keys = lambda df, col: df.select("s").distinct().filter(F.length("s") >= FAR).select(F.col("s").alias(col), F.explode(far_cells(F.col("s"))).alias("cell"))

    @F.pandas_udf("boolean")
    def within(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([names.same_surname([v], [w]) for v, w in zip(x, y)], dtype=bool)

    met_ = keys(a, "s_a").join(keys(b, "s_b"), "cell").filter("s_a <> s_b and abs(length(s_a) - length(s_b)) <= 2").select("s_a", "s_b").distinct().withColumn("d", F.levenshtein("s_a", "s_b", 4))
    swapped = (F.col("d") >= 3) & (F.levenshtein(_letters("s_a"), _letters("s_b"), 2) >= 0)  # with a swap among two edits, the letters differ by one edit
    return cut(met_.filter("d between 1 and 2").unionByName(met_.filter(swapped).filter(within("s_a", "s_b"))).select("s_a", "s_b"))


def cut_packed(df: DataFrame) -> DataFrame:
    """``cut`` of many small rows: a checkpoint isn't compressed, so thousands of rows at a time are written as one compressed value."""

    def pack(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packed"])

    def unpack(batches):
        for b in batches:
            for value in b.column(0):
                yield from pa.ipc.open_stream(value.as_py())

    return cut(df.mapInArrow(pack, "packed binary")).mapInArrow(unpack, df.schema)


def firm_cells(firm: Column) -> Column:
    """Hashes of the beginnings of a firm's first word and of its first two written together, with each two of six letters left
    out; two firms that ``names.same_firm`` can hold for one share one."""
    letters = F.transform(F.array_distinct(F.array(F.get(firm, F.lit(0)), F.array_join(F.slice(firm, 1, 2), ""))), lambda w: F.rpad(F.substring(w, 1, 6), 6, "_"))
    less = lambda w: F.array(*[F.concat(*[F.substring(w, k, 1) for k in range(1, 7) if k not in (i, j)]) for j in range(2, 7) for i in range(1, j)])
    return F.array_distinct(F.transform(F.flatten(F.transform(letters, less)), lambda x: F.xxhash64(x)))


def often_given(words: DataFrame) -> DataFrame:
    """``w, n`` of the single ``words`` (``w`` as typed, ``given``: whether it stands where given names do) that are usual as given names,
    typos included."""
    return words.filter("w <> ''").groupBy(F.lower("w").alias("w")).agg(F.count_if("given").alias("n"), F.count_if(~F.col("given")).alias("other")).filter((F.col("n") >= LEAST_BEARERS) & (F.col("n") > RATHER * F.col("other"))).select("w", "n")


def usual_given_names(words: DataFrame) -> set[str]:
    """Usual given names among single ``words`` (see ``often_given``)."""
    return without_typos(often_given(words).collect())  # names, not people: their number is that of the languages' usual ones


def without_typos(rows: list) -> set[str]:
    """The names among ``w, n`` that aren't typos of others."""
    count: dict[str, int] = {}
    for r in rows:
        w = names.plain(r["w"])
        count[w] = count.get(w, 0) + r["n"]
    near: dict[str, list[str]] = {}
    out = set()
    for w in sorted(count, key=lambda w: (-count[w], w)):
        cells_ = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        typo = any(count[v] >= TYPO * count[w] and names.edits(v, w, 1) <= 1 for c in cells_ for v in near.get(c, ()))
        if not typo:
            out.add(w)
            for c in cells_:
                near.setdefault(c, []).append(w)
    return out


def without_typos_table(often: DataFrame) -> DataFrame:
    """``without_typos`` as a table ``w``: nothing comes to the driver. Each round decides the names that are near no more frequent name still
    undecided; a name's typos are ``TYPO`` times rarer, so there are few rounds."""

    @F.pandas_udf("string")
    def plain(w: pd.Series) -> pd.Series:
        return w.map(names.plain)

    count = cut(often.select(plain("w").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")))

    @F.pandas_udf("boolean")
    def near(v: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([names.edits(x, y, 1) <= 1 for x, y in zip(v, w)], dtype=bool)

    each = count.select("w", "n", F.explode(cells(F.col("w"), 1)).alias("cell"))
    met_ = each.select(F.col("w").alias("v"), F.col("n").alias("n_v"), "cell").join(each, "cell").filter((F.col("n_v") >= TYPO * F.col("n")) & (F.levenshtein("v", "w") <= 2)).select("v", "w").distinct()
    open_ = cut(met_.filter(near("v", "w")))
    typos = count.select("w").limit(0)
    while not open_.isEmpty():
        sure = cut(open_.join(open_.select(F.col("w").alias("v")).distinct(), "v", "left_anti").select("w").distinct())
        open_ = cut(open_.join(sure, "w", "left_anti").join(sure.select(F.col("w").alias("v")), "v", "left_anti"))
        typos = typos.unionByName(sure)
    return count.select("w").join(typos, "w", "left_anti")


def short_forms(read: DataFrame) -> list[tuple[str, str]]:
    """``short_form_table`` as a list."""
    return [tuple(r) for r in short_form_table(read).collect()]


def short_form_table(read: DataFrame) -> DataFrame:
    """``short, full``: a short form and its full name, learned from ``read`` (``given, surname, firm``): two given names that are neither alike nor equally
    frequent and occur more often than by chance under one surname in one firm.

    Every family counts, whatever its size: in one of more than ``FAMILY`` given names a pair has so much less weight that a name has no more
    weight in all than in a family of ``FAMILY``.
    """
    d = read.filter("length(given) > 1 and surname is not null and firm is not null")
    families = d.groupBy(F.xxhash64("surname", "firm").alias("f")).agg(F.array_sort(F.collect_set("given")).alias("g"))
    each = families.filter("size(g) > 1").select("g", F.greatest(F.lit(1), F.when(F.size("g") <= FAMILY, UNIT).otherwise(F.floor(F.lit(UNIT * (FAMILY - 1)) / (F.size("g") - 1)))).cast("long").alias("w"), F.explode("g").alias("a"))
    pairs = each.select("a", "w", F.explode(F.filter("g", lambda b: b > F.col("a"))).alias("b")).filter(F.levenshtein("a", "b") > 1).groupBy("a", "b").agg((F.sum("w") / UNIT).alias("c"))  # whole numbers until summed up: the order changes nothing
    ends = pairs.select(F.explode(F.array("a", "b")).alias("g"), "c").groupBy("g").agg(F.sum("c").alias("m"))
    total = pairs.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t"))
    often = families.select(F.explode("g").alias("given")).groupBy("given").agg(F.count(F.lit(1)).alias("o"))
    of = ends.join(often, ends["g"] == often["given"]).select("g", "m", "o")
    j = pairs.filter(F.col("c") >= SEEN).crossJoin(total).join(of.select(F.col("g").alias("a"), F.col("m").alias("ma"), F.col("o").alias("oa")), "a").join(of.select(F.col("g").alias("b"), F.col("m").alias("mb"), F.col("o").alias("ob")), "b")  # one row on the right
    sure = j.filter((2 * F.col("c") * F.col("t") >= LIFT * F.col("ma") * F.col("mb")) & (F.greatest("oa", "ob") >= RARER * F.least("oa", "ob")))
    rarer = F.col("oa") < F.col("ob")
    return sure.select(F.when(rarer, F.col("a")).otherwise(F.col("b")).alias("short"), F.when(rarer, F.col("b")).otherwise(F.col("a")).alias("full"))


def one_word(c: str) -> Column:
    return F.regexp_extract(c, r"(?U)^\s*([\p{L}'’-]{2,})\s*$", 1)


def _read_udf(lex):
    @F.pandas_udf("given string, surnames array<string>, firm array<string>")
    def read(first: pd.Series, last: pd.Series, company: pd.Series) -> pd.DataFrame:
        out = [(*names.read_person(f, l, lex.value), names.read_firm(c)) for f, l, c in zip(first, last, company)]
        return pd.DataFrame(out, columns=["given", "surnames", "firm"])

    return read


def _letters(c: Column | str) -> Column:
    """A string's letters in order of the alphabet."""
    return F.array_join(F.array_sort(F.split(c, "")), "")


def _within(x: Column, y: Column, edits: Column | int) -> Column:
    """Whether so many edits may lie between two strings, in built-in functions: a swap is two plain edits."""
    d = F.levenshtein(x, y, 4)
    return (d >= 0) & (d <= 2 * edits)


def may_be_firm(a: Column, b: Column) -> Column:
    """What two firms' words must fulfil for ``names.same_firm``, in built-in functions."""
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    ja, jb = F.array_join(F.slice(a, 1, 2), ""), F.array_join(F.slice(b, 1, 2), "")
    least = lambda p, q: F.least(F.length(p), F.length(q))
    return F.coalesce(_within(x, y, F.when(least(x, y) < FAR, 1).otherwise(2)) | (ja == jb) | ((least(ja, jb) >= FAR) & _within(ja, jb, F.lit(2))), F.lit(False))


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of people whose surnames share a cell, however many people that cell has. ``left``: ``a, s``, ``right``: ``b, s``; where
    both are one table, give the same table renamed, and keep ``a < b`` of the result."""
    key = lambda df, i: df.select(i, F.explode(cells(F.col("s"))).alias("cell"))
    return key(left, "a").join(key(right, "b"), "cell").select("a", "b")


def firm_keys(firms: DataFrame) -> DataFrame:
    """``two, fk, n`` (``n`` its rows) of each reading ``two`` of a firm (its first two words) among ``firms``: keys such that two readings that
    ``names.same_firm`` holds for one firm share one. A reading's keys are itself and the more frequent ones like it: most
    have one or two. Readings meet by cells of their first word and of both written together."""
    r = firms.groupBy("two").agg(F.count(F.lit(1)).alias("n")).withColumn("f", F.xxhash64("two"))
    texts = F.array_distinct(F.array(F.get("two", F.lit(0)), F.array_join("two", "")))
    near = F.flatten(F.transform(texts, lambda t: F.concat(cells(t), F.coalesce(far_cells(t, NEARER), F.array().cast("array<bigint>")))))
    n = int(firms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = r.select("two", "n", "f", F.explode(F.array_distinct(near)).alias("cell")).repartition(n, "cell")  # few bytes, but much to compare: in as many parts as anything else
    one = keys.select(F.col("two").alias("two_a"), F.col("n").alias("n_a"), F.col("f").alias("f_a"), "cell")
    other = keys.select(F.col("two").alias("two_b"), F.col("n").alias("n_b"), F.col("f").alias("f_b"), "cell")

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([names.same_firm(list(x), list(y)) for x, y in zip(a, b)], dtype=bool)

    up = (F.col("n_b") > F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("f_b") > F.col("f_a")))
    like = one.join(other, "cell").filter(up).filter(may_be_firm(F.col("two_a"), F.col("two_b"))).filter(same("two_a", "two_b")).select("two_a", "n_a", "two_b", "f_b").distinct()
    return r.select("two", F.col("f").alias("fk"), "n").unionByName(like.select(F.col("two_a").alias("two"), F.col("f_b").alias("fk"), F.col("n_a").alias("n")))


def _less(w: str) -> frozenset:
    """What two surnames that ``names.same_surname`` holds for one share: ``cells`` and ``far_cells`` in Python, within one firm."""
    out = {w} if len(w) < FAR else set()
    if 4 <= len(w) <= FAR:
        out |= {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(w) >= FAR:
        out |= set(itertools.combinations(w[:NEARER], NEARER - 2))
    return frozenset(out)


def block_pairs(people: list[tuple], lex: names.Lexicon) -> list[tuple]:
    """``a, b, lid_a, lid_b`` (``a < b``) of the people ``pid, lid, given, surnames, two`` of one block that are the same by name and firm and
    have no differing profile ids."""
    if len(people) < 2:
        return []
    people = sorted({p[0]: p for p in people}.values(), key=lambda p: p[0])
    at: dict = {}
    given: dict[tuple, bool] = {}
    firm: dict[tuple, bool] = {}
    out = []
    for n, (pid, lid, g, sur, two) in enumerate(people):
        keys = {k for s in sur.split() for k in _cached_less(s)}
        for m in {m for k in keys for m in at.get(k, ())}:
            qid, lid_q, h, sur_q, two_q = people[m]
            if lid is not None and lid_q is not None and lid != lid_q:
                continue
            if (same := given.get((h, g))) is None:
                same = given[h, g] = names.same_given(h, g, lex)
            if not same or not names.same_surname(sur_q.split(), sur.split()):
                continue
            if (same := firm.get((two_q, two))) is None:
                same = firm[two_q, two] = names.same_firm(two_q.split(), two.split())
            if same:
                out.append((qid, pid, lid_q, lid))
        for k in keys:
            at.setdefault(k, []).append(n)
    return out


_cached_less = lru_cache(maxsize=names._CACHED)(_less)


def _meet_in_blocks(keyed: DataFrame, lex) -> DataFrame:
    """``a, b, lid_a, lid_b`` of the people ``pid, lid, given, surnames, two`` of each block ``k`` that are the same; each block is read by one task
    and nothing but what is found leaves it."""

    def run(parts):
        k, block = None, []
        columns = ["a", "b", "lid_a", "lid_b"]
        for df in parts:
            out = []
            lids = [None if none else lid for lid, none in zip(df["lid"].tolist(), df["none"].tolist())]
            for key, *person in zip(df["k"].tolist(), df["pid"].tolist(), lids, df["given"].tolist(), df["surnames"].tolist(), df["two"].tolist()):
                if key != k:
                    out += block_pairs(block, lex.value)
                    k, block = key, []
                block.append(tuple(person))
            yield _frame(out, columns)
        yield _frame(block_pairs(block, lex.value), columns)

    rows = keyed.select("k", "pid", F.coalesce("lid", F.lit(0)).alias("lid"), F.col("lid").isNull().alias("none"), "given", "surnames", "two")
    return rows.repartition("k").sortWithinPartitions("k").mapInPandas(run, "a long, b long, lid_a long, lid_b long")


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Numbers that may be missing stay whole numbers."""
    return pd.DataFrame({c: pd.array([r[i] for r in rows], dtype="Int64") for i, c in enumerate(columns)})


def link_people(df: DataFrame) -> DataFrame:
    """``row_id_a, row_id_b`` (smaller first) of rows that mean the same person in the same firm and differ literally in
    ``FirstName``, ``LastName`` or ``Company``.

    Rows are linked if their profile ids are equal, or if given name, surname and firm agree within a typo and their
    profile ids don't differ; rows without profile id also join the one profile their name agrees with. A row without
    given name, surname or firm is linked by profile id only. Repeated ``row_id`` give no pair with themselves; other columns are ignored.
    """
    spark = df.sparkSession
    words = df.select(F.explode(F.array(F.struct(one_word("FirstName").alias("w"), F.lit(True).alias("given")), F.struct(one_word("LastName").alias("w"), F.lit(False).alias("given")))).alias("x")).select("x.*")
    usual = usual_given_names(words)
    lex = spark.sparkContext.broadcast(names.Lexicon.of(usual))
    mark = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = (
        df.select("row_id", "FirstName", "LastName", "Company", profile_id("LinkedInURL").alias("lid"))
        .withColumn("tid", F.xxhash64(F.col("FirstName").isNull(), mark("FirstName"), F.col("LastName").isNull(), mark("LastName"), F.col("Company").isNull(), mark("Company")))
        .withColumn("pid", F.xxhash64("tid", F.col("lid").isNull(), mark("lid")))
    )
    # written once in few bytes a row: a name's words stand side by side in one text, a profile id is a number
    people = rows.select("pid", F.when(F.col("lid").isNotNull(), F.xxhash64("lid")).alias("lid"), _read_udf(lex)("FirstName", "LastName", "Company").alias("p"))
    people = cut_packed(people.select("pid", "lid", "p.given", F.array_join("p.surnames", " ").alias("surnames"), F.array_join(F.slice("p.firm", 1, 2), " ").alias("two")))
    first = lambda c: F.nullif(F.substring_index(c, " ", 1), F.lit(""))
    lex = spark.sparkContext.broadcast(names.Lexicon.of(usual, short_forms(people.select("given", first("surnames").alias("surname"), first("two").alias("firm")))))
    named = people.filter("given <> '' and surnames <> '' and two <> ''")
    keys = firm_keys(named.select(F.split("two", " ").alias("two")))
    members = keys.groupBy("fk").agg(F.sum("n").alias("members"))
    keys = cut(keys.join(members, "fk").select(F.array_join("two", " ").alias("two"), "fk", "members"))  # of firms, not of people
    keyed = named.join(keys, "two")
    here = lambda cs: F.flatten(F.transform(F.split("surnames", " "), lambda s: F.coalesce(cs(s), F.array().cast("array<bigint>"))))
    # the beginnings of surnames that agree share a cell, as the surnames do; of longer ones than FAR, whatever lies within an edit has FAR letters and shares a cell below
    begins = F.array_distinct(F.concat(here(lambda s: F.when(F.length(s) <= FAR, cells(F.substring(s, 1, BEGINS)))), here(lambda s: far_cells(s, BEGINS_FAR))))
    blocks = F.when(F.col("members") <= BLOCK, F.array("fk")).otherwise(F.transform(begins, lambda c: F.xxhash64(c, "fk")))
    near = _meet_in_blocks(keyed.select("pid", "lid", "given", "surnames", "two", F.explode(blocks).alias("k")), lex)
    # people of one profile are candidates, too; that they are of one firm is checked
    owned = people.filter("lid is not null").groupBy("lid").agg(F.collect_set(F.struct("pid", "two")).alias("g")).filter("size(g) > 1")
    by_id = owned.select("lid", "g", F.explode("g").alias("a")).select("lid", "a", F.explode("g").alias("b")).filter("a.pid < b.pid")
    firm = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    by_id = by_id.filter((F.col("a.two") == "") | (F.col("b.two") == "") | may_be_firm(firm("a.two"), firm("b.two"))).select(F.col("a.pid").alias("a"), F.col("b.pid").alias("b"), F.col("lid").alias("lid_a"), F.col("lid").alias("lid_b"))
    alike = cut(near.unionByName(by_id).distinct())
    # people without a profile id take on that of the one profile they agree with
    both = alike.unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("lid_b").alias("lid_a"), F.col("lid_a").alias("lid_b")))
    taken = both.filter("lid_a is null and lid_b is not null").groupBy("a").agg(F.min("lid_b").alias("l"), F.max("lid_b").alias("l2")).filter("l = l2").select(F.col("a").alias("pid"), "l")
    ids_of = people.filter("lid is not null").select("pid", F.col("lid").alias("l"))
    joined = taken.select(F.col("pid").alias("x"), "l").join(ids_of.unionByName(taken).withColumnRenamed("pid", "y"), "l").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    links = alike.select("a", "b").unionByName(joined).distinct()
    ids = rows.select("pid", "tid", "row_id")
    return (
        links.join(ids.select(F.col("pid").alias("a"), F.col("tid").alias("ta"), F.col("row_id").alias("ra")), "a")
        .join(ids.select(F.col("pid").alias("b"), F.col("tid").alias("tb"), F.col("row_id").alias("rb")), "b")
        .filter("ra <> rb and ta <> tb")
        .select(F.least("ra", "rb").alias("row_id_a"), F.greatest("ra", "rb").alias("row_id_b"))
        .distinct()
    )
