"""Freely typed values mapped to a reference list by a prefix-filtered set-similarity join.

The list is bounded (``MOST_ENTRIES``) and is read into variants: each entry's spellings, and, as job titles are a rank
and an area of work, the combinations of each region's words for a rank with its words for an area. Which words of an
entry name the rank is learned from the list: rank words occur with most functions, area words with few.

Typed values are folded, freed of marks, numbers and asides, and their abbreviations are spelt out from the list's
words. Distinct results are joined with the variants on character trigrams: trigrams are ordered by their rarity in
all values, only the rarest prefix of each side is joined, length and position bound the overlap that is still
possible, Jaccard is verified on the whole sets, and the best variant is kept if an edit distance confirms that
neither its rank nor a word of its area differs. All else maps to the empty string.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import is_blank
from rankloom.session import cut

#: Variants of entries (ranks, areas and regions combined) that are sent to every task; more are joined like any table.
MOST_VARIANTS = 300_000
#: Least Jaccard of trigrams; entries of the list at most; share of the functions from which on a word names a rank.
JACCARD, MOST_ENTRIES, RANK_SPREAD = 0.6, 50_000, 0.4

#: Words without meaning of their own in titles (fixed values).
FUNCTION_WORDS = frozenset("a al and d das de del der des die du el en et for fur if im in l la las le les los of pour the und van von y".split())
#: Usual short forms of ranks (fixed values).
SHORT_FORMS = {
    "svp": "senior vice president", "evp": "executive vice president", "avp": "assistant vice president", "vp": "vice president", "sr": "senior", "snr": "senior", "jr": "junior", "dir": "director", "drctr": "director", "mgr": "manager", "mngr": "manager",
    "hd": "head", "chf": "chief", "off": "officer", "offr": "officer", "ofcr": "officer", "pres": "president", "anl": "analyst", "anlst": "analyst", "anlyst": "analyst", "coord": "coordinator", "coordntr": "coordinator", "asst": "assistant", "assoc": "associate",
}
#: Asides that say nothing of rank or area (fixed values).
ASIDES = re.compile(r"\b(?:and |& )?deputy site lead\b|\bon leave\b|\b(?:ad )?interim\b|\bacting\b|\bregional\b|\bgroup\b|\b(?:north|south|east|west|apac|emea|iberia|latam|dach|nordics?|benelux|americas|mena)\b(?= *$)|\b(?:plant|site|unit|building|branch) *\d+|#? *\d+")


def fold(s: str) -> str:
    """Lower case without accents; ligatures and strokes spelt out."""
    s = unicodedata.normalize("NFKD", s).translate(_LETTERS)
    return "".join(c for c in s if not unicodedata.combining(c)).casefold()


#: Letters that don't decompose (fixed values).
_LETTERS = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "ı": "i", "ŋ": "n"})


def words(s: str, camel: bool = False) -> list[tuple[str, bool]]:
    """Folded words of a text without function words, each with whether a full stop followed it."""
    s = re.sub(r"\bco-ordinat", "coordinat", s, flags=re.I)
    if camel:
        s = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z][a-z])", " ", s)
    s = fold(s.replace("’", "'"))
    s = re.sub(r"[_\s]+", " ", s)
    s = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m.group().replace(".", "") + " ", s)
    s = ASIDES.sub(" ", s)
    out = []
    for w, dot in re.findall(r"([^\W_]+(?:'[^\W_]+)*)(\.?)", s):
        head, _, tail = w.partition("'")
        if tail and (len(head) > 1 and len(tail) > 2 or head in "dlnsc"):
            out += [(x, False) for x in w.split("'")]
        else:
            out += [(x, bool(dot)) for x in SHORT_FORMS.get(w, w).split()]
    return [x for x in out if x[0] not in FUNCTION_WORDS and x[0]]


class Reference:
    """The list, read into variants; small enough to be sent to every task."""

    def __init__(self, rows: list[dict], value: str = "normalized_title", spellings: tuple[str, ...] = ("title_raw", "title_native"), region: str = "region", function: str = "function"):
        if len(rows) > MOST_ENTRIES:
            raise ValueError(f"the list has {len(rows)} rows; {MOST_ENTRIES} at most are broadcast")
        rows = [r for r in rows if r.get(value)]
        spread: dict[str, set] = defaultdict(set)
        n = len({r.get(function) for r in rows}) or 1
        for r in rows:
            for c in (value, *spellings):
                for w, _ in words(r.get(c) or ""):
                    spread[w].add(r.get(function))
        ranks = {w for w, f in spread.items() if len(f) >= RANK_SPREAD * n}

        def parts(s: str) -> tuple[tuple, tuple]:
            t = [w for w, _ in words(s)]
            return tuple(w for w in t if w in ranks), tuple(w for w in t if w not in ranks)

        self.of: dict[str, str] = {}  # variant: value
        taken: Counter = Counter()
        by = {parts(r[value]): r[value] for r in rows}
        rank_forms: dict[str, dict[tuple, Counter]] = defaultdict(lambda: defaultdict(Counter))
        area_forms: dict[str, dict[tuple, Counter]] = defaultdict(lambda: defaultdict(Counter))
        for r in rows:
            rank, area = parts(r[value])
            self._put(r[value], r[value])
            for c in (value, *spellings):
                s = r.get(c)
                if not s:
                    continue
                self._put(s, r[value])
                own_rank, own_area = parts(s)
                place = "" if c != spellings[-1] or own_area == area else str(r.get(region))
                if own_rank and own_area:
                    rank_forms[place][rank][own_rank] += 1
                    area_forms[place][area][own_area] += 1
        for place, forms in rank_forms.items():
            for rank, rs in forms.items():
                for area, ns in area_forms[place].items():
                    if (rank, area) not in by:
                        continue
                    for a, k in rs.items():
                        for b, m in ns.items():
                            if k * 20 < sum(rs.values()) or m * 4 < sum(ns.values()):  # odd ones
                                continue
                            for v in {" ".join([*a, *b]), " ".join([*b, *a])} | ({" ".join([a[0], *b, *a[1:]])} if len(a) > 1 else set()):
                                taken[(v, by[(rank, area)])] += 1
        for (v, t), _ in sorted(taken.items(), key=lambda x: (-x[1], x[0])):
            self.of.setdefault(v, t)
        self.vocabulary = Counter(w for v in self.of for w in v.split())
        self.together: dict[str, set] = defaultdict(set)
        for v in self.of:
            for w in v.split():
                self.together[w] |= set(v.split())
        self.ranks = ranks
        self.by_first: dict[str, list[str]] = defaultdict(list)
        self.shortened: dict[str, set[str]] = defaultdict(set)
        self.longest = max(map(len, self.vocabulary), default=0)
        for w in self.vocabulary:
            self.by_first[w[0]].append(w)
            for x in _shortened(w):
                self.shortened[x].add(w)

    def _put(self, s: str, value: str) -> None:
        v = " ".join(w for w, _ in words(s))
        if v:
            self.of.setdefault(v, value)

    def spell_out(self, w: str, dot: bool, others: list[str]) -> str:
        """A word of the list that ``w`` abbreviates, or ``w``."""
        if w in self.vocabulary and not dot:
            return w
        if w in self.vocabulary or len(w) < 2:
            return w
        found = []
        for v in self.by_first.get(w[0], []):
            if len(v) <= len(w) + 1:
                continue
            if "'" in w:
                head, _, tail = w.partition("'")
                if v.startswith(head) and v.endswith(tail):
                    found.append(v)
            elif dot and v.startswith(w) or len(w) >= 3 and len(w) <= 0.8 * len(v) and sum(c in "aeiouy" for c in w[1:]) <= len(w) // 4 and _within(w, v):
                found.append(v)
        if not found:
            return w
        known = [o for o in others if o in self.together]
        return max(found, key=lambda v: (sum(v in self.together[o] for o in known if o not in self.ranks), sum(v in self.together[o] for o in known), self.vocabulary[v], v))

    def like(self, w: str) -> bool:
        """Whether a word of the list is at most one edit (from seven letters on, two) from ``w``."""
        most = 1 if len(w) < 7 else 2
        if len(w) > self.longest + most:
            return False
        return w in self.vocabulary or any(_near(w, v, most) for v in {v for x in _shortened(w) for v in self.shortened.get(x, ())})

    def read(self, s: str) -> list[str]:
        """The forms in which a typed value is looked up: as typed and spelt out, with joined words cut, and without words unlike any of the list."""
        forms = []
        for camel in (False, True):
            ws = words(s, camel)
            plain = [w for w, _ in ws]
            out = [self.spell_out(w, dot, [p for p in plain if p != w]) for w, dot in ws]
            for x in (out, plain):
                forms.append(" ".join(x))
            if not any(f in self.of for f in forms):
                forms.append(" ".join(w for w in out if self.like(w)))
        return [f for f in dict.fromkeys(forms) if f]


def _shortened(w: str) -> set[str]:
    """``w`` with none, one or (from seven letters on) two letters left out: words within as many edits share one of them."""
    one = {w[:i] + w[i + 1 :] for i in range(len(w))}
    return {w} | one | ({x[:i] + x[i + 1 :] for x in one for i in range(len(x))} if len(w) >= 7 else set())


def _within(w: str, v: str) -> bool:
    """Whether the letters of ``w`` occur in ``v`` in that order."""
    it = iter(v)
    return all(c in it for c in w)


def _near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits (insert, delete, replace, swap of neighbours) turn ``a`` into ``b``."""
    if abs(len(a) - len(b)) > most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 1)
            row.append(c)
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


def _trigrams(c):
    s = F.concat(F.lit("^"), F.regexp_replace(c, " ", ""), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - 2)), lambda i: F.substring(s, i, F.lit(3))))


def _prefixes(df: DataFrame, key: str, t: float) -> DataFrame:
    """``df`` (key, size, grams: array of (rank, gram) from the rarest) as rows of its prefix: key, size, gram, pos."""
    return df.select(key, "size", F.posexplode(F.slice("grams", 1, (F.col("size") - F.ceil(F.col("size") * t) + 1).cast("int"))).alias("pos", "g")).select(key, "size", "pos", F.col("g.gram").alias("gram"))


def _squash(c: str):
    return F.regexp_replace(c, " ", "")


def similar_pairs(left: DataFrame, right: DataFrame, t: float = JACCARD, edits: int = 4, broadcast_right: bool = False) -> DataFrame:
    """``l, r, jaccard, edits`` of all pairs of strings (columns ``l`` and ``r``, distinct) whose trigram sets have Jaccard
    ``t`` or more and between which, spaces aside, lie at most ``edits`` edits."""
    sets = [df.select(c, _trigrams(F.col(c)).alias("set")) for df, c in ((left, "l"), (right, "r"))]
    freq = sets[0].select(F.explode("set").alias("gram")).unionByName(sets[1].select(F.explode("set").alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def ordered(df: DataFrame, c: str) -> DataFrame:
        return df.select(c, F.explode("set").alias("gram")).join(freq, "gram").groupBy(c).agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams")).withColumn("size", F.size("grams"))

    ls, rs = cut(ordered(sets[0], "l")), cut(ordered(sets[1], "r"))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lp = _prefixes(ls.repartition(n, "l"), "l", t).withColumn("lq", _squash("l")).withColumn("ln", F.length("lq"))
    rp = _prefixes(rs, "r", t).select("r", F.col("size").alias("rsize"), F.col("pos").alias("rpos"), "gram").withColumn("rq", _squash("r")).withColumn("rn", F.length("rq"))
    need = F.ceil((F.col("size") + F.col("rsize")) * (t / (1 + t)))
    # the edit distance is the cheaper of the two verifications, so it comes first
    pairs = (
        lp.join(F.broadcast(rp) if broadcast_right else rp, "gram")
        .filter((F.abs(F.col("ln") - F.col("rn")) <= edits) & (F.col("rsize") >= F.col("size") * t) & (F.col("size") >= F.col("rsize") * t))
        .filter(F.least(F.col("size") - F.col("pos"), F.col("rsize") - F.col("rpos")) >= need - F.least("pos", "rpos"))
        .withColumn("edits", F.levenshtein("lq", "rq", edits))
        .filter("edits >= 0")
        .select("l", "r", "edits")
        .distinct()
    )
    # sets are joined to the few pairs left: computed from the strings, the optimiser would do so within the join above
    both = F.size(F.array_intersect("lg", "rg"))
    j = both / (F.col("size") + F.col("rsize") - both)
    rg = rs.select("r", F.col("grams.gram").alias("rg"), F.col("size").alias("rsize"))
    return (
        pairs.join(ls.select("l", F.col("grams.gram").alias("lg"), "size"), "l")
        .join(F.broadcast(rg) if broadcast_right else rg, "r")
        .select("l", "r", "edits", j.alias("jaccard"))
        .filter(F.col("jaccard") >= t)
    )


def map_values(df: DataFrame, reference: DataFrame, id_col: str = "row_id", value_col: str = "Designation") -> DataFrame:
    """``row_id, normalized_title`` of each row whose value isn't null, blank or literally a ``title_raw`` of the list.

    ``normalized_title`` is ``''`` where the list has no such rank and area. Repeated rows come out as often as they
    come in; an empty list maps all to ``''``; other columns are ignored. Of equally near variants the first in alphabet is taken.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = reference.select("title_raw", "title_native", "region", "normalized_title", "function").limit(MOST_ENTRIES + 1)
    ref = Reference([r.asDict() for r in entries.collect()])
    b = spark.sparkContext.broadcast(ref)
    small = len(ref.of) <= MOST_VARIANTS
    sent = F.broadcast if small else (lambda x: x)

    @F.pandas_udf("array<string>")
    def read(s: pd.Series) -> pd.Series:
        return pd.Series([b.value.read(x) for x in s], dtype=object)

    raw = entries.select(F.col("title_raw").alias("v")).filter("v is not null").distinct()
    rows = df.select(F.col(id_col).alias("row_id"), F.col(value_col).alias("v")).filter(~is_blank("v")).join(F.broadcast(raw), "v", "left_anti")
    typed = cut(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).repartition(n, "v").select("v", read("v").alias("forms")))
    forms = cut(typed.select(F.explode("forms").alias("l")).distinct())
    variants = spark.createDataFrame(sorted(ref.of.items()) or [("", "")], "r string, t string")
    same = forms.join(sent(variants), F.col("l") == F.col("r")).select("l", "t", F.lit(0).alias("edits"), F.lit(1.0).alias("jaccard"), "r")
    rest = forms.join(sent(variants), F.col("l") == F.col("r"), "left_anti").filter(F.length(_squash("l")) <= max(map(len, ref.of), default=0) + 4)  # longer ones are more than four edits from every variant
    near = similar_pairs(rest, variants.select("r"), broadcast_right=small)
    most = F.least(F.lit(4), F.floor(F.length(_squash("r")) / 7))
    near = near.filter(F.col("edits") <= most).join(sent(variants), "r").select("l", "t", "edits", "jaccard", "r")
    best = same.unionByName(near).groupBy("l").agg(F.min_by("t", F.struct("edits", -F.col("jaccard"), "r")).alias("t"), F.min("edits").alias("edits"))
    meant = typed.select("v", F.posexplode("forms").alias("pos", "l")).join(best, "l").groupBy("v").agg(F.min_by("t", F.struct("edits", "pos")).alias("t"))
    return rows.join(meant, "v", "left").select("row_id", F.coalesce("t", F.lit("")).alias("normalized_title"))
