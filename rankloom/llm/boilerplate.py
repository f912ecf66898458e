"""The main body of pages, without site furniture.

Template deduction by equivalence classes. Lines are tokens, freed of numbers and of the page's own firm; the second
line of one wording on a page is another token than the first. Pages of one host are dealt into groups of about
``GROUP``, so that a host of any size is worked on in bounded pieces, and a cut or changed page spoils but its own
group. In a group, tokens of the same occurrence vector form a class. A class joins the group's template if it has
enough tokens and pages, if enough of its pages differ in the rarer lines beside it (copies of one text don't), if its
tokens keep their order on every page, and if they keep their gap within every wider class they are nested in.
Lines of the template are furniture whatever their wording; a line that names the page's own person is a slot.

What the templates leave are slots: the main body, but also teasers, notices put in at random and furniture of hosts
with too few pages. Which slot is which is learned from the templates, no wording being given. Over the whole corpus,
each skeleton (a line with numbers, names and capitalised words left open) is counted: how often it stands between
lines of a template. Skeletons that do are furniture; those that recur and never do are content. With these and the
templates as labels, a model of three roles (furniture, teaser, content) in sequence is fitted by expectation
maximisation on a bounded sample of pages: a softmax over the words and form of a line, and transitions between roles.
It gives every line of every page its most probable role; template lines stay what they are.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import is_blank
from rankloom.session import cut

#: Least tokens and pages of a class; pages of a host dealt into one group.
CLASS_TOKENS, CLASS_PAGES, GROUP = 3, 3, 16
#: Bounds of the labelled sample: pages, and characters of a page.
SAMPLE_PAGES, SAMPLE_CHARS = 3_000, 20_000
#: A skeleton is furniture from this share of occurrences between template lines, content below the second, if it occurs ``RECURS`` times or more outside
#: templates and ``CASES`` times between. One that is in templates in ``BOTH`` of its occurrences and amid open lines in ``INSIDE`` of the others is left to its place.
BETWEEN, NEVER, RECURS, CASES, BOTH, INSIDE = 0.04, 0.02, 6, 3, 0.1, 0.5
#: Slots of the hashed features, rounds of expectation maximisation, steps of a fit, its penalty.
BUCKETS, ROUNDS, STEPS, PENALTY = 1 << 17, 3, 40, 2e-6
FURNITURE, TEASER, CONTENT = 0, 1, 2
#: Signs from which on a whole line that no label holds for furniture speaks for content, while the roles are fitted.
LONG = 100

_WORD = re.compile(r"\w+|[^\w\s]+")
_NUMBER = re.compile(r"\d[\d.,]*")
#: A line that breaks off, perhaps with a link of two words behind.
_CUT_OFF = re.compile(r"(?:…|\.\.\.|\[…\])\W*(?:\w+ \w+)?\W*$")
_CACHED = 200_000  #: keys that a ``Memory`` holds


def own_words(firm: str | None, person: str | None) -> list[tuple[str, str]]:
    """What stands for the page's person and firm in its lines: full names and longer words of the person, the firm's first word."""
    out = []
    if person and len(person) > 3:
        out += [(person, "personx")] + [(w, "personx") for w in person.split() if len(w) > 3]
    if firm and len(firm) > 3:
        out += [(firm, "firmx")] + [(w, "firmx") for w in firm.split()[:1] if len(w) > 3]
    return out


def token(line: str, own: list[tuple[str, str]]) -> str:
    """A line as a token of a template."""
    s = line.strip().lower()
    for w, x in own:
        s = s.replace(w.lower(), x)
    return re.sub(r"\s+", " ", _NUMBER.sub("0", s)).replace("personx personx", "personx")


def skeleton(line: str, own: list[tuple[str, str]]) -> str:
    """A line with its numbers, names and capitalised words, but for the first word, left open."""
    s = line.strip()
    for w, x in own:
        s = s.replace(w, f" {x} ")
    out: list[str] = []
    seen = False
    for w in _WORD.findall(re.sub(r"\d+", "0", s)):
        if w[0].isupper() and seen:
            if out[-1] != "X":
                out.append("X")
            continue
        seen = seen or w[0].isalpha()
        out.append(w.lower())
    return " ".join(out)


def _mine(line: str, own: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Those of ``own`` that occur in the line."""
    low = line.lower()
    return [x for x in own if x[0].lower() in low]


class Memory(dict):
    """What was computed of a key; emptied when it holds ``_CACHED`` keys, which bounds memory and changes no result."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key):
        if len(self) >= _CACHED:
            self.clear()
        v = self[key] = self.f(key)
        return v


def _id(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def non_blank(text: str) -> list[tuple[int, str]]:
    """Numbered lines, from 1, that aren't blank."""
    return [(i, l) for i, l in enumerate(text.split("\n"), 1) if l.strip() and l.strip().lower() != "nan"]


def in_order(ranks: list[int]) -> list[int]:
    """A longest rising part of a page's tokens, given as ranks in the class's usual order."""
    ends: list[int] = []  # by length of the part, its least last rank
    best: list[list] = []
    for r in ranks:
        i = bisect.bisect_left(ends, r)
        part = [r, best[i - 1] if i else None]
        if i == len(ends):
            ends.append(r)
            best.append(part)
        else:
            ends[i], best[i] = r, part
    out, part = [], best[-1] if best else None
    while part:
        out.append(part[0])
        part = part[1]
    return out[::-1]


def deduce(pages: list[tuple[object, list[tuple[str, str]]]]) -> list[set[int]]:
    """Of each page of a group (its address, and its lines as token and raw text) the places of the lines that belong to the template."""
    at: list[dict] = []
    where: dict = defaultdict(int)
    for d, (_, lines) in enumerate(pages):
        nth: Counter = Counter()
        places = {}
        for j, (t, _) in enumerate(lines):
            nth[t] += 1
            if "personx" not in t:
                places[t, nth[t]] = j
                where[t, nth[t]] |= 1 << d
        at.append(places)
    by_vector: dict = defaultdict(list)
    for k, v in where.items():
        if v.bit_count() >= CLASS_PAGES:
            by_vector[v].append(k)
    found: list[tuple[int, list]] = []
    marks: list[set[int]] = [set() for _ in pages]
    for v in sorted(by_vector, key=lambda v: (-v.bit_count(), v)):
        tokens = by_vector[v]
        on = [d for d in range(len(pages)) if v >> d & 1]
        if len(tokens) < CLASS_TOKENS or len({pages[d][0] for d in on}) < CLASS_PAGES:
            continue
        beside = set()
        for d in on:
            nth = Counter()
            rest = []
            for t, raw in pages[d][1]:
                nth[t] += 1
                if where.get((t, nth[t]), 0).bit_count() < v.bit_count():
                    rest.append(raw)
            if rest:
                beside.add(tuple(rest))
        if len(beside) < CLASS_PAGES:
            continue
        tokens = sorted(tokens, key=lambda k: at[on[0]][k])
        rank = {k: r for r, k in enumerate(tokens)}
        kept = set(rank.values())
        for d in on:
            kept &= set(in_order([rank[k] for k in sorted(tokens, key=at[d].__getitem__)]))
        tokens = [k for k in tokens if rank[k] in kept]
        for wide, nest in found:
            if wide & v == v:
                ends = [sorted(at[d][k] for k in nest) for d in on]
                tokens = [k for k in tokens if len({bisect.bisect_left(e, at[d][k]) for d, e in zip(on, ends)}) == 1]
        if len(tokens) >= CLASS_TOKENS:
            found.append((v, tokens))
            for d in on:
                marks[d].update(at[d][k] for k in tokens)
    return marks


_MARKED = "entry_id long, host long, text string, firm string, name string, pages int, template array<boolean>, skeletons array<long>, cut_off array<boolean>"


def _template_udf(templates: bool):
    """Rows sorted by group in, marked rows out; a group is held whole, and it is bounded by how pages are dealt."""

    read = lambda l, own: (token(l, own), _id(skeleton(l, own)), bool(_CUT_OFF.search(l)) and len(l) > 25)
    common = Memory(lambda l: read(l, []))

    def finish(rows: list) -> list:
        seen, pages, out = set(), [], []
        for r in rows:
            if (r.entry_id, r.text) not in seen:
                seen.add((r.entry_id, r.text))
                pages.append(r)
        several = len({r.page for r in pages}) if pages and pages[0].host is not None else 0
        learn = templates and several >= CLASS_PAGES
        lines = [[l for _, l in non_blank(r.text)] for r in pages]
        facts = []
        for r, ls in zip(pages, lines):
            own = own_words(r.firm, r.name)
            facts.append([read(l, mine) if (mine := _mine(l, own)) else common[l] for l in ls] if learn else [])
        marks = deduce([(r.page, [(f[0], l) for f, l in zip(fs, ls)]) for r, fs, ls in zip(pages, facts, lines)]) if learn else [set()] * len(pages)
        for r, ls, fs, m in zip(pages, lines, facts, marks):
            out.append((r.entry_id, r.host, r.text, r.firm, r.name, several, [j in m for j in range(len(ls))], [f[1] for f in fs] if m else [], [f[2] for f in fs] if m else []))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key, done = [], None, []
        columns = [c.split()[0] for c in _MARKED.split(", ")]
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for r in pdf.itertuples(index=False):
                if (r.host, r.g) != key:
                    done += finish(held)
                    held, key = [], (r.host, r.g)
                held.append(r)
                if len(done) >= 2_000:
                    yield pd.DataFrame(done, columns=columns)
                    done = []
        done += finish(held)
        if done:
            yield pd.DataFrame(done, columns=columns)

    return run


def features(line: str, own: list[tuple[str, str]]) -> np.ndarray:
    """Hashed features of a line: its words, pairs of words, wording as a whole, and form."""
    s, t, k = line.strip(), token(line, own), skeleton(line, own)
    w = k.split(" ")
    last = k[-1:]
    end = "cut" if _CUT_OFF.search(s) else "." if last in tuple(".!?。»”\"") else "w" if last.isalnum() else "c"
    size = int(np.log2(len(s) + 1) * 1.5)
    f = ["L%d" % size, "E" + end, "LE%d%s" % (size // 2, end), "S" + (s[0] if not s[0].isalnum() else "a"), "U" if s.isupper() else "u", "T" + k, "t" + t, "1" + " ".join(w[:2]), "2" + " ".join(w[-2:])]
    if "personx" in k:
        f.append("P")
    if "firmx" in k:
        f.append("F")
    f += ["w" + x for x in set(w)]
    f += ["b" + x + " " + y for x, y in set(zip(w, w[1:]))]
    return np.array([_bucket[x] for x in f], np.int64)


_bucket = Memory(lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS)


def place_features(j: int, n: int, gap: bool) -> list[int]:
    """Features of a line's place on its page."""
    return [zlib.crc32(x) % BUCKETS for x in (b"top%d" % min(j, 4), b"end%d" % min(n - 1 - j, 4), b"gap%d" % gap)]


def forward_backward(em: np.ndarray, starts: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the roles of all lines of many pages at once (``starts``: first lines, then the number of lines), and expected transitions."""
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    begin, size = starts[:-1][order], size[order]
    alpha, beta, c = np.empty_like(em), np.ones_like(em), np.ones(len(em))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # pages longer than t
    for t in range(longest):
        i = begin[: active[t]] + t
        v = em[i] * (first if t == 0 else alpha[i - 1] @ step)
        c[i] = v.sum(1)
        alpha[i] = v / c[i, None]
    moves = np.zeros_like(step)
    for t in range(longest - 2, -1, -1):
        i = begin[: active[t + 1]] + t
        nxt = em[i + 1] * beta[i + 1] / c[i + 1, None]
        beta[i] = nxt @ step.T
        moves += (alpha[i].T @ nxt) * step
    post = alpha * beta
    return post / post.sum(1, keepdims=True), moves


class Roles:
    """The fitted model of roles."""

    def __init__(self, weights: np.ndarray, prior: np.ndarray, step: np.ndarray, first: np.ndarray):
        self.weights, self.prior, self.step, self.first = weights, prior, step, first

    def emissions(self, z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True) / self.prior + 1e-12


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in parts])
    row = np.repeat(np.arange(len(parts)), n)
    return np.concatenate(parts), row, (3 / np.sqrt(n))[row]


def _fit(index, row, value, target, weights) -> np.ndarray:
    """Softmax regression by adaptive gradient steps; returns the probabilities, changes the weights."""
    n, k = target.shape
    grown = np.full(weights.shape, 1e-9)
    for _ in range(STEPS):
        z = np.stack([np.bincount(row, weights[index, s] * value, n) for s in range(k)], 1)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p - target
        for s in range(k):
            g = np.bincount(index, d[row, s] * value, BUCKETS) / n + PENALTY * weights[:, s]
            grown[:, s] += g * g
            weights[:, s] -= 0.5 * g / np.sqrt(grown[:, s])
    return p


def learn_roles(sample: pd.DataFrame, furniture: set[int], content: set[int]) -> Roles | None:
    """Fit the roles on marked pages; ``furniture`` and ``content`` are skeletons so labelled. None without pages."""
    parts, starts, tpl, cut_off, fur, con, long = [], [0], [], [], [], [], []
    for r in sample.itertuples(index=False):
        lines, own = non_blank(r.text), own_words(r.firm, r.name)
        for j, (i, l) in enumerate(lines):
            parts.append(np.concatenate([features(l, own), place_features(j, len(lines), j > 0 and i - lines[j - 1][0] > 1)]))
            long.append(len(l) >= LONG)
        starts.append(len(parts))
        tpl += list(r.template)
        cut_off += list(r.cut_off)
        fur += [k in furniture for k in r.skeletons]
        con += [k in content for k in r.skeletons]
    if not parts:
        return None
    starts, tpl, cut_off, fur, con, long = np.array(starts), *(np.array(x, bool) for x in (tpl, cut_off, fur, con, long))
    cut_off &= ~tpl
    fur &= ~tpl & ~cut_off
    con &= ~tpl & ~cut_off & ~fur
    beside = np.zeros(len(tpl), bool)  # within two lines of one that breaks off
    page = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for d in (1, 2):
        same = page[d:] == page[:-d]
        beside[d:] |= cut_off[:-d] & same
        beside[:-d] |= cut_off[d:] & same
    post = np.select([m[:, None] for m in (tpl, cut_off, fur, con, long, beside)], [np.array(x, float) for x in ((1, 0, 0), (0, 1, 0), (0.6, 0.4, 0), (0.02, 0.03, 0.95), (0.02, 0.08, 0.9), (0.2, 0.5, 0.3))], np.array((0.2, 0.1, 0.7)))
    step, first = np.array([[0.8, 0.1, 0.1], [0.1, 0.7, 0.2], [0.1, 0.1, 0.8]]), np.array([0.7, 0.1, 0.2])
    index, row, value = _flat(parts)
    weights = np.zeros((BUCKETS, 3))
    for n in range(ROUNDS):
        prior = np.maximum(post.mean(0), 1e-3)
        p = _fit(index, row, value, post, weights)
        model = Roles(weights.astype(np.float32), prior, step, first)
        if n == ROUNDS - 1:
            break
        em = p / prior + 1e-12
        em[tpl] = (1, 1e-6, 1e-6)
        em[cut_off] = (1e-6, 1, 1e-6)
        em[fur] *= (1, 1, 1e-6)
        em[con] *= (0.05, 0.05, 1)
        em[long & ~tpl & ~cut_off & ~fur] *= (0.1, 0.1, 1)
        post, moves = forward_backward(em, starts, step, first)
        step = (moves + 1) / (moves + 1).sum(1, keepdims=True)
        first = (post[starts[:-1]].sum(0) + 1) / (len(starts) + 2)
    return model


def _bodies_udf(model):
    """Marked pages in, the numbers of their content lines out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roles = model.value
        weigh = lambda l, own: (roles.weights[f := features(l, own)].sum(0), len(f))
        common = Memory(lambda l: weigh(l, []))
        places: dict = {}
        for pdf in batches:
            entries, numbers, z, tpl, starts = [], [], [], [], [0]
            for e, text, firm, name, template in zip(pdf["entry_id"], pdf["text"], pdf["firm"], pdf["name"], pdf["template"]):
                lines, own = non_blank(text), own_words(firm, name)
                before = 0
                for j, (i, l) in enumerate(lines):
                    v = weigh(l, mine) if (mine := _mine(l, own)) else common[l]
                    at = (min(j, 4), min(len(lines) - 1 - j, 4), j > 0 and i - before > 1)
                    p = places.get(at)
                    if p is None:
                        p = places[at] = roles.weights[place_features(j, len(lines), at[2])].sum(0)
                    z.append((v[0] + p) * (3 / np.sqrt(v[1] + 3)))
                    before = i
                    numbers.append(i)
                    entries.append(e)
                tpl += list(template)
                starts.append(len(z))
            if not z:
                continue
            em = roles.emissions(np.array(z, float))
            em[np.array(tpl, bool)] = (1, 1e-6, 1e-6)
            sizes = np.array(starts)
            post, _ = forward_backward(em, sizes[np.r_[True, np.diff(sizes) > 0]], roles.step, roles.first)
            keep = post.argmax(1) == CONTENT
            yield pd.DataFrame({"entry_id": np.array(entries)[keep], "line_no": np.array(numbers, np.int32)[keep]})

    return run


def mark_templates(df: DataFrame, templates: bool = True) -> DataFrame:
    """Non-blank pages with their template lines marked and, where there are any, their skeletons; written once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host = F.nullif(F.regexp_extract(F.lower("source_url"), r"^\s*[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#:\s]+)", 1), F.lit(""))
    address = F.xxhash64(F.regexp_replace(F.lower("source_url"), r"^\s*[a-z]+://(www\.)?|/+\s*$", ""))
    big = df.select(F.xxhash64(host).alias("host"), host.isNull().alias("no")).filter("not no").groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups")).filter("groups > 1")
    pages = df.filter(~is_blank("raw_evidence")).select("entry_id", F.when(host.isNotNull(), F.xxhash64(host)).alias("host"), address.alias("page"), F.col("raw_evidence").alias("text"), "firm", "name")
    dealt = pages.join(big, "host", "left").withColumn("g", F.when(F.col("host").isNull(), F.col("entry_id")).otherwise(F.pmod(F.xxhash64("entry_id"), F.coalesce("groups", F.lit(1)))))
    dealt = dealt.repartition(n, "host", "g").sortWithinPartitions("host", "g", "entry_id").select("entry_id", "host", "g", "page", "text", "firm", "name")
    return cut(dealt.mapInPandas(_template_udf(templates), _MARKED))


def skeleton_counts(marked: DataFrame) -> DataFrame:
    """``skeleton, n, between, hosts, on_template`` over all lines of pages with a template: occurrences outside templates and broken-off lines, those of
    them that stand between such lines (or an end of the page) while the page has other open lines, those amid open lines (``inside``), whether several hosts have it, occurrences in templates."""
    known = F.zip_with("template", "cut_off", lambda a, b: a | b)
    open_ = F.size(F.filter(known, lambda x: ~x))
    line = marked.filter("size(skeletons) > 0").select("host", known.alias("k"), open_.alias("open"), F.posexplode("skeletons").alias("j", "skeleton"), "template")
    side = lambda d: F.coalesce(F.get("k", F.col("j") + d), F.lit(True))
    mine = F.get("k", F.col("j"))
    return line.groupBy("skeleton").agg(
        F.count_if(~mine).alias("n"), F.count_if(~mine & side(-1) & side(1) & (F.col("open") > 2)).alias("between"), F.count_if(~mine & ~side(-1) & ~side(1)).alias("inside"), (F.min("host") < F.max("host")).alias("hosts"), F.count_if(F.get("template", F.col("j"))).alias("on_template")
    )


def main_bodies(df: DataFrame, templates: bool = True) -> DataFrame:
    """``entry_id, line_no`` of each non-blank line of a page's main body.

    ``df`` needs ``entry_id, raw_evidence, source_url, firm, name``; other columns are ignored. Lines are the pieces
    between ``\\n``, counted from 1. Null, empty and blank pages give no rows; a page without address has no host and so
    no template, only learned roles. Pages fetched again count once for a template. Repeated rows give their lines once.
    Where no host has a template there is nothing to learn from, and every non-blank line is body; so too with
    ``templates`` off.
    """
    marked = mark_templates(df, templates)
    labelled = marked.filter(F.exists("template", lambda x: x) & (F.length("text") <= SAMPLE_CHARS))
    total = labelled.count()
    # a bounded sample, by hash; the limit only guards against ids that hash unevenly
    sample = labelled.filter(F.pmod(F.xxhash64("entry_id", F.lit(7)), F.lit(1_000_000)) < F.lit(int(min(1.0, SAMPLE_PAGES / max(total, 1)) * 1_000_000))).limit(2 * SAMPLE_PAGES)
    spark = df.sparkSession
    if total == 0:
        return marked.select("entry_id", F.posexplode(F.split("text", "\n")).alias("j", "l")).filter(~is_blank("l")).select("entry_id", (F.col("j") + 1).alias("line_no")).distinct()
    pages = sample.select("entry_id", "text", "firm", "name", "template", "skeletons", "cut_off").toPandas().sort_values("entry_id", kind="stable")
    mine = spark.createDataFrame(pd.DataFrame({"skeleton": pd.unique(np.concatenate([np.asarray(s, np.int64) for s in pages["skeletons"]] + [np.zeros(1, np.int64)]))}))
    share = F.col("between") / F.col("n")
    asked = skeleton_counts(marked).filter(F.col("hosts") & (F.col("n") >= RECURS)).join(mine, "skeleton", "left_semi")  # at most the sample's lines
    heading = (F.col("on_template") >= BOTH * (F.col("n") + F.col("on_template"))) & (F.col("inside") >= INSIDE * F.col("n"))  # a menu entry of some hosts and a heading of bodies: its place decides
    kind = F.when((F.col("between") >= CASES) & (share >= BETWEEN), F.when(~heading, 1)).when((share < NEVER) & (F.col("on_template") < NEVER * F.col("n")), 2)
    got = asked.select("skeleton", kind.alias("kind")).filter("kind is not null").toPandas()
    model = learn_roles(pages, set(got.loc[got["kind"] == 1, "skeleton"]), set(got.loc[got["kind"] == 2, "skeleton"]))
    return marked.select("entry_id", "text", "firm", "name", "template").mapInPandas(_bodies_udf(spark.sparkContext.broadcast(model)), "entry_id long, line_no int").distinct()
