"""People and sections out of pages and loosely formed answers.

What built-in functions can express stays in the JVM; parsing of JSON and markup of any depth runs in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rankloom.functions.titles import fold

_SCRIPTS = r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>"


def visible_text(html: Column | str) -> Column:
    c = F.regexp_replace(html, _SCRIPTS, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def is_js_shell(html: Column | str, least: int = 300) -> Column:
    """A page that shows less than ``least`` signs without running its scripts; null pages too."""
    return F.length(F.coalesce(visible_text(html), F.lit(""))) < least


def marker_slice(text: Column | str, marker: str, before: int = 200, after: int = 4_000) -> Column:
    """The text around the first place of a marker in any case; null if it doesn't occur."""
    text = F.col(text) if isinstance(text, str) else text
    at = F.regexp_instr(text, F.lit("(?i)" + re.escape(marker)))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + after - start))


def between_markers(text: Column | str, starts: tuple[str, ...] = ("ITEM 10", "DIRECTORS AND EXECUTIVE OFFICERS"), end: str = "ITEM 11", before: int = 100, most: int = 12_000) -> Column:
    """From ``before`` signs ahead of the first start marker that occurs up to the end marker behind it (or ``most`` signs); the text's beginning if none occurs."""
    text = F.col(text) if isinstance(text, str) else text
    find = lambda m, t: F.nullif(F.regexp_instr(t, F.lit("(?i)" + re.escape(m))), F.lit(0))
    at = F.coalesce(*[find(s, text) for s in starts])
    stop = find(end, F.substring(text, at, F.length(text)))
    first = F.greatest(at - before, F.lit(1))
    length = F.least(F.coalesce(at + stop - 1, at + most) - first, F.lit(most))
    return F.coalesce(F.substring(text, first, length), F.substring(text, F.lit(1), F.lit(most * 2 // 3)))


#: Headings that open and close a section on leaders (fixed values).
SECTION_OPENS = r"(?i)^(?:board\s+of\s+directors?|board\s+members?|directors?|executive\s+(?:team|officers?|management)|leadership|senior\s+management|management\s+team)"
SECTION_ENDS = r"(?i)^(?:history|products?|services?|finances?|controversy|see\s+also|references|external\s+links|operations?|subsidiaries)"


def carve_sections(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, line`` of non-blank lines that stand in a section on leaders: from a heading that opens one (itself
    included) to a short one that ends it. A page's lines meet in one window, so a page is the unit, whatever the number of pages."""
    l = pages.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("j", "raw")).select("id", (F.col("j") + 1).alias("line_no"), F.trim("raw").alias("line")).filter("line <> ''")
    turn = F.when(F.col("line").rlike(SECTION_OPENS), True).when(F.col("line").rlike(SECTION_ENDS) & (F.length("line") < 60), False)
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return l.withColumn("inside", F.last(turn, ignorenulls=True).over(w)).filter("inside").select("id", "line_no", "line")


def infobox_people(text: Column | str, most: int = 500) -> Column:
    """What follows "Key people" in a line, up to the next entry of the box; null if there is none."""
    s = F.regexp_extract(text, rf"(?i)(key people[^\n]{{0,{most - 10}}})", 1)
    cut = F.regexp_replace(s, r"(?is)^(.+?)(?:revenue|products|website|footnotes|number of employees).*$", "$1")
    return F.nullif(F.trim(cut), F.lit(""))


def name_evidence(name: Column | str, source: Column | str, least_chars: int = 200) -> Column:
    """Whether a page names a person: its full name, all its parts, or a surname of four letters or more, also without
    marks on letters. A source below ``least_chars`` is too thin to tell and passes; a null one too."""
    name = F.col(name) if isinstance(name, str) else name
    src = F.coalesce(F.lower(source), F.lit(""))

    def check(n: Column, s: Column) -> Column:
        parts = F.filter(F.split(n, r"\s+"), lambda p: F.length(p) >= 2)
        last = F.try_element_at(F.split(F.trim(n), r"\s+"), F.lit(-1))
        return F.contains(s, n) | ((F.size(parts) >= 2) & F.forall(parts, lambda p: F.contains(s, p))) | ((F.length(last) >= 4) & F.contains(s, last))

    n = F.lower(name)
    given = F.coalesce(F.trim(name), F.lit("")) != ""
    return F.when(F.length(src) < least_chars, True).otherwise(given & F.coalesce(check(n, src) | check(fold(n), fold(src)), F.lit(False)))


def linkedin_urls(text: Column | str) -> Column:
    """Addresses of personal pages in a text, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://(?:[a-z]{2,3}\.)?linkedin\.com/in/[A-Za-z0-9_%-]+)"), F.lit(1)))


def url_for_name(urls: Column, name: Column) -> Column:
    """The first address whose slug holds a name's first and last word, else the first that holds its last; null if none does."""
    w = F.filter(F.split(F.lower(fold(name)), r"[^a-z0-9]+"), lambda x: x != "")
    slug = lambda u: F.lower(F.regexp_extract(u, r"/in/([^/?#]+)", 1))
    first, last = F.get(w, F.lit(0)), F.try_element_at(w, F.lit(-1))
    both = F.filter(urls, lambda u: F.contains(slug(u), first) & F.contains(slug(u), last))
    one = F.filter(urls, lambda u: F.contains(slug(u), last))
    return F.coalesce(F.when(F.size(w) >= 2, F.get(both, F.lit(0))), F.get(one, F.lit(0)))


def ordered_distinct(lines: Column) -> Column:
    """Lines of an array that aren't blank, each once, in order of their first place."""
    return F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""))


# ---------------------------------------------------------------------------
# JSON of any form
# ---------------------------------------------------------------------------
PERSON = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("title", T.StringType())]))
NAME_KEYS, TITLE_KEYS = ("name", "fullName", "personName", "displayName"), ("title", "jobTitle", "position", "role", "designation")  # fixed values
ARRAY_KEYS = "boardMembers?|directors?|executives?|leadership(?:Team)?|teamMembers?|managementTeam|committeeMembers?"
DEEPEST = 6


def walk_people(value: object) -> list[tuple[str, str]]:
    """Name and title of each object, down to ``DEEPEST`` levels, that has both, the name being of two words or more and under 60 signs."""
    out, todo = [], [(value, 0)]
    while todo:
        v, depth = todo.pop()
        if depth > DEEPEST:
            continue
        if isinstance(v, dict):
            n, t = (str(next((v[k] for k in keys if v.get(k)), "")).strip() for keys in (NAME_KEYS, TITLE_KEYS))
            if n and t and len(n.split()) >= 2 and len(n) < 60:
                out.append((n, t))
        inner = list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
        todo += [(x, depth + 1) for x in reversed(inner)]
    return list(dict.fromkeys(out))


def _loads(s: str):
    try:
        return json.loads(s)
    except ValueError:
        return None


def _first_value(s: str):
    """The JSON value at the start of a text; None if there is none."""
    try:
        return json.JSONDecoder().raw_decode(s)[0]
    except ValueError:
        return None


def page_data(html: str) -> list[tuple[str, str]]:
    """People in the data that a page carries for its scripts: a framework's state, assigned state objects, and arrays under keys of leaders."""
    found: list[tuple[str, str]] = []
    for m in re.finditer(r"<script[^>]+id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", html, re.S | re.I):
        found += walk_people(_loads(m.group(1)))
    for m in re.finditer(r"(?:window\.__[A-Z_]+__|var\s+(?:initial|page|app|state)Data)\s*=\s*(?=\{)", html):
        found += walk_people(_first_value(html[m.end() :]))
    for m in re.finditer(rf'"(?:{ARRAY_KEYS})"\s*:\s*(?=\[)', html, re.I):
        found += walk_people(_first_value(html[m.end() :]))
    return list(dict.fromkeys(found))


def linked_data(html: str) -> list[tuple[str, str]]:
    """People of a page's JSON-LD blocks: persons, and the members, employees and list elements of organisations."""
    out = []
    for m in re.finditer(r"<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", html, re.S | re.I):
        top = _loads(m.group(1))
        for item in top if isinstance(top, list) else [top]:
            if not isinstance(item, dict):
                continue
            inner = [x for k in ("member", "employee", "itemListElement") for x in (item.get(k) if isinstance(item.get(k), list) else [])]
            for p in ([item] if item.get("@type") in ("Person", "Employee") else []) + [x for x in inner if isinstance(x, dict)]:
                if p.get("name") and p.get("jobTitle"):
                    out.append((str(p["name"]).strip(), str(p["jobTitle"]).strip()))
    return list(dict.fromkeys(out))


def tolerant_json(raw: str | None) -> list[dict]:
    """People of a model's answer: with or without code fences or words around it; boards and executives, or a plain list."""
    s = re.sub(r"(?m)^\s*```(?:json)?|```\s*$", "", raw or "").strip()
    v = _loads(s)
    if v is None:
        at = s.find("{")
        v = _first_value(s[at:]) if at >= 0 else None
    if isinstance(v, list):
        return [p for p in v if isinstance(p, dict)]
    if not isinstance(v, dict):
        return []
    board, execs = (v.get(k) if isinstance(v.get(k), list) else [] for k in ("board_of_directors", "executive_management"))
    return [{**p, "is_board": True} for p in board if isinstance(p, dict)] + [{"is_board": False, **p} for p in execs if isinstance(p, dict)]


# ---------------------------------------------------------------------------
# People on pages
# ---------------------------------------------------------------------------
_CARD = re.compile(r"\b(?:card|profile|member|person|leader|executive|director|team|bio)\b", re.I)
_NAME_CLASS = re.compile(r"\b(?:profile|person|member|bio|exec|leader)[-_]?name\b", re.I)
_TITLE_CLASS = re.compile(r"\b(?:(?:profile|person|member|bio|exec|job|leader)[-_]?title|position|role)\b", re.I)
_TITLE_WORD = re.compile(r"\b(?:chief|officer|president|director|chair\w*|head|manager|partner|founder|secretary|counsel|c[efiot]o|vp|svp|evp)\b", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self) -> Iterable:
        todo = list(reversed(self.kids))
        while todo:
            k = todo.pop()
            if isinstance(k, _Node):
                yield k
                todo += reversed(k.kids)

    def text(self) -> str:
        out, todo = [], list(reversed(self.kids))
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                out.append(k)
            elif k.tag not in ("script", "style"):
                todo += reversed(k.kids)
        return " ".join(" ".join(out).split())

    def following(self) -> list:
        """The next four elements beside this one."""
        if self.parent is None:
            return []
        here = self.parent.kids.index(self)
        return [k for k in self.parent.kids[here + 1 :] if isinstance(k, _Node)][:4]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def looks_like_name(s: str) -> bool:
    w = s.split()
    return 2 <= len(w) <= 5 and len(s) < 60 and not re.search(r"\d", s) and s != s.upper() and not _TITLE_WORD.search(s)


def people_of_page(html: str | None) -> list[tuple[str, str]]:
    """People on a page, by the first way that finds any: linked data, microdata, cards, name classes, headings with what follows, headings with a title below."""
    if not html:
        return []
    got = [(n, t) for n, t in linked_data(html) if looks_like_name(n)]
    if got:
        return got
    p = _Tree()
    p.feed(html)
    nodes = list(p.root.walk())
    cls = lambda n: n.attrs.get("class", "")
    heads = lambda *tags: [n for n in nodes if n.tag in tags]

    def first(n: _Node, ok) -> _Node | None:
        return next((k for k in n.walk() if ok(k)), None)

    def microdata():
        for n in nodes:
            if re.search(r"schema\.org/Person", n.attrs.get("itemtype", ""), re.I):
                name, title = first(n, lambda k: k.attrs.get("itemprop") == "name"), first(n, lambda k: re.search("job|title|role", k.attrs.get("itemprop", ""), re.I))
                if name:
                    yield name.text(), title.text() if title else ""

    def cards():
        for n in nodes:
            if _CARD.search(cls(n)):
                name = first(n, lambda k: k.tag in ("h2", "h3", "h4", "h5", "strong", "b"))
                if name:
                    own = name.text()
                    texts = (k.text() for k in n.walk() if k.tag in ("p", "span", "div"))
                    yield own, next((t for t in texts if t and t != own and 1 < len(t.split()) <= 10 and (_TITLE_WORD.search(t) or len(t) < 50)), "")

    def classes():
        for n in nodes:
            if _NAME_CLASS.search(cls(n)):
                title = first(n.parent, lambda k: k is not n and _TITLE_CLASS.search(cls(k)))
                yield n.text(), title.text() if title else next((t for t in (k.text() for k in n.following()) if t and len(t) < 120), "")

    def pairs():
        for n in heads("h2", "h3"):
            texts = [t for t in (k.text() for k in n.following()) if t and t != n.text()]
            yield n.text(), next((t for t in texts if len(t) < 120 and (_TITLE_WORD.search(t) or len(t.split()) <= 12)), "")

    def subtitles():
        for n in heads("h3", "h4"):
            t = next((k.text() for k in n.following() if k.tag in ("p", "span", "div")), "")
            if _TITLE_WORD.search(t) and len(t) < 120:
                yield n.text(), t

    for way in (microdata, cards, classes, pairs, subtitles):
        out: dict[str, str] = {}
        for name, title in way():
            name = " ".join(name.split())
            if looks_like_name(name):
                out.setdefault(name, " ".join(title.split()))
        if out:
            return list(out.items())
    return []


def _udf(f):
    @F.pandas_udf(PERSON)
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([[{"name": n, "title": t} for n, t in f(x)] if x else [] for x in c], dtype=object)

    return run


people_in_page = _udf(people_of_page)
people_in_page_data = _udf(page_data)
people_in_linked_data = _udf(linked_data)
people_in_answer = _udf(lambda s: [(str(p.get("name") or ""), str(p.get("title") or "")) for p in tolerant_json(s)])


def listed_people(c: Column) -> Column:
    """People of an array (``name, title``) that have both, the name being of two words or more."""
    return F.filter(c, lambda p: (F.coalesce(F.trim(p["name"]), F.lit("")) != "") & (F.coalesce(F.trim(p["title"]), F.lit("")) != "") & (F.size(F.split(F.trim(p["name"]), r"\s+")) >= 2))


def flat_leaders(board: Column, executives: Column, senior: Column) -> Column:
    """One array (``name, title, is_board``) of the board, then executives and senior leaders together."""
    mark = lambda c, b: F.transform(F.coalesce(c, F.array()), lambda p: F.struct(p["name"].alias("name"), p["title"].alias("title"), F.lit(b).alias("is_board")))
    return F.concat(mark(board, True), mark(F.concat(F.coalesce(executives, F.array()), F.coalesce(senior, F.array())), False))
