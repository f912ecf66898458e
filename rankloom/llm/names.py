"""Reading names of people and firms that were typed by people."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

from rankloom.llm.canonical import _LETTERS

#: Words around a name that aren't part of it (fixed values).
HONORIFICS = frozenset("mr mrs ms miss mx dr prof ing sir dame herr frau mme mlle sr sra don dona dipl rev hon".split())
SUFFIXES = frozenset("jr snr ii iii iv mba phd cpa md esq msc bsc ba ma llm cfa dds rn pe ret".split())
#: Words of firms that are form, not name (fixed values).
LEGAL = frozenset("the inc incorporated corp corporation co company ltd limited llc llp lp plc gmbh ag sa spa srl bv nv oy ab as kk pty pvt private sons partners and group holding hq subsidiary a of und y et & b v k p s l n international intl global".split())


#: Strings that a worker remembers readings of; a bound of memory that changes no result.
_CACHED = 100_000


def _less(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


@dataclass(frozen=True)
class Lexicon:
    """What the data tell of given names: those that are usual, and of each short form the names it stands for."""

    usual: frozenset = frozenset()
    short: dict = field(default_factory=dict)
    near: dict = field(default_factory=dict)  # a usual name, and it with each letter left out, to such names

    @classmethod
    def of(cls, usual: Iterable[str], pairs: Iterable[tuple[str, str]] = (), typos: bool = True) -> Lexicon:
        """``pairs``: short form and full name. ``typos``: whether ``likes`` is asked, which takes most of the memory."""
        short: dict[str, set[str]] = {}
        for s, full in pairs:
            short.setdefault(s, set()).add(full)
        near: dict[str, list[str]] = {}
        usual = frozenset(usual)
        for w in usual if typos else ():
            if len(w) > 3:
                for c in _less(w):
                    near.setdefault(c, []).append(w)
        return cls(usual, {s: frozenset(f) for s, f in short.items()}, near)

    def likes(self, w: str) -> bool:
        """Known, or within one edit of a usual name of four letters or more."""
        return self.knows(w) or any(edits(v, w, 1) <= 1 for c in _less(w) for v in self.near.get(c, ()))

    def knows(self, w: str) -> bool:
        return w in self.usual or w in self.short

    def fulls(self, w: str) -> frozenset:
        return self.short.get(w, frozenset())

    def initials(self, w: str) -> set[str]:
        """First letters of what a name is short for, and of its short forms."""
        return {f[0] for f in self.fulls(w)} | {s[0] for s, f in self.short.items() if w in f}


@dataclass(frozen=True)
class Excerpt(Lexicon):
    """What a lexicon tells of some given names only, as the columns of a table have it."""

    first: dict = field(default_factory=dict)

    @classmethod
    def of_columns(cls, given: Iterable[str], usual: Iterable[bool], fulls: Iterable, initials: Iterable) -> Excerpt:
        rows = {g: x for g, *x in zip(given, usual, fulls, initials)}
        return cls(frozenset(g for g, x in rows.items() if x[0]), {g: frozenset(x[1]) for g, x in rows.items()}, {}, {g: set(x[2]) for g, x in rows.items()})

    def initials(self, w: str) -> set[str]:
        return self.first.get(w, set())


@lru_cache(maxsize=_CACHED)
def plain(s: str | None) -> str:
    """Folded text; null and the text ``nan`` give the empty string."""
    if s is None:
        return ""
    s = unicodedata.normalize("NFKD", s).translate(_LETTERS)
    s = "".join(c for c in s if not unicodedata.combining(c)).casefold().strip()
    return "" if s == "nan" else s


@lru_cache(maxsize=_CACHED)
def sound(w: str) -> str:
    """A surname without the differences that transliteration and poor scans make."""
    w = w.replace("0", "o").replace("1", "l").replace("5", "s")
    for a, b in (("ue", "u"), ("oe", "o"), ("ae", "a"), ("ph", "f"), ("ie", "i"), ("y", "i"), ("ck", "k"), ("c", "k"), ("z", "s"), ("x", "ks")):
        w = w.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", w)


def _tokens(s: str) -> list[str]:
    s = re.sub(r"\([^)]*\)", " ", s)
    out = []
    for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", s):
        if w.replace("'", "") not in HONORIFICS and w not in SUFFIXES:
            out.append(w)
    return out


def name_words(s: str | None) -> list[str]:
    """The words of a name in one field that ``read_person`` looks up in the lexicon, and perhaps more."""
    s = plain(s)
    head, _, tail = s.partition(",")
    return list(dict.fromkeys(w for x in (s, head, tail) for w in _tokens(x)))


def read_person(first: str | None, last: str | None, lex: Lexicon) -> tuple[str, list[str]]:
    """Given name (or its initial) and parts of the surname, whatever the order and the fields they were typed in."""
    f, l = plain(first), plain(last)
    if f and l:
        a, b = _tokens(f), _tokens(l)
        if "," in l and not a:
            f = ""
        elif "," in l and len(b) > 1 and a == b[1:]:
            b = b[:1]
        long_a, long_b = [w for w in a if len(w) > 1], [w for w in b if len(w) > 1]
        if f:
            known_a, known_b = any(map(lex.knows, long_a)), any(map(lex.knows, long_b))
            if not known_a and not known_b and long_a and long_b:  # perhaps a given name with a typo
                known_a, known_b = any(map(lex.likes, long_a)), any(map(lex.likes, long_b))
            if (known_b and not known_a and long_a) or (long_a and not long_b and b):
                a, b = b, a
            return _given(a), _parts([w for w in b if len(w) > 1])
    s = l if not f else f
    if "," in s:
        head, _, tail = s.partition(",")
        t = _tokens(tail)
        if t:
            h = _tokens(head)
            if h and any(map(lex.knows, h)) and not any(map(lex.knows, t)):
                t, h = h, t
            return _given(t), _parts([w for w in h if len(w) > 1])
        s = head
    t = _tokens(s)
    if len(t) < 2:
        return ("", _parts(t)) if not f else (_given(t), [])
    if not lex.knows(t[0]) and len(t[0]) > 1:
        for i in (len(t) - 1, 1):
            if t[i] in lex.usual:
                return t[i], _parts([w for j, w in enumerate(t) if j != i and len(w) > 1])
        if len(t[-1]) == 1 and len(t) == 2:
            return t[-1], _parts(t[:1])
    return _given(t[:1]), _parts([w for w in t[1:] if len(w) > 1])


def _given(t: list[str]) -> str:
    long = [w for w in t if len(w) > 1]
    return t[0] if t and (len(t[0]) == 1 or not long) else (long[0] if long else "")


def _parts(t: list[str]) -> list[str]:
    out = [sound(re.sub("['’-]", "", w)) for w in t]
    for w in t:
        pieces = re.split(r"['’-]", w)
        out += ["".join(map(sound, pieces[:n])) for n in range(2, len(pieces))]  # one surname written with a dash before another
        for x in pieces:
            out.append(sound(x))
            if re.search(r"[aou]e|ie|y|(.)\1", x):  # where a typo can look like a transliteration
                out.append(x)
    return [x for x in dict.fromkeys(out) if len(x) > 2] or [x for x in dict.fromkeys(out) if x]


@lru_cache(maxsize=_CACHED)
def _firm_words(company: str) -> tuple[str, ...]:
    s = re.sub(r"([^\W\d_])(?=[A-Z])", lambda m: m.group() + " " if m.group().islower() else m.group(), company)
    s = re.sub(r"(?<=\w)\.(?=\w\b)", "", plain(s.split(",")[0] if "," in s else s)).replace("int'l", "")
    out = [w.replace("0", "o").replace("1", "l") for w in re.findall(r"[^\W_]+", s)]
    return tuple(w for w in out if w not in LEGAL and len(w) > 1)


def read_firm(company: str | None) -> list[str]:
    """The words that name a firm, folded: usually a coined word and one for its trade, all of them where there are more."""
    if not company or plain(company) == "":
        return []
    return list(_firm_words(company))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between ``a`` and ``b``; ``most + 1`` if more.

    Swaps are unrestricted (letters may be put between the two swapped), so that this is a metric: the triangle
    inequality holds.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2)] + [[far, i] + [0] * len(b) for i in range(len(a) + 1)]
    d[1][1:] = range(len(b) + 1)
    last_row: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        last_col = 0
        row, up = d[i + 1], d[i]
        for j, y in enumerate(b, 1):
            k, l = last_row.get(y, 0), last_col
            c = up[j] + (x != y)
            if x == y:
                last_col = j
            row[j + 1] = min(c, row[j] + 1, up[j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last_row[x] = i
        if min(row[1:]) > most and min(up[1:]) > most:
            return most + 1
    return min(d[-1][-1], most + 1)


def same_given(a: str, b: str, lex: Lexicon) -> bool:
    """Whether two given names can be one: equal, an initial, a short form, or a typo of each other where not both are usual names."""
    if not a or not b:
        return False
    if a == b:
        return True
    if len(a) == 1 or len(b) == 1:
        x, y = (a, b) if len(a) == 1 else (b, a)
        return y[0] == x or x in lex.initials(y)
    fa, fb = lex.fulls(a), lex.fulls(b)
    if b in fa or a in fb or fa & fb:
        return True
    sa, sb = sound(a), sound(b)
    if sa == sb:
        return True
    if a in lex.usual and b in lex.usual:
        return False
    return min(edits(sa, sb, 2), edits(a, b, 2)) <= (1 if min(len(a), len(b)) < 8 else 2)


def same_surname(a: list[str], b: list[str]) -> bool:
    return any(edits(x, y, 2) <= (0 if min(len(x), len(y)) < 4 else 1 if min(len(x), len(y)) < 9 else 2) for x in a for y in b)


def same_firm(a: list[str], b: list[str]) -> bool:
    """Whether two firms' words can be one firm: coined words within a typo, and trades that don't contradict."""
    if not a or not b:
        return False
    x, y = a[0], b[0]
    if x != y and edits(x, y, 2) > (1 if min(len(x), len(y)) < 9 else 2):
        ja, jb = "".join(a[:2]), "".join(b[:2])
        return ja == jb or (len(min(ja, jb, key=len)) >= 9 and edits(ja, jb, 2) <= 2)
    if len(a) > 1 and len(b) > 1:
        p, q = sorted((a[1], b[1]), key=len)
        return q.startswith(p) or edits(p, q, 2) <= 2
    return True
