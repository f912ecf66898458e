"""Column functions on job titles: folding, translation, names, predicates and quick ranks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.rules import any_of, quote
from rankloom.functions.text import squeeze, squeeze_sql, strip, strip_sql

#: Letters that ``fold`` can reduce to a base letter: everything of these blocks that decomposes to one letter and marks.
_BLOCKS = ((0x00C0, 0x0250), (0x1E00, 0x1F00))


def _foldable() -> tuple[str, str]:
    pairs = []
    for lo, hi in _BLOCKS:
        for o in range(lo, hi):
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(o)) if not unicodedata.combining(c))
            if len(base) == 1 and base != chr(o) and ord(base) < 128:
                pairs.append((chr(o), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _foldable()


def fold(c: Column | str) -> Column:
    """Latin letters without their marks, and loose combining marks dropped. Letters without decomposition (ø, ł, ß) stay."""
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"[\x{0300}-\x{036F}]", "")


def fold_sql(x: str) -> str:
    return f"regexp_replace(translate({x}, {quote(FOLD_FROM)}, {quote(FOLD_TO)}), '[\\x{{0300}}-\\x{{036F}}]', '', 'g')"


# ---------------------------------------------------------------------------
# Titles in Spanish and Portuguese (fixed values): phrases first, then words, then what joins them.
# ---------------------------------------------------------------------------
AREAS = {"finanzas": "Finance", "finanças": "Finance", "financas": "Finance", "recursos humanos": "HR", "tecnología": "Technology", "tecnologia": "Technology", "mercadeo": "Marketing", "marketing": "Marketing", "ventas": "Sales", "operaciones": "Operations", "operações": "Operations", "operacoes": "Operations", "estrategia": "Strategy", "riesgos": "Risk", "cumplimiento": "Compliance", "sistemas": "IT"}
PHRASES = (
    ("presidente ejecutivo", "CEO"), ("vicepresident[ea] ejecutiv[oa]", "Executive Vice President"), ("vicepresident[ea] senior", "Senior Vice President"), ("vice-presidente", "Vice President"), ("vicepresident[ea]", "Vice President"), ("president[ea]", "President"),
    ("director[ae]? general", "General Director"), ("director[ae]? ejecutiv[oa]", "Executive Director"), ("diretora? geral", "General Director"), ("diretora? executiv[oa]", "Executive Director"),
    *((f"(?:director[ae]?|diretora?) de {a}", f"{e} Director") for a, e in AREAS.items()),
    ("subdirector[ae]?", "Deputy Director"), ("director[ae]|diretora?", "Director"), ("gerente (?:general|geral)", "General Manager"), ("gerente senior", "Senior Manager"), ("gerente de [áa]rea", "Area Manager"), ("subgerente", "Deputy Manager"), ("gerente", "Manager"),
    ("jefe de [áa]rea", "Area Head"), ("jefa|jefe|chefe", "Head"), ("coordinadora?|coordenadora?", "Coordinator"), ("analista", "Analyst"), ("asesora?", "Advisor"), ("dirigente", "Director"), ("gerencia", "Management"), ("superintendente", "Superintendent"), ("s[oó]ci[oa]", "Partner"), ("consejer[oa]", "Board Director"),
    ("miembro (?:de la? junta|del? consejo)", "Board Member"), ("miembro", "Member"), ("accionista", "Shareholder"),
)
JOINERS = (("(?:de l[ao]s?|del)", "of the"), ("(?:de|d[ao]s?)", "of"), ("(?:y|e)", "and"))
#: A title is translated if it holds one of these words or any letter beyond ASCII; an English "president" doesn't count.
FOREIGN = r"(?i)\b(?:" + "|".join(p for p, _ in PHRASES if " " not in p) + r"|junta)\b"


def _steps() -> list[tuple[str, str]]:
    wide = lambda p: p.replace(" ", r"\s+")
    return [(rf"(?i)\b(?:{wide(p)})\b", e) for p, e in PHRASES] + [(rf"(?i)\s+{wide(p)}\s+", f" {e} ") for p, e in JOINERS]


def is_foreign(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(FOREIGN) | c.rlike(r"[\p{L}&&[^\x00-\x7F]]"), F.lit(False))


def translate(c: Column | str) -> Column:
    """Spanish and Portuguese titles in English, without marks; other titles as they are. Null stays null."""
    out = F.col(c) if isinstance(c, str) else c
    gate = is_foreign(out)
    done = out
    for p, e in _steps():
        done = F.regexp_replace(done, p, e)
    return F.when(gate, strip(fold(done))).otherwise(out)


def translate_sql(x: str) -> str:
    done = x
    for p, e in _steps():
        done = f"regexp_replace({done}, {quote(p)}, {quote(e)}, 'g')"
    return f"CASE WHEN coalesce(regexp_matches({x}, {quote(FOREIGN)}) OR regexp_matches(regexp_replace({x}, '[\\x00-\\x7F]', '', 'g'), '\\p{{L}}'), false) THEN {strip_sql(fold_sql(done))} ELSE {x} END"


def translated(title: str) -> str:
    """``translate`` of one string, for use outside Spark."""
    if not (re.search(FOREIGN, title) or any(ord(ch) > 127 and ch.isalpha() for ch in title)):
        return title
    for p, e in _steps():
        title = re.sub(p, e, title)
    return "".join(ch for ch in unicodedata.normalize("NFKD", title) if not unicodedata.combining(ch)).strip()


# ---------------------------------------------------------------------------
# Abbreviations and modifiers (fixed values)
# ---------------------------------------------------------------------------
ABBREVIATIONS = {"sr": "senior", "jr": "junior", "vp": "vice president", "svp": "senior vice president", "evp": "executive vice president", "avp": "assistant vice president", "md": "managing director", "gm": "general manager", "dir": "director", "mgr": "manager", "mngr": "manager", "asst": "assistant", "assoc": "associate", "exec": "executive", "eng": "engineer", "dept": "department", "hr": "human resources", "it": "information technology", "ops": "operations", "mktg": "marketing", "fin": "finance", "acct": "accounting", "comm": "communications", "intl": "international", "natl": "national", "reg": "regional"}
MODIFIERS = "interim|acting|global|regional|national|international|group|associate|assistant|deputy|co|former|temporary|contract"


def expand(c: Column | str, table: dict[str, str] | None = None) -> Column:
    """Abbreviations (whole words, with or without a dot) written out, longest first, in lower case."""
    out = F.lower(c)
    for a, full in sorted((ABBREVIATIONS if table is None else table).items(), key=lambda kv: (-len(kv[0]), kv[0])):
        out = F.regexp_replace(out, rf"(^|[^a-z]){re.escape(a)}\.?($|[^a-z])", rf"$1{full}$2")
    return squeeze(out)


def expand_sql(x: str) -> str:
    out = f"lower({x})"
    for a, full in sorted(ABBREVIATIONS.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        out = f"regexp_replace({out}, {quote(rf'(^|[^a-z]){re.escape(a)}\.?($|[^a-z])')}, {quote(rf'\1{full}\2')}, 'g')"
    return squeeze_sql(out)


def without_modifiers(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), rf"\b(?:{MODIFIERS})\b", " "))


def without_modifiers_sql(x: str) -> str:
    return squeeze_sql(f"regexp_replace(lower({x}), '\\b(?:{MODIFIERS})\\b', ' ', 'g')")


# ---------------------------------------------------------------------------
# Predicates (fixed values: the words). Text: the title in lower case.
# ---------------------------------------------------------------------------
EXECUTIVE_WORDS = "chief|ceo|cfo|coo|cto|cio|president|chair|director|executive|officer|managing|head of|partner|founder"
BOARD_WORDS = "board of directors|board member|board director|non-executive|non executive|independent director|supervisory board|board of trustees|trustee|chairman|chairwoman|chairperson|chair of the board|board chair|vice chair|lead director|lead independent|presiding director|outside director|audit committee|compensation committee|nomination committee|governance committee"
RETIRED = r"\b(?:retired|former|formerly|ex-|emeritus|emerita|late|deceased|past|outgoing|departed|stepped\s+down|resigned)\b|\((?:ret|retd)\.?\)"
_UNIT_BEFORE_CEO = r"\b(?!group|global|the|and|chairman|president|founder|interim|co)[a-z]+\s+ceo\b"


def looks_executive(c: Column | str) -> Column:
    return F.coalesce(F.lower(c).rlike(any_of(EXECUTIVE_WORDS)), F.lit(False))


def on_board(c: Column | str) -> Column:
    return F.coalesce(F.lower(c).rlike(any_of(BOARD_WORDS)), F.lit(False))


def is_retired(title: Column | str, name: Column | str) -> Column:
    return F.coalesce(F.lower(title).rlike(RETIRED), F.lit(False)) | F.coalesce(F.lower(name).rlike(RETIRED), F.lit(False))


def is_group_ceo(c: Column | str) -> Column:
    """A chief executive of the whole firm: no deputy, and no unit or place before "CEO"."""
    t = F.lower(strip(c))
    return F.coalesce(t.rlike(r"\bceo\b|\bchief\s+executive\b") & ~t.rlike(r"deputy|vice|assistant|associate|former|regional") & ~t.rlike(_UNIT_BEFORE_CEO), F.lit(False))


def not_current(c: Column | str) -> Column:
    """A flag "job is current" that says no; null and anything else count as current."""
    return F.coalesce(F.lower(F.trim(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))).isin("false", "0", "no", "n"), F.lit(False))


#: Ranks told by words alone, in order (fixed values).
QUICK_LAYERS = ((0, "chairman|chairwoman|chairperson|board of directors|non-executive|independent director"), (1, "chief|ceo|cfo|coo|cto|president and"), (2, "executive vice president|evp|managing director|group president"), (3, "senior vice president|svp|executive director"), (4, "vice president|vp|general manager|head of"), (5, "senior director"), (6, "director"), (7, "senior manager"), (8, "manager|supervisor"), (9, "senior|lead|principal"), (10, "analyst|associate|assistant|intern|coordinator"))


def quick_layer(c: Column | str) -> Column:
    """Layer by the first group of words found as whole words; 5 if none."""
    t, out = F.lower(c), None
    for n, words in QUICK_LAYERS:
        hit = t.rlike(rf"\b(?:{words})\b")
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.otherwise(5)


def quick_layer_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), {quote(rf'\b(?:{w})\b')}) THEN {n}" for n, w in QUICK_LAYERS) + " ELSE 5 END"


#: Functions of leaders by words of their title, in order (fixed values).
LEADER_FUNCTIONS = (("Finance & Accounting", "financ|cfo|treasur|account|audit|controller"), ("Human Resources", "human res|people|chro|talent"), ("Legal, Risk & Compliance", "legal|counsel|complian|risk|secretary"), ("Information Technology", "technolog|information|cio|cto|digital|data"), ("Research & Development", "research|scien|innovation"), ("Marketing", "market|brand|cmo"), ("Sales & Business Development", "sales|revenue|commercial|customer"), ("Supply Chain", "supply|logist|procure"), ("Manufacturing", "manufact|production|plant"), ("Operations", "operat|coo"), ("Corporate Communications & Public Affairs", "communicat|public|affairs"), ("Sustainability", "sustain|esg|environment"))


def leader_function(c: Column | str) -> Column:
    t, out = F.lower(c), None
    for f, words in LEADER_FUNCTIONS:
        out = F.when(t.rlike(words), f) if out is None else out.when(t.rlike(words), f)
    return out.otherwise("Strategy")


def leader_function_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({x}), {quote(w)}) THEN {quote(f)}" for f, w in LEADER_FUNCTIONS) + " ELSE 'Strategy' END"


# ---------------------------------------------------------------------------
# Names
# ---------------------------------------------------------------------------
def split_name(c: Column | str) -> Column:
    """Struct of the first word and the rest of a full name."""
    parts = F.split(strip(c), r"\s+", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("first"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("rest"))


def slug_company(url: Column | str) -> Column:
    """A firm's name from its page's address: ``.../company/acme-steel`` gives ``Acme Steel``; empty if there is none."""
    return F.initcap(F.regexp_replace(F.regexp_extract(F.lower(url), r"/company/([a-z0-9-]+)", 1), "-", " "))


def mail_company(domain: Column | str) -> Column:
    """A firm's name from its mail domain: ``acme-steel.com`` gives ``Acme Steel``."""
    return F.initcap(F.regexp_replace(F.regexp_extract(F.lower(domain), r"^(?:.*@)?(?:www\.)?([a-z0-9-]+)\.", 1), "-", " "))


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness, 0 to 100, of two texts as sets of words: the best of comparing shared words with shared words plus either's rest."""

    def ratio(x: str, y: str) -> float:
        if not x and not y:
            return 100.0
        n, m = len(x), len(y)
        last = [0] * (m + 1)
        for i in range(1, n + 1):
            row = [0] * (m + 1)
            for j in range(1, m + 1):
                row[j] = last[j - 1] + 1 if x[i - 1] == y[j - 1] else max(last[j], row[j - 1])
            last = row
        return 200.0 * last[m] / (n + m)

    def one(x: str | None, y: str | None) -> float:
        s, t = (set(re.findall(r"\w+", (v or "").lower())) for v in (x, y))
        if not s or not t:
            return 0.0
        both, only_s, only_t = (" ".join(sorted(v)) for v in (s & t, s - t, t - s))
        if both and (not only_s or not only_t):
            return 100.0
        p, q = (both + " " + only_s).strip(), (both + " " + only_t).strip()
        return max(ratio(both, p), ratio(both, q), ratio(p, q))

    return pd.Series([one(x, y) for x, y in zip(a, b)])
