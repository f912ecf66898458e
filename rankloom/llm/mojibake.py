"""Text that was decoded with a wrong character encoding: found and restored.

Noisy-channel decoding. A channel is a true encoding read as a wrong one (or that twice, or with HTML escapes in
between). Undoing a channel on a token gives its bytes, with wildcards where a byte was lost to U+FFFD, and from them
the text that would have been there. A Viterbi search runs over the tokens of a document: its states are "as it
stands" and the channels, a state's emission is the log frequency of the token it gives (as a word of the corpus, or
by pairs of characters where the word is new), and changing the state costs a penalty, so that neighbours support each
other. A document is affected if the best path leaves the state "as it stands" with enough gain, or if characters
were lost for good. Lost characters within a word are filled in by the commonest word of the corpus that fits.

Frequencies are counted over all distinct texts; what is sent to the tasks are the most frequent ``PAIRS`` pairs of
characters and ``WORDS`` words (a bound on the model, not on the texts; rarer ones count as unseen).
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import cut

#: Bounds of the model; cost of changing the state; least gain of a document, in nats.
PAIRS, WORDS, SWITCH, GAIN = 200_000, 100_000, 3.0, 2.0

_SINGLE = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "koi8_r", "mac_roman", "iso8859_2")
#: Channels: (true encoding, wrong encoding, rounds) (fixed values).
CHANNELS = (
    *(("utf-8", w, 1) for w in (*_SINGLE, "gb18030", "cp932", "big5", "euc_kr")), ("utf-8", "cp1252", 2), ("utf-8", "html", 1),
    *((t, "cp1252", 1) for t in ("cp1250", "cp1251", "cp437", "cp850", "cp866", "koi8_r", "mac_roman", "gb18030", "euc_jp", "cp932", "big5", "euc_kr")),
    *(("cp1252", w, 1) for w in ("cp1250", "cp1251", "cp437", "cp850", "mac_roman")), ("koi8_r", "cp1251", 1), ("cp1251", "koi8_r", 1), ("cp866", "cp1251", 1), ("cp1251", "cp866", 1),
    ("cp932", "gb18030", 1), ("euc_jp", "gb18030", 1), ("gb18030", "cp932", 1), ("euc_jp", "cp932", 1), ("big5", "gb18030", 1), ("gb18030", "big5", 1), ("gb18030", "euc_kr", 1), ("cp932", "mac_roman", 1),
)
_TOKEN = re.compile(r"[^ \t\r\n]+")
#: Long tokens (scripts without spaces) are cut at marks of these scripts.
_CLAUSE = re.compile(r"[^。、，；：？！「」]+[。、，；：？！「」]*")


@functools.lru_cache(maxsize=None)
def _to_byte(codec: str) -> dict[int, str]:
    """Characters of a one-byte encoding as Latin-1 characters of their bytes; bytes without a character stand for themselves."""
    table = {i: chr(i) for i in range(256)}
    for i in range(256):
        try:
            table[ord(bytes([i]).decode(codec))] = chr(i)
        except UnicodeDecodeError:
            pass
    for i in range(128, 256):  # a character of the encoding itself goes before the stand-ins
        try:
            table[ord(bytes([i]).decode(codec))] = chr(i)
        except UnicodeDecodeError:
            pass
    return table


def undo(s: str, channel: tuple[str, str, int]) -> str | None:
    """What ``s`` was before the channel; U+FFFD where a byte is lost; None if it can't have come through the channel."""
    true, wrong, rounds = channel
    for _ in range(rounds):
        if wrong == "html":
            s, wrong_now = html.unescape(s), "cp1252"
        else:
            wrong_now = wrong
        try:
            if wrong_now in _SINGLE:
                raw = s.replace("�", "\x00").translate(_to_byte(wrong_now)).encode("latin-1")
            else:
                raw = s.replace("�", "\x00").encode(wrong_now)
        except UnicodeEncodeError:
            return None
        lost = b"\x00" in raw
        try:
            out = raw.decode(true)
        except UnicodeDecodeError:
            if not lost and wrong_now in _SINGLE:
                return None
            out = raw.decode(true, "replace")
            if out.count("�") - s.count("�") > len(out) / 6 or out.count("�") * 3 > len(out) + 2:
                return None
        s = re.sub("[\x00�]+", "�", out)
    return s


class Model:
    """Log frequencies of words and of pairs of characters."""

    def __init__(self, pairs: dict[str, int], words: dict[str, int]):
        self.pairs, self.words = pairs, words
        first: Counter = Counter()
        for p, n in pairs.items():
            first[p[0]] += n
        self.first, self.kinds = first, max(1000, len(first))
        self.total = max(1, sum(words.values()))
        self.cache: dict[str, float] = {}
        self.options: dict[str, dict] = {}
        self.by_shape: dict[tuple, list[str]] = {}
        for w in words:
            if len(w) > 2 and "�" not in w and any(ord(c) > 127 for c in w):
                self.by_shape.setdefault((len(w), w[0]), []).append(w)

    def score(self, s: str) -> float:
        """Log probability of a token."""
        hit = self.cache.get(s)
        if hit is not None:
            return hit
        core = s.strip("\"'.,;:!?()[]{}«»„“”‘’-–—*•")
        text = f" {s} "
        z = 0.0
        for a, b in zip(text, text[1:]):
            if b == "�":
                z -= 9.0
            else:
                z += math.log((self.pairs.get(a + b, 0) + 0.02) / (self.first.get(a, 0) + 0.02 * self.kinds))
        n = self.words.get(core, 0)
        if n > 3 and len(core) > 1:
            z = max(z, math.log(n / self.total) - 0.5 * (len(s) - len(core)))
        if len(self.cache) < 200_000:
            self.cache[s] = z
        return z

    def fill(self, s: str) -> str | None:
        """The commonest word that fits a token with lost characters (each U+FFFD is one, or a stretch of them one)."""
        core = s.strip("\"'.,;:!?()[]{}«»„“”‘’-–—*•")
        if not re.search(r"[^\W\d_]", core):
            return None
        best = None
        for c in {core, re.sub("�+", "�", core)}:
            pattern = re.compile("".join("[^\x00-\x7f]" if x == "�" else re.escape(x) for x in c))
            for w in self.by_shape.get((len(c), c[0]), ()) if c[0] != "�" else (w for (n, _), ws in self.by_shape.items() if n == len(c) for w in ws):
                if pattern.fullmatch(w) and (best is None or self.words[w] > self.words[best]):
                    best = w
        return s.replace(core, best) if best else None


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Places of the tokens that hold something else than ASCII."""
    for m in _TOKEN.finditer(text):
        if m.group().isascii() and "&" not in m.group():
            continue
        if m.end() - m.start() <= 40:
            yield m.span()
        else:
            for c in _CLAUSE.finditer(text, m.start(), m.end()):
                if not c.group().isascii():
                    yield c.span()


@functools.lru_cache(maxsize=None)
def _marks() -> tuple[re.Pattern, dict[int, frozenset]]:
    """What a token must hold to have come through a channel: for UTF-8 read as a one-byte encoding a lead byte's sign
    before a following byte's; for one-byte encodings the signs that become letters."""
    pairs, become = [], {}
    for k, (true, wrong, _) in enumerate(CHANNELS, 1):
        if wrong in _SINGLE:
            table = _to_byte(wrong)
            if true == "utf-8":
                lead = "".join(re.escape(chr(c)) for c, x in table.items() if "\xc2" <= x <= "\xf4")
                rest = "".join(re.escape(chr(c)) for c, x in table.items() if "\x80" <= x <= "\xbf")
                pairs.append(f"[{lead}][{rest}�]")
            elif true in _SINGLE:
                good = set()
                for c, x in table.items():
                    if c > 127:
                        t = x.encode("latin-1").decode(true, "replace")
                        if t.isalpha() or t in "«»„“”‘’–—•€¿¡":
                            good.add(chr(c))
                become[k] = frozenset(good)
    return re.compile("|".join(dict.fromkeys(pairs))), become


_LOST = re.compile("[\x80-\x84\x86-\x9f�]")
_HIGH = re.compile(r"[\x80-˿Ѐ-ԯ‐-™]{2,}")
_ASIAN = re.compile(r"[⺀-퟿豈-﫿＀-￯]")


def _options(tok: str, model: Model) -> dict[int, tuple[str, float]]:
    """By state (0: as it stands) the text a token would be and its log probability."""
    out = {0: (tok, model.score(tok))}
    marks, become = _marks()
    odd = {c for c in tok if c > "\x7f"}
    odd.discard("�")
    eight, high, asian, escaped = marks.search(tok), _HIGH.search(tok), _ASIAN.search(tok), "&" in tok
    word = any(c.isalpha() for c in tok)
    for k, ch in enumerate(CHANNELS, 1):
        if ch[1] == "html":
            if not escaped:
                continue
        elif ch[1] not in _SINGLE:
            if not asian:
                continue
        elif ch[0] == "utf-8":
            if not eight:
                continue
        elif k in become:
            if not word or not odd or not odd <= become[k]:
                continue
        elif not high:
            continue
        t = undo(tok, ch)
        if ch[1] == "html" and t is not None and t.isascii():
            continue  # an escape of a plain sign is no wrong encoding
        if t is not None and t != tok and t and not any(c < " " or "\x7f" <= c <= "\x9f" for c in t):
            out[k] = (t, model.score(t))
    return out


def decode(text: str, model: Model) -> tuple[bool, str, float]:
    """Whether a text is affected, the text restored as far as possible, and the gain in nats."""
    spans = list(_pieces(text))
    if not spans:
        return False, text, 0.0
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    plain = 0.0
    kept: list[dict[int, tuple[str, float]]] = []
    memo = model.options
    for a, b in spans:
        tok = text[a:b]
        opt = memo.get(tok)
        if opt is None:
            opt = _options(tok, model)
            if len(memo) < 200_000:
                memo[tok] = opt
        kept.append(opt)
        plain += opt[0][1]
        if len(opt) == 1 and len(best) == 1:
            best = {0: (best[0][0] + opt[0][1], (0, best[0][1]))}
            continue
        top = max(best.items(), key=lambda x: x[1][0])
        new: dict[int, tuple[float, tuple | None]] = {}
        for k in {*opt, *best}:
            # a channel may also leave a token as it is (what it gives is nothing): then the token costs what it stands for
            e = opt[k][1] if k in opt else (opt[0][1] if tok.isascii() else opt[0][1] - 1.5)
            stay = best[k][0] if k in best else -math.inf
            move = top[1][0] - (0.0 if k == top[0] else 0.3 if k and CHANNELS[k - 1][0] == "utf-8" else SWITCH if k else 0.1)
            new[k] = (stay + e, (k, best[k][1])) if stay >= move else (move + e, (k, top[1][1]))
        limit = max(v[0] for v in new.values()) - 40
        best = {k: v for k, v in new.items() if v[0] >= limit or k == 0}
    score, path = max(best.values(), key=lambda x: x[0])
    states: list[int] = []
    while path is not None:
        states.append(path[0])
        path = path[1]
    states.reverse()
    out, at, changed = [], 0, False
    for (a, b), opt, k in zip(spans, kept, states):
        tok = text[a:b]
        t = opt[k][0] if k in opt else tok
        if t != tok:
            changed = True
        if "�" in t:
            t = model.fill(t) or t
        out += [text[at:a], t]
        at = b
    out.append(text[at:])
    gain = score - plain
    lost = bool(_LOST.search(text))
    sure = all(k == 0 or CHANNELS[k - 1][0] == "utf-8" for k in states)  # valid UTF-8 by chance is rare
    return (changed and gain >= (0.1 if sure else GAIN)) or lost, "".join(out), round(gain, 4)


def _count_udf():
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs: Counter = Counter()
            words: Counter = Counter()
            for text in pdf["text"]:
                for a, b in _pieces(text):
                    s = f" {text[a:b]} "
                    pairs.update(map("".join, zip(s, s[1:])))
                    w = text[a:b].strip("\"'.,;:!?()[]{}«»„“”‘’-–—*•")
                    if len(w) > 1:
                        words[w] += 1
            yield pd.DataFrame([("p", k, n) for k, n in pairs.items()] + [("w", k, n) for k, n in words.items()], columns=["kind", "k", "n"])

    return count


def learn(texts: DataFrame) -> Model:
    """The model of all ``text`` of a table; its size is bounded."""
    counts = cut(texts.filter("text is not null").mapInPandas(_count_udf(), "kind string, k string, n long").groupBy("kind", "k").agg(F.sum("n").alias("n")))
    top = lambda kind, most: {r["k"]: r["n"] for r in counts.filter((F.col("kind") == kind) & (F.col("n") > 1)).orderBy(F.desc("n"), "k").limit(most).collect()}
    return Model(top("p", PAIRS), top("w", WORDS))


def restore(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, restored, gain`` of each affected document of ``df``; repeated rows and texts each count.

    Null, empty and blank texts aren't affected; what can't be restored stays as it was, with U+FFFD where characters
    are lost. Equal texts are decoded once. Other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]|&(?:#x?[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"))
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("h2", F.hash("text"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = cut(docs.groupBy("h", "h2").agg(F.first("text").alias("text")).repartition(n, "h"))  # read for the model and again for decoding
    model = df.sparkSession.sparkContext.broadcast(learn(texts))

    @F.pandas_udf("found boolean, restored string, gain double")
    def decoded(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(t, model.value) for t in text], columns=["found", "restored", "gain"])

    found = cut(texts.select("h", "h2", decoded("text").alias("d")).filter("d.found").select("h", "h2", "d.restored", "d.gain"))
    return docs.select("doc_id", "h", "h2").join(found, ["h", "h2"]).select("doc_id", "restored", "gain")
