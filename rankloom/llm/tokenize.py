"""Token ids of whole corpora by a public byte-level BPE vocabulary.

Short texts are encoded as they are. A text longer than ``leaf_chars`` is cut at places where the vocabulary's
pattern always cuts (a white space after something else, a mark after a letter), whatever stands around, so the
pieces' ids concatenate. A stretch without such a place is cut into its pattern matches, and a match longer than
``leaf_chars`` into leaves of that length. Pieces and leaves are separate rows, encoded in parallel. Leaves are
joined as a tree: around each join a window of tokens is encoded again and doubled until its first token equals
the left side's and its last the right side's. Equality on both sides is enough: a token sequence is the
encoding of its bytes as soon as each adjacent pair is the encoding of the pair's bytes, and all pairs within the
window and within both sides are.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split pattern published with the byte-level BPE vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points of a text, and of a leaf of one, that are encoded at once.
LEAF_CHARS = 32_768

_SPLIT = regex.compile(PATTERN)
#: Places at which the pattern cuts in any surroundings: a space or line end after a visible sign, and a mark after a letter.
_SAFE = regex.compile(r"(?<=[A-Za-z0-9.,;:!?)\]}\"À-ɏЀ-ӿ、。぀-ヿ一-鿿，])(?=[ \n])|(?<=[A-Za-zÀ-ÖØ-öА-яぁ-ゖ一-龥])(?=[.,;:!?()\[\]{}\"、。「」，])")


def default_vocabulary() -> str:
    """Path of the installed 50k byte-level vocabulary in rank form."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The vocabulary at ``path``, loaded once in each Python worker; it has no special tokens, so their strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut_text(text: str, leaf: int = LEAF_CHARS) -> list[tuple[int, int, str]]:
    """Cut a text into (run, raw, piece): the pieces of one run are leaves of a single pattern match (raw = 1, joined as
    a tree); any other piece is a run of its own (raw = 0) whose ids just follow the former ones."""
    out: list[tuple[int, int, str]] = []
    run, at = 0, 0
    while at < len(text):
        if len(text) - at <= leaf:
            out.append((run, 0, text[at:]))
            break
        end = 0
        for m in _SAFE.finditer(text, at + leaf // 2, at + leaf + 1):
            end = m.start()
        if not end:
            m = _SAFE.search(text, at + leaf)
            end = m.start() if m else len(text)
        if end - at <= leaf:
            out.append((run, 0, text[at:end]))
            run += 1
        else:
            for raw, pieces in _cut_stretch(text[at:end], leaf):
                out += [(run, raw, p) for p in pieces]
                run += 1
        at = end
    return out


def _cut_stretch(s: str, leaf: int) -> Iterator[tuple[int, list[str]]]:
    """A stretch without a safe place: groups of whole pattern matches, and long matches in leaves."""
    group: list[str] = []
    size = 0
    for m in [*_SPLIT.finditer(s), None]:
        p = m.group() if m else ""
        if m and len(p) <= leaf:
            group.append(p)
            size += len(p)
            if size < leaf // 2 or p[-1].isspace():  # after white space the next match depends on what follows
                continue
        tail = []
        while group and group[-1][-1].isspace():
            tail.append(group.pop())
        if group:
            yield 0, ["".join(group)]
        for x in reversed(tail):  # as matches of their own
            yield 1, [x]
        group, size = [], 0
        if len(p) > leaf:
            yield 1, [p[i : i + leaf] for i in range(0, len(p), leaf)]


def join_ids(enc, left: list[int], right: list[int], first: int = 4) -> list[int]:
    """Ids of one pattern match from the ids of its two parts."""
    if not left or not right:
        return left or right
    k = first
    while True:
        a, b = left[-k:], right[:k]
        w = enc._encode_single_piece(enc.decode_bytes(a + b))
        if (k >= len(left) or w[0] == a[0]) and (k >= len(right) or w[-1] == b[-1]):
            return left[: max(0, len(left) - k)] + w + right[k:]
        k *= 2


def join_tree(enc, leaves: list[list[int]]) -> list[int]:
    """Join neighbours, then neighbours of the results, until one is left."""
    while len(leaves) > 1:
        leaves = [join_ids(enc, leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else []


def encode_whole(enc, text: str | None, leaf: int = LEAF_CHARS) -> list[int]:
    """Ids of one text in this process, by the same cuts and joins."""
    if not text:
        return []
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    runs: dict[int, list[list[int]]] = {}
    for run, raw, p in cut_text(text, leaf):
        runs.setdefault(run, []).append(enc._encode_single_piece(p) if raw else enc.encode_ordinary(p))
    for run in sorted(runs):
        ids += join_tree(enc, runs[run])
    return ids


def _ids_udf(path: str, counts_only: bool = False):
    if counts_only:

        @F.pandas_udf(T.IntegerType())
        def count(texts: pd.Series, raw: pd.Series) -> pd.Series:
            enc = encoder(path)
            return pd.Series([len(enc._encode_single_piece(t) if r else enc.encode_ordinary(t)) if t else 0 for t, r in zip(texts, raw)], dtype="int32")

        return count

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series, raw: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([(enc._encode_single_piece(t) if r else enc.encode_ordinary(t)) if t else [] for t, r in zip(texts, raw)], dtype=object)

    return ids


def _cut_udf(leaf: int):
    @F.pandas_udf("array<struct<run:int,raw:int,piece:string>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"run": a, "raw": b, "piece": c} for a, b, c in cut_text(t, leaf)] for t in texts], dtype=object)

    return pieces


def _join_udf(path: str):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def joined(parts: pd.Series) -> pd.Series:
        enc = encoder(path)
        out = []
        for rows in parts:
            ids: list[int] = []
            run, leaves = None, []
            for r in rows:
                if r["run"] != run:
                    ids += join_tree(enc, leaves)
                    run, leaves = r["run"], []
                leaves.append(list(r["ids"]))
            out.append(ids + join_tree(enc, leaves))
        return pd.Series(out, dtype=object)

    return joined


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of each row.

    Null and empty texts get an empty list; a repeated row comes out as often as it came in; an empty table gives
    no rows. Other columns of ``df``, whatever their names, are not read. Null ids are kept.
    """
    path = vocabulary or default_vocabulary()
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    ids = _ids_udf(path)
    is_long = F.coalesce(F.length("t") > leaf_chars, F.lit(False))
    short = rows.filter(~is_long).select("k", ids(F.coalesce("t", F.lit("")), F.lit(0)).alias("ids"))
    # a long text's pieces become rows, spread over the cluster; equal rows are encoded once and repeated at the end
    long = rows.filter(is_long).groupBy("k", "t").agg(F.count(F.lit(1)).cast("int").alias("n"))
    pieces = (
        long.select("k", "n", F.xxhash64("t").alias("h"), F.posexplode(_cut_udf(leaf_chars)(F.col("t"))).alias("pos", "p"))
        .select("k", "n", "h", "pos", "p.run", "p.raw", "p.piece")
        .repartition("k", "h", "pos")
        .select("k", "n", "h", "pos", "run", ids("piece", "raw").alias("ids"))
    )
    joined = (
        pieces.groupBy("k", "h", "n")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "run", "ids"))).alias("parts"))
        .select("k", "n", _join_udf(path)("parts").alias("ids"))
        .select("k", F.explode(F.array_repeat("ids", F.col("n"))).alias("ids"))
    )
    return short.unionByName(joined).select(F.col("k").alias(id_col), "ids")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``id_col`` and ``n_tokens`` of each row; the ids themselves are not moved for short texts."""
    path = vocabulary or default_vocabulary()
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    is_long = F.coalesce(F.length("t") > leaf_chars, F.lit(False))
    short = rows.filter(~is_long).select("k", _ids_udf(path, True)(F.coalesce("t", F.lit("")), F.lit(0)).alias("n_tokens"))
    long = encode_documents(rows.filter(is_long), "k", "t", path, leaf_chars).select("k", F.size("ids").alias("n_tokens"))
    return short.unionByName(long).select(F.col("k").alias(id_col), "n_tokens")
