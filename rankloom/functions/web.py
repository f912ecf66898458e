"""Text from pages and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def html_to_text(c: Column | str) -> Column:
    """Without scripts and styles, tags as spaces, white space squeezed."""
    c = F.regexp_replace(c, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def domain(url: Column | str) -> Column:
    """Host without ``www.``, in lower case; empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#:\s]+)", 1)


def name_key(c: Column | str) -> Column:
    """The first two words of a name, letters only, in lower case."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z ]", "")), " +"), 1, 2), " ")


def domain_guess(company: Column | str) -> Column:
    """``acme.com`` for ``Acme Inc``; empty if fewer than four letters are left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(company), r"\s+(?:inc|ltd|llc|corp|plc|gmbh|ag|co|company|limited)\.?\s*$", ""), "[^a-z0-9]", "")
    return F.when(F.length(slug) >= 4, F.concat(slug, F.lit(".com"))).otherwise("")


def looks_like_name(c: Column | str) -> Column:
    """Two to five words, under 60 signs, no digit, not all in capitals."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.size(F.split(F.trim(c), r"\s+"))
    return F.coalesce(n.between(2, 5) & (F.length(c) < 60) & ~c.rlike(r"\d") & (c != F.upper(c)), F.lit(False))
