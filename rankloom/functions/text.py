"""Column functions on strings, with the null and blank rules used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """Remove white space of any Unicode kind (and zero-width signs) at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s​‌‍⁠﻿ ]+|[\s​‌‍⁠﻿ ]+$", "")


def squeeze(c: Column | str) -> Column:
    """``strip`` and make each inner stretch of white space one space."""
    return strip(F.regexp_replace(c, r"(?U)[\s​⁠﻿ ]+", " "))


def is_blank(c: Column | str) -> Column:
    """True for null, empty, white space only and the text ``nan``; never null."""
    return F.coalesce(F.lower(strip(c)).isin("", "nan"), F.lit(True))


def missing_to_null(c: Column | str) -> Column:
    """Stripped text; null where blank or one of ``nan``, ``none``, ``null`` in any case."""
    s = strip(c)
    return F.when(F.coalesce(F.lower(s).isin("", "nan", "none", "null"), F.lit(True)), F.lit(None)).otherwise(s)


_WS = r"[\s\x{0B}\x{85}\p{Z}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"


def strip_sql(x: str) -> str:
    """``strip`` as DuckDB SQL."""
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def squeeze_sql(x: str) -> str:
    """``squeeze`` as DuckDB SQL."""
    return strip_sql(rf"regexp_replace({x}, '[\s\x{{0B}}\x{{85}}\p{{Z}}\x{{200B}}\x{{2060}}\x{{FEFF}}]+', ' ', 'g')")
