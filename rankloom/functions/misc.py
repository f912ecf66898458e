"""Small column functions of charts and logs: metadata, times, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_metadata(*cols: str) -> Column:
    """The columns as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*cols))


def unpack_metadata(c: Column | str, schema: str) -> Column:
    """The fields of ``schema`` of a JSON object; null where the text is no JSON, and for fields that aren't there."""
    return F.from_json(c, schema)


def utc_stamp(at: Column | None = None) -> Column:
    """A time as ISO text in UTC with seconds (the session's time zone is UTC); now by default."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_stamp(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd")


def rgb(hex_colour: Column | str) -> Column:
    """Struct of red, green and blue (0 to 255) of a colour such as ``#3491E8``; null if it is none."""
    c = F.col(hex_colour) if isinstance(hex_colour, str) else hex_colour
    part = lambda i: F.conv(F.substring(F.regexp_replace(c, "^#", ""), i, 2), 16, 10).cast("int")
    return F.when(c.rlike("^#?[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("red"), part(3).alias("green"), part(5).alias("blue")))


def luminance(hex_colour: Column | str) -> Column:
    """Brightness of a colour, 0 to 1: what decides whether text on it is dark or light."""
    c = rgb(hex_colour)
    return F.round((0.299 * c["red"] + 0.587 * c["green"] + 0.114 * c["blue"]) / 255, 6)
