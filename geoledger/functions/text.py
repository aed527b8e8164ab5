"""Text clean-up as column expressions; entity decoding is the one Arrow UDF."""

from __future__ import annotations

import html
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPACE = r"(?U)[\s \x1c-\x1f]+"


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def unescape_entities(text: Column) -> Column:
    """Decode HTML entities; only texts that hold an ampersand travel to Python."""
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def plain_text(markup: Column) -> Column:
    return collapse_space(unescape_entities(strip_tags(markup)))


def after_marker(text: Column, marker: str) -> Column:
    """Text after the first marker, or the whole text when there is none."""
    start = F.instr(text, marker)
    return F.when(start > 0, F.substring(text, start + F.lit(len(marker)), F.length(text))).otherwise(text)


def before_stops(text: Column, stops: Iterable[str]) -> Column:
    """Text before each stop in turn."""
    for stop in stops:
        text = F.substring_index(text, stop, 1)
    return text


def strip_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def filled(text: Column) -> Column:
    """NULL for NULL or empty text."""
    return F.nullif(text, F.lit(""))


def name_matches(query: str, names: list[Column], aliases: Column) -> Column:
    """Case-insensitive substring match in any name or alias; a trimmed query under two characters matches none."""
    wanted = query.strip().lower()
    if len(wanted) < 2:
        return F.lit(False)
    every = F.concat(F.array(*names), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.exists(every, lambda n: F.coalesce(F.contains(F.lower(n), F.lit(wanted)), F.lit(False)))
