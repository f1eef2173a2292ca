"""Message and markup text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The markup entities replaced inside the JVM, in this order; the ampersand comes last.
COMMON_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
# One word character, one blank character.
WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x0b\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Report fields, tried from left to right.
REPORT_MESSAGE = [r"<!--\s*BUGDESC\s*(.*?)\s*-->", r"<h3[^>]*>(.*?)</h3>", r"<title>(.*?)</title>"]
REPORT_FILE = [r"<!--\s*BUGFILE\s*(.*?)\s*-->", r"File:\s*</td>\s*<td[^>]*>(.*?)</td>", r"File:\s*(.*?)<"]
REPORT_LINE = [r"<!--\s*BUGLINE\s*(\d+)\s*-->", r"Line:\s*</td>\s*<td[^>]*>(\d+)</td>", r"Line:\s*(\d+)"]


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_common(c: Column) -> Column:
    for entity, plain in COMMON_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def clean_html(c: Column, all_entities: bool = False) -> Column:
    """Entities first, then tags, then blanks. ``all_entities`` uses an Arrow batch function for the full table."""
    text = F.coalesce(c, F.lit(""))
    text = _unescape(text) if all_entities else unescape_common(text)
    text = F.regexp_replace(text, r"<[^>]+>", "")
    text = F.regexp_replace(text, f"[{BLANK}]+", " ")
    return F.trim(text)


def first_match(c: Column, patterns: list[str], all_entities: bool = False) -> Column:
    """Group 1 of the first pattern that matches at all, even if it cleans to an empty text."""
    found = None
    for pattern in patterns:
        full = "(?is)" + pattern
        hit = F.regexp_extract(c, full, 1)
        found = F.when(c.rlike(full), hit) if found is None else found.when(c.rlike(full), hit)
    return clean_html(found.otherwise(F.lit("")), all_entities)


def norm_message(c: Column) -> Column:
    """Drop a trailing ``[checker]`` and outer punctuation, collapse blanks, lower the case."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), f"^[{BLANK}]+|[{BLANK}]+$", "")
    text = F.regexp_replace(text, f"[{BLANK}]*\\[[^\\]]+\\][{BLANK}]*$", "")
    text = F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.lower(F.regexp_replace(text, f"[{BLANK}]+", " "))


def is_bad(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)(^|[^A-Za-z0-9])bad(Sink|Source)?[0-9]*([^A-Za-z0-9]|$)")


def is_good(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?i)(^|[^A-Za-z0-9])good(G2B|B2G)?[0-9]*([^A-Za-z0-9]|$)")


def ground_truth(source_function: Column, enclosing: Column) -> tuple[Column, Column]:
    """(status, origin): the diagnostic's function decides, else the enclosing function, else unknown."""
    own_bad, own_good = is_bad(source_function), is_good(source_function)
    near_bad, near_good = is_bad(enclosing), is_good(enclosing)
    status = (
        F.when(own_bad, "bad").when(own_good, "good").when(near_bad, "bad").when(near_good, "good").otherwise("unknown")
    )
    origin = (
        F.when(own_bad | own_good, "plist_source_function")
        .when(near_bad | near_good, "enclosing_function")
        .otherwise("unknown")
    )
    return status, origin


def alert_id(message: Column) -> Column:
    return F.substring(F.substring_index(message, ":", 1), 1, 60)


def annotation_id(*parts: Column) -> Column:
    """``clang-ann-`` and 16 hex digits of the sha1 of the parts joined with ``|``."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("clang-ann-"), F.substring(F.sha1(joined), 1, 16))


def function_name(prefix: Column) -> Column:
    """Last (qualified) name of a signature prefix."""
    name = F.regexp_extract(F.trim(prefix), r"((?:[A-Za-z_~][\p{L}\p{N}_]*)(?:::[A-Za-z_~][\p{L}\p{N}_]*)*)\s*$", 1)
    return F.when(name == "", "anonymous_function").otherwise(name)
