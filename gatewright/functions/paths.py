"""File paths, case ids and CWE names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewright import params as P


def norm_path(c: Column) -> Column:
    slashes = F.translate(F.trim(F.coalesce(c, F.lit(""))), "\\", "/")
    return F.regexp_replace(slashes, "/+", "/")


def path_parts(c: Column) -> Column:
    return F.filter(F.split(norm_path(c), "/"), lambda p: p != "")


def path_suffixes(c: Column) -> Column:
    """Every tail of the path that starts at a component, longest first."""
    parts = path_parts(c)
    tails = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
        lambda i: F.array_join(F.slice(parts, i, F.greatest(F.size(parts), F.lit(1))), "/"),
    )
    return F.filter(tails, lambda t: t != "")


def char_suffixes(c: Column) -> Column:
    """Every non-empty character tail of the text, including the text itself."""
    return F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: i <= F.length(c)),
        lambda i: F.substring(c, i, F.length(c)),
    )


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def stem(c: Column) -> Column:
    """Last component without its extension; a leading dot is part of the name."""
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]+$", "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(c), r".(\.[^.]+)$", 1))


def is_source_file(c: Column) -> Column:
    return extension(c).isin(P.SOURCE_EXTENSIONS)


def in_excluded_folder(c: Column) -> Column:
    return F.arrays_overlap(F.split(c, "/"), F.array(*[F.lit(x) for x in P.EXCLUDED_FOLDERS]))


def under_scan_path(c: Column, scan_path: str) -> Column:
    """Component-wise prefix: ``src2/a.c`` is not under ``src``. ``.`` or an empty path takes everything."""
    root = scan_path.strip().strip("/").removeprefix("./")
    if root in ("", "."):
        return F.lit(True)
    return c.startswith(root + "/") | (c == root)


def cwe_number(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"CWE(\d+)", 1)


def cwe_family(path: Column) -> Column:
    """First component that starts with CWE and contains an underscore."""
    hits = F.filter(F.split(path, "/"), lambda p: p.startswith("CWE") & F.contains(p, F.lit("_")))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(""))


def case_id(file_stem: Column) -> Column:
    """Annotation case: drop one trailing letter a-e that follows a digit."""
    return F.regexp_replace(file_stem, r"([0-9])[a-e]$", "$1")


def case_group_id(file_stem: Column) -> Column:
    """Sampling case: drop every trailing ``_bad``, ``_good…`` or ``_<digits><letter>`` part."""
    return F.regexp_replace(file_stem, r"(?:_(?:bad|goodG2B|goodB2G|good|[0-9]+[a-z]?))+$", "")
