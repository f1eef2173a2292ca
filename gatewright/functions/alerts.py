"""Alert features and priority rules."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatewright import params as P


def lookup(c: Column, table: dict, default=None) -> Column:
    """Value of ``c`` in a small fixed table (a literal map, so no join and no shuffle)."""
    literal_map = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    hit = F.try_element_at(literal_map, c)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def severity_score_a(c: Column) -> Column:
    return lookup(F.lower(c), P.SEVERITY_SCORES_CPPCHECK, 0)


def severity_score_b(c: Column) -> Column:
    return lookup(F.lower(c), P.SEVERITY_SCORES_CLANG, 0)


def has_value(c: Column) -> Column:
    """1 unless the text is null, blank, or one of nan / none / null."""
    word = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return (~word.isin(P.BLANK_WORDS)).cast("int")


def keyword_flag(c: Column, terms: list[str]) -> Column:
    """1 if any term is a substring, ignoring case. A chain of ``contains`` stays inside codegen."""
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms]).cast("int")


def tool_flag(c: Column, name: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(name)), F.lit(False)).cast("int")


def priority_a(is_actionable: Column, severity: Column) -> Column:
    urgent = F.coalesce(F.lower(severity).isin("error", "critical"), F.lit(False))
    return F.when(~is_actionable, "LOW").when(urgent, "HIGH").otherwise("MEDIUM")


def priority_b(ground_truth: Column, family: Column) -> Column:
    truth = F.lower(F.trim(F.coalesce(ground_truth, F.lit(""))))
    name = F.trim(F.coalesce(family, F.lit("")))
    bad = truth == "bad"
    return (
        F.when(truth == "good", "LOW")
        .when(bad & (name == P.MEDIUM_FAMILY), "MEDIUM")
        .when(bad & name.isin(P.HIGH_FAMILIES), "HIGH")
        .otherwise("UNKNOWN")
    )


def label_of(priority: Column) -> Column:
    """0 / 1 / 2; null for UNKNOWN."""
    return lookup(priority, P.LABEL_OF_PRIORITY)


def priority_of(label: Column) -> Column:
    return lookup(label.cast("int"), P.PRIORITY_OF_LABEL)


def priority_rank(priority: Column) -> Column:
    return lookup(priority, P.RANK_OF_PRIORITY)
