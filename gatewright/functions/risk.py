"""Risk scores, levels, reasons and issue texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from gatewright import params as P
from gatewright.functions.numbers import number_text, round_half_up


def risk_score(p: Column) -> Column:
    return round_half_up(p * F.lit(100.0), 2)


def risk_level(score: Column, medium: float = 40.0, high: float = 70.0) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def confidence(p: Column) -> Column:
    return round_half_up(F.abs(p - F.lit(0.5)) * F.lit(2.0), 4)


def review_gate(level: Column, conf: Column, threshold: float = 0.2) -> Column:
    return F.when((conf < threshold) & (level != "HIGH"), "REVIEW_REQUIRED").otherwise(level)


def risky_terms(code: Column, terms: list[str] | None = None, n: int = 5) -> Column:
    """The first ``n`` terms of the list (list order) that are substrings of the code."""
    text = F.lower(code)
    hits = [F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in (terms or P.RISKY_TERMS)]
    return F.slice(F.array_compact(F.array(*hits)), 1, n)


def risk_reason(level: Column, terms: Column, fallback: Column, conf: Column, threshold: float = 0.2) -> Column:
    # The reason sentences.
    shown = F.array_join(F.slice(terms, 1, 3), ", ")
    any_terms = F.size(terms) > 0
    limit = number_text(F.lit(float(threshold)))
    review = F.concat(
        F.lit("REVIEW_REQUIRED because model confidence ("), number_text(conf), F.lit(") is below threshold ("), limit,
        F.lit(")."),
        F.when(any_terms, F.concat(F.lit(" Potential risky terms include "), shown, F.lit("."))).otherwise(F.lit("")),
    )
    main = (
        F.when(level == "REVIEW_REQUIRED", review)
        .when(any_terms, F.concat(level, F.lit(" because modified function contains "), shown, F.lit(" patterns.")))
        .when(level == "HIGH", "HIGH based on model confidence for vulnerable code patterns.")
        .when(level == "MEDIUM", "MEDIUM based on model confidence for potentially risky code patterns.")
        .otherwise("LOW because no strong vulnerable pattern signals were detected.")
    )
    note = F.when(fallback, " Function extraction failed, so full-file fallback analysis was used.").otherwise("")
    return F.concat(main, note)


def positive_score(kind: str, c: Column) -> Column:
    """Score of the positive class from a ``probability`` vector, a ``margin`` number or a plain ``prediction``."""
    if kind == "probability":
        return vector_to_array(c)[1]
    if kind == "margin":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))
    return c.cast("double")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(P.TRUE_WORDS), F.lit(False))


def norm_status(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def alert_text(tool: Column, alert_id: Column, file: Column, line: Column, message: Column) -> Column:
    """``tool | id | file:line | message``; the line is left out where it is null or blank."""
    line_text = F.trim(F.coalesce(line.cast("string"), F.lit("")))
    place = F.concat(F.coalesce(file, F.lit("")), F.when(line_text != "", F.concat(F.lit(":"), line_text)).otherwise(""))
    return F.concat_ws(
        " | ", F.coalesce(tool, F.lit("unknown")), F.coalesce(alert_id, F.lit("")), place, F.coalesce(message, F.lit(""))
    )


def commit_text(file_path: Column, score: Column) -> Column:
    return F.concat(
        F.lit("commit-risk | "), F.coalesce(file_path, F.lit("")), F.lit(" | risk score: "), number_text(score)
    )


def run_identifier(given: Column, github_run: Column, sha: Column, ts: Column) -> Column:
    """First usable of: the given id, ``gh_run:<id>``, ``sha:<sha>:<ts>``, ``sha:<sha>``, ``ts:<ts>``, empty."""
    def text(c: Column) -> Column:
        return F.nullif(F.trim(c.cast("string")), F.lit(""))

    g, s, t = text(github_run), text(sha), text(ts)
    return F.coalesce(
        text(given),
        F.concat(F.lit("gh_run:"), g),
        F.concat(F.lit("sha:"), s, F.lit(":"), t),
        F.concat(F.lit("sha:"), s),
        F.concat(F.lit("ts:"), t),
        F.lit(""),
    )


def now_utc() -> Column:
    """Time of the job, kept out of compared results."""
    return F.current_timestamp()
