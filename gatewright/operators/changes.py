"""Diff hunks, changed functions and whole-file fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.operators.spans import code_of, function_span_array, source_lines
from gatewright.session import cut_lineage

# Fixed value: the header of a unified-diff hunk.
HUNK = r"@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"
FALLBACK_NAME = "__FILE_FALLBACK__"
FILE_KEYS = ["repo_id", "run_id", "file_path"]
LINE_BIN = 256


def hunk_array(diff_text: Column) -> Column:
    """Changed line ranges (start_line, end_line) of the new file; ranges of zero lines are no change."""
    heads = F.filter(F.split(diff_text, r"\r\n|\r|\n"), lambda x: x.startswith("@@") & x.rlike(HUNK))

    def bounds(head: Column) -> Column:
        start = F.regexp_extract(head, HUNK, 1).try_cast("int")
        count = F.coalesce(F.nullif(F.regexp_extract(head, HUNK, 2), F.lit("")).try_cast("int"), F.lit(1))
        return F.struct(start.alias("start_line"), (start + count - 1).alias("end_line"))

    return F.filter(F.transform(heads, bounds), lambda h: h.end_line >= h.start_line)


def changed_hunks(diffs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return diffs.select(*(keys or FILE_KEYS), F.inline(hunk_array(F.col("diff_text"))))


def changed_lines(diffs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per changed line; only for reports — joins work on the ranges."""
    ranges = changed_hunks(diffs, keys)
    return ranges.select(*(keys or FILE_KEYS), F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()


def _bins(df: DataFrame, low: str, high: str, width: int) -> DataFrame:
    return df.withColumn(
        "__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    )


def touched_functions(funcs: DataFrame, hunks: DataFrame, keys: list[str] | None = None, width: int = LINE_BIN) -> DataFrame:
    """Functions that overlap a changed range of their file.

    Ranges are cut into line bins, so the join has an equality key (file and bin) and a huge file is spread over many
    tasks instead of being compared range by range in one. The functions are written first: they are read twice, and parsing
    their files costs more.
    """
    keys = keys or FILE_KEYS
    funcs = cut_lineage(funcs, "functions")
    identity = [*keys, "function_name", "start_line", "end_line"]
    left = _bins(funcs.select(*identity), "start_line", "end_line", width).alias("f")
    right = _bins(hunks.select(*keys, "start_line", "end_line"), "start_line", "end_line", width).alias("h")
    same = [F.col(f"f.{k}") == F.col(f"h.{k}") for k in [*keys, "__bin"]]
    overlap = (F.col("f.start_line") <= F.col("h.end_line")) & (F.col("h.start_line") <= F.col("f.end_line"))
    hit = left.join(right, [*same, overlap], "left_semi").drop("__bin").distinct()
    return funcs.join(hit, identity, "left_semi")


def with_file_fallback(files: DataFrame, touched: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add one whole-file row for each file without a touched function. The touched functions are written, as they are read twice."""
    keys = keys or FILE_KEYS
    touched = cut_lineage(touched, "touched")
    lines = F.size(source_lines(F.col("content")))
    whole = files.join(touched.select(*keys).distinct(), keys, "left_anti").select(
        *keys,
        F.lit(FALLBACK_NAME).alias("function_name"),
        F.lit(1).alias("start_line"),
        lines.alias("end_line"),
        F.col("content").alias("function_code"),
        F.lit(True).alias("fallback_used"),
    )
    return touched.withColumn("fallback_used", F.lit(False)).unionByName(whole)


def changed_functions(sources: DataFrame, diffs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Changed functions of every changed file in one pass.

    A file's spans and its hunks meet in one row (both are bounded by that file), so the overlap test needs no range
    join: the only shuffle is the equality join of sources and diffs on the file key.
    """
    keys = keys or FILE_KEYS
    hunks = diffs.groupBy(*keys).agg(F.flatten(F.collect_list(hunk_array(F.col("diff_text")))).alias("hunks"))
    files = sources.join(hunks, keys).withColumn("__lines", source_lines(F.col("content")))
    spans = files.withColumn("__spans", function_span_array("content"))
    touched = F.filter(
        "__spans",
        lambda s: F.exists("hunks", lambda h: (h.start_line <= s.end_line) & (s.start_line <= h.end_line)),
    )
    whole = F.array(
        F.struct(
            F.lit(FALLBACK_NAME).alias("function_name"),
            F.lit(1).alias("start_line"),
            F.size("__lines").alias("end_line"),
        )
    )
    picked = spans.withColumn("__touched", touched).select(
        *keys, "content", "__lines", F.explode(F.when(F.size("__touched") > 0, F.col("__touched")).otherwise(whole)).alias("f")
    )
    fallback = F.col("f.function_name") == FALLBACK_NAME
    return picked.select(
        *keys,
        "f.function_name",
        "f.start_line",
        "f.end_line",
        F.when(fallback, F.col("content")).otherwise(code_of("__lines", F.col("f"))).alias("function_code"),
        fallback.alias("fallback_used"),
    )


def enclosing_function(alerts: DataFrame, spans: DataFrame, keys: list[str], width: int = LINE_BIN) -> DataFrame:
    """Add ``enclosing_function`` to alerts (file keys, ``line``): spans of a file are disjoint, so at most one fits."""
    at = alerts.withColumn("__bin", F.floor(F.col("line") / width)).alias("a")
    over = _bins(spans.select(*keys, "function_name", "start_line", "end_line"), "start_line", "end_line", width).alias("s")
    same = [F.col(f"a.{k}") == F.col(f"s.{k}") for k in [*keys, "__bin"]]
    inside = F.col("a.line").between(F.col("s.start_line"), F.col("s.end_line"))
    return at.join(over, [*same, inside], "left").select(
        *[F.col(f"a.{c}") for c in alerts.columns], F.col("s.function_name").alias("enclosing_function")
    )
