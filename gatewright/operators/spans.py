"""Function spans of C/C++ source texts: a files table in, a spans table (or a spans array per file) out.

Spark spreads the files; the helpers below see one text at a time and run in linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What may head a function, and what may not.
BRACE = re.compile(r"[{}]")
CONTROL_HEAD = re.compile(r"\b(if|for|while|switch|catch)\s*\(")
TYPE_HEADS = ("typedef", "struct", "enum", "class", "namespace")
QUALIFIED_NAME = re.compile(r"([A-Za-z_~]\w*(?:::[A-Za-z_~]\w*)*)\s*$")
TYPED_HEAD = re.compile(
    r"^\s*(?:static\s+)?(?:void|int|char|short|long|float|double|bool|size_t|unsigned|signed"
    r"|struct\s+[A-Za-z_][A-Za-z0-9_]*)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*\)\s*(\{)?\s*$"
)
HEAD_LINES = 8
NO_NAME = "anonymous_function"

SPAN_ARRAY = T.ArrayType(
    T.StructType().add("function_name", T.StringType()).add("start_line", T.IntegerType()).add("end_line", T.IntegerType())
)


class _Braces:
    """Depth in front of every line, and for each depth the lines on which a closing brace came down to it."""

    def __init__(self, lines: list[str]):
        self.before: list[int] = []
        self.closed_to: dict[int, list[int]] = defaultdict(list)
        depth = 0
        for number, line in enumerate(lines):
            self.before.append(depth)
            if "{" not in line and "}" not in line:
                continue
            for brace in BRACE.findall(line):
                depth += 1 if brace == "{" else -1
                if brace == "}":
                    self.closed_to[depth].append(number)

    def end_of_block(self, line: int) -> int | None:
        stops = self.closed_to.get(self.before[line], [])
        at = bisect_left(stops, line)
        return stops[at] if at < len(stops) else None


def _head(lines: list[str], first: int) -> tuple[int, str] | None:
    """Line that opens the body and the joined signature up to it, or None if no body opens within reach."""
    text = ""
    for number, line in enumerate(lines[first : first + HEAD_LINES], start=first):
        part = line.strip()
        if not part:
            continue
        text = f"{text} {part}" if text else part
        if "{" in part:
            return number, text
        if ";" in part and "(" in text:
            return None
    return None


def _name_of_head(signature: str) -> str | None:
    """Function name, or None where the signature is not a function's."""
    if "(" not in signature or ")" not in signature or signature.startswith(TYPE_HEADS):
        return None
    prefix = signature.partition("{")[0]
    tail = prefix.partition(")")[2] if ")" in prefix else prefix
    if ";" in tail or CONTROL_HEAD.search(signature):
        return None
    words = prefix.partition("(")[0].rsplit(None, 1)  # a name holds no blanks
    name = QUALIFIED_NAME.search(words[-1]) if words else None
    return name.group(1) if name else NO_NAME


def heuristic_spans(text: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of each function, found by its signature and balanced braces."""
    lines = text.splitlines()
    braces = _Braces(lines)
    spans = []
    free_from = 0  # lines before this one belong to a span already taken
    for first, line in enumerate(lines):
        if first < free_from or ("(" not in line and "{" not in line) or line.lstrip().startswith("#"):
            continue
        head = _head(lines, first)
        name = _name_of_head(head[1]) if head else None
        last = braces.end_of_block(head[0]) if name else None
        if last is not None:
            spans.append((name, first + 1, last + 1))
            free_from = last + 1
    return spans


def typed_spans(text: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line) for one-line typed signatures; an unclosed body runs to the end of the file."""
    lines = text.splitlines()
    change = [line.count("{") - line.count("}") for line in lines]
    heads = [TYPED_HEAD.match(line) for line in lines]
    spans = []
    at, depth = 0, 0
    while at < len(lines):
        if heads[at] is None:
            at += 1
            continue
        opened = at
        if heads[at].group(2):
            depth = change[at]
        else:
            opened += 1
            while opened < len(lines) and heads[opened] is None:
                depth += change[opened]
                if "{" in lines[opened]:
                    break
                opened += 1
            else:
                at = opened  # another signature came first, or the text ended
                continue
        last = opened
        while last + 1 < len(lines):
            last += 1
            depth += change[last]
            if depth <= 0:
                break
        if last > opened:
            spans.append((heads[at].group(1), at + 1, last + 1))
        at, depth = last + 1, 0
    return spans


def _span_rows(texts: pa.Array, find) -> pa.Array:
    spans, ends = [], [0]
    for text in texts.to_pylist():
        spans += find(text or "")
        ends.append(len(spans))
    columns = zip(*spans) if spans else ((), (), ())
    kinds = {"function_name": pa.string(), "start_line": pa.int32(), "end_line": pa.int32()}
    rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


@F.arrow_udf(SPAN_ARRAY)
def function_span_array(texts: pa.Array) -> pa.Array:
    return _span_rows(texts, heuristic_spans)


@F.arrow_udf(SPAN_ARRAY)
def typed_span_array(texts: pa.Array) -> pa.Array:
    return _span_rows(texts, typed_spans)


def source_lines(content: Column) -> Column:
    """Lines of a text; one final line break does not open another line."""
    text = F.when(F.contains(content, F.lit("\r")), F.regexp_replace(content, r"\r\n|\r", "\n")).otherwise(content)
    text = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def function_spans(sources: DataFrame, keys: list[str]) -> DataFrame:
    """One row per function with its code. The text is split into lines once per file, not once per function."""
    files = sources.select(*keys, source_lines(F.col("content")).alias("__lines"), function_span_array("content").alias("__spans"))
    spans = files.select(*keys, "__lines", F.explode("__spans").alias("s"))
    return spans.select(*keys, "s.function_name", "s.start_line", "s.end_line", code_of("__lines", F.col("s")).alias("function_code"))


def code_of(lines: str, span: Column) -> Column:
    """Text of a span from the lines of its file."""
    return F.array_join(F.slice(lines, span.start_line, F.greatest(span.end_line - span.start_line + 1, F.lit(0))), "\n")


def typed_function_spans(sources: DataFrame, keys: list[str]) -> DataFrame:
    return sources.select(*keys, F.inline(typed_span_array("content")))
