"""Whole-file fallback: the files are parsed once, however often their functions are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.operators import changes as C
from gatewright.operators import spans as X

KEYS = ["repo_id", "run_id", "file_path"]


def test_functions_are_parsed_once_for_the_fallback(spark):
    text = "int f(int a) {\n    return a;\n}\n"
    rows = [("r", "1", "a.c", text, "@@ -1,1 +1,2 @@\n+x\n"), ("r", "1", "b.c", text, "@@ -9,1 +9,1 @@\n+x\n"), ("r", "1", "b.c", text, "")]
    files = spark.createDataFrame(rows, "repo_id string, run_id string, file_path string, content string, diff_text string")
    seen = spark.sparkContext.accumulator(0)
    sources = files.drop("diff_text").withColumn("content", F.udf(lambda t: seen.add(1) or t).asNondeterministic()("content"))
    touched = C.touched_functions(X.function_spans(sources, KEYS), C.changed_hunks(files.drop("content")))
    out = C.with_file_fallback(files.drop("diff_text"), touched)
    got = sorted((r["file_path"], r["function_name"], r["fallback_used"]) for r in out.collect())
    assert got == [("a.c", "f", False), ("b.c", C.FALLBACK_NAME, True), ("b.c", C.FALLBACK_NAME, True)]
    assert seen.value == 3
