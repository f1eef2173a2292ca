"""Function spans, changed functions, fallback, enclosing functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gatewright.operators import changes as C
from gatewright.operators import spans as X

KEYS = ["repo_id", "run_id", "file_path"]


@pytest.mark.parametrize(("source", "expected"), [
    ("\nint add(int a, int b) {\n    return a + b;\n}\n", [("add", 2, 4)]),
    ("\nvoid foo() {\n}\n\nint bar() {\n    return 0;\n}\n", [("foo", 2, 3), ("bar", 5, 7)]),
    ("\nvoid process() {\n    if (cond) {\n        action();\n    }\n}\n", [("process", 2, 6)]),
    ("int x = 5;\n", []),
    ("\nvoid incomplete() {\n    return;\n", []),
    ("", []),
    ("#define F(x) {\nint g(\n  int a,\n  int b)\n{\n  return a;\n}\n", [("g", 2, 7)]),
    ("struct s {\n  int a;\n};\nclass K { void m() { } };\n", []),
    ("int f(int a);\nint g() { return 1; }\n", [("g", 2, 2)]),
    ("A::~A() {\n}\n", [("A::~A", 1, 2)]),
    ("{ run(); }\n", [("anonymous_function", 1, 1)]),
    ("int a(\n\n\n\n\n\n\n\n) {\n}\n", []),
    ("} int f() {\n}\n", []),
    ("void f() { } }\nvoid g() {\n}\n", [("f", 1, 1), ("g", 2, 3)]),
    ("for (;;) {\n}\nint h() { s = \"}\"; }\n", [("h", 3, 3)]),
])
def test_heuristic_spans(source, expected):
    assert X.heuristic_spans(source) == expected


@pytest.mark.parametrize(("source", "expected"), [
    ("void bad() {\n  x();\n}\nstatic int good1(int a)\n{\n  y();\n}\n", [("bad", 1, 3), ("good1", 4, 7)]),
    ("void bad(int a);\nint x;\n", []),
    ("void open() {\n  x();\n", [("open", 1, 2)]),
    ("void one()\n{ }\nint z;\n", [("one", 1, 3)]),
    ("struct node get(int a)\n{\n}\n", [("get", 1, 3)]),
    ("void a()\nvoid b()\n{\n  x();\n}\n", [("b", 2, 5)]),
    ("void last() {", []),
])
def test_typed_spans(source, expected):
    assert X.typed_spans(source) == expected


def sources(spark, texts):
    return spark.createDataFrame([("r", "1", name, text) for name, text in texts.items()], "repo_id string, run_id string, file_path string, content string")


def diffs(spark, texts):
    return spark.createDataFrame([("r", "1", name, text) for name, text in texts.items()], "repo_id string, run_id string, file_path string, diff_text string")


def test_hunk_headers(spark):
    texts = {
        "one": "@@ -10,3 +10,4 @@ context\n+x", "two": "@@ -5,3 +5,3 @@\n@@ -20,2 +21,2 @@", "long": "@@ -1 +10,5 @@",
        "empty": "", "bad": "@@ invalid hunk @@", "none": "@@ -10,2 +10,0 @@", "single": "@@ -1,2 +7 @@", "inside": "+@@ -1 +1 @@",
    }
    got = {}
    for row in C.changed_lines(diffs(spark, texts)).collect():
        got.setdefault(row["file_path"], set()).add(row["line"])
    assert got == {"one": {10, 11, 12, 13}, "two": {5, 6, 7, 21, 22}, "long": {10, 11, 12, 13, 14}, "single": {7}}


CODE = "\nvoid first() {\n    line_a();\n}\n\nvoid second() {\n    line_b();\n}\n"


@pytest.mark.parametrize(("diff", "names"), [
    ("@@ -1 +3 @@", ["first"]), ("@@ -1 +3 @@\n@@ -1 +7 @@", ["first", "second"]), ("@@ -1 +5 @@", [C.FALLBACK_NAME]), ("", [C.FALLBACK_NAME]),
    ("@@ -1 +4,3 @@", ["first", "second"]),
])
def test_changed_functions(spark, diff, names):
    src, dif = sources(spark, {"t.c": CODE}), diffs(spark, {"t.c": diff})
    rows = sorted(C.changed_functions(src, dif).collect(), key=lambda r: r["start_line"])
    assert [r["function_name"] for r in rows] == names
    if names == [C.FALLBACK_NAME]:
        assert (rows[0]["start_line"], rows[0]["end_line"], rows[0]["function_code"], rows[0]["fallback_used"]) == (1, 8, CODE, True)
    else:
        assert rows[0]["function_code"].startswith("void first") and not rows[0]["fallback_used"]
    touched = C.touched_functions(X.function_spans(src, KEYS), C.changed_hunks(dif), width=2)
    both = C.with_file_fallback(src, touched)
    assert sorted(map(tuple, both.select(*rows[0].__fields__).collect())) == sorted(map(tuple, rows))


def test_empty_source_falls_back(spark):
    rows = C.changed_functions(sources(spark, {"t.c": ""}), diffs(spark, {"t.c": "@@ -1 +1 @@"})).collect()
    assert [(r["function_name"], r["start_line"], r["end_line"], r["function_code"]) for r in rows] == [(C.FALLBACK_NAME, 1, 0, "")]


def test_enclosing_function(spark):
    spans = X.typed_function_spans(sources(spark, {"t.c": "void bad() {\n  x();\n}\nint y;\nvoid good1() {\n  z();\n}\n"}), KEYS)
    alerts = spark.createDataFrame([("r", "1", "t.c", n) for n in range(1, 9)], "repo_id string, run_id string, file_path string, line int")
    got = {r["line"]: r["enclosing_function"] for r in C.enclosing_function(alerts, spans, KEYS, width=3).collect()}
    assert got == {1: "bad", 2: "bad", 3: "bad", 4: None, 5: "good1", 6: "good1", 7: "good1", 8: None}


def test_only_lines_with_braces_are_scanned(monkeypatch):
    class Counted:
        seen: list = []

        def findall(self, line):
            self.seen.append(line)
            return [c for c in line if c in "{}"]

    monkeypatch.setattr(X, "BRACE", Counted())
    assert X.heuristic_spans("void f()\n{\n" + "  x = 1;\n" * 1000 + "}\n") == [("f", 1, 1003)]
    assert Counted.seen == ["{", "}"]


def test_lines_of_texts(spark):
    texts = {"a\r\nb\rc\n": ["a", "b", "c"], "a\n\n": ["a", ""], "\n": [""], "": [], "\r": [""], "a": ["a"], None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.source_lines(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == texts
