"""Boundary values of the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions import alerts as A
from gatewright.functions import numbers as N
from gatewright.functions import paths, risk, text


def values(spark, fn, rows, schema):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["out"] for r in df.select("i", fn(df).alias("out")).orderBy("i").collect()]


def test_severity_scores(spark):
    words = ["critical", "ERROR", "warning", "performance", "portability", "style", "information", "note", "", None]
    assert values(spark, lambda d: A.severity_score_a(d.s), words, "s string") == [4, 3, 2, 2, 2, 1, 1, 0, 0, 0]
    assert values(spark, lambda d: A.severity_score_b(d.s), words, "s string") == [4, 3, 2, 0, 0, 0, 1, 1, 0, 0]


def test_has_value(spark):
    words = [None, "", "  ", "NaN", "None", " null ", "0", "476"]
    assert values(spark, lambda d: A.has_value(d.s), words, "s string") == [0, 0, 0, 0, 0, 0, 1, 1]


def test_keyword_flags_are_substrings(spark):
    words = ["targets hit", "NULLABLE", "nothing", None]
    flag = lambda terms: values(spark, lambda d: A.keyword_flag(d.s, terms), words, "s string")
    assert flag(P.KEYWORDS_CPPCHECK["is_obsolete_function"]) == [1, 0, 0, 0]
    assert flag(P.KEYWORDS_CPPCHECK["is_null_pointer"]) == [0, 1, 0, 0]
    assert flag(P.KEYWORDS_CLANG["is_null_pointer"]) == [0, 0, 0, 0]


def test_priority_rules(spark):
    rows = [(False, "error"), (True, "error"), (True, "Critical"), (True, "style"), (True, None)]
    assert values(spark, lambda d: A.priority_a(d.a, d.s), rows, "a boolean, s string") == ["LOW", "HIGH", "HIGH", "MEDIUM", "MEDIUM"]
    rows = [("good", "x"), ("bad", P.MEDIUM_FAMILY), ("Bad ", P.HIGH_FAMILIES[0]), ("bad", "CWE78_x"), (None, None)]
    got = values(spark, lambda d: A.priority_b(d.a, d.s), rows, "a string, s string")
    assert got == ["LOW", "MEDIUM", "HIGH", "UNKNOWN", "UNKNOWN"]


@pytest.mark.parametrize(("p", "level"), [(0.499, "LOW"), (0.50, "MEDIUM"), (0.799, "MEDIUM"), (0.80, "HIGH"), (0.25, "LOW"), (0.65, "MEDIUM"), (0.95, "HIGH")])
def test_risk_level_boundaries(spark, p, level):
    assert values(spark, lambda d: risk.risk_level(risk.risk_score(d.p), 50, 80), [p], "p double") == [level]


def test_confidence(spark):
    assert values(spark, lambda d: risk.confidence(d.p), [0.52, 0.70, 0.99, 0.01, 0.50], "p double") == [0.04, 0.4, 0.98, 0.98, 0.0]


def test_review_gate(spark):
    rows = [("LOW", 0.3), ("MEDIUM", 0.4), ("HIGH", 0.2), ("LOW", 0.5), ("MEDIUM", 0.6)]
    got = values(spark, lambda d: risk.review_gate(d.l, d.c, 0.5), rows, "l string, c double")
    assert got == ["REVIEW_REQUIRED", "REVIEW_REQUIRED", "HIGH", "LOW", "MEDIUM"]


def test_positive_score(spark):
    assert values(spark, lambda d: risk.positive_score("margin", d.m), [0.0], "m double") == [0.5]
    assert values(spark, lambda d: risk.positive_score("margin", d.m), [2.0], "m double")[0] > 0.8
    assert values(spark, lambda d: risk.positive_score("prediction", d.m), [0, 1], "m int") == [0.0, 1.0]


def test_risky_terms_keep_list_order(spark):
    code = ["buffer then STRCPY(buffer)", "int add(int a) { return a; }", "MALLOC", "strcpy strcat sprintf gets memcpy malloc free"]
    got = values(spark, lambda d: risk.risky_terms(d.c), code, "c string")
    assert got[0] == ["strcpy", "buffer"] and got[1] == [] and got[2] == ["malloc"]
    assert got[3] == ["strcpy", "strcat", "sprintf", "gets", "memcpy"]


def test_risk_reason(spark):
    rows = [("REVIEW_REQUIRED", ["strcpy"], False, 0.1), ("HIGH", ["a", "b", "c", "d"], False, 0.9), ("HIGH", [], False, 0.9),
            ("MEDIUM", [], False, 0.9), ("LOW", [], True, 0.9), ("REVIEW_REQUIRED", [], False, 0.0002)]
    got = values(spark, lambda d: risk.risk_reason(d.l, d.t, d.f, d.c, 0.3), rows, "l string, t array<string>, f boolean, c double")
    assert got[0] == ("REVIEW_REQUIRED because model confidence (0.1) is below threshold (0.3)."
                      " Potential risky terms include strcpy.")
    assert got[1] == "HIGH because modified function contains a, b, c patterns."
    assert got[2].startswith("HIGH based on") and got[3].startswith("MEDIUM based on")
    assert got[4].startswith("LOW because no strong") and got[4].endswith("full-file fallback analysis was used.")
    assert "(0.0002)" in got[5]


def test_number_text(spark):
    got = values(spark, lambda d: N.number_text(d.p), [0.0, 50.0, 0.3, 0.0001, 0.00025, 33.33, 12345678.5, 100.0], "p double")
    assert got == ["0.0", "50.0", "0.3", "0.0001", "0.00025", "33.33", "12345678.5", "100.0"]


def test_paths(spark):
    names = ["src/main.c", "app.cpp", "header.h", "header.HPP", "script.py", "readme.md", ".git/config.c", "a.b/c", ".c"]
    assert values(spark, lambda d: paths.is_source_file(d.p), names, "p string") == [True, True, True, True, False, False, True, False, False]
    assert values(spark, lambda d: paths.in_excluded_folder(d.p), names, "p string")[6] is True
    inside = ["src/a.c", "src2/a.c", "src_test/a.c", "src/lib/u.c", "test/t.c"]
    assert values(spark, lambda d: paths.under_scan_path(d.p, "src"), inside, "p string") == [True, False, False, True, False]
    assert all(values(spark, lambda d: paths.under_scan_path(d.p, "."), inside, "p string"))
    assert values(spark, lambda d: paths.norm_path(d.p), [" a\\\\b//c ", None], "p string") == ["a/b/c", ""]
    assert values(spark, lambda d: paths.path_suffixes(d.p), ["/a/b/c.c", "", "x"], "p string") == [["a/b/c.c", "b/c.c", "c.c"], [], ["x"]]
    assert values(spark, lambda d: paths.char_suffixes(d.p), ["abc", ""], "p string") == [["abc", "bc", "c"], []]
    assert values(spark, lambda d: paths.stem(d.p), ["a/b.tar.gz", ".hidden", "x/y"], "p string") == ["b.tar", ".hidden", "y"]


def test_case_ids(spark):
    stems = ["CWE121__x_01a", "CWE121__x_01f", "x_bad", "CWE121_x_54_goodG2B"]
    assert values(spark, lambda d: paths.case_id(d.p), stems, "p string") == ["CWE121__x_01", "CWE121__x_01f", "x_bad", "CWE121_x_54_goodG2B"]
    assert values(spark, lambda d: paths.case_group_id(d.p), stems, "p string") == ["CWE121__x", "CWE121__x", "x", "CWE121_x"]
    files = ["C/testcases/CWE121_Stack_Based/s01/x.c", "CWE12/x.c"]
    assert values(spark, lambda d: paths.cwe_family(d.p), files, "p string") == ["CWE121_Stack_Based", ""]
    assert values(spark, lambda d: paths.cwe_number(d.p), ["1_CWE476_NULL_x.c.txt", "x"], "p string") == ["476", ""]


def test_messages_and_names(spark):
    messages = ["  ..Use of Memory   after free_ [unix.Malloc]", "...", None]
    assert values(spark, lambda d: text.norm_message(d.m), messages, "m string") == ["use of memory after free", "", ""]
    names = ["CWE_bad", "badSink2", "mybad", "bad_1", "goodG2B1", "good", "goodness", None]
    assert values(spark, lambda d: text.is_bad(d.m), names, "m string") == [True, True, False, True, False, False, False, False]
    assert values(spark, lambda d: text.is_good(d.m), names, "m string") == [False] * 4 + [True, True, False, False]
    heads = ["int main", "void std::vector", "void MyClass::method", "char* getData", "int process  ", "@#$%^&*()", "~Klass"]
    got = values(spark, lambda d: text.function_name(d.m), heads, "m string")
    assert got == ["main", "std::vector", "MyClass::method", "getData", "process", "anonymous_function", "~Klass"]
    assert values(spark, lambda d: text.alert_id(d.m), ["a: b: c", "x" * 80], "m string") == ["a", "x" * 60]


def test_html_text(spark):
    raw = ["<b>a &amp;lt; b</b>\n  c", "&lt;i&gt;gone&lt;/i&gt; kept", None]
    assert values(spark, lambda d: text.clean_html(d.h), raw, "h string") == ["a &lt; b c", "gone kept", ""]
    assert values(spark, lambda d: text.clean_html(d.h, True), ["caf&eacute; &copy;"], "h string") == ["café ©"]
    page = ["<h3>  </h3><title>t</title>", "<!-- BUGDESC Null deref --><h3>x</h3>", "nothing"]
    assert values(spark, lambda d: text.first_match(d.h, text.REPORT_MESSAGE), page, "h string") == ["", "Null deref", ""]


def test_issue_texts_and_run_ids(spark):
    got = values(spark, lambda d: risk.alert_text(d.t, d.a, d.f, d.l, d.m), [("cppcheck", "A1", "src/foo.c", 10, "msg"), (None, None, "f", None, None)],
                 "t string, a string, f string, l int, m string")
    assert got == ["cppcheck | A1 | src/foo.c:10 | msg", "unknown |  | f | "]
    assert values(spark, lambda d: risk.commit_text(d.f, d.s), [("src/a.c", 50.0)], "f string, s double") == ["commit-risk | src/a.c | risk score: 50.0"]
    rows = [("own", "1", "s", "9"), (" ", "1", "s", "9"), (None, "", "s", "9"), (None, None, "s", " "), (None, None, None, "9"), (None, None, None, None)]
    got = values(spark, lambda d: risk.run_identifier(d.a, d.b, d.c, d.e), rows, "a string, b string, c string, e string")
    assert got == ["own", "gh_run:1", "sha:s:9", "sha:s", "ts:9", ""]
    truths = ["1", "True", " yes ", "Y", "no", "", None]
    assert values(spark, lambda d: risk.truthy(d.s), truths, "s string") == [True, True, True, True, False, False, False]


def test_numbers(spark):
    assert values(spark, lambda d: N.round_half_up(d.p, 2), [0.285, 1.005, -0.125], "p double")[0] == 0.28
    assert values(spark, lambda d: N.round_half_even_int(d.p), [0.5, 1.5, 2.5, 2.6], "p double") == [0, 2, 2, 3]
    assert values(spark, lambda d: N.to_number(d.p), ["12", "x", None], "p string") == [12.0, None, None]
    units = spark.range(2000).select(N.hash_unit(F.col("id"), F.lit("a")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= units[0] < 0.01 and 0.99 < units[1] < 1 and abs(units[2] - 0.5) < 0.03


def test_parameters():
    with pytest.raises(ValueError):
        P.RiskParams(medium_threshold=70, high_threshold=70)
    with pytest.raises(ValueError):
        P.RiskParams(review_confidence=1.5)
    assert [P.min_rows_or_default(x) for x in ("20", 0, "-3", "abc", None)] == [20, 30, 30, 30, 30]
