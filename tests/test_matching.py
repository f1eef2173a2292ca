"""Report, source and diagnostic matching against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gatewright.functions import text
from gatewright.operators import matching as M
from gatewright.plans.prioritiser import annotate, clang_model_rows, clang_training


def norm(p):
    out = p.strip().replace("\\", "/")
    while "//" in out:
        out = out.replace("//", "/")
    return out


def test_match_report_by_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "b", "xb", "c.c", "xc.c", "d.c"]
    make = lambda: "/".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    index = [(f"r{rng.randint(0, 1)}", make(), f"p{rng.randint(0, 6)}") for _ in range(25)]
    alerts = [(f"r{rng.randint(0, 1)}", make(), i) for i in range(120)] + [("r0", "", 900)]
    got = {r["ord"]: r["report"] for r in M.match_report(
        spark.createDataFrame(alerts, "repo_id string, source_file string, ord int"),
        spark.createDataFrame(index, "repo_id string, source_file string, report string")).collect()}
    for repo, path, ord_ in alerts:
        known = {}
        for r, p, rep in sorted(index, key=lambda x: x[2]):
            if r == repo:
                known[norm(p)] = rep
        want = None
        if norm(path) in known:
            want = known[norm(path)]
        elif path:
            hits = {rep for p, rep in known.items() if norm(path).endswith(p) or p.endswith(norm(path))}
            want = hits.pop() if len(hits) == 1 else None
        assert got[ord_] == want, (repo, path)


def test_match_source(spark):
    files = spark.createDataFrame(
        [("r", "p", 0, "/x/src/a.c"), ("r", "p", 1, "/y/src/a.c"), ("r", "p", 2, "lib\\b.c"), ("r", "p", 3, "q/a.c")],
        "repo_id string, report string, ord int, source_file string")
    rows = [("/y/src/a.c", "/y/src/a.c"), ("z/b.c", "lib/b.c"), ("z/src/a.c", "/x/src/a.c"), ("q/none.c", None), ("y/src/a.c", None), ("", None)]
    alerts = spark.createDataFrame([("r", "p", i, path) for i, (path, _) in enumerate(rows)], "repo_id string, report string, ord int, source_file string")
    got = {r["ord"]: r["matched_file"] for r in M.match_source(alerts, files).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]


def test_match_diagnostic(spark):
    diags = spark.createDataFrame([
        ("r", "p", 5, "a.c", "Null deref [core]", "f_bad", "function"),
        ("r", "p", 6, "a.c", "one", "f", "function"), ("r", "p", 6, "a.c", "one", "g", "function"),
        ("r", "p", 7, "a.c", "other", "good1", "function"), ("r", "p", 8, "a.c", "kind", "h", "block"),
        ("r", "p", 9, "b.c", "elsewhere", "k", "function"),
    ], "repo_id string, report string, line int, source_file string, description string, issue_context string, issue_context_kind string")
    cases = [(5, "null deref.", ("f_bad", True)), (6, "one", ("", True)), (7, "unlike", ("good1", True)), (8, "kind", ("", True)),
             (9, "elsewhere", ("", True)), (5, "", ("f_bad", True)), (50, "x", ("", True))]
    alerts = spark.createDataFrame([("r", "p", "a.c", i, line, m) for i, (line, m, _) in enumerate(cases)],
                                   "repo_id string, report string, matched_file string, ord int, line int, message string")
    got = {r["ord"]: (r["source_function"], r["has_plist_match"]) for r in M.match_diagnostic(alerts, diags).collect()}
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]


def test_match_diagnostic_by_brute_force(spark):
    rng = random.Random(6)
    messages = ["one", "One.", "two [x]", "", "three"]
    diags = [("r", rng.choice("pq"), rng.randint(1, 4), rng.choice(["a.c", "b.c", "x\\\\a.c"]), rng.choice(messages),
              rng.choice(["f", "g_bad", "good1", "h", None]), rng.choice(["function", "function", "block", None])) for _ in range(45)]
    alerts = [("r", rng.choice(["p", "q", None]), rng.choice(["a.c", "b.c", "x/a.c", None]), i, rng.choice([1, 2, 3, 4, 5, None]), rng.choice(messages)) for i in range(300)]
    got = {r["ord"]: (r["source_function"], r["has_plist_match"]) for r in M.match_diagnostic(
        spark.createDataFrame(alerts, "repo_id string, report string, matched_file string, ord int, line int, message string"),
        spark.createDataFrame(diags, "repo_id string, report string, line int, source_file string, description string, issue_context string, issue_context_kind string")).collect()}
    clean = {r[0]: r[1] for r in spark.createDataFrame([(m,) for m in messages], "m string").select("m", text.norm_message(F.col("m"))).collect()}
    for repo, report, file, i, line, message in alerts:
        fits = []
        for r, p, n, f, said, context, kind in diags:
            named = (context or "").endswith("_bad") or (context or "").startswith("good")
            if (r, p, n) == (repo, report, line) and file in (None, norm(f)) and (clean[said] == clean[message] or clean[message] == "" or named):
                fits.append((context or "", kind or ""))
        want = (fits[0][0] if fits[0][1] == "function" else "", True) if len(fits) == 1 else ("", file is not None)
        assert got[i] == want, (i, fits)


def test_annotation_end_to_end(spark):
    base = "/w/testcases/CWE121_Stack_Based_Buffer_Overflow/CWE121__x_01a.c"
    alerts = spark.createDataFrame([
        ("r", 1, "clang", base, 2, "a", "121", "warning", "a: b", "t.txt"), ("r", 2, "clang", base, 2, "a", "121", "warning", "a: b", "t.txt"),
        ("r", 3, "clang", base, 6, "c", "121", "warning", "c", "t.txt"), ("r", 4, "clang", base, 9, "n", "121", "note", "n", "t.txt"),
        ("r", 5, "clang", base, 11, "u", "121", "error", "u", "t.txt"),
    ], "repo_id string, ord int, tool string, source_file string, line int, alert_id string, cwe string, severity string, message string, raw_report_path string")
    index = spark.createDataFrame([("r", "p", 0, base)], "repo_id string, report string, ord int, source_file string")
    diags = spark.createDataFrame([("r", "p", 2, base, "a: b", "x_bad", "function")],
                                  "repo_id string, report string, line int, source_file string, description string, issue_context string, issue_context_kind string")
    code = "void q_bad() {\n  a();\n}\n\nvoid good1() {\n  b();\n}\n"
    src = spark.createDataFrame([("r", base, code)], "repo_id string, source_file string, content string")
    rows = {r["ord"]: r for r in annotate(alerts, index, diags, src).collect()}
    assert sorted(rows) == [1, 3, 5]
    assert (rows[1]["ground_truth_status"], rows[1]["ground_truth_origin"]) == ("bad", "plist_source_function")
    assert (rows[3]["ground_truth_status"], rows[3]["ground_truth_origin"]) == ("good", "enclosing_function")
    assert (rows[5]["ground_truth_status"], rows[5]["is_bad_path"], rows[5]["juliet_case_id"]) == ("unknown", 0, "CWE121__x_01")
    training = clang_training(annotate(alerts, index, diags, src))
    labels = {r["ord"]: (r["priority"], r["label"]) for r in training.collect()}
    assert labels == {1: ("HIGH", 2), 3: ("LOW", 0), 5: ("UNKNOWN", None)}
    assert clang_model_rows(training).count() == 2


def test_console_lines_are_taken_apart_once(spark, tmp_path):
    """Reports, diagnostics and alerts read the written alerts: none of their plans holds the lines' pattern."""
    from gatewright.plans.tables import Tables

    rows = [(k, k % 50, "1-URGENT", "FOP"[k % 3]) for k in range(200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    plans = [d._jdf.queryExecution().toString() for d in (t.report_index, t.diagnostics, t.kept_alerts)]
    assert not any("warning|error|note" in p for p in plans)
    assert sorted(map(tuple, t.kept_alerts.collect())) == sorted(map(tuple, t.console_alerts.collect()))
