"""Readers, writers and streams."""

from __future__ import annotations

import gzip
import json
import plistlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatewright.operators import rows as O
from gatewright.sources import readers as S
from gatewright.sources import report_files
from gatewright.sources import sinks as K
from gatewright.streaming import history as ST


def test_labelled_functions_absent_key_and_null_differ(spark, tmp_path):
    lines = [{"project": "p", "commit_id": "c", "cve": "v", "cwe": None, "func": "f()", "target": 1}, {"func": None}, {"target": 0}, {"func": "f()", "target": 1}]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in lines[:2]) + "\n\n  \n" + "\n".join(json.dumps(x) for x in lines[2:]))
    rows = S.read_labelled_functions(spark, str(tmp_path / "a.jsonl"), "train").collect()
    assert len(rows) == 4
    assert (rows[0]["cwe"], rows[0]["function_code"], rows[0]["target"]) == (None, "f()", 1)
    assert (rows[1]["function_code"], rows[1]["target"], rows[1]["project"]) == (None, 0, "")
    assert (rows[2]["function_code"], rows[2]["target"]) == ("", 0)


def test_gzip_warnings(spark, tmp_path):
    data = [{"toolName": "Cppcheck", "filePath": "a.c", "lineNumber": "x", "warningType": "t", "cwe": None, "warningSeverity": s, "warningMessage": "Null pointer"}
            for s in ("error", "style")]
    with gzip.open(tmp_path / "w.json.gz", "wt") as f:
        json.dump(data, f)
    rows = S.read_warnings(spark, str(tmp_path / "w.json.gz"), True).orderBy("severity").collect()
    assert [(r["priority"], r["label"], r["line"], r["has_cwe"], r["is_null_pointer"], r["is_cppcheck"]) for r in rows] == [
        ("HIGH", 2, None, 0, 1, 1), ("MEDIUM", 1, None, 0, 1, 1)]
    assert {r["priority"] for r in S.read_warnings(spark, str(tmp_path / "w.json.gz"), False).collect()} == {"LOW"}
    with pytest.raises(FileNotFoundError):
        S.read_warnings(spark, str(tmp_path / "none.gz"), True)


def test_lenient_reports(spark, tmp_path):
    schema = "risk_level string, risk_score double"
    assert S.read_report(spark, str(tmp_path / "absent.csv"), schema).count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert S.read_report(spark, str(tmp_path / "empty.csv"), schema).columns == ["risk_level", "risk_score"]
    (tmp_path / "header.csv").write_text("risk_level,risk_score\n")
    assert S.read_report(spark, str(tmp_path / "header.csv"), schema).count() == 0
    (tmp_path / "other.csv").write_text("col_a,col_b\n1,2\n")
    assert S.read_report(spark, str(tmp_path / "other.csv"), schema).columns == ["col_a", "col_b"]
    (tmp_path / "ok.csv").write_text('risk_level,risk_score,code\nHIGH,71.5,"a\n""b"""\n')
    row = S.read_report(spark, str(tmp_path / "ok.csv"), schema).first()
    assert (row["risk_level"], row["risk_score"], row["code"]) == ("HIGH", 71.5, 'a\n"b"')


def test_cppcheck_xml(spark, tmp_path):
    (tmp_path / "r.xml").write_text("""<?xml version="1.0"?><results version="2"><errors>
<error id="nullPointer" severity="error" msg="Null pointer" cwe="476"><location file="a.c" line="3"/><location file="b.c" line="9"/></error>
<error id="missingInclude" severity="information" msg="m"/>
<error id="x" severity="style" msg="no place"></error></errors></results>""")
    rows = O.drop_ignored(S.read_xml_alerts(spark, str(tmp_path / "r.xml"))).orderBy("alert_id").collect()
    assert [(r["alert_id"], r["file"], r["line"], r["cwe"]) for r in rows] == [("nullPointer", "a.c", "3", "476"), ("x", "", "", "")]
    (tmp_path / "e.xml").write_text("")
    with pytest.raises(ValueError):
        S.read_xml_alerts(spark, str(tmp_path / "e.xml"))
    with pytest.raises(FileNotFoundError):
        S.read_xml_alerts(spark, str(tmp_path / "none.xml"))


def test_html_reports(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "report-1.html").write_text("<!-- BUGDESC Null &amp; void -->\n<!-- BUGFILE /a/b.c -->\n<!-- BUGLINE 12 -->")
    (tmp_path / "report-2.html").write_text("<h3>Leak</h3><table><tr><td>File:</td><td>x.c</td></tr><tr><td>Line:</td><td>7</td></tr></table>")
    (tmp_path / "report-3.html").write_text("<p>nothing</p>")
    (tmp_path / "index.html").write_text("<title>ignored</title>")
    rows = {r["message"]: r for r in S.read_html_reports(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Null & void", "Leak", "Unknown Clang issue"}
    assert (rows["Null & void"]["file"], rows["Null & void"]["line"]) == ("/a/b.c", "12")
    assert (rows["Leak"]["file"], rows["Leak"]["line"]) == ("x.c", "7")
    assert rows["Unknown Clang issue"]["file"].endswith("report-3.html")


def test_console_text(spark, tmp_path):
    (tmp_path / "1_CWE121_Stack_x.c.txt").write_text("p/x.c:10:5: warning: Bad: thing [c]\np/x.c:11:5: note: skip\nother\np/y.c:1:2: error: e\n")
    rows = S.read_text_alerts(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["source_file"], r["line"], r["severity"], r["alert_id"], r["cwe"]) for r in rows] == [
        ("p/y.c", 1, "error", "e", "121"), ("p/x.c", 10, "warning", "Bad", "121")]


def test_plists(spark, tmp_path):
    report = {"files": ["a.c", "b.c"], "diagnostics": [{"description": "d", "issue_context": "f_bad", "issue_context_kind": "function", "location": {"file": 1, "line": 4}},
                                                      {"description": "far", "location": {"file": 9, "line": 5}}]}
    (tmp_path / "ok.plist").write_bytes(plistlib.dumps(report))
    (tmp_path / "empty.plist").write_bytes(b"")
    (tmp_path / "broken.plist").write_bytes(b"<plist>")
    plists = S.read_plists(spark, str(tmp_path))
    assert [(r["report"], r["ord"], r["source_file"]) for r in S.plist_index(plists).orderBy("ord").collect()] == [("ok.plist", 0, "a.c"), ("ok.plist", 1, "b.c")]
    rows = S.plist_diagnostics(plists).orderBy("line").collect()
    assert [(r["source_file"], r["line"], r["issue_context"]) for r in rows] == [("b.c", 4, "f_bad"), ("", 5, None)]


def test_plist_events_equal_the_loaded_tree():
    draw = random.Random(3)
    other = {"path": [{"kind": "event", "location": {"file": 7, "line": 7}, "description": "inner", "ranges": [[{"line": 1}]]}], "notes": []}
    for n in (0, 1, 7, 9000):  # the last spans many pieces
        files = [f"d/{draw.randrange(99)}<&>é.c" for _ in range(min(n, 50))]
        found = [
            {k: v for k, v in {"description": f"x & <y> {i}", "issue_context": "f" if i % 3 else None, "issue_context_kind": "",
             "location": {"file": draw.randrange(-1, 60), "line": i, "col": 2} if i % 4 else None, **other}.items() if v is not None}
            for i in range(n)
        ]
        tree = {"clang_version": "v", "diagnostics": found, "files": files, "more": {"files": ["no"], "diagnostics": [{"description": "no"}]}}
        want = [("r", i, f, None, None, None, None) for i, f in enumerate(files)]
        for d in found:
            at = d.get("location", {}).get("file", -1)
            want.append(("r", None, files[at] if 0 <= at < len(files) else "", d.get("location", {}).get("line"), d["description"],
                         d.get("issue_context"), d["issue_context_kind"]))
        for kind in (plistlib.FMT_XML, plistlib.FMT_BINARY):
            assert list(report_files.plist_entries("r", plistlib.dumps(tree, fmt=kind))) == want
        whole = plistlib.dumps(tree)
        for broken in (whole[:-20], whole.replace(b"<key>files</key>", b""), b"<!DOCTYPE plist [<!ENTITY a 'b'>]>" + whole[whole.index(b"<plist") :], b"bplist00"):
            assert list(report_files.plist_entries("r", broken)) == []


def test_plist_rows_leave_in_bounded_batches():
    tree = {"files": ["a.c"], "diagnostics": [{"description": "d", "location": {"file": 0, "line": i}} for i in range(10_000)]}
    given = pa.record_batch([["p", "q", None], [plistlib.dumps(tree), b"", None]], names=["report", "content"])
    sizes = [b.num_rows for b in report_files.plist_batches(iter([given]))]
    assert sum(sizes) == 10_001 and max(sizes) == report_files.ROWS
    assert list(report_files.plist_batches(iter([]))) == []


def test_sources_and_status(spark, tmp_path):
    (tmp_path / "a.c").write_bytes(b"int a;\xff\n")
    assert S.read_sources(spark, str(tmp_path), "*.c").first()["content"] == "int a;\n"
    (tmp_path / "status").write_text(" SCAN_FAILED \n")
    assert S.read_scan_status(spark, str(tmp_path / "status")).first()[0] == "SCAN_FAILED"
    assert S.read_scan_status(spark, str(tmp_path / "none")).first()[0] == ""


def test_reports_keep_their_schema_when_empty(spark, tmp_path):
    df = spark.createDataFrame([("r", ["a", "b"], 1.5)], "repo_id string, terms array<string>, s double")
    K.write_report(df.filter("s > 9"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).columns == ["repo_id", "terms", "s"]
    K.write_report(df, str(tmp_path / "c"), csv=True)
    assert S.read_csv(spark, str(tmp_path / "c"), "repo_id string, terms string, s double").first()["terms"] == "a|b"


def test_append_once(spark, tmp_path):
    path, schema = str(tmp_path / "h"), "repo_id string, run_id string, ord int"
    assert K.history_size(spark, path) == 0
    assert K.append_once(spark, path, spark.createDataFrame([("r", "1", 2), ("r", "1", 1), ("r", "2", 3)], schema))
    assert K.append_once(spark, path, spark.createDataFrame([("r", "2", 9), ("r", "3", 4), ("q", "1", 5)], schema))
    rows = sorted(map(tuple, spark.read.parquet(path).collect()))
    assert rows == [("q", "1", 5), ("r", "1", 1), ("r", "2", 3), ("r", "3", 4)] and K.history_size(spark, path) == 4
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    assert not K.append_once(spark, str(tmp_path / "bad"), spark.createDataFrame([("r", "1", 2)], schema))
    # a first write that never ended left no data file behind
    (tmp_path / "half" / "_temporary" / "0").mkdir(parents=True)
    half = str(tmp_path / "half")
    assert K.append_once(spark, half, spark.createDataFrame([("r", "1", 2)], schema)) and K.history_size(spark, half) == 1


def test_stream_equals_batch_after_redelivery_and_restart(spark, tmp_path):
    source, table, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "repo_id string, run_id string, ts timestamp, ord int"
    first = spark.range(40).select((F.col("id") % 4).cast("string").alias("repo_id"), (F.col("id") % 10).cast("string").alias("run_id"),
                                   F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("int").alias("ord"))
    first.write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    ST.run_to_end(ST.stream_history(stream, table, mark))
    late = first.withColumn("ts", F.col("ts") + F.expr("interval 30 days")).unionByName(
        spark.createDataFrame([("9", "9", 99)], "repo_id string, run_id string, ord int").withColumn("ts", F.timestamp_seconds(F.lit(9e6))))
    late.select("repo_id", "run_id", "ts", "ord").write.mode("append").parquet(source)
    ST.run_to_end(ST.stream_history(spark.readStream.schema(schema).parquet(source), table, mark))
    got = sorted((r["repo_id"], r["run_id"]) for r in spark.read.parquet(table).collect())
    assert got == sorted({(str(i % 4), str(i % 10)) for i in range(40)} | {("9", "9")})


def test_stream_stops_at_an_unreadable_history_and_goes_on_once_it_is_gone(spark, tmp_path):
    source, bad, mark = str(tmp_path / "in"), tmp_path / "out", str(tmp_path / "mark")
    schema = "repo_id string, run_id string, ts timestamp, ord int"
    spark.range(6).selectExpr("string(id % 2) repo_id", "string(id) run_id", "timestamp_seconds(id * 60) ts", "int(id) ord").write.parquet(source)
    bad.mkdir()
    (bad / "x.parquet").write_text("not parquet")
    stream = lambda: ST.stream_history(spark.readStream.schema(schema).parquet(source), str(bad), mark)
    with pytest.raises(Exception, match="cannot be read"):
        ST.run_to_end(stream())
    (bad / "x.parquet").unlink()
    ST.run_to_end(stream())
    assert sorted(r["run_id"] for r in spark.read.parquet(str(bad)).collect()) == ["0", "1", "2", "3", "4", "5"]


def test_daily_counts_hold_the_last_day_and_follow_later_batches(spark, tmp_path):
    source, table, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "repo_id string, ts timestamp, priority string"

    def deliver(rows):
        spark.createDataFrame(rows, "repo_id string, s long, priority string").selectExpr(
            "repo_id", "timestamp_seconds(s) ts", "priority").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ST.run_to_end(ST.write_updates(ST.daily_metrics(stream, "1 hour"), table, mark, ["repo_id", "day"]))
        now = ST.latest(spark, table, ["repo_id", "day"], "repo_id string, day timestamp")
        return sorted((r["repo_id"], r["day"].day, r["total_alerts"], r["high_alerts"]) for r in now.collect())

    day = 86400
    assert deliver([("a", 10, "HIGH"), ("a", day + 10, "LOW"), ("b", 20, "LOW")]) == [("a", 1, 1, 1), ("a", 2, 1, 0), ("b", 1, 1, 0)]
    assert deliver([("a", day + 60, "HIGH")]) == [("a", 1, 1, 1), ("a", 2, 2, 1), ("b", 1, 1, 0)]


def test_prior_scores_go_on_after_a_restart(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "repo_id string, run_id string, ts timestamp, total_alerts long"
    rng = np.random.default_rng(3)
    rows = [(f"r{i % 3}", f"{i:03d}", i, None if i == 17 else int(rng.integers(0, 50) + 10**9)) for i in range(60)]

    def deliver(part):
        spark.createDataFrame(part, "repo_id string, run_id string, s long, total_alerts long").selectExpr(
            "repo_id", "run_id", "timestamp_seconds(s) ts", "total_alerts").write.mode("append").parquet(source)
        ST.run_to_end(ST.stream_prior_scores(spark.readStream.schema(schema).parquet(source), out, mark))

    deliver(rows[:20][::-1])  # in any order within a batch
    deliver(rows[20:41])
    deliver([*rows[41:], ("r0", "old", 4, 10**9)])
    got = {(r["repo_id"], r["run_id"]): r for r in spark.read.parquet(f"{out}/batch=*").collect()}
    assert len(got) == 61 and {k for k, r in got.items() if r["late"]} == {("r0", "old")}
    for repo in ("r0", "r1", "r2"):
        seen: list = []
        for name, run, _, value in rows:
            if name != repo or (repo == "r0" and int(run) > 40):
                continue
            r = got[name, run]
            assert r["prior_runs"] == len(seen)
            if seen:
                assert abs(r["prior_mean"] - np.mean(seen)) < 1e-5 and abs(r["prior_std"] - np.std(np.array(seen) - 10**9)) < 1e-6
            if seen and value is not None:
                assert abs(r["z"] - (value - np.mean(seen)) / (np.std(np.array(seen) - 10**9) or 1.0)) < 1e-4
            else:
                assert r["z"] is None
            seen += [] if value is None else [value]


def test_report_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from gatewright.plans import catalog_tables, registry

    pages = spark.createDataFrame([(i, f"u{i}", "<p>File: z.c<") for i in range(60)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(catalog_tables, "scratch_dir", lambda *_: f"{tmp_path}/reports")
    registry.load_all()
    found = registry.run("src06_html_report_files", spark, str(tmp_path)).collect()
    assert sorted(r["file"] for r in found) == sorted(f"src/{i}.c" for i in range(60))
    parts = {p.name[:10] for p in (tmp_path / "reports").glob("part-*")}
    assert len(parts) >= spark.sparkContext.defaultParallelism


def test_arriving_runs_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from gatewright.plans import catalog_learning, registry

    spark.range(1200).selectExpr(
        "id event_id", "timestamp_seconds(id % 30 * 86400) ts", "id % 40 user_id", "'error' event_type", "10D value", "'p' props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalog_learning, "scratch_dir", lambda _, label: f"{tmp_path}/{label}")
    registry.load_all()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = registry.run("stm03_prior_scores", spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    runs = {(r["repo_id"], r["run_id"]) for r in found}
    assert len(found) == len(runs) == spark.read.parquet(f"{tmp_path}/events.parquet").selectExpr("user_id", "date(ts)").distinct().count()
    assert len(list((tmp_path / "arriving").glob("part-*"))) > 3  # one a part before
