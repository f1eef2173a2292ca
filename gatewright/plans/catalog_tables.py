"""Sources, sinks, checks, projections, filters, sets and sorts."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions import alerts as A
from gatewright.functions.numbers import to_number
from gatewright.operators import history as H
from gatewright.operators import quality as Q
from gatewright.operators import rows as O
from gatewright.operators import runs as R
from gatewright.operators.features import fit_code_tfidf
from gatewright.operators.models import one_hot_stages
from gatewright.plans.registry import query
from gatewright.plans.tables import Tables, glue
from gatewright.plans.views import listed, r
from gatewright.session import cut_lineage, scratch_dir, widen
from gatewright.sources import readers as S
from gatewright.sources import sinks as K

TRAINING = "ord, tool, file, line, alert_id, cwe, severity, message, is_actionable, priority, label, severity_score, has_cwe, " + ", ".join(
    P.FLAG_COLUMNS) + ", is_cppcheck"


def training_rows(t: Tables):
    """Both warning sets as alert-training rows."""
    rows = t.messages
    parts = [O.warning_to_alert(rows.filter(F.col("actionable") == flag).drop("actionable"), flag) for flag in (True, False)]
    return O.union_tables(*parts)


# ---- sources -----------------------------------------------------------------------------------------------------
@query("src01_labelled_functions_json", ["labelled"], """
SELECT 'train' AS split, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS project, '' AS commit_id, '' AS cve,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '79' END AS cwe, function_code, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE target END AS target
FROM (SELECT * REPLACE (CAST(target AS BIGINT) AS target) FROM labelled)""")
def _(t: Tables):
    k = F.col("doc_id")
    keep = F.struct(
        F.when(k % 4 != 0, F.col("source")).alias("project"), F.when(k % 3 != 0, F.lit("79")).alias("cwe"),
        F.col("function_code").alias("func"), F.when(k % 5 != 0, F.col("target")).alias("target"),
    )
    # Nulls are left out of the text (absent keys), except an explicit null for cwe.
    line = F.to_json(keep)
    line = F.when(k % 3 == 0, F.concat(F.lit('{"cwe":null,'), F.substring(line, 2, 2**30))).otherwise(line)
    path = scratch_dir(t.spark, "jsonl")
    t.labelled.select(line.alias("value")).write.text(path)
    return S.read_labelled_functions(t.spark, path, "train")


@query("src02_warnings_gzip_json", ["training"], f"SELECT {TRAINING} FROM training")
def _(t: Tables):
    spark, sets = t.spark, []
    for flag in (True, False):
        path = scratch_dir(spark, "warnings")
        rows = cut_lineage(t.messages.filter(F.col("actionable") == flag).drop("actionable"), "warnings")
        # One JSON array per file of bounded size; the number of files grows with the data.
        fields = F.struct(*[c for c in rows.columns])
        bucket = F.pmod(F.xxhash64("ord"), F.lit(1 + rows.count() // 20_000))
        arrays = rows.groupBy(bucket.alias("bucket")).agg(F.to_json(F.collect_list(fields)).alias("value"))
        arrays.write.partitionBy("bucket").option("compression", "gzip").text(path)
        sets.append(S.read_warnings(spark, path, flag, also="ord string"))
    return O.union_tables(*sets)


@query("src03_csv_tables", ["labelled"],
       "SELECT doc_id, split, function_code, CAST(target AS INTEGER) AS target FROM labelled")
def _(t: Tables):
    path = scratch_dir(t.spark, "csv")
    K.write_report(t.labelled.select("doc_id", "split", "function_code", "target"), path, csv=True)
    return S.read_csv(t.spark, path, "doc_id long, split string, function_code string, target int")


@query("src04_lenient_report", ["alerts"], "SELECT priority, count(*) AS n, 0 AS missing_rows FROM alerts GROUP BY ALL")
def _(t: Tables):
    path = scratch_dir(t.spark, "report")
    columns = ["priority", "tool", "file", "line", "alert_id", "cwe", "severity", "message"]
    K.write_report(t.alerts.select(*columns), path, csv=True)
    schema = "priority string, tool string, file string, line long"
    found = S.read_report(t.spark, path, schema).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    absent = S.read_report(t.spark, path + "-absent", schema).agg(F.count(F.lit(1)).cast("int").alias("missing_rows"))
    return found.join(F.broadcast(absent))  # one row


@query("src05_xml_alerts", ["alerts"], """
SELECT 'cppcheck' AS tool, CASE WHEN line IS NULL THEN '' ELSE file END AS file, coalesce(CAST(line AS VARCHAR), '') AS line, alert_id,
 coalesce(cwe, '') AS cwe, severity, message FROM alerts""")
def _(t: Tables):
    path = scratch_dir(t.spark, "xml")
    place = F.struct(F.col("file").alias("_file"), F.col("line").cast("string").alias("_line"))
    second = F.struct(F.lit("other.c").alias("_file"), F.lit("1").alias("_line"))
    errors = t.alerts.select(
        F.col("alert_id").alias("_id"), F.col("severity").alias("_severity"), F.col("message").alias("_msg"),
        F.col("cwe").alias("_cwe"), F.when(F.col("line").isNotNull(), F.array(place, second)).alias("location"),
    )
    errors.write.format("xml").option("rowTag", "error").option("rootTag", "errors").save(path)
    return S.read_xml_alerts(t.spark, path)


@query("src06_html_reports", [], r"""
SELECT page_id, 'clang' AS tool, url AS file, '' AS line, 'clang-static-analyzer' AS alert_id, '' AS cwe, 'warning' AS severity,
 CASE WHEN m = '' THEN 'Unknown Clang issue' ELSE m END AS message FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(
 replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'),
 '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS m FROM pages)""")
def _(t: Tables):
    return S.html_alerts(t.read("pages").select("page_id", "url", "html"), "html", "url")


@query("src06_html_report_files", [], r"""
SELECT 'clang' AS tool, 'src/' || page_id || '.c' AS file, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE '' END AS line,
 'clang-static-analyzer' AS alert_id, '' AS cwe, 'warning' AS severity,
 CASE WHEN page_id % 3 = 0 THEN 'Bug in ' || page_id || ' & more' ELSE 'Leak ' || page_id END AS message FROM pages""")
def _(t: Tables):
    path, n = scratch_dir(t.spark, "reports"), F.col("page_id")
    message = F.when(n % 3 == 0, glue("=<!-- BUGDESC Bug in ", n, "= &amp; more -->\n")).otherwise(glue("=<h3 class='x'>Leak\n <b>", n, "=</b></h3>"))
    file = F.when(n % 5 == 0, glue("=<!-- BUGFILE src/", n, "=.c -->")).otherwise(glue("=<td>File:</td>\n<td class='f'>src/", n, "=.c</td>"))
    line = F.when(n % 4 == 0, glue("=<!-- BUGLINE ", n, "= -->")).when(n % 2 == 0, glue("=<td>Line:</td><td>", n, "=</td>")).otherwise("")
    pages = widen(t.read("pages")).select(F.concat(message, file, line, F.lit("\n"), F.coalesce("html", F.lit(""))).alias("value"))
    pages.write.option("maxRecordsPerFile", 1).text(path)  # a file for each report, as analyzers write them
    return S.read_html_reports(t.spark, path, "*.txt").drop("report_file")


@query("src07_console_alerts", ["console_alerts"], "SELECT * FROM console_alerts")
def _(t: Tables):
    return t.console_alerts


def _plist_texts(d, keys: list[str]):
    """(keys, content) of property lists with some ``_REPORT_ROWS`` diagnostics each, however many share the keys."""
    columns = ["line", "source_file", "description", "issue_context", "issue_context_kind"]

    def pair(key: str, kind: str, c) -> F.Column:
        return F.concat(F.lit(f"<key>{key}</key><{kind}>"), c.cast("string"), F.lit(f"</{kind}>"))

    # equal diagnostics are numbered, so they part as others do
    counted = d.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("copies"))
    rows = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    sizes = counted.groupBy(*keys).agg(F.ceil(F.sum("copies") / _REPORT_ROWS).alias("parts"))
    joined = rows.join(sizes, keys) if keys else rows.crossJoin(F.broadcast(sizes))  # without keys sizes is one row
    cut = joined.withColumn("part", F.pmod(F.xxhash64(*columns, "copy"), F.col("parts")))
    # One file entry per diagnostic, so the array index of a diagnostic is its own position.
    grouped = cut.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))
    entries = F.transform("items", lambda x, i: F.concat(
        F.lit("<dict>"), pair("description", "string", x["description"]), pair("issue_context", "string", x["issue_context"]),
        pair("issue_context_kind", "string", x["issue_context_kind"]), F.lit("<key>location</key><dict>"),
        pair("file", "integer", i), pair("line", "integer", x["line"]), F.lit("</dict></dict>"),
    ))
    files = F.transform("items", lambda x: F.concat(F.lit("<string>"), x["source_file"], F.lit("</string>")))
    content = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><plist version="1.0"><dict><key>diagnostics</key><array>'),
        F.array_join(entries, ""), F.lit("</array><key>files</key><array>"), F.array_join(files, ""),
        F.lit("</array></dict></plist>"),
    )
    return grouped.select(*keys, content.alias("content"))


_REPORT_ROWS = 500


@query("src08_plists", ["diagnostics"], """
SELECT 'r' || repo_id || report AS report, line, source_file, description, issue_context, issue_context_kind FROM diagnostics
WHERE report <> 'rep7.plist'""")
def _(t: Tables):
    texts = _plist_texts(t.diagnostics.withColumn("report", glue("=r", "repo_id", "report")), ["report"])
    broken = F.col("report").endswith("rep7.plist")
    content = F.when(broken, F.lit("not a plist")).otherwise(F.col("content")).cast("binary")
    return S.plist_diagnostics(S.parse_plists(texts.select("report", content.alias("content"))))


@query("src08_plist_files", ["diagnostics"],
       "SELECT line, source_file, description, issue_context, issue_context_kind FROM diagnostics")
def _(t: Tables):
    path = scratch_dir(t.spark, "plists")
    _plist_texts(t.diagnostics, []).write.option("maxRecordsPerFile", 1).text(path)  # a file for each report
    return S.plist_diagnostics(S.read_plists(t.spark, path, "*.txt")).drop("report")


@query("src09_source_texts", ["console"], "SELECT count(*) AS lines, max(length(value)) AS longest FROM console")
def _(t: Tables):
    path = scratch_dir(t.spark, "sources")
    t.console.select("value").write.option("maxRecordsPerFile", 5000).text(path)  # more files, not longer ones
    lines = S.read_sources(t.spark, path, "*.txt").select(F.explode(F.split(F.rtrim("content", F.lit("\n")), "\n")).alias("l"))
    return lines.filter("l <> ''").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("l")).cast("long").alias("longest"))


@query("src10_changed_lines", ["lines"], "SELECT repo_id, run_id, file_path, line FROM lines")
def _(t: Tables):
    from gatewright.operators.changes import changed_lines

    return changed_lines(t.diffs)


@query("src11_scan_status", [], "SELECT 'SCAN_COMPLETED ' || max(event_id) AS scan_status FROM events")
def _(t: Tables):
    path = scratch_dir(t.spark, "status")
    t.read("events").agg(glue("=  SCAN_COMPLETED ", F.max("event_id"), "= ").alias("value")).write.text(path)
    return S.read_scan_status(t.spark, path).filter("scan_status <> ''")


# ---- sinks -------------------------------------------------------------------------------------------------------
@query("snk01_write_report", ["alerts"], "SELECT repo_id, run_id, priority, file, line, message FROM alerts")
def _(t: Tables):
    path = scratch_dir(t.spark, "alerts")
    wanted = t.alerts.select("repo_id", "run_id", "priority", "file", "line", "message")
    K.write_report(wanted, path)
    empty = scratch_dir(t.spark, "empty")
    K.write_report(wanted.filter("line < 0"), empty)
    return t.spark.read.schema(wanted.schema).parquet(path).unionByName(t.spark.read.parquet(empty))


@query("snk02_append_once", ["metrics"], "SELECT repo_id, run_id, total_alerts FROM metrics")
def _(t: Tables):
    path = scratch_dir(t.spark, "history")
    rows = t.metrics.select("repo_id", "run_id", "total_alerts")
    late = F.substring("run_id", 9, 2).cast("int")
    K.append_once(t.spark, path, rows.filter(late < 12))
    K.append_once(t.spark, path, rows.filter(late < 20).unionByName(rows.filter(late < 5)))
    K.append_once(t.spark, path, rows.unionByName(rows))
    return t.spark.read.schema("repo_id string, run_id string, total_alerts long").parquet(path)


_part = "CAST(('0x' || substr(m, {0}, 12)) AS BIGINT)"


@query("snk03_model_metadata", ["labelled"], r"""
WITH t AS (SELECT * FROM labelled WHERE split = 'train'),
h AS (SELECT md5(concat_ws('|', doc_id, coalesce(function_code, 'null'), coalesce(CAST(target AS VARCHAR), 'null'))) AS m FROM t),
v AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(function_code, ''), '[\p{L}\p{N}_]+')) AS term FROM t)
SELECT count(*) AS rows, sha256(count(*) || ':' || sum(""" + _part.format(1) + ") || ':' || sum(" + _part.format(13) + f""")) AS fingerprint,
 'TF-IDF' AS feature_type, 'function-level' AS input_level, least((SELECT count(*) FROM v), 5000) AS vocabulary_size, CAST({P.SEED} AS BIGINT) AS seed FROM h""")
def _(t: Tables):
    train = t.labelled.filter("split = 'train'")
    model = fit_code_tfidf(train)
    path = scratch_dir(t.spark, "model")
    meta = H.dataset_fingerprint(train, ["function_code", "target"], "doc_id").withColumns({
        "feature_type": F.lit("TF-IDF"), "input_level": F.lit("function-level"),
        "vocabulary_size": F.lit(len(model.stages[1].vocabulary)), "seed": F.lit(P.SEED),
    })
    K.save_model(model, meta, path)
    return t.spark.read.json(f"{path}/metadata")


@query("snk04_training_status", ["flags"], """
SELECT repo_id, CASE WHEN ok < 20 THEN 'SKIPPED' ELSE 'READY' END AS status, ok AS rows_available, n AS total_history_rows,
 20 AS min_rows_required, CASE WHEN ok = 0 THEN 'No valid historical rows available after ML3 training filters'
 WHEN ok < 20 THEN 'Not enough valid historical rows for model training' ELSE '' END AS reason
FROM (SELECT repo_id, count(*) AS n, count(*) FILTER (NOT (x_blocked OR x_risk OR x_summary OR x_cppcheck OR x_failed)) AS ok
 FROM flags GROUP BY ALL)""")
def _(t: Tables):
    return Q.training_status(t.history, 20)


# ---- data quality ------------------------------------------------------------------------------------------------
@query("dq01_required_columns", ["alerts"], "SELECT priority, count(*) AS n FROM alerts GROUP BY ALL")
def _(t: Tables):
    rows = Q.require_columns(t.alerts, ["message", "alert_id", "severity", "cwe", "priority"])
    return rows.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


@query("dq02_report_health", ["runs"], """
SELECT repo_id, run_id, report, CASE WHEN k % 7 = 0 THEN 'MISSING' WHEN k % 7 = 1 OR k % 7 = 2 THEN 'MALFORMED'
 WHEN k % 7 = 3 THEN 'SCHEMA_MISMATCH' ELSE 'OK' END AS status
FROM (SELECT *, CAST(repo_id AS BIGINT) + CAST(substr(run_id, 9, 2) AS BIGINT) + length(report) AS k
 FROM (SELECT repo_id, run_id, unnest(['commit_risk_status', 'commit_summary_status', 'cppcheck_status', 'clang_status']) AS report FROM runs))""")
def _(t: Tables):
    required = F.create_map(*[x for k, v in P.REQUIRED_REPORT_COLUMNS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    rows = t.runs.withColumn("report", F.explode(F.array(*[F.lit(c) for c in P.REQUIRED_REPORT_COLUMNS])))
    k = (F.col("repo_id").cast("long") + F.substring("run_id", 9, 2).cast("long") + F.length("report")) % 7
    manifest = rows.withColumns({
        "required": required[F.col("report")], "found": k != 0, "byte_size": F.when(k == 1, 0).otherwise(100),
        "columns": F.when(k == 2, F.lit(None)).when(k == 3, F.array(F.lit("other"))).otherwise(
            F.array_union(required[F.col("report")], F.array(F.lit("extra")))),
    })
    return Q.report_health(manifest).select("repo_id", "run_id", "report", "status")


@query("dq03_scoring_block", ["history"], f"""
SELECT repo_id, run_id, pairs <> '' AS ml3_scoring_blocked, CASE WHEN pairs = '' THEN '' ELSE
 'ML3 scoring blocked due to missing, malformed, or schema-incompatible upstream reports: ' || pairs END AS ml3_scoring_block_reason
FROM (SELECT repo_id, run_id, array_to_string([x FOR x IN [{', '.join(
    f"CASE WHEN upper(trim({c})) IN ({listed(P.BAD_STATUSES)}) THEN '{c}=' || upper(trim({c})) END" for c in sorted(P.UPSTREAM_STATUS_COLUMNS)
)}] IF x IS NOT NULL], ', ') AS pairs FROM history)""")
def _(t: Tables):
    return t.blocked_metrics.select("repo_id", "run_id", "ml3_scoring_blocked", "ml3_scoring_block_reason")


@query("dq04_numeric_features", ["history"], """
SELECT repo_id, run_id, CASE WHEN u % 9 = 0 THEN 'CURRENT_METRICS_NON_NUMERIC_FEATURE:total_alerts'
 WHEN d % 8 = 0 THEN 'CURRENT_METRICS_NON_NUMERIC_FEATURE:alerts_per_file' END AS numeric_failure FROM history""")
def _(t: Tables):
    u, d = F.col("repo_id").cast("long"), F.substring("run_id", 9, 2).cast("long")
    rows = t.history.withColumns({
        "total_alerts": F.when(u % 9 == 0, "many").otherwise(F.col("total_alerts").cast("string")),
        "alerts_per_file": F.when(d % 8 != 0, F.col("alerts_per_file")),
    })
    return Q.check_numeric(rows).select("repo_id", "run_id", "numeric_failure")


@query("dq05_single_row", ["alerts"], """
SELECT repo_id, run_id, CASE WHEN n = 0 THEN 'CURRENT_METRICS_FILE_EMPTY' WHEN n > 1 THEN 'CURRENT_METRICS_ROW_COUNT_INVALID:' || n
 ELSE '' END AS load_error FROM (SELECT repo_id, run_id, count(*) FILTER (priority = 'HIGH') AS n FROM alerts GROUP BY ALL)""")
def _(t: Tables):
    return Q.check_single_row(t.runs, t.alerts.filter("priority = 'HIGH'"))


@query("dq06_model_schema", ["training"], "SELECT " + ", ".join(P.FEATURES_CPPCHECK) + " FROM training")
def _(t: Tables):
    """The features that a saved and loaded pipeline says it was fitted on."""
    rows = training_rows(t)
    path = scratch_dir(t.spark, "model")
    fitted = Pipeline(stages=one_hot_stages(["alert_id", "severity", "cwe"])).fit(rows)
    columns = F.array(*[F.lit(c) for c in P.FEATURES_CPPCHECK])
    K.save_model(fitted, t.spark.range(1).select(columns.alias("feature_columns")), path)
    features = O.select_features(rows, "cppcheck")
    K.load_model(t.spark, path, features.columns)
    return features


@query("dq07_parameters", ["risks"], """
SELECT ord, CASE WHEN confidence < CAST(0.5 AS DOUBLE) AND risk_score < 30 THEN 'REVIEW_REQUIRED' WHEN risk_score >= 30 THEN 'HIGH'
 WHEN risk_score >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM risks""")
def _(t: Tables):
    strict = P.RiskParams(medium_threshold=10.0, high_threshold=30.0, review_confidence=0.5)
    return R.score_risk(t.risks.select("ord", "probability"), strict).select("ord", "risk_level")


_flagged = "SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem"


def flagged(t: Tables):
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.read("lineitem").withColumn("label", label)


@query("dq08_class_coverage", [], f"""
SELECT l_orderkey, count(DISTINCT label) = 3 AS has_all_classes FROM ({_flagged}) GROUP BY ALL""")
def _(t: Tables):
    return Q.has_classes(flagged(t), ["l_orderkey"])


@query("dq09_split_leaks", ["labelled"], """
WITH k AS (SELECT function_code, max(CAST(split = 'train' AS INTEGER)) AS a, max(CAST(split = 'valid' AS INTEGER)) AS b,
 max(CAST(split = 'test' AS INTEGER)) AS c FROM labelled GROUP BY ALL), s AS (SELECT source, max(CAST(split = 'train' AS INTEGER)) AS a,
 max(CAST(split = 'valid' AS INTEGER)) AS b, max(CAST(split = 'test' AS INTEGER)) AS c FROM labelled GROUP BY ALL)
SELECT 'text' AS key, CAST(sum(a * b) AS BIGINT) AS train_valid, CAST(sum(a * c) AS BIGINT) AS train_test, CAST(sum(b * c) AS BIGINT) AS valid_test FROM k
UNION ALL SELECT 'source', CAST(sum(a * b) AS BIGINT), CAST(sum(a * c) AS BIGINT), CAST(sum(b * c) AS BIGINT) FROM s""")
def _(t: Tables):
    a = Q.split_overlap(t.labelled, ["function_code"]).withColumn("key", F.lit("text"))
    return a.unionByName(Q.split_overlap(t.labelled, ["source"]).withColumn("key", F.lit("source")))


# ---- projections -------------------------------------------------------------------------------------------------
@query("prj01_canonical_columns", ["labelled", "training"], f"""
SELECT split, source AS project, '' AS commit_id, '' AS cve, '' AS cwe, function_code, CAST(target AS BIGINT) AS target FROM labelled""")
def _(t: Tables):
    mapping = {"project": F.col("source"), "function_code": F.col("function_code"), "target": F.col("target").cast("long")}
    return O.to_labelled_function(t.labelled, F.col("split"), mapping)


@query("prj01_warning_records", ["training"], f"SELECT {TRAINING} FROM training")
def _(t: Tables):
    return training_rows(t)


@query("prj02_numeric_coercion", ["messages"], 'SELECT ord, TRY_CAST("lineNumber" AS DOUBLE) AS line FROM messages')
def _(t: Tables):
    return t.messages.select("ord", to_number(F.col("lineNumber")).alias("line"))


@query("prj03_null_fill", ["training"], """
SELECT ord, coalesce(cwe, '0') AS cwe, coalesce(line, 0) AS line, coalesce(message, '') AS message FROM training""")
def _(t: Tables):
    return O.fill_text(training_rows(t).select("ord", "cwe", "line", "message"), {"cwe": "0", "line": 0.0, "message": ""})


@query("prj04_absent_columns", ["history"], """
SELECT repo_id, run_id, total_alerts, 0 AS high_alerts, CASE WHEN low_alerts > 2 THEN low_alerts ELSE 0 END AS low_alerts FROM history""")
def _(t: Tables):
    partial = t.history.select("repo_id", "run_id", "total_alerts", F.when(F.col("low_alerts") > 2, F.col("low_alerts")).alias("low_alerts"))
    return O.ensure_columns(partial, ["total_alerts", "high_alerts", "low_alerts"])


@query("prj05_feature_columns", ["training"], f"SELECT ord, {', '.join(P.FEATURES_CPPCHECK)} FROM training")
def _(t: Tables):
    return O.select_features(training_rows(t), "cppcheck", ["ord"])


@query("prj07_anomaly_report", ["history"], f"""
SELECT repo_id, run_id, anomaly_status, reason, failure_reason, anomaly_status = 'ANOMALOUS' AS is_anomaly,
 CASE WHEN anomaly_status IN ('ANOMALOUS', 'NORMAL') THEN score END AS anomaly_score, anomaly_status <> 'FAILED' AS append_to_history FROM (
SELECT *, CASE WHEN load_error <> '' THEN 'FAILED' WHEN blocked THEN 'NOT_AVAILABLE' WHEN u % 5 = 0 THEN 'NOT_AVAILABLE' WHEN bad IS NOT NULL THEN 'FAILED'
 WHEN total_alerts > 4 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS anomaly_status,
 CASE WHEN load_error <> '' THEN 'ML3 current metrics unavailable or invalid' WHEN blocked AND d % 2 = 0 THEN 'why' WHEN blocked THEN 'ML3_SCORING_BLOCKED'
 WHEN u % 5 = 0 AND u < 50 THEN 'INSUFFICIENT_HISTORY' WHEN u % 5 = 0 THEN 'MODEL_NOT_TRAINED'
 WHEN bad IS NOT NULL THEN 'Current metrics contain non-numeric feature values' ELSE 'Scored using trained ML3 anomaly model' END AS reason,
 CASE WHEN load_error <> '' THEN load_error WHEN blocked OR u % 5 = 0 OR bad IS NULL THEN '' ELSE bad END AS failure_reason FROM (
SELECT *, CASE WHEN d % 13 = 0 THEN 'CURRENT_METRICS_FILE_EMPTY' ELSE '' END AS load_error, ml3_scoring_blocked IN ('True', 'yes') AS blocked,
 CASE WHEN d % 9 = 0 THEN 'CURRENT_METRICS_NON_NUMERIC_FEATURE:total_alerts' END AS bad, {r('total_alerts / CAST(7 AS DOUBLE)', 6)} AS score FROM history))""")
def _(t: Tables):
    from gatewright.functions.numbers import round_half_up

    u, d = F.col("repo_id").cast("long"), F.substring("run_id", 9, 2).cast("long")
    rows = t.history.withColumns({
        "load_error": F.when(d % 13 == 0, "CURRENT_METRICS_FILE_EMPTY").otherwise(""),
        "ml3_scoring_block_reason": F.when(d % 2 == 0, "why").otherwise(" "),
        "model_ready": u % 5 != 0, "history_rows": u, "min_rows_required": F.lit(50),
        "numeric_failure": F.when(d % 9 == 0, "CURRENT_METRICS_NON_NUMERIC_FEATURE:total_alerts"),
        "prediction": F.when(F.col("total_alerts") > 4, -1).otherwise(1),
        "anomaly_score": round_half_up(F.col("total_alerts") / F.lit(7.0), 6), "selected_model": F.lit("x"),
    })
    report = H.anomaly_report(rows).withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False)))
    return report.select("repo_id", "run_id", "anomaly_status", "reason", "failure_reason", "is_anomaly", "anomaly_score", "append_to_history")


# ---- filters -----------------------------------------------------------------------------------------------------
@query("flt01_changed_files", ["case_files"], """
WITH f AS (SELECT 'r' AS repo_id, 'x' AS run_id, source_file AS file_path FROM case_files
 UNION ALL SELECT 'p', 'x', CASE page_id % 6 WHEN 0 THEN 'C/src' || page_id || '.HPP' WHEN 1 THEN 'C2/a' || page_id || '.c' WHEN 2 THEN 'C/.git/a' || page_id || '.c'
  WHEN 3 THEN 'C/reports/b' || page_id || '.h' WHEN 4 THEN 'C/readme' || page_id || '.md' ELSE 'C/x' || (page_id % 10) || '.cc' END FROM pages)
SELECT DISTINCT repo_id, run_id, file_path FROM f WHERE regexp_matches(lower(file_path), '\\.(c|cpp|cc|cxx|h|hpp)$') AND starts_with(file_path, 'C/')
 AND NOT contains(file_path, '/.git/') AND NOT contains(file_path, '/reports/')""".replace("\\\\", "\\"))
def _(t: Tables):
    k = F.col("page_id")
    odd = (
        F.when(k % 6 == 0, glue("=C/src", k, "=.HPP")).when(k % 6 == 1, glue("=C2/a", k, "=.c")).when(k % 6 == 2, glue("=C/.git/a", k, "=.c"))
        .when(k % 6 == 3, glue("=C/reports/b", k, "=.h")).when(k % 6 == 4, glue("=C/readme", k, "=.md")).otherwise(glue("=C/x", k % 10, "=.cc"))
    )
    files = t.case_files.select(F.lit("r").alias("repo_id"), F.lit("x").alias("run_id"), F.col("source_file").alias("file_path"))
    extra = t.read("pages").select(F.lit("p").alias("repo_id"), F.lit("x").alias("run_id"), odd.alias("file_path"))
    return O.changed_source_files(files.unionByName(extra), "C")


@query("flt02_ignored_alerts", [], f"""
SELECT event_id, alert_id FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'missingInclude' WHEN 'click' THEN 'checkersReport'
 ELSE event_type END AS alert_id FROM events) WHERE alert_id NOT IN ({listed(P.IGNORED_ALERT_IDS)})""")
def _(t: Tables):
    kind = F.when(F.col("event_type") == "view", "missingInclude").when(F.col("event_type") == "click", "checkersReport")
    return O.drop_ignored(t.read("events").select("event_id", F.coalesce(kind, F.col("event_type")).alias("alert_id")))


@query("flt03_drop_notes", ["console"], """
SELECT ord, regexp_extract(value, ': (warning|error|note): ', 1) AS severity FROM console
WHERE regexp_extract(value, ': (warning|error|note): ', 1) <> 'note'""")
def _(t: Tables):
    return O.drop_notes(t.console.select("ord", F.regexp_extract("value", ": (warning|error|note): ", 1).alias("severity")))


@query("flt04_incomplete_rows", [], """
SELECT doc_id, text, quality FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS text, quality FROM documents LEFT JOIN labels USING (doc_id))
WHERE text IS NOT NULL AND quality IS NOT NULL""")
def _(t: Tables):
    rows = t.read("documents").join(t.read("labels"), "doc_id", "left").select(
        "doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"), "quality")
    return O.drop_incomplete(rows, ["text", "quality"])


@query("flt05_known_labels", [], """
SELECT o_orderkey, label FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderkey % 5 AS INTEGER) END AS label FROM orders)
WHERE label IN (0, 1, 2)""")
def _(t: Tables):
    k = F.col("o_orderkey")
    return O.known_labels(t.read("orders").select("o_orderkey", F.when(k % 5 < 4, (k % 5).cast("int")).alias("label")))


_VALID = "repo_id, run_id, total_alerts, ml3_outcome"


@query("flt06_valid_history", ["valid"], f"SELECT {_VALID} FROM valid")
def _(t: Tables):
    return Q.valid_history(t.history).select("repo_id", "run_id", "total_alerts", "ml3_outcome")


@query("flt06_exclusion_counts", ["flags"], """
SELECT * FROM (SELECT repo_id, 'ML3_SCORING_BLOCKED' AS reason, count(*) FILTER (x_blocked) AS rows FROM flags GROUP BY ALL
UNION ALL SELECT repo_id, 'commit_risk_status:MISSING', count(*) FILTER (x_risk) FROM flags GROUP BY ALL
UNION ALL SELECT repo_id, 'commit_summary_status:MALFORMED', count(*) FILTER (x_summary) FROM flags GROUP BY ALL
UNION ALL SELECT repo_id, 'cppcheck_status:SCHEMA_MISMATCH', count(*) FILTER (x_cppcheck) FROM flags GROUP BY ALL
UNION ALL SELECT repo_id, 'ML3_OUTCOME_FAILED', count(*) FILTER (x_failed) FROM flags GROUP BY ALL) WHERE rows > 0
UNION ALL SELECT repo_id, 'TOTAL_ROWS', count(*) FROM flags GROUP BY ALL
UNION ALL SELECT repo_id, 'VALID_ROWS', count(*) FILTER (NOT (x_blocked OR x_risk OR x_summary OR x_cppcheck OR x_failed)) FROM flags GROUP BY ALL
UNION ALL SELECT repo_id, 'EXCLUDED_ROWS', count(*) FILTER (x_blocked OR x_risk OR x_summary OR x_cppcheck OR x_failed) FROM flags GROUP BY ALL""")
def _(t: Tables):
    return Q.exclusion_counts(t.history)


@query("flt07_selected_families", ["case_files"], f"""
SELECT source_file, regexp_extract(source_file, '(CWE[^/]*_[^/]*)', 1) AS cwe_folder FROM case_files
WHERE regexp_extract(source_file, '(CWE[^/]*_[^/]*)', 1) IN ({listed([P.MEDIUM_FAMILY, *P.HIGH_FAMILIES])})""")
def _(t: Tables):
    return O.selected_families(t.case_files)


@query("flt08_history_gate", ["history"], """
SELECT repo_id, count(*) AS history_rows, CASE WHEN count(*) < 27 THEN 'INSUFFICIENT_HISTORY' ELSE 'MODEL_NOT_TRAINED' END AS reason
FROM history GROUP BY ALL""")
def _(t: Tables):
    return Q.history_gate(t.runs, t.history, 27)


# ---- sets and sorts ----------------------------------------------------------------------------------------------
@query("set01_union_tables", [], """
SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def _(t: Tables):
    c = t.read("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return O.union_tables(c, t.read("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("set02_distinct_rows", ["alerts"], "SELECT DISTINCT file, alert_id FROM alerts")
def _(t: Tables):
    return O.distinct_rows(t.alerts, ["file", "alert_id"])


@query("set03_overlap_size", ["labelled"], """
SELECT count(*) AS overlap FROM (SELECT function_code FROM labelled WHERE split = 'train' INTERSECT SELECT function_code FROM labelled WHERE split <> 'train')""")
def _(t: Tables):
    return O.overlap_size(t.labelled.filter("split = 'train'"), t.labelled.filter("split <> 'train'"), ["function_code"])


@query("set04_difference", [], "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables):
    return O.difference(t.read("documents").select("doc_id", "source"), t.read("labels"), ["doc_id"])


@query("srt01_ranked_alerts", ["alerts"], "SELECT priority, tool, file, line, alert_id, cwe, severity, message FROM alerts")
def _(t: Tables):
    columns = ["priority", "tool", "file", "line", "alert_id", "cwe", "severity", "message"]
    return O.rank_alerts(t.alerts.select(*columns))


@query("srt02_sorted_files", ["case_files"], "SELECT DISTINCT source_file FROM case_files ORDER BY 1")
def _(t: Tables):
    return O.sorted_distinct(t.case_files, "source_file")


@query("srt03_sample_head", ["console_alerts"], r"""
SELECT DISTINCT source_file, regexp_replace(regexp_replace(split_part(source_file, '/', -1), '\.[^.]+$', ''), '([0-9])[a-e]$', '\1') AS case_id
FROM console_alerts ORDER BY source_file LIMIT 30""")
def _(t: Tables):
    from gatewright.functions import paths

    cases = t.console_alerts.select("source_file", paths.case_id(paths.stem(F.col("source_file"))).alias("case_id")).distinct()
    return O.sample_head(cases, 30, ["source_file"])


@query("srt04_best_row", ["metrics"], "SELECT repo_id, run_id, total_alerts FROM metrics ORDER BY total_alerts DESC, repo_id, run_id LIMIT 1")
def _(t: Tables):
    rows = t.metrics.select("repo_id", "run_id", "total_alerts")
    return O.best_row(rows, [F.desc("total_alerts"), F.asc("repo_id"), F.asc("run_id")])
