"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions import alerts as A
from gatewright.functions import numbers as N
from gatewright.functions import paths, risk, text
from gatewright.operators import runs as R
from gatewright.plans.registry import query
from gatewright.plans.tables import Tables, glue
from gatewright.plans.views import LEVEL, flag, has_value, listed, r, severity_score

PROSE_TERMS = ["free", "the", "ion", "null", "race", "que", "und", "exec", "con"]


@query("fn01_severity_score_cppcheck", ["alerts"],
       f"SELECT ord, severity, {severity_score('severity', P.SEVERITY_SCORES_CPPCHECK)} AS severity_score FROM alerts")
def _(t: Tables):
    return t.alerts.select("ord", "severity", A.severity_score_a(F.col("severity")).alias("severity_score"))


@query("fn02_severity_score_clang", ["console"],
       f"""SELECT ord, regexp_extract(value, ': (warning|error|note): ', 1) AS severity,
 {severity_score("regexp_extract(value, ': (warning|error|note): ', 1)", P.SEVERITY_SCORES_CLANG)} AS severity_score FROM console""")
def _(t: Tables):
    severity = F.regexp_extract("value", ": (warning|error|note): ", 1)
    return t.console.select("ord", severity.alias("severity"), A.severity_score_b(severity).alias("severity_score"))


@query("fn03_has_value", ["messages"], f"""SELECT ord, {has_value('cwe')} AS has_cwe,
 {has_value("' NULL ' || substr(cwe, 1, 0)")} AS blank_word FROM messages""")
def _(t: Tables):
    blank = F.concat(F.lit(" NULL "), F.substring("cwe", 1, 0))
    return t.messages.select("ord", A.has_value(F.col("cwe")).alias("has_cwe"), A.has_value(blank).alias("blank_word"))


@query("fn04_keyword_flags", [], "SELECT doc_id, " + ", ".join(
    f"{flag('text', terms)} AS {name}_{v}" for v, words in (("a", P.KEYWORDS_CPPCHECK), ("b", P.KEYWORDS_CLANG))
    for name, terms in words.items()) + " FROM documents")
def _(t: Tables):
    both = (("a", P.KEYWORDS_CPPCHECK), ("b", P.KEYWORDS_CLANG))
    lowered = t.read("documents").select("doc_id", F.lower("text").alias("text"))
    return lowered.select("doc_id", *[
        A.keyword_flag(F.col("text"), terms).alias(f"{name}_{v}") for v, words in both for name, terms in words.items()
    ])


@query("fn05_tool_flag", ["messages"],
       """SELECT ord, CAST(contains(lower("toolName"), 'cppcheck') AS INTEGER) AS is_cppcheck, 1 AS is_clang FROM messages""")
def _(t: Tables):
    return t.messages.select("ord", A.tool_flag(F.col("toolName"), "cppcheck").alias("is_cppcheck"), F.lit(1).alias("is_clang"))


@query("fn06_priority_cppcheck", ["alerts"], "SELECT ord, priority, label FROM alerts")
def _(t: Tables):
    return t.alerts.select("ord", "priority", "label")


@query("fn07_priority_clang", ["console_alerts"], f"""
SELECT *, CASE priority WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 END AS label FROM (
SELECT ord, truth, family, CASE WHEN lower(trim(truth)) = 'good' THEN 'LOW'
 WHEN lower(trim(truth)) = 'bad' AND family = '{P.MEDIUM_FAMILY}' THEN 'MEDIUM'
 WHEN lower(trim(truth)) = 'bad' AND family IN ({listed(P.HIGH_FAMILIES)}) THEN 'HIGH' ELSE 'UNKNOWN' END AS priority
FROM (SELECT ord, CASE ord % 4 WHEN 0 THEN ' Good' WHEN 1 THEN 'BAD ' WHEN 2 THEN 'bad' END AS truth,
 regexp_extract(source_file, '(CWE[^/]*_[^/]*)', 1) AS family FROM console_alerts))""")
def _(t: Tables):
    k = F.col("ord")
    truth = F.when(k % 4 == 0, " Good").when(k % 4 == 1, "BAD ").when(k % 4 == 2, "bad")
    rows = t.console_alerts.select("ord", truth.alias("truth"), paths.cwe_family(F.col("source_file")).alias("family"))
    rated = rows.withColumn("priority", A.priority_b(F.col("truth"), F.col("family")))
    return rated.withColumn("label", A.label_of(F.col("priority")))


@query("fn08_normalise_path", ["report_index"], r"""
SELECT repo_id, ord, regexp_replace(replace(trim(source_file), '\', '/'), '/+', '/', 'g') AS path FROM report_index
UNION ALL SELECT CAST(page_id AS VARCHAR), page_id, regexp_replace(trim(url), '/+', '/', 'g') FROM pages""")
def _(t: Tables):
    listed_paths = t.report_index.select("repo_id", "ord", paths.norm_path(F.col("source_file")).alias("path"))
    urls = t.read("pages").select(
        F.col("page_id").cast("string").alias("repo_id"), F.col("page_id").alias("ord"), paths.norm_path(F.col("url")).alias("path")
    )
    return listed_paths.unionByName(urls)


@query("fn09_path_suffixes", [], """
SELECT page_id, array_to_string(parts[i:], '/') AS suffix FROM (
 SELECT page_id, unnest(range(1, len(parts) + 1)) AS i, parts FROM (
  SELECT page_id, [x FOR x IN string_split(regexp_replace(url, '/+', '/', 'g'), '/') IF x <> ''] AS parts FROM pages))""")
def _(t: Tables):
    return t.read("pages").select("page_id", F.explode(paths.path_suffixes(F.col("url"))).alias("suffix"))


def _plain(c: str) -> str:
    for entity, plain in text.COMMON_ENTITIES:
        quoted = plain.replace("'", "''")
        c = f"replace({c}, '{entity}', '{quoted}')"
    return f"trim(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"


@query("fn10_clean_html", [], f"SELECT page_id, {_plain('html')} AS plain FROM pages")
def _(t: Tables):
    return t.read("pages").select("page_id", text.clean_html(F.col("html")).alias("plain"))


_titles = ["<h3[^>]*>(.*?)</h3>", "<h1[^>]*>(.*?)</h1>", "<title>(.*?)</title>"]


@query("fn11_first_match", [], "SELECT page_id, " + _plain(
    "CASE " + " ".join(f"WHEN regexp_matches(html, '(?is){p}') THEN regexp_extract(html, '(?is){p}', 1)" for p in _titles) + " ELSE '' END"
) + " AS headline FROM pages")
def _(t: Tables):
    return t.read("pages").select("page_id", text.first_match(F.col("html"), _titles).alias("headline"))


@query("fn12_normalise_message", ["console_alerts"], r"""
SELECT ord, lower(regexp_replace(regexp_replace(regexp_replace(trim(message), '\s*\[[^\]]+\]\s*$', ''),
 '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '\s+', ' ', 'g')) AS message FROM console_alerts
UNION ALL SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
 '\s*\[[^\]]+\]\s*$', ''), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'), '\s+', ' ', 'g')) FROM documents""")
def _(t: Tables):
    a = t.console_alerts.select("ord", text.norm_message(F.col("message")).alias("message"))
    d = t.read("documents").select(F.col("doc_id").alias("ord"), text.norm_message(F.col("text")).alias("message"))
    return a.unionByName(d)


@query("fn13_good_bad_names", ["case_files"], """
SELECT source_file, regexp_matches(source_file, '(?i)(^|[^A-Za-z0-9])bad(Sink|Source)?[0-9]*([^A-Za-z0-9]|$)') AS is_bad,
 regexp_matches(source_file, '(?i)(^|[^A-Za-z0-9])good(G2B|B2G)?[0-9]*([^A-Za-z0-9]|$)') AS is_good FROM case_files""")
def _(t: Tables):
    c = F.col("source_file")
    return t.case_files.select("source_file", text.is_bad(c).alias("is_bad"), text.is_good(c).alias("is_good"))


@query("fn14_ground_truth", ["console_alerts"], """
SELECT ord, CASE WHEN ord % 3 = 0 THEN 'bad' WHEN ord % 3 = 1 THEN 'good' WHEN ord % 7 = 0 THEN 'bad' WHEN ord % 7 = 1 THEN 'good'
 ELSE 'unknown' END AS status, CASE WHEN ord % 3 < 2 THEN 'plist_source_function' WHEN ord % 7 < 2 THEN 'enclosing_function'
 ELSE 'unknown' END AS origin FROM console_alerts""")
def _(t: Tables):
    k = F.col("ord")
    own = F.when(k % 3 == 0, "CWE_badSink2").when(k % 3 == 1, "goodB2G").otherwise("")
    near = F.when(k % 7 == 0, "x_bad").when(k % 7 == 1, "good1").when(k % 7 == 2, "badly")
    status, origin = text.ground_truth(own, near)
    return t.console_alerts.select("ord", status.alias("status"), origin.alias("origin"))


@query("fn15_cwe_names", ["console"], """
SELECT ord, regexp_extract(file_name, 'CWE([0-9]+)', 1) AS cwe,
 coalesce(([p FOR p IN string_split(value, '/') IF starts_with(p, 'CWE') AND contains(p, '_')])[1], '') AS family FROM console""")
def _(t: Tables):
    return t.console.select(
        "ord", paths.cwe_number(F.col("file_name")).alias("cwe"), paths.cwe_family(F.col("value")).alias("family")
    )


_stem = r"regexp_replace(split_part(source_file, '/', -1), '\.[^.]+$', '')"


@query("fn16_case_id", ["console_alerts"],
       rf"SELECT ord, regexp_replace({_stem}, '([0-9])[a-e]$', '\1') AS case_id FROM console_alerts")
def _(t: Tables):
    return t.console_alerts.select("ord", paths.case_id(paths.stem(F.col("source_file"))).alias("case_id"))


@query("fn17_case_group_id", ["case_files"],
       f"SELECT source_file, regexp_replace({_stem}, '(_(bad|goodG2B|goodB2G|good|[0-9]+[a-z]?))+$', '') AS case_group FROM case_files")
def _(t: Tables):
    return t.case_files.select("source_file", paths.case_group_id(paths.stem(F.col("source_file"))).alias("case_group"))


@query("fn18_alert_id", ["console_alerts"], """
SELECT ord, alert_id FROM console_alerts UNION ALL SELECT doc_id, substr(split_part(text, ':', 1), 1, 60) FROM documents""")
def _(t: Tables):
    d = t.read("documents").select(F.col("doc_id").alias("ord"), text.alert_id(F.col("text")).alias("alert_id"))
    return t.console_alerts.select("ord", "alert_id").unionByName(d)


@query("fn19_annotation_id", ["console_alerts"], """
SELECT ord, 'clang-ann-' || substr(sha1(source_file || '|' || line || '|' || alert_id || '|' || cwe || '|' || severity || '|' || message),
 1, 16) AS annotation_id FROM console_alerts""")
def _(t: Tables):
    parts = [F.col(c) for c in ("source_file", "line", "alert_id", "cwe", "severity", "message")]
    return t.console_alerts.select("ord", text.annotation_id(*parts).alias("annotation_id"))


@query("fn20_risk_level", ["risks"], """SELECT ord, risk_score, CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM'
 ELSE 'LOW' END AS level FROM risks""")
def _(t: Tables):
    score = risk.risk_score(F.col("probability"))
    return t.risks.select("ord", score.alias("risk_score"), risk.risk_level(score).alias("level"))


@query("fn21_confidence_gate", ["risks"], "SELECT ord, confidence, risk_level FROM risks")
def _(t: Tables):
    return t.risks.select("ord", "confidence", "risk_level")


def _terms(c: str, terms: list[str]) -> str:
    return "[" + ", ".join(f"CASE WHEN contains(lower({c}), '{x}') THEN '{x}' END" for x in terms) + "]"


@query("fn22_risky_terms", [], f"""
SELECT doc_id, array_to_string(([x FOR x IN {_terms('text', P.RISKY_TERMS)} IF x IS NOT NULL])[1:5], '|') AS top_risky_terms,
 array_to_string(([x FOR x IN {_terms('text', PROSE_TERMS)} IF x IS NOT NULL])[1:5], '|') AS prose_terms FROM documents""")
def _(t: Tables):
    c = F.col("text")
    return t.read("documents").select(
        "doc_id", F.array_join(risk.risky_terms(c), "|").alias("top_risky_terms"),
        F.array_join(risk.risky_terms(c, PROSE_TERMS), "|").alias("prose_terms"),
    )


@query("fn23_risk_reason", [], f"""
WITH p AS (SELECT doc_id, text, CAST(n_chars % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS probability, doc_id % 5 = 0 AS fallback,
  ([x FOR x IN {_terms('text', PROSE_TERMS)} IF x IS NOT NULL])[1:5] AS terms FROM documents),
s AS (SELECT *, {r('probability * 100', 2)} AS risk_score, {r('abs(probability - 0.5) * 2', 4)} AS confidence FROM p),
l AS (SELECT *, {LEVEL} AS level, array_to_string(terms[1:3], ', ') AS shown FROM s)
SELECT doc_id, CASE WHEN level = 'REVIEW_REQUIRED' THEN 'REVIEW_REQUIRED because model confidence (' || CAST(confidence AS VARCHAR) ||
 ') is below threshold (0.2).' || CASE WHEN len(terms) > 0 THEN ' Potential risky terms include ' || shown || '.' ELSE '' END
 WHEN len(terms) > 0 THEN level || ' because modified function contains ' || shown || ' patterns.'
 WHEN level = 'HIGH' THEN 'HIGH based on model confidence for vulnerable code patterns.'
 WHEN level = 'MEDIUM' THEN 'MEDIUM based on model confidence for potentially risky code patterns.'
 ELSE 'LOW because no strong vulnerable pattern signals were detected.' END ||
 CASE WHEN fallback THEN ' Function extraction failed, so full-file fallback analysis was used.' ELSE '' END AS risk_reason FROM l""")
def _(t: Tables):
    rows = t.read("documents").select(
        "doc_id", ((F.col("n_chars") % 1000).cast("double") / F.lit(1000.0)).alias("probability"),
        (F.col("doc_id") % 5 == 0).alias("fallback"), risk.risky_terms(F.col("text"), PROSE_TERMS).alias("terms"),
    )
    scored = R.score_risk(rows)
    reason = risk.risk_reason(F.col("risk_level"), F.col("terms"), F.col("fallback"), F.col("confidence"))
    return scored.select("doc_id", reason.alias("risk_reason"))


@query("fn24_positive_score", [], f"""
SELECT event_id, {r('1 / (1 + exp(-(value - 50) / 25))', 9)} AS from_margin, CAST(event_type = 'error' AS DOUBLE) AS from_prediction,
 {r('value / 500', 9)} AS from_probability FROM events""")
def _(t: Tables):
    from pyspark.ml.functions import array_to_vector

    margin = (F.col("value") - 50) / 25
    p = F.col("value") / 500
    vector = array_to_vector(F.array(1 - p, p))
    return t.read("events").select(
        "event_id",
        N.round_half_up(risk.positive_score("margin", margin), 9).alias("from_margin"),
        risk.positive_score("prediction", (F.col("event_type") == "error").cast("int")).alias("from_prediction"),
        N.round_half_up(risk.positive_score("probability", vector), 9).alias("from_probability"),
    )


@query("fn25_truthy_status", ["history"], """
SELECT repo_id, run_id, lower(trim(ml3_scoring_blocked)) IN ('1', 'true', 'yes', 'y') AS blocked,
 upper(trim(commit_risk_status)) AS commit_risk_status, upper(trim(commit_summary_status)) AS commit_summary_status FROM history""")
def _(t: Tables):
    return t.history.select(
        "repo_id", "run_id", risk.truthy(F.col("ml3_scoring_blocked")).alias("blocked"),
        risk.norm_status(F.col("commit_risk_status")).alias("commit_risk_status"),
        risk.norm_status(F.col("commit_summary_status")).alias("commit_summary_status"),
    )


@query("fn26_issue_texts", ["alerts", "risks"], """
SELECT ord, tool || ' | ' || alert_id || ' | ' || file || CASE WHEN line IS NULL THEN '' ELSE ':' || line END || ' | ' || message AS alert_text,
 'commit-risk | ' || file_path || ' | risk score: ' || CAST(risk_score AS VARCHAR) AS commit_text FROM alerts JOIN risks USING (ord)""")
def _(t: Tables):
    a = t.alerts.select("ord", risk.alert_text(*[F.col(c) for c in ("tool", "alert_id", "file", "line", "message")]).alias("alert_text"))
    c = t.risks.select("ord", risk.commit_text(F.col("file_path"), F.col("risk_score")).alias("commit_text"))
    return a.join(c, "ord")


@query("fn27_function_name", ["parts"], """
SELECT file_path, l_linenumber, l_partkey, l_suppkey, CASE kind WHEN 2 THEN 'anonymous_function' WHEN 3 THEN
 's_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey ELSE function_name END AS function_name FROM parts""")
def _(t: Tables):
    head = F.substring_index(F.substring_index(F.col("piece"), "{", 1), "(", 1)
    head = F.when(head.startswith("#define"), "@#$%^&*").otherwise(head)
    return t.source_parts.select(
        "file_path", "place.l_linenumber", "place.l_partkey", "place.l_suppkey", text.function_name(head).alias("function_name")
    )


@query("fn28_now_utc", [], "SELECT event_id, true AS is_past FROM events")
def _(t: Tables):
    return t.read("events").select("event_id", (risk.now_utc() > F.col("ts").cast("timestamp")).alias("is_past"))


@query("fn29_anomaly_defaults", ["runs"], """
SELECT repo_id, run_id, CASE WHEN d % 3 = 0 THEN 'NOT_AVAILABLE' WHEN d % 3 = 1 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS anomaly_status,
 CASE WHEN d % 3 = 0 THEN 'ML3 anomaly report not available' WHEN d % 3 = 1 THEN 'ML3 pipeline anomaly status: ANOMALOUS, score: '
 || CAST(CAST(d AS DOUBLE) / 4 AS VARCHAR) ELSE 'given' END AS anomaly_reason
FROM (SELECT *, CAST(substr(run_id, 9, 2) AS INTEGER) AS d FROM runs)""")
def _(t: Tables):
    d = F.substring("run_id", 9, 2).cast("int")
    rows = t.runs.select(
        "repo_id", "run_id",
        F.when(d % 3 == 1, "ANOMALOUS").when(d % 3 == 2, "NORMAL").alias("anomaly_status"),
        F.when(d % 3 == 1, d / 4).cast("double").alias("anomaly_score"),
        F.when(d % 3 == 2, "given").alias("anomaly_reason"), (d % 3 != 0).alias("anomaly_seen"),
    )
    return R.anomaly_defaults(rows).drop("anomaly_score")


@query("prj06_run_identifier", [], """
SELECT event_id, coalesce(nullif(trim(given), ''), 'gh_run:' || nullif(trim(gh), ''),
 'sha:' || nullif(trim(sha), '') || ':' || nullif(trim(ts), ''), 'sha:' || nullif(trim(sha), ''), 'ts:' || nullif(trim(ts), ''), '') AS run
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN ' own-' || event_id ELSE ' ' END AS given,
 CASE WHEN event_id % 5 = 0 THEN CAST(user_id AS VARCHAR) END AS gh, CASE WHEN event_id % 3 = 0 THEN 'abc' || user_id END AS sha,
 CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS ts FROM events)""")
def _(t: Tables):
    k = F.col("event_id")
    return t.read("events").select("event_id", risk.run_identifier(
        F.when(k % 7 == 0, glue("= own-", k)).otherwise(" "), F.when(k % 5 == 0, F.col("user_id").cast("string")),
        F.when(k % 3 == 0, glue("=abc", "user_id")), F.when(k % 2 == 0, k.cast("string")).otherwise(""),
    ).alias("run"))
