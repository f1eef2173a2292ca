"""Joins: changed functions, report and diagnostic matching, spans, lookups, run assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright.functions import alerts as A
from gatewright.functions import text
from gatewright.operators import changes as C
from gatewright.operators import matching as M
from gatewright.operators import rows as O
from gatewright.operators import runs as R
from gatewright.operators import spans as X
from gatewright.operators import splits as S
from gatewright.operators.neighbours import knn, weighted_points
from gatewright.plans.registry import query
from gatewright.plans.tables import Tables, glue
from gatewright.plans.views import r
from gatewright.session import cut_lineage
from gatewright.sources import sinks as K

KEYS = ["repo_id", "run_id", "file_path"]
SPAN = "repo_id, run_id, file_path, function_name, start_line, end_line"


@query("spn01_function_spans", ["spans"], f"SELECT {SPAN}, function_code FROM spans")
def _(t: Tables):
    return X.function_spans(t.sources, KEYS)


# The single-line typed signature of a function piece; a method has a qualified name and does not match.
@query("spn02_typed_spans", ["parts"], f"""
SELECT repo_id, run_id, file_path, function_name, CAST(first_line AS INTEGER) AS start_line, CAST(first_line + 2 AS INTEGER) AS end_line
FROM parts WHERE kind = 0""")
def _(t: Tables):
    return X.typed_function_spans(t.sources, KEYS)


@query("jn01_touched_functions", ["touched"], f"SELECT {SPAN} FROM touched")
def _(t: Tables):
    return C.touched_functions(X.function_spans(t.sources, KEYS).drop("function_code"), C.changed_hunks(t.diffs))


_fallback = """
SELECT repo_id, run_id, file_path, function_name, start_line, end_line, function_code, false AS fallback_used FROM touched
UNION ALL SELECT repo_id, run_id, file_path, '__FILE_FALLBACK__', 1, n_lines, content, true FROM sources
WHERE file_path NOT IN (SELECT file_path FROM touched)"""


@query("jn02_file_fallback", ["touched", "sources"], _fallback)
def _(t: Tables):
    sources = cut_lineage(t.sources, "sources")
    funcs = X.function_spans(sources, KEYS)
    return C.with_file_fallback(sources, C.touched_functions(funcs, C.changed_hunks(t.diffs)))


@query("jn02_changed_functions", ["touched", "sources"], _fallback)
def _(t: Tables):
    return C.changed_functions(t.sources, t.diffs)


_known = r"""known AS (SELECT repo_id, regexp_replace(replace(trim(source_file), '\', '/'), '/+', '/', 'g') AS path, max(report) AS report
 FROM report_index GROUP BY ALL)"""
_resolved = f"""{_known},
wanted AS (SELECT DISTINCT repo_id, source_file AS path FROM console_alerts),
exact AS (SELECT w.repo_id, w.path, k.report FROM wanted w LEFT JOIN known k USING (repo_id, path)),
loose AS (SELECT e.repo_id, e.path, min(k.report) AS low, max(k.report) AS high FROM exact e JOIN known k ON e.repo_id = k.repo_id
 AND (ends_with(e.path, k.path) OR ends_with(k.path, e.path)) WHERE e.report IS NULL GROUP BY ALL),
resolved AS (SELECT repo_id, path, report FROM exact WHERE report IS NOT NULL UNION ALL SELECT repo_id, path, low FROM loose WHERE low = high)"""


@query("jn03_match_report", ["console_alerts", "report_index"], f"""
WITH {_resolved} SELECT a.ord, a.source_file, s.report FROM console_alerts a LEFT JOIN resolved s ON a.repo_id = s.repo_id AND a.source_file = s.path""")
def _(t: Tables):
    return M.match_report(t.kept_alerts, t.report_index).select("ord", "source_file", "report")


_matched = r"""al AS (SELECT *, 'rep' || (ord % 30) || '.plist' AS report, CASE ord % 4 WHEN 0 THEN source_file WHEN 1 THEN replace(source_file, '/work/', '')
 ELSE 'elsewhere/' || split_part(source_file, '/', -1) END AS alert_file FROM console_alerts),
files AS (SELECT repo_id, report, regexp_replace(replace(trim(source_file), '\', '/'), '/+', '/', 'g') AS path, min(ord) AS ord FROM report_index GROUP BY ALL),
ftails AS (SELECT repo_id, report, path, ord, array_to_string(parts[i:], '/') AS tail FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
 FROM (SELECT *, [x FOR x IN string_split(path, '/') IF x <> ''] AS parts FROM files))),
owner AS (SELECT repo_id, report, tail, arg_min(path, ord) AS owner FROM ftails GROUP BY ALL),
wanted AS (SELECT DISTINCT repo_id, report, alert_file AS path FROM al),
exact AS (SELECT w.*, f.path AS hit FROM wanted w LEFT JOIN files f ON w.repo_id = f.repo_id AND w.report = f.report AND w.path = f.path),
atails AS (SELECT repo_id, report, path, array_to_string(parts[i:], '/') AS tail FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
 FROM (SELECT *, [x FOR x IN string_split(path, '/') IF x <> ''] AS parts FROM exact WHERE hit IS NULL))),
loose AS (SELECT a.repo_id, a.report, a.path, min(o.owner) AS low, max(o.owner) AS high FROM atails a JOIN owner o USING (repo_id, report, tail) GROUP BY ALL),
matched AS (SELECT repo_id, report, path, hit AS matched_file FROM exact WHERE hit IS NOT NULL
 UNION ALL SELECT repo_id, report, path, low FROM loose WHERE low = high),
af AS (SELECT al.*, m.matched_file FROM al LEFT JOIN matched m ON al.repo_id = m.repo_id AND al.report = m.report AND al.alert_file = m.path)"""


def reported_alerts(t: Tables):
    """Alerts with a report and a shortened path."""
    k, path = F.col("ord"), F.col("source_file")
    short = F.when(k % 4 == 0, path).when(k % 4 == 1, F.replace(path, F.lit("/work/"), F.lit(""))).otherwise(
        F.concat(F.lit("elsewhere/"), F.substring_index(path, "/", -1)))
    return t.kept_alerts.withColumns({"report": glue("=rep", k % 30, "=.plist"), "source_file": short})


@query("jn04_match_source", ["console_alerts", "report_index"], f"WITH {_matched} SELECT ord, alert_file AS source_file, matched_file FROM af")
def _(t: Tables):
    return M.match_source(reported_alerts(t), t.report_index).select("ord", "source_file", "matched_file")


_norm = r"""lower(regexp_replace(regexp_replace(regexp_replace(trim({c}), '\s*\[[^\]]+\]\s*$', ''), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'), '\s+', ' ', 'g'))"""


@query("jn05_match_diagnostic", ["console_alerts", "report_index", "diagnostics"], f"""
WITH {_matched},
dn AS (SELECT *, {_norm.format(c='description')} AS dmsg, regexp_matches(issue_context, '(?i)(^|[^A-Za-z0-9])(bad(Sink|Source)?|good(G2B|B2G)?)[0-9]*([^A-Za-z0-9]|$)') AS named FROM diagnostics),
an AS (SELECT *, {_norm.format(c='message')} AS amsg FROM af),
hits AS (SELECT an.ord, count(*) AS n, min(issue_context) AS context, min(issue_context_kind) AS kind FROM an JOIN dn ON an.repo_id = dn.repo_id
 AND an.report = dn.report AND an.line = dn.line AND (an.matched_file IS NULL OR an.matched_file = dn.source_file)
 AND (dmsg = amsg OR amsg = '' OR named) GROUP BY ALL)
SELECT af.ord, CASE WHEN n = 1 AND kind = 'function' THEN context ELSE '' END AS source_function,
 coalesce(n = 1, false) OR af.matched_file IS NOT NULL AS has_plist_match FROM af LEFT JOIN hits USING (ord)""")
def _(t: Tables):
    matched = M.match_source(reported_alerts(t), t.report_index)
    return M.match_diagnostic(matched, t.diagnostics).select("ord", "source_function", "has_plist_match")


@query("jn06_enclosing_function", ["parts", "spans"], """
WITH pl AS MATERIALIZED (SELECT row_number() OVER () AS n, file_path, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 30 + 1 AS INTEGER) AS line FROM parts),
sp AS MATERIALIZED (SELECT file_path, start_line, end_line, function_name FROM spans),
held AS MATERIALIZED (SELECT pl.n, sp.function_name FROM pl JOIN sp ON pl.file_path = sp.file_path WHERE pl.line BETWEEN sp.start_line AND sp.end_line)
SELECT pl.file_path, pl.l_linenumber, pl.l_partkey, pl.l_suppkey, pl.line, held.function_name AS enclosing_function
FROM pl LEFT JOIN held ON pl.n = held.n""")
def _(t: Tables):
    at = t.source_parts.select(
        *KEYS, "place.l_linenumber", "place.l_partkey", "place.l_suppkey", (F.col("place.l_partkey") % 30 + 1).cast("int").alias("line")
    )
    spans = X.function_spans(t.sources, KEYS).drop("function_code")
    return C.enclosing_function(at, spans, KEYS).drop("repo_id", "run_id")


@query("jn06_annotated_alerts", ["console_alerts", "report_index", "diagnostics"], f"""
WITH {_matched},
dn AS (SELECT *, {_norm.format(c='description')} AS dmsg, regexp_matches(issue_context, '(?i)(^|[^A-Za-z0-9])(bad(Sink|Source)?|good(G2B|B2G)?)[0-9]*([^A-Za-z0-9]|$)') AS named FROM diagnostics),
an AS (SELECT *, {_norm.format(c='message')} AS amsg FROM af),
hits AS (SELECT an.ord, count(*) AS n, min(issue_context) AS context, min(issue_context_kind) AS kind FROM an JOIN dn ON an.repo_id = dn.repo_id
 AND an.report = dn.report AND an.line = dn.line AND (an.matched_file IS NULL OR an.matched_file = dn.source_file)
 AND (dmsg = amsg OR amsg = '' OR named) GROUP BY ALL),
fn AS (SELECT af.ord, CASE WHEN n = 1 AND kind = 'function' THEN context ELSE '' END AS source_function FROM af LEFT JOIN hits USING (ord))
SELECT ord, source_function, CASE WHEN contains(source_function, 'bad') THEN 'bad' WHEN contains(source_function, 'good') THEN 'good'
 ELSE 'unknown' END AS ground_truth_status FROM fn""")
def _(t: Tables):
    matched = M.match_source(reported_alerts(t), t.report_index)
    found = M.match_diagnostic(matched, t.diagnostics)
    status, _ = text.ground_truth(F.col("source_function"), F.lit(""))
    return found.select("ord", "source_function", status.alias("ground_truth_status"))


@query("jn07_lookups", ["alerts"], """
SELECT ord, priority, label, CASE priority WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END AS priority_rank,
 CASE (label + 1) % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS next_priority FROM alerts""")
def _(t: Tables):
    return t.alerts.select(
        "ord", "priority", "label", A.priority_rank(F.col("priority")).alias("priority_rank"),
        A.priority_of((F.col("label") + 1) % 3).alias("next_priority"),
    )


@query("jn08_assign_split", [], """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + v THEN 'valid' ELSE 'train' END AS split
FROM lineitem JOIN (SELECT *, CAST(ceil((g - t) * 0.25) AS BIGINT) AS v FROM (SELECT *, CAST(ceil(g * 0.2) AS BIGINT) AS t FROM (
 SELECT l_orderkey, row_number() OVER (ORDER BY md5(l_orderkey || '|7')) AS rk, count(*) OVER () AS g FROM (SELECT DISTINCT l_orderkey FROM lineitem))))
 USING (l_orderkey)""")
def _(t: Tables):
    rows = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return S.assign_split(rows, S.group_splits(rows, "l_orderkey", 7), "l_orderkey")


@query("jn09_unseen_runs", ["metrics"], """
SELECT repo_id, run_id, total_alerts FROM metrics WHERE CAST(substr(run_id, 9, 2) AS INTEGER) > 10""")
def _(t: Tables):
    rows = t.metrics.select("repo_id", "run_id", "total_alerts")
    seen = rows.filter(F.substring("run_id", 9, 2).cast("int") <= 10)
    return K.new_runs(seen, rows.unionByName(rows))


@query("jn10_nearest_neighbours", [], f"""
WITH v AS (SELECT CAST(label AS VARCHAR) AS repo_id, lpad(CAST(vec_id AS VARCHAR), 9, '0') AS point, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
w AS (SELECT repo_id, x, min(point) AS point, count(*) AS weight FROM v GROUP BY ALL),
d AS (SELECT a.repo_id, a.point, b.point AS neighbour, b.weight - CAST(a.point = b.point AS INTEGER) AS weight,
 round(list_distance(a.x, b.x), 9) AS distance FROM w a JOIN w b USING (repo_id)),
o AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY repo_id, point ORDER BY distance, neighbour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
 FROM d WHERE weight > 0)
SELECT repo_id, point, neighbour, {r('distance', 6)} AS distance, CAST(least(weight, 10 - b) AS BIGINT) AS weight FROM o WHERE b < 10""")
def _(t: Tables):
    from gatewright.functions.numbers import round_half_up

    rows = t.read("embeddings").select(
        F.col("label").cast("string").alias("repo_id"), F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("run_id"),
        *[F.col("embedding")[i].alias(f"x{i}") for i in range(64)],
    )
    near = knn(weighted_points(rows, [f"x{i}" for i in range(64)]), 10)
    return near.withColumn("distance", round_half_up(F.col("distance"), 6))


@query("jn11_run_facts", ["alerts", "shifted"], """
WITH a AS (SELECT repo_id, run_id, count(*) FILTER (priority = 'HIGH') AS alert_high_count, count(*) FILTER (priority = 'MEDIUM') AS alert_medium_count,
 count(*) FILTER (priority = 'LOW') AS alert_low_count FROM alerts GROUP BY ALL),
c AS (SELECT repo_id, run_id, count(*) FILTER (risk_level = 'HIGH') AS commit_high_count, count(*) FILTER (risk_level = 'REVIEW_REQUIRED') AS commit_review_required_count,
 count(*) FILTER (risk_level = 'MEDIUM') AS commit_medium_count, count(*) FILTER (risk_level = 'LOW') AS commit_low_count FROM shifted GROUP BY ALL)
SELECT repo_id, run_id, coalesce(alert_high_count, 0) AS alert_high_count, coalesce(alert_medium_count, 0) AS alert_medium_count,
 coalesce(alert_low_count, 0) AS alert_low_count, coalesce(commit_high_count, 0) AS commit_high_count,
 coalesce(commit_review_required_count, 0) AS commit_review_required_count, coalesce(commit_medium_count, 0) AS commit_medium_count,
 coalesce(commit_low_count, 0) AS commit_low_count, 'NOT_AVAILABLE' AS anomaly_status, 'ML3 anomaly report not available' AS anomaly_reason
FROM a FULL JOIN c USING (repo_id, run_id)""")
def _(t: Tables):
    """Runs with alerts, with functions, or with both."""
    spine = t.runs.unionByName(t.shifted_risks.select("repo_id", "run_id").distinct())
    return R.run_facts(spine, t.alerts, t.shifted_risks).drop("anomaly_score")
