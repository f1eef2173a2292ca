"""The mappings of ``tables.py`` and the operators built on them as SQL text for the side-by-side check."""

from __future__ import annotations

from gatewright import params as P
from gatewright.plans.tables import FAMILY_OF_PRIORITY, WORDS_OF_PART


def r(expression: str, digits: int) -> str:
    """Half-up rounding as in the Spark functions."""
    scale = f"CAST(1e{digits} AS DOUBLE)"
    return f"(floor(CAST({expression} AS DOUBLE) * {scale} + CAST(0.5 AS DOUBLE)) / {scale})"


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def flag(text: str, terms: list[str]) -> str:
    tests = " OR ".join(f"contains(lower(coalesce({text}, '')), '{t}')" for t in terms)
    return f"CAST(({tests}) AS INTEGER)"


def severity_score(c: str, table: dict[str, int]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CASE lower({c}) {whens} ELSE 0 END"


def has_value(c: str) -> str:
    return f"CAST(lower(trim(coalesce(CAST({c} AS VARCHAR), ''))) NOT IN ({listed(P.BLANK_WORDS)}) AS INTEGER)"


def unit(*parts: str) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({joined}), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def risk_columns(p: str) -> str:
    return f"""{r(f'{p} * 100', 2)} AS risk_score, {r(f'abs({p} - 0.5) * 2', 4)} AS confidence"""


LEVEL = """CASE WHEN confidence < CAST(0.2 AS DOUBLE) AND risk_score < 70 THEN 'REVIEW_REQUIRED' WHEN risk_score >= 70 THEN 'HIGH'
 WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"""


def file_of(key: str) -> str:
    return f"'src/mod' || (user_id % 7) || '/unit' || ({key} % 13) || '.c'"


_family = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY_OF_PRIORITY.items())
_case_families = [*P.HIGH_FAMILIES, P.MEDIUM_FAMILY, "CWE78_OS_Command_Injection", "support"]
_n = "l_linenumber || '_' || l_partkey || '_' || l_suppkey"
CONSOLE = r"(.+?):([0-9]+):[0-9]+:\s+(warning|error|note):\s+(.+)"
_kind = "CAST(l_quantity AS INTEGER) % 4"

# name -> (views it reads, text)
VIEWS: dict[str, tuple[list[str], str]] = {
    "alerts": ([], f"""
SELECT *, CASE priority WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 END AS label FROM (
 SELECT *, CASE WHEN NOT actionable THEN 'LOW' WHEN severity IN ('error', 'critical') THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM (
  SELECT CAST(user_id AS VARCHAR) AS repo_id, strftime(ts, '%Y-%m-%d') AS run_id, event_id AS ord,
   CASE WHEN event_id % 2 = 1 THEN 'clang' ELSE 'cppcheck' END AS tool, CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END AS tool_order,
   {file_of('event_id')} AS file, CASE WHEN event_id % 10 <> 9 THEN event_id % 400 + 1 END AS line, event_type AS alert_id,
   CASE event_type WHEN 'error' THEN '476' WHEN 'click' THEN '' END AS cwe,
   CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'style'
    WHEN 'click' THEN 'information' ELSE 'none' END AS severity,
   event_type || ' ' || props AS message, event_type <> 'view' AS actionable
  FROM events))"""),
    "risks": ([], f"""
SELECT *, {LEVEL} AS risk_level FROM (SELECT *, {risk_columns('probability')} FROM (
 SELECT CAST(user_id AS VARCHAR) AS repo_id, strftime(ts, '%Y-%m-%d') AS run_id, event_id AS ord,
  {file_of('event_id')} AS file_path, least(value / CAST(500 AS DOUBLE), CAST(1 AS DOUBLE)) AS probability FROM events))"""),
    "shifted": (["risks"], """
SELECT * REPLACE (CASE WHEN CAST(substr(run_id, 9, 2) AS INTEGER) % 3 = 0 THEN run_id || ' apart' ELSE run_id END AS run_id) FROM risks"""),
    "runs": (["alerts"], "SELECT DISTINCT repo_id, run_id FROM alerts"),
    "metrics": (["alerts", "risks", "runs"], f"""
SELECT repo_id, run_id, total_files_scanned, high_alerts + medium_alerts + low_alerts AS total_alerts, high_alerts, medium_alerts,
 low_alerts, high_commit_risk, medium_commit_risk, low_commit_risk,
 {r('(high_alerts + medium_alerts + low_alerts) / CAST(total_files_scanned AS DOUBLE)', 2)} AS alerts_per_file
FROM runs JOIN (SELECT repo_id, run_id, count(*) FILTER (priority = 'HIGH') AS high_alerts,
  count(*) FILTER (priority = 'MEDIUM') AS medium_alerts, count(*) FILTER (priority = 'LOW') AS low_alerts FROM alerts GROUP BY ALL)
 USING (repo_id, run_id)
JOIN (SELECT repo_id, run_id, count(*) FILTER (risk_level = 'HIGH') AS high_commit_risk,
  count(*) FILTER (risk_level = 'MEDIUM') AS medium_commit_risk, count(*) FILTER (risk_level = 'LOW') AS low_commit_risk,
  count(DISTINCT file_path) AS total_files_scanned FROM risks GROUP BY ALL) USING (repo_id, run_id)"""),
    "history": (["metrics"], """
SELECT *, d * 86400 AS ts, CASE WHEN (u * 31 + d) % 19 = 0 THEN ' missing ' ELSE 'OK' END AS commit_risk_status,
 CASE WHEN (u * 7 + d) % 23 = 0 THEN 'Malformed' ELSE 'OK' END AS commit_summary_status,
 CASE WHEN (u * 11 + d) % 29 = 0 THEN 'SCHEMA_MISMATCH' ELSE 'OK' END AS cppcheck_status,
 CASE WHEN (u + d) % 5 = 0 THEN 'NOT_APPLICABLE' ELSE 'OK' END AS clang_status,
 CASE WHEN (u + d) % 31 = 0 THEN 'True' WHEN (u + d) % 37 = 0 THEN 'yes' ELSE 'False' END AS ml3_scoring_blocked,
 CASE WHEN (u * 3 + d) % 41 = 0 THEN 'failed' ELSE 'NORMAL' END AS ml3_outcome
FROM (SELECT *, CAST(repo_id AS BIGINT) AS u, CAST(substr(run_id, 9, 2) AS BIGINT) AS d FROM metrics)"""),
    "flags": (["history"], """
SELECT *, ml3_scoring_blocked IN ('True', 'yes') AS x_blocked, commit_risk_status = ' missing ' AS x_risk,
 commit_summary_status = 'Malformed' AS x_summary, cppcheck_status = 'SCHEMA_MISMATCH' AS x_cppcheck,
 ml3_outcome = 'failed' AS x_failed FROM history"""),
    "valid": (["flags"], "SELECT * FROM flags WHERE NOT (x_blocked OR x_risk OR x_summary OR x_cppcheck OR x_failed)"),
    "console": ([], f"""
SELECT CAST(o_custkey % 20 AS VARCHAR) AS repo_id, o_orderkey AS ord,
 CASE WHEN o_orderkey % 11 = 0 THEN '2 warnings generated.' ELSE
  '/work/testcases/' || family || '/s0' || (o_orderkey % 9) || '/' || family || '__case_' || (o_custkey % 40) ||
  CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN '_bad' ELSE '_goodG2B' END || CASE WHEN o_orderkey % 2 = 0 THEN '.c' ELSE '.cpp' END
  || ':' || (o_orderkey % 97 + 1) || ':5: ' || CASE o_orderstatus WHEN 'F' THEN 'warning' WHEN 'O' THEN 'error' ELSE 'note' END
  || ': ' || CASE o_orderkey % 4 WHEN 0 THEN 'Dereference of null pointer: value is null [core.NullDereference]'
   WHEN 1 THEN '  Memory is never released; potential leak [unix.Malloc]' WHEN 2 THEN 'Use of memory after it is freed'
   ELSE '...' END END AS value,
 (o_orderkey % 50) || '_' || family || '_x.c.txt' AS file_name
FROM (SELECT *, CASE o_orderpriority {_family} END AS family FROM orders)"""),
    "console_alerts": (["console"], rf"""
SELECT repo_id, ord, 'clang' AS tool, m1 AS source_file, CAST(m2 AS INTEGER) AS line,
 substr(split_part(trim(m4), ':', 1), 1, 60) AS alert_id, regexp_extract(file_name, 'CWE([0-9]+)', 1) AS cwe, m3 AS severity,
 trim(m4) AS message, file_name AS raw_report_path
FROM (SELECT *, {', '.join(f"regexp_extract(value, '{CONSOLE}', {i}) AS m{i}" for i in (1, 2, 3, 4))} FROM console)
WHERE regexp_matches(value, '{CONSOLE}') AND m3 <> 'note'"""),
    "report_index": (["console_alerts"], r"""
SELECT repo_id, 'rep' || (ord % 30) || '.plist' AS report, ord, CASE ord % 5 WHEN 0 THEN source_file WHEN 1 THEN '/build' || source_file
 WHEN 2 THEN replace(source_file, '/work/testcases/', '') WHEN 3 THEN replace(source_file, '/', '\')
 ELSE ' other/' || split_part(source_file, '/', -1) END AS source_file FROM console_alerts WHERE ord % 7 < 2"""),
    "diagnostics": (["console_alerts"], """
SELECT repo_id, 'rep' || (ord % 30) || '.plist' AS report, line, source_file,
 CASE WHEN ord % 2 = 0 THEN upper(message) ELSE 'another finding' END AS description,
 CASE ord % 3 WHEN 0 THEN 'CWE_bad' WHEN 1 THEN 'goodG2B1' ELSE 'helper' END AS issue_context,
 CASE WHEN ord % 8 = 5 THEN 'block' ELSE 'function' END AS issue_context_kind FROM console_alerts WHERE ord % 6 <> 1"""),
    "parts": ([], f"""
SELECT *, coalesce(sum(n_lines) OVER (PARTITION BY file_path ORDER BY l_linenumber, l_partkey, l_suppkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS first_line FROM (
 SELECT *, CAST(l_orderkey % 50 AS VARCHAR) AS repo_id, 'r1' AS run_id, 'src/o' || l_orderkey || '.cpp' AS file_path,
  {_kind} AS kind, CASE {_kind} WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 2 ELSE 3 END AS n_lines,
  CASE {_kind} WHEN 0 THEN 'f_' || {_n} WHEN 1 THEN 'C' || l_suppkey || '::run_' || {_n} END AS function_name,
  CASE {_kind} WHEN 0 THEN 'static int f_' || {_n} || '(int a) {{' || chr(10) || '    return a;' || chr(10) || '}}'
   WHEN 1 THEN 'void C' || l_suppkey || '::run_' || {_n} || '(char *p)' || chr(10) || '{{' || chr(10) || '    if (p) {{' || chr(10)
    || '        free(p);' || chr(10) || '    }}' || chr(10) || '}}'
   WHEN 2 THEN '#define X_' || {_n} || ' 1' || chr(10) || 'int v_' || {_n} || ' = 1;'
   ELSE 'struct s_' || {_n} || ' {{' || chr(10) || '    int a;' || chr(10) || '}};' END || chr(10) AS piece
 FROM lineitem)"""),
    "spans": (["parts"], """
SELECT repo_id, run_id, file_path, function_name, CAST(first_line AS INTEGER) AS start_line,
 CAST(first_line + n_lines - 1 AS INTEGER) AS end_line, rtrim(piece, chr(10)) AS function_code FROM parts WHERE kind < 2"""),
    "sources": (["parts"], """
SELECT repo_id, run_id, file_path, string_agg(piece, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS content,
 CAST(sum(n_lines) AS INTEGER) AS n_lines FROM parts GROUP BY ALL"""),
    "lines": (["parts"], """
SELECT DISTINCT repo_id, run_id, file_path, CAST(line AS INTEGER) AS line FROM (
 SELECT repo_id, run_id, file_path, unnest(range(l_partkey % 20 + 1, l_partkey % 20 + 1 + CAST(l_quantity AS INTEGER) % 3)) AS line
 FROM parts WHERE l_linenumber <= 3)"""),
    "touched": (["spans", "lines"], """
SELECT * FROM spans s WHERE EXISTS (SELECT 1 FROM lines l WHERE l.file_path = s.file_path AND l.line BETWEEN s.start_line AND s.end_line)"""),
    "case_files": ([], f"""
SELECT DISTINCT 'C/testcases/' || family || '/s01/' || family || '__t_' || l_orderkey || 'xy' ||
 CASE l_partkey % 3 WHEN 0 THEN '_bad' WHEN 1 THEN '_goodG2B' ELSE '_12b' END || '.c' AS source_file
FROM (SELECT *, ([{listed(_case_families)}])[l_linenumber % 7 + 1] AS family FROM lineitem)"""),
    "labelled": ([], """
SELECT doc_id, CASE WHEN b < 154 THEN 'train' WHEN b < 205 THEN 'valid' ELSE 'test' END AS split, text AS function_code,
 quality AS target, source, toxic FROM (SELECT *, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2)) AS INTEGER) AS b
 FROM documents JOIN labels USING (doc_id))"""),
    "messages": ([], f"""
SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity * 100) AS BIGINT),
 CAST(round(l_extendedprice * 100) AS BIGINT)) AS ord,
 CASE WHEN l_suppkey % 5 = 0 THEN 'CppCheck 2.1' ELSE 'other' END AS "toolName", 'src/f' || (l_orderkey % 500) || '.c' AS "filePath",
 CASE WHEN l_partkey % 9 = 0 THEN 'n/a' ELSE CAST(l_partkey % 300 AS VARCHAR) END AS "lineNumber",
 'id' || (l_suppkey % 12) AS "warningType",
 CASE WHEN l_linenumber = 1 THEN 'nan' WHEN l_linenumber < 5 THEN CAST(l_linenumber + 118 AS VARCHAR) END AS cwe,
 CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'Warning' ELSE 'style' END AS "warningSeverity",
 'Possible ' || ([{listed(WORDS_OF_PART)}])[l_partkey % {len(WORDS_OF_PART)} + 1] || ' in item ' || (l_partkey % 40) AS "warningMessage",
 l_linestatus = 'F' AS actionable FROM lineitem"""),
    "training": (["messages"], f"""
SELECT *, CASE priority WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS label,
 {severity_score('severity', P.SEVERITY_SCORES_CPPCHECK)} AS severity_score, {has_value('cwe')} AS has_cwe,
 {', '.join(f"{flag('message', terms)} AS {name}" for name, terms in P.KEYWORDS_CPPCHECK.items())},
 CAST(contains(lower(tool), 'cppcheck') AS INTEGER) AS is_cppcheck FROM (
 SELECT ord, "toolName" AS tool, "filePath" AS file, TRY_CAST("lineNumber" AS DOUBLE) AS line, "warningType" AS alert_id, cwe,
  "warningSeverity" AS severity, "warningMessage" AS message, CAST(actionable AS INTEGER) AS is_actionable,
  CASE WHEN NOT actionable THEN 'LOW' WHEN lower("warningSeverity") IN ('error', 'critical') THEN 'HIGH' ELSE 'MEDIUM' END AS priority
 FROM messages)"""),
}


def sql(needs: list[str], body: str) -> str:
    """``body`` with the named views, and what they read, in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for inner in VIEWS[name][0]:
            visit(inner)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    head = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    if not head:
        return body
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
