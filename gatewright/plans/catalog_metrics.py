"""Aggregations, metrics, windows and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions import paths
from gatewright.functions.numbers import round_half_up
from gatewright.operators import evaluation as E
from gatewright.operators import history as H
from gatewright.operators import rows as O
from gatewright.operators import runs as R
from gatewright.operators import splits as S
from gatewright.operators.ranking import top_per_group
from gatewright.plans.catalog_tables import TRAINING, flagged, training_rows
from gatewright.plans.registry import query
from gatewright.plans.tables import Tables, glue
from gatewright.plans.views import r

LABELS = P.LABELS


# ---- run rollups -------------------------------------------------------------------------------------------------
@query("ag01_level_counts", ["alerts"], """
SELECT repo_id, run_id, count(*) FILTER (priority = 'HIGH') AS high_alerts, count(*) FILTER (priority = 'MEDIUM') AS medium_alerts,
 count(*) FILTER (priority = 'LOW') AS low_alerts FROM alerts GROUP BY ALL""")
def _(t: Tables):
    return R.level_counts(t.alerts, "priority", ["HIGH", "MEDIUM", "LOW"], "", "_alerts")


@query("ag02_commit_summary", ["alerts", "risks", "runs", "shifted"], """
WITH f AS (SELECT repo_id, run_id, count(DISTINCT file_path) AS total_changed_files FROM risks GROUP BY ALL),
s AS (SELECT repo_id, run_id FROM runs UNION SELECT repo_id, run_id FROM shifted UNION SELECT repo_id, run_id || ' later' FROM runs),
c AS (SELECT repo_id, run_id, count(*) AS total_changed_functions, count(*) FILTER (risk_level = 'HIGH') AS high_risk_functions,
 count(*) FILTER (risk_level = 'REVIEW_REQUIRED') AS review_required_functions, count(*) FILTER (risk_level = 'MEDIUM') AS medium_risk_functions,
 count(*) FILTER (risk_level = 'LOW') AS low_risk_functions, max(risk_score) AS max_risk_score FROM shifted GROUP BY ALL),
j AS (SELECT repo_id, run_id, coalesce(total_changed_files, 0) AS total_changed_files, coalesce(total_changed_functions, 0) AS total_changed_functions,
 coalesce(high_risk_functions, 0) AS high_risk_functions, coalesce(review_required_functions, 0) AS review_required_functions,
 coalesce(medium_risk_functions, 0) AS medium_risk_functions, coalesce(low_risk_functions, 0) AS low_risk_functions,
 coalesce(max_risk_score, CAST(0 AS DOUBLE)) AS max_risk_score FROM s LEFT JOIN f USING (repo_id, run_id) LEFT JOIN c USING (repo_id, run_id))
SELECT *, CASE WHEN high_risk_functions > 0 THEN 'HIGH' WHEN review_required_functions > 0 THEN 'REVIEW_REQUIRED' WHEN medium_risk_functions > 0 THEN 'MEDIUM'
 WHEN low_risk_functions > 0 THEN 'LOW' ELSE 'SKIPPED' END AS commit_risk_level,
 CASE WHEN total_changed_files > 0 AND total_changed_functions > 0 THEN 'COMPLETED' ELSE 'SKIPPED' END AS status,
 CASE WHEN total_changed_files = 0 THEN 'No changed C/C++ files detected in the resolved diff range.'
 WHEN total_changed_functions = 0 THEN 'Changed C/C++ files were found, but no analyzable functions were extracted.'
 ELSE 'Prediction completed successfully.' END AS reason FROM j""")
def _(t: Tables):
    """Runs with files and functions, with either, and with neither."""
    files = t.risks.select("repo_id", "run_id", "file_path").distinct()
    later = t.runs.withColumn("run_id", F.concat("run_id", F.lit(" later")))
    spine = t.runs.unionByName(t.shifted_risks.select("repo_id", "run_id").distinct()).unionByName(later)
    return R.commit_summary(spine, files, t.shifted_risks)


@query("ag03_run_metrics", ["metrics"], "SELECT * FROM metrics")
def _(t: Tables):
    return t.metrics


# ---- distributions -----------------------------------------------------------------------------------------------
@query("ag04_class_distribution", [], f"""
WITH f AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem),
g AS (SELECT l_linenumber, unnest([0, 1, 2]) AS label FROM (SELECT DISTINCT l_linenumber FROM lineitem)),
c AS (SELECT l_linenumber, label, count(*) AS n FROM f GROUP BY ALL)
SELECT l_linenumber, label, coalesce(n, 0) AS count,
 {r('coalesce(n, 0) / CAST(sum(n) OVER (PARTITION BY l_linenumber) AS DOUBLE)', 6)} AS percent FROM g LEFT JOIN c USING (l_linenumber, label)""")
def _(t: Tables):
    return E.class_distribution(flagged(t), ["l_linenumber"])


_share = "(floor(CAST(n{x} AS DOUBLE) / (n0 + n1 + n2) * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE))"


@query("ag05_split_divergence", [], f"""
WITH f AS (SELECT l_linenumber % 3 AS split, l_suppkey % 4 AS part, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem),
c AS (SELECT part, split, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 2) AS n2 FROM f GROUP BY ALL),
p AS (SELECT part, split, {', '.join(_share.format(x=x) + f' AS p{x}' for x in LABELS)} FROM c),
w AS (SELECT part, {', '.join(_share.format(x=x) + f' AS q{x}' for x in LABELS)} FROM (SELECT part, sum(n0) AS n0, sum(n1) AS n1, sum(n2) AS n2 FROM c GROUP BY ALL))
SELECT part, {r('sum(abs(q0 - p0) + abs(q1 - p1) + abs(q2 - p2))', 6)} AS divergence FROM p JOIN w USING (part) GROUP BY part""")
def _(t: Tables):
    rows = flagged(t).withColumns({"split": F.col("l_linenumber") % 3, "part": F.col("l_suppkey") % 4})
    return E.split_divergence(rows, ["part"])


@query("ag06_coverage_stats", ["alerts"], """
SELECT tool, count(*) AS rows, count(DISTINCT file) AS distinct_file, count(DISTINCT alert_id) AS distinct_alert_id,
 count(DISTINCT repo_id) AS distinct_repo_id FROM alerts GROUP BY ALL""")
def _(t: Tables):
    return E.coverage_stats(t.alerts, ["file", "alert_id", "repo_id"], ["tool"])


_case = r"regexp_replace(regexp_replace(split_part(source_file, '/', -1), '\.[^.]+$', ''), '([0-9])[a-e]$', '\1')"


@query("ag07_annotation_stats", ["console_alerts"], f"""
SELECT count(*) FILTER (ord % 3 < 2) AS alerts_with_plist_match, count(*) FILTER (ord % 3 = 2) AS alerts_without_plist_match,
 count(*) FILTER (ord % 3 = 0) AS alerts_with_source_function, count(*) FILTER (ord % 3 = 0) AS alerts_classified_from_source_function,
 count(*) FILTER (ord % 3 = 1) AS alerts_classified_from_enclosing_source_function, count(*) FILTER (ord % 3 = 0) AS bad_count,
 count(*) FILTER (ord % 3 = 1) AS good_count, count(*) FILTER (ord % 3 = 2) AS unknown_count,
 count(DISTINCT regexp_replace(split_part(source_file, '/', -1), '\\.[^.]+$', '')) AS unique_case_ids_before_corrected_normalization,
 count(DISTINCT {_case}) AS unique_case_ids_after_corrected_normalization FROM console_alerts""".replace("\\\\", "\\"))
def _(t: Tables):
    k = F.col("ord") % 3
    rows = t.console_alerts.withColumns({
        "has_plist_match": k < 2, "source_function": F.when(k == 0, "x_bad").otherwise(""),
        "ground_truth_origin": F.when(k == 0, "plist_source_function").when(k == 1, "enclosing_function").otherwise("unknown"),
        "ground_truth_status": F.when(k == 0, "bad").when(k == 1, "good").otherwise("unknown"),
        "juliet_case_id": paths.case_id(paths.stem(F.col("source_file"))),
    })
    return E.annotation_stats(rows)


@query("ag08_value_counts", ["messages"], "SELECT cwe, count(*) AS n FROM messages GROUP BY ALL")
def _(t: Tables):
    return E.value_counts(t.messages, "cwe")


# ---- classifier metrics ------------------------------------------------------------------------------------------
PREDICTED = """p AS (SELECT 'm' || (l_suppkey % 4) AS model, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
 CAST(CASE WHEN l_suppkey % 4 = 3 THEN l_linenumber % 2 WHEN (l_partkey + l_linenumber) % 3 = 0 THEN CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
 ELSE l_partkey % 3 END AS INTEGER) AS prediction, l_returnflag = 'R' AS pos, CAST(l_quantity AS INTEGER) % 10 + CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS s FROM lineitem)"""
CELLS = "c AS (SELECT model, " + ", ".join(
    f"count(*) FILTER (label = {a} AND prediction = {b}) AS c{a}{b}" for a in LABELS for b in LABELS) + " FROM p GROUP BY ALL)"


def _said(x: int) -> str:
    return "(" + " + ".join(f"c{a}{x}" for a in LABELS) + ")"


def _real(x: int) -> str:
    return "(" + " + ".join(f"c{x}{b}" for b in LABELS) + ")"


def _safe(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN CAST(0 AS DOUBLE) ELSE {a} / CAST({b} AS DOUBLE) END"


SCORES = "s AS (SELECT *, " + ", ".join(
    f"{_safe(f'c{x}{x}', _said(x))} AS precision_{x}, {_safe(f'c{x}{x}', _real(x))} AS recall_{x}, "
    f"{_safe(f'2 * c{x}{x}', f'({_said(x)} + {_real(x)})')} AS f1_{x}, {_real(x)} AS support_{x}, {_said(x)} AS predicted_{x}" for x in LABELS
) + " FROM c)"


def predicted(t: Tables):
    label = F.col("label")
    pred = F.when(F.col("l_suppkey") % 4 == 3, F.col("l_linenumber") % 2).when(
        (F.col("l_partkey") + F.col("l_linenumber")) % 3 == 0, label).otherwise(F.col("l_partkey") % 3)
    rows = flagged(t).select(glue("=m", F.col("l_suppkey") % 4).alias("model"), "label", pred.cast("int").alias("prediction"),
                             (F.col("l_returnflag") == "R").cast("int").alias("pos"),
                             (F.col("l_quantity").cast("int") % 10 + F.when(F.col("l_returnflag") == "R", 2).otherwise(0)).alias("s"))
    return rows


@query("ag09_confusion", [], f"WITH {PREDICTED}, {CELLS} SELECT * FROM c")
def _(t: Tables):
    return E.confusion(predicted(t), ["model"], LABELS)


@query("ag10_class_scores", [], f"""WITH {PREDICTED}, {CELLS}, {SCORES} SELECT model, """ + ", ".join(
    f"{r(f'{m}_{x}', 6)} AS {m}_{x}" for x in LABELS for m in ("precision", "recall", "f1")) + ", " + ", ".join(f"support_{x}" for x in LABELS) + " FROM s")
def _(t: Tables):
    s = E.class_scores(E.confusion(predicted(t), ["model"], LABELS), ["model"], LABELS)
    return s.select("model", *[round_half_up(F.col(f"{m}_{x}"), 6).alias(f"{m}_{x}") for x in LABELS for m in ("precision", "recall", "f1")],
                    *[f"support_{x}" for x in LABELS])


@query("ag11_multi_metrics", [], f"""WITH {PREDICTED}, {CELLS}, {SCORES},
u AS (SELECT *, support_0 + support_1 + support_2 AS n, (CAST(support_0 + predicted_0 > 0 AS INTEGER) + CAST(support_1 + predicted_1 > 0 AS INTEGER)
 + CAST(support_2 + predicted_2 > 0 AS INTEGER)) AS used FROM s)
SELECT model, {r('(c00 + c11 + c22) / CAST(n AS DOUBLE)', 6)} AS accuracy, {r('(f1_0 + f1_1 + f1_2) / used', 6)} AS macro_f1,
 {r('(f1_0 * support_0 + f1_1 * support_1 + f1_2 * support_2) / n', 6)} AS weighted_f1, {r('recall_2', 6)} AS high_recall FROM u""")
def _(t: Tables):
    names = ["accuracy", "macro_f1", "weighted_f1", "high_recall"]
    return E.multi_metrics(predicted(t), ["model"]).select("model", *[round_half_up(F.col(c), 6).alias(c) for c in names])


@query("ag12_roc_auc", [], f"""WITH {PREDICTED},
k AS (SELECT model, pos, avg(rn) OVER (PARTITION BY model, s) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY s) AS rn FROM p)),
a AS (SELECT model, sum(rk) FILTER (pos) AS rs, CAST(count(*) FILTER (pos) AS DOUBLE) AS np, CAST(count(*) FILTER (NOT pos) AS DOUBLE) AS nn FROM k GROUP BY ALL)
SELECT model, {r('(rs - np * (np + 1) / 2) / (np * nn)', 6)} AS roc_auc FROM a""")
def _(t: Tables):
    auc = E.roc_auc(predicted(t), ["model"], truth="pos", score="s")
    return auc.withColumn("roc_auc", round_half_up(F.col("roc_auc"), 6))


@query("ag13_average_precision", [], f"""WITH {PREDICTED},
k AS (SELECT model, s, count(*) FILTER (pos) AS tp, count(*) AS n FROM p GROUP BY ALL),
w AS (SELECT model, tp, CAST(sum(tp) OVER o AS DOUBLE) / sum(n) OVER o AS prec, CAST(tp AS DOUBLE) / sum(tp) OVER (PARTITION BY model) AS gain FROM k
 WINDOW o AS (PARTITION BY model ORDER BY s DESC))
SELECT model, {r('sum(gain * prec)', 6)} AS average_precision FROM w GROUP BY ALL""")
def _(t: Tables):
    ap = E.average_precision(predicted(t), ["model"], truth="pos", score="s")
    return ap.withColumn("average_precision", round_half_up(F.col("average_precision"), 6))


@query("ag14_detector_metrics", ["history"], f"""
SELECT repo_id, tn, fp, fn, tp, {r(_safe('fp', '(fp + tn)'), 6)} AS false_positive_rate, normal_count, anomaly_count,
 {r('anomaly_count / CAST(normal_count + anomaly_count AS DOUBLE)', 4)} AS anomaly_rate, {r('lo', 4)} AS score_min, {r('hi', 4)} AS score_max FROM (
SELECT repo_id, count(*) FILTER (NOT y AND NOT a) AS tn, count(*) FILTER (NOT y AND a) AS fp, count(*) FILTER (y AND NOT a) AS fn, count(*) FILTER (y AND a) AS tp,
 count(*) FILTER (NOT a) AS normal_count, count(*) FILTER (a) AS anomaly_count, min(alerts_per_file) AS lo, max(alerts_per_file) AS hi
FROM (SELECT *, total_alerts > 3 AS a, d % 4 = 0 AS y FROM history) GROUP BY ALL)""")
def _(t: Tables):
    d = F.substring("run_id", 9, 2).cast("int")
    anomalous = F.col("total_alerts") > 3
    rows = t.history.select("repo_id", (d % 4 == 0).cast("int").alias("label"), anomalous.cast("int").alias("prediction"),
                            F.when(anomalous, -1).otherwise(1).alias("verdict"), "alerts_per_file")
    counts = E.binary_metrics(rows, ["repo_id"]).select("repo_id", "tn", "fp", "fn", "tp", round_half_up(F.col("false_positive_rate"), 6).alias("false_positive_rate"))
    return counts.join(E.score_range(rows, ["repo_id"], "verdict", "alerts_per_file"), "repo_id")


@query("ag15_time_range", ["history"], "SELECT repo_id, min(ts) AS history_timestamp_min, max(ts) AS history_timestamp_max FROM history GROUP BY ALL")
def _(t: Tables):
    return H.time_range(t.history)


_hash = "md5(concat_ws('|', run_id, " + ", ".join(f"CAST({c} AS VARCHAR)" for c in P.ANOMALY_FEATURES if c != "alerts_per_file") + "))"


@query("ag16_dataset_fingerprint", ["history"], f"""
SELECT repo_id, n AS rows, sha256(n || ':' || a || ':' || b) AS fingerprint FROM (SELECT repo_id, count(*) AS n,
 sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS b FROM (SELECT *, {_hash} AS h FROM history) GROUP BY ALL)""")
def _(t: Tables):
    columns = [c for c in P.ANOMALY_FEATURES if c != "alerts_per_file"]
    return H.dataset_fingerprint(t.history, columns, "run_id", ["repo_id"])


@query("ag17_history_size", ["metrics"], "SELECT count(*) AS history_rows, 0 AS absent_rows FROM metrics")
def _(t: Tables):
    from gatewright.session import scratch_dir
    from gatewright.sources import sinks as K

    path = scratch_dir(t.spark, "size")
    t.metrics.write.parquet(path)
    n, absent = K.history_size(t.spark, path), K.history_size(t.spark, path + "-absent")
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("history_rows")).filter(F.col("history_rows") == n).withColumn(
        "absent_rows", F.lit(absent))


# ---- windows and ordering ----------------------------------------------------------------------------------------
@query("win01_dedup_texts", [], """
SELECT text, doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def _(t: Tables):
    rows = t.read("documents").select("text", "doc_id", "lang", "source", F.col("doc_id").alias("ord"))
    return O.dedup_first(rows, ["text"]).drop("ord")


@query("win01_dedup_alerts", ["training"], f"""
SELECT {TRAINING} FROM training QUALIFY row_number() OVER (PARTITION BY {', '.join(P.ALERT_KEY_CPPCHECK)} ORDER BY ord) = 1""")
def _(t: Tables):
    return O.dedup_first(training_rows(t), P.ALERT_KEY_CPPCHECK)


def _digest(view: str, column: str, text: str, levels: list[str], prefix: str, order: str) -> str:
    columns = ", ".join(f"coalesce(string_agg(txt, ' ; ' ORDER BY rn) FILTER ({column} = '{x}'), '') AS {prefix}{x.lower()}_issues" for x in levels)
    inside = f"SELECT *, row_number() OVER (PARTITION BY repo_id, run_id, {column} ORDER BY {order}) AS rn, {text} AS txt FROM {view}"
    return f"SELECT repo_id, run_id, {columns} FROM ({inside}) WHERE rn <= 5 GROUP BY ALL"


ALERT_TEXT = "tool || ' | ' || alert_id || ' | ' || file || CASE WHEN line IS NULL THEN '' ELSE ':' || line END || ' | ' || message"
COMMIT_TEXT = "'commit-risk | ' || file_path || ' | risk score: ' || CAST(risk_score AS VARCHAR)"
ALERT_DIGEST = _digest("alerts", "priority", ALERT_TEXT, ["HIGH", "MEDIUM", "LOW"], "alert_", "tool_order, ord")
COMMIT_DIGEST = _digest("risks", "risk_level", COMMIT_TEXT, ["HIGH", "REVIEW_REQUIRED", "MEDIUM", "LOW"], "commit_", "ord")


@query("win02_issue_digest", ["alerts"], ALERT_DIGEST)
def _(t: Tables):
    return R.alert_digest(t.alerts, ["tool_order", "ord"])


@query("win02_commit_digest", ["risks"], COMMIT_DIGEST)
def _(t: Tables):
    return R.commit_digest(t.risks, ["ord"])


@query("win03_chronological_holdout", ["history"], """
SELECT repo_id, run_id, CASE WHEN rn > n - least(greatest(1, CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT)), n - 1) THEN 'holdout' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ts, run_id) AS rn, count(*) OVER (PARTITION BY repo_id) AS n FROM history)""")
def _(t: Tables):
    return H.chrono_split(t.history).select("repo_id", "run_id", "split")


@query("win04_ranked_models", [], f"""WITH {PREDICTED}, {CELLS}, {SCORES},
u AS (SELECT model, {r('(c00 + c11 + c22) / CAST(support_0 + support_1 + support_2 AS DOUBLE)', 6)} AS accuracy, {r('(f1_0 + f1_1 + f1_2) / (CAST(support_0 + predicted_0 > 0 AS INTEGER) + CAST(support_1 + predicted_1 > 0 AS INTEGER) + CAST(support_2 + predicted_2 > 0 AS INTEGER))', 6)} AS macro_f1,
 {r('(f1_0 * support_0 + f1_1 * support_1 + f1_2 * support_2) / (support_0 + support_1 + support_2)', 6)} AS weighted_f1, {r('recall_2', 6)} AS high_recall FROM s)
SELECT model, CAST(row_number() OVER (ORDER BY macro_f1 DESC, high_recall DESC, weighted_f1 DESC, accuracy DESC, model) AS INTEGER) AS selection_rank FROM u""")
def _(t: Tables):
    names = ["accuracy", "macro_f1", "weighted_f1", "high_recall"]
    rounded = E.multi_metrics(predicted(t), ["model"]).select("model", *[round_half_up(F.col(c), 6).alias(c) for c in names])
    return E.rank_models(rounded, "alert_priority").select("model", "selection_rank")


@query("win05_sampled_cases", ["case_files"], f"""
WITH f AS (SELECT source_file, regexp_extract(source_file, '(CWE[^/]*_[^/]*)', 1) AS cwe_folder,
 regexp_replace(regexp_replace(split_part(source_file, '/', -1), '\\.[^.]+$', ''), '(_(bad|goodG2B|goodB2G|good|[0-9]+[a-z]?))+$', '') AS case_group FROM case_files),
w AS (SELECT * FROM f WHERE cwe_folder IN ({', '.join(f"'{x}'" for x in [P.MEDIUM_FAMILY, *P.HIGH_FAMILIES])})),
c AS (SELECT cwe_folder, case_group FROM (SELECT DISTINCT cwe_folder, case_group FROM w)
 QUALIFY row_number() OVER (PARTITION BY cwe_folder ORDER BY md5(case_group || '|42'), case_group) <= 200)
SELECT cwe_folder, case_group, source_file FROM w JOIN c USING (cwe_folder, case_group)""".replace("\\\\", "\\"))
def _(t: Tables):
    return S.sample_groups(t.case_files)


@query("win06_grouped_split", [], """
SELECT l_orderkey, split, count(*) AS rows FROM lineitem JOIN (SELECT l_orderkey, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + ceil((g - t) * 0.25) THEN 'valid'
 ELSE 'train' END AS split FROM (SELECT *, ceil(g * 0.2) AS t FROM (SELECT l_orderkey, row_number() OVER (ORDER BY md5(l_orderkey || '|42')) AS rk,
 count(*) OVER () AS g FROM (SELECT DISTINCT l_orderkey FROM lineitem)))) USING (l_orderkey) GROUP BY ALL""")
def _(t: Tables):
    return S.grouped_split(t.read("lineitem"), "l_orderkey").groupBy("l_orderkey", "split").agg(F.count(F.lit(1)).alias("rows"))


TRIALS = 120
_names = ["train", "valid", "test"]
_distance = " + ".join(
    f"abs({r(f'(train_n{x} + valid_n{x} + test_n{x}) / CAST(al AS DOUBLE)', 6)} - {r(f'{s}_n{x} / CAST({s}_n AS DOUBLE)', 6)})" for s in _names for x in LABELS)


@query("win07_split_search", [], f"""
WITH g AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n0, count(*) FILTER (l_returnflag = 'N') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2
 FROM lineitem GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY md5(l_orderkey || '|' || seed)) AS rk, count(*) OVER (PARTITION BY seed) AS g
 FROM g, (SELECT unnest(range(42, 42 + {TRIALS})) AS seed)),
s AS (SELECT seed, n0, n1, n2, CASE WHEN rk <= ceil(g * 0.2) THEN 'test' WHEN rk <= ceil(g * 0.2) + ceil((g - ceil(g * 0.2)) * 0.25) THEN 'valid' ELSE 'train' END AS split FROM d),
t AS (SELECT CAST(seed AS INTEGER) AS seed, {', '.join(f"CAST(sum(n{x}) FILTER (split = '{s}') AS BIGINT) AS {s}_n{x}" for s in _names for x in LABELS)},
 {', '.join(f"sum(n0 + n1 + n2) FILTER (split = '{s}') AS {s}_n" for s in _names)}, sum(n0 + n1 + n2) AS al FROM s GROUP BY seed)
SELECT seed, {', '.join(f'{s}_n{x}' for s in _names for x in LABELS)}, divergence,
 CAST(row_number() OVER (ORDER BY divergence, seed) AS INTEGER) AS trial_rank FROM (SELECT *, {r(_distance, 6)} AS divergence FROM t)""")
def _(t: Tables):
    return S.search_split(flagged(t), "l_orderkey", trials=TRIALS)


_prior = ["total_alerts", "alerts_per_file"]


@query("win08_prior_baseline", ["history"], """
SELECT repo_id, run_id, n AS prior_runs, """ + ", ".join(
    f"{r(f'm_{f}', 6)} AS {f}_prior_mean, {r(f'CASE WHEN n > 0 THEN sqrt(greatest(q_{f} - m_{f} * m_{f}, 0)) END', 6)} AS {f}_prior_std" for f in _prior) + """ FROM (
SELECT repo_id, run_id, count(*) OVER o AS n, """ + ", ".join(
    f"avg(CAST({f} AS DOUBLE)) OVER o AS m_{f}, avg(CAST({f} AS DOUBLE) * CAST({f} AS DOUBLE)) OVER o AS q_{f}" for f in _prior) + """ FROM history
WINDOW o AS (PARTITION BY repo_id ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def _(t: Tables):
    keys = ["repo_id", "run_id", "ts", *_prior]
    base = H.prior_baseline(t.history.select(*keys), _prior)
    return base.drop("ts", *_prior)


@query("srt04_best_row_per_repo", ["risks"], """
SELECT repo_id, ord, risk_score FROM risks QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY risk_score DESC, ord) = 1""")
def _(t: Tables):
    rows = t.risks.select("repo_id", "ord", "risk_score")
    return top_per_group(rows, ["repo_id"], [F.desc("risk_score"), F.asc("ord")], 1).drop("rn")
