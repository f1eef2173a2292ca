"""Features, models, detectors, streams and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions.numbers import round_half_up
from gatewright.operators import detectors as D
from gatewright.operators import evaluation as E
from gatewright.operators import features as X
from gatewright.operators import history as H
from gatewright.operators import kernel as KS
from gatewright.operators import models as M
from gatewright.operators import rows as O
from gatewright.operators import runs as R
from gatewright.operators.neighbours import local_outlier_factor
from gatewright.plans import anomaly as N
from gatewright.plans import detector_store as V
from gatewright.plans import gate as G
from gatewright.plans.catalog_metrics import ALERT_DIGEST, COMMIT_DIGEST
from gatewright.plans.catalog_tables import training_rows
from gatewright.plans.registry import query
from gatewright.plans.tables import Tables
from gatewright.plans.views import r, unit
from gatewright.session import cut_lineage, scratch_dir, widen
from gatewright.streaming import history as ST


# ---- features ----------------------------------------------------------------------------------------------------
def _tfidf(docs: str, key: str, tokens: str, size: int) -> str:
    return f"""
WITH d AS ({docs}), tok AS (SELECT {key}, unnest({tokens}) AS term FROM d), tf AS (SELECT {key}, term, count(*) AS tf FROM tok GROUP BY ALL),
voc AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL ORDER BY total DESC, term LIMIT {size}),
w AS (SELECT {key}, term, tf * (ln((CAST(1 AS DOUBLE) + (SELECT count(*) FROM d)) / (CAST(1 AS DOUBLE) + df)) + 1) AS w FROM tf JOIN voc USING (term))
SELECT {key}, term, {r(f'w / sqrt(sum(w * w) OVER (PARTITION BY {key}))', 6)} AS tfidf FROM w"""


@query("ml01_code_tfidf", [], _tfidf("SELECT doc_id, text FROM documents", "doc_id", r"regexp_extract_all(text, '[\p{L}\p{N}_]+')", X.CODE_TERMS))
def _(t: Tables):
    rows = X.tfidf_rows(widen(t.read("documents").select("doc_id", "text")), "doc_id", X.code_tokens(F.col("text")), X.CODE_TERMS)
    return rows.withColumn("tfidf", round_half_up(F.col("tfidf"), 6))


@query("ml01_code_tfidf_vectors", ["labelled"], rf"""
WITH w AS (SELECT doc_id, split, regexp_extract_all(function_code, '[\p{{L}}\p{{N}}_]+') AS words FROM labelled),
voc AS (SELECT term FROM (SELECT unnest(words) AS term FROM w WHERE split = 'train') GROUP BY term ORDER BY count(*) DESC, term LIMIT {X.CODE_TERMS})
SELECT doc_id, split, CASE WHEN list_has_any(words, (SELECT list(term) FROM voc)) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS squared_length FROM w""")
def _(t: Tables):
    """The same weights from the saved-model form: non-zero entries per labelled function."""
    from pyspark.ml.functions import vector_to_array

    model = X.fit_code_tfidf(t.labelled.filter("split = 'train'"))
    sums = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, v: a + v * v)
    return model.transform(t.labelled).select("doc_id", "split", round_half_up(sums, 6).alias("squared_length"))


_words = r"regexp_extract_all(lower(message), '[\p{L}\p{N}_]{2,}')"


@query("ml02_message_tfidf", ["messages"], _tfidf(
    'SELECT ord, "warningMessage" AS message FROM messages', "ord",
    f"list_concat({_words}, [a || ' ' || ({_words})[i + 1] FOR a, i IN {_words} IF i < len({_words})])", 3000))
def _(t: Tables):
    rows = t.messages.select("ord", F.col("warningMessage").alias("message"))
    weights = X.tfidf_rows(rows, "ord", X.message_tokens(F.col("message")), X.MESSAGE_TERMS)
    return weights.withColumn("tfidf", round_half_up(F.col("tfidf"), 6))


_scaled = ", ".join(
    r(f"CASE WHEN stddev_pop({c}) OVER () < 1e-9 THEN {c} - avg({c}) OVER () ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END", 6) + f" AS {c}"
    for c in ("severity_score", "has_cwe", "is_null_pointer", "is_buffer_issue"))


@query("ml03_standardise", ["training"], f"SELECT ord, {_scaled} FROM training")
def _(t: Tables):
    columns = ["severity_score", "has_cwe", "is_null_pointer", "is_buffer_issue"]
    rows = X.standardise(training_rows(t).select("ord", *columns), columns)
    return rows.select("ord", *[round_half_up(F.col(c), 6).alias(c) for c in columns])


@query("ml03_standardise_per_repo", ["history"], "SELECT repo_id, run_id, " + ", ".join(
    r(f"CASE WHEN stddev_pop({c}) OVER w < 1e-9 THEN 0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END", 6) + f" AS {c}"
    for c in ("total_alerts", "alerts_per_file")) + " FROM history WINDOW w AS (PARTITION BY repo_id)")
def _(t: Tables):
    columns = ["total_alerts", "alerts_per_file"]
    rows = X.standardise(t.history.select("repo_id", "run_id", *columns), columns, ["repo_id"])
    return rows.select("repo_id", "run_id", *[round_half_up(F.col(c), 6).alias(c) for c in columns])


@query("ml04_one_hot", ["training"], """
WITH v AS (SELECT alert_id, CAST(row_number() OVER (ORDER BY alert_id) - 1 AS INTEGER) AS i, (SELECT count(DISTINCT alert_id) FROM training WHERE is_actionable = 1) AS n
 FROM (SELECT DISTINCT alert_id FROM training WHERE is_actionable = 1 AND alert_id <> 'id3'))
SELECT ord, coalesce(i, -1) AS hot, CAST(CASE WHEN i IS NULL THEN 0 ELSE 1 END AS INTEGER) AS total FROM training LEFT JOIN v USING (alert_id)""")
def _(t: Tables):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = training_rows(t).select("ord", "alert_id", "is_actionable")
    model = Pipeline(stages=M.one_hot_stages(["alert_id"])).fit(rows.filter("is_actionable = 1 and alert_id <> 'id3'"))
    hot = vector_to_array("__alert_id_v")
    return model.transform(rows).select(
        "ord", (F.array_position(hot, F.lit(1.0)) - 1).cast("int").alias("hot"),
        F.aggregate(hot, F.lit(0.0), lambda a, v: a + v).cast("int").alias("total"),
    )


@query("ml06_balanced_weight", ["training"], f"""
SELECT ord, label, {r('CAST(n AS DOUBLE) / (k * c)', 6)} AS weight FROM training JOIN (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n,
 count(*) OVER () AS k FROM training GROUP BY label) USING (label)""")
def _(t: Tables):
    rows = X.balanced_weight(training_rows(t).select("ord", "label"))
    return rows.withColumn("weight", round_half_up(F.col("weight"), 6))


# ---- classifiers -------------------------------------------------------------------------------------------------
def alert_splits(t: Tables):
    """De-duplicated warnings with a file-grouped split, as (train, valid, test)."""
    from gatewright.operators.splits import grouped_split

    rows = O.fill_text(O.dedup_first(training_rows(t), P.ALERT_KEY_CPPCHECK), {"cwe": "0", "message": "", "alert_id": "", "severity": ""})
    table = cut_lineage(grouped_split(rows, "file"), "alert-splits")
    return tuple(table.filter(F.col("split") == s) for s in ("train", "valid", "test"))


@query("ml05_alert_features")
def _(t: Tables):
    """Assembled feature vectors: their width and number of non-zero entries per alert."""
    from pyspark.ml.functions import vector_to_array

    train, valid, _ = alert_splits(t)
    model = M.feature_model(train, "cppcheck")
    v = vector_to_array("features")
    return model.transform(valid).select("ord", F.size(v).alias("width"), F.size(F.filter(v, lambda x: x != 0)).alias("filled"))


def _candidates(t: Tables, names: list[str]):
    train, valid, test = alert_splits(t)
    features = M.feature_model(train, "cppcheck")
    return M.train_and_select(train, valid, test, "cppcheck", features, names)


def _evaluation_columns(table):
    metrics = ["accuracy", "macro_f1", "weighted_f1", "high_recall"]
    return table.select("model", *[round_half_up(F.col(c), 4).alias(c) for c in metrics], "selected")


@query("ml07_logistic_regression")
def _(t: Tables):
    return _evaluation_columns(_candidates(t, ["Logistic Regression"])[2])


@query("ml08_linear_svm")
def _(t: Tables):
    return _evaluation_columns(_candidates(t, ["SVM"])[2])


@query("ml09_random_forest")
def _(t: Tables):
    """Two-class form on labelled functions (100 trees)."""
    return _commit_risk(t, ["Random Forest"])[2].select("model", "accuracy", "precision", "recall", "f1", "roc_auc", "selected")


@query("ml10_neural_network")
def _(t: Tables):
    return _commit_risk(t, ["ANN"])[2].select("model", "accuracy", "precision", "recall", "f1", "roc_auc", "selected")


def _commit_risk(t: Tables, names: list[str] | None):
    rows = cut_lineage(t.labelled.withColumn("label", F.col("target")), "labelled")
    parts = [rows.filter(F.col("split") == s) for s in ("train", "valid", "test")]
    return M.train_and_select(*parts, "commit_risk", X.fit_code_tfidf(parts[0]), names)


@query("ml11_train_and_select")
def _(t: Tables):
    best, _, ranked, final = _commit_risk(t, None)
    columns = ["model", "accuracy", "precision", "recall", "f1", "roc_auc"]
    test = final.select(*columns, F.lit(True).alias("selected"), F.lit("test").alias("split"))
    return ranked.select(*columns, "selected", F.lit("valid").alias("split")).unionByName(test)


@query("ml18_score_functions", ["touched", "sources", "risks"], f"""
WITH f AS (SELECT file_path, function_name, start_line, function_code, false AS fb FROM touched UNION ALL
 SELECT file_path, '__FILE_FALLBACK__', 1, content, true FROM sources WHERE file_path NOT IN (SELECT file_path FROM touched)),
p AS (SELECT *, {unit('file_path', 'function_name')} AS probability FROM f),
s AS (SELECT *, {r('probability * 100', 2)} AS risk_score, {r('abs(probability - 0.5) * 2', 4)} AS confidence FROM p)
SELECT file_path, function_name, start_line, risk_score, confidence, CASE WHEN confidence < CAST(0.2 AS DOUBLE) AND risk_score < 70 THEN 'REVIEW_REQUIRED'
 WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 CASE WHEN contains(lower(function_code), 'free') THEN 'free' ELSE '' END AS top_risky_terms FROM s""")
def _(t: Tables):
    """Changed functions scored from a given probability; the model form is in ``ml18_model_scores``."""
    from gatewright.functions.numbers import hash_unit
    from gatewright.operators.changes import changed_functions

    funcs = changed_functions(t.sources, t.diffs)
    rows = funcs.withColumn("probability", hash_unit(F.col("file_path"), F.col("function_name")))
    scored = R.score_risk(rows, code="function_code")
    return scored.select("file_path", "function_name", "start_line", "risk_score", "confidence", "risk_level",
                         F.array_join("top_risky_terms", "|").alias("top_risky_terms"))


@query("ml18_model_scores")
def _(t: Tables):
    _, model, _, _ = _commit_risk(t, None)
    rows = t.labelled.filter("split = 'test'").select("doc_id", "function_code", F.lit(False).alias("fallback_used"))
    return M.score_functions(model, rows).select("doc_id", "risk_score", "risk_level", "confidence", "risk_reason")


@query("ml19_prioritised_alerts")
def _(t: Tables):
    _, model, _, _ = _candidates(t, ["Logistic Regression"])
    alerts = O.alert_features(t.alerts.drop("priority", "label").na.fill("0", subset=["cwe"]), "cppcheck", scoring=True)
    return M.prioritise(model, O.drop_ignored(alerts), keep=["ord"])


# ---- detectors ---------------------------------------------------------------------------------------------------
def _split_history(t: Tables):
    split = H.chrono_split(t.history)
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'holdout'").drop("split")


_u = {k: unit("repo_id", "run_id", f"'{k}'", "42") for k in P.PERTURBATION}


def _whole(c: str) -> str:
    return f"CAST(round_even({c}, 0) AS DOUBLE)"


@query("ml15_perturbed_copies", ["history"], f"""
SELECT repo_id, run_id, {_whole(f"total_alerts * (CAST(2 AS DOUBLE) + CAST(2 AS DOUBLE) * {_u['total_alerts_multiplier']})")} AS total_alerts,
 CAST(high_alerts + 3 + floor({_u['high_alerts_increment']} * 13) AS DOUBLE) AS high_alerts,
 CAST(high_commit_risk + 2 + floor({_u['high_commit_risk_increment']} * 9) AS DOUBLE) AS high_commit_risk,
 greatest({_whole(f"total_files_scanned * (CAST(0.35 AS DOUBLE) + (CAST(0.7 AS DOUBLE) - CAST(0.35 AS DOUBLE)) * {_u['total_files_scanned_shrink_ratio']})")}, CAST(1 AS DOUBLE)) AS total_files_scanned,
 {r(f"alerts_per_file * (CAST(2 AS DOUBLE) + {_u['alerts_per_file_multiplier']})", 2)} AS alerts_per_file,
 CAST(medium_alerts AS DOUBLE) AS medium_alerts, CAST(low_alerts AS DOUBLE) AS low_alerts, CAST(medium_commit_risk AS DOUBLE) AS medium_commit_risk,
 CAST(low_commit_risk AS DOUBLE) AS low_commit_risk FROM history""")
def _(t: Tables):
    return D.perturbed_copies(t.history.select("repo_id", "run_id", *P.ANOMALY_FEATURES))


def _lof_sql(features: list[str], source: str) -> str:
    d2 = " + ".join(f"pow(a.{f} - b.{f}, 2)" for f in features)
    cols = ", ".join(features)
    return f"""
WITH rows AS ({source}), pt AS (SELECT repo_id, {cols}, min(run_id) AS point, count(*) AS weight FROM rows GROUP BY ALL),
d AS (SELECT a.repo_id, a.point, b.point AS nb, b.weight - CAST(a.point = b.point AS INTEGER) AS w, round(sqrt({d2}), 9) AS dist FROM pt a JOIN pt b USING (repo_id)),
o AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY repo_id, point ORDER BY dist, nb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d WHERE w > 0),
n AS (SELECT repo_id, point, nb, dist, least(w, 10 - b) AS w FROM o WHERE b < 10),
k AS (SELECT repo_id, point, max(dist) AS kd FROM n GROUP BY ALL),
l AS (SELECT n.repo_id, n.point, 1 / (sum(greatest(n.dist, k.kd) * n.w) / sum(n.w) + 1e-10) AS lrd FROM n JOIN k ON n.repo_id = k.repo_id AND n.nb = k.point GROUP BY ALL),
f AS (SELECT n.repo_id, n.point, sum(l.lrd * n.w) / sum(n.w) AS m FROM n JOIN l ON n.repo_id = l.repo_id AND n.nb = l.point GROUP BY ALL),
s AS (SELECT f.repo_id, f.point, {r('-f.m / l.lrd', 6)} AS lof_score FROM f JOIN l USING (repo_id, point)),
z AS (SELECT rows.repo_id, rows.run_id, s.lof_score FROM rows JOIN pt USING (repo_id, {cols}) JOIN s USING (repo_id, point))
SELECT repo_id, run_id, {r('ln(-lof_score)', 6)} AS log_factor, CASE WHEN lof_score < quantile_cont(lof_score, 0.1) OVER (PARTITION BY repo_id) THEN -1 ELSE 1 END AS prediction FROM z"""


_lof = list(P.ANOMALY_FEATURES)


@query("ml12_local_outlier_factor", ["history"], _lof_sql(_lof, f"SELECT repo_id, run_id, {', '.join(_lof)} FROM history"))
def _(t: Tables):
    scored = local_outlier_factor(t.history.select("repo_id", "run_id", *_lof), _lof)
    # Copies of one point are infinitely dense, so factors span many magnitudes: compare their logarithms.
    return scored.select("repo_id", "run_id", round_half_up(F.log(-F.col("lof_score")), 6).alias("log_factor"), "prediction")


@query("ml12_lof_in_sample")
def _(t: Tables):
    return N.lof_in_sample(cut_lineage(N.trainable(t.history, 20), "usable"))


@query("ml13_isolation_forest")
def _(t: Tables):
    """Scores and verdicts of all valid runs under a forest of their own repository."""
    x = _scaled_history(t)
    scores = cut_lineage(D.grown_forest_score(x, x), "forest")
    return D.verdict(scores, D.cut_at(scores, 0.1)).drop("x")


def _scaled_history(t: Tables):
    usable = cut_lineage(N.trainable(t.history, 20), "usable")
    return cut_lineage(D.scale(usable, D.scaler(usable)).select("repo_id", "run_id", "x"), "scaled")


_FEATURES = P.ANOMALY_FEATURES
_z = ", ".join(
    r(f"CASE WHEN stddev_pop({c}) OVER w < 1e-9 THEN {c} - avg({c}) OVER w ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END", 9) for c in _FEATURES)


@query("ml14_rbf_one_class", ["valid"], f"""
WITH v AS (SELECT * FROM valid QUALIFY count(*) OVER (PARTITION BY repo_id) >= 20),
x AS (SELECT repo_id, run_id, [{_z}] AS x FROM v WINDOW w AS (PARTITION BY repo_id)),
g AS (SELECT repo_id, avg(list_sum([e * e FOR e IN x])) / 9 - pow(avg(list_sum(x)) / 9, 2) AS var FROM x GROUP BY ALL),
y AS (SELECT repo_id, run_id, x, CASE WHEN var > 1e-9 THEN 1 / (9 * var) ELSE 1 END AS gamma FROM x JOIN g USING (repo_id)),
ix AS (SELECT i, j FROM (SELECT unnest(range(0, 9)) AS i), (SELECT unnest(range(0, {D.FOURIER})) AS j)),
wt AS (SELECT i, j, sqrt(-2 * ln(1 - {unit("'r'", 'i', 'j', '42')})) * cos(2 * pi() * {unit("'a'", 'i', 'j', '42')}) AS w FROM ix),
bt AS (SELECT j, 2 * pi() * {unit("'b'", 'j', '42')} AS b FROM (SELECT DISTINCT j FROM ix)),
ux AS (SELECT repo_id, run_id, unnest(x) * sqrt(2 * gamma) AS z, unnest(range(0, 9)) AS i FROM y),
phi AS (SELECT repo_id, run_id, j, sqrt(CAST(2 AS DOUBLE) / {D.FOURIER}) * cos(s + b) AS phi FROM (SELECT repo_id, run_id, j, sum(z * w) AS s FROM ux JOIN wt USING (i) GROUP BY ALL) JOIN bt USING (j)),
mu AS (SELECT repo_id, j, avg(phi) AS m FROM phi GROUP BY ALL),
sc AS (SELECT repo_id, run_id, sum(phi * m) AS score FROM phi JOIN mu USING (repo_id, j) GROUP BY ALL)
SELECT repo_id, run_id, {r('score', 6)} AS score FROM sc""")
def _(t: Tables):
    x = _scaled_history(t)
    scores = D.rbf_score(x, D.fit_rbf(x, N.WIDTH), N.WIDTH)
    return scores.select("repo_id", "run_id", round_half_up(F.col("sample_score"), 6).alias("score"))


_exact = f"""
WITH v AS (SELECT * FROM valid QUALIFY count(*) OVER (PARTITION BY repo_id) >= 20),
x AS (SELECT repo_id, run_id, [{_z}] AS x FROM v WINDOW w AS (PARTITION BY repo_id)),
g AS (SELECT repo_id, avg(list_sum([e * e FOR e IN x])) / 9 - pow(avg(list_sum(x)) / 9, 2) AS var, count(*) AS n FROM x GROUP BY ALL),
y AS (SELECT repo_id, run_id, x, n, CASE WHEN var > 1e-9 THEN 1 / (9 * var) ELSE 1 END AS gamma FROM x JOIN g USING (repo_id)),
sc AS (SELECT a.repo_id, a.run_id, any_value(a.n) AS n, avg(exp(-a.gamma * pow(list_distance(a.x, b.x), 2))) AS score
 FROM y a JOIN y b USING (repo_id) GROUP BY ALL)
"""


@query("ml14_rbf_exact", ["valid"], f"{_exact} SELECT repo_id, run_id, {r('score', 6)} AS score FROM sc")
def _(t: Tables):
    x = _scaled_history(t)
    return KS.kernel_score(x, KS.kernel_cells(x, N.WIDTH)).select(
        "repo_id", "run_id", round_half_up(F.col("sample_score"), 6).alias("score")
    )


@query("ml14_rbf_bounded", ["valid"], f"{_exact} SELECT repo_id, count(*) AS rows, true AS fewer_cells, true AS within_bound, true AS within_tolerance FROM sc GROUP BY ALL")
def _(t: Tables):
    x = _scaled_history(t)
    cells = KS.kernel_cells(x, N.WIDTH, 0.05)
    exact = KS.kernel_score(x, KS.kernel_cells(x, N.WIDTH)).select("repo_id", "run_id", F.col("sample_score").alias("exact"))
    off = KS.kernel_score(x, cells).join(exact, ["repo_id", "run_id"]).groupBy("repo_id").agg(
        F.max(F.abs(F.col("sample_score") - F.col("exact"))).alias("off")
    )
    return KS.kernel_error(cells).join(off, "repo_id").select(
        "repo_id", "rows", (F.col("cells") <= F.col("rows")).alias("fewer_cells"),
        (F.col("off") <= F.col("bound") + 1e-8).alias("within_bound"), (F.col("bound") <= 0.05).alias("within_tolerance"),
    )


@query("ml14_rbf_verdicts")
def _(t: Tables):
    x = _scaled_history(t)
    scores = cut_lineage(D.rbf_score(x, D.fit_rbf(x, N.WIDTH), N.WIDTH), "rbf")
    return D.verdict(scores, D.cut_at(scores, 0.1)).drop("x")


@query("ml16_detector_evaluation")
def _(t: Tables):
    usable = cut_lineage(N.trainable(t.history, 20), "usable")
    return N.detector_evaluation(N.detector_verdicts(usable))


@query("ml16_training_report", ["flags"], """
WITH n AS (SELECT repo_id, count(*) FILTER (NOT (x_blocked OR x_risk OR x_summary OR x_cppcheck OR x_failed)) AS ok FROM flags GROUP BY ALL),
m AS (SELECT unnest(['Isolation Forest', 'One-Class SVM', 'LOF']) AS model)
SELECT repo_id, 'TRAINED' AS status, ok AS rows_available, model, model <> 'LOF' AS deployment_eligible, model = 'LOF' AS exploratory_only,
 CASE WHEN model = 'LOF' THEN 'Exploratory only: configured with novelty=False and cannot safely score unseen rows in deployed runtime.' ELSE '' END AS reason,
 greatest(1, CAST(round_even(ok * CAST(0.2 AS DOUBLE), 0) AS BIGINT)) AS normal_examples, model <> 'LOF' AS ranked FROM n, m WHERE ok >= 20
UNION ALL SELECT repo_id, 'SKIPPED', ok, NULL, NULL, NULL, CASE WHEN ok = 0 THEN 'No valid historical rows available after ML3 training filters'
 ELSE 'Not enough valid historical rows for model training' END, NULL, false FROM n WHERE ok < 20""")
def _(t: Tables):
    """Every model's row for each repository: the outlier factor cannot be chosen; repositories of too little history say so."""
    history = cut_lineage(t.history, "history")
    usable = cut_lineage(N.trainable(history, 20), "usable")
    report = N.comparison(history, usable, cut_lineage(N.detector_evaluation(N.detector_verdicts(usable)), "evaluation"), 20)
    return report.select("repo_id", "status", "rows_available", "model", "deployment_eligible", "exploratory_only", "reason", "normal_examples",
                         F.col("selection_rank").isNotNull().alias("ranked"))


@query("ml16_detector_ranking", ["history"], f"""
WITH m AS (SELECT repo_id, unnest(['a', 'b', 'c']) AS model, total_alerts, d FROM history),
p AS (SELECT repo_id, model, d % 4 = 0 AS y, CASE model WHEN 'a' THEN total_alerts > 3 WHEN 'b' THEN total_alerts < 3 ELSE d % 3 = 0 END AS a FROM m),
c AS (SELECT repo_id, model, count(*) FILTER (NOT y AND NOT a) AS tn, count(*) FILTER (NOT y AND a) AS fp, count(*) FILTER (y AND NOT a) AS fn, count(*) FILTER (y AND a) AS tp FROM p GROUP BY ALL),
k AS (SELECT *, {r('CASE WHEN tp + fp = 0 THEN CAST(0 AS DOUBLE) ELSE tp / CAST(tp + fp AS DOUBLE) END', 4)} AS precision,
 {r('CASE WHEN tp + fn = 0 THEN CAST(0 AS DOUBLE) ELSE tp / CAST(tp + fn AS DOUBLE) END', 4)} AS recall,
 {r('CASE WHEN 2 * tp + fp + fn = 0 THEN CAST(0 AS DOUBLE) ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END', 4)} AS f1,
 {r('CASE WHEN fp + tn = 0 THEN CAST(0 AS DOUBLE) ELSE fp / CAST(fp + tn AS DOUBLE) END', 4)} AS false_positive_rate FROM c)
SELECT repo_id, model, precision, recall, f1, false_positive_rate,
 CAST(row_number() OVER (PARTITION BY repo_id ORDER BY f1 DESC, recall DESC, false_positive_rate, model) AS INTEGER) AS selection_rank FROM k""")
def _(t: Tables):
    d, n = F.substring("run_id", 9, 2).cast("int"), F.col("total_alerts")
    rows = t.history.select("repo_id", n, F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("model"), d.alias("d"))
    said = F.when(F.col("model") == "a", n > 3).when(F.col("model") == "b", n < 3).otherwise(F.col("d") % 3 == 0)
    rows = rows.select("repo_id", "model", (F.col("d") % 4 == 0).cast("int").alias("label"), said.cast("int").alias("prediction"))
    names = ["precision", "recall", "f1", "false_positive_rate"]
    table = E.binary_metrics(rows, ["repo_id", "model"]).select("repo_id", "model", *[round_half_up(F.col(c), 4).alias(c) for c in names])
    return E.rank_models(table, "anomaly", ["repo_id"]).drop("selected")


@query("ml17_detect_runs")
def _(t: Tables):
    """The last day's runs against detectors trained on the days before."""
    day = F.substring("run_id", 9, 2).cast("int")
    rows = cut_lineage(t.history.withColumn("ml3_scoring_block_reason", F.lit("")), "history")
    report = N.detect(rows.filter(day < 30), rows.filter(day >= 30), 20)
    return report.select("repo_id", "run_id", "anomaly_status", "is_anomaly", "anomaly_score", "selected_model", "reason", "failure_reason")


@query("ml17_saved_detectors", ["flags"], """
WITH n AS (SELECT repo_id, count(*) AS history_rows, count(*) FILTER (NOT (x_blocked OR x_risk OR x_summary OR x_cppcheck OR x_failed)) AS usable
 FROM flags WHERE d < 30 GROUP BY ALL)
SELECT repo_id, run_id, CASE WHEN x_blocked THEN 'ML3_SCORING_BLOCKED' WHEN coalesce(usable, 0) >= 20 THEN 'Scored using trained ML3 anomaly model'
 WHEN coalesce(history_rows, 0) < 20 THEN 'INSUFFICIENT_HISTORY' ELSE 'MODEL_NOT_TRAINED' END AS reason,
 NOT x_blocked AND coalesce(usable, 0) >= 20 AS scored, true AS verdict_follows_score FROM flags LEFT JOIN n USING (repo_id) WHERE d >= 30""")
def _(t: Tables):
    """The last day's runs by detectors that were trained on the days before, stored and loaded."""
    day = F.substring("run_id", 9, 2).cast("int")
    rows = cut_lineage(t.history.withColumn("ml3_scoring_block_reason", F.lit("")), "history")
    past, path = rows.filter(day < 30), scratch_dir(t.spark, "detectors")
    V.train_detectors(past, path, 20)
    sizes = past.groupBy("repo_id").agg(F.count(F.lit(1)).alias("history_rows"))
    report = V.detect_saved(rows.filter(day >= 30), sizes, path, min_rows=20)
    scored = F.col("anomaly_score").isNotNull()
    follows = ~scored | (F.col("is_anomaly") == (F.col("anomaly_score") < 0)) | (F.col("anomaly_score") == 0)
    return report.select("repo_id", "run_id", "reason", scored.alias("scored"), follows.alias("verdict_follows_score"))


@query("snk03_detector_store", ["flags"], f"""
SELECT repo_id, count(*) AS total_history_rows, count(*) FILTER (ok) AS valid_training_rows, count(*) FILTER (NOT ok) AS excluded_history_rows,
 min(ts) FILTER (ok) AS history_timestamp_min, max(ts) FILTER (ok) AS history_timestamp_max, '{"|".join(_FEATURES)}' AS feature_columns, 1 AS detectors, true AS as_selected
FROM (SELECT *, NOT (x_blocked OR x_risk OR x_summary OR x_cppcheck OR x_failed) AS ok FROM flags) GROUP BY repo_id HAVING count(*) FILTER (ok) >= 20""")
def _(t: Tables):
    """What the store says of each repository's detector."""
    path = scratch_dir(t.spark, "detectors")
    V.train_detectors(cut_lineage(t.history, "history"), path, 20)
    m = F.col("metadata")
    names = ["total_history_rows", "valid_training_rows", "excluded_history_rows", "history_timestamp_min", "history_timestamp_max"]
    held = F.col("forest").isNotNull().cast("int") + F.col("rbf").isNotNull().cast("int")
    return V.detector_store(t.spark, path).read().select(
        "repo_id", *[m[c].alias(c) for c in names], F.array_join(m["feature_columns"], "|").alias("feature_columns"),
        held.alias("detectors"), (m["selected_model"] == F.col("model")).alias("as_selected"),
    )


# ---- gate --------------------------------------------------------------------------------------------------------
_FACTS = """
a AS (SELECT repo_id, run_id, count(*) FILTER (priority = 'HIGH') AS alert_high_count, count(*) FILTER (priority = 'MEDIUM') AS alert_medium_count,
 count(*) FILTER (priority = 'LOW') AS alert_low_count FROM alerts GROUP BY ALL),
c AS (SELECT repo_id, run_id, count(*) FILTER (risk_level = 'HIGH') AS commit_high_count, count(*) FILTER (risk_level = 'REVIEW_REQUIRED') AS commit_review_required_count,
 count(*) FILTER (risk_level = 'MEDIUM') AS commit_medium_count, count(*) FILTER (risk_level = 'LOW') AS commit_low_count FROM risks GROUP BY ALL),
f AS (SELECT *, CASE WHEN d % 5 = 0 THEN 'ANOMALOUS' WHEN d % 5 = 1 THEN 'FAILED' WHEN d % 5 = 2 THEN 'NORMAL' ELSE 'NOT_AVAILABLE' END AS anomaly_status,
 CASE WHEN d % 5 < 3 THEN CAST(d AS DOUBLE) / 8 END AS anomaly_score,
 CASE WHEN d % 5 < 3 THEN 'given' WHEN d % 5 = 3 THEN 'x=SCHEMA_MISMATCH' ELSE 'ML3 anomaly report not available' END AS anomaly_reason
 FROM (SELECT *, CAST(substr(run_id, 9, 2) AS INTEGER) AS d FROM a JOIN c USING (repo_id, run_id))),
v AS (SELECT *, CASE WHEN commit_high_count + alert_high_count > 0 THEN 1 WHEN commit_review_required_count > 0 THEN 2 WHEN anomaly_status = 'ANOMALOUS' THEN 3
 WHEN anomaly_status = 'NOT_AVAILABLE' AND contains(anomaly_reason, 'SCHEMA_MISMATCH') THEN 4 WHEN anomaly_status = 'FAILED' THEN 5
 WHEN commit_medium_count + alert_medium_count > 0 THEN 6 WHEN commit_low_count + alert_low_count > 0 THEN 7 ELSE 8 END AS rule FROM f)"""
_DECISION = """repo_id, run_id, CASE WHEN rule = 1 THEN 'BLOCK' WHEN rule < 7 THEN 'REVIEW' ELSE 'PASS' END AS decision, CASE rule
 WHEN 1 THEN 'High commit risk or high severity security alerts detected' WHEN 2 THEN 'Low-confidence ML1 predictions require manual review'
 WHEN 3 THEN 'Anomalous CI/CD pipeline behaviour detected by ML3'
 WHEN 4 THEN 'ML3 anomaly detection unavailable due to malformed or schema-incompatible upstream input' WHEN 5 THEN 'ML3 anomaly detection runtime failed'
 WHEN 6 THEN 'Medium commit risk or medium severity security alerts detected' WHEN 7 THEN 'Only low risk findings detected'
 ELSE 'No commit risk, security alerts, or anomaly detected' END AS reason, commit_high_count, commit_review_required_count, commit_medium_count,
 commit_low_count, alert_high_count, alert_medium_count, alert_low_count, anomaly_status, anomaly_score, anomaly_reason"""


def anomalies(t: Tables):
    """Anomaly reports for four of five days; one kind carries an input fault."""
    d = F.substring("run_id", 9, 2).cast("int")
    status = F.when(d % 5 == 0, "ANOMALOUS").when(d % 5 == 1, "FAILED").when(d % 5 == 2, "NORMAL").otherwise("NOT_AVAILABLE")
    return t.runs.filter(d % 5 < 4).select(
        "repo_id", "run_id", status.alias("anomaly_status"), F.when(d % 5 < 3, d.cast("double") / 8).alias("anomaly_score"),
        F.when(d % 5 < 3, "given").otherwise("x=SCHEMA_MISMATCH").alias("reason"),
    )


@query("gt01_decisions", ["alerts", "risks"], f"WITH {_FACTS} SELECT {_DECISION} FROM v")
def _(t: Tables):
    return G.decide(R.run_facts(t.runs, t.alerts, t.risks, anomalies(t)))


@query("gt02_decision_table", ["alerts", "risks"], f"""WITH {_FACTS}, ad AS ({ALERT_DIGEST}), cd AS ({COMMIT_DIGEST})
SELECT {_DECISION}, """ + ", ".join(f"coalesce(cd.commit_{x}_issues, '') AS commit_{x}_issues" for x in ("high", "review_required", "medium", "low"))
       + ", " + ", ".join(f"coalesce(ad.alert_{x}_issues, '') AS alert_{x}_issues" for x in ("high", "medium", "low"))
       + " FROM v LEFT JOIN ad USING (repo_id, run_id) LEFT JOIN cd USING (repo_id, run_id)")
def _(t: Tables):
    return G.decision_table(t.runs, t.alerts, t.risks, anomalies(t))


# ---- streams -----------------------------------------------------------------------------------------------------
def _event_stream(t: Tables, options: dict[str, str] | None = None):
    schema = t.read("events").schema
    reader = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return reader.parquet(t.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stm01_append_once_stream", ["runs"], "SELECT repo_id, run_id FROM runs")
def _(t: Tables):
    table, mark = scratch_dir(t.spark, "stream-history"), scratch_dir(t.spark, "stream-mark")
    runs = _event_stream(t).select(
        F.col("user_id").cast("string").alias("repo_id"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), "ts", F.col("event_id").alias("ord"))
    ST.run_to_end(ST.stream_history(runs, table, mark))
    return ST.read_table(t.spark, table, "repo_id string, run_id string, ts timestamp, ord long").select("repo_id", "run_id")


@query("stm02_daily_metrics_stream", ["alerts"], """
SELECT repo_id, run_id AS day, count(*) AS total_alerts, count(*) FILTER (priority = 'HIGH') AS high_alerts,
 count(*) FILTER (priority = 'MEDIUM') AS medium_alerts, count(*) FILTER (priority = 'LOW') AS low_alerts FROM alerts GROUP BY ALL""")
def _(t: Tables):
    from gatewright.functions.alerts import lookup, priority_a
    from gatewright.plans.tables import SEVERITY_OF_EVENT

    table, mark = scratch_dir(t.spark, "stream-metrics"), scratch_dir(t.spark, "stream-mark")
    severity = lookup(F.col("event_type"), SEVERITY_OF_EVENT, "none")
    alerts = _event_stream(t).select(
        F.col("user_id").cast("string").alias("repo_id"), "ts", priority_a(F.col("event_type") != "view", severity).alias("priority"))
    ST.run_to_end(ST.write_updates(ST.daily_metrics(alerts, "1 hour"), table, mark, ["repo_id", "day"]))
    schema = "repo_id string, day timestamp, total_alerts long, high_alerts long, medium_alerts long, low_alerts long"
    return ST.latest(t.spark, table, ["repo_id", "day"], schema).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stm03_stream_scores", ["metrics"], f"""
WITH b AS (SELECT repo_id, avg(total_alerts) AS m, stddev_pop(total_alerts) AS s FROM metrics WHERE CAST(substr(run_id, 9, 2) AS INTEGER) <= 20 GROUP BY ALL)
SELECT repo_id, run_id, total_alerts, {r('(total_alerts - m) / CASE WHEN s > 0 THEN s ELSE 1 END', 6)} AS z FROM metrics LEFT JOIN b USING (repo_id)
WHERE CAST(substr(run_id, 9, 2) AS INTEGER) > 20""")
def _(t: Tables):
    """Later runs arrive as a stream and meet the baseline saved from the earlier ones."""
    base, arriving = scratch_dir(t.spark, "baseline"), scratch_dir(t.spark, "arriving")
    out, mark = scratch_dir(t.spark, "stream-scores"), scratch_dir(t.spark, "stream-mark")
    day = F.substring("run_id", 9, 2).cast("int")
    rows = t.metrics.select("repo_id", "run_id", "total_alerts")
    rows.filter(day <= 20).groupBy("repo_id").agg(F.avg("total_alerts").alias("mean"), F.stddev_pop("total_alerts").alias("dev")).write.parquet(base)
    rows.filter(day > 20).write.parquet(arriving)
    stream = t.spark.readStream.schema("repo_id string, run_id string, total_alerts long").parquet(arriving)
    ST.run_to_end(ST.stream_score(stream, base, out, mark))
    return t.spark.read.schema("repo_id string, run_id string, total_alerts long, z double").parquet(f"{out}/batch=*")


@query("stm03_prior_scores", ["history"], f"""
SELECT repo_id, run_id, n AS prior_runs, {r('m', 6)} AS prior_mean, {r('s', 6)} AS prior_std, {r('(total_alerts - m) / CASE WHEN s > 0 THEN s ELSE 1 END', 4)} AS z FROM (
SELECT repo_id, run_id, total_alerts, count(*) OVER o AS n, avg(total_alerts) OVER o AS m, stddev_pop(total_alerts) OVER o AS s FROM history
WINDOW o AS (PARTITION BY repo_id ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def _(t: Tables):
    """Runs arrive in three parts, day by day; each is scored against all runs before it."""
    arriving, out, mark = (scratch_dir(t.spark, x) for x in ("arriving", "prior-scores", "stream-mark"))
    rows = cut_lineage(t.history.select("repo_id", "run_id", F.timestamp_seconds("ts").alias("ts"), "total_alerts"), "history")
    day = F.substring("run_id", 9, 2).cast("int")
    for low, high in ((0, 9), (10, 24), (25, 99)):
        rows.filter(day.between(low, high)).write.mode("append").parquet(arriving)
        stream = t.spark.readStream.schema(rows.schema).parquet(arriving)
        ST.run_to_end(ST.stream_prior_scores(stream, out, mark))
    schema = "repo_id string, run_id string, prior_runs long, prior_mean double, prior_std double, z double"
    found = t.spark.read.schema(schema).parquet(f"{out}/batch=*")
    return found.select("repo_id", "run_id", "prior_runs", *[round_half_up(F.col(c), n).alias(c) for c, n in (("prior_mean", 6), ("prior_std", 6), ("z", 4))])
