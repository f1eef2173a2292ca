"""Features, training, saving and scoring."""

from __future__ import annotations

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.operators import features as X
from gatewright.operators import models as M
from gatewright.operators import rows as O
from gatewright.plans import commit_risk, prioritiser
from gatewright.sources import sinks as K


def functions(spark):
    rows = spark.range(300).select(
        F.col("id").alias("ord"), F.when(F.col("id") % 5 < 3, "train").when(F.col("id") % 5 == 3, "valid").otherwise("test").alias("split"),
        F.when(F.floor(F.col("id") / 5) % 3 == 0, F.concat(F.lit("void f"), F.col("id") % 17, F.lit("(char *p) { strcpy(p, q); gets(p); }")))
        .otherwise(F.concat(F.lit("int g"), F.col("id") % 19, F.lit("(int a) { return a + 1; }"))).alias("function_code"),
        (F.floor(F.col("id") / 5) % 3 == 0).cast("int").alias("target"))
    return rows


def test_vector_and_relational_tfidf_agree(spark):
    rows = functions(spark)
    model = X.fit_code_tfidf(rows, size=20)
    terms = model.stages[1].vocabulary
    assert terms == sorted(terms) and len(terms) == 20
    vectors = {r["ord"]: dict(zip(terms, r["v"])) for r in model.transform(rows).select("ord", vector_to_array("features").alias("v")).collect()}
    for r in X.tfidf_rows(rows, "ord", X.code_tokens(F.col("function_code")), 20).collect():
        assert abs(vectors[r["ord"]][r["term"]] - r["tfidf"]) < 1e-9


def test_tokens(spark):
    df = spark.createDataFrame([("für a_1 b", "A bc, De f gh")], "c string, m string")
    row = df.select(X.code_tokens(F.col("c")).alias("c"), X.message_tokens(F.col("m")).alias("m")).first()
    assert row["c"] == ["für", "a_1", "b"] and row["m"] == ["bc", "de", "gh", "bc de", "de gh"]
    assert spark.createDataFrame([("", "x")], "c string, m string").select(X.message_tokens(F.col("m")).alias("m")).first()["m"] == []


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted(map(tuple, X.standardise(df, ["a", "b"]).collect())) == [(-1.0, 0.0), (1.0, 0.0)]


def test_commit_risk_training_saving_scoring(spark, tmp_path):
    rows = functions(spark)
    train = commit_risk.labelled_split(rows.filter("split = 'train'").unionByName(rows.filter("split = 'train'")))
    assert train.count() == rows.filter("split = 'train'").select("function_code").distinct().count()
    best, model, ranked, final = commit_risk.train(rows, ["Logistic Regression", "SVM"])
    table = {r["model"]: r for r in ranked.collect()}
    assert set(table) == {"Logistic Regression", "SVM"} and best == "Logistic Regression" and table[best]["selected"]
    assert table[best]["recall"] == 1.0 and final.first()["f1"] == 1.0 and final.first()["roc_auc"] == 1.0
    K.save_model(model, spark.createDataFrame([(best, P.SEED)], "model string, seed int"), str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m" / "model"))
    src = spark.createDataFrame([("r", "1", "a.c", "void f1(char *p) {\n strcpy(p, q); gets(p);\n}\nint g(int a) {\n return a + 1;\n}\n"), ("r", "1", "b.py", "x")],
                                "repo_id string, run_id string, file_path string, content string")
    dif = spark.createDataFrame([("r", "1", "a.c", "@@ -1 +1,6 @@"), ("r", "1", "b.py", "@@ -1 +1 @@")], "repo_id string, run_id string, file_path string, diff_text string")
    runs = spark.createDataFrame([("r", "1"), ("r", "2")], "repo_id string, run_id string")
    risks, summary = commit_risk.score_commits(runs, src, dif, again)
    got = {r["function_name"]: r for r in risks.collect()}
    assert got["f1"]["risk_score"] > got["g"]["risk_score"] and got["f1"]["top_risky_terms"] == ["strcpy", "gets"]
    totals = {r["run_id"]: r for r in summary.collect()}
    assert (totals["1"]["total_changed_files"], totals["1"]["total_changed_functions"], totals["2"]["status"]) == (1, 2, "SKIPPED")


def warnings(spark):
    words = F.element_at(F.array(F.lit("null pointer here"), F.lit("buffer overflow there"), F.lit("style of name")), (F.col("id") % 3 + 1).cast("int"))
    raw = spark.range(600).select(
        F.col("id").alias("ord"), F.lit("cppcheck").alias("toolName"), F.concat(F.lit("f"), F.col("id") % 60, F.lit(".c")).alias("filePath"),
        F.col("id").cast("string").alias("lineNumber"), F.concat(F.lit("id"), F.col("id") % 4).alias("warningType"), F.lit(None).cast("string").alias("cwe"),
        F.when(F.col("id") % 3 == 0, "error").otherwise("style").alias("warningSeverity"), words.alias("warningMessage"))
    return prioritiser.cppcheck_training(O.warning_to_alert(raw.filter("ord % 3 < 2"), True), O.warning_to_alert(raw.filter("ord % 3 = 2"), False))


def test_prioritiser_learns_and_ranks(spark):
    rows = warnings(spark)
    best, model, ranked, final = prioritiser.train(rows, "cppcheck", "file", trials=4, names=["Logistic Regression"])
    assert best == "Logistic Regression" and final.first()["macro_f1"] > 0.95
    alerts = rows.drop("priority", "label").na.fill("0", subset=["cwe"]).withColumn("alert_id", F.when(F.col("ord") == 0, "unseen").otherwise(F.col("alert_id")))
    out = M.prioritise(model, alerts).collect()
    assert len(out) == 600 and [r["priority"] for r in out] == sorted((r["priority"] for r in out), key=["HIGH", "MEDIUM", "LOW"].index)


def test_alerts_are_scored_once(spark, capsys):
    """The sort reads what was scored: it would score its input a second time to find its ranges."""
    from gatewright.operators.linear import LinearClassifier

    rows = warnings(spark).na.fill("0", subset=["cwe"])
    features = M.feature_model(rows, "cppcheck", 5)
    model = PipelineModel([*features.stages, LinearClassifier(classes=3, maxIter=2).fit(features.transform(rows))])
    out = M.prioritise(model, rows.drop("priority", "label"))
    out.explain()
    assert "Python" not in capsys.readouterr().out and out.count() == 600


def test_no_split_with_all_classes_is_an_error(spark):
    rows = warnings(spark).withColumn("file", F.when(F.col("label") == 2, "one.c").otherwise(F.col("file")))
    with pytest.raises(ValueError, match="required classes"):
        prioritiser.train(rows, "cppcheck", "file", trials=3)
