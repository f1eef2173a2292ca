"""Saved detectors: versions, what is fitted again, loading, and what a loaded detector says."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_detectors import history

from gatewright import params as P
from gatewright.plans import anomaly as N
from gatewright.plans import detector_store as S
from gatewright.session import scratch_dir
from gatewright.sources.keyed_store import KeyedStore

VERDICT = ["repo_id", "run_id", "anomaly_status", "is_anomaly", "anomaly_score", "selected_model", "reason", "failure_reason", "append_to_history"]


def sizes(past):
    return past.groupBy("repo_id").agg(F.count("*").alias("history_rows"))


@pytest.fixture(scope="module")
def trained(spark):
    h = history(spark).unionByName(history(spark, 1, 5).withColumn("repo_id", F.lit("young")))
    path = scratch_dir(spark, "detectors")
    past = h.filter("ts < 39")
    return h, past, path, S.train_detectors(past, path, 30).toPandas()


def test_loaded_detectors_say_what_detectors_in_memory_say(spark, trained):
    h, past, path, _ = trained
    last = h.filter("ts >= 36").withColumn("total_alerts", F.when(F.col("repo_id") == "r0", F.lit(900)).otherwise(F.col("total_alerts")))
    last = last.withColumns({
        "ml3_scoring_blocked": F.when(F.col("repo_id") == "r1", "True").otherwise("False"),
        "total_alerts": F.when((F.col("repo_id") == "r2") & (F.col("ts") == 38), F.lit(None)).otherwise(F.col("total_alerts")),
    }).unionByName(h.filter("repo_id = 'young' and ts = 4"))
    want = N.detect(past, last, 30).select(*VERDICT).collect()
    got = S.detect_saved(last, sizes(past), path, min_rows=30).select(*VERDICT).collect()
    assert sorted(got) == sorted(want) and len(got) == 13
    assert {r["anomaly_status"] for r in got} >= {"ANOMALOUS", "NOT_AVAILABLE", "FAILED"}


def test_report_has_every_model_and_who_was_skipped(trained):
    report = trained[3]
    for repo in ("r0", "r1", "r2"):
        rows = report[report.repo_id == repo].set_index("model")
        assert set(rows.index) == {N.FOREST, N.RBF, N.LOF} and (rows["status"] == "TRAINED").all()
        assert not rows.loc[N.LOF, "deployment_eligible"] and rows.loc[N.LOF, "exploratory_only"] and rows.loc[N.LOF, "reason"].startswith("Exploratory only")
        assert rows.loc[N.LOF, "normal_count"] + rows.loc[N.LOF, "anomaly_count"] == 31 and rows["selected"].sum() == 1
        assert rows.loc[[N.FOREST, N.RBF], "selection_rank"].tolist() in ([1, 2], [2, 1]) and rows["rows_available"].tolist() == [39] * 3
    young = report[report.repo_id == "young"].iloc[0]
    assert young["status"] == "SKIPPED" and young["reason"] == "Not enough valid historical rows for model training"


def test_metadata_says_what_a_detector_was_made_from(spark, trained):
    _, past, path, report = trained
    rows = {r["repo_id"]: r for r in S.detector_store(spark, path).read().collect()}
    prints = {r["repo_id"]: r["fingerprint"] for r in S.fingerprints(past).collect()}
    assert set(rows) == {"r0", "r1", "r2"}
    for repo, r in rows.items():
        m = r["metadata"]
        chosen = report[(report.repo_id == repo) & (report.selected == True)].iloc[0]  # noqa: E712
        assert m["selected_model"] == r["model"] == chosen["model"] and m["selection_metrics"]["f1"] == chosen["f1"]
        assert m["training_data_hash"] == r["fingerprint"] == prints[repo]
        assert (m["total_history_rows"], m["valid_training_rows"], m["excluded_history_rows"], m["exclusion_reasons"]) == (39, 39, 0, {})
        assert m["feature_columns"] == r["features"] == P.ANOMALY_FEATURES and m["history_timestamp_max"] == 38
        assert m["synthetic_anomaly_generation_method"]["recipe"].keys() == P.PERTURBATION.keys()
        assert (r["forest"] is None) == (r["model"] == N.RBF) and (r["rbf"] is None) == (r["model"] == N.FOREST)


def test_only_changed_histories_are_fitted_again(spark, trained):
    h, past, _, _ = trained
    path = scratch_dir(spark, "detectors")
    S.train_detectors(past.filter("repo_id <> 'r2'"), path, 30)
    store = S.detector_store(spark, path)
    first = {r["repo_id"]: r for r in store.index().collect()}
    assert store.versions() == [1] and set(first) == {"r0", "r1"}
    # nothing changed: no version; r1 gets a run, r2 appears
    again = S.train_detectors(past.filter("repo_id <> 'r2'"), path, 30)
    assert store.versions() == [1] and {r["status"] for r in again.collect()} == {"SKIPPED"}
    report = S.train_detectors(past.unionByName(h.filter("repo_id = 'r1' and ts = 39")), path, 30)
    assert {r["repo_id"] for r in report.filter("status = 'TRAINED'").collect()} == {"r1", "r2"}
    second = {r["repo_id"]: r for r in store.index().collect()}
    assert store.versions() == [1, 2] and second["r0"] == first["r0"] and second["r1"]["part"] != first["r1"]["part"]
    # an older version can still be read
    assert {r["repo_id"] for r in store.read(1).collect()} == {"r0", "r1"}
    assert sorted(r["repo_id"] for r in store.read().collect()) == ["r0", "r1", "r2"]


def test_missing_columns_and_missing_models_are_reported(spark, trained):
    h, past, path, _ = trained
    last = h.filter("ts = 39").drop("low_alerts", "alerts_per_file")
    rows = S.detect_saved(last, sizes(past), path, min_rows=30).collect()
    assert {(r["anomaly_status"], r["failure_reason"]) for r in rows} == {
        ("FAILED", "CURRENT_METRICS_SCHEMA_INCOMPATIBLE: missing feature columns low_alerts, alerts_per_file")}
    assert {r["reason"] for r in rows} == {"Current metrics schema is incompatible with trained model"}
    none = S.detect_saved(h.filter("ts = 39"), sizes(past), scratch_dir(spark, "no-detectors"), min_rows=30).collect()
    assert {(r["anomaly_status"], r["reason"]) for r in none} == {("NOT_AVAILABLE", "MODEL_NOT_TRAINED")}


def rows_of(spark, pairs):
    rows = spark.createDataFrame(pairs, "repo_id string, value long")
    return rows, rows.select("repo_id", F.col("value").cast("string").alias("fingerprint"))


def test_a_store_keeps_versions_and_few_parts(spark):
    store = KeyedStore(spark, scratch_dir(spark, "store"), most_parts=3)
    assert store.index() is None and store.read() is None and store.versions() == []
    want = {}
    for i in range(7):
        pairs = [(f"k{i}", i), ("hot", i)]
        want.update(pairs)
        store.publish(*rows_of(spark, pairs))
        assert {r["repo_id"]: r["value"] for r in store.read().collect()} == want
        assert store.index().select("part").distinct().count() <= 3
    assert store.changed(rows_of(spark, [("hot", 6), ("k1", 9), ("new", 1)])[1]).count() == 2
    store.remove_old(1)
    assert len(store.versions()) == 1 and len(store._files("parts/part=*")) <= 3
    assert {r["repo_id"]: r["value"] for r in store.read().collect()} == want


def test_what_a_dead_writer_left_is_not_seen(spark):
    store = KeyedStore(spark, scratch_dir(spark, "store"))
    store.publish(*rows_of(spark, [("a", 1)]))
    rows_of(spark, [("a", 2)])[0].write.parquet(f"{store.path}/parts/part=dead")
    # an index without its marker, as a writer that died leaves it
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        store.index().withColumn("part", F.lit("dead")).write.parquet(f"{store.path}/index/v=2")
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert store.versions() == [1] and [r["value"] for r in store.read().collect()] == [1]
    with pytest.raises(ValueError):
        store.index(2)
    assert store.publish(*rows_of(spark, [("b", 3)])) == 3
    assert {r["repo_id"]: r["value"] for r in store.read().collect()} == {"a": 1, "b": 3}
