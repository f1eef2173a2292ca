"""Splits, ranks and classifier metrics against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from gatewright.operators import evaluation as E
from gatewright.operators import quality as Q
from gatewright.operators import splits as S
from gatewright.operators.history import prior_baseline
from gatewright.operators.ranking import exact_quantile, global_rank_by_hash, prefix_digits, ranges_of, running_before


def test_split_sizes_match_published_group_counts():
    assert S.expected_sizes(13779) == (8267, 2756, 2756)
    assert S.expected_sizes(4374) == (2624, 875, 875)


def test_grouped_split_is_exact_and_leak_free(spark):
    rows = spark.range(3000).select((F.col("id") % 437).cast("string").alias("g"), (F.col("id") % 3).cast("int").alias("label"))
    split = S.grouped_split(rows, "g")
    sizes = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()}
    assert (sizes["train"], sizes["valid"], sizes["test"]) == S.expected_sizes(437)
    assert Q.split_overlap(split, ["g"]).first().asDict() == {"train_valid": 0, "train_test": 0, "valid_test": 0}
    again = S.grouped_split(rows.repartition(5), "g")
    assert split.select("g", "split").distinct().exceptAll(again.select("g", "split").distinct()).isEmpty()


def test_split_search_matches_ranking_every_group(spark):
    rows = spark.range(2500).select((F.col("id") % 211).cast("string").alias("g"), F.floor(F.sqrt(F.col("id") % 9)).cast("int").alias("label"))
    table = {r["seed"]: r for r in S.search_split(rows, "g", trials=9, prefix=1).collect()}
    for seed in range(42, 51):
        split = S.grouped_split(rows, "g", seed)
        counts = {(r["split"], r["label"]): r["n"] for r in split.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
        for s in ("train", "valid", "test"):
            for x in (0, 1, 2):
                assert table[seed][f"{s}_n{x}"] == counts[(s, x)]
    best = min(table.values(), key=lambda r: (r["divergence"], r["seed"]))
    assert best["trial_rank"] == 1


def test_split_search_fails_when_a_class_has_one_group(spark):
    rows = spark.range(300).select((F.col("id") % 30).cast("string").alias("g"), F.when(F.col("id") % 30 == 7, 2).otherwise((F.col("id") / 30).cast("int") % 2).alias("label"))
    assert S.search_split(rows, "g", trials=5).isEmpty()


def test_rank_by_hash(spark):
    names = [str(i) for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names], "g string").withColumn("h", F.md5("g"))
    got = {r["g"]: r["rank"] for r in global_rank_by_hash(df, [], "h").collect()}
    order = sorted(names, key=lambda n: hashlib.md5(n.encode()).hexdigest())
    assert [got[n] for n in order] == list(range(1, 501))


def test_running_sums_and_quantiles(spark):
    rng = np.random.default_rng(1)
    data = [(("hot" if i < 800 else f"g{i % 5}"), int(rng.integers(0, 60)), i, float(rng.normal())) for i in range(1000)]
    df = spark.createDataFrame(data, "g string, t int, i int, v double")
    got = {r["i"]: (r["s_before"], r["s_total"]) for r in running_before(df, ["g"], [F.col("t"), F.col("i")], {"s": F.col("v")}, 16).collect()}
    for g in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == g), key=lambda d: (d[1], d[2]))
        total = 0.0
        for d in mine:
            assert abs(got[d[2]][0] - total) < 1e-9
            total += d[3]
        assert abs(got[mine[0][2]][1] - total) < 1e-9
    cuts = {r["g"]: r["cut"] for r in exact_quantile(df, ["g"], "v", 0.1).collect()}
    for g, cut in cuts.items():
        assert abs(cut - np.quantile([d[3] for d in data if d[0] == g], 0.1)) < 1e-12


def test_ranges_are_bounded_whatever_the_ties(spark):
    # one group holds most rows, all at one time, a third of them equal in every key
    rows = spark.range(12_000).selectExpr(
        "if(id % 10 = 0, concat('g', id % 7), 'hot') AS g", "0 AS t", "if(id % 3 = 0, 'tie', cast(id as string)) AS tie", "1 AS v", "id")
    cut = ranges_of(rows, ["g"], ["t", "tie"], 500)
    sizes = [r["count"] for r in cut.groupBy("__range").count().collect()]
    assert sum(sizes) == 12_000 and max(sizes) < 1000 and len(sizes) >= 20
    placed = running_before(rows, ["g"], [F.col("t"), F.col("tie")], {"n": F.col("v")}, 500)
    for r in placed.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("n_before").alias("d"), F.max("n_before").alias("m"), F.max("n_total").alias("all")).collect():
        assert r["n"] == r["d"] == r["m"] + 1 == r["all"]
    late = placed.alias("a").where("g = 'hot' and tie <> 'tie'").selectExpr("tie", "n_before").orderBy("tie").collect()
    assert [r["n_before"] for r in late] == sorted(r["n_before"] for r in late)


def test_running_sums_of_null_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7), (None, None, 1)], "g string, t int, v int")
    for most in (1, 100):
        got = {(r["g"], r["t"]): (r["s_before"], r["s_total"]) for r in running_before(df, ["g"], [F.col("t")], {"s": F.col("v")}, most).collect()}
        assert got == {(None, None): (0, 12), (None, 1): (1, 12), (None, 2): (6, 12), ("a", 1): (0, 7)}
    assert running_before(df.limit(0), ["g"], [F.col("t")], {"s": F.col("v")}).count() == 0


def test_prefixes_follow_the_number_of_rows():
    assert [prefix_digits(n) for n in (0, 1, 4096, 5000, 65_536, 70_000, 10**9)] == [1, 1, 1, 1, 1, 2, 5]


def test_deviation_of_large_counts_does_not_cancel(spark):
    values = [1e9 + x for x in (0.0, 1.0, 2.0, 1.0, 0.0, 3.0)]
    rows = spark.createDataFrame([("r", f"{i}", i, v) for i, v in enumerate(values)], "repo_id string, run_id string, ts long, a double")
    got = {r["ts"]: (r["a_prior_mean"], r["a_prior_std"]) for r in prior_baseline(rows, ["a"]).collect()}
    assert got[0] == (None, None)
    for i in range(1, 6):
        assert abs(got[i][0] - np.mean(values[:i])) < 1e-5 and abs(got[i][1] - np.std(np.array(values[:i]) - 1e9)) < 2e-6


def test_first_policy_takes_the_lowest_seed(spark):
    rows = spark.range(400).select((F.col("id") % 60).cast("string").alias("g"), (F.col("id") % 3).cast("int").alias("label"))
    table = S.search_split(rows, "g", trials=500, policy="first").collect()
    assert [r["seed"] for r in sorted(table, key=lambda r: r["trial_rank"])] == sorted(r["seed"] for r in table)
    other = S.search_split(rows, "g", trials=500, policy="first", prefix=3).collect()
    assert sorted(map(tuple, table)) == sorted(map(tuple, other))


def test_auc_and_average_precision(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, s)] + [("one", 1, 0.5)], "m string, label int, score double")
    auc = {r["m"]: r["roc_auc"] for r in E.roc_auc(df, ["m"]).collect()}
    pairs = [(1.0 if p > n else 0.5 if p == n else 0.0) for p in s[y == 1] for n in s[y == 0]]
    assert abs(auc["m"] - np.mean(pairs)) < 1e-12 and auc["one"] is None
    ap = {r["m"]: r["average_precision"] for r in E.average_precision(df, ["m"]).collect()}
    want, seen = 0.0, 0
    for cut in sorted(set(s), reverse=True):
        tp = int(((s >= cut) & (y == 1)).sum())
        want += (tp - seen) / y.sum() * tp / (s >= cut).sum()
        seen = tp
    assert abs(ap["m"] - want) < 1e-12 and ap["one"] == 1.0


def test_metrics_with_empty_denominators(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("a", 0, 0)], "m string, label int, prediction int")
    r = E.multi_metrics(df, ["m"]).first()
    assert (r["precision_1"], r["recall_1"], r["f1_2"], r["high_recall"]) == (0, 0, 0, 0)
    assert abs(r["macro_f1"] - 0.4) < 1e-12 and abs(r["accuracy"] - 2 / 3) < 1e-12
    b = E.binary_metrics(df, ["m"]).first()
    assert (b["tn"], b["fp"], b["fn"], b["tp"], b["precision"], b["false_positive_rate"]) == (2, 0, 1, 0, 0, 0)
    assert E.confusion_matrix(E.confusion(df, ["m"], [0, 1]), ["m"], [0, 1]).first()["confusion_matrix"] == [[2, 0], [1, 0]]


def test_model_ranking_ties(spark):
    rows = [("b", 0.5, 0.5, 0.5, 0.5), ("a", 0.5, 0.5, 0.5, 0.5), ("c", 0.5, 0.6, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "model string, macro_f1 double, high_recall double, weighted_f1 double, accuracy double")
    got = {r["model"]: r["selection_rank"] for r in E.rank_models(df, "alert_priority").collect()}
    assert got == {"c": 1, "a": 2, "b": 3}


def test_group_sample(spark):
    rows = spark.range(900).select(F.concat(F.lit("C/CWE121_Stack_Based_Buffer_Overflow/s01/t"), F.floor(F.col("id") / 2), F.lit("k"), F.when(F.col("id") % 2 == 0, "_bad").otherwise("_goodG2B"), F.lit(".c")).alias("source_file"))
    got = S.sample_groups(rows, n=50)
    assert got.select("case_group").distinct().count() == 50 and got.count() == 100


def test_a_boundary_outside_its_window_is_found_all_the_same(spark, monkeypatch):
    rows = spark.range(2500).select((F.col("id") % 611).cast("string").alias("g"), (F.col("id") % 3).cast("int").alias("label"))
    rows = rows.withColumn("g", F.when(F.col("g") != "7", F.col("g")))  # a group without a name
    usual = sorted(map(tuple, S.search_split(rows, "g", trials=15).collect()))
    for reach in (0, 0.3, 100):
        monkeypatch.setattr(S, "DEVIATIONS", reach)
        assert sorted(map(tuple, S.search_split(rows, "g", trials=15).collect())) == usual
    assert len(usual) == 15


def test_windows_of_a_split_search_get_narrow():
    shares = []
    for groups in (10**3, 10**5, 10**7):
        a, b, c, d = (int(x, 16) / 16**8 for x in S._windows(groups, [groups // 5, groups * 2 // 5], 8))
        assert a < 0.2 < b <= c < 0.4 < d
        shares.append(b - a + d - c)
    assert shares[1] < shares[0] / 5 and shares[2] < shares[1] / 5
