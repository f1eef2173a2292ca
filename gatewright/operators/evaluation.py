"""Counts, class shares and classifier metrics as aggregates (by any grouping, e.g. model or repository)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions.numbers import round_half_up
from gatewright.operators.ranking import running_before, top_per_group


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))


def class_distribution(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Count and share (six digits) of each class, zero-filled, from one aggregation."""
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(label) == x).alias(f"n{x}") for x in P.LABELS])
    total = _add([F.col(f"n{x}") for x in P.LABELS])
    rows = F.array(
        *[
            F.struct(
                F.lit(x).alias("label"),
                F.col(f"n{x}").alias("count"),
                round_half_up(_ratio(F.col(f"n{x}"), total), 6).alias("percent"),
            )
            for x in P.LABELS
        ]
    )
    return counts.select(*by, F.inline(rows))


def split_divergence(df: DataFrame, by: list[str], split: str = "split", label: str = "label") -> DataFrame:
    """Sum over splits of the L1 distance between the split's and the whole table's class shares."""
    per_split = df.groupBy(*by, split).agg(*[F.count_if(F.col(label) == x).alias(f"n{x}") for x in P.LABELS])
    whole = per_split.groupBy(*by).agg(*[F.sum(f"n{x}").alias(f"w{x}") for x in P.LABELS])
    joined = per_split.join(whole, by) if by else per_split.join(F.broadcast(whole))  # without groups one row
    n, w = _add([F.col(f"n{x}") for x in P.LABELS]), _add([F.col(f"w{x}") for x in P.LABELS])
    distance = _add([
        F.abs(round_half_up(_ratio(F.col(f"w{x}"), w), 6) - round_half_up(_ratio(F.col(f"n{x}"), n), 6)) for x in P.LABELS
    ])
    return joined.withColumn("d", distance).groupBy(*by).agg(round_half_up(F.sum("d"), 6).alias("divergence"))


def coverage_stats(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows and exact distinct counts."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in columns]
    )


def annotation_stats(df: DataFrame) -> DataFrame:
    """Ten counts over annotated alerts, one pass."""
    stem = F.regexp_replace(F.substring_index("source_file", "/", -1), r"(?<=.)\.[^.]+$", "")
    matched = F.coalesce("has_plist_match", F.lit(False))
    return df.agg(
        F.count_if(matched).alias("alerts_with_plist_match"),
        F.count_if(~matched).alias("alerts_without_plist_match"),
        F.count_if(F.coalesce("source_function", F.lit("")) != "").alias("alerts_with_source_function"),
        F.count_if(F.col("ground_truth_origin") == "plist_source_function").alias("alerts_classified_from_source_function"),
        F.count_if(F.col("ground_truth_origin") == "enclosing_function").alias("alerts_classified_from_enclosing_source_function"),
        F.count_if(F.col("ground_truth_status") == "bad").alias("bad_count"),
        F.count_if(F.col("ground_truth_status") == "good").alias("good_count"),
        F.count_if(F.col("ground_truth_status") == "unknown").alias("unknown_count"),
        F.countDistinct(stem).alias("unique_case_ids_before_corrected_normalization"),
        F.countDistinct("juliet_case_id").alias("unique_case_ids_after_corrected_normalization"),
    )


def confusion(df: DataFrame, by: list[str], labels: list[int], truth: str = "label", pred: str = "prediction") -> DataFrame:
    """Confusion cells ``c<truth><prediction>`` per group: one partial aggregation, no per-label passes."""
    cells = [
        F.count_if((F.col(truth) == t) & (F.col(pred) == p)).alias(f"c{t}{p}") for t in labels for p in labels
    ]
    return df.groupBy(*by).agg(*cells)


def confusion_matrix(cells: DataFrame, by: list[str], labels: list[int]) -> DataFrame:
    """The cells as an array of rows (true class) of arrays (predicted class)."""
    return cells.select(*by, F.array(*[F.array(*[F.col(f"c{t}{p}") for p in labels]) for t in labels]).alias("confusion_matrix"))


def class_scores(cells: DataFrame, by: list[str], labels: list[int]) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion cells; 0 where a denominator is 0."""
    columns = []
    for x in labels:
        tp = F.col(f"c{x}{x}")
        said = _add([F.col(f"c{t}{x}") for t in labels])
        real = _add([F.col(f"c{x}{p}") for p in labels])
        columns += [
            _ratio(tp, said).alias(f"precision_{x}"),
            _ratio(tp, real).alias(f"recall_{x}"),
            _ratio(tp * 2, said + real).alias(f"f1_{x}"),
            real.alias(f"support_{x}"),
            said.alias(f"predicted_{x}"),
        ]
    return cells.select(*by, *[F.col(f"c{t}{p}") for t in labels for p in labels], *columns)


def multi_metrics(df: DataFrame, by: list[str], truth: str = "label", pred: str = "prediction") -> DataFrame:
    """Three-class metrics: accuracy, macro and weighted F1, recall of class 2, per-class scores, confusion cells.

    Macro F1 averages over the classes that occur in truth or prediction.
    """
    labels = P.LABELS
    scores = class_scores(confusion(df, by, labels, truth, pred), by, labels)
    total = _add([F.col(f"support_{x}") for x in labels])
    right = _add([F.col(f"c{x}{x}") for x in labels])
    used = [((F.col(f"support_{x}") + F.col(f"predicted_{x}")) > 0).cast("int") for x in labels]
    return scores.select(
        *by,
        _ratio(right, total).alias("accuracy"),
        _ratio(_add([F.col(f"f1_{x}") for x in labels]), _add(used)).alias("macro_f1"),
        _ratio(_add([F.col(f"f1_{x}") * F.col(f"support_{x}") for x in labels]), total).alias("weighted_f1"),
        F.col("recall_2").alias("high_recall"),
        *[F.col(f"{m}_{x}") for x in labels for m in ("precision", "recall", "f1", "support")],
        *[F.col(f"c{t}{p}") for t in labels for p in labels],
    )


def binary_metrics(df: DataFrame, by: list[str], truth: str = "label", pred: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp with accuracy, precision, recall, F1 and false-positive rate."""
    c = confusion(df, by, [0, 1], truth, pred).select(
        *by, F.col("c00").alias("tn"), F.col("c01").alias("fp"), F.col("c10").alias("fn"), F.col("c11").alias("tp")
    )
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return c.select(
        *by, "tn", "fp", "fn", "tp",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
        _ratio(fp, fp + tn).alias("false_positive_rate"),
    )


def _score_counts(df: DataFrame, by: list[str], truth: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: ties collapse before anything is ordered."""
    return df.groupBy(*by, score).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg")
    )


def roc_auc(df: DataFrame, by: list[str], truth: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve; null where only one class occurs.

    Each negative wins against the positives above it and half of those tied with it.
    """
    counts = _score_counts(df, by, truth, score)
    placed = running_before(counts, by, [F.col(score)], {"neg": F.col("neg"), "pos": F.col("pos")})
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    sums = placed.groupBy(*by).agg(F.sum(won).alias("__u"), F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    pairs = F.col("__p").cast("double") * F.col("__n").cast("double")
    return sums.select(*by, F.when(pairs > 0, F.col("__u") / pairs).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str], truth: str = "label", score: str = "score") -> DataFrame:
    """Sum over distinct scores, from high to low, of recall gain times precision."""
    counts = _score_counts(df, by, truth, score)
    placed = running_before(
        counts.withColumn("__down", -F.col(score)), by, [F.col("__down")],
        {"pos": F.col("pos"), "all": F.col("pos") + F.col("neg")},
    )
    tp, seen = F.col("pos_before") + F.col("pos"), F.col("all_before") + F.col("pos") + F.col("neg")
    gain = F.when(F.col("pos_total") > 0, F.col("pos") / F.col("pos_total") * tp / seen).otherwise(F.lit(0.0))
    return placed.groupBy(*by).agg(F.sum(gain).alias("average_precision"))


def score_range(df: DataFrame, by: list[str], pred: str = "prediction", score: str = "score") -> DataFrame:
    """Normal and anomaly counts, anomaly rate and the range of scores (predictions are 1 and -1)."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        F.count_if(F.col(pred) == 1).alias("normal_count"),
        F.count_if(F.col(pred) == -1).alias("anomaly_count"),
        round_half_up(F.count_if(F.col(pred) == -1) / n, 4).alias("anomaly_rate"),
        round_half_up(F.min(score), 4).alias("score_min"),
        round_half_up(F.max(score), 4).alias("score_max"),
    )


# What each selection looks at, first key first; the name breaks the last ties.
SELECTION = {
    "commit_risk": [("recall", False)],
    "alert_priority": [("macro_f1", False), ("high_recall", False), ("weighted_f1", False), ("accuracy", False)],
    "anomaly": [("f1", False), ("recall", False), ("false_positive_rate", True)],
}


def rank_models(evaluation: DataFrame, policy: str, by: list[str] | None = None, first: str = "model") -> DataFrame:
    """Add ``selection_rank`` and ``selected``; equal candidates keep the order of ``first``."""
    from pyspark.sql import Window

    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in SELECTION[policy]]
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a handful of candidates per group
    rank = F.row_number().over(window.orderBy(*keys, F.col(first).asc()))
    return evaluation.withColumn("selection_rank", rank).withColumn("selected", F.col("selection_rank") == 1)


def best_model(evaluation: DataFrame, policy: str, by: list[str], first: str = "model") -> DataFrame:
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in SELECTION[policy]]
    return top_per_group(evaluation, by, [*keys, F.col(first).asc()], 1).drop("rn")
