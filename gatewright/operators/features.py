"""Text and number features. Vocabularies are chosen by aggregates with a total order, then handed to MLlib stages."""

from __future__ import annotations

from itertools import chain

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions.text import WORD

CODE_TERMS = 5000
MESSAGE_TERMS = 3000


def code_tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores; case kept."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"[{WORD}]+"), F.lit(0))


def message_tokens(c: Column) -> Column:
    """Lower-case words of two or more characters followed by their neighbouring pairs."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)


def vocabulary(df: DataFrame, tokens: Column, size: int) -> DataFrame:
    """(term, total, df): the ``size`` most frequent terms, ties in alphabetical order.

    Each text sends its tokens and, marked, its distinct tokens; both counts are combined in the map tasks, so the shuffle
    holds terms, not tokens, and nothing is grouped by text.
    """
    listed = df.select(tokens.alias("t"))
    every = F.transform("t", lambda x: F.struct(x.alias("term"), F.lit(0).alias("once")))
    once = F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), F.lit(1).alias("once")))
    marked = listed.select(F.inline(F.concat(every, once)))
    totals = marked.groupBy("term").agg(F.count_if(F.col("once") == 0).alias("total"), F.count_if(F.col("once") == 1).alias("df"))
    return totals.orderBy(F.desc("total"), F.asc("term")).limit(size)


def inverse_frequency(n: Column, df: Column) -> Column:
    """Smoothed: ``ln((1 + n) / (1 + df)) + 1``."""
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + F.lit(1.0)


def tfidf_rows(df: DataFrame, key: str, tokens: Column, size: int) -> DataFrame:
    """(key, term, tfidf) with unit length per text: the relational form, used for checks and reports.

    Only the vocabulary, at most ``size`` terms, is shuffled and comes to the driver. Each text's terms are counted in its row, as the
    saved model does, and weighted there; nothing is grouped by text. Rows of equal key are texts of their own.
    """
    n = df.count()
    rows = vocabulary(df, tokens, size).withColumn("idf", inverse_frequency(F.lit(n), F.col("df"))).orderBy("term").collect()
    if not rows:
        return df.select(key, F.lit("").alias("term"), F.lit(0.0).alias("tfidf")).limit(0)
    terms, weights = [r["term"] for r in rows], [r["idf"] for r in rows]
    counted = CountVectorizerModel.from_vocabulary(terms, inputCol="__tokens", outputCol="__counts").transform(
        df.select(key, F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("__tokens"))
    )
    weighted = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="__counts", outputCol="__weighted").transform(counted)
    unit = Normalizer(p=2.0, inputCol="__weighted", outputCol="__unit").transform(weighted).select(key, F.unwrap_udt("__unit").alias("__v"))
    pairs = unit.select(key, F.inline(F.arrays_zip(F.col("__v.indices").alias("i"), F.col("__v.values").alias("tfidf"))))
    names = F.array(*[F.lit(t) for t in terms])
    return pairs.select(key, F.element_at(names, F.col("i") + 1).alias("term"), "tfidf")


def _token_stage(kind: str, column: str, output: str) -> SQLTransformer:
    """A stage that can be saved with the model, unlike a Python function."""
    word = WORD.replace("\\", "\\\\")  # the statement reads a backslash pair as one
    if kind == "code":
        expr = f"regexp_extract_all(coalesce({column}, ''), '[{word}]+', 0)"
    else:
        words = f"regexp_extract_all(lower(coalesce({column}, '')), '[{word}]{{2,}}', 0)"
        last = f"greatest(size({words}) - 1, 0)"
        expr = (
            f"concat({words}, zip_with(slice({words}, 1, {last}), slice({words}, 2, {last}), "
            "(a, b) -> concat(a, ' ', b)))"
        )
    return SQLTransformer(statement=f"SELECT *, {expr} AS {output} FROM __THIS__")


def fit_tfidf(train: DataFrame, column: str, kind: str, size: int, output: str) -> list[Transformer]:
    """Fitted TF-IDF stages for a text column. Only the vocabulary (at most ``size`` terms) comes to the driver."""
    tokens = code_tokens(F.col(column)) if kind == "code" else message_tokens(F.col(column))
    n = train.count()
    rows = vocabulary(train.select(column), tokens, size).withColumn("idf", inverse_frequency(F.lit(n), F.col("df"))).orderBy("term").collect()
    terms, weights = ([r["term"] for r in rows], [r["idf"] for r in rows]) if rows else (["__none__"], [1.0])
    t, c, w = f"__{output}_tokens", f"__{output}_counts", f"__{output}_weighted"
    return [
        _token_stage(kind, column, t),
        CountVectorizerModel.from_vocabulary(terms, inputCol=t, outputCol=c),
        ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=c, outputCol=w),
        Normalizer(p=2.0, inputCol=w, outputCol=output),
    ]


def fit_code_tfidf(train: DataFrame, column: str = "function_code", size: int = CODE_TERMS) -> PipelineModel:
    return PipelineModel(fit_tfidf(train, column, "code", size, "features"))


def scaling_stats(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation per column; a column without variance is divided by 1."""
    return df.groupBy(*(by or [])).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_dev") for c in columns],
    )


def scaled(column: str) -> Column:
    dev = F.col(f"{column}_dev")
    return (F.col(column) - F.col(f"{column}_mean")) / F.when(dev < 1e-9, F.lit(1.0)).otherwise(dev)


def standardise(df: DataFrame, columns: list[str], by: list[str] | None = None, fitted: DataFrame | None = None) -> DataFrame:
    """Columns as (x - mean) / deviation, by the statistics of ``fitted`` (default: the table's own)."""
    stats = scaling_stats(fitted if fitted is not None else df, columns, by)
    joined = df.join(stats, by) if by else df.join(F.broadcast(stats))  # without groups this is one row
    return joined.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def balanced_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (classes * n_class). Class counts are a handful of rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    weights = counts.join(F.broadcast(total)).select(
        label, (F.col("__all") / (F.col("__k") * F.col("__n"))).cast("double").alias("weight")
    )
    return df.join(F.broadcast(weights), label)


def class_weights(df: DataFrame, label: str = "label") -> Column:
    """The same weights as a literal map, for fitting several models on one table."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    table = {k: total / (len(counts) * v) for k, v in counts.items()}
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return pairs[F.col(label)]


def feature_columns(variant: str) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns of a prioritiser."""
    if variant == "cppcheck":
        return ["severity_score", "has_cwe", *P.FLAG_COLUMNS, "is_cppcheck"], ["alert_id", "severity", "cwe"]
    return ["severity_score", "has_cwe", *P.FLAG_COLUMNS, "is_clang"], ["alert_id", "severity"]
