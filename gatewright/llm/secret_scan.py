"""Secret scan: candidate strings, and a random forest that tells secrets from harmless strings. DataFrame functions only.

A candidate is whatever stands behind ``=`` or ``:`` and a name that tells of secrets, of any length and with or without digits; and
any other value of at least ``LEAST`` characters with a digit among them. A word may hold several. The forest sees the value's length and make-up, changes between character classes, how much of its letters are words
of the corpus, the document's path, and the words before and after.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.session import cut_lineage

LEAST = 10
#: Most frequent words of all texts that count as dictionary words.
DICTIONARY_WORDS = 5000
#: Labelled findings to learn from, at most; drawn by a hash of id and value.
TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 40, 8, 7
HELD_OUT = 5
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
#: A name, if any, and a value: ``key=value``, ``"key":"value"`` or the bare value.
VALUE = r"(?:(?<![A-Za-z_0-9\-])([A-Za-z_][A-Za-z_0-9\-]*)[\"'\\]*[=:]+[\"'\\]*)?(?<![A-Za-z0-9+/_=])([A-Za-z0-9+/_=@:.\-]{%d,}(?<![@:.\-]))" % LEAST
KEY_WORDS = "passw|passphrase|pwd|secret|token|api|key|auth|cred"
#: What stands behind an assignment: up to the closing quote, or up to a sign that parts values.
ASSIGNED = r"(?:\"([^\"]+)|'([^']+)|([^\s\"'\\,;&?<>(){}\[\]]*[^\s\"'\\,;&?<>(){}\[\].:=]))"
SECRET_NAME = r"(?i)(?<![A-Za-z_0-9\-])([A-Za-z_0-9\-]*(?:%s|pass)[A-Za-z_0-9\-]*)" % KEY_WORDS
KEYED = SECRET_NAME + r"[\"'\\]*[=:]+>?\\?" + ASSIGNED
#: The value of ``key = value``, where blanks part key, sign and value.
BEHIND = r"^\\?" + ASSIGNED
NEIGHBOUR_BINS = 8
FEATURES = [
    "length", "digits", "uppers", "lowers", "signs", "hexes", "distinct", "changes", "dots", "ats", "coverage", "path_bin",
    "path_marks", "named", "key_before", "assigned", "before_word", "after_word", "before_length", "after_length", "before_bin",
]


def values(word: Column, before: Column, before2: Column) -> Column:
    """Array of (name, value): the candidates in a word that stands behind two others."""

    def found(text: Column, pattern: str, name: int, *groups: int) -> Column:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
        names = F.regexp_extract_all(text, F.lit(pattern), F.lit(name)) if name else F.transform(parts[0], lambda p: F.lit(""))
        return F.transform(names, lambda n, j: F.struct(F.lower(n).alias("name"), F.concat(*[F.get(p, j) for p in parts]).alias("value")))

    none = F.filter(F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("value"))), lambda x: F.lit(False))
    # what one kind of candidate took, the next does not see
    named = word.rlike("[=:]") & word.rlike("(?i)pass|" + KEY_WORDS)
    left = F.when(named, F.regexp_replace(word, KEYED, " ")).otherwise(word)
    sign = before.isin("=", ":", ":=", "=>", "==") & before2.rlike(SECRET_NAME)
    follows = sign | (before.rlike("[=:]>?$") & before.rlike(SECRET_NAME + r"[\"'\\]*[=:]+>?$"))
    rest = F.when(follows, F.regexp_replace(left, BEHIND, " ")).otherwise(left)
    digits = (F.length(word) >= LEAST) & word.rlike("[0-9]")
    return F.array_distinct(F.concat(
        F.when(named, found(word, KEYED, 1, 2, 3, 4)).otherwise(none),
        F.when(follows, found(left, BEHIND, 0, 1, 2, 3)).otherwise(none),
        F.when(digits, F.filter(found(rest, VALUE, 1, 2), lambda x: x["value"].rlike("[0-9]"))).otherwise(none),
    ))


def candidates(docs: DataFrame, id_column: str, text_column: str, path_column: str) -> DataFrame:
    """(doc_id, position, name, value, path, before2, before, after): a row per candidate; ``position`` counts words from 0."""
    words = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(path_column).cast("string"), F.lit("")).alias("path"),
        F.split(F.coalesce(F.col(text_column), F.lit("")), BLANKS, -1).alias("w"),
    )
    hit = F.flatten(F.transform("w", lambda w, i: F.transform(
        values(w, F.lower(F.coalesce(F.get("w", i - 1), F.lit(""))), F.lower(F.coalesce(F.get("w", i - 2), F.lit("")))),
        lambda v: F.struct(i.alias("i"), v["name"].alias("name"), v["value"].alias("value")),
    )))
    rows = words.withColumn("hit", F.explode(hit))

    def near(step: int) -> Column:
        return F.lower(F.coalesce(F.get("w", F.col("hit.i") + step), F.lit("")))

    blank = F.when(F.get("w", F.lit(0)) == "", F.lit(1)).otherwise(F.lit(0))
    return rows.select(
        "doc_id", (F.col("hit.i") - blank).cast("long").alias("position"), "path",
        "hit.name", "hit.value",
        near(-2).alias("before2"), near(-1).alias("before"), near(1).alias("after"),
    )


def dictionary(docs: DataFrame, text_column: str, most: int = DICTIONARY_WORDS) -> DataFrame:
    """One row: hashes of the corpus's most frequent words of three letters or more, at most ``most`` of them."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_column), F.lit(""))), "[^\\p{L}]+")).alias("word"))
    counts = words.where(F.length("word") >= 3).groupBy(F.xxhash64("word").alias("word")).count()
    top = counts.orderBy(F.desc("count"), "word").limit(most)
    return top.agg(F.sort_array(F.collect_list("word")).alias("words"))


def share(pattern: str) -> Column:
    """Share of the value's characters that match."""
    return (F.length("value") - F.length(F.regexp_replace("value", pattern, ""))) / F.length("value")


def with_features(found: DataFrame, words: Column) -> DataFrame:
    """The forest's inputs for each candidate; ``words``: an array of dictionary hashes."""
    classes = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9"), "[^aA9]", "."
    )
    runs = F.length(F.regexp_replace(classes, "(.)\\1+", "$1"))
    parts = F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda p: F.length(p) >= 3)
    known = F.filter(parts, lambda p: F.array_contains(words, F.xxhash64(p)))
    letters = F.aggregate(known, F.lit(0), lambda n, p: n + F.length(p))

    def bare(column: str) -> Column:
        return F.regexp_replace(column, "[^\\p{L}]", "")

    context = F.concat_ws(" ", "name", "before2", "before")
    columns = {
        "length": F.length("value"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"), "hexes": share("[0-9a-f]"), "dots": share("\\."), "ats": share("@"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        "changes": (runs - 1) / F.length("value"),
        "coverage": letters / F.length("value"),
        "path_bin": F.pmod(F.xxhash64("path"), F.lit(NEIGHBOUR_BINS)),
        "path_marks": F.lower("path").rlike("test|example|sample|doc|mock").cast("int"),
        "named": (F.col("name") != "").cast("int"),
        "key_before": context.rlike(KEY_WORDS).cast("int"),
        "assigned": ((F.col("name") != "") | F.col("before").isin("=", ":", ":=", "=>")).cast("int"),
        "before_word": F.array_contains(words, F.xxhash64(bare("before"))).cast("int"),
        "after_word": F.array_contains(words, F.xxhash64(bare("after"))).cast("int"),
        "before_length": F.length("before"), "after_length": F.length("after"),
        "before_bin": F.pmod(F.xxhash64("before"), F.lit(NEIGHBOUR_BINS)),
    }
    return found.select("*", *[c.cast("double").alias(f"f_{n}") for n, c in columns.items()])


def known_findings(found: DataFrame) -> DataFrame:
    """Candidates whose format settles what they are, as labelled findings (column ``label``): a seed where no review exists.

    Fixed values: access keys ``AKIA`` and 16 characters, hexadecimal values behind a password or token name are secrets;
    network addresses, mail addresses and plain numbers are not.
    """
    context = F.concat_ws(" ", "name", "before2", "before")
    secret = F.col("value").rlike("^AKIA[0-9A-Z]{16}$") | (F.col("value").rlike("^[0-9a-f]{16,}$") & context.rlike("passw|token"))
    harmless = F.col("value").rlike("^[0-9.:]+$") | F.col("value").rlike("^[^@]+@[^@]+\\.[a-z]+$")
    return found.withColumn("label", F.when(secret, 1).when(harmless, 0)).where("label is not null")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


@dataclass
class SecretModel:
    """The fitted forest, or a constant where the labels are all alike."""

    pipeline: PipelineModel | None
    constant: float = 0.0

    def score(self, rows: DataFrame) -> DataFrame:
        if self.pipeline is None:
            return rows.withColumn("probability", F.lit(self.constant))
        out = self.pipeline.transform(rows)
        return out.withColumn("p", vector_to_array("probability")[1]).drop("probability").withColumnRenamed("p", "probability")


def fit(labelled: DataFrame, most: int = TRAINING_ROWS) -> SecretModel:
    """Learn from labelled findings with their features: a bounded draw of those that are not held out."""
    inputs = [f"f_{n}" for n in FEATURES]
    drawn = labelled.where(~held_out()).orderBy(F.xxhash64("doc_id", "value"), "doc_id", "position").limit(most)
    data = cut_lineage(drawn.select(F.col("label").cast("int").alias("label"), *inputs), "findings")
    n = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return SecretModel(None, 1.0 if n.get(1) else 0.0)
    forest = RandomForestClassifier(labelCol="label", featuresCol="inputs", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return SecretModel(Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="inputs"), forest]).fit(data))


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    path_column: str = "source",
    findings: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, position, name, value, probability, is_secret, held_out): every candidate of every row of ``docs``.

    ``findings`` (doc_id, value, label) are reviewed findings to learn from; without them :func:`known_findings` labels what its
    format settles. A value found twice in a document under different labels counts as a secret. Null and blank texts have no
    candidates; null paths are the empty path; null ids and repeated rows keep their candidates. With no labels of both classes
    every candidate gets the one label there is (0 if none). Other columns are not read.

    Scale: texts stay where they are. Word hashes are counted with partial aggregates; only candidates are written out.
    The dictionary is one row of at most ``DICTIONARY_WORDS`` hashes.
    """
    found = cut_lineage(candidates(docs, id_column, text_column, path_column), "candidates")
    words = dictionary(docs, text_column).first()["words"]
    rows = cut_lineage(with_features(found, F.lit(words) if words else F.array().cast("array<bigint>")), "candidate-features")
    if findings is None:
        labelled = known_findings(rows)
    else:
        reviewed = findings.where(F.col("label").isin(0, 1)).groupBy("doc_id", "value").agg(F.max("label").alias("label"))
        labelled = rows.join(reviewed, ["doc_id", "value"])
    out = fit(labelled).score(rows)
    return out.select(
        "doc_id", "position", "name", "value", "probability",
        (F.col("probability") >= 0.5).cast("int").alias("is_secret"), held_out().alias("held_out"),
    )
