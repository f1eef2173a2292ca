"""Path and diagnostic matching without nested loops.

"Accept only if exactly one distinct candidate fits" needs just the smallest and the largest candidate, so every step
ends in a partial aggregate and no list of candidates is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.functions import paths, text
from gatewright.session import cut_lineage


def _tails(paths_: DataFrame, lengths: DataFrame) -> DataFrame:
    """``paths_`` (repo_id, path, ...) once for each of its proper tails of a length in ``lengths`` (repo_id, lengths): the
    tail's length and two hashes instead of its text."""
    fit = F.filter("lengths", lambda n: n < F.length("path"))
    rows = paths_.join(lengths, "repo_id").withColumn("length", F.explode(fit)).drop("lengths")
    return _hashed(rows, F.right(F.col("path"), F.col("length")))


def _hashed(rows: DataFrame, tail: F.Column) -> DataFrame:
    return rows.withColumns({"length": F.length(tail), "h1": F.xxhash64(tail), "h2": F.xxhash64(F.lit(1), tail)})


def match_report(alerts: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``report`` to alerts (repo_id, source_file) from the index (repo_id, source_file, report).

    Equal normalised paths win (of several reports the last by name). Otherwise either path may be a character suffix
    of the other. A path can only end in a path of the other side if one of that length is there, so each path is cut at the lengths
    that occur on the other side of its repository, a few dozen, and the tails meet as hashes.
    """
    known = (
        index.select("repo_id", paths.norm_path(F.col("source_file")).alias("path"), "report")
        .filter("path <> ''")
        .groupBy("repo_id", "path")
        .agg(F.max("report").alias("report"))
    )
    known = cut_lineage(known, "report-paths")
    wanted = alerts.select("repo_id", paths.norm_path(F.col("source_file")).alias("path")).filter("path <> ''").distinct()
    exact = cut_lineage(wanted.join(known, ["repo_id", "path"], "left"), "exact-paths")
    open_paths = exact.filter("report is null").select("repo_id", "path")

    def lengths(rows: DataFrame) -> DataFrame:
        """As many as there are characters in the longest path, at most."""
        return rows.groupBy("repo_id").agg(F.collect_set(F.length("path")).alias("lengths"))

    key, ends = ["repo_id", "length", "h1", "h2"], [F.min("report").alias("low"), F.max("report").alias("high")]
    index_tails = _tails(known, lengths(open_paths)).groupBy(*key).agg(*ends)
    longer_index = _hashed(open_paths, F.col("path")).join(index_tails, key).select("repo_id", "path", "low", "high")
    tails = _tails(open_paths, lengths(known))
    whole = _hashed(known.withColumnRenamed("path", "own"), F.col("own")).drop("own")
    shorter_index = tails.join(whole, key).groupBy("repo_id", "path").agg(*ends)
    unique = (
        longer_index.unionByName(shorter_index)
        .groupBy("repo_id", "path")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .filter(F.col("low") == F.col("high"))
        .select("repo_id", "path", F.col("low").alias("report"))
    )
    resolved = exact.filter("report is not null").unionByName(unique)
    return (
        alerts.withColumn("path", paths.norm_path(F.col("source_file")))
        .join(resolved, ["repo_id", "path"], "left")
        .select(*alerts.columns, "report")
    )


def match_source(alerts: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``matched_file`` to alerts (repo_id, report, source_file) from files (repo_id, report, ord, source_file).

    Equal path first; else shared component suffixes, where the first file of the report owns each suffix, and all
    owners found must be the same file.
    """
    keys = ["repo_id", "report"]
    listed = files.select(*keys, paths.norm_path(F.col("source_file")).alias("path"), "ord").filter("path <> ''")
    listed = listed.groupBy(*keys, "path").agg(F.min("ord").alias("ord"))
    listed = cut_lineage(listed, "listed-files")  # met by equal paths and by tails
    owner = (
        listed.select(*keys, F.explode(paths.path_suffixes(F.col("path"))).alias("tail"), "path", "ord")
        .groupBy(*keys, "tail")
        .agg(F.min_by("path", "ord").alias("owner"))
    )
    wanted = (
        alerts.filter("report is not null")
        .select(*keys, paths.norm_path(F.col("source_file")).alias("path"))
        .filter("path <> ''")
        .distinct()
    )
    exact = wanted.join(listed.withColumn("matched_file", F.col("path")).drop("ord"), [*keys, "path"], "left")
    exact = cut_lineage(exact, "exact-files")
    by_tail = (
        exact.filter("matched_file is null")
        .select(*keys, "path", F.explode(paths.path_suffixes(F.col("path"))).alias("tail"))
        .join(owner, [*keys, "tail"])
        .groupBy(*keys, "path")
        .agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
        .filter(F.col("low") == F.col("high"))
        .select(*keys, "path", F.col("low").alias("matched_file"))
    )
    resolved = exact.filter("matched_file is not null").unionByName(by_tail)
    return (
        alerts.withColumn("path", paths.norm_path(F.col("source_file")))
        .join(resolved, [*keys, "path"], "left")
        .select(*alerts.columns, "matched_file")
    )


def match_diagnostic(alerts: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Add ``source_function`` and ``has_plist_match`` to alerts (repo_id, report, matched_file, line, message).

    A diagnostic fits on the same line (and file, if the file matched) when its message is equal after normalisation,
    the alert's message is blank, or its context names a good or bad function. Only a single fit counts, and only of
    kind ``function``.

    Diagnostics are counted before they meet alerts: all of a place, those that name a function, and the others by message. An alert
    adds up two of these numbers, so a line of many alerts and diagnostics makes no pairs.
    """
    place = ["repo_id", "report", "line", "any_file", "file"]
    context = F.trim(F.coalesce("issue_context", F.lit("")))
    d = diagnostics.select(
        "repo_id", "report", "line",
        paths.norm_path(F.col("source_file")).alias("own_file"),
        text.norm_message(F.col("description")).alias("__msg"),
        context.alias("context"),
        F.coalesce("issue_context_kind", F.lit("")).alias("kind"),
        (text.is_bad(context) | text.is_good(context)).alias("named"),
    )
    d = d.groupBy("repo_id", "report", "line", "own_file", "__msg", "named").agg(
        F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"), F.min("context").alias("context")
    )
    # each diagnostic counts for its own file and for alerts whose file did not match
    d = cut_lineage(d, "diagnostics").withColumn("any_file", F.explode(F.array(F.lit(False), F.lit(True))))
    d = d.withColumn("file", F.when(F.col("any_file"), F.lit("")).otherwise(F.col("own_file")))
    only = [F.when(F.col("named"), F.col(c)) for c in ("n", "kind", "context")]
    spots = d.groupBy(*place).agg(
        F.sum("n").alias("n_all"), F.min("kind").alias("kind_all"), F.min("context").alias("context_all"),
        F.coalesce(F.sum(only[0]), F.lit(0)).alias("n_named"), F.min(only[1]).alias("kind_named"), F.min(only[2]).alias("context_named"),
    )
    texts = d.filter("not named").groupBy(*place, "__msg").agg(
        F.sum("n").alias("n_text"), F.min("kind").alias("kind_text"), F.min("context").alias("context_text")
    )
    here = alerts.withColumns({
        "__msg": text.norm_message(F.col("message")),
        "any_file": F.col("matched_file").isNull(),
        "file": F.coalesce("matched_file", F.lit("")),
    })
    # written: join sides that come out of an aggregate cannot be split at a hot line
    joined = here.join(cut_lineage(spots, "spots"), place, "left").join(cut_lineage(texts, "spot-messages"), [*place, "__msg"], "left")
    blank, n_text = F.col("__msg") == "", F.coalesce("n_text", F.lit(0))
    n = F.when(blank, F.col("n_all")).otherwise(F.col("n_named") + n_text)
    by_name = F.col("n_named") == 1
    kind = F.when(blank, F.col("kind_all")).when(by_name, F.col("kind_named")).otherwise(F.col("kind_text"))
    found = F.when(blank, F.col("context_all")).when(by_name, F.col("context_named")).otherwise(F.col("context_text"))
    one = F.coalesce(n == 1, F.lit(False))
    return joined.select(
        *[F.col(f"`{c}`") for c in alerts.columns],
        F.when(one & (kind == "function"), found).otherwise(F.lit("")).alias("source_function"),
        (one | F.col("matched_file").isNotNull()).alias("has_plist_match"),
    )
