"""Readers: every one returns a lazy DataFrame with a declared schema."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewright.functions import text
from gatewright.functions.paths import cwe_number
from gatewright.operators.rows import warning_to_alert
from gatewright.sources.records import csv_records, json_array_records
from gatewright.sources.report_files import ENTRY_SCHEMA, TEXTS, plist_batches

# Fixed value: one line of analyzer console output.
CONSOLE_ALERT = r"(.+?):([0-9]+):[0-9]+:\s+(warning|error|note):\s+(.+)"

WARNING_SCHEMA = (
    "toolName string, filePath string, lineNumber string, warningType string, cwe string, "
    "warningSeverity string, warningMessage string"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def file_bytes(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def read_labelled_functions(spark: SparkSession, path: str, split: str) -> DataFrame:
    """JSON lines of labelled functions. An absent key takes its default; an explicit null stays null."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    present = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    fields = "project string, commit_id string, cve string, cwe string, func string, target long"
    record = lines.select(F.from_json("value", fields).alias("r"), present.alias("keys"))

    def field(name: str, default) -> F.Column:
        return F.when(F.array_contains("keys", name), F.col(f"r.{name}")).otherwise(F.lit(default))

    return record.select(
        F.lit(split).alias("split"),
        *[field(c, "").alias(c) for c in ("project", "commit_id", "cve", "cwe")],
        field("func", "").alias("function_code"),
        field("target", 0).cast("long").alias("target"),
    )


def read_warnings(
    spark: SparkSession, path: str, is_actionable: bool, partitions: int | None = None, also: str | None = None
) -> DataFrame:
    """JSON arrays of warnings as alert-training rows. ``also``: further fields to keep, as a schema text.

    A gzip file is cut into objects while it inflates and its rows are spread right after, as it cannot be split. Other files are
    read whole, one task each.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    schema = ", ".join([WARNING_SCHEMA, *([also] if also else [])])
    if all(f.endswith(".gz") for f in spark.read.text(path).inputFiles()):
        records = json_array_records(spark, path)
        raw = records.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    else:
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
    spread = raw.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return warning_to_alert(spread, is_actionable)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with header whose cells may hold doubled quotes and line breaks (function code); large files are split."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.fields)
    cells = F.from_csv("value", fields, {"escape": '"', "multiLine": "true"})
    return csv_records(spark, path).select(cells.alias("r")).select("r.*")


def read_report(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Lenient report: a missing, empty or unparsable file gives an empty table; unknown columns are kept as text."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    empty = spark.createDataFrame([], wanted)
    if not path_exists(spark, path) or file_bytes(spark, path) == 0:
        return empty
    try:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    except Exception:  # an unreadable report counts as an absent one
        return empty
    typed = [
        F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields if f.name in raw.columns
    ]
    others = [F.col(f"`{c}`") for c in raw.columns if c not in wanted.fieldNames()]
    return raw.select(*typed, *others)


def read_xml_alerts(spark: SparkSession, path: str) -> DataFrame:
    """cppcheck XML: one alert per ``<error>`` with its first location; absent attributes are empty."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Cppcheck report missing: {path}")
    if file_bytes(spark, path) == 0:
        raise ValueError(f"Cppcheck report is empty: {path}")
    place = "array<struct<_file:string,_line:string>>"
    schema = f"_id string, _severity string, _msg string, _cwe string, location {place}"
    errors = spark.read.format("xml").option("rowTag", "error").option("mode", "FAILFAST").schema(schema).load(path)

    def attribute(c) -> F.Column:
        return F.coalesce(c, F.lit(""))

    first = F.try_element_at("location", F.lit(1))
    return errors.select(
        F.lit("cppcheck").alias("tool"),
        attribute(first["_file"]).alias("file"),
        attribute(first["_line"]).alias("line"),
        attribute(F.col("_id")).alias("alert_id"),
        attribute(F.col("_cwe")).alias("cwe"),
        attribute(F.col("_severity")).alias("severity"),
        attribute(F.col("_msg")).alias("message"),
    )


def html_alerts(pages: DataFrame, content: str, name: str, all_entities: bool = False) -> DataFrame:
    """Alerts from report markup: message, file and line by the first field pattern that matches."""
    body = F.col(content)
    message = text.first_match(body, text.REPORT_MESSAGE, all_entities)
    file = text.first_match(body, text.REPORT_FILE, all_entities)
    fields = pages.withColumn("__m", message).withColumn("__f", file)
    return fields.select(
        *[c for c in pages.columns if c not in (content, name)],
        F.lit("clang").alias("tool"),
        F.when(F.col("__f") == "", F.col(name)).otherwise(F.col("__f")).alias("file"),
        text.first_match(body, text.REPORT_LINE, all_entities).alias("line"),
        F.lit("clang-static-analyzer").alias("alert_id"),
        F.lit("").alias("cwe"),
        F.lit("warning").alias("severity"),
        F.when(F.col("__m") == "", "Unknown Clang issue").otherwise(F.col("__m")).alias("message"),
    )


def read_html_reports(spark: SparkSession, path: str, glob: str = "report-*.html") -> DataFrame:
    """All report files below a folder, one alert each; a report is one value, however many there are."""
    files = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("report_file"))
    )
    return html_alerts(files, "value", "report_file", all_entities=True)


def console_alerts(lines: DataFrame, value: str, file_name: str) -> DataFrame:
    """Alerts from console lines; notes and other lines are dropped before any further work."""
    hit = lines.filter(F.col(value).rlike(CONSOLE_ALERT)).withColumn("severity", F.regexp_extract(value, CONSOLE_ALERT, 3))
    kept = hit.filter("severity <> 'note'")
    message = F.trim(F.regexp_extract(value, CONSOLE_ALERT, 4))
    return kept.select(
        *[c for c in lines.columns if c not in (value, file_name)],
        F.lit("clang").alias("tool"),
        F.regexp_extract(value, CONSOLE_ALERT, 1).alias("source_file"),
        F.regexp_extract(value, CONSOLE_ALERT, 2).cast("int").alias("line"),
        text.alert_id(message).alias("alert_id"),
        cwe_number(F.col(file_name)).alias("cwe"),
        "severity",
        message.alias("message"),
        F.col(file_name).alias("raw_report_path"),
    )


def read_text_alerts(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path).select(
        "value", F.col("_metadata.file_name").alias("file_name")
    )
    return console_alerts(lines, "value", "file_name")


def read_plists(spark: SparkSession, path: str, glob: str = "*.plist") -> DataFrame:
    """Entries of the analyzer plist files below a folder; empty and broken ones are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return parse_plists(files.filter("length > 0").select(F.col("_metadata.file_name").alias("report"), "content"))


def parse_plists(files: DataFrame) -> DataFrame:
    """Entries from (report, content): a row per listed file, which has an ``ord``, and a row per diagnostic, which has none.

    A report is parsed by events, so a task holds its bytes, its listed paths and a batch of rows, never a tree or one row of
    all diagnostics. A report broken anywhere, a null and an empty one give no rows.
    """
    return files.select("report", "content").mapInArrow(plist_batches, ENTRY_SCHEMA)


def plist_index(plists: DataFrame) -> DataFrame:
    """(report, ord, source_file) of every file listed in a report."""
    return plists.filter("ord IS NOT NULL").select("report", F.col("ord").cast("int").alias("ord"), "source_file")


def plist_diagnostics(plists: DataFrame) -> DataFrame:
    """(report, source_file, line, description, issue_context, issue_context_kind), one row per diagnostic."""
    return plists.filter("ord IS NULL").select("report", "source_file", F.col("line").cast("int").alias("line"), *TEXTS)


def read_sources(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_path, content) of source files; bytes that are not UTF-8 do not fail the job."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("file_path"), _decode("content").alias("content"))


@F.pandas_udf(T.StringType())
def _decode(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: b.decode("utf-8", errors="ignore"), na_action="ignore")


def read_scan_status(spark: SparkSession, path: str) -> DataFrame:
    """One row with the trimmed scan-status marker; empty where the file is missing."""
    if not path_exists(spark, path):
        return spark.createDataFrame([("",)], "scan_status string")
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace("value", r"^\s+|\s+$", "").alias("scan_status")
    )


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Required columns that are absent (schema only, no job)."""
    return [c for c in columns if c not in df.columns]
