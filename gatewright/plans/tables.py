"""The given tables seen as security signals.

Each builder has a twin in ``views.py``: the same mapping as SQL text, for the side-by-side check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions import alerts as A
from gatewright.functions.numbers import md5_text
from gatewright.operators import runs as R
from gatewright.operators.quality import scoring_block
from gatewright.session import cut_lineage, widen

SEVERITY_OF_EVENT = {"error": "error", "purchase": "warning", "signup": "style", "click": "information"}
FAMILY_OF_PRIORITY = {
    "1-URGENT": "CWE121_Stack_Based_Buffer_Overflow",
    "2-HIGH": "CWE122_Heap_Based_Buffer_Overflow",
    "3-MEDIUM": "CWE415_Double_Free",
    "4-NOT SPECIFIED": "CWE416_Use_After_Free",
    "5-LOW": "CWE476_NULL_Pointer_Dereference",
}
WORDS_OF_PART = ["null pointer", "buffer overflow", "memory leak", "strcpy call", "dead store", "Use After Free", "plain"]


def text(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def glue(*parts) -> F.Column:
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else text(p) for p in parts])


class Tables:
    """Lazy access to one folder of the given parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    # ---- runs, alerts, functions, history (from events) ----------------------------------------------------------
    @cached_property
    def alerts(self) -> DataFrame:
        """One alert per event: the repository is the user, the run is the user's day."""
        e, k = self.read("events"), F.col("event_id")
        odd = k % 2 == 1
        base = e.select(
            text("user_id").alias("repo_id"),
            F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
            k.alias("ord"),
            F.when(odd, "clang").otherwise("cppcheck").alias("tool"),
            F.when(odd, 1).otherwise(0).alias("tool_order"),
            glue("=src/mod", F.col("user_id") % 7, "=/unit", k % 13, "=.c").alias("file"),
            F.when(k % 10 != 9, k % 400 + 1).alias("line"),
            F.col("event_type").alias("alert_id"),
            F.when(F.col("event_type") == "error", "476").when(F.col("event_type") == "click", "").alias("cwe"),
            A.lookup(F.col("event_type"), SEVERITY_OF_EVENT, "none").alias("severity"),
            glue("event_type", "= ", "props").alias("message"),
            (F.col("event_type") != "view").alias("actionable"),
        )
        rated = base.withColumn("priority", A.priority_a(F.col("actionable"), F.col("severity")))
        return rated.withColumn("label", A.label_of(F.col("priority")))

    @cached_property
    def risks(self) -> DataFrame:
        """One scored function per event."""
        e, k = self.read("events"), F.col("event_id")
        rows = e.select(
            text("user_id").alias("repo_id"),
            F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
            k.alias("ord"),
            glue("=src/mod", F.col("user_id") % 7, "=/unit", k % 13, "=.c").alias("file_path"),
            F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("probability"),
        )
        return R.score_risk(rows)

    @cached_property
    def shifted_risks(self) -> DataFrame:
        """All scored functions, those of every third day under run names that no alert has."""
        apart = F.substring("run_id", 9, 2).cast("int") % 3 == 0
        return self.risks.withColumn("run_id", F.when(apart, F.concat("run_id", F.lit(" apart"))).otherwise(F.col("run_id")))

    @cached_property
    def runs(self) -> DataFrame:
        return self.alerts.select("repo_id", "run_id").distinct()

    @cached_property
    def metrics(self) -> DataFrame:
        """The nine features per run, with files counted as distinct files of the run."""
        files = self.risks.select("repo_id", "run_id", "file_path").distinct().groupBy("repo_id", "run_id").agg(
            F.count(F.lit(1)).alias("total_changed_files")
        )
        return R.run_metrics(self.runs, self.alerts, self.risks, files)

    @cached_property
    def history(self) -> DataFrame:
        """Run metrics with a time and upstream statuses of mixed spelling."""
        u, d = F.col("repo_id").cast("long"), F.substring("run_id", 9, 2).cast("long")
        status = {
            "commit_risk_status": F.when((u * 31 + d) % 19 == 0, " missing ").otherwise("OK"),
            "commit_summary_status": F.when((u * 7 + d) % 23 == 0, "Malformed").otherwise("OK"),
            "cppcheck_status": F.when((u * 11 + d) % 29 == 0, "SCHEMA_MISMATCH").otherwise("OK"),
            "clang_status": F.when((u + d) % 5 == 0, "NOT_APPLICABLE").otherwise("OK"),
            "ml3_scoring_blocked": F.when((u + d) % 31 == 0, "True").when((u + d) % 37 == 0, "yes").otherwise("False"),
            "ml3_outcome": F.when((u * 3 + d) % 41 == 0, "failed").otherwise("NORMAL"),
        }
        return self.metrics.withColumns({"ts": d * 86400, **status})

    @cached_property
    def blocked_metrics(self) -> DataFrame:
        """Run metrics with clean statuses and the block decision."""
        clean = {c: F.upper(F.trim(c)) for c in P.UPSTREAM_STATUS_COLUMNS}
        return scoring_block(self.history.withColumns(clean).drop("ml3_scoring_blocked"))

    # ---- analyzer output (from orders) ---------------------------------------------------------------------------
    @cached_property
    def console(self) -> DataFrame:
        """Console lines: alerts, notes and other lines."""
        o, k = widen(self.read("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")), F.col("o_orderkey")
        family = A.lookup(F.col("o_orderpriority"), FAMILY_OF_PRIORITY)
        path = glue(
            "=/work/testcases/", family, "=/s0", k % 9, "=/", family, "=__case_", F.col("o_custkey") % 40,
            F.when(k % 3 == 0, "a").when(k % 3 == 1, "_bad").otherwise("_goodG2B"), F.when(k % 2 == 0, ".c").otherwise(".cpp"),
        )
        severity = F.when(F.col("o_orderstatus") == "F", "warning").when(F.col("o_orderstatus") == "O", "error").otherwise("note")
        message = F.when(k % 4 == 0, "Dereference of null pointer: value is null [core.NullDereference]").when(
            k % 4 == 1, "  Memory is never released; potential leak [unix.Malloc]").when(
            k % 4 == 2, "Use of memory after it is freed").otherwise("...")
        line = glue(path, "=:", k % 97 + 1, "=:5: ", severity, "=: ", message)
        return o.select(
            text(F.col("o_custkey") % 20).alias("repo_id"),
            k.alias("ord"),
            F.when(k % 11 == 0, "2 warnings generated.").otherwise(line).alias("value"),
            glue(k % 50, "=_", family, "=_x.c.txt").alias("file_name"),
        )

    @cached_property
    def console_alerts(self) -> DataFrame:
        from gatewright.sources.readers import console_alerts

        return console_alerts(self.console, "value", "file_name")

    @cached_property
    def kept_alerts(self) -> DataFrame:
        """The console alerts, taken from their lines once and written: for jobs that read them several times."""
        return cut_lineage(self.console_alerts, "console-alerts")

    @cached_property
    def report_index(self) -> DataFrame:
        """Files listed in reports, under equal, longer, shorter and backslash paths."""
        a, k = self.kept_alerts, F.col("ord")
        path = F.col("source_file")
        listed = (
            F.when(k % 5 == 0, path)
            .when(k % 5 == 1, F.concat(F.lit("/build"), path))
            .when(k % 5 == 2, F.regexp_replace(path, "^/work/testcases/", ""))
            .when(k % 5 == 3, F.translate(path, "/", "\\"))
            .otherwise(F.concat(F.lit(" other/"), F.substring_index(path, "/", -1)))
        )
        return a.select("repo_id", glue("=rep", k % 30, "=.plist").alias("report"), "ord", listed.alias("source_file")).filter(
            k % 7 < 2
        )

    @cached_property
    def diagnostics(self) -> DataFrame:
        """Diagnostics of the reports: near copies of the alerts."""
        k = F.col("ord")
        context = F.when(k % 3 == 0, "CWE_bad").when(k % 3 == 1, "goodG2B1").otherwise("helper")
        return self.kept_alerts.select(
            "repo_id",
            glue("=rep", k % 30, "=.plist").alias("report"),
            "line",
            "source_file",
            F.when(k % 2 == 0, F.upper("message")).otherwise("another finding").alias("description"),
            context.alias("issue_context"),
            F.when(k % 8 == 5, "block").otherwise("function").alias("issue_context_kind"),
        ).filter(k % 6 != 1)

    # ---- sources and diffs (from lineitem) -----------------------------------------------------------------------
    @cached_property
    def source_parts(self) -> DataFrame:
        """Each line item as a piece of C++ text: a function, a method, a declaration or a struct."""
        li = widen(self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
        n = glue("l_linenumber", "=_", "l_partkey", "=_", "l_suppkey")
        kind = F.col("l_quantity").cast("int") % 4
        piece = (
            F.when(kind == 0, glue("=static int f_", n, "=(int a) {\n    return a;\n}\n"))
            .when(kind == 1, glue("=void C", "l_suppkey", "=::run_", n, "=(char *p)\n{\n    if (p) {\n        free(p);\n    }\n}\n"))
            .when(kind == 2, glue("=#define X_", n, "= 1\nint v_", n, "= = 1;\n"))
            .otherwise(glue("=struct s_", n, "= {\n    int a;\n};\n"))
        )
        start, count = F.col("l_partkey") % 20 + 1, F.col("l_quantity").cast("int") % 3
        hunk = glue("=@@ -1,2 +", start, "=,", count, "= @@ ctx\n+changed\n")
        return li.select(
            text(F.col("l_orderkey") % 50).alias("repo_id"),
            F.lit("r1").alias("run_id"),
            glue("=src/o", "l_orderkey", "=.cpp").alias("file_path"),
            F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"),
            piece.alias("piece"),
            hunk.alias("hunk"),
            (F.col("l_linenumber") <= 3).alias("in_diff"),
        )

    def _joined(self, column: str) -> F.Column:
        parts = F.array_sort(F.collect_list(F.when(F.col("in_diff") | F.lit(column == "piece"), F.struct("place", column))))
        return F.array_join(F.transform(parts, lambda x: x[column]), "")

    @cached_property
    def sources(self) -> DataFrame:
        """One file per order (a handful of pieces each)."""
        keys = ["repo_id", "run_id", "file_path"]
        return self.source_parts.groupBy(*keys).agg(self._joined("piece").alias("content"))

    @cached_property
    def diffs(self) -> DataFrame:
        keys = ["repo_id", "run_id", "file_path"]
        return self.source_parts.groupBy(*keys).agg(self._joined("hunk").alias("diff_text"))

    # ---- case files (from lineitem) and labelled functions (from documents) ----------------------------------------
    @cached_property
    def case_files(self) -> DataFrame:
        li = self.read("lineitem")
        families = [*P.HIGH_FAMILIES, P.MEDIUM_FAMILY, "CWE78_OS_Command_Injection", "support"]
        family = F.element_at(F.array(*[F.lit(f) for f in families]), (F.col("l_linenumber") % 7 + 1).cast("int"))
        part = F.when(F.col("l_partkey") % 3 == 0, "_bad").when(F.col("l_partkey") % 3 == 1, "_goodG2B").otherwise("_12b")
        return li.select(
            glue("=C/testcases/", family, "=/s01/", family, "=__t_", F.col("l_orderkey"), "=xy", part, "=.c").alias("source_file")
        ).distinct()

    @cached_property
    def labelled(self) -> DataFrame:
        """Documents as functions with labels; the split comes from a hash of the document id."""
        d, y = self.read("documents"), self.read("labels")
        bucket = F.conv(F.substring(md5_text(F.col("doc_id")), 1, 2), 16, 10).cast("int")
        split = F.when(bucket < 154, "train").when(bucket < 205, "valid").otherwise("test")
        return d.join(y, "doc_id").select(
            "doc_id", split.alias("split"), F.col("text").alias("function_code"), F.col("quality").alias("target"),
            "source", "toxic",
        )

    @cached_property
    def messages(self) -> DataFrame:
        """Part-flavoured warnings, one per line item: raw records as a warning file would hold them."""
        # the first six tell line items apart: some share order, line, part and supplier
        used = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
        li = widen(self.read("lineitem").select(*used))
        words = F.array(*[F.lit(w) for w in WORDS_OF_PART])
        word = F.element_at(words, (F.col("l_partkey") % len(WORDS_OF_PART) + 1).cast("int"))
        severity = F.when(F.col("l_returnflag") == "A", "error").when(F.col("l_returnflag") == "N", "Warning").otherwise("style")
        return li.select(
            F.concat_ws("|", *[F.col(c).cast("long").cast("string") for c in used[:4]],
                        *[F.round(F.col(c) * 100).cast("long").cast("string") for c in used[4:6]]).alias("ord"),
            F.when(F.col("l_suppkey") % 5 == 0, "CppCheck 2.1").otherwise("other").alias("toolName"),
            glue("=src/f", F.col("l_orderkey") % 500, "=.c").alias("filePath"),
            F.when(F.col("l_partkey") % 9 == 0, "n/a").otherwise(text(F.col("l_partkey") % 300)).alias("lineNumber"),
            glue("=id", F.col("l_suppkey") % 12).alias("warningType"),
            F.when(F.col("l_linenumber") == 1, "nan").when(F.col("l_linenumber") < 5, text(F.col("l_linenumber") + 118)).alias("cwe"),
            severity.alias("warningSeverity"),
            glue("=Possible ", word, "= in item ", F.col("l_partkey") % 40).alias("warningMessage"),
            (F.col("l_linestatus") == "F").alias("actionable"),
        )
