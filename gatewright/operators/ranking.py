"""Ranks, running sums and exact quantiles that do not push one hot group through one task.

A window partitioned by a group key sorts a whole group in a single task. When a repository may hold a third of all
rows that task never ends, so the rows are first cut into ranges of the whole order (group, order, row number), each
range is sorted on its own, and the ranges' totals, which are few, supply the offsets. Even a group whose rows all agree
in their order is cut. The result is exact whatever the bounds are, because ranges only ever split the order, never reorder it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.session import cut_lineage

#: Rows that a range should hold at most.
RANGE_ROWS = 250_000
#: Groups that a prefix of a hash should hold at most.
PREFIX_ROWS = 4096


def _same(left: DataFrame, right: DataFrame, names: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in names], F.lit(True))


def ranges_of(df: DataFrame, group: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``__range``, the number of its range, and ``__row``, which tells rows of equal order apart; both written.

    Spark draws the bounds from a sample of the whole key, so a range is as large as any other, whatever a group's size or ties.
    Writing the rows keeps a lost executor from changing the place of a row after it was counted. As many rows as fit one range
    are one range.
    """
    rows = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()), "ordered")
    ranges = -(-rows.count() // range_rows)
    if ranges <= 1:
        return rows.withColumn("__range", F.lit(0))
    rows = rows.repartitionByRange(ranges, *group, *order, "__row")
    return cut_lineage(rows.withColumn("__range", F.spark_partition_id()), "ranges")


def running_before(
    df: DataFrame, group: list[str], order: list[Column], values: dict[str, Column], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Add ``<name>_before`` (sum over strictly earlier rows of the group) and ``<name>_total`` for every value.

    Rows that agree in ``order`` follow each other in some order. Null groups are groups, null orders come first.
    """
    keys = {f"__k{i}": c for i, c in enumerate(order)}
    rows = ranges_of(df.withColumns({**keys, **{f"__v_{n}": v for n, v in values.items()}}), group, list(keys), range_rows)
    inside = Window.partitionBy(*group, "__range").orderBy(*keys, "__row").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"__l_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in values})
    totals = rows.groupBy(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__range").alias("__r")).agg(
        *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values]
    )
    whole = Window.partitionBy(*[f"__g_{g}" for g in group])
    earlier = whole.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({
        **{f"__o_{n}": F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)) for n in values},
        **{f"{n}_total": F.sum(f"__t_{n}").over(whole) for n in values},
    })
    names = [(g, f"__g_{g}") for g in group] + [("__range", "__r")]
    joined = local.join(totals, _same(local, totals, names))
    before = [(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(f"{n}_before") for n in values]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[f"{n}_total" for n in values], *before)


def prefix_digits(n: int, rows: int = PREFIX_ROWS) -> int:
    """Hex digits of a hash that part ``n`` rows into prefixes of about ``rows``."""
    return max(1, math.ceil(math.log(max(n / rows, 1), 16)))


def global_rank_by_hash(df: DataFrame, group: list[str], hash_column: str, prefix: int | None = None) -> DataFrame:
    """Add ``rank`` (1-based, by the hex text) and ``size``. A hash spreads evenly, so its prefix is the bucket; its length
    follows from the number of rows."""
    if prefix is None:
        df = cut_lineage(df, "hashed")
        prefix = prefix_digits(df.count())
    cut = df.withColumn("__p", F.substring(hash_column, 1, prefix))
    counts = cut.groupBy(*group, "__p").agg(F.count(F.lit(1)).alias("__n"))
    base = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    counts = counts.select(
        *group,
        "__p",
        F.coalesce(F.sum("__n").over(base.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"),
        F.sum("__n").over(base).alias("size"),
    )
    inside = Window.partitionBy(*group, "__p").orderBy(hash_column)
    ranked = cut.withColumn("__r", F.row_number().over(inside))
    return (
        ranked.join(counts, on=[*group, "__p"])
        .withColumn("rank", (F.col("__r") + F.col("__o")).cast("long"))
        .drop("__p", "__r", "__o")
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group with their position ``rn``.

    The ``rn <= n`` filter lets Spark keep only ``n`` rows per group in every map task before the shuffle.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)


def exact_quantile(df: DataFrame, group: list[str], value: str, q: float, alias: str = "cut") -> DataFrame:
    """Exact quantile per group with linear interpolation between the two nearest ranks."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    placed = running_before(counts, group, [F.col(value)], {"c": F.col("__c")})
    position = F.lit(q) * (F.col("c_total") - 1)
    first, last = F.col("c_before"), F.col("c_before") + F.col("__c") - 1
    low, high = F.floor(position), F.ceil(position)
    picked = placed.select(
        *group,
        position.alias("__pos"),
        F.when((first <= low) & (low <= last), F.col(value)).alias("__lo"),
        F.when((first <= high) & (high <= last), F.col(value)).alias("__hi"),
    )
    ends = picked.groupBy(*group).agg(
        F.max("__pos").alias("__pos"), F.max("__lo").alias("__lo"), F.max("__hi").alias("__hi")
    )
    share = F.col("__pos") - F.floor("__pos")
    return ends.select(*group, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * share).alias(alias))
