"""Grouped splits and group samples from hashes, so they repeat exactly on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions import paths
from gatewright.functions.numbers import md5_text, round_half_up
from gatewright.operators.ranking import global_rank_by_hash, top_per_group
from gatewright.session import cut_lineage

TEST_SHARE = 0.2
VALID_SHARE = 0.25  # of what the test split leaves
#: Of a split search: deviations that a window reaches to both sides of its boundary, hex digits of its bounds, groups a task.
DEVIATIONS, BOUND_DIGITS, TASK_GROUPS = 6, 8, 50_000


def sample_groups(files: DataFrame, families: list[str] | None = None, n: int = 200, seed: int = P.SEED) -> DataFrame:
    """All files of at most ``n`` cases per family, cases drawn by hash.

    ``n`` is the size of the sample asked for; the chosen cases are at most ``n`` times the families, so broadcasting
    them is safe.
    """
    wanted = families or [P.MEDIUM_FAMILY, *P.HIGH_FAMILIES]
    named = files.withColumn("cwe_folder", paths.cwe_family(F.col("source_file"))).filter(F.col("cwe_folder").isin(wanted))
    named = named.withColumn("case_group", paths.case_group_id(paths.stem(F.col("source_file"))))
    cases = named.select("cwe_folder", "case_group").distinct()
    draw = md5_text(F.col("case_group"), F.lit(seed))
    chosen = top_per_group(cases.withColumn("__d", draw), ["cwe_folder"], [F.col("__d"), F.col("case_group")], n)
    return named.join(F.broadcast(chosen.select("cwe_folder", "case_group")), ["cwe_folder", "case_group"], "left_semi")


def _sizes(size: F.Column) -> tuple[F.Column, F.Column]:
    """Numbers of test and validation groups out of ``size`` groups."""
    test = F.ceil(size * F.lit(TEST_SHARE) - F.lit(1e-9))
    valid = F.ceil((size - test) * F.lit(VALID_SHARE) - F.lit(1e-9))
    return test.cast("long"), valid.cast("long")


def _split_of_rank(rank: F.Column, size: F.Column) -> F.Column:
    test, valid = _sizes(size)
    return F.when(rank <= test, "test").when(rank <= test + valid, "valid").otherwise("train")


def group_splits(df: DataFrame, group: str, seed: int = P.SEED) -> DataFrame:
    """(group, split) for the distinct groups: exact 20 % test and 20 % validation groups by hash rank."""
    groups = df.select(group).distinct().withColumn("__h", md5_text(F.col(group), F.lit(seed)))
    ranked = global_rank_by_hash(groups, [], "__h")
    return ranked.select(group, _split_of_rank(F.col("rank"), F.col("size")).alias("split"))


def grouped_split(df: DataFrame, group: str, seed: int = P.SEED) -> DataFrame:
    return assign_split(df, group_splits(df, group, seed), group)


def assign_split(df: DataFrame, splits: DataFrame, group: str) -> DataFrame:
    return df.join(splits, group)


def _windows(groups: int, edges: list[int], digits: int) -> list[str]:
    """Bounds of the zones below, at and between two ranks among uniform hashes, and above: hex texts, windows in the odd zones."""
    top, bounds = 16**digits, []
    for edge in edges:
        share = edge / max(groups, 1)
        reach = DEVIATIONS * math.sqrt(max(share * (1 - share), 1 / max(groups, 1)) / max(groups, 1))
        low, high = math.floor((share - reach) * top), math.ceil((share + reach) * top)
        low, high = (min(max(x, 0), top) for x in (low, high))
        bounds += [max(low, bounds[-1]) if bounds else low, max(high, bounds[-1]) if bounds else high]
    # a bound above every hash sorts behind all hex digits
    return [format(x, f"0{digits}x") if x < top else "g" for x in bounds]


def search_split(
    df: DataFrame, group: str, label: str = "label", seed: int = P.SEED, trials: int = 120, policy: str = "divergence",
    prefix: int | None = None,
) -> DataFrame:
    """Score ``trials`` seeds without a driver loop and without sorting the groups once per seed.

    Rows shrink to class counts per group first, which are written. Each group then carries all seeds in one array and is hashed once
    per seed. A seed's two boundaries lie where a known share of the hashes ends, give or take a few deviations: hashes there are kept
    one by one, all others are summed per seed and zone in the map tasks, so the shuffle holds few of them. Only what is kept is
    ranked. A boundary outside its window, which the counts would show, gets its whole zone ranked. ``prefix``: hex digits of the
    windows' bounds.

    ``divergence``: every seed with all classes in all splits, best (smallest total L1 divergence) first.
    ``first``: the same seeds, lowest seed first.
    """
    counts = [f"n{x}" for x in P.LABELS]
    per_group = df.groupBy(group).agg(*[F.count_if(F.col(label) == x).alias(f"n{x}") for x in P.LABELS])
    per_group = cut_lineage(per_group, "class-counts")
    groups = per_group.count()
    train, valid, test = expected_sizes(groups)
    bounds = _windows(groups, [test, test + valid], prefix or BOUND_DIGITS)
    seeds = F.array(*[F.struct(F.lit(x).alias("seed"), F.lit(str(x)).alias("text")) for x in range(seed, seed + trials)])
    # the text that md5_text would hash: a null group leaves out the separator as well
    text = F.coalesce(F.concat(F.col(group).cast("string"), F.lit("|")), F.lit(""))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, groups // TASK_GROUPS)
    drawn = per_group.repartition(tasks).select(text.alias("__t"), *counts, F.inline(seeds)).select(
        "seed", *counts, F.md5(F.concat("__t", "text")).alias("__h")
    )
    zone = F.lit(len(bounds))
    for number, bound in reversed(list(enumerate(bounds))):
        zone = F.when(F.col("__h") < bound, number).otherwise(zone)
    drawn = drawn.withColumn("zone", zone)
    kept = F.when(F.col("zone") % 2 == 1, F.col("__h"))  # windows have the odd numbers
    found = drawn.groupBy("seed", "zone", kept.alias("__h")).agg(F.count(F.lit(1)).alias("g"), *[F.sum(c).alias(c) for c in counts])
    found = cut_lineage(found, "split-zones")

    cells = found.groupBy("seed", "zone").agg(F.sum("g").alias("g"), *[F.sum(c).alias(c) for c in counts])
    order = Window.partitionBy("seed").orderBy("zone")  # at most five rows a seed
    cells = cells.withColumn("upto", F.sum("g").over(order)).withColumn("before", F.col("upto") - F.col("g"))
    cells = cut_lineage(cells, "split-cells")
    size, t, v = (F.lit(x).cast("long") for x in (groups, test, test + valid))

    def crosses(edge: F.Column) -> F.Column:
        return (F.col("before") < edge) & (F.col("upto") > edge)

    whole = cells.filter(~(crosses(t) | crosses(v))).select("seed", _split_of_rank(F.col("upto"), size).alias("split"), *counts)
    edges = cells.filter(crosses(t) | crosses(v)).select("seed", "zone", "before")  # at most two rows per seed
    single = found.filter("__h is not null").join(F.broadcast(edges), ["seed", "zone"])
    missed = edges.filter("zone % 2 = 0")
    if not missed.isEmpty():
        again = drawn.withColumn("g", F.lit(1).cast("long")).join(F.broadcast(missed), ["seed", "zone"])
        single = single.unionByName(again.select(*single.columns))
    rank = F.col("before") + F.sum("g").over(Window.partitionBy("seed", "zone").orderBy("__h"))
    single = single.withColumn("rank", rank).select("seed", _split_of_rank(F.col("rank"), size).alias("split"), *counts)

    names = ["train", "valid", "test"]
    sums = [
        F.sum(F.when(F.col("split") == s, F.col(c)).otherwise(0)).alias(f"{s}_{c}") for s in names for c in counts
    ]
    table = whole.unionByName(single).groupBy("seed").agg(*sums)
    total = {c: F.col(f"train_{c}") + F.col(f"valid_{c}") + F.col(f"test_{c}") for c in counts}

    def share(c: F.Column, n: F.Column) -> F.Column:
        return round_half_up(F.when(n > 0, c / n).otherwise(F.lit(0.0)), 6)

    everything = sum(total.values())
    distance = F.lit(0.0)
    complete = F.lit(True)
    for s in names:
        rows = sum(F.col(f"{s}_{c}") for c in counts)
        for c in counts:
            distance = distance + F.abs(share(total[c], everything) - share(F.col(f"{s}_{c}"), rows))
            complete = complete & (F.col(f"{s}_{c}") > 0)
    scored = table.withColumn("divergence", round_half_up(distance, 6)).filter(complete)
    keys = [F.col("divergence"), F.col("seed")] if policy == "divergence" else [F.col("seed")]
    return scored.withColumn("trial_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)))


def best_split(df: DataFrame, group: str, label: str = "label", seed: int = P.SEED, trials: int = 120, policy: str = "divergence") -> DataFrame:
    """Rows with their split under the winning seed; an error if no seed puts every class into every split."""
    best = search_split(df, group, label, seed, trials, policy).filter("trial_rank = 1").select("seed").first()
    if best is None:
        raise ValueError("Could not build grouped splits that contain all required classes.")
    return grouped_split(df, group, best["seed"])


def expected_sizes(groups: int) -> tuple[int, int, int]:
    """(train, valid, test) group numbers for a number of groups."""
    test = math.ceil(groups * TEST_SHARE - 1e-9)
    valid = math.ceil((groups - test) * VALID_SHARE - 1e-9)
    return groups - test - valid, valid, test
