"""Exact k nearest neighbours per repository and the local outlier factor, without comparing all pairs.

1. Equal points collapse to one weighted point.
2. A metric tree parts each repository's points: a crowded node draws pivots among its points, each point goes to its nearest
   pivot's child, until a node holds few. A node keeps its children's pivots and radii.
3. A query's own leaf gives an upper bound of its k-th distance. Descending from the root, a child can hold a nearer point only if its
   lower bound is smaller: the distance to the pivot less the radius, or the distance to the plane between the pivot and the query's
   nearest one. What is left is visited by growing lower bound, some leaves a round, until the k-th distance excludes the rest.
Chunks of a leaf's points meet chunks of queries, small ones in batches; a chunk of queries hands on at most k neighbours per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.functions.numbers import round_half_up
from gatewright.operators.batches import batches_for, met_in_batches
from gatewright.operators.ranking import exact_quantile
from gatewright.session import cut_lineage

#: Points in a leaf, children of a node, levels of a tree at most (a node of the last one is a leaf, however large).
LEAF, FAN, MOST_LEVELS = 1000, 64, 9
#: Rows of a leaf, and queries, that meet in a task at most.
CHUNK = 4000
#: Pairs compared at once, and pairs that count as much as a row when batches are made.
PAIRS, PAIRS_A_ROW = 1 << 19, 1000
#: Leaves that a query visits in the first round after its own; each further round reaches four times as far.
FIRST_LEAVES = 3
#: What bounds are widened by: distances are rounded.
SLACK = 1e-6
DIGITS = 9
_NEAR = "repo_id string, point string, neighbour string, distance double, weight long"


def weighted_points(df: DataFrame, features: list[str], point: str = "run_id") -> DataFrame:
    """(repo_id, point, x, weight): equal vectors become one point named after their smallest id."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    return df.groupBy("repo_id", x.alias("x")).agg(F.min(point).alias("point"), F.count(F.lit(1)).alias("weight"))


def _nearest(queries: pd.DataFrame, points: pd.DataFrame, groups: list[tuple[np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """The first neighbours of each query, among its group's points, whose weights reach ``k``; ties by point name; own copies count.

    Inner products tell which points can be among the first; only their distances are computed as they are compared and returned.
    """
    q, p = np.stack(queries["x"].to_numpy()), np.stack(points["x"].to_numpy())
    asked, names, weights = queries["point"].to_numpy(), points["point"].to_numpy(), points["weight"].to_numpy()
    place = np.empty(len(p), dtype=np.int64)
    place[pd.Series(names).sort_values(kind="stable").index] = np.arange(len(p))  # null names come last
    same = pd.factorize(np.concatenate([asked, names]))[0]
    same_q, same_p = same[: len(q)], same[len(q) :]
    norm_q, norm_p = (q * q).sum(1), (p * p).sum(1)
    found = []
    for mine, theirs in groups:
        theirs = theirs[np.argsort(place[theirs])]
        b, squares = p[theirs], norm_p[theirs]
        strip = max(1, PAIRS // len(theirs))
        for start in range(0, len(mine), strip):
            at = mine[start : start + strip]
            a = q[at]
            w = weights[theirs][None, :] - (same_q[at][:, None] == same_p[theirs][None, :])
            rough = np.where(w > 0, norm_q[at][:, None] + squares[None, :] - 2 * (a @ b.T), np.inf)
            if len(theirs) > k:  # each weighs one at least, so the first k points hold the answer
                kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
                off = 1e-13 * (b.shape[1] + 10) * (np.sqrt(norm_q[at]) + np.sqrt(np.nan_to_num(squares).max())) ** 2
                reach = (np.sqrt(np.maximum(kth, 0) + off) + 4 * 10.0**-DIGITS) ** 2 + off
                i, j = np.nonzero(~(rough > reach[:, None]) & (w > 0))  # what is not a number stays, and comes last
            else:
                i, j = np.nonzero(w > 0)
            d = np.round(np.sqrt(((a[i] - b[j]) ** 2).sum(-1)), DIGITS)
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            got = w[i, j]
            upto = np.cumsum(got)
            first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, dtype=bool)
            before = upto - got
            before = before - before[np.flatnonzero(first)][np.cumsum(first) - 1] if len(i) else before
            take = np.minimum(got, k - before)
            kept = take > 0
            found.append((at[i[kept]], theirs[j[kept]], d[kept], take[kept]))
    i, j, d, w = (np.concatenate(c) for c in zip(*found))
    return pd.DataFrame({"repo_id": queries["repo_id"].to_numpy()[i], "point": asked[i], "neighbour": names[j], "distance": d, "weight": w})


def _each(function):
    """A function of one group's queries and points as one of a batch's."""
    def run(q: pd.DataFrame, p: pd.DataFrame, groups: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        return pd.concat([function(q.iloc[i], p.iloc[j]) for i, j in groups])

    return run


def _shared(queries: DataFrame, stored: DataFrame, chunk: int, function, schema: str) -> DataFrame:
    """``function(queries, stored, groups)`` where both have the same (repo_id, node), in groups of at most ``chunk`` queries and rows.

    Small groups meet in batches, as many as keep their rows and their pairs few.
    """
    keys = ["repo_id", "node"]
    cuts = queries.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / chunk) + 1).alias("shares"), F.count(F.lit(1)).alias("q"))
    parts = stored.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / chunk) + 1).alias("parts"), F.count(F.lit(1)).alias("p"))
    cuts = cut_lineage(cuts.join(parts, keys), "shares")
    q, p = F.col("q").cast("double"), F.col("p").cast("double")
    most = cuts.agg(F.sum(q * F.col("parts") + p * F.col("shares") + q * p / PAIRS_A_ROW).alias("rows")).first()["rows"]
    cuts, batches = cuts.drop("q", "p"), batches_for(cuts.sparkSession, most)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda n, row: F.pmod(F.xxhash64(row, F.lit(n)), F.col(n))
    left = queries.join(cuts, keys).withColumn("share", one("shares", "point")).withColumn("part", every("parts")).drop("shares", "parts")
    right = stored.join(cuts, keys).withColumn("part", one("parts", "row")).withColumn("share", every("shares")).drop("shares", "parts", "row")
    return met_in_batches(left, right, [*keys, "share", "part"], batches, function, schema)


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.empty((len(q), len(p)))
    for start in range(0, len(q), 256):
        out[start : start + 256] = np.sqrt(((q[start : start + 256, None, :] - p[None, :, :]) ** 2).sum(-1))
    return out


def metric_tree(points: DataFrame, leaf: int, fan: int, chunk: int) -> tuple[DataFrame, list[DataFrame]]:
    """(points with their leaf ``node``, one table (repo_id, node, child, x, radius, inner) of children per level).

    Node 0 is a repository's root; the children of node n are fan * n + 1 to fan * n + fan. A pivot is one of the node's points and
    nearest to itself, so each child is smaller than its node.
    """
    open_, levels, done = cut_lineage(points.withColumn("node", F.lit(0).cast("long")), "tree-points"), [], None
    while True:
        last = len(levels) == MOST_LEVELS
        sizes = open_.groupBy("repo_id", "node").agg(F.count(F.lit(1)).alias("n"))
        crowded = sizes.filter(F.lit(not last) & (F.col("n") > leaf)).withColumn("kids", F.greatest(F.lit(2), F.least(F.lit(fan), F.ceil(F.col("n") / leaf))))
        crowded = cut_lineage(crowded, "crowded")
        small = open_.join(crowded, ["repo_id", "node"], "left_anti")
        done = small if done is None else done.unionByName(small)
        if crowded.isEmpty():
            return cut_lineage(done, "leaves"), levels
        rows = open_.join(crowded, ["repo_id", "node"])
        draw = Window.partitionBy("repo_id", "node").orderBy(F.xxhash64("point", F.lit(len(levels))), "point")
        pivots = rows.withColumn("i", F.row_number().over(draw)).filter((F.col("i") <= F.col("kids")) & (F.col("i") <= fan))
        pivots = cut_lineage(pivots.select("repo_id", "node", (F.col("node") * fan + F.col("i")).alias("child"), "x"), "pivots")

        def nearest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("child")
            d = _distances(np.stack(q["x"].to_numpy()), np.stack(p["x"].to_numpy()))
            at = d.argmin(axis=1)
            return q.assign(child=p["child"].to_numpy()[at], away=d[np.arange(len(q)), at])

        schema = "repo_id string, node long, point string, x array<double>, weight long, child long, away double"
        # all pivots of a node are in one part: there are at most ``fan``
        placed = cut_lineage(_shared(rows.drop("n", "kids"), pivots.withColumn("row", F.col("child")), max(chunk, fan), _each(nearest), schema), "assigned")
        radii = placed.groupBy("repo_id", "node", "child").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
        inner = (F.col("n") > leaf) & F.lit(len(levels) + 1 < MOST_LEVELS)
        levels.append(cut_lineage(pivots.join(radii, ["repo_id", "node", "child"]).withColumn("inner", inner).drop("n"), "children"))
        open_ = placed.select("repo_id", F.col("child").alias("node"), "point", "x", "weight")


def _reachable(levels: list[DataFrame], queries: DataFrame, chunk: int) -> DataFrame:
    """(repo_id, point, node, low): leaves that may hold a point within a query's ``bound``, with their lower bounds."""

    def lower(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("child")
        x = np.stack(p["x"].to_numpy())
        d = _distances(np.stack(q["x"].to_numpy()), x)
        own = d.argmin(axis=1)
        near = d[np.arange(len(q)), own]
        apart = _distances(x, x)[own]
        plane = np.divide(d**2 - near[:, None] ** 2, 2 * apart, out=np.zeros_like(d), where=apart > 0)
        low = np.maximum(np.maximum(d - p["radius"].to_numpy(), plane), 0.0)
        low = np.maximum(low, q["low"].to_numpy()[:, None])
        i, j = np.nonzero(low <= q["bound"].to_numpy()[:, None])
        return pd.DataFrame({
            "repo_id": q["repo_id"].to_numpy()[i], "point": q["point"].to_numpy()[i], "x": q["x"].to_numpy()[i], "bound": q["bound"].to_numpy()[i],
            "low": low[i, j], "node": p["child"].to_numpy()[j], "inner": p["inner"].to_numpy()[j],
        })

    schema = "repo_id string, point string, x array<double>, bound double, low double, node long, inner boolean"
    frontier, found = queries.withColumns({"node": F.lit(0).cast("long"), "low": F.lit(0.0)}), None
    for children in levels:
        stored = children.select("repo_id", "node", "child", "x", "radius", "inner", F.col("child").alias("row"))
        seen = cut_lineage(_shared(frontier, stored, max(chunk, FAN), _each(lower), schema), "frontier")
        leaves = seen.filter("not inner").select("repo_id", "point", "node", "low")
        found = leaves if found is None else found.unionByName(leaves)
        frontier = seen.filter("inner").drop("inner")
    return found


def _merged(near: DataFrame, k: int) -> DataFrame:
    """The first neighbours of each point whose weights reach ``k``. A weight may be cut at k before, never below what the list can use."""
    order = Window.partitionBy("repo_id", "point").orderBy("distance", "neighbour")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = near.withColumn("__b", before).withColumn("weight", F.least("weight", F.lit(k) - F.col("__b")))
    return kept.filter("weight > 0").drop("__b")


def knn(points: DataFrame, k: int, leaf: int = LEAF, chunk: int = CHUNK, fan: int = FAN, visits: list[DataFrame] | None = None) -> DataFrame:
    """(repo_id, point, neighbour, distance, weight): the k nearest others of each point, copies counted by weight.

    ``visits``: a list that gets, for each round, a table (repo_id, pairs) of the pairs compared.
    """
    stored, levels = metric_tree(points, leaf, fan, chunk)
    shelf = stored.withColumn("row", F.col("point"))

    def visit(asked: DataFrame) -> DataFrame:
        if visits is not None:
            sizes = stored.groupBy("repo_id", "node").agg(F.count(F.lit(1)).alias("n"))
            visits.append(asked.groupBy("repo_id", "node").agg(F.count(F.lit(1)).alias("q")).join(sizes, ["repo_id", "node"]).groupBy("repo_id").agg(F.sum(F.col("q") * F.col("n")).alias("pairs")))
        # a crowded leaf comes in parts, each with its own list
        return _shared(asked, shelf, chunk, lambda q, p, groups: _nearest(q, p, groups, k), _NEAR)

    near = cut_lineage(_merged(visit(stored.select("repo_id", "node", "point", "x")), k), "neighbours")
    if not levels:
        return near
    limit = near.groupBy("repo_id", "point").agg(F.max("distance").alias("far"), F.sum("weight").alias("got"))
    limit = limit.select("repo_id", "point", F.when(F.col("got") >= k, F.col("far") + SLACK).otherwise(F.lit(float("inf"))).alias("bound"))
    queries = stored.filter("node > 0").select("repo_id", "point", "x", F.col("node").alias("own"))
    bounded = queries.join(limit, ["repo_id", "point"], "left").na.fill(float("inf"), subset=["bound"])
    reach = _reachable(levels, bounded.drop("own"), chunk).join(queries, ["repo_id", "point"]).filter("node <> own").drop("own")
    turn = F.row_number().over(Window.partitionBy("repo_id", "point").orderBy("low", "node"))
    todo, upto = cut_lineage(reach.withColumn("turn", turn), "to-visit"), FIRST_LEAVES
    while not todo.isEmpty():
        found = visit(todo.filter(F.col("turn") <= upto).select("repo_id", "node", "point", "x"))
        near = cut_lineage(_merged(near.unionByName(found), k), "neighbours")
        limit = near.groupBy("repo_id", "point").agg(F.max("distance").alias("far"), F.sum("weight").alias("got"))
        held = F.when(F.col("got") >= k, F.col("far") + SLACK).otherwise(F.lit(float("inf")))
        rest = todo.filter(F.col("turn") > upto).join(limit.select("repo_id", "point", held.alias("bound")), ["repo_id", "point"], "left")
        todo = cut_lineage(rest.filter(F.coalesce("bound", F.lit(float("inf"))) >= F.col("low")).drop("bound"), "to-visit")
        upto *= 4
    return near


def local_outlier_factor(df: DataFrame, features: list[str], k: int = 10, contamination: float = 0.1, point: str = "run_id",
                         leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """Input rows with ``lof_score`` (negative factor) and ``prediction`` (-1 below the contamination quantile)."""
    points = weighted_points(df, features, point)
    near = knn(points, k, leaf, chunk)
    # With fewer than k others, all of them are used.
    kdist = near.groupBy("repo_id", "point").agg(F.max("distance").alias("kdist"), F.sum("weight").alias("k"))
    other = kdist.select("repo_id", F.col("point").alias("neighbour"), F.col("kdist").alias("their_kdist"))
    reach = near.join(other, ["repo_id", "neighbour"]).withColumn("reach", F.greatest("distance", "their_kdist"))
    density = (
        reach.groupBy("repo_id", "point")
        .agg((F.sum(F.col("reach") * F.col("weight")) / F.sum("weight")).alias("mean_reach"))
        .select("repo_id", "point", (F.lit(1.0) / (F.col("mean_reach") + 1e-10)).alias("density"))
    )
    theirs = density.select("repo_id", F.col("point").alias("neighbour"), F.col("density").alias("theirs"))
    factor = (
        near.join(theirs, ["repo_id", "neighbour"])
        .groupBy("repo_id", "point")
        .agg((F.sum(F.col("theirs") * F.col("weight")) / F.sum("weight")).alias("mean_theirs"))
        .join(density, ["repo_id", "point"])
        .select("repo_id", "point", round_half_up(-F.col("mean_theirs") / F.col("density"), 6).alias("lof_score"))
    )
    scored = points.select("repo_id", "x", "point").join(factor, ["repo_id", "point"]).drop("point")
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.withColumn("x", x).join(scored, ["repo_id", "x"]).drop("x")
    cut = exact_quantile(rows, ["repo_id"], "lof_score", contamination)
    return rows.join(cut, "repo_id").withColumn(
        "prediction", F.when(F.col("lof_score") < F.col("cut"), -1).otherwise(1)
    ).drop("cut")
