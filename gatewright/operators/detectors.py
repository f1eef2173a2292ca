"""Anomaly detectors for all repositories at once: isolation forest and an RBF one-class score."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright import params as P
from gatewright.functions.numbers import hash_unit, round_half_even_int, round_half_up
from gatewright.operators.batches import BATCH_ROWS, batch_of, batches_for, met_in_batches, positions
from gatewright.operators.features import scaling_stats, scaled
from gatewright.operators.ranking import exact_quantile
from gatewright.session import cut_lineage, spread

TREES = 100
SAMPLE = 256
ROWS_PER_TASK = 20000
#: Sampled rows whose forests grow together, about, and stored forests in a batch.
GROWN_ROWS, FORESTS = 1000, 32
FOURIER = 256
FOREST_SCHEMA = (
    "repo_id string, feature array<int>, threshold array<double>, child array<int>, length array<double>, "
    "trees int, sample_size int"
)


# ---- labelled evaluation set -------------------------------------------------------------------------------------
def perturbed_copies(holdout: DataFrame, seed: int = P.SEED, point: str = "run_id") -> DataFrame:
    """One perturbed copy of each holdout row by the fixed recipe, from hash uniforms."""
    def between(name: str) -> F.Column:
        low, high = P.PERTURBATION[name]
        return F.lit(float(low)) + F.lit(float(high - low)) * hash_unit(F.col("repo_id"), F.col(point), F.lit(name), F.lit(seed))

    def whole(name: str) -> F.Column:
        low, high = P.PERTURBATION[name]
        u = hash_unit(F.col("repo_id"), F.col(point), F.lit(name), F.lit(seed))
        return F.lit(low) + F.floor(u * F.lit(float(high - low + 1)))

    def rounded(c: F.Column) -> F.Column:
        return round_half_even_int(c).cast("double")

    changed = {
        "total_alerts": rounded(F.col("total_alerts") * between("total_alerts_multiplier")),
        "high_alerts": rounded(F.col("high_alerts") + whole("high_alerts_increment")),
        "high_commit_risk": rounded(F.col("high_commit_risk") + whole("high_commit_risk_increment")),
        "total_files_scanned": F.greatest(
            rounded(F.col("total_files_scanned") * between("total_files_scanned_shrink_ratio")), F.lit(1.0)
        ),
        "alerts_per_file": round_half_up(F.col("alerts_per_file") * between("alerts_per_file_multiplier"), 2),
        **{
            c: rounded(F.greatest(F.col(c).cast("double"), F.lit(0.0)))
            for c in ("medium_alerts", "low_alerts", "medium_commit_risk", "low_commit_risk")
        },
    }
    return holdout.select(
        *[c for c in holdout.columns if c not in P.ANOMALY_FEATURES],
        *[changed[c].alias(c) for c in P.ANOMALY_FEATURES],
    )


def evaluation_set(holdout: DataFrame, seed: int = P.SEED, point: str = "run_id") -> DataFrame:
    """Holdout rows (label 0) and their perturbed copies (label 1)."""
    plain = holdout.withColumns({c: F.col(c).cast("double") for c in P.ANOMALY_FEATURES})
    return plain.withColumn("label", F.lit(0)).unionByName(perturbed_copies(plain, seed, point).withColumn("label", F.lit(1)))


# ---- scaling per repository --------------------------------------------------------------------------------------
def scaler(train: DataFrame, features: list[str] | None = None) -> DataFrame:
    return scaling_stats(train, features or P.ANOMALY_FEATURES, ["repo_id"])


def scale(df: DataFrame, stats: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Add ``x``: the scaled features as an array, by the repository's statistics."""
    features = features or P.ANOMALY_FEATURES
    joined = df.join(stats, "repo_id")
    x = F.array(*[round_half_up(scaled(f), 9) for f in features])
    return joined.select(*df.columns, x.alias("x"))


# ---- isolation forest --------------------------------------------------------------------------------------------
def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    long = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def _split_ranges(x: np.ndarray, row: np.ndarray, sizes: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, low, high) of each node: of the features that vary among its rows the one that drew the largest number.

    ``row`` lists the rows node by node, ``sizes`` how many each has. Features are tried from the largest number down, so most nodes
    look at few of them; where all rows agree low and high are 0.
    """
    pick, low, high = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
    turns = np.argsort(-drawn, axis=1, kind="stable")
    open_ = np.flatnonzero(sizes > 1)
    row, sizes = row[np.repeat(sizes > 1, sizes)], sizes[open_]
    for turn in range(drawn.shape[1]):
        if not len(open_):
            break
        feature = turns[open_, turn]
        values, starts = x[row, np.repeat(feature, sizes)], np.cumsum(sizes) - sizes
        a, b = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
        varies = b > a
        at = open_[varies]
        pick[at], low[at], high[at] = feature[varies], a[varies], b[varies]
        row, open_, sizes = row[np.repeat(~varies, sizes)], open_[~varies], sizes[~varies]
    return pick, low, high


def grow_forests(
    x: np.ndarray, row: np.ndarray, owner: np.ndarray, tree: np.ndarray, trees: int, limits: np.ndarray, rngs: list[np.random.Generator]
) -> dict[str, np.ndarray]:
    """All trees of several forests together, one level at a time. ``row`` tells which of ``x`` a tree sees, ``owner`` of which forest
    and ``tree`` which tree that is.

    Node ``forest * trees + tree`` is a root; a level's nodes follow each other by forest. A forest draws from its own generator, the
    same numbers whatever forests grow beside it.
    """
    feature, threshold, child, length, owners = [], [], [], [], []
    held = np.repeat(np.arange(len(limits)), trees)  # the forest of each node of the level
    node, first, count = owner.astype(np.int64) * trees + tree, 0, len(held)
    total, depth = count, 0
    while count:
        f = np.full(count, -1, dtype=np.int32)
        t, c = np.zeros(count), np.full(count, -1, dtype=np.int64)
        sizes = np.bincount(node - first, minlength=count)
        leaf_length = depth + _average_path(sizes)
        grows = limits[held[node - first]] > depth
        if not grows.all():
            row, node = row[grows], node[grows]
        new = 0
        if len(node):
            place = node - first
            order = np.argsort(place.astype(np.uint16) if count <= 1 << 16 else place, kind="stable")  # short keys sort by digits
            row, node = row[order], node[order]
            starts = np.flatnonzero(np.r_[True, np.diff(node) > 0])
            ids = node[starts] - first
            each = np.bincount(held[ids], minlength=len(limits))
            drawn = [(rngs[r].random((each[r], x.shape[1])), rngs[r].random(each[r])) for r in np.flatnonzero(each)]
            pick, a, b = _split_ranges(x, row, np.diff(np.r_[starts, len(row)]), np.concatenate([d[0] for d in drawn]))
            cut = np.minimum(a + (b - a) * np.concatenate([d[1] for d in drawn]), np.nextafter(b, -np.inf))
            splits = b > a
            f[ids[splits]] = pick[splits]
            t[ids[splits]] = cut[splits]
            c[ids[splits]] = total + 2 * np.arange(splits.sum())
            new = 2 * int(splits.sum())
        feature.append(f), threshold.append(t), child.append(c), length.append(leaf_length), owners.append(held)
        if new:
            own = node - first
            inner = f[own] >= 0
            row, own = row[inner], own[inner]
            right = x[row, f[own]] > t[own]
            node = c[own] + right
            held = np.repeat(held[ids[splits]], 2)
        first, count, total, depth = total, new, total + new, depth + 1
    return {k: np.concatenate(v) for k, v in
            {"feature": feature, "threshold": threshold, "child": child, "length": length, "owner": owners}.items()}


def _repo_rng(repo: str, seed: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{repo}|{seed}".encode()).digest()[:8], "big"))


def forest_sample(train: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = P.SEED, point: str = "run_id") -> DataFrame:
    """(repo_id, n, tree, draw, point, x): the rows that a repository's trees are grown from (of scaled rows ``repo_id, run_id, x``).

    A repository of at most ``sample`` rows sends each row once (tree -1: all trees see it). A larger one sends, per tree,
    the rows whose hash falls below a threshold slightly above sample/n; the task then keeps the ``sample`` smallest.
    So a group never exceeds about ``trees * sample`` rows, however many runs the repository has.
    """
    sizes = train.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    sent = train.select("repo_id", point, "x").join(sizes, "repo_id")
    share = F.lit(sample + 8 * sample**0.5 + 16) / F.col("n")

    def draw(t: F.Column) -> F.Column:
        return F.pmod(F.xxhash64(F.col(point), t, F.lit(seed)), F.lit(2**40)) / F.lit(float(2**40))

    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share)
    rows = sent.withColumn("tree", F.explode(F.when(F.col("n") <= sample, F.array(F.lit(-1))).otherwise(chosen)))
    return rows.withColumn("draw", draw(F.col("tree"))).select("repo_id", "n", "tree", "draw", F.col(point).alias("point"), "x")


def _sample_rows(n: Column, trees: int, sample: int) -> Column:
    """Rows that a repository of ``n`` rows sends."""
    return F.when(n <= sample, n).otherwise(F.lit(trees) * F.least(n, F.lit(int(sample + 8 * sample**0.5 + 17))))


def _grown(pdf: pd.DataFrame, groups: list[np.ndarray], trees: int, sample: int, seed: int) -> dict[str, np.ndarray]:
    """The forests of some repositories, whose sampled rows are at the positions ``groups``."""
    x, repos, sizes = np.stack(pdf["x"].to_numpy()), pdf["repo_id"].to_numpy(), pdf["n"].to_numpy()
    rows, owner, tree = [], [], []
    for number, at in enumerate(groups):
        if sizes[at[0]] <= sample:
            rows.append(np.tile(at, trees))
            tree.append(np.repeat(np.arange(trees), len(at)))
        else:
            some = pdf.iloc[at].assign(at=at).sort_values(["tree", "draw", "point"], kind="stable")
            some = some[some.groupby("tree").cumcount() < sample]
            rows.append(some["at"].to_numpy())
            tree.append(some["tree"].to_numpy())
        owner.append(np.full(len(rows[-1]), number))
    size = np.array([min(sample, int(sizes[at[0]])) for at in groups])
    limits = np.ceil(np.log2(np.maximum(size, 2))).astype(int)
    rngs = [_repo_rng(repos[at[0]], seed) for at in groups]
    grown = grow_forests(x, np.concatenate(rows), np.concatenate(owner), np.concatenate(tree), trees, limits, rngs)
    return {**grown, "size": size}


def _some(groups: list, sizes: list[int]) -> Iterator[list]:
    """The groups in runs of about ``GROWN_ROWS`` rows."""
    run, rows = [], 0
    for group, size in zip(groups, sizes):
        run.append(group)
        rows += size
        if rows >= GROWN_ROWS:
            yield run
            run, rows = [], 0
    if run:
        yield run


def fit_forest(train: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = P.SEED, point: str = "run_id") -> DataFrame:
    """One row per repository with its forest. Repositories meet in batches of bounded size."""
    rows = forest_sample(train, trees, sample, seed, point)
    sizes = train.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    batches = batches_for(train.sparkSession, sizes.agg(F.sum(_sample_rows(F.col("n"), trees, sample))).first()[0])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = list(positions(pdf, ["repo_id"]).values())
        repos, out = pdf["repo_id"].to_numpy(), []
        for run in _some(groups, [len(at) for at in groups]):
            grown = _grown(pdf, run, trees, sample, seed)
            order = np.argsort(grown["owner"], kind="stable")  # a forest's nodes keep their order
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            ends = np.cumsum(np.bincount(grown["owner"], minlength=len(run)))
            child = grown["child"]
            child = np.where(child >= 0, place[child], -1)[order]
            for at, size, start, end in zip(run, grown["size"], np.r_[0, ends[:-1]], ends):
                nodes, kids = order[start:end], child[start:end]
                out.append({
                    "repo_id": repos[at[0]], "feature": grown["feature"][nodes], "threshold": grown["threshold"][nodes],
                    "child": np.where(kids >= 0, kids - start, -1).astype(np.int32), "length": grown["length"][nodes], "trees": trees, "sample_size": size,
                })
        return pd.DataFrame(out)

    dealt = spread(rows.withColumn("__batch", batch_of(["repo_id"], batches)), "__batch")
    return dealt.groupBy("__batch").applyInPandas(build, FOREST_SCHEMA)


def _depth_scores(x: np.ndarray, root: np.ndarray, forest: dict, trees: int, sample_size: np.ndarray) -> np.ndarray:
    """Minus the anomaly score of each row, as in ``2 ** (-mean depth / c(sample))``; ``root`` is the first tree of each row's forest."""
    feature, threshold, child, length = (np.asarray(forest[c]) for c in ("feature", "threshold", "child", "length"))
    out = np.empty(len(x))
    for start in range(0, len(x), 2048):
        part = x[start : start + 2048]
        rows = np.arange(len(part))[:, None]
        node = root[start : start + 2048, None] + np.arange(trees)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = part[rows, np.maximum(f, 0)] > threshold[node]
            node = np.where(inner, child[node] + right, node)
        depth = length[node].mean(axis=1)
        scale = _average_path(sample_size[start : start + 2048])
        out[start : start + len(part)] = np.where(scale > 0, -np.exp2(-depth / np.where(scale > 0, scale, 1.0)), -0.5)
    return out


def _row_shares(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their ``share`` of at most about ``ROWS_PER_TASK``, the repositories that have several: (repo_id, shares)).

    Those are at most one for each ``ROWS_PER_TASK`` rows, so they are broadcast.
    """
    counts = rows.groupBy("repo_id").agg((F.floor(F.count(F.lit(1)) / ROWS_PER_TASK) + 1).alias("shares"))
    large = cut_lineage(counts.filter("shares > 1"), "large-repositories")
    number = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "repo_id"]), F.col("shares"))
    return rows.join(F.broadcast(large), "repo_id", "left").withColumn("share", F.coalesce(number, F.lit(0))).drop("shares"), large


def _for_shares(df: DataFrame, large: DataFrame) -> DataFrame:
    """A copy of each repository's rows for each of its shares."""
    last = F.coalesce(F.col("shares"), F.lit(1).cast("long")) - 1
    return df.join(F.broadcast(large), "repo_id", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("shares")


def forest_score(rows: DataFrame, forest: DataFrame) -> DataFrame:
    """Add ``sample_score`` (higher is more normal) to scaled rows.

    A repository's rows are cut into shares of bounded size; its forest (about 1 MB) is copied to each share. Forests are
    never broadcast, since there are as many as repositories; some meet in a batch.
    """
    shared, large = _row_shares(rows)
    size = rows.agg(F.count(F.lit(1)) + F.count_distinct("repo_id") * (BATCH_ROWS // FORESTS)).first()[0]
    schema = rows.withColumn("sample_score", F.lit(0.0)).schema

    def score(left: pd.DataFrame, right: pd.DataFrame, groups: list) -> pd.DataFrame:
        x, out, done = np.stack(left["x"].to_numpy()), np.empty(len(left)), np.zeros(len(left), dtype=bool)
        for mine, theirs in groups:
            held = right.iloc[theirs[0]]
            sample_size = np.full(len(mine), int(held["sample_size"]))
            out[mine] = _depth_scores(x[mine], np.zeros(len(mine), dtype=np.int64), held, int(held["trees"]), sample_size)
            done[mine] = True
        return left.assign(sample_score=np.round(out, 9))[done]

    batches = batches_for(rows.sparkSession, size)
    return met_in_batches(shared, _for_shares(forest, large), ["repo_id", "share"], batches, score, schema)


def grown_forest_score(rows: DataFrame, train: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = P.SEED, point: str = "run_id") -> DataFrame:
    """What ``forest_score(rows, fit_forest(train))`` returns, for forests that nothing else needs.

    A forest is a thousand times as large as a row that it is grown from. So the sampled rows go to the rows that are scored, and the
    forests, the same as ``fit_forest`` makes, grow and end where these are.
    """
    shared, large = _row_shares(rows)
    sizes = train.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    sent = _for_shares(sizes, large).agg(F.sum(_sample_rows(F.col("n"), trees, sample))).first()[0] or 0
    batches = batches_for(rows.sparkSession, sent + rows.count())
    schema = rows.withColumn("sample_score", F.lit(0.0)).schema

    def score(left: pd.DataFrame, right: pd.DataFrame, groups: list) -> pd.DataFrame:
        x, out, done = np.stack(left["x"].to_numpy()), np.empty(len(left)), np.zeros(len(left), dtype=bool)
        for run in _some(groups, [len(g[1]) for g in groups]):
            grown = _grown(right, [g[1] for g in run], trees, sample, seed)
            at = np.concatenate([g[0] for g in run])
            owner = np.repeat(np.arange(len(run)), [len(g[0]) for g in run])
            out[at] = _depth_scores(x[at], owner * trees, grown, trees, grown["size"][owner])
            done[at] = True
        return left.assign(sample_score=np.round(out, 9))[done]

    return met_in_batches(shared, _for_shares(forest_sample(train, trees, sample, seed, point), large), ["repo_id", "share"], batches, score, schema)


# ---- RBF one-class score -----------------------------------------------------------------------------------------
def fourier_weights(width: int, components: int = FOURIER, seed: int = P.SEED) -> tuple[np.ndarray, np.ndarray]:
    """Normal directions and uniform phases from md5 uniforms (Box-Muller), the same on every worker and engine."""
    def unit(*parts) -> float:
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52

    w = np.empty((width, components))
    for i in range(width):
        for j in range(components):
            radius = np.sqrt(-2 * np.log(1 - unit("r", i, j, seed)))
            w[i, j] = radius * np.cos(2 * np.pi * unit("a", i, j, seed))
    b = np.array([2 * np.pi * unit("b", j, seed) for j in range(components)])
    return w, b


def _fourier(z: pd.Series, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2 / len(b)) * np.cos(np.stack(z.to_numpy()) @ w + b)


def rbf_gamma(train: DataFrame, width: int) -> DataFrame:
    """(repo_id, gamma): 1 / (columns * variance of all values) of scaled rows ``x``."""
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    plain = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    moments = train.groupBy("repo_id").agg(F.avg(square).alias("q"), F.avg(plain).alias("s"))
    variance = F.col("q") / width - (F.col("s") / width) * (F.col("s") / width)
    return moments.select(
        "repo_id", F.when(variance > 1e-9, F.lit(1.0) / (F.lit(float(width)) * variance)).otherwise(F.lit(1.0)).alias("gamma")
    )


def fit_rbf(train: DataFrame, width: int, seed: int = P.SEED) -> DataFrame:
    """(repo_id, gamma, mean_map) from scaled rows ``x``.

    The score of a row is its mean RBF kernel value to the training rows. Comparing each row with each training row would
    grow with the square of the history; random Fourier features turn the mean kernel into one inner product with a
    mean vector, so training is a single partial aggregate. ``operators/kernel.py`` has the exact and the bounded form.
    """
    w, b = fourier_weights(width, seed=seed)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                phi, parts = _fourier(pdf["z"], w, b), list(positions(pdf, ["repo_id"]).items())
                yield pd.DataFrame({
                    "repo_id": [repo for (repo,), _ in parts], "gamma": pdf["gamma"].to_numpy()[[at[0] for _, at in parts]],
                    "n": [float(len(at)) for _, at in parts], "phi": [phi[at].mean(axis=0) for _, at in parts],
                })

    gammas = rbf_gamma(train, width)
    z = F.transform("x", lambda v: v * F.sqrt(2 * F.col("gamma")))
    rows = train.join(gammas, "repo_id").select("repo_id", "gamma", z.alias("z"))
    # a row a repository and batch leaves Python, not a wide vector for each training row
    features = rows.mapInPandas(summed, "repo_id string, gamma double, n double, phi array<double>")
    mean = Summarizer.metrics("mean").summary(array_to_vector("phi"), F.col("n"))["mean"]
    means = features.groupBy("repo_id").agg(F.first("gamma").alias("gamma"), mean.alias("m"))
    return means.select("repo_id", "gamma", vector_to_array("m").alias("mean_map"))


def rbf_score(rows: DataFrame, model: DataFrame, width: int, seed: int = P.SEED) -> DataFrame:
    """Add ``sample_score``: the mean kernel value to the repository's training rows (higher is more normal)."""
    w, b = fourier_weights(width, seed=seed)

    @F.pandas_udf("double")
    def inner(z: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series(np.round((_fourier(z, w, b) * np.stack(mean.to_numpy())).sum(axis=1), 9))

    z = F.transform("x", lambda v: v * F.sqrt(2 * F.col("gamma")))
    joined = rows.join(model, "repo_id")
    return joined.select(*rows.columns, inner(z, F.col("mean_map")).alias("sample_score"))


# ---- cut and verdict ---------------------------------------------------------------------------------------------
def cut_at(train_scores: DataFrame, share: float) -> DataFrame:
    """(repo_id, cut): the quantile of the training scores below which a row counts as anomalous."""
    return exact_quantile(train_scores, ["repo_id"], "sample_score", share)


def verdict(scores: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``decision_value`` (score minus cut, six digits) and ``prediction`` (-1 anomalous, 1 normal)."""
    value = F.col("sample_score") - F.col("cut")
    return scores.join(cuts, "repo_id").withColumn("prediction", F.when(value < 0, -1).otherwise(1)).withColumn(
        "decision_value", round_half_up(value, 6)
    ).drop("cut")
