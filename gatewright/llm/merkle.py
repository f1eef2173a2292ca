"""Merkle manifest of a table: a digest tree for each group of rows, a tree over the groups' roots, and a proof for each row.

Rows are numbered in their group by a range partitioning of their order. Consecutive nodes form an aligned block, a row that keeps
each level of its part of the tree as one string of hex digests. Substrings of fixed width are hashed to the parents' level, and the
substrings beside a node in its run are its siblings. The roots of blocks are the nodes of the next, smaller table, and so on until
each group has one block. Proofs are then handed down from block to block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.session import cut_lineage

HEX = 64
#: Nodes in a run: so many consecutive digests are hashed to one.
ARITY = 2
#: Levels that a block holds: it has ARITY ** LEVELS nodes.
LEVELS = 8
#: Rows that a range of the numbering should hold at most.
RANGE_ROWS = 500_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def sha(column: Column) -> Column:
    return F.sha2(column, 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row: ``-`` for a null, else the UTF-8 byte count, ``:`` and the value, all concatenated."""
    texts = [v.cast("string") for v in values]
    return sha(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def folded(start: Column, proof: Column) -> Column:
    """The root that a proof leads to from a digest."""
    return F.aggregate(proof, start, lambda h, s: sha(F.concat(s["left"], h, s["right"])))


def proof_digest(proof: Column) -> Column:
    """The digest of all sibling digests of a proof, in order."""
    return sha(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def _whole(number: Column) -> Column:
    return F.floor(number).cast("int")


# --- numbering --------------------------------------------------------------------------------------------------------


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a text column ``grp``) and ``place``, a row's number from 0 in its group by ``order`` (nulls first), and ``n``,
    the rows of the group.

    Rows that agree in ``order`` are numbered one after the other, so no range has to hold them all. Ranges are written before
    they are counted, so a lost executor can't change a number that was used.
    """
    rows = cut_lineage(rows.withColumn("uid", F.monotonically_increasing_id()), "merkle-rows")
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    rows = rows.repartitionByRange(ranges, "grp", *order, "uid").withColumn("range", F.spark_partition_id())
    rows = cut_lineage(rows, "merkle-ranges")
    whole = Window.partitionBy("grp")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("grp", "range")
        .agg(F.count("*").alias("held"))
        .select("grp", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("begin"), F.sum("held").over(whole).alias("n"))
    )
    own = F.row_number().over(Window.partitionBy("grp", "range").orderBy(*order, "uid"))
    return (
        rows.withColumn("own", own)
        .join(cut_lineage(starts, "merkle-starts"), ["grp", "range"])
        .withColumn("place", F.col("begin") + F.col("own") - 1)
        .drop("uid", "range", "own", "begin")
    )


# --- blocks -----------------------------------------------------------------------------------------------------------


def _parents(level: Column, arity: int) -> Column:
    """The string of digests above a string of digests."""
    run = HEX * arity
    count = _whole((F.octet_length(level) + run - 1) / run)
    made = F.transform(F.sequence(F.lit(0), count - 1), lambda i: sha(F.substring(level, i * run + 1, F.lit(run))))
    return F.array_join(made, "").cast("binary")


def _siblings(levels: Column, at: Column, arity: int) -> Column:
    """What stands left and right of node ``at`` and of its ancestors in their runs, from the lowest level to that below the top."""

    def beside(level: Column, j: Column) -> Column:
        own = _whole(at / F.pow(F.lit(arity), j))
        first = _whole(own / arity) * arity
        left = F.substring(level, first * HEX + 1, (own - first) * HEX)
        right = F.substring(level, (own + 1) * HEX + 1, (first + arity - 1 - own) * HEX)
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), beside)


def blocks_of(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` (grp, place, digest, kept, n) to blocks (grp, block, n, items, levels, top). Levels are strings as bytes, which
    substring reaches without counting characters."""
    size = arity**levels
    item = F.struct((F.col("place") % size).cast("int").alias("at"), "digest", "kept")
    rows = nodes.groupBy("grp", F.floor(F.col("place") / size).alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(item), lambda x, y: x["at"] - y["at"]).alias("items")
    )
    base = F.array(F.array_join(F.col("items.digest"), "").cast("binary"))

    def climb(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        ended = (F.col("n") <= size) & (F.octet_length(last) == HEX)
        return F.when(ended, done).otherwise(F.concat(done, F.array(_parents(last, arity))))

    rows = rows.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.lit(levels)), base, climb))
    return cut_lineage(rows.withColumn("top", F.element_at("levels", -1).cast("string")), "merkle-blocks")


def expanded(blocks: DataFrame, arity: int, levels: int) -> DataFrame:
    """Blocks with the proof ``above`` their top to their nodes: (grp, place, digest, kept, proof, and what else blocks have)."""
    rest = [c for c in blocks.columns if c not in ("block", "n", "items", "levels", "top", "above")]

    def node(x: Column) -> Column:
        return F.struct(x["at"], x["digest"], x["kept"], _siblings(F.col("levels"), x["at"], arity).alias("own"))

    rows = blocks.select(*rest, "block", "above", F.explode(F.transform("items", node)).alias("x"))
    return rows.select(
        *rest,
        (F.col("block") * F.lit(arity**levels) + F.col("x.at")).alias("place"),
        F.col("x.digest").alias("digest"),
        F.col("x.kept").alias("kept"),
        F.concat("x.own", "above").alias("proof"),
    )


def rooted(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """The blocks of ``nodes`` with ``above``, the proof of their tops, and ``root``, that of their group.

    A table of blocks a round, each an ``arity ** levels``-th of the one before; whether any group is open is all the driver sees.
    """
    size, tables = arity**levels, []
    while True:
        tables.append(blocks_of(nodes, arity, levels))
        higher = tables[-1].where(F.col("n") > size)
        if higher.isEmpty():
            break
        n = F.ceil(F.col("n") / size).alias("n")
        nodes = higher.select("grp", F.col("block").alias("place"), F.col("top").alias("digest"), F.lit(None).cast("int").alias("kept"), n)
    done = None
    for blocks in reversed(tables):
        now = blocks.where(F.col("n") <= size).select("*", F.array().cast(PROOF).alias("above"), F.col("top").alias("root"))
        if done is not None:
            parents = expanded(done, arity, levels)
            parents = cut_lineage(parents.select("grp", F.col("place").alias("block"), F.col("proof").alias("above"), "root"), "merkle-proofs")
            now = now.unionByName(blocks.where(F.col("n") > size).join(parents, ["grp", "block"]))
        done = now
    return done


# --- the manifest -----------------------------------------------------------------------------------------------------


def manifest(
    rows: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    keep: dict[str, Column] | None = None,
    arity: int = ARITY,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``rows``: (leaf, subroot, root, proof, and a column for each entry of ``keep``).

    A leaf is the digest of ``columns``. The leaves of a ``group`` ascend by ``order``, nulls first; while there are several nodes,
    each run of ``arity`` consecutive ones (the last may be shorter) is hashed to one. The groups' roots, by name, the null group
    first, give ``root`` in the same way. ``proof`` holds for each level the run's digests left and right of the row's own,
    from the leaf to the root; a node alone in its run has empty texts there, and a tree of one row no level at all.

    Null values count as ``-``; empty texts are values. A null group is a group and differs from the empty one. Rows of equal group
    and order follow each other by leaf; equal rows are leaves of their own, each with its proof. An empty table gives an empty
    result. Columns not named are not read, so their names don't matter. Texts of any length are hashed whole.

    Scale: texts are read once and never shuffled. What is shuffled has some 100 bytes a row, by ranges and by blocks, so a hot group is
    spread like any other. Proofs (64 bytes a level) are made beside the blocks' strings and not shuffled.
    """
    kept = F.struct(F.col(order).alias("__order"), *(v.alias(k) for k, v in (keep or {}).items()))
    # a text that sorts as the group does, null first
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(name.alias("grp"), leaf_digest([F.col(c) for c in columns]).alias("digest"), kept.alias("kept"))
    nodes = numbered(leaves, ["kept.__order", "digest"])
    based = rooted(nodes, arity, levels).withColumnRenamed("root", "subroot")
    groups = based.where("block = 0").select(F.lit("").alias("grp"), F.col("subroot").alias("digest"), F.col("grp").alias("kept"))
    over = expanded(rooted(numbered(groups, ["kept"]), arity, levels), arity, levels)
    over = cut_lineage(over.select(F.col("kept").alias("grp"), F.col("proof").alias("rest"), "root"), "merkle-groups")
    whole = based.join(over, "grp").withColumn("above", F.concat("above", "rest")).drop("rest")
    found = expanded(whole, arity, levels)
    return found.select(*(F.col(f"kept.{k}").alias(k) for k in keep or {}), F.col("digest").alias("leaf"), "subroot", "root", "proof")


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose n_chars is one more, where 7 divides the CRC-32 of the decimal doc_id; else null."""
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    values = [one_more if c == "n_chars" else F.col(c) for c in COLUMNS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf_digest(values))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for ``documents``: each row's proof is folded from its
    leaf, or from its tampered leaf where there is one, and held against the root. A null doc_id is never tampered with, and adding 1 to a
    null n_chars changes nothing. See :func:`manifest` for odd rows."""
    rows = manifest(docs, keep={"doc_id": F.col("doc_id"), "changed": tampered(docs)})
    found = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
