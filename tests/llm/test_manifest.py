"""The Merkle manifest against a tree built with hashlib."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gatewright.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp string, place string, items string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, more: int = 0) -> str:
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, n_chars if n_chars is None else n_chars + more, text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each digest what stands left and right of it and its ancestors."""
    proofs, owner, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, at in enumerate(owner):
            first = at // arity * arity
            proofs[k].append(("".join(level[first:at]), "".join(level[at + 1 : first + arity])))
        owner = [at // arity for at in owner]
        level = [sha(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], proofs


def brute(rows: list[tuple], arity: int) -> list[tuple]:
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own[g] = tree([leaf(r) for r in groups[g]], arity)
    root, over = tree([own[g][0] for g in order], arity) if order else ("", [])
    out = []
    for g, above in zip(order, over):
        for row, proof in zip(groups[g], own[g][1]):
            proof = proof + above
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            h = leaf(row, int(changed))
            for left, right in proof:
                h = sha(left, h, right)
            out.append((row[0], leaf(row), own[g][0], root, sha(*(a + b for a, b in proof)), h, h == root))
    return out


def corpus(seed: int, n: int) -> list[tuple]:
    draw = random.Random(seed)
    out = [(i * 3 - 7, draw.choice(["", "é x", "a" * 50, None, f"text {i}"]), draw.choice(["en", "en", "en", "de", "", None, "é", "z"]), draw.choice([None, "s"]), draw.choice([None, i])) for i in range(n)]
    draw.shuffle(out)
    return out + [(5, "b", "en", "s", 1), (5, "a", "en", "s", 1), (None, "x", "en", None, 1), (9, "only one", "alone", None, (1 << 63) - 1)] + out[:6]


@pytest.mark.parametrize(("n", "arity", "levels"), [(140, 2, 8), (140, 2, 2), (37, 3, 1), (0, 2, 1)])
def test_proofs_equal_brute_force(spark, n, arity, levels):
    rows = corpus(n, n)
    kept = merkle.manifest(docs_of(spark, rows), keep={"doc_id": F.col("doc_id"), "changed": merkle.tampered(docs_of(spark, []))}, arity=arity, levels=levels)
    found = kept.withColumn("folded", merkle.folded(F.coalesce("changed", "leaf"), F.col("proof")))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, sha(*(s.left + s.right for s in r.proof)), r.folded, r.folded == r.root) for r in found.collect()]
    assert sorted(got, key=str) == sorted(brute(rows, arity), key=str)


def test_every_size_of_a_group(spark):
    for n in range(1, 12):
        rows = [(i, f"t{i}", "en", "s", i) for i in range(n)]
        found = merkle.manifest(docs_of(spark, rows), keep={"doc_id": F.col("doc_id")}, levels=1)
        assert {r.root for r in found.collect()} == {brute(rows, 2)[0][3]}


def test_tampering_is_noticed(spark):
    rows = [*corpus(4, 90), (14, "long " * 100_000, "en", "s", 500_000)]
    found = merkle.verified_manifest(docs_of(spark, rows))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(brute(rows, 2), key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


def test_many_equal_rows_are_leaves_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 100)
    rows = [(1, "same", "en", "s", 4)] * 1000 + [(i, f"t{i}", "en", "s", 4) for i in range(50)]
    found = merkle.verified_manifest(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows, 2))


def test_manifest_of_nothing(spark):
    assert merkle.verified_manifest(docs_of(spark, [])).count() == 0
