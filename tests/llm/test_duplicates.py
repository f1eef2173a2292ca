"""Near copies, repeated passages and repeated lines against brute force."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gatewright.llm import lines, queries, simhash, substrings
from gatewright.llm.components import connected_components
from gatewright.llm.texts import words_of

SCHEMA = "doc_id long, text string, fingerprint string, spans string, id string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def corpus(seed: int, n: int = 60, words: int = 90) -> list[tuple]:
    """Texts with near copies, shared passages and lines, blanks, nulls and repeated rows."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7))) for _ in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(70)]
    out: list[tuple] = []
    for i in range(n):
        body = [draw.choice(vocabulary) for _ in range(draw.randint(1, words))]
        if i % 5 == 1:
            body = out[-1][1].split()
            body[draw.randrange(len(body))] = "changed"
        if i % 4 == 2:
            at = draw.randrange(len(body))
            a = draw.randrange(15)
            body[at:at] = passage[a : a + draw.randint(40, 60)]
        text = "".join(w + draw.choice([" ", " ", " ", "\n", "\t ", "\x0b"]) for w in body)
        if i % 3 == 0:
            text += "\n  A Line that Many documents share \nshort\n"
        out.append((draw.randrange(10**6), text))
    return out + [(7, None), (8, ""), (9, " \n "), out[0], out[1], (None, out[2][1]), (None, None)]


def brute_print(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = corpus(seed)
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            group[i] = min(group[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 2)
    names = {}
    for (i, _), g in zip(rows, group):
        names.setdefault(g, []).append(i)
    want = [(i, f"{p:016x}", min((x for x in names[g] if x is not None), default=None)) for (i, _), p, g in zip(rows, prints, group)]
    found = [tuple(r) for r in simhash.near_duplicates(docs_of(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_shards_and_leaves_lose_no_link():
    draw = np.random.default_rng(5)
    centres = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << draw.integers(0, 64, (40, 60, 3), dtype=np.uint64)
    points = np.unique(np.r_[draw.integers(0, 1 << 63, 3000, dtype=np.uint64), np.bitwise_xor.reduce(flips, 2).ravel() ^ np.repeat(centres, 60)])
    leaves: list[int] = []
    tree = simhash.grow(points[::7], 2, 40, draw, leaves)
    assert len(leaves) > 4
    together = [set(at.tolist()) for _, at in simhash.route(tree, points, 2)]
    assert set().union(*together) == set(range(len(points)))
    labels = simhash.shard_labels(points, 2)
    for i in range(0, len(points), 5):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2).tolist():
            assert labels[i] == labels[j]
            assert any(i in s and j in s for s in together)


def test_probing_equals_comparing(monkeypatch):
    draw = np.random.default_rng(3)
    points = np.unique(np.bitwise_xor.reduce(np.uint64(1) << draw.integers(0, 64, (1500, 3), dtype=np.uint64), 1))
    plain = simhash.shard_labels(points, 2)
    monkeypatch.setattr(simhash, "PROBE_ROWS", 0)
    monkeypatch.setattr(simhash, "split_at", lambda *a: None)
    probed = simhash.shard_labels(points, 2)
    assert np.array_equal(plain[:, None] == plain, probed[:, None] == probed)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3), (70, 71), (71, 70)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(200)} | {70: 70, 71: 70}
    assert found == want


def brute_repeats(rows):
    """Rows of the same id are one document; null is the smallest id."""
    key = lambda i: -1 if i is None else i
    first: dict = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            first[g] = min(first.get(g, 10**9), key(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < key(i):
                gone |= set(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_repeats_equal_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(20, "a b " * 200), (21, "b a " * 130), (22, "a " * 49), (23, "a " * 50)]
    want = brute_repeats(rows)
    assert sum(r[2] for r in want) > 300
    found = [tuple(r) for r in substrings.without_repeats(docs_of(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other, rest = word.translate(str.maketrans("ab", "ba")), " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}"), (4, f"x{word} {rest}"), (5, "\0" * 8 + f" {rest}"), (6, "\0" * 9 + f" {rest}")]
    want = brute_repeats(rows)
    assert [r[2] for r in want] == [0, 0, 50, 0, 0, 0]
    assert sorted(map(tuple, substrings.without_repeats(docs_of(spark, rows)).collect())) == sorted(want)


def test_hashes_tell_words_apart_and_equal_ones_not():
    draw = random.Random(4)
    pool = ["".join(draw.choice("ab") for _ in range(draw.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 70]))) for _ in range(3000)]
    words = words_of(pa.array([" ".join(pool[:1500]).encode(), b"", " ".join(pool[1500:]).encode()], pa.binary()))
    by_word: dict = {}
    for w, h in zip(pool, words.hashes().tolist()):
        by_word.setdefault(w, set()).add(h)
    assert all(len(v) == 1 for v in by_word.values())
    assert len(set.union(*by_word.values())) == len(by_word) > 500


def test_repeats_of_nothing(spark):
    assert substrings.without_repeats(docs_of(spark, [])).count() == 0


def brute_lines(rows):
    key = lambda i: -1 if i is None else i
    fold = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(fold(line), set()).add(key(i))
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(fold(x)) < 20 or len(holders[fold(x)]) < 3 or key(i) == max(holders[fold(x)])]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_lines_equal_brute_force(spark, batches, fanout):
    rows = corpus(6)
    long_line = "The same long line\tin three documents"
    rows += [(50, f"{long_line}\n{long_line}"), (51, f"x\n {long_line.upper()}"), (52, long_line), (53, "twice only in two documents\n" * 2)]
    rows += [(54, "twice only in two documents"), (55, "\n"), (56, "x" * 19), (57, "x" * 19), (58, "x" * 19)]
    want = brute_lines(rows)
    assert sum(r[3] for r in want) > 10
    found = lines.without_repeated_lines(docs_of(spark, rows), batches=batches, fanout=fanout)
    assert found.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "__n_lines", "__n_dropped"]
    got = [(r["doc_id"], r["text"], r["__n_lines"], r["__n_dropped"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lines_without_ansi(spark):
    rows = [(1, "a line of more than twenty\nx"), (2, "a line of more than twenty"), (3, "a line of more than twenty"), (4, "alone"), (5, None)]
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        found = lines.without_repeated_lines(docs_of(spark, rows)).select("doc_id", "__n_dropped", "text").collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert sorted(map(tuple, found)) == [(1, 1, "x"), (2, 1, ""), (3, 0, rows[2][1]), (4, 0, "alone"), (5, 0, "")]


def test_lines_of_nothing_and_native(spark):
    found = lines.without_repeated_lines(docs_of(spark, []))
    assert found.count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.CHECKS[name])
    names = [d[0] for d in want.description]
    found = queries.QUERIES[name](spark, sf)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want.fetchall())
