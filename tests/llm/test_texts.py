"""Sketches, packing and token attribution."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatewright.llm import attribution, encode, packing, sketches

ODD = ["", " ", "a  b", "a \n b", "x\n\ny z", " lead", "trail ", "né\xa0e à", "日本 語　x", "a\tb c", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|><|endoftext|>", "é<|endoftext|>\n\n  y", "🙂 ok🙂", "\n", "a b\n", "ö" * 40]
SCHEMA = "doc_id long, text string, start string, sections string, ids string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_and_spans_are_those_of_the_whole_text(texts, reference, monkeypatch):
    monkeypatch.setattr(encode, "MEMO_WORDS", 500)
    here = encode.Encoder(encode.default_vocabulary())
    for text in ODD + [t for _, t in texts[:80]]:
        want = reference.encode(text, add_special_tokens=False)
        assert here.ids(text).tolist() == want.ids
        assert here.tokens(text).tolist() == [list(x) for x in want.offsets]


def check_packed(rows, pieces, reference, length):
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(reference.encode(t or "", add_special_tokens=False).ids + [0])
    by_doc: dict = {}
    by_sequence: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sum(p.length for p in pieces) == sum(len(x) for v in ids.values() for x in v)
    for i, got in by_doc.items():
        if len(ids[i]) > 1:
            continue
        at = 0
        for p in sorted(got, key=lambda p: p.start):
            part = np.array(ids[i][0][p.start : p.start + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[i][0]), zlib.crc32(part))
            at += p.length
        assert at == len(ids[i][0])
    for got in by_sequence.values():
        at = 0
        for p in sorted(got, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length
    return len(by_sequence)


@pytest.mark.parametrize(("length", "group"), [(1024, 4096), (64, 20)])
def test_packing(spark, texts, reference, length, group):
    rows = [*texts[:60], (10**6, None), (10**6 + 1, ""), (10**6 + 2, "\n"), (None, "null id"), (3 * 10**6, "twice"), (3 * 10**6, "twice")]
    rows += [(2 * 10**6 + i, t) for i, t in enumerate(ODD)]
    pieces = packing.pack(docs_of(spark, rows), length=length, group_docs=group).collect()
    sequences = check_packed(rows, pieces, reference, length)
    tokens = sum(p.length for p in pieces)
    assert sequences * length - tokens < length * -(-len(rows) // group)


def test_very_many_equal_documents_are_packed_apart(spark):
    docs = spark.range(20_000).selectExpr("cast(null as long) AS doc_id", "'' AS text")
    pieces = packing.pack(docs, group_docs=1000)
    assert pieces.count() == 20_000
    most = pieces.groupBy((F.col("sequence_id") / F.lit(1 << 32)).cast("long")).count().agg(F.max("count"), F.count("*")).first()
    assert most[0] < 1300 and most[1] == 20


def test_a_very_long_document_is_packed_whole(spark, reference):
    text = "long words and short ones " * 40_000 + "end" * 100_000
    pieces = packing.pack(docs_of(spark, [(1, text), (2, "x")])).collect()
    assert check_packed([(1, text), (2, "x")], pieces, reference, 1024) == -(-sum(p.length for p in pieces) // 1024)


def test_packing_nothing(spark):
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_items_go_to_the_cheapest_sequence_with_room():
    placed = packing.assign(np.array([10, 9, 8, 3, 2]), 16)
    # longest first to the emptier one; 3 fits neither 10 + 8 nor leaves 9 + 8 room, so it goes to 10; 2 is cut to fill both
    assert [(i, n, s) for i, _, n, s, _ in placed] == [(0, 10, 0), (1, 9, 1), (2, 7, 1), (2, 1, 0), (3, 3, 0), (4, 2, 0)]
    draw = random.Random(1)
    for _ in range(50):
        n = np.array(sorted((draw.randint(1, 99) for _ in range(draw.randint(1, 60))), reverse=True))
        used: dict = {}
        for item, first, size, sequence, offset in packing.assign(n, 100):
            assert offset == used.get(sequence, 0)
            used[sequence] = offset + size
        assert len(used) == -(-int(n.sum()) // 100) and max(used.values()) <= 100


def brute_owner(start, end, spans, rule):
    def at(c):
        held = [k for k, (_, a, b) in enumerate(spans) if a <= c < b]
        return held[-1] if held else -1

    if rule == "most":
        inside = [at(c) for c in range(start, max(end, start + 1))]
        known = [x for x in inside if x >= 0]
        return max(known, key=lambda x: (known.count(x), -known.index(x))) if known else -1
    return at(start) if rule == "start" else at(max(end - 1, start))


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_equals_brute_force(spark, texts, reference, rule):
    rows = [*texts[:15], (10**6, None), (10**6 + 1, ""), (None, "null id here"), (5 * 10**6, "twice"), (5 * 10**6, "twice")]
    rows += [(2 * 10**6 + i, t) for i, t in enumerate(ODD)]
    draw, cuts = random.Random(2), {}
    for k, (_, t) in enumerate(rows):
        n = len(t or "")
        edges = sorted(draw.sample(range(n + 1), min(n + 1, 6)))
        cuts[k] = [(j, a, b) for j, (a, b) in enumerate(zip(edges, edges[1:])) if j % 3 != 1]
    data = [(i, t, cuts[k] if k % 7 else None, "x") for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, spans array<struct<section:long,start:long,end:long>>, n_tokens string")
    want = []
    for i, t, spans, _ in data:
        spans = spans or []
        own = [(brute_owner(a, b, spans, rule), a, b) for a, b in reference.encode(t or "", add_special_tokens=False).offsets]
        loose = sum(o < 0 for o, _, _ in own)
        if loose:
            want.append((i, None, None, None, loose, 0))
        for k, (s, a, b) in enumerate(spans):
            mine = [(x, y) for o, x, y in own if o == k]
            want.append((i, s, a, b, len(mine), sum(x < a or y > b for x, y in mine)))
    found = attribution.attribute_tokens(docs, docs["spans"], rule=rule).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_to_nested_and_overlapping_sections(spark, texts, reference, rule):
    draw = random.Random(9)
    rows, cuts = [(i, t) for i, (_, t) in enumerate(texts[:25])], {}
    for i, t in rows:
        n = min(len(t), 300)
        cuts[i] = sorted({tuple(sorted((draw.randint(0, n), draw.randint(0, n)))) for _ in range(draw.randint(0, 12))} | {(0, n), (5, 10)})
    data = [(i, t, [(k, a, b) for k, (a, b) in enumerate(cuts[i])], "x") for i, t in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, spans array<struct<section:long,start:long,end:long>>, n_tokens string")
    want = []
    for i, t, spans, _ in data:
        own = [brute_owner(a, b, spans, rule) for a, b in reference.encode(t, add_special_tokens=False).offsets]
        want += [(i, k, own.count(k)) for k, _, _ in spans] + ([(i, None, own.count(-1))] if -1 in own else [])
    found = attribution.attribute_tokens(docs, docs["spans"], rule=rule).select("doc_id", "section", "n_tokens").collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_line_sections_cover_the_text(spark, texts):
    rows = [*texts[:20], (10**6, None), (10**6 + 1, "a\n\nb\n")]
    docs = docs_of(spark, rows)
    spans = {r[0]: r[1] for r in docs.select("doc_id", attribution.line_sections("text")).collect()}
    for i, t in rows:
        assert "".join((t or "")[s.start : s.end] for s in spans[i]) == (t or "")
        assert len(spans[i]) == (t or "").count("\n") + 1
    counts = attribution.attribute_tokens(docs, attribution.line_sections("text"))
    assert counts.where("section is null").count() == 0
    assert attribution.attribute_tokens(docs_of(spark, []), attribution.line_sections("text")).count() == 0


def test_sections_from_a_table(spark):
    docs = docs_of(spark, [(1, "one two"), (2, "three")])
    table = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 3, 7)], "doc_id long, section long, start long, end long")
    with_spans = attribution.sections_of(docs.select("doc_id", "text"), table)
    found = sorted(map(tuple, attribution.attribute_tokens(with_spans, with_spans["sections"]).collect()), key=str)
    assert found == [(1, 0, 0, 3, 1, 0), (1, 1, 3, 7, 1, 0), (2, None, None, None, 1, 0)]


def keys_of(text: str) -> set:
    return set(sketches.paragraphs([text.encode()])[1].tolist())


def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        a, b, c = keys_of(t), keys_of(edited), keys_of(after)
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)))
    return out


@pytest.mark.parametrize("bucket", [8192, 7])
def test_edit_fingerprints_equal_brute_force(spark, texts, monkeypatch, bucket):
    monkeypatch.setattr(sketches, "BUCKET_ROWS", bucket)
    rows = [*texts[:70], (10**6, None), (10**6 + 1, ""), (10**6 + 2, "one"), (None, "no id. At all."), (-5, "In. " * 90), (10**7, "no end " * 200)]
    found = sketches.fingerprint_edits(docs_of(spark, rows)).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    assert sorted(got, key=str) == sorted(brute_edits(rows), key=str)
    by_text: dict = {}
    for r in found:
        by_text.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_one_document_follows_itself_and_none_is_none(spark):
    one = sketches.fingerprint_edits(docs_of(spark, [(1, "abcdef")])).first()
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"abcdab").hexdigest(), 1.0)
    assert sketches.fingerprint_edits(docs_of(spark, [])).count() == 0


def test_peeling_recovers_exactly_the_difference():
    draw = np.random.default_rng(4)
    pairs = 30
    sides = []
    shared = draw.integers(1, 1 << 62, (pairs, 40)).astype(np.uint64)
    for _ in range(2):
        own = [draw.integers(1, 1 << 62, int(draw.integers(0, 200))).astype(np.uint64) for _ in range(pairs)]
        sides.append((np.concatenate([np.full(40 + len(x), i) for i, x in enumerate(own)]), np.concatenate([np.r_[shared[i], x] for i, x in enumerate(own)])))
    pair, key, sign = sketches.differing(pairs, *sides)
    for i in range(pairs):
        a, b = (set(k[o == i].tolist()) for o, k in sides)
        assert set(key[(pair == i) & (sign > 0)].tolist()) == a - b
        assert set(key[(pair == i) & (sign < 0)].tolist()) == b - a


def test_texts_of_new_words_are_encoded_whole(reference, monkeypatch):
    monkeypatch.setattr(encode, "MEMO_WORDS", 100)
    calls, here, again = [], encode.Encoder(encode.default_vocabulary()), encode.Encoder(encode.default_vocabulary())
    rng = random.Random(3)
    fresh = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(60)) for _ in range(6)]
    assert [here.ids(t).tolist() for t in fresh] == [reference.encode(t, add_special_tokens=False).ids for t in fresh]
    monkeypatch.setattr(here, "_whole", lambda text, whole=here._whole: calls.append(text) or whole(text))
    assert here.ids(fresh[0]).tolist() == reference.encode(fresh[0], add_special_tokens=False).ids
    assert calls == [fresh[0]] and not here.memo and not here.last
    same = " ".join(f"w{k % 5}" for k in range(400))
    assert [again.ids(same).tolist() for _ in range(3)] == [reference.encode(same, add_special_tokens=False).ids] * 3 and again.memo
