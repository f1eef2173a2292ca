"""Large single files: JSON arrays cut while they inflate, quoted CSV cut at any block."""

from __future__ import annotations

import csv
import gzip
import io
import json
import random

import pyarrow as pa
import pytest

from gatewright.sources import readers as S
from gatewright.sources import records as R

WILD = ['a "quoted" word', "brace } and { in it", "line\nbreak", 'back\\slash \\" end', "", "é 日本", "x,y", '"', "}\n{", "tab\tand\rreturn", "two\r\nlines", '""', ' ",\n" ']


def objects(seed, n):
    draw = random.Random(seed)
    return [{"toolName": draw.choice(WILD), "k}{": i, "inner": {"list": [{"deep": draw.choice(WILD)}], "n": None}, "warningMessage": draw.choice(WILD) * draw.randint(1, 4)} for i in range(n)]


def write_gz(path, data, indent=None):
    with gzip.open(path, "wt", encoding="utf-8") as out:
        out.write(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False, indent=indent))


def test_objects_are_cut_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "_BATCH", 7)
    sets = [objects(1, 300), [], objects(2, 1), [{}], objects(3, 50)]
    for i, data in enumerate(sets):
        write_gz(tmp_path / f"f{i}.json.gz", data, indent=[None, 2][i % 2])
    found: dict = {}
    for r in R.json_array_records(spark, str(tmp_path)).collect():
        found.setdefault(r["file"][-9:-8], []).append(json.loads(r["value"]))
    assert [found.get(str(i), []) for i in range(5)] == sets


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1}, {"a"', '{"a": 1}', '[{"a": "}"]', '[1, {"a": 2}]', '[{"a": 1}]x'])
def test_what_is_no_whole_array_is_an_error(spark, tmp_path, text):
    write_gz(tmp_path / "f.json.gz", text)
    with pytest.raises(Exception, match="cut off|not an array"):
        R.json_array_records(spark, str(tmp_path)).collect()


def test_plain_files_are_not_cut(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"toolName": "a", "filePath": "f.c"}]')
    with pytest.raises(Exception, match="only gzip"):
        R.json_array_records(spark, str(tmp_path)).collect()
    assert [r["tool"] for r in S.read_warnings(spark, str(tmp_path), True).collect()] == ["a"]


def test_warnings_keep_further_fields(spark, tmp_path):
    rows = [{"toolName": "cppcheck 1", "filePath": f"s{i}.c", "lineNumber": i, "warningMessage": WILD[i % len(WILD)], "ord": f"o{i}"} for i in range(40)]
    write_gz(tmp_path / "f.json.gz", rows)
    found = S.read_warnings(spark, str(tmp_path), False, also="ord string").collect()
    assert {r["ord"]: r["file"] for r in found} == {f"o{i}": f"s{i}.c" for i in range(40)}


def test_a_large_array_takes_little_memory():
    """The cutter never holds more than one object."""
    cutter, most = R.ArrayCutter("f.gz"), 0
    piece = ', {"warningMessage": "' + "x" * 200 + '"'
    for _ in range(20_000):
        assert cutter.add(piece) is not None
        most = max(most, len(cutter.held))
    cutter.end("]")
    assert most == 0


def table(seed, n):
    draw = random.Random(seed)
    return [(str(i), "".join(draw.choice(WILD) for _ in range(draw.randint(0, 5))) or "z", draw.choice(WILD) or "w") for i in range(n)]


@pytest.mark.parametrize("block", [60, 700, 10**6])
@pytest.mark.parametrize("shuffled", [False, True])
def test_records_are_cut_at_any_block(spark, tmp_path, monkeypatch, block, shuffled):
    if shuffled:
        monkeypatch.setattr(R, "BROADCAST_BLOCKS", 0)
    monkeypatch.setattr(R, "_BATCH", 5)
    want = []
    for f in range(3):
        rows = table(f, 80) + [("long", "one cell over many blocks\n" * 60 + '"', "end")] + table(f + 9, 5)
        want += rows
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=["\n", "\r\n", "\n"][f], quoting=csv.QUOTE_ALL)
        writer.writerows([("id", "text", "other\nname"), *rows])
        (tmp_path / f"f{f}.csv").write_text(out.getvalue() if f else out.getvalue()[:-1], newline="")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = [tuple(r) for r in S.read_csv(spark, str(tmp_path), "id string, text string, other string").collect()]
        blocks = R.csv_records(spark, str(tmp_path)).select("file", "block").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(found) == sorted(want)
    assert blocks > 30 if block == 60 else blocks >= 3


def test_no_records(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n\n")
    assert S.read_csv(spark, str(tmp_path), "a string, b long").collect() == []


def test_flat_objects_are_taken_as_columns():
    """Only pieces that need it are put together one by one; the objects are those that the cutter finds alone."""
    for seed in range(20):
        data = objects(seed, 30) + [{"toolName": "plain", "line": i} for i in range(200)] + objects(seed + 50, 3)
        *pieces, rest = json.dumps(data, indent=[None, 1][seed % 2], ensure_ascii=False).split("}")
        alone, both, seen = R.ArrayCutter("f.gz"), R.ArrayCutter("f.gz"), []
        want = [r for p in pieces if (r := alone.add(p)) is not None]
        one_by_one, both.add = both.add, lambda p: seen.append(p) or one_by_one(p)
        found = [r for chunk in R._cut_pieces(both, pa.array(pieces)) for r in chunk.to_pylist()]
        both.end(rest)
        assert found == want and [json.loads(r) for r in found] == data
        assert len(seen) <= len(pieces) - 190
