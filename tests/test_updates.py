"""Update tables in levels: few folders to read, and nothing lost by replays or by merges that die."""

from __future__ import annotations

import random

import pytest

from gatewright.session import scratch_dir
from gatewright.streaming.updates import UpdateTable

SCHEMA = "k string, a long, b string"


def rows(spark, pairs):
    return spark.createDataFrame([(k, v, f"t{v}") for k, v in pairs], SCHEMA).coalesce(1)


def state(table):
    got = table.read(SCHEMA).collect()
    assert all(r["b"] == f"t{r['a']}" for r in got) and len({r["k"] for r in got}) == len(got)
    return {r["k"]: r["a"] for r in got}


def test_many_batches_are_few_folders(spark):
    table, want, draw = UpdateTable(spark, scratch_dir(spark, "updates"), ["k"], fanout=4), {}, random.Random(1)
    assert state(table) == {}
    for i in range(40):
        pairs = [(f"k{draw.randrange(30)}", 100 * i)] if i % 3 else [(f"k{n}", 100 * i + n) for n in draw.sample(range(30), 4)]
        want |= dict(pairs)
        table.write(rows(spark, pairs), i)
        if i % 9 == 0:
            assert state(table) == want
        # three batches, and three runs of each level, at most
        assert len(table.folders()) <= 9
    assert state(table) == want
    assert {r[1] for r in table.runs()} == {2, 3} or {r[1] for r in table.runs()} == {1, 2}
    table.remove_old()
    assert state(table) == want and len(table._files("batch=*")) < 4 and len(table._files("runs/*")) == len(table.runs())


def test_replays_change_nothing(spark):
    table = UpdateTable(spark, scratch_dir(spark, "updates"), ["k"], fanout=3)
    for i in range(5):
        table.write(rows(spark, [("x", i), (f"own{i}", i)]), i)
    want = {"x": 4, **{f"own{i}": i for i in range(5)}}
    assert state(table) == want
    table.write(rows(spark, [("x", 1), ("own1", 1)]), 1)  # long merged
    table.write(rows(spark, [("x", 4), ("own4", 4)]), 4)  # the last one again
    assert state(table) == want


@pytest.mark.parametrize("at", ["run", "manifest"])
def test_a_merge_that_dies_is_harmless(spark, monkeypatch, at):
    table = UpdateTable(spark, scratch_dir(spark, "updates"), ["k"], fanout=3)
    for i in range(2):
        table.write(rows(spark, [("x", i), (f"own{i}", i)]), i)
    made = spark.createDataFrame

    def dies(*args, **kw):
        raise RuntimeError("executor lost")

    if at == "manifest":  # the run is written, the manifest is not
        batch = rows(spark, [("x", 2)])
        monkeypatch.setattr(type(spark), "createDataFrame", dies)
    else:
        batch = rows(spark, [("x", 2)])
        monkeypatch.setattr(UpdateTable, "_rows", dies)
    with pytest.raises(RuntimeError):
        table.write(batch, 2)
    monkeypatch.undo()
    assert made is not None and state(table) == {"x": 2, "own0": 0, "own1": 1} and table.runs() == []
    table.write(rows(spark, [("x", 2)]), 2)  # the stream replays the batch
    assert state(table) == {"x": 2, "own0": 0, "own1": 1} and len(table.runs()) == 1
    table.write(rows(spark, [("x", 3)]), 3)
    assert state(table)["x"] == 3
