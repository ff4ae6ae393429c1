"""The keyed table against a dict: merges, failed and racing writers, versions, task numbers."""

import os
import random

import pytest

from costloom.sources import keyed

SCHEMA = "k string, j int, v double"


def rows_of(table, version=None):
    return {(r["k"], r["j"]): r["v"] for r in table.read(version).collect()}


def test_merges_equal_a_dict(spark, tmp_path):
    rng = random.Random(2)
    table, want = keyed.KeyedTable(spark, str(tmp_path / "t"), ["k", "j"], 8), {}
    assert table.read() is None and table.latest() == (0, None)
    assert table.merge(spark.createDataFrame([], SCHEMA)) == 0
    versions = []
    for turn in range(4):
        new = [(rng.choice(["a", "b", None, "ü"]), rng.choice([1, 2, 3, None]), float(turn * 100 + i)) for i in range(8)]
        keep = turn == 2
        number = table.merge(spark.createDataFrame(new, SCHEMA), keep)
        last = {}
        for k, j, v in new:
            last[k, j] = max(v, last.get((k, j), v))
        want = last | want if keep else want | last
        assert number == turn + 1 and rows_of(table) == want and table.read().count() == len(want)
        versions.append(dict(want))
    assert [rows_of(table, v + 1) for v in range(4)] == versions  # earlier versions stay readable


def test_only_touched_partitions_are_written(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], 16)
    table.merge(spark.createDataFrame([(f"k{i}", i, 0.0) for i in range(200)], SCHEMA))
    before = table.latest()[1]["parts"]
    table.merge(spark.createDataFrame([("k5", 5, 1.0)], SCHEMA))
    after = table.latest()[1]["parts"]
    assert sum(before[p] != after[p] for p in before) == 1 and set(before) == set(after) and len(before) > 8
    assert table.read().count() == 200 and table.read().filter("v = 1").count() == 1


def test_failed_and_racing_writers(spark, tmp_path, monkeypatch):
    make = lambda: keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table = make()
    table.merge(spark.createDataFrame([("a", 1, 1.0)], SCHEMA))
    # One fails after its data are written, before its version is.
    monkeypatch.setattr(keyed.KeyedTable, "_commit", lambda self, n, e: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        table.merge(spark.createDataFrame([("a", 1, 2.0)], SCHEMA))
    monkeypatch.undo()
    assert rows_of(make()) == {("a", 1): 1.0}
    # One fails inside its version's file.
    (tmp_path / "t" / "log" / "00000002.json").write_text('{"parts": {"1"')
    assert make().latest()[0] == 1 and rows_of(make()) == {("a", 1): 1.0}
    with pytest.raises(keyed.Conflict, match="being written"):
        table.merge(spark.createDataFrame([("a", 1, 9.0)], SCHEMA))
    os.utime(tmp_path / "t" / "log" / "00000002.json", (1, 1))  # long ago: its writer is gone
    assert table.merge(spark.createDataFrame([("a", 1, 1.0)], SCHEMA)) == 2
    # Two start from one version.
    other = make()
    version = other.latest()[0]
    table.merge(spark.createDataFrame([("b", 1, 3.0)], SCHEMA))
    with pytest.raises(keyed.Conflict):
        other.merge(spark.createDataFrame([("c", 1, 4.0)], SCHEMA), at=version)
    with pytest.raises(keyed.Conflict):
        other._commit(version, {"parts": {}, "schema": {}})
    assert rows_of(make()) == {("a", 1): 1.0, ("b", 1): 3.0}


def test_task_numbers_never_change(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "product string, root_cause string, month string, n int")
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), ["product", "root_cause", "month"])
    ids = lambda df: {(r["product"], r["root_cause"], r["month"]): r["task_id"] for r in df.collect()}
    first = ids(keyed.kept_task_ids(table, frame([("P", "x", "2026-05", 2), ("Q", "x", "2026-05", 1), ("P", "x", "2026-06", 3)]), "n"))
    assert first == {("Q", "x", "2026-05"): "TASK-202605-0001", ("P", "x", "2026-05"): "TASK-202605-0002", ("P", "x", "2026-06"): "TASK-202606-0001"}
    again = ids(keyed.kept_task_ids(table, frame([("A", "a", "2026-05", 0), ("P", "x", "2026-05", 9)]), "n"))
    assert again == first | {("A", "a", "2026-05"): "TASK-202605-0003"}
    version = table.latest()[0]
    assert ids(keyed.kept_task_ids(table, frame([("A", "a", "2026-05", 5)]), "n")) == again and table.latest()[0] == version
