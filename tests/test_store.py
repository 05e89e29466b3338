"""Stored tables: what a change reads, what a failed one leaves, and replays."""

from datetime import datetime

import pytest
from confluo.sources import store
from pyspark.sql import functions as F

SCHEMA = "id string, date timestamp_ntz, v int"


def _rows(spark, *rows):
    return spark.createDataFrame([(k, datetime.fromisoformat(d), v) for k, d, v in rows], SCHEMA)


def _read(spark, path):
    return sorted((r.id, str(r.date)[:10], r.v) for r in store.read_table(spark, path, spark.createDataFrame([], SCHEMA).schema).collect())


def test_an_upsert_opens_only_the_months_and_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.upsert_table(_rows(spark, *[(f"k{m}-{i}", f"2024-{m:02}-05", 1) for m in range(1, 13) for i in range(40)]), path, ["id"], ["v"])
    opened = []
    read, read_index = store._Folder.read, store._Folder.read_index
    monkeypatch.setattr(store._Folder, "read", lambda self, manifest, parts, schema: opened.append(("months", list(parts))) or read(self, manifest, parts, schema))
    monkeypatch.setattr(store._Folder, "read_index", lambda self, manifest, buckets: opened.append(("buckets", list(buckets))) or read_index(self, manifest, buckets))
    store.upsert_table(_rows(spark, ("k3-7", "2024-06-09", 2), ("new", "2024-06-01", 1)), path, ["id"], ["v"])  # moves from March to June
    assert opened[0][0] == "buckets" and len(opened[0][1]) <= 2
    assert opened[1] == ("months", ["2024-03", "2024-06"])
    monkeypatch.undo()
    rows = _read(spark, path)
    assert len(rows) == 481 and [r for r in rows if r[0] == "k3-7"] == [("k3-7", "2024-06-09", 2)]


@pytest.mark.parametrize("where", ["write", "commit"])
def test_a_crash_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch, where):
    path = str(tmp_path / "t")
    first = _rows(spark, ("a", "2024-01-05", 1), ("b", "2024-02-05", 1))
    moved = _rows(spark, ("a", "2024-03-05", 2))
    store.upsert_table(first, path, ["id"], ["v"])

    def crash(*_):
        raise OSError("lost")

    if where == "commit":
        monkeypatch.setattr(store._Folder, "commit", crash)
    else:
        monkeypatch.setattr(store, "upsert", crash)
    with pytest.raises(OSError):
        store.upsert_table(moved, path, ["id"], ["v"])
    monkeypatch.undo()
    assert _read(spark, path) == [("a", "2024-01-05", 1), ("b", "2024-02-05", 1)]
    store.upsert_table(moved, path, ["id"], ["v"])
    assert _read(spark, path) == [("a", "2024-03-05", 2), ("b", "2024-02-05", 1)]  # a key stands once


def test_old_folders_go_after_two_commits(spark, tmp_path):
    path = tmp_path / "t"
    for v in range(5):
        store.upsert_table(_rows(spark, ("a", "2024-01-05", v), ("b", "2024-02-05", 0)), str(path), ["id"], ["v"])
    assert len(list(path.glob("_v=*/_part=2024-01"))) == 2 and len(list((path / "_manifest").glob("0*.json"))) == 2
    assert _read(spark, str(path)) == [("a", "2024-01-05", 4), ("b", "2024-02-05", 0)]


def test_append_reads_only_its_days_and_skips_replays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "id string, day string, v int")
    store.append_new(rows(*[(f"{d}-{i}", f"2024-01-{d:02}", 0) for d in range(1, 20) for i in range(3)]), path, ["id"], stream="s", batch=0)
    opened = []
    read = store._Folder.read
    monkeypatch.setattr(store._Folder, "read", lambda self, manifest, parts, schema: opened.append(list(parts)) or read(self, manifest, parts, schema))
    store.append_new(rows(("5-1", "2024-01-05", 9), ("5-9", "2024-01-05", 9), ("n", None, 9)), path, ["id"], stream="s", batch=1)
    assert [sorted(x) for x in opened] == [["2024-01-05", "none"]]
    store.append_new(rows(("other", "2024-01-06", 9)), path, ["id"], stream="s", batch=1)  # a batch that is stored is skipped whole
    store.append_new(rows(("other2", "2024-01-06", 9)), path, ["id"], stream="t", batch=1)
    monkeypatch.undo()
    found = {r.id: r.v for r in store.read_table(spark, path, rows(("", "", 0)).schema).collect()}
    assert len(found) == 57 + 3 and found["5-1"] == 0 and found["5-9"] == 9 and found["other2"] == 9 and "other" not in found


def test_a_late_writer_fails(spark, tmp_path):
    table = store._Folder(spark, str(tmp_path / "t"))
    table.commit({"parts": {}, "index": {}, "batches": {}}, 1)
    with pytest.raises(RuntimeError):
        table.commit({"parts": {}, "index": {}, "batches": {}}, 1)
    assert store.read_table(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema).where(F.lit(True)).count() == 0
