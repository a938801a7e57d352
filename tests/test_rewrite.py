"""Changes of stored tables: untouched files stay, broken changes are finished or thrown away, replays change nothing."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import rewrite
from millrace.streaming import streams


def _table(spark, path):
    rows = [(i, f"v{i}", None if i % 10 == 0 else f"d{i % 4}") for i in range(40)]
    rewrite.store(spark.createDataFrame(rows, "id long, v string, day string"), path, "day")
    return rows


def _files(spark, path):
    return {(r.day, r.file_name, str(r.at)) for r in spark.read.parquet(path).select("day", "_metadata.file_name", F.col("_metadata.file_modification_time").alias("at")).distinct().collect()}


def _ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def test_only_touched_folders_change(spark, tmp_path):
    path = str(tmp_path / "t")
    _table(spark, path)
    before = _files(spark, path)
    rewrite.remove(spark, path, "day", F.col("id").isin(1, 5, 10) | (F.col("v") == F.lit(None)))
    after = _files(spark, path)
    assert _ids(spark, path) == [i for i in range(40) if i not in (1, 5, 10)]
    assert {d for d, *_ in before - after} == {"d1", None} and {x for x in before if x[0] not in ("d1", None)} <= after
    rewrite.remove_ids(spark, path, "day", spark.createDataFrame([(2,), (2,), (999,), (None,)], "id long"))
    assert _ids(spark, path) == [i for i in range(40) if i not in (1, 2, 5, 10)]
    rewrite.drop_folders(spark, path, "day", spark.createDataFrame([("d3",), (None,)], "day string"))
    assert _ids(spark, path) == [i for i in range(40) if i not in (1, 2, 5, 10) and i % 4 != 3 and i % 10]
    rewrite.remove(spark, path, "day", F.col("id") < 0)
    assert not any(rewrite.Folder(spark, f"{path}/{rewrite.STAGE}").names())


def test_a_broken_change_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    _table(spark, path)
    swap = rewrite._swap

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(rewrite, "_swap", broken)
    with pytest.raises(OSError):
        rewrite.remove(spark, path, "day", F.col("day") == "d1")
    assert len(_ids(spark, path)) == 40
    (tmp_path / "t" / rewrite.STAGE / "half" / "rows").mkdir(parents=True)
    monkeypatch.setattr(rewrite, "_swap", swap)
    rewrite.recover(spark, path)
    assert _ids(spark, path) == [i for i in range(40) if i % 4 != 1 or i % 10 == 0]
    assert not rewrite.Folder(spark, f"{path}/{rewrite.STAGE}").names()


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    each = streams.upsert_batch(path, "k", folders=3)
    for number, rows in enumerate([[("a", 1), ("b", 1)], [("b", 2), ("c", 2)], [("b", 2), ("c", 2)], []]):
        each(spark.createDataFrame(rows, "k string, n int"), number)
    assert sorted((r.k, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 2)]
