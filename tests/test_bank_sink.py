"""Bank files: whole, once each, and only after the commit."""

import hashlib
import os

import pytest
from pyspark.sql import Row

from exalake.sources import bank_sink


def read(spark, root):
    return {r.path: (r["items"], r.digest, open(f"{root}/{r.name}").read()) for r in bank_sink.read_bank_files(spark, root).collect()}


def test_files_are_written_whole(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [(f"b{b}/b{b}.xml", p, f"<é {b} {p}>", 1) for b in range(7) for p in reversed(range(12))]
    parts = spark.createDataFrame(rows, "path string, part_no long, content string, items long").repartition(5)
    bank_sink.write_bank_files(parts, root)
    want = {f"b{b}/b{b}.xml": "".join(f"<é {b} {p}>" for p in range(12)) for b in range(7)}
    assert read(spark, root) == {k: (12, hashlib.md5(v.encode()).hexdigest(), v) for k, v in want.items()}
    # a second write adds, an overwriting one takes the place of all
    bank_sink.write_bank_files(spark.createDataFrame([("c.xml", 0, "c", 3)], parts.schema), root)
    assert len(read(spark, root)) == 8
    bank_sink.write_bank_files(spark.createDataFrame([("c.xml", 0, "d", 3)], parts.schema), root, overwrite=True)
    assert {k: v[2] for k, v in read(spark, root).items()} == {"c.xml": "d"}
    bank_sink.write_bank_files(parts.where("part_no < 0"), root, overwrite=True)
    assert read(spark, root) == {}


def test_failed_tasks_leave_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    bad = spark.createDataFrame([("a.xml", 0, "a", 1), ("b.xml", 0, None, 1)], "path string, part_no long, content string, items long")
    with pytest.raises(Exception):
        bank_sink.write_bank_files(bad, root)
    assert read(spark, root) == {}


def test_attempts_that_are_not_committed_do_not_count(spark, tmp_path):
    root = str(tmp_path / "out")
    writer = bank_sink.BankFilesWriter(root, False)
    rows = [Row(path="a.xml", part_no=0, content="x", items=1), Row(path="a.xml", part_no=1, content="y", items=1), Row(path="b.xml", part_no=0, content="z", items=1)]
    first, second, none = writer.write(iter(rows)), writer.write(iter(rows)), writer.write(iter([]))
    assert read(spark, root) == {} and none.folder is None
    writer.commit([second, none])
    assert {k: v[2] for k, v in read(spark, root).items()} == {"a.xml": "xy", "b.xml": "z"}
    writer.abort([first, None])
    assert not os.path.exists(f"{root}/{first.folder}") and os.path.exists(f"{root}/{second.folder}")
