"""Keys that come before, after and again for their exams, file by file."""

import datetime

from exalake.streaming import late_keys


def test_keys_wait_for_exams(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    folder, n = str(tmp_path / "in"), [0]

    def arrive(*files):
        n[0] += 1
        rows = [(exam, kind, version, entries, t0 + datetime.timedelta(hours=h)) for exam, kind, version, entries, h in files]
        spark.createDataFrame(rows, late_keys.FILES).coalesce(1).write.mode("append").parquet(folder)
        query = late_keys.write_applied(late_keys.applied(late_keys.read_files(spark, folder), wait_ms=1, late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
        assert query.awaitTermination(60)
        if query.exception():
            raise query.exception()
        seen = spark.read.schema(late_keys.APPLIED).parquet(str(tmp_path / "out")).collect()
        new = sorted((r.exam, r.exam_version, r.key_version, r.no, r.value, r.status) for r in seen if (id_ := tuple(r)) not in known or known[id_] < sum(tuple(s) == id_ for s in seen))
        known.clear()
        for r in seen:
            known[tuple(r)] = known.get(tuple(r), 0) + 1
        return new

    known: dict = {}
    key = [("1", "A"), ("2", "B"), ("2", "C"), ("9", "D")]
    asked = [("1", None), ("2", None), ("3", None)]
    # a key alone waits; another exam's file changes nothing for it
    assert arrive(("x", "key", 1, key, 0), ("z", "key", 1, key, 0), (None, "key", 1, key, 0), ("x", "note", 5, key, 0)) == []
    # the exam comes, in time for x; z has waited long enough
    told = arrive(("x", "exam", 1, asked, 1))
    assert [t for t in told if t[0] == "x"] == [("x", 1, 1, "1", "A", "answered"), ("x", 1, 1, "2", "B", "answered"), ("x", 1, 1, "3", None, "missing"), ("x", 1, 1, "9", "D", "unused")]
    assert [t for t in told if t[0] == "z"] == [("z", None, 1, None, None, "no_exam")]
    # the same file again, and an older version: nothing; a newer key is applied again
    assert arrive(("x", "exam", 1, asked, 1), ("x", "key", 0, [("1", "Z")], 1)) == []
    assert arrive(("x", "key", 3, [("1", "C")], 2)) == [("x", 1, 3, "1", "C", "answered"), ("x", 1, 3, "2", None, "missing"), ("x", 1, 3, "3", None, "missing")]
    # an exam that comes late, and long ago by its own time, is met all the same
    assert arrive(("z", "exam", 1, [("1", None)], -999)) == [("z", 1, 1, "1", "A", "answered"), ("z", 1, 1, "2", "B", "unused"), ("z", 1, 1, "9", "D", "unused")]
