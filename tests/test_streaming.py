from datetime import datetime, timedelta

from exalake.streaming import grades


def test_windows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1, 1, 3, t0), (1, 1, 3, t0), (1, 2, 0, t0 + timedelta(minutes=5)), (2, 1, 3, t0 + timedelta(minutes=70)), (9, 9, 0, t0 + timedelta(days=2))]
    spark.createDataFrame(rows, grades.RESPONSES).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    keys = spark.createDataFrame([(1, 3, 1.0), (2, 1, 1.0), (9, 0, 1.0)], "item long, correct long, points double")
    scores = grades.windowed_scores(grades.read_responses(spark, f"file://{tmp_path}/in"), keys)
    grades.write_scores(scores, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(120)
    got = {(r.student, r.start): (r.graded, r.total) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {(1, t0): (2, 1.0), (2, t0 + timedelta(hours=1)): (1, 1.0)}
