"""Cell formats and JSON exam packages."""

import base64
import json

from pyspark.sql import functions as F

from exalake.functions import formats
from exalake.sources import exams

SHOWN = [
    (14, None, 16682.0, "02/09/1945"), (16, None, 46024.0, "02/01"), (22, None, 45658.5, "01/01/2025 12:00"), (20, None, 0.3541666667, "8:30"), (21, None, 0.3541666667, "8:30:00"), (46, None, 1.5, "36:00:00"),
    (9, None, 0.25, "25%"), (10, None, 0.125, "12.50%"), (9, None, 0.6, "60%"), (12, None, 0.5, "1/2"), (12, None, 1.5, "1 1/2"), (12, None, 0.333, "1/3"), (12, None, 2.0, "2"), (12, None, -0.5, "-1/2"), (12, None, 0.0, "0"), (12, None, 0.999, "1"),
    (13, None, 0.3125, "5/16"), (164, "dd/mm/yyyy", 16682.0, "02/09/1945"), (164, "d/m/yy", 16682.0, "2/9/45"), (164, "m/d/yyyy", 16682.0, "9/2/1945"), (164, "[$-42A]dd/mm/yyyy", 16682.0, "02/09/1945"), (164, "yyyy-mm-dd", 16682.0, "1945-09-02"),
    (164, "mmm-yy", 16682.0, "02/09/1945"), (164, "0.0%", 0.256, "25.6%"), (164, "# ??/16", 0.3125, "5/16"), (164, "[h]:mm", 1.5, "36:00"), (164, "h:mm:ss", 0.5, "12:00:00"), (164, "General", 1.0, None), (164, "#,##0", 1.0, None), (164, "[Red]0.00", 1.0, None),
    (0, None, 1.0, None), (49, None, 1.0, None), (14, None, 1.0, "01/01/1900"), (14, None, 59.0, "28/02/1900"), (14, None, 61.0, "01/03/1900"), (14, None, -1.0, None),
]


def test_formats(spark):
    frame = spark.createDataFrame([(i, a, b, c) for i, (a, b, c, _) in enumerate(SHOWN)], "i int, id int, code string, v double")
    got = frame.withColumn("f", formats.classify(F.col("id"), F.col("code"))).select("i", formats.shown(F.col("v"), F.col("f")).alias("s")).orderBy("i").collect()
    assert [(SHOWN[r.i][:3], r.s) for r in got] == [(x[:3], x[3]) for x in SHOWN]
    one = spark.range(1).select(formats.shown(F.lit(0.0), formats.classify(F.lit(14), F.lit(None).cast("string")), F.lit(True)).alias("s"))
    assert one.first().s == "01/01/1904"


def hide(keys, km):
    data = bytearray(json.dumps(keys, ensure_ascii=False).encode())
    for i in range(len(data)):
        data[i] ^= (ord(km[i % len(km)]) & 255) ^ ((i * 31) & 255)
    return base64.b64encode(bytes(data)).decode()


def test_exam_packages(spark):
    keys, km = ["B", "Hà Nội", "C"], "nshm.50"
    parts = [{"label": "I", "groups": [{"type": "mcq", "perItem": 0.5, "items": [{"n": 0, "q": "example", "ans": 2}, {"n": 1, "q": "1+1?", "opts": ["1", "2"], "ans": 0}, {"n": 2, "q": "x", "ans": 9}]}, {"type": "short", "items": [{"n": 3, "q": "Capital?", "ans": 1, "pt": 2}]}, {"type": "odd", "items": [{"n": 4, "q": "?", "ans": "z"}]}]}]
    hidden = {"EXAM": {}, "PARTS": parts, "_KX": hide(keys, km), "_KM": km}
    rows = [("a", json.dumps(hidden)), ("b", json.dumps({"EXAM": {}, "PARTS": parts})), ("c", '{"PASSAGES": []}'), ("d", '{"EXAM_INFO": 1, "PARTS": [{"key": 1, "items": []}]}'), ("e", "not json"), ("f", None)]
    frame = spark.createDataFrame(rows, "package string, data string")
    assert [r.v for r in frame.select("package", exams.variant(F.col("data")).alias("v")).orderBy("package").collect()] == ["template-hidden", "template", "passages", "keyed-parts", "unknown", "unknown"]
    got = exams.questions(frame.where("package = 'a'")).orderBy("part", "grp", "item").collect()
    assert [(r.type, r.no, r.answer, r.points) for r in got] == [("mc", "1", "B", 0.5), ("mc", "2", None, 0.5), ("short", "3", "Hà Nội", 2.0), (None, "4", "z", None)]
    assert exams.questions(frame.where("package = 'b'")).where("no = '1'").first().answer == "0"
    use = exams.answer_table_use(frame).collect()
    assert [(r.package, r.entries, r.used, r.outside) for r in use] == [("a", 3, 3, 1)]
