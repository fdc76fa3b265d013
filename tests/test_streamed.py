"""Files in parts and segments: no group is held as one value."""

import hashlib

from pyspark.sql import functions as F

from exalake.operators import ordered, packages


def test_files_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packages, "PART_CHARS", 100)
    items = [(b, i, f"<item>{b}é{i * 7}</item>") for b, n in (("hot", 300), ("one", 1)) for i in range(n)]
    parts = packages.bank_files(spark.createDataFrame(items, "bank string, pos int, xml string").repartition(7)).cache()
    whole = {b: "<questestinterop><objectbank>" + "".join(x for c, _, x in items if c == b) + "</objectbank></questestinterop>" for b in ("hot", "one")}
    rows = sorted(parts.collect(), key=lambda r: r.part_no)
    assert {b: "".join(r.content for r in rows if r.bank == b) for b in whole} == whole
    assert sum(r.bank == "hot" for r in rows) > 40 and max(len(r.content) for r in rows) < 200
    assert {tuple(r) for r in packages.file_digests(parts).collect()} == {(b, f"{b}/{b}.xml", hashlib.md5(x.encode()).hexdigest(), 300 if b == "hot" else 1) for b, x in whole.items()}
    names = spark.createDataFrame([("p", f"f{i:03}") for i in range(50)], "package string, path string")
    said = sorted(packages.manifest(names).collect(), key=lambda r: r.part_no)
    assert len(said) > 10 and "".join(r.manifest for r in said) == "<manifest><resources>" + "".join(f'<resource href="f{i:03}"><file href="f{i:03}"/></resource>' for i in range(50)) + "</resources></manifest>"


def test_segments_of_a_hot_part(spark):
    rows = spark.range(30_000).select((F.col("id") % 100 == 0).alias("f"), F.col("id").alias("o"), F.when(F.col("id") % 11 != 0, F.col("id") * F.col("id") % 17).alias("no"))
    want, seen, seg = {}, {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        if r.no in seen.setdefault(r.f, set()):
            seen[r.f], seg[r.f] = set(), seg.get(r.f, 1) + 1
        if r.no is not None:
            seen[r.f].add(r.no)
        want[r.o] = seg.get(r.f, 1)
    assert {r.o: r.segment for r in ordered.segments(rows, "no", ["f"], ["o"]).collect()} == want
