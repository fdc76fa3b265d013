"""Pictures looked up by path, and cut out of data: addresses."""

import base64

from exalake.operators import pictures

PNG = b"\x89PNG\r\n\x1a\n123"


def fnv(data):
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 % 2**32
    return f"{h:08x}"


def test_pictures(spark):
    inline = "data:image/jpeg;base64," + base64.b64encode(PNG).decode().rstrip("=")
    cases = [
        ("Media/Ảnh 1.PNG", "images/a1.png", "exact", None), ("./Media/%E1%BA%A2nh%201.PNG?x#y", "images/a1.png", "decoded", None), ("media\\ảnh 1.png", "images/a1.png", "any_case", None),
        ("elsewhere/UNIQUE.gif", "images/b.gif", "file_name", None), ("elsewhere/twice.png", "elsewhere/twice.png", None, "unknown"), ("images/a1.png", "images/a1.png", "given", None),
        ("images/none.png", "images/none.png", None, "unknown"), ("gone.png", "images/lost.png", "exact", "absent"), ("ugly.png", "images/Ugly Name.png", "exact", "bad_name"),
        ("https://x.org/a.png", "https://x.org/a.png", None, "remote"), ("ftp://x", None, None, "scheme"), ("  ", None, None, "src_missing"), (None, None, None, "src_missing"),
        (inline, f"images/img_{fnv(PNG)}.png", "embedded", None), ("data:image/gif,a%20b+c", f"images/img_{fnv(b'a b+c')}.gif", "embedded", None), ("data:text/plain,x", None, None, "other_kind"), ("data:image/png", None, None, "broken_data"),
        ("Case.png", "images/second.png", "any_case", None), ("a+b.png", "images/plus.png", "exact", None), ("100%.png", "images/pct.png", "exact", None),
    ]
    refs = spark.createDataFrame([("k", i, c[0], "x") for i, c in enumerate(cases)] + [("other", 0, "Media/Ảnh 1.PNG", "x")], "bank string, n int, src string, name string").drop("name")
    paths = [("Media/Ảnh 1.PNG", "images/a1.png"), ("d/unique.gif", "b.gif"), ("d/twice.png", "t1.png"), ("e/Twice.png", "t2.png"), ("gone.png", "lost.png"), ("ugly.png", "Ugly Name.png"), ("CASE.png", "first.png"), ("case.png", "second.png"), ("a+b.png", "plus.png"), ("100%.png", "pct.png")]
    named = spark.createDataFrame([("k", k, v, i) for i, (k, v) in enumerate(paths)], "bank string, key string, name string, ord int")
    images = spark.createDataFrame([("k", n) for n in ("a1.png", "b.gif", "Ugly Name.png", "second.png", "plus.png", "pct.png", f"img_{fnv(PNG)}.png")], "bank string, name string")
    got = {(r.bank, r.n): (r.out, r.way, r.code) for r in pictures.resolve_pictures(refs, named, images).collect()}
    for i, (src, *want) in enumerate(cases):
        assert got["k", i] == tuple(want), (src, got["k", i])
    assert got["other", 0] == ("Media/Ảnh 1.PNG", None, "unknown") and len(got) == len(cases) + 1
    assert pictures.resolve_pictures(refs.where("n < 0"), named, images).collect() == []


def test_equal_contents_are_one_blob(spark):
    inline = lambda data: "data:;base64," + base64.b64encode(data).decode()
    refs = spark.createDataFrame([("k", 2, inline(PNG)), ("k", 1, inline(PNG)), ("k", 3, inline(PNG + b"x")), ("j", 1, inline(PNG)), ("k", 4, "data:;base64,AAAA")], "bank string, n int, src string")
    got = {(r.bank, r.name, bytes(r.bytes)) for r in pictures.blobs(pictures.embedded(refs)).collect()}
    assert got == {("k", f"img_{fnv(PNG)}.png", PNG), ("k", f"img_{fnv(PNG + b'x')}.png", PNG + b"x"), ("j", f"img_{fnv(PNG)}.png", PNG)}


def test_contents_of_one_hash_are_numbered(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(pictures, "fnv1a32", lambda c: F.lit(7).cast("long"))
    cut = spark.createDataFrame([("k", 5, b"a", "d1", "png"), ("k", 2, b"b", "d2", "png"), ("k", 9, b"c", "d3", "gif")], "bank string, n int, bytes binary, digest string, ext string")
    assert {(r.digest, r.name) for r in pictures.blobs(cut).collect()} == {("d2", "img_00000007.png"), ("d1", "img_00000007_2.png"), ("d3", "img_00000007.gif")}
