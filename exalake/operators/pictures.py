"""Pictures that texts refer to: looked up by path in four ways, or cut out of data: addresses into rows of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exalake.functions.text import fnv1a32
from exalake.operators.exports import IMAGE_NAME

#: Ways of looking a path up, in order: as written, decoded, without regard to case, by the file's name if only one has it.
WAYS = ("exact", "decoded", "any_case", "file_name")
#: First bytes of the kinds that a package can show, and the words of a media type that stand for them (fixed values).
FIRST_BYTES, MEDIA_WORDS = {"png": "89504E47", "jpg": "FFD8FF", "gif": "474946"}, {"png": "png", "jpg": "jpe?g", "gif": "gif"}


def plain_path(src: Column) -> Column:
    """A path without query and mark, percent signs decoded if they can be, forward slashes alone, relative."""
    x = F.regexp_replace(F.replace(F.trim(src), F.lit("\\"), F.lit("/")), "[?#].*$", "")
    decoded = F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    bad = F.contains(decoded, F.lit("�")) & ~F.contains(x, F.lit("�"))
    return F.regexp_replace(F.regexp_replace(F.when(bad, x).otherwise(F.coalesce(decoded, x)), r"^(?:\./)+", ""), "^/+", "")


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def embedded(refs: DataFrame) -> DataFrame:
    """refs (bank, n, src) with data: addresses as (bank, n, bytes, digest, ext): ext by the first bytes, else by the media type;
    null if it is no picture that a package can show, and bytes null too if the address is broken."""
    src = F.trim("src")
    head, body = F.substring_index(src, ",", 1), F.substring(src, F.instr(src, ",") + 1, F.char_length(src))
    clean = F.regexp_replace(F.translate(body, "-_", "+/"), "[^A-Za-z0-9+/]", "")
    # a lone last character holds no whole byte
    whole = F.substring(clean, F.lit(1), F.char_length(clean) - F.when(F.char_length(clean) % 4 == 1, 1).otherwise(0))
    padded = F.rpad(whole, F.ceil(F.char_length(whole) / 4).cast("int") * 4, "=")
    text = F.coalesce(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))), body)
    content = F.when(F.contains(src, F.lit(",")), F.when(head.rlike("(?i);base64"), F.unbase64(padded)).otherwise(F.encode(text, "UTF-8")))
    rows = refs.where(src.rlike("(?i)^data:")).select("bank", "n", content.alias("bytes"), F.lower(F.regexp_extract(head, "(?i)^data:([^;,]*)", 1)).alias("media"))
    first, ext = F.hex(F.substring("bytes", 1, 4)), F.lit(None).cast("string")
    for kind in reversed(FIRST_BYTES):
        ext = F.when(F.col("media").rlike(MEDIA_WORDS[kind]), kind).otherwise(ext)
    for kind, start in reversed(FIRST_BYTES.items()):
        ext = F.when(first.startswith(start), kind).otherwise(ext)
    return rows.select("bank", "n", "bytes", F.sha2("bytes", 256).alias("digest"), F.when(F.col("bytes").isNotNull(), ext).alias("ext"))


def blobs(cut: DataFrame) -> DataFrame:
    """embedded pictures, each content once a bank: (bank, digest, ext, name, bytes).

    The name is img_ and the bytes' 32-bit FNV hash; contents with one hash are numbered in order of their first reference.
    """
    once = cut.where("ext IS NOT NULL").groupBy("bank", "digest", "ext").agg(F.min("n").alias("n"), F.first("bytes").alias("bytes"))
    hashed = once.withColumn("base", F.concat(F.lit("img_"), F.lower(F.lpad(F.hex(fnv1a32(F.col("bytes"))), 8, "0"))))
    nth = F.row_number().over(Window.partitionBy("bank", "base", "ext").orderBy("n", "digest"))
    name = F.concat("base", F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""), F.lit("."), F.col("ext"))
    return hashed.select("bank", "digest", "ext", name.alias("name"), "bytes")


def resolve_pictures(refs: DataFrame, paths: DataFrame, images: DataFrame) -> DataFrame:
    """refs (bank, n, src) with out (the address to write, null if the picture goes), name, way, level and code.

    paths: (bank, key, name, ord), where a file that is now called `name` was; of keys that differ in case alone the last
    counts, a file's name only if one key has it.  images: (bank, name) that there are.  way is one of WAYS, `embedded` or
    `given` (images/name already); what isn't found has none.  code tells what is wrong, null if nothing is: src_missing,
    broken_data, other_kind, remote (a warning), scheme, unknown, absent, bad_name (a warning).  n must tell rows apart.
    """
    src, path = F.trim("src"), plain_path(F.col("src"))
    data = F.coalesce(src.rlike("(?i)^data:"), F.lit(False))
    strip = F.regexp_replace("name", r"^\.?/?images/", "")
    known = paths.select("bank", "key", F.lower("key").alias("low"), strip.alias("name"), "ord")
    kinds = [
        known.groupBy("bank", F.col("key").alias("k")).agg(F.max_by("name", "ord").alias("v")).withColumn("kind", F.lit(0)),
        known.groupBy("bank", F.col("low").alias("k")).agg(F.max_by("name", "ord").alias("v")).withColumn("kind", F.lit(1)),
        known.groupBy("bank", _file_name(F.col("low")).alias("k")).agg(F.when(F.count("*") == 1, F.max("name")).alias("v")).where("v IS NOT NULL").withColumn("kind", F.lit(2)),
    ]
    table = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    tries = [(0, src, 0), (1, path, 0), (2, F.lower(path), 1), (3, _file_name(F.lower(path)), 2)]
    asked = refs.where(~data).select("bank", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), k.alias("k"), F.lit(kind).alias("kind")) for p, k, kind in tries])).alias("t")).select("bank", "n", "t.*")
    hits = asked.join(table, ["bank", "kind", "k"]).groupBy("bank", "n").agg(F.min(F.struct("p", "v")).alias("hit"))
    cut = embedded(refs)
    own = cut.drop("bytes").join(blobs(cut).select("bank", "digest", "ext", F.col("name").alias("blob")), ["bank", "digest", "ext"], "left").select("bank", "n", F.col("digest").isNotNull().alias("whole"), "blob")
    there = images.select("bank", "name").distinct().withColumn("there", F.lit(True))
    rows = refs.join(hits, ["bank", "n"], "left").join(own, ["bank", "n"], "left")
    given = F.regexp_extract(path, "^images/([^/]+)$", 1)
    name = F.when(data, F.col("blob")).otherwise(F.coalesce("hit.v", F.nullif(given, F.lit(""))))
    rows = rows.withColumn("name", name).join(there, ["bank", "name"], "left")
    found = F.col("hit").isNotNull()
    # images/name without an entry is trusted only if there is such an image
    held = found | data | F.col("there").isNotNull()
    blank = F.coalesce(src, F.lit("")) == ""
    code = (
        F.when(blank, "src_missing")
        .when(data, F.when(F.col("blob").isNull(), F.when(F.col("whole"), "other_kind").otherwise("broken_data")))
        .when(held, F.when(F.col("there").isNull(), "absent").when(~F.col("name").rlike(IMAGE_NAME), "bad_name"))
        .when(src.rlike("(?i)^https?://"), "remote")
        .when(src.rlike("(?i)^[a-z][a-z0-9+.-]*:"), "scheme")
        .otherwise("unknown")
    )
    way = F.when(data & F.col("blob").isNotNull(), "embedded").when(found, F.get(F.array(*map(F.lit, WAYS)), F.col("hit.p"))).when(F.col("there").isNotNull() & ~blank, "given")
    rows = rows.withColumns({"code": code, "way": way})
    out = F.when(F.col("way").isNotNull(), F.concat(F.lit("images/"), F.col("name"))).when(F.col("code").isin("remote", "unknown"), src)
    level = F.when(F.col("code").isin("remote", "bad_name"), "warn").when(F.col("code").isNotNull(), "error")
    return rows.select("bank", "n", "src", out.alias("out"), F.when(F.col("way").isNotNull(), F.col("name")).alias("name"), "way", level.alias("level"), "code")
