"""Question packages: identities by place, counts with totals, item rows and the files of a package."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exalake.functions.text import escape_attribute, escape_xml

#: Characters of a part of a file; thousands of parts fit one Arrow batch.
PART_CHARS = 1 << 14


def item_ident(bank: Column, pos: Column, part: Column | None = None) -> Column:
    """<bank>_q<NN> with the 1-based place in at least two digits, _s<k> for one part of a split question."""
    n = F.greatest(F.length(pos.cast("string")), F.lit(2))
    ident = F.concat(bank, F.lit("_q"), F.lpad(pos.cast("string"), n, F.lit("0")))
    return ident if part is None else F.concat(ident, F.lit("_s"), part.cast("string"))


def number_items(questions: DataFrame, bank: str, order: list[str]) -> DataFrame:
    """pos and ident from the place in the bank; excluded questions keep theirs, so identities never shift."""
    pos = F.row_number().over(Window.partitionBy(bank).orderBy(*order))
    return questions.withColumn("pos", pos).withColumn("ident", item_ident(F.col(bank), F.col("pos")))


def answer_id(pos: Column, k: Column, right: bool = False, wide: Column | None = None) -> Column:
    """pos * 100 + k (right sides + 50), or pos * 10000 (+ 5000) + k where a side has over 49 entries."""
    narrow = pos * 100 + k + (50 if right else 0)
    return narrow if wide is None else F.when(wide, pos * 10_000 + k + (5_000 if right else 0)).otherwise(narrow)


def summary(questions: DataFrame, bank: str = "bank", kind: str = "type") -> DataFrame:
    """Counts and points by bank and type, by bank, and in all, in one pass (grouping sets)."""
    return questions.rollup(bank, kind).agg(F.count("*").alias("items"), F.round(F.sum("points"), 4).alias("points"), F.grouping_id().cast("int").alias("level"))


def item_xml(ident: Column, title: Column, body: Column, points: Column) -> Column:
    """One item element with a stable order of attributes."""
    return F.concat(F.lit('<item ident="'), escape_attribute(ident), F.lit('" title="'), escape_attribute(title), F.lit('" points="'), points.cast("string"), F.lit('"><presentation>'), escape_xml(body), F.lit("</presentation></item>"))


def file_parts(pieces: DataFrame, by: str, order: list[str], piece: Column, head: str, tail: str) -> DataFrame:
    """(by, part_no, content, items): head, pieces in order and tail, cut where the running length passes PART_CHARS.

    A part is at most one piece longer; put together by ascending part_no, parts give the file.
    """
    w = Window.partitionBy(by).orderBy(*order)
    rows = pieces.select(by, *order, F.coalesce(piece, F.lit("")).alias("_piece"))
    start = F.sum(F.length("_piece").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("_piece")
    ends = F.lead(F.lit(1)).over(w).isNull()
    text = F.concat(F.when(F.row_number().over(w) == 1, head).otherwise(""), "_piece", F.when(ends, tail).otherwise(""))
    placed = rows.select(by, *order, F.floor(start / PART_CHARS).alias("part_no"), text.alias("_text"))
    sorted_ = F.sort_array(F.collect_list(F.struct(*order, "_text")))
    return placed.groupBy(by, "part_no").agg(F.array_join(F.transform(sorted_, lambda x: x["_text"]), "").alias("content"), F.count("*").alias("items"))


def bank_files(items: DataFrame, bank: str = "bank") -> DataFrame:
    """items (bank, pos, xml) to a file a bank, in parts: bank, path, part_no, content, items; items in order of pos."""
    parts = file_parts(items, bank, ["pos", "xml"], F.col("xml"), "<questestinterop><objectbank>", "</objectbank></questestinterop>")
    return parts.select(bank, F.concat(F.col(bank), F.lit("/"), F.col(bank), F.lit(".xml")).alias("path"), "part_no", "content", "items")


def file_digests(parts: DataFrame, bank: str = "bank") -> DataFrame:
    """bank_files to one row a file: bank, path, digest (MD5) and items; parts are streamed in order, none are kept."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, md5, items, begun = None, None, 0, False
        row = lambda: pa.RecordBatch.from_pylist([{bank: now[0], "path": now[1], "digest": md5.hexdigest(), "items": items}], schema=out)
        for batch in batches:
            out = pa.schema([batch.schema.field(bank), batch.schema.field("path"), pa.field("digest", pa.string()), pa.field("items", pa.int64())])
            for b, path, content, n in zip(*[batch.column(c).to_pylist() for c in (bank, "path", "content", "items")], strict=True):
                if not begun or b != now[0]:
                    if begun:
                        yield row()
                    now, md5, items, begun = (b, path), hashlib.md5(), 0, True
                md5.update(content.encode())
                items += n
        if begun:
            yield row()

    kind = T.StructType([parts.schema[bank], parts.schema["path"], T.StructField("digest", T.StringType()), T.StructField("items", T.LongType())])
    return parts.select(bank, "path", "part_no", "content", "items").repartition(bank).sortWithinPartitions(bank, "part_no").mapInArrow(fold, kind)


def manifest(files: DataFrame, package: str = "package") -> DataFrame:
    """files (package, path) to a manifest a package, in parts: package, part_no, manifest; a resource for each path, sorted."""
    p = escape_attribute(F.col("path"))
    resource = F.when(F.col("path").isNotNull(), F.concat(F.lit('<resource href="'), p, F.lit('"><file href="'), p, F.lit('"/></resource>')))
    parts = file_parts(files, package, ["path"], resource, "<manifest><resources>", "</resources></manifest>")
    return parts.select(package, "part_no", F.col("content").alias("manifest"))
