"""Exam files: kind by first bytes, archives exploded to members, spreadsheets to cells."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of files (fixed values).
MAGIC = [("504B0304", "zip"), ("504B0506", "zip"), ("89504E47", "png"), ("FFD8FF", "jpg"), ("474946", "gif"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("D0CF11E0", "ole"), ("25504446", "pdf")]
#: The most bytes a member may unpack to; larger ones are error rows, so no archive fills a worker.
MOST_MEMBER_BYTES = 64 << 20
NOISE = r"(^|/)(__MACOSX/|\.|Thumbs\.db$)"
MEMBERS = "archive string, path string, content binary, error string"
CELLS = "archive string, sheet string, row int, col int, kind string, text string, num double"


def file_kind(content: Column) -> Column:
    """Kind by the first bytes alone, whatever the name says."""
    head = F.hex(F.substring(content, 1, 12))
    kind = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for magic, name in MAGIC:
        kind = kind.when(head.startswith(magic), name)
    return kind.otherwise("unknown")


def archive_kind(members: DataFrame) -> DataFrame:
    """docx, xlsx, scorm, qti or bundle by which paths an archive has."""
    path = F.lower("path")
    flags = members.groupBy("archive").agg(F.max(path == "word/document.xml").alias("doc"), F.max(path == "xl/workbook.xml").alias("book"), F.max(path.endswith("imsmanifest.xml")).alias("manifest"), F.max(path.rlike(r"\.html?$")).alias("html"), F.max(path.rlike("(assessment|non_cc_assessments|qti)")).alias("qti"))
    kind = F.when(F.col("doc"), "docx").when(F.col("book"), "xlsx").when(F.col("manifest") & F.col("html") & ~F.col("qti"), "scorm").when(F.col("manifest"), "qti").otherwise("bundle")
    return flags.select("archive", kind.alias("kind"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Files below path as (archive, content); the content column is not read unless asked for."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "length", "content")


def _members(archive: str, content: bytes) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                name = info.filename.replace("\\", "/")
                if info.is_dir() or re.search(NOISE, name):
                    continue
                if info.flag_bits & 1 or info.compress_type not in (0, 8):
                    yield archive, name, None, "unsupported"
                elif info.file_size > MOST_MEMBER_BYTES:
                    yield archive, name, None, "too large"
                else:
                    try:
                        with z.open(info) as f:
                            data = f.read(MOST_MEMBER_BYTES + 1)
                        yield (archive, name, data, None) if len(data) <= MOST_MEMBER_BYTES else (archive, name, None, "too large")
                    except Exception as e:  # a bad checksum or stream spoils one member, not the archive
                        yield archive, name, None, type(e).__name__
    except zipfile.BadZipFile:
        yield archive, None, None, "not an archive"


def explode_archives(files: DataFrame) -> DataFrame:
    """files (archive, content) to a row a member; what can't be unpacked is a row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"], strict=True):
                rows = list(_members(archive, content or b""))
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "path", "content", "error"])

    return files.select("archive", "content").mapInPandas(run, MEMBERS)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _cells(archive: str, members: dict[str, bytes]) -> Iterator[tuple]:
    shared = []
    if data := members.get("xl/sharedStrings.xml"):
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(data).iter(f"{_NS}si")]
    for path in sorted(members):
        if not (m := re.fullmatch(r"xl/worksheets/(sheet\d+)\.xml", path)):
            continue
        for c in ElementTree.fromstring(members[path]).iter(f"{_NS}c"):
            ref = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
            if not ref:
                continue
            col = 0
            for ch in ref[1]:
                col = col * 26 + ord(ch) - 64
            kind, v = c.get("t", "n"), c.findtext(f"{_NS}v")
            if kind == "s" and v is not None:
                kind, text, num = "string", shared[int(v)] if int(v) < len(shared) else None, None
            elif kind == "inlineStr":
                kind, text, num = "string", "".join(t.text or "" for t in c.iter(f"{_NS}t")), None
            elif kind == "b":
                kind, text, num = "boolean", "TRUE" if v == "1" else "FALSE", None
            elif kind == "e":
                kind, text, num = "error", v, None
            elif kind in ("str", "d"):
                kind, text, num = "string", v, None
            elif v is not None:
                kind, text, num = "number", v, float(v)
            else:
                continue
            yield archive, m[1], int(ref[2]), col - 1, kind, text, num


def read_cells(members: DataFrame) -> DataFrame:
    """Members of spreadsheets to a row a cell; one workbook is one group, bounded by MOST_MEMBER_BYTES a member."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = dict(zip(group["path"], group["content"], strict=True))
        return pd.DataFrame(list(_cells(key[0], parts)), columns=["archive", "sheet", "row", "col", "kind", "text", "num"])

    wanted = members.where(F.col("error").isNull() & F.col("path").rlike(r"^xl/(sharedStrings|worksheets/sheet\d+)\.xml$"))
    return wanted.select("archive", "path", "content").groupBy("archive").applyInPandas(run, CELLS)
