"""Question sheets from cells in long form: header by its text, rows by role, types by what the answer looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exalake.functions.text import slug, slug_of_folded, trimmed, without_marks

#: Header texts (as slugs) of each column role (fixed values).
ALIASES = {
    "no": ["stt", "tt", "so_tt", "so_thu_tu", "cau", "cau_so", "so_cau", "no"],
    "kind": ["loai_cau", "loai", "loai_cau_hoi", "dang_cau", "dang_cau_hoi", "kieu_cau", "type", "question_type"],
    "content": ["noi_dung_cau_hoi", "noi_dung", "cau_hoi", "de_bai", "noi_dung_cau", "question", "question_text"],
    "picture": ["anh", "hinh", "hinh_anh", "anh_minh_hoa", "ten_anh", "tep_anh", "image", "images", "picture"],
    "answer": ["dap_an", "dap_an_dung", "answer", "correct_answer", "key", "da"],
    "points": ["diem", "so_diem", "diem_so", "points", "point", "score"],
    "solution": ["loi_giai", "loi_giai_chi_tiet", "huong_dan_giai", "giai_thich", "hdg", "huong_dan_cham", "dap_an_chi_tiet", "feedback", "explanation", "solution"],
    "bank": ["ngan_hang", "ngan_hang_cau_hoi", "ten_ngan_hang", "bank", "question_bank"],
    "level": ["muc_do", "muc_do_nhan_thuc", "muc_do_nhan_biet", "level", "do_kho"],
    "topic": ["chu_de", "chuong", "bai_hoc", "don_vi_kien_thuc", "noi_dung_kien_thuc", "topic"],
    "part": ["phan", "part"],
}
#: What may stand before the letter of an option column (fixed values).
OPTION_LEADS = ["", "phuong_an", "pa", "lua_chon", "y", "option", "choice", "dap_an"]
ALIASES |= {c: [lead + gap + c.lower() for lead in OPTION_LEADS for gap in (("_", "") if lead else ("",))] for c in "ABCDEFGH"}
#: Question types by what sheets call them (fixed values).
TYPE_NAMES = {
    "mc": ["tn", "mot dap an", "trac nghiem", "trac nghiem mot dap an", "mc", "multiple choice"],
    "ma": ["nd", "nhieu dap an", "trac nghiem nhieu dap an", "ma", "multiple answers"],
    "tf": ["ds", "dung sai", "tf", "true false"],
    "short": ["tln", "tra loi ngan", "short", "short answer"],
    "num": ["so", "dien so", "num", "numeric", "numerical"],
    "blanks": ["dien", "dien khuyet", "dien tu", "blanks", "fill in blanks"],
    "dropdowns": ["chon", "chon tu danh sach", "dropdown", "dropdowns"],
    "matching": ["ghep", "ghep noi", "matching"],
    "essay": ["tl", "tu luan", "essay"],
    "passage": ["doan", "doan dan", "passage"],
}
#: Levels by what sheets call them (fixed values).
LEVEL_NAMES = {
    "NB": ["nb", "nhan biet", "biet", "1", "muc 1"],
    "TH": ["th", "thong hieu", "hieu", "2", "muc 2"],
    "VD": ["vd", "van dung", "van dung thap", "3", "muc 3"],
    "VDC": ["vdc", "van dung cao", "4", "muc 4"],
}
#: Rows in which a header is looked for.
HEADER_ROWS = 10


def header_roles(spark: SparkSession) -> DataFrame:
    """The alias table: a few dozen rows."""
    return spark.createDataFrame([(a, role) for role, names in ALIASES.items() for a in names], "alias string, role string")


def code_of(raw: Column, names: dict[str, list[str]]) -> Column:
    """The code of a name such as 'TN – Một đáp án', 'TN', 'Một đáp án': whole, by its parts, by its first word.

    Null for a blank name, 'unknown' for one that is in no list.
    """
    folded = without_marks(raw)
    key = lambda s: F.replace(slug_of_folded(F.regexp_replace(s, r"\([^)]*\)|\[[^\]]*\]|[*:]+", " ")), F.lit("_"), F.lit(" "))
    whole = key(folded)
    tries = F.concat(F.array(whole), F.transform(F.split(F.trim(folded), r"\s+[-–—]\s+|\s*[–—:]\s*"), key), F.array(F.element_at(F.split(whole, " "), 1)))
    codes = F.create_map(*[F.lit(x) for code, every in names.items() for name in every for x in (name, code)])
    hits = F.array_compact(F.transform(tries, lambda k: F.try_element_at(codes, k)))
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) != "", F.coalesce(F.get(hits, F.lit(0)), F.lit("unknown")))


def headers(cells: DataFrame) -> DataFrame:
    """(archive, sheet, header_row, col, role): the first row among the first HEADER_ROWS with a content column and another."""
    named = cells.where((F.col("row") <= HEADER_ROWS) & F.col("text").isNotNull()).withColumn("alias", slug(F.regexp_replace("text", r"\([^)]*\)|\[[^\]]*\]|[*:]+", " ")))
    roles = named.join(F.broadcast(header_roles(cells.sparkSession)), "alias")
    first = roles.groupBy("archive", "sheet", "row", "role").agg(F.min("col").alias("col"))
    w = Window.partitionBy("archive", "sheet", "row")
    good = first.withColumn("n", F.count("*").over(w)).withColumn("has", F.max((F.col("role") == "content").cast("int")).over(w)).where("n >= 2 and has = 1")
    best = good.groupBy("archive", "sheet").agg(F.min("row").alias("header_row"))
    return good.join(best, ["archive", "sheet"]).where("row = header_row").select("archive", "sheet", "header_row", "col", "role")


def records(cells: DataFrame) -> DataFrame:
    """A row for each sheet row below the header, a column for each role; the bank filled down; rows without content left out."""
    found = headers(cells)
    below = cells.join(found, ["archive", "sheet", "col"]).where("row > header_row")
    wide = below.groupBy("archive", "sheet", "row").pivot("role", list(ALIASES)).agg(F.first("text"))
    fill = Window.partitionBy("archive", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    filled = wide.withColumn("bank", F.last(F.when(trimmed("bank") != "", trimmed("bank")), ignorenulls=True).over(fill))
    used = F.coalesce(*[F.nullif(trimmed(c), F.lit("")) for c in ("content", *"ABCDEFGH", "answer", "solution", "picture")])
    return filled.where(used.isNotNull() | (code_of(F.col("kind"), TYPE_NAMES) == "passage"))


def inferred_kind(content: Column, answer: Column, options: Column) -> Column:
    """The type of a row that names none: boxes, option labels, true or false marks, arrows, a number, text, else essay."""
    a = trimmed(F.coalesce(answer, F.lit("")))
    boxes, filled = F.regexp_extract_all(content, F.lit(r"\[\[([^\]]*)\]\]"), F.lit(1)), F.filter(options, lambda o: F.coalesce(trimmed(o), F.lit("")) != "")
    letters, arrows = F.regexp_replace(F.upper(a), r"[\s,;&.]", ""), F.size(F.filter(filled, lambda o: o.rlike("=>|⇒|->|→")))
    return (
        F.when(F.size(boxes) > 0, F.when(F.exists(boxes, lambda b: b.contains("*")), "dropdowns").otherwise("blanks"))
        .when((F.size(filled) >= 2) & letters.rlike("^[A-H]+$"), F.when(F.length(letters) == 1, "mc").otherwise("ma"))
        .when((F.size(filled) >= 1) & F.upper(a).rlike(r"^[ĐSTFD\s,;.\-a-hA-H)]+$") & (a != ""), "tf")
        .when(arrows >= 2, "matching")
        .when(a.rlike("^[-+−]?\\d+([.,]\\d+)?(\\s*(±|\\.\\.|…)\\s*[-+−]?\\d+([.,]\\d+)?)?$"), "num")
        .when(a != "", "short")
        .otherwise("essay")
    )
