"""Registered queries of the exam-content operators and the SQL that gives the same rows.

The driver's tables hold no exams, so each query derives its input from them by plain arithmetic; the SQL derives it alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exalake.functions import answers, formats, text
from exalake.operators import answer_key, grading, integrity, ordered, packages, sheets, validation
from exalake.sources import exams, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- grading ------------------------------------------------------------------------------------------------------------
@query("""
SELECT student, count(score) AS graded, round(sum(score), 6) AS total FROM (
  SELECT l_orderkey AS student, CASE WHEN l_linenumber % 4 = p_size % 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY student""")
def grade_responses(spark, sf_dir):
    """Single choice: each order line answers the question of its part."""
    responses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("student"), F.col("l_partkey").alias("item"), (F.col("l_linenumber") % 4).alias("chosen"))
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") % 4).alias("correct"), F.lit(1.0).alias("points"))
    return grading.totals(grading.grade_single(responses, keys))


@query("""
SELECT student, item, round(CASE WHEN wrong > 0 THEN greatest(hit / tot * 2.0 - wrong / tot * 2.0, 0.0) ELSE hit / tot * 2.0 END, 10)::DOUBLE AS score FROM (
  SELECT l_orderkey AS student, l_partkey AS item, least(p_size % 4 + 1, l_linenumber % 4 + 1)::DOUBLE AS hit,
    greatest(l_linenumber % 4 + 1 - (p_size % 4 + 1), 0)::DOUBLE AS wrong, (p_size % 4 + 1)::DOUBLE AS tot
  FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def grade_multiple_answers(spark, sf_dir):
    """Several answers, two points: right less wrong ones over the number of right ones, not below 0."""
    responses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("student"), F.col("l_partkey").alias("item"), F.sequence(F.lit(0), (F.col("l_linenumber") % 4).cast("int")).alias("chosen"))
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.sequence(F.lit(0), F.lit(3)).alias("options"), F.sequence(F.lit(0), (F.col("p_size") % 4).cast("int")).alias("correct"), F.lit(2.0).alias("points"))
    return grading.grade_multiple(responses, keys)


@query("""
SELECT student, item, CASE WHEN trim(value) <> '' AND x >= low - 1e-12 AND x <= high + 1e-12 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM (
  SELECT *, coalesce(try_cast(replace(value, ',', '') AS DOUBLE), 0.0) AS x FROM (
    SELECT l_orderkey AS student, l_partkey AS item,
      CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '0,' WHEN 2 THEN '0.' ELSE 'x' END || CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE lpad(CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR), 2, '0') END AS value,
      (p_size % 9)::DOUBLE / 100 - 0.02 AS low, (p_size % 9)::DOUBLE / 100 + 0.02 AS high FROM lineitem JOIN part ON l_partkey = p_partkey))""")
def grade_numeric_answers(spark, sf_dir):
    """Numbers within a tolerance; a comma is dropped, so 0,05 is 5; no number is 0; blank scores 0."""
    digits = F.lpad(F.round(F.col("l_discount") * 100).cast("int").cast("string"), 2, "0")
    kind = F.col("l_linenumber") % 4
    value = F.when(kind == 0, "").otherwise(F.concat(F.when(kind == 1, "0,").when(kind == 2, "0.").otherwise("x"), digits))
    responses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("student"), F.col("l_partkey").alias("item"), value.alias("value"))
    middle = (F.col("p_size") % 9).cast("double") / 100
    intervals = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), (middle - 0.02).alias("low"), (middle + 0.02).alias("high"), F.lit(1.0).alias("points"))
    return grading.grade_numeric(responses, intervals)


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_orderkey AS item, l_linenumber AS blank, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE ' ' || lower(s) || ' ' END AS value, o_orderstatus AS accepted FROM l JOIN orders ON l_orderkey = o_orderkey)
SELECT item, CASE WHEN max(CASE WHEN trim(value) <> '' THEN 1 ELSE 0 END) = 1 THEN round(sum(CASE WHEN lower(trim(value)) = lower(trim(accepted)) THEN 1 ELSE 0 END)::DOUBLE / count(*), 10) END AS score
FROM r GROUP BY item""")
def grade_fill_blanks(spark, sf_dir):
    """Blanks of one order: the share that equals an accepted text; nothing filled in gives null."""
    # hardly any two lines are alike, so they are dealt before they are grouped, and to more tasks than usual
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(spark, sf_dir, "lineitem").repartition(tasks, "l_orderkey", "l_linenumber")
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_linestatus").alias("l_linestatus"))
    orders = table(spark, sf_dir, "orders")
    value = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.lower("l_linestatus"), F.lit(" ")))
    responses = lines.select(F.lit(0).alias("student"), F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("blank"), value.alias("value"))
    keys = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("blank"), F.col("o_orderstatus").alias("accepted"), F.lit(1.0).alias("points"))
    return grading.grade_blanks(responses, keys).select("item", "score")


@query("""
WITH p AS (SELECT l_orderkey AS item, l_linenumber AS left_id, max(l_returnflag) AS right_text, l_linenumber AS right_id FROM lineitem GROUP BY 1, 2),
r AS (SELECT a.item, a.left_id, a.right_text, b.right_text AS said FROM p a LEFT JOIN p b ON a.item = b.item AND b.right_id = a.left_id % 3 + 1 WHERE a.left_id % 5 <> 0)
SELECT p.item, round(max(h.hits)::DOUBLE / count(*), 10) AS score FROM p
LEFT JOIN (SELECT item, sum(CASE WHEN said = right_text THEN 1 ELSE 0 END) AS hits FROM r GROUP BY item) h ON p.item = h.item GROUP BY p.item""")
def grade_matching_pairs(spark, sf_dir):
    """Matching: a left side is right if the chosen right side has its pair's text."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("n")).agg(F.max("l_returnflag").alias("right")).withColumn("left_id", F.col("n").cast("string"))
    responses = lines.select(F.lit(0).alias("student"), "item", "left_id", F.when(F.col("n") % 5 != 0, (F.col("n") % 3 + 1).cast("string")).alias("right_id"))
    pairs = lines.select("item", "left_id", "right", F.lit(1.0).alias("points"))
    return grading.grade_matching(responses, pairs, lines.select("item", F.col("left_id").alias("right_id"), "right")).select("item", "score")


@query("""
SELECT c_custkey AS student, round(CASE WHEN lower(trim(c_mktsegment)) IN (lower(trim(' Building ')), 'machinery') THEN 0.5 ELSE 0.0 END, 10)::DOUBLE AS score FROM customer""")
def grade_short_answers(spark, sf_dir):
    """Short answers: any accepted spelling, outer blanks and case aside."""
    responses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student"), F.lit(1).alias("item"), F.concat(F.col("c_mktsegment"), F.lit("  ")).alias("value"))
    accepted = spark.createDataFrame([(1, " Building ", 0.5), (1, "machinery", 0.5), (1, " ", 0.5)], "item int, answer string, points double")
    return grading.grade_short(responses, accepted).select("student", "score")


# -- texts and answers ---------------------------------------------------------------------------------------------------
@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(translate(strip_accents(translate(text, 'đĐßẞ', 'dd  ')), 'đĐ', 'dd')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug,
  length(nfc_normalize(text))::BIGINT AS n_chars FROM documents""")
def normalise_texts(spark, sf_dir):
    """Slugs and lengths in normal form C of documents: ß is no ASCII letter, so slug() parts words at it, and the SQL does alike."""
    given = F.col("text").isNotNull()
    slug, length = F.when(given, text.slug(text.without_any_marks(F.translate("text", "đĐ", "dd")))), F.when(given, F.length(text.nfc("text")))
    return table(spark, sf_dir, "documents").select("doc_id", slug.alias("slug"), length.cast("long").alias("n_chars"))


@query(r"""
SELECT page_id, length(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#13;'))::BIGINT AS xml_chars,
  length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'))::BIGINT AS html_chars,
  ((length(html) - length(replace(html, '<p>', ''))) // 3)::INTEGER AS paragraphs FROM pages""")
def escape_pages(spark, sf_dir):
    """Lengths of escaped pages and how often a tag stands in them."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(text.escape_xml(html)).cast("long").alias("xml_chars"), F.length(text.escape_html(html)).cast("long").alias("html_chars"), text.occurrences(html, F.lit("<p>")).alias("paragraphs"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '(?i)<img\b[^>]*?\bsrc\s*=\s*["'']([^"'']*)["'']', 1))::INTEGER AS images,
  (regexp_matches(html, '(?i)<(script|iframe|object|embed|form|meta|link|base)\b') OR regexp_matches(html, '(?i)\son[a-z]+\s*=') OR regexp_matches(html, '(?i)(href|src|action)\s*=\s*["'']?\s*(javascript|vbscript|data:text/html)')) AS unsafe,
  regexp_matches(html, '</?[A-Za-z][A-Za-z0-9-]*(?:\s*/?>|\s+[A-Za-z_:][-A-Za-z0-9_:.]*\s*=)|<!--') AS has_tag FROM pages""")
def inspect_pages(spark, sf_dir):
    """Image references and unsafe markup of pages."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.image_sources(html)).alias("images"), text.unsafe_html(html).alias("unsafe"), text.has_tag(html).alias("has_tag"))


@query()
def page_texts(spark, sf_dir):
    """Pages as plain text."""
    return table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("text"))


@query("""
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 0.5 WHEN 2 THEN p_size + 0.25 WHEN 3 THEN ('0.' || p_size)::DOUBLE WHEN 4 THEN NULL ELSE p_size::DOUBLE END::DOUBLE AS points FROM part""")
def parse_points(spark, sf_dir):
    """Points in their many spellings."""
    n, kind = F.col("p_size").cast("string"), F.col("p_size") % 6
    said = F.when(kind == 0, F.concat(n, F.lit(" điểm"))).when(kind == 1, F.concat(F.lit("( "), n, F.lit(",5 đ )"))).when(kind == 2, F.concat(n, F.lit(".25"))).when(kind == 3, F.concat(F.lit("."), n, F.lit(" pts"))).when(kind == 4, F.concat(n, F.lit(" x"))).otherwise(F.concat(F.lit("["), n, F.lit("P]")))
    return table(spark, sf_dir, "part").select("p_partkey", answers.points(said).alias("points"))


@query("""
SELECT p_partkey, (p_size + 0.5)::DOUBLE AS sheet, CASE WHEN p_size % 2 = 0 THEN 1000 + p_size ELSE p_size * 1000 + 234.5 END::DOUBLE AS document,
  CASE WHEN p_size % 2 = 0 THEN p_size - 1.5 ELSE least(p_size, 7) END::DOUBLE AS low, CASE WHEN p_size % 2 = 0 THEN p_size + 1.5 ELSE greatest(p_size, 7) END::DOUBLE AS high FROM part""")
def parse_numbers(spark, sf_dir):
    """Numbers of sheets and documents, tolerances and ranges."""
    n, even = F.col("p_size").cast("string"), F.col("p_size") % 2 == 0
    span = answers.numeric_answer(F.when(even, F.concat(n, F.lit(" ± 1,5"))).otherwise(F.concat(n, F.lit(" .. 7"))))
    many = F.when(even, F.concat(F.lit("1."), F.lit("0"), F.lpad(n, 2, "0"))).otherwise(F.concat(n, F.lit(".234,5")))
    many = F.when(even, F.concat(F.lit("1.0"), F.lpad(n, 2, "0"), F.lit(",0"))).otherwise(many)
    low, high = F.coalesce(span["min"], span["exact"] - span["margin"]), F.coalesce(span["max"], span["exact"] + span["margin"])
    return table(spark, sf_dir, "part").select("p_partkey", answers.sheet_number(F.concat(F.lit(" "), n, F.lit(",5"))).alias("sheet"), answers.document_number(many).alias("document"), low.alias("low"), high.alias("high"))


@query("""
SELECT p_partkey, array_to_string(CASE WHEN p_size % 3 = 0 THEN ['x' || p_size] WHEN p_size % 3 = 1 THEN ['-' || p_size || ',5', chr(8722) || p_size || ',5', '-' || p_size || '.5', chr(8722) || p_size || '.5']
  ELSE [p_size || '.5', 'Ab', p_size || ',5'] END, '|') AS variants FROM part""")
def answer_variants(spark, sf_dir):
    """Accepted spellings of answers: decimal marks and minus signs, case aside distinct."""
    n = F.col("p_size").cast("string")
    kind = F.col("p_size") % 3
    given = F.when(kind == 0, F.array(F.concat(F.lit("x"), n), F.concat(F.lit(" X"), n), F.lit(" "))).when(kind == 1, F.array(F.concat(F.lit("-"), n, F.lit(",5")))).otherwise(F.array(F.concat(n, F.lit(".5")), F.lit("Ab"), F.lit("aB ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(answers.variants(given), "|").alias("variants"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'A,C' WHEN 1 THEN 'B,D' WHEN 2 THEN 'H' ELSE NULL END AS letters FROM orders""")
def option_letters(spark, sf_dir):
    """Option letters from their spellings."""
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, "A và c, A").when(k == 1, "bd").when(k == 2, "(H)").otherwise("A và Z")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(answers.option_letters(said), ",").alias("letters"))


@query("""
SELECT p_partkey, ['mc', 'ma', 'tf', 'unknown', 'num', 'dropdowns', 'essay', 'short', 'passage', 'matching'][CAST(p_partkey % 10 AS INTEGER) + 1] AS kind_code, ['NB', 'VDC', 'TH'][CAST(p_partkey % 3 AS INTEGER) + 1] AS level_code FROM part""")
def type_and_level_codes(spark, sf_dir):
    """Question types and levels as sheets name them: whole, by a part of the name, by its first word."""
    named = ["TN – Một đáp án", "Nhiều đáp án", "ĐS: Đúng/Sai", "???", "Điền số (đơn vị)", "Chọn - từ danh sách", "Tự luận *", "TLN", "đoạn dẫn", "ghép cột"]
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(named).alias("kind"), pick(["Nhận biết", "Mức 4", "2"]).alias("level"))
    return rows.select("p_partkey", sheets.code_of(F.col("kind"), sheets.TYPE_NAMES).alias("kind_code"), sheets.code_of(F.col("level"), sheets.LEVEL_NAMES).alias("level_code"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'a1b0c1' WHEN 1 THEN 'a1b0c0' WHEN 2 THEN 'a0b1c1' WHEN 3 THEN NULL ELSE 'a1b1c0' END AS marks FROM orders""")
def true_false_answers(spark, sf_dir):
    """True and false marks by label or in order, for three statements."""
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, "ĐSĐ").when(k == 1, "a-Đ, b-S; c-F").when(k == 2, "b) Đúng a) Sai c) true").when(k == 3, "Đúng; Sai").otherwise("T / dung. sai")
    labels = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    marks = answers.true_false_of(answers.true_false(said), labels)
    text_of = F.array_join(F.transform(labels, lambda x: F.concat(x, F.try_element_at(marks, x).cast("int").cast("string"))), "")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(marks.isNotNull(), text_of).alias("marks"))


@query("""
SELECT c.c_custkey AS student, c.c_nationkey AS item, CASE WHEN c.c_custkey % 7 = 0 OR n.n_nationkey IS NULL THEN NULL WHEN c.c_custkey % 4 IN (1, 3) THEN 2.0 ELSE 0.0 END AS score
FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) n ON n.n_nationkey = c.c_nationkey""")
def grade_choices(spark, sf_dir):
    """Single choice with two accepted options; unanswered and unkeyed items keep a row without a score."""
    chosen = F.when(F.col("c_custkey") % 7 != 0, F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("c_custkey") % 4 + 1).cast("int")))
    said = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student"), F.col("c_nationkey").alias("item"), chosen.alias("chosen"))
    keys = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("item"), F.array(F.lit("B"), F.lit("D")).alias("correct"), F.lit(2.0).alias("points"))
    return grading.grade_choice(said, keys)


@query("""
WITH q AS (SELECT DISTINCT o_custkey AS exam, CASE WHEN o_custkey % 3 = 0 THEN 'II' ELSE 'I' END AS part, CAST(o_orderkey % 10 AS VARCHAR) AS no FROM orders),
k AS (SELECT DISTINCT o_custkey AS exam, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'I' END AS part, CAST(o_orderkey % 7 AS VARCHAR) AS no FROM orders)
SELECT k.exam, k.part, k.no FROM k WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.exam = k.exam AND q.no = k.no)""")
def unused_after_fallback(spark, sf_dir):
    """Key entries that no question took, also not as the part without a name or as the only part."""
    o = table(spark, sf_dir, "orders").withColumn("exam", F.col("o_custkey"))
    q = o.select("exam", F.when(F.col("exam") % 3 == 0, "II").otherwise("I").alias("part"), (F.col("o_orderkey") % 10).cast("string").alias("no")).distinct().withColumn("qid", F.struct("part", "no"))
    k = o.select("exam", F.when(F.col("exam") % 2 == 0, "").otherwise("I").alias("part"), (F.col("o_orderkey") % 7).cast("string").alias("no")).distinct()
    return answer_key.unused_after(k, answer_key.find_answers(q, k.withColumn("value", F.lit("A"))))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS INTEGER), 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"


@query(f"""
SELECT c_custkey, 'nh_' || s || '_' || lower(lpad(to_hex(xor(h >> 24, h & 16777215)), 6, '0')) AS ident FROM (
  SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')[1:40] AS s, {_FNV.format("c_name")} AS h FROM customer)""")
def bank_idents(spark, sf_dir):
    """Stable identifiers of names: slug and folded hash."""
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", text.bank_ident(name, text.slug_of_folded(name)).alias("ident"))


@query(r"""
SELECT page_id, 'site/img/' || page_id || '.png' AS resolved, CASE WHEN page_id % 26 = 0 THEN 0 ELSE 26 + page_id % 26 END::INTEGER AS col FROM pages""")
def resolve_paths(spark, sf_dir):
    """Relative references resolved; spreadsheet columns numbered."""
    n = F.col("page_id").cast("string")
    letter = F.char(65 + F.col("page_id") % 26)
    ref = F.when(F.col("page_id") % 26 == 0, "A").otherwise(F.concat(F.lit("A"), letter))
    return table(spark, sf_dir, "pages").select("page_id", text.resolve_path(F.lit("site/html/index.html"), F.concat(F.lit("..\\img/./x/../"), n, F.lit(".png?v=1#t"))).alias("resolved"), text.column_number(ref).alias("col"))


@query("""
SELECT event_id, event_type, json_extract_string(props, '$.' || list_sort(json_keys(props))[1]) AS first_value, len(json_keys(props))::INTEGER AS n_keys FROM events""")
def event_properties(spark, sf_dir):
    """JSON objects as maps: the value of the first key and how many there are."""
    m = F.from_json("props", "map<string,string>")
    first = F.sort_array(F.map_keys(m))[0]
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.element_at(m, first).alias("first_value"), F.size(F.map_keys(m)).alias("n_keys"))


# -- ordered rows --------------------------------------------------------------------------------------------------------
@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bank FROM events""")
def forward_fill(spark, sf_dir):
    """Each event with the last signup of its user at or above it."""
    rows = table(spark, sf_dir, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return ordered.forward_fill(rows, "mark", ["user_id"], ["ts", "event_id"], "bank").select("event_id", "bank")


@query("""
WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id WHEN event_type = 'click' THEN -1 END AS m FROM events),
f AS (SELECT event_id, last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS x FROM e)
SELECT event_id, nullif(x, -1) AS passage FROM f""")
def fill_until_stop(spark, sf_dir):
    """A passage runs from its row to the next stop row."""
    rows = table(spark, sf_dir, "events").withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return ordered.fill_until(rows, "mark", F.col("event_type") == "click", ["user_id"], ["ts", "event_id"], "passage").select("event_id", "passage")


@query("""
WITH m AS (SELECT event_id, user_id % 50 AS sheet FROM events WHERE event_id % 2 = 0), r AS (SELECT DISTINCT user_id % 50 AS sheet, event_id AS row_id FROM events WHERE event_id % 2 <> 0),
f AS (SELECT sheet, min(row_id) AS first_id FROM r GROUP BY sheet)
SELECT m.event_id, coalesce(r.row_id, f.first_id) AS row_at FROM m ASOF LEFT JOIN r ON m.sheet = r.sheet AND m.event_id >= r.row_id LEFT JOIN f ON m.sheet = f.sheet""")
def nearest_row_above(spark, sf_dir):
    """Pictures to the nearest row at or above them, else to the first row; even events are pictures, odd ones rows."""
    e = table(spark, sf_dir, "events").withColumn("sheet", F.col("user_id") % 50).withColumn("at", F.col("event_id"))
    return ordered.nearest_above(e.where("event_id % 2 = 0").select("event_id", "sheet", "at"), e.where("event_id % 2 <> 0").select("sheet", "at"), ["sheet"], "at", "at", "row_at").select("event_id", "row_at")


@query("""
WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c)
SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first_at, max(event_id) AS last_at FROM r GROUP BY user_id, run, event_type""")
def merge_runs(spark, sf_dir):
    """Adjacent events of one type as one run."""
    return ordered.runs(table(spark, sf_dir, "events"), "event_type", ["user_id"], ["event_id"])


@query("""
WITH n AS (SELECT o_orderkey, o_orderkey % 2 <> 0 AS q, o_custkey % 20 AS no, o_custkey % 97 AS value, row_number() OVER (PARTITION BY o_orderkey % 2 <> 0, o_custkey % 20 ORDER BY o_orderkey) AS nth FROM orders)
SELECT q.o_orderkey, k.value FROM (SELECT * FROM n WHERE q) q LEFT JOIN (SELECT * FROM n WHERE NOT q) k ON q.no = k.no AND q.nth = k.nth""")
def nth_key_to_nth_question(spark, sf_dir):
    """The k-th key entry of a number to the k-th question with it; odd orders are questions, even ones key entries."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("no"), F.col("o_orderkey").alias("ord"), F.lit(1).alias("exam"), (F.col("o_custkey") % 97).alias("value"))
    return answer_key.nth_to_nth(rows.where("o_orderkey % 2 <> 0").drop("value"), rows.where("o_orderkey % 2 = 0").drop("o_orderkey")).select("o_orderkey", "value")


@query()
def segment_conversations(spark, sf_dir):
    """Turns of a conversation in segments: a role that comes again within a segment opens the next."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordered.segments(turns, "role", ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "segment")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN nth < n THEN round(10.0::DOUBLE / n, 4) ELSE round(10.0::DOUBLE - round(10.0::DOUBLE / n, 4) * (n - 1), 4) END AS points FROM s""")
def split_points(spark, sf_dir):
    """Ten points in equal shares over the lines of an order; the last line takes the rest."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(10.0).alias("total"))
    return ordered.equal_split(lines, "total", ["l_orderkey"], ["l_linenumber"], "points").drop("total")


@query("""
WITH n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE upper(o_orderpriority) END AS name FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, lower(name) ORDER BY o_orderkey) AS nth FROM n)
SELECT o_orderkey, CASE WHEN nth = 1 THEN name ELSE name || '_' || nth END AS file_name FROM r""")
def unique_file_names(spark, sf_dir):
    """Names made unique within a folder, case aside."""
    rows = table(spark, sf_dir, "orders").withColumn("name", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.upper("o_orderpriority")))
    return ordered.unique_names(rows, "name", ["o_custkey"], ["o_orderkey"], "file_name").select("o_orderkey", "file_name")


@query("""
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def first_of_each_source(spark, sf_dir):
    """The longest document of each source."""
    return ordered.first_match(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), "doc_id"]).select("source", "doc_id")


# -- answer keys ---------------------------------------------------------------------------------------------------------
_KEYED = """
q AS (SELECT o_custkey % 100 AS exam, o_orderkey AS qid, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE substr(o_orderpriority, 1, 1) END AS part, o_orderkey % 13 AS no FROM orders),
k AS (SELECT exam, part, no, min(value) AS value FROM (SELECT s_suppkey % 100 AS exam, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(s_suppkey % 5 + 1 AS VARCHAR) END AS part, s_nationkey % 13 AS no, CAST(s_suppkey AS VARCHAR) AS value FROM supplier) GROUP BY exam, part, no)"""


def _questions_and_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    q = orders.select((F.col("o_custkey") % 100).alias("exam"), F.col("o_orderkey").alias("qid"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.substring("o_orderpriority", 1, 1)).alias("part"), (F.col("o_orderkey") % 13).alias("no"))
    k = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 100).alias("exam"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise((F.col("s_suppkey") % 5 + 1).cast("string")).alias("part"), (F.col("s_nationkey") % 13).cast("long").alias("no"), F.col("s_suppkey").cast("string").alias("value"))
    return q, k.groupBy("exam", "part", "no").agg(F.min("value").alias("value"))


@query(f"""
WITH {_KEYED}, parts AS (SELECT exam, list(DISTINCT part) AS parts FROM k GROUP BY exam),
a AS (SELECT q.*, CASE WHEN q.part <> '' AND list_contains(parts, q.part) THEN q.part ELSE '' END AS p1, CASE WHEN (q.part = '' OR NOT list_contains(parts, q.part)) AND len(parts) = 1 THEN parts[1] END AS p2 FROM q LEFT JOIN parts USING (exam))
SELECT a.exam, a.qid, coalesce(k1.value, k2.value) AS value FROM a LEFT JOIN k k1 ON a.exam = k1.exam AND a.p1 = k1.part AND a.no = k1.no LEFT JOIN k k2 ON a.exam = k2.exam AND a.p2 = k2.part AND a.no = k2.no""")
def find_answers(spark, sf_dir):
    """Answers by part and number, with the fallbacks of keys without parts."""
    q, k = _questions_and_key(spark, sf_dir)
    return answer_key.find_answers(q, k).select("exam", "qid", "value")


@query("""
WITH q AS (SELECT DISTINCT l_orderkey % 500 AS exam, l_orderkey * 10 + l_linenumber AS qid, l_linenumber AS low, l_linenumber + l_orderkey % 3 AS high FROM lineitem),
k AS (SELECT p_partkey % 500 AS exam, CASE WHEN p_partkey % 500 % 2 = 0 THEN '' ELSE 'I' END AS part, (p_partkey // 500 % 7 + 1)::INTEGER AS no, min(p_brand) AS value FROM part GROUP BY ALL),
w AS (SELECT s_suppkey % 500 AS exam, (s_suppkey % 7 + 1) || '-' || (s_suppkey % 7 + 1 + s_suppkey % 3) AS no, min(s_name) AS value FROM supplier GROUP BY ALL),
h AS (SELECT qid, q.exam, string_agg(value, ', ' ORDER BY no) AS v, count(*) AS n FROM q JOIN k ON q.exam = k.exam AND k.no BETWEEN low AND high GROUP BY qid, q.exam)
SELECT q.qid, CASE WHEN h.n = q.high - q.low + 1 THEN h.v ELSE w.value END AS value FROM q LEFT JOIN h ON q.qid = h.qid LEFT JOIN w ON w.exam = q.exam AND w.no = q.low || '-' || q.high AND w.exam % 2 = 0""")
def find_range_answers(spark, sf_dir):
    """Questions over a range of numbers take all their answers, or what the key says for the range as a whole.

    Every second exam's key has one named part, beside the ranges without a part; questions of no part take the ranges alone there.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    q = lines.select((F.col("l_orderkey") % 500).alias("exam"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qid"), F.when(F.col("l_orderkey") % 2 == 0, "").otherwise("I").alias("part"), F.col("l_linenumber").cast("int").alias("low"), (F.col("l_linenumber") + F.col("l_orderkey") % 3).cast("int").alias("high"))
    exam = F.col("p_partkey") % 500
    single = table(spark, sf_dir, "part").groupBy(exam.alias("exam"), F.when(exam % 2 == 0, "").otherwise("I").alias("part"), (F.floor(F.col("p_partkey") / 500) % 7 + 1).cast("string").alias("no")).agg(F.min("p_brand").alias("value"))
    s = F.col("s_suppkey")
    whole = table(spark, sf_dir, "supplier").groupBy((s % 500).alias("exam"), F.lit("").alias("part"), F.concat((s % 7 + 1).cast("string"), F.lit("-"), (s % 7 + 1 + s % 3).cast("string")).alias("no")).agg(F.min("s_name").alias("value"))
    return answer_key.find_range_answers(q, single.unionByName(whole)).select("qid", "value")


@query(f"""WITH {_KEYED} SELECT k.exam, k.part, k.no, k.value FROM k WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.exam = k.exam AND q.part = k.part AND q.no = k.no)""")
def unused_answers(spark, sf_dir):
    """Key entries that no question has."""
    q, k = _questions_and_key(spark, sf_dir)
    return answer_key.unused(k, q)


@query("""
SELECT l_suppkey AS file, CAST(l_linenumber AS VARCHAR) AS part, l_partkey % 11 AS no, min(struct_pack(a := l_orderkey * 10 + l_linenumber, b := l_returnflag)).b AS value, count(*) AS entries, count(DISTINCT l_returnflag) > 1 AS conflicting
FROM lineitem GROUP BY 1, 2, 3""")
def first_answer_wins(spark, sf_dir):
    """Entries of a key that come twice: the first counts, differing ones are told."""
    lines = table(spark, sf_dir, "lineitem")
    entries = lines.select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").cast("string").alias("part"), (F.col("l_partkey") % 11).alias("no"), F.col("l_returnflag").alias("value"), F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_returnflag").alias("ord"))
    return answer_key.gather(entries)


@query("""
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderkey % 5 = 0 THEN 'filled' WHEN o_orderstatus = substr(o_orderpriority, 3, 1) OR o_orderkey % 2 = 0 THEN 'same' ELSE 'conflict' END AS outcome FROM orders) GROUP BY outcome""")
def key_outcomes(spark, sf_dir):
    """What applying a key does to each question: the document's own answer stays."""
    o = F.col("o_orderkey")
    marked = F.when(o % 5 == 0, " ").otherwise(F.col("o_orderstatus"))
    keyed = F.when(o % 7 == 0, "").when(o % 2 == 0, F.concat(F.lower("o_orderstatus"), F.lit(" ."))).otherwise(F.substring("o_orderpriority", 3, 1))
    keyed = F.when((o % 7 != 0) & (o % 2 == 0), F.concat(F.lower("o_orderstatus"), F.lit("."))).otherwise(keyed)
    return table(spark, sf_dir, "orders").select(answer_key.outcome(marked, keyed).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def _keys_and_exams(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_id"), F.split(F.concat(F.lower("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" x"), (F.col("c_custkey") % 3).cast("string")), " ").alias("tokens"))
    kind = F.element_at(F.array(*[F.lit(w) for w in ("building", "machinery", "furniture", "household", "automobile")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    exams = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("exam_id"), F.split(F.concat(kind, F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(" x"), (F.col("s_suppkey") % 3).cast("string")), " ").alias("tokens"))
    return keys.distinct(), exams


@query("""
WITH k AS (SELECT DISTINCT c_custkey AS key_id, string_split(lower(c_mktsegment) || ' ' || c_nationkey || ' x' || c_custkey % 3, ' ') AS a FROM customer),
e AS (SELECT s_suppkey AS exam_id, string_split(CASE s_suppkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' WHEN 2 THEN 'furniture' WHEN 3 THEN 'household' ELSE 'automobile' END || ' ' || s_nationkey || ' x' || s_suppkey % 3, ' ') AS b FROM supplier),
g AS (SELECT b, count(*) AS exams, min(exam_id) AS first_id FROM e GROUP BY b),
p AS (SELECT a, exams, first_id, len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) AS overlap, len(list_filter(list_intersect(a, b), lambda t: length(t) >= 2 AND regexp_matches(t, '[a-z]'))) > 0 AS telling FROM (SELECT DISTINCT a FROM k), g),
s AS (SELECT *, max(overlap) OVER (PARTITION BY a) AS best FROM p WHERE telling),
t AS (SELECT a, sum(exams) AS ties, min(first_id) AS likely, max(best) AS best FROM s WHERE overlap = best GROUP BY a)
SELECT k.key_id, CASE WHEN g.exams = 1 THEN g.first_id WHEN g.exams IS NULL AND t.best >= 0.8 AND t.ties = 1 THEN likely END AS exam_id FROM k LEFT JOIN g ON k.a = g.b LEFT JOIN t ON k.a = t.a""")
def pair_key_files(spark, sf_dir):
    """Keys to exams by the words of their names, ties refused."""
    return answer_key.pair_names(*_keys_and_exams(spark, sf_dir))


# -- integrity -----------------------------------------------------------------------------------------------------------
@query("""
SELECT doc_id, 'undeclared' AS issue FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'unused' AS issue FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def orphans(spark, sf_dir):
    """Documents without a label and labels without a document."""
    return integrity.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""
WITH l AS (SELECT l_suppkey AS part, l_orderkey % 2 = 0 AS even, l_orderkey * 10 + l_linenumber AS id, epoch(date_trunc('day', l_shipdate))::BIGINT // 86400 AS day, l_linenumber AS n FROM lineitem)
SELECT a.id AS a_id, b.id AS b_id FROM l a JOIN l b ON a.even AND NOT b.even AND a.part = b.part AND a.day < b.day + b.n * 2 AND b.day < a.day + a.n * 3""")
def overlapping_spans(spark, sf_dir):
    """Shipping spans of one supplier that overlap: those of even orders with those of odd ones."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    side = lambda s, at, m: table(spark, sf_dir, "lineitem").where(at).select(F.col("l_suppkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(f"{s}_id"), day.alias(f"{s}_start"), (day + F.col("l_linenumber") * m).alias(f"{s}_end"))
    return integrity.overlaps(side("a", "l_orderkey % 2 = 0", 3), side("b", "l_orderkey % 2 <> 0", 2), ["part"], 16).select("a_id", "b_id")


@query("""
WITH t AS (SELECT n_nationkey, n_name, lower(n_name) AS low, substr(n_name, 1, 3) AS stem FROM nation),
r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN substr(n_name, 1, 3) ELSE 'none' END AS ref FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, coalesce((SELECT min(n_nationkey) FROM t WHERE t.n_name = r.ref), (SELECT min(n_nationkey) FROM t WHERE t.low = r.ref), (SELECT min(n_nationkey) FROM t WHERE t.stem = r.ref)) AS found FROM r""")
def lookup_with_fallbacks(spark, sf_dir):
    """References by exact name, name in lower case, first letters: the first that matches."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lower("n_name").alias("low"), F.substring("n_name", 1, 3).alias("stem"))
    k = F.col("c_custkey") % 4
    ref = F.when(k == 0, F.col("n_name")).when(k == 1, F.lower("n_name")).when(k == 2, F.substring("n_name", 1, 3)).otherwise("none")
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", ref.alias("ref"))
    return integrity.lookup_first(rows, nations, [("ref", "n_name"), ("ref", "low"), ("ref", "stem")], "c_custkey", "n_nationkey", "found").select("c_custkey", "found")


@query("""
WITH a AS (SELECT o_orderkey AS item, o_orderstatus AS v FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 10 <> 1)
SELECT coalesce(a.item, b.item) AS item, CASE WHEN a.item IS NULL THEN 'added' WHEN b.item IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.item = b.item""")
def compare_versions(spark, sf_dir):
    """Items of two versions of a bank: added, removed, changed, same."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("v"))
    return integrity.versions(o.where("item % 10 <> 0"), o.where("item % 10 <> 1").withColumn("v", F.when(F.col("item") % 6 == 0, "X").otherwise(F.col("v"))), ["item"], ["v"])


# -- validation ----------------------------------------------------------------------------------------------------------
def _questions(spark, sf_dir):
    """Parts as questions of all sorts, valid and not."""
    n = F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("mc", "ma", "tf", "short", "num", "matching", "essay", "quiz")]), (n % 8 + 1).cast("int"))
    text_ = F.col("p_name")
    choices = F.transform(F.sequence(F.lit(1), (n % 4 + 1).cast("int")), lambda i: F.struct(F.char(64 + F.least(i, F.lit(3))).alias("id"), F.when(i == 4, "").otherwise(text_).alias("html"), (i % 3 == n % 3).alias("correct")))
    made = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("bank"), F.col("p_partkey").cast("int").alias("pos"), F.when(n % 11 == 0, "Bad Id").otherwise(F.concat(F.lit("q"), F.col("p_partkey").cast("string"))).alias("id"),
        kind.alias("type"), (n % 5 - 1).cast("double").alias("points"), F.when(n % 7 == 0, "<p> &nbsp;</p>").otherwise(text_).alias("stem"),
        choices.alias("choices"), F.when(n % 3 == 0, F.array(F.lit(" "))).when(n % 3 == 1, F.array(F.lit("<b>x</b>"))).otherwise(F.array(F.lit("a<b"))).alias("answers"),
        F.when(n % 2 == 0, F.struct((n * 1.0).alias("exact"), (n % 3 - 1.0).alias("margin"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))).otherwise(F.struct(F.lit(None).cast("double").alias("exact"), F.lit(None).cast("double").alias("margin"), F.lit(20.0).alias("min"), (n * 1.0).alias("max"))).alias("numeric"),
    )
    rest = [f for f in spark.createDataFrame([], validation.QUESTION).schema if f.name not in made.columns]
    return made.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])


@query("""
WITH q AS (SELECT p_partkey::INTEGER AS pos, p_size AS n, ['mc','ma','tf','short','num','matching','essay','quiz'][p_size % 8 + 1] AS t, p_size % 5 - 1 AS points FROM part),
c AS (SELECT *, n % 4 + 1 AS k, len(list_filter(range(1, n % 4 + 2), lambda i: i % 3 = n % 3)) AS correct FROM q),
i AS (SELECT pos, 'error' AS level, 'id' AS code FROM c WHERE n % 11 = 0
UNION ALL SELECT pos, 'error', 'type' FROM c WHERE t = 'quiz'
UNION ALL SELECT pos, 'error', 'points' FROM c WHERE t <> 'quiz' AND points <= 0
UNION ALL SELECT pos, 'warn', 'empty' FROM c WHERE t <> 'quiz' AND n % 7 = 0
UNION ALL SELECT pos, 'error', 'choices_few' FROM c WHERE t IN ('mc', 'ma') AND k < 2
UNION ALL SELECT pos, 'error', 'choice_none_correct' FROM c WHERE t IN ('mc', 'ma') AND correct = 0
UNION ALL SELECT pos, 'error', 'choice_many_correct' FROM c WHERE t = 'mc' AND correct > 1
UNION ALL SELECT pos, 'error', 'choice_label_twice' FROM c WHERE t IN ('mc', 'ma') AND k = 4
UNION ALL SELECT pos, 'warn', 'choice_empty' FROM c WHERE t IN ('mc', 'ma') AND k = 4
UNION ALL SELECT pos, 'error', 'statements_none' FROM c WHERE t = 'tf'
UNION ALL SELECT pos, 'error', 'short_none' FROM c WHERE t = 'short' AND n % 3 = 0
UNION ALL SELECT pos, 'error', 'short_html' FROM c WHERE t = 'short' AND n % 3 = 1
UNION ALL SELECT pos, 'error', 'num_margin' FROM c WHERE t = 'num' AND n % 2 = 0 AND n % 3 = 0
UNION ALL SELECT pos, 'error', 'num_range_reversed' FROM c WHERE t = 'num' AND n % 2 = 1 AND 20 > n
UNION ALL SELECT pos, 'error', 'pairs_few' FROM c WHERE t = 'matching')
SELECT pos, level, code FROM i""")
def validate_questions(spark, sf_dir):
    """Every rule that a question breaks."""
    return validation.issues(_questions(spark, sf_dir)).select("pos", "level", "code")


@query("""
WITH i AS (SELECT doc_id % 50 AS q, n AS source, doc_id AS ord, CASE WHEN (doc_id + n) % 3 = 0 THEN 'error' WHEN (doc_id + n) % 3 = 1 THEN 'warn' ELSE 'info' END AS level, 'Question ' || doc_id || ': ' || lang || ' text' AS message
  FROM documents, (SELECT unnest([0, 1]) AS n)),
r AS (SELECT *, row_number() OVER (PARTITION BY q, level, lower(regexp_replace(message, '^Question [0-9]+: ', '')) ORDER BY source, ord) AS k FROM i)
SELECT q, level, message, CASE level WHEN 'error' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END AS severity, source, ord FROM r WHERE k = 1""")
def merge_issues(spark, sf_dir):
    """Issues of two checks merged: one of each level and message tail, with its severity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.array(F.lit(0), F.lit(1))).alias("source"))
    s = (F.col("doc_id") + F.col("source")) % 3
    rows = docs.select((F.col("doc_id") % 50).alias("q"), "source", F.col("doc_id").alias("ord"), F.when(s == 0, "error").when(s == 1, "warn").otherwise("info").alias("level"), F.concat(F.lit("Question "), F.col("doc_id").cast("string"), F.lit(": "), "lang", F.lit(" text")).alias("message"))
    return validation.merge_issues(rows, ["q"])


# -- packages ------------------------------------------------------------------------------------------------------------
@query("""
WITH n AS (SELECT c_custkey, 'nh_' || c_nationkey AS bank, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, c_acctbal < 0 AS excluded FROM customer)
SELECT c_custkey, bank || '_q' || lpad(pos::VARCHAR, greatest(length(pos::VARCHAR), 2)::INTEGER, '0') AS ident, pos * 100 + 3 AS answer_id FROM n WHERE NOT excluded""")
def item_identities(spark, sf_dir):
    """Identities by place; excluded questions keep their place."""
    rows = table(spark, sf_dir, "customer").withColumn("bank", F.concat(F.lit("nh_"), F.col("c_nationkey").cast("string")))
    items = packages.number_items(rows, "bank", ["c_custkey"]).where("not c_acctbal < 0")
    return items.select("c_custkey", "ident", packages.answer_id(F.col("pos"), F.lit(3)).cast("long").alias("answer_id"))


@query("""
SELECT p_brand AS bank, p_type AS type, count(*) AS items, round(sum((p_size % 5)::DOUBLE), 4) AS points, CASE WHEN grouping(p_brand) = 1 THEN 3 WHEN grouping(p_type) = 1 THEN 1 ELSE 0 END::INTEGER AS level
FROM part GROUP BY ROLLUP (p_brand, p_type)""")
def package_counts(spark, sf_dir):
    """Items and points by type, by bank and in all."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("bank"), F.col("p_type").alias("type"), (F.col("p_size") % 5).cast("double").alias("points"))
    return packages.summary(rows)


@query("""
WITH i AS (SELECT p_brand AS bank, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, p_name, p_size FROM part),
x AS (SELECT bank, pos, '<item ident="' || bank || '_q' || lpad(pos::VARCHAR, greatest(length(pos::VARCHAR), 2)::INTEGER, '0') || '" title="' || p_name || '" points="' || p_size || '"><presentation>' || p_name || '</presentation></item>' AS xml FROM i)
SELECT bank, bank || '/' || bank || '.xml' AS path, md5('<questestinterop><objectbank>' || string_agg(xml, '' ORDER BY pos) || '</objectbank></questestinterop>') AS digest, count(*) AS items FROM x GROUP BY bank""")
def bank_files(spark, sf_dir):
    """A file of items for each bank, in order."""
    items = packages.number_items(table(spark, sf_dir, "part").withColumn("bank", F.col("p_brand")), "bank", ["p_partkey"])
    xml = packages.item_xml(F.col("ident"), F.col("p_name"), F.col("p_name"), F.col("p_size"))
    return packages.file_digests(packages.bank_files(items.select("bank", "pos", xml.alias("xml"))))


@query("""
SELECT n, CASE n % 5 WHEN 0 THEN 'zip' WHEN 1 THEN 'png' WHEN 2 THEN 'pdf' WHEN 3 THEN 'jpg' ELSE 'unknown' END AS kind FROM (SELECT doc_id AS n FROM documents)""")
def file_kinds(spark, sf_dir):
    """Kinds by first bytes."""
    n = F.col("doc_id")
    magic = F.unhex(F.when(n % 5 == 0, "504B0304").when(n % 5 == 1, "89504E47").when(n % 5 == 2, "25504446").when(n % 5 == 3, "FFD8FF").otherwise("00"))
    content = F.concat(magic, F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select(n.alias("n"), files.file_kind(content).alias("kind"))


@query("""
WITH h AS (SELECT n_nationkey AS sheet, n_nationkey % 3 + 1 AS header_row FROM nation)
SELECT sheet, header_row + r AS row, 'Q' || r AS content, CASE WHEN r % 3 = 1 THEN '12,5' WHEN r % 3 = 2 THEN 'A' ELSE 'word' END AS answer,
  CASE WHEN r % 3 = 1 THEN 'num' WHEN r % 3 = 2 THEN 'mc' ELSE 'short' END AS kind, 'bank ' || (r - (r - 1) % 4) AS bank FROM h, (SELECT unnest(range(1, 13)) AS r)""")
def read_question_sheets(spark, sf_dir):
    """Sheets in cells to question rows: header found by its text, bank filled down, types inferred."""
    sheet = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("archive"), (F.col("n_nationkey") % 3 + 1).alias("h"))
    names = F.array(*[F.lit(x) for x in ("STT", "Nội dung câu hỏi (*)", "Đáp án", "A", "B", "Ngân hàng", "Ghi chú")])
    head = sheet.select("archive", F.col("h").alias("row"), F.posexplode(names).alias("col", "text"))
    r = F.col("r")
    values = F.array(r.cast("string"), F.concat(F.lit("Q"), r.cast("string")), F.when(r % 3 == 1, "12,5").when(r % 3 == 2, "A").otherwise("word"), F.when(r % 3 == 2, "yes"), F.when(r % 3 == 2, "no"), F.when(r % 4 == 1, F.concat(F.lit("bank "), r.cast("string"))), F.lit("note"))
    body = sheet.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(12)))).select("archive", (F.col("h") + r).alias("row"), F.posexplode(values).alias("col", "text"))
    cells = head.unionByName(body).where(F.col("text").isNotNull()).select(F.col("archive").cast("string").alias("archive"), F.lit("s1").alias("sheet"), "row", "col", "text")
    kind = sheets.inferred_kind(F.col("content"), F.col("answer"), F.array("A", "B"))
    return sheets.records(cells).select(F.col("archive").cast("int").alias("sheet"), F.col("row").cast("long").alias("row"), "content", "answer", kind.alias("kind"), "bank")


# -- cells and JSON packages ---------------------------------------------------------------------------------------------
@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(DATE '1899-12-30' + CAST(o_orderkey % 40000 + 61 AS INTEGER), '%d/%m/%Y')
  WHEN 1 THEN CAST(o_orderkey % 100 AS VARCHAR) || '%' ELSE CAST(o_orderkey % 24 AS VARCHAR) || ':30' END AS shown FROM orders""")
def shown_numbers(spark, sf_dir):
    """Cell numbers as their formats show them: dates, percent, times."""
    n = F.col("o_orderkey")
    kind = n % 3
    v = F.when(kind == 0, (n % 40000 + 61).cast("double")).when(kind == 1, (n % 100) / 100).otherwise((n % 24 + 0.5) / 24)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", v.cast("double").alias("v"), F.when(kind == 0, 14).when(kind == 1, 9).otherwise(20).alias("id"))
    rows = rows.withColumn("f", formats.classify(F.col("id"), F.lit(None).cast("string")))
    return rows.select("o_orderkey", formats.shown(F.col("v"), F.col("f")).alias("shown"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS package, CASE p_size % 3 WHEN 0 THEN 'mc' WHEN 1 THEN 'short' END AS type, CAST(i AS VARCHAR) AS no, p_name || i AS stem, 'k' || i AS answer, CASE WHEN i = 1 THEN 2.5 ELSE 0.5 END::DOUBLE AS points
FROM part, (SELECT unnest([1, 2, 3]) AS i)""")
def exam_package_questions(spark, sf_dir):
    """JSON exam packages to question rows; worked examples (number 0) left out, unknown group types kept without a type."""
    item = lambda i: F.struct(F.lit(i).alias("n"), F.concat("p_name", F.lit(str(i))).alias("q"), F.lit(f"k{i}").alias("ans"), (F.lit(2.5) if i == 1 else F.lit(None).cast("double")).alias("pt"))
    kind = F.element_at(F.array(F.lit("mcq"), F.lit("order"), F.lit("riddle")), (F.col("p_size") % 3 + 1).cast("int"))
    groups = F.array(F.struct(kind.alias("type"), F.lit(0.5).alias("perItem"), F.array(*[item(i) for i in range(4)]).alias("items")))
    data = F.to_json(F.struct(F.struct(F.lit("t").alias("title")).alias("EXAM"), F.array(F.struct(F.lit("I").alias("label"), groups.alias("groups"))).alias("PARTS")))
    packages_ = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("package"), data.alias("data"))
    return exams.questions(packages_).select("package", "type", "no", "stem", "answer", "points")


from exalake.plans import bank_queries, source_queries  # noqa: E402,F401  they register their queries; they need those above
