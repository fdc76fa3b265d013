"""Registered queries of package forms, answer domains, merged cells, running context, label chains and scripts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from exalake.operators import context, domains, formulas, items, pictures, regions, successors, validation
from exalake.plans.queries import query, table
from exalake.sources import forms, json_data, scripts
from exalake.sources.shared import cut


# -- cells -----------------------------------------------------------------------------------------------------------------
@query("""
WITH c AS (SELECT doc_id % 3 AS sheet, doc_id // 24 AS r, CAST(doc_id // 3 % 8 AS INTEGER) AS c, max(CASE WHEN n_chars % 2 = 0 THEN source || doc_id ELSE '' END) AS text FROM documents GROUP BY ALL),
m AS (SELECT doc_id % 3 AS sheet, doc_id // 24 AS r1, doc_id // 3 % 8 AS c1, doc_id // 24 + doc_id % 40 AS r2, doc_id // 3 % 8 + doc_id % 4 AS c2, doc_id AS o FROM labels),
f AS (SELECT c.sheet, c.r, c.c, arg_min({'r': m.r1, 'c': m.c1}, m.o) AS corner FROM c JOIN m ON c.sheet = m.sheet AND c.r BETWEEN m.r1 AND m.r2 AND c.c BETWEEN m.c1 AND m.c2
  WHERE c.text = '' AND NOT (c.r = m.r1 AND c.c = m.c1) GROUP BY ALL)
SELECT c.sheet, c.r, c.c, c.text, k.text AS merged FROM c LEFT JOIN f USING (sheet, r, c) LEFT JOIN c AS k ON k.sheet = c.sheet AND k.r = f.corner.r AND k.c = f.corner.c""")
def merged_cells(spark, sf_dir):
    """Blank cells take what stands in the corner of the first merged region that they lie in; three sheets hold all cells."""
    place = lambda i: [(i % 3).alias("sheet"), F.floor(i / 24).alias("r"), (F.floor(i / 3) % 8).cast("int").alias("c")]
    i = F.col("doc_id")
    text = F.when(F.col("n_chars") % 2 == 0, F.concat("source", i.cast("string"))).otherwise("")
    cells = table(spark, sf_dir, "documents").select(*place(i), text.alias("text")).groupBy("sheet", "r", "c").agg(F.max("text").alias("text"))
    corner = table(spark, sf_dir, "labels").select(*place(i), i.alias("o"))
    merged = corner.select("sheet", F.col("r").alias("r1"), F.col("c").alias("c1"), (F.col("r") + F.col("o") % 40).alias("r2"), (F.col("c") + F.col("o") % 4).cast("int").alias("c2"), "o")
    return regions.anchor_values(cells, merged, ["sheet"], "text", "o", F.col("text") == "", "merged")


# -- JSON ------------------------------------------------------------------------------------------------------------------
@query("""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, turn, role, text FROM conversations)
SELECT conv_id, path, kind, text FROM (
  SELECT conv_id, '$.turns[' || i || '].said.role' AS path, 'string' AS kind, role AS text FROM t WHERE role IS NOT NULL
  UNION ALL SELECT conv_id, '$.turns[' || i || '].said[''the text'']', 'string', text FROM t WHERE text IS NOT NULL
  UNION ALL SELECT conv_id, '$.turns[' || i || '].at[0]', 'number', CAST(turn AS VARCHAR) FROM t WHERE turn IS NOT NULL
  UNION ALL SELECT conv_id, '$.id', 'number', CAST(conv_id AS VARCHAR) FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id)""")
def conversation_leaves(spark, sf_dir):
    """Conversations as nested JSON, walked to every leaf with its path."""
    turn = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    said = lambda t: F.struct(F.struct(t["role"].alias("role"), t["text"].alias("the text")).alias("said"), F.array(t["turn"]).alias("at"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return json_data.leaves(rows.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), F.transform("turns", said).alias("turns"))).alias("json")), "json")


def _packages(spark, sf_dir):
    """A package for each page in one of six forms, by its number; two questions and the words to choose from hold its address."""
    pages = table(spark, sf_dir, "pages")
    name, size = F.coalesce("url", F.lit("")), F.col("page_id")
    brand = F.concat(F.lit("Brand "), (size % 25).cast("string"))
    q = lambda n, ans, **more: F.struct(F.lit(n).alias("n"), name.alias("q"), ans.alias("ans"), *[v.alias(k) for k, v in more.items()])
    option = lambda k, t, key="k", text="t": F.struct(F.lit(k).alias(key), t.alias(text))
    info = F.struct(F.lit(0.25).alias("ptI"), F.lit(0.5).alias("ptIII")).alias("EXAM_INFO")
    right = F.when(size % 2 == 0, "B").otherwise("Z")
    of = {
        # headings: the first is right, the second left over, the third the example's
        0: F.struct(info, F.array(F.struct(F.lit(1).alias("no"), F.array(F.struct(F.lit("select").alias("type"), F.array(option("i", brand), option("ii", name), option("iii", brand)).alias("list"), F.struct(F.lit("iii").alias("ans")).alias("example"), F.array(q(0, F.lit("iii")), q(1, F.lit("i")), q(2, F.lit("x"))).alias("items"))).alias("groups"))).alias("PASSAGES")),
        # choices whose keys are letters of their places
        1: F.struct(info, F.array(F.struct(F.lit("I").alias("label"), F.lit("I").alias("key"), F.lit("mcq").alias("type"), F.array(q(1, right, opts=F.array(brand, name)), q(2, F.lit("A"), opts=F.array(brand, name))).alias("items"))).alias("PARTS")),
        # a bank of words, in other letters
        2: F.struct(info, F.array(F.struct(F.lit("I").alias("roman"), F.lit(1).alias("no"), F.lit("a < b").alias("instr"), F.lit("bank").alias("type"), F.array(brand, name).alias("bank"), F.array(q(1, F.upper(brand), alt=F.array(F.lit("?"))), q(2, F.lit("none"), alt=F.array(name))).alias("items"))).alias("EXERCISES")),
        # tags, one of them the example's
        3: F.struct(info, F.array(F.struct(F.lit(7).alias("id"), F.lit("x").alias("icon"), brand.alias("title"), F.lit("letterMatch").alias("type"), F.array(F.struct(F.lit("A").alias("v"), brand.alias("t"), F.lit(False).alias("example")), F.struct(F.lit("B").alias("v"), name.alias("t"), F.lit(True).alias("example"))).alias("bank"), F.array(F.struct(F.lit(1).alias("n"), name.alias("prompt"), right.alias("ans"))).alias("items"))).alias("PARTS")),
        # choices by their text, and a short answer
        4: F.struct(F.array(F.struct(F.lit(1).alias("n"), F.lit("choice").alias("type"), name.alias("prompt"), F.array(F.lit("no"), brand).alias("options"), F.when(size % 2 == 0, brand).otherwise(name).alias("answer")), F.struct(F.lit(2).alias("n"), F.lit("type").alias("type"), name.alias("prompt"), F.lit(None).cast("array<string>").alias("options"), brand.alias("answer"))).alias("QUESTIONS")),
        # several answers of a group
        5: F.struct(F.struct(F.lit("t").alias("title")).alias("EXAM"), F.array(F.struct(F.lit("I").alias("label"), F.array(F.struct(F.lit("multi").alias("type"), F.lit(0.5).alias("perItem"), F.array(brand, name).alias("opts"), F.array(F.lit("A"), right).alias("ans"), F.array(q(1, F.lit(None).cast("string")), q(2, F.lit(None).cast("string"))).alias("items"))).alias("groups"))).alias("PARTS")),
    }
    data = F.lit(None).cast("string")
    for k, struct in of.items():
        data = F.when(size % 6 == k, F.to_json(struct)).otherwise(data)
    return pages.select(size.cast("string").alias("package"), data.alias("data"))


@query("""
WITH p AS (SELECT CAST(page_id AS VARCHAR) AS package, coalesce(url, '') AS name, replace(replace(replace(coalesce(url, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS shown, 'Brand ' || page_id % 25 AS brand, page_id % 6 AS k, page_id % 2 = 0 AS even FROM pages)
SELECT package, CASE k WHEN 0 THEN 'READING PASSAGE 1' WHEN 3 THEN 'Chặng 7: ' || brand WHEN 4 THEN 'Phiếu bài tập' ELSE 'I' END AS label,
  CASE k WHEN 0 THEN 'select' WHEN 1 THEN 'mcq' WHEN 2 THEN 'bank' WHEN 3 THEN 'letters' WHEN 4 THEN CASE n WHEN 1 THEN 'mcq' ELSE 'short' END ELSE 'multi' END AS type,
  CAST(n AS VARCHAR) AS no, CASE WHEN k IN (2, 3, 4) THEN shown ELSE name END AS stem,
  CASE k WHEN 0 THEN CASE n WHEN 1 THEN 'i' ELSE 'x' END WHEN 1 THEN CASE WHEN n = 2 THEN 'A' WHEN even THEN 'B' ELSE 'Z' END
    WHEN 2 THEN CASE n WHEN 1 THEN upper(brand) || '|?' ELSE 'none|' || name END WHEN 3 THEN CASE WHEN even THEN 'B' ELSE 'Z' END
    WHEN 4 THEN CASE WHEN n = 2 THEN brand WHEN even THEN 'B' ELSE 'UNMATCHED:' || name END END AS answers,
  CASE k WHEN 1 THEN 0.25 WHEN 5 THEN 0.5 ELSE 1.0 END::DOUBLE AS points
FROM p, (VALUES (1), (2)) AS s(n) WHERE k <> 3 OR n = 1""")
def package_forms(spark, sf_dir):
    """Packages of six forms as rows of one schema: label, type, number, stem, answers, points."""
    rows = forms.items(forms.groups(_packages(spark, sf_dir)))
    return rows.select("package", "label", "type", "no", "stem", F.array_join("answers", "|").alias("answers"), "points")


@query("""
WITH p AS (SELECT CAST(page_id AS VARCHAR) AS package, coalesce(url, '') AS name, replace(replace(replace(coalesce(url, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS shown, 'Brand ' || page_id % 25 AS brand, page_id % 6 AS k, page_id % 2 = 0 AS even FROM pages)
SELECT package, domain, answer, CAST(way AS INTEGER) AS way, CAST(place AS INTEGER) AS place, text, state FROM (
  SELECT package, 'heading' AS domain, 'i' AS answer, 0 AS way, 0 AS place, brand AS text, 'resolved' AS state FROM p WHERE k = 0
  UNION ALL SELECT package, NULL, 'x', NULL, NULL, NULL, 'unresolved' FROM p WHERE k = 0
  UNION ALL SELECT package, 'heading', NULL, NULL, 1, name, 'unused' FROM p WHERE k = 0
  UNION ALL SELECT package, 'heading', NULL, NULL, 2, brand, 'example' FROM p WHERE k = 0
  UNION ALL SELECT package, CASE WHEN even THEN 'option' END, CASE WHEN even THEN 'B' ELSE 'Z' END, CASE WHEN even THEN 0 END, CASE WHEN even THEN 1 END, CASE WHEN even THEN name END, CASE WHEN even THEN 'resolved' ELSE 'unresolved' END FROM p WHERE k = 1
  UNION ALL SELECT package, 'option', NULL, NULL, 0, brand, 'unused' FROM p WHERE k = 1
  UNION ALL SELECT package, 'option', NULL, NULL, 1, name, 'unused' FROM p WHERE k = 1 AND NOT even
  UNION ALL SELECT package, 'option', 'A', 0, 0, brand, 'resolved' FROM p WHERE k = 1
  UNION ALL SELECT package, 'option', NULL, NULL, 1, name, 'unused' FROM p WHERE k = 1
  UNION ALL SELECT package, 'word', upper(brand), 0, 0, brand, 'resolved' FROM p WHERE k = 2
  UNION ALL SELECT package, 'word', name, 1, 1, name, 'resolved' FROM p WHERE k = 2
  UNION ALL SELECT package, CASE WHEN even THEN 'person' END, CASE WHEN even THEN 'B' ELSE 'Z' END, CASE WHEN even THEN 0 END, CASE WHEN even THEN 1 END, CASE WHEN even THEN shown END, CASE WHEN even THEN 'resolved' ELSE 'unresolved' END FROM p WHERE k = 3
  UNION ALL SELECT package, 'person', NULL, NULL, 0, brand, 'unused' FROM p WHERE k = 3
  UNION ALL SELECT package, 'person', NULL, NULL, 1, shown, 'example' FROM p WHERE k = 3 AND NOT even
  UNION ALL SELECT package, CASE WHEN even THEN 'option' END, CASE WHEN even THEN 'B' ELSE 'UNMATCHED:' || name END, CASE WHEN even THEN 0 END, CASE WHEN even THEN 1 END, CASE WHEN even THEN brand END, CASE WHEN even THEN 'resolved' ELSE 'unresolved' END FROM p WHERE k = 4
  UNION ALL SELECT package, 'option', NULL, NULL, 0, 'no', 'unused' FROM p WHERE k = 4
  UNION ALL SELECT package, 'option', NULL, NULL, 1, brand, 'unused' FROM p WHERE k = 4 AND NOT even
  UNION ALL SELECT package, 'option', 'A', 0, 0, brand, 'resolved' FROM p WHERE k = 5
  UNION ALL SELECT package, CASE WHEN even THEN 'option' END, CASE WHEN even THEN 'B' ELSE 'Z' END, CASE WHEN even THEN 0 END, CASE WHEN even THEN 1 END, CASE WHEN even THEN name END, CASE WHEN even THEN 'resolved' ELSE 'unresolved' END FROM p WHERE k = 5
  UNION ALL SELECT package, 'option', NULL, NULL, 1, name, 'unused' FROM p WHERE k = 5 AND NOT even)""")
def answer_domains(spark, sf_dir):
    """Answers of packages looked up in options, words, people and headings; unresolved ones and unused entries are told too."""
    return domains.resolve(forms.groups(_packages(spark, sf_dir))).select("package", "domain", "answer", F.col("by").alias("way"), "place", "text", "state")


# -- ordered lines ------------------------------------------------------------------------------------------------------------
@query("""
WITH l AS (SELECT doc_id, source, n_chars % 5 AS kind, n_chars AS value FROM documents),
e AS (SELECT *, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) OVER w AS banks, sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER w AS parts,
    sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) OVER w AS passages, sum(CASE WHEN kind = 3 THEN 1 ELSE 0 END) OVER w AS questions,
    max(CASE WHEN kind = 4 THEN doc_id END) OVER w AS last_click FROM l WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
b AS (SELECT *, max(CASE WHEN kind = 1 THEN doc_id END) OVER w AS part_at, min(parts) OVER (PARTITION BY source, banks) - CASE WHEN min(parts) OVER (PARTITION BY source, banks) > 0 AND banks = 0 THEN min(parts) OVER (PARTITION BY source, banks) ELSE 0 END AS parts_0,
    min(CASE WHEN kind = 0 THEN doc_id END) OVER (PARTITION BY source, banks) AS bank_at FROM e WINDOW w AS (PARTITION BY source, banks ORDER BY doc_id)),
p AS (SELECT *, max(CASE WHEN kind = 2 THEN doc_id END) OVER w AS passage_at, max(CASE WHEN kind IN (0, 1) THEN passages END) OVER (PARTITION BY source ORDER BY doc_id) AS passages_0,
    questions AS q FROM b WINDOW w AS (PARTITION BY source, banks, parts ORDER BY doc_id))
SELECT p.doc_id, p.bank_at AS bank, CASE WHEN p.bank_at IS NOT NULL THEN p.banks END::BIGINT AS bank_no, p.part_at AS part, CASE WHEN p.part_at IS NOT NULL THEN p.parts - p.parts_0 END::BIGINT AS part_no,
  p.passage_at AS passage, CASE WHEN p.passage_at IS NOT NULL THEN p.passages - coalesce(p.passages_0, 0) END::BIGINT AS passage_no, CASE WHEN p.passage_at IS NOT NULL THEN p.questions - o.questions END::BIGINT AS passage_nth, c.value AS points
FROM p LEFT JOIN l AS c ON c.doc_id = p.last_click LEFT JOIN e AS o ON o.doc_id = p.passage_at""")
def exam_context(spark, sf_dir):
    """Documents of a source as lines: for each the bank, part and passage above it with their numbers, how many questions its
    passage has so far, and the last default points."""
    kind, place = F.col("n_chars") % 5, F.col("doc_id")
    scopes = [context.Scope(name, kind == i, place) for i, name in enumerate(("bank", "part", "passage"))] + [context.Scope("points", kind == 4, F.col("n_chars"), keeps=True)]
    rows = context.running_context(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", scopes, kind == 3)
    return rows.select("doc_id", "bank", "bank_no", "part", "part_no", "passage", "passage_no", "passage_nth", "points")


@query("""
WITH RECURSIVE r AS (SELECT source, doc_id // 100 AS question, doc_id, n_chars % 7 AS n FROM documents),
chain AS (SELECT source, question, min(doc_id) AS doc_id, 1 AS n FROM r WHERE n = 1 GROUP BY source, question
  UNION ALL SELECT c.source, c.question, min(r.doc_id), c.n + 1 FROM chain AS c JOIN r ON r.source = c.source AND r.question = c.question AND r.n = c.n + 1 AND r.doc_id > c.doc_id GROUP BY c.source, c.question, c.n)
SELECT r.source, r.doc_id, r.n, c.doc_id IS NOT NULL AS accepted FROM r LEFT JOIN chain AS c ON c.source = r.source AND c.question = r.question AND c.doc_id = r.doc_id AND c.n = r.n""")
def label_chains(spark, sf_dir):
    """Documents of a source, a hundred ids a question, as labelled lines: the first 1, the next 2 below it, and so on."""
    rows = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 100).alias("question"), "doc_id", (F.col("n_chars") % 7).alias("n"))
    return successors.accepted(rows, ["source", "question"], "doc_id", "n").drop("question")


# -- scripts ------------------------------------------------------------------------------------------------------------------
@query(r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages)
SELECT page_id, name, source FROM (
  SELECT page_id, 'p' || page_id AS name, 'function p' || page_id || '(x) { if (x) { return "}' || url || '\""; } /* { */ }' AS source FROM p
  UNION ALL SELECT page_id, 'outer', 'function outer () { function inner(){ return `{` } }' FROM p UNION ALL SELECT page_id, 'inner', 'function inner(){ return `{` }' FROM p)""")
def page_functions(spark, sf_dir):
    """Functions of pages' scripts, cut out by their braces; those within strings and comments are none."""
    own = F.concat(F.lit("<script>// function no() {\nfunction p"), F.col("page_id").cast("string"), F.lit('(x) { if (x) { return "}'), F.coalesce("url", F.lit("")), F.lit('\\""; } /* { */ }\nvar s = \'function no2() {}\'; function outer () { function inner(){ return `{` } }</script>'))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), own).alias("html"))
    return scripts.functions(scripts.inline_scripts(pages, ["page_id"], "html"), ["page_id", "script"], "body").select("page_id", "name", "source")


# -- formulas and pictures ------------------------------------------------------------------------------------------------------
_JS_SPACE = r"[\x09-\x0d \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@query(rf"""
WITH RECURSIVE t AS (SELECT doc_id, text || ' Giá 5$ và 10$; $x_' || doc_id || '$, \(a' || lang || '\), \[c\], \$3 $$y$$ $ z$' AS s FROM documents WHERE text IS NOT NULL),
step AS (
  SELECT doc_id, CAST(strpos(replace(s, '\', '$'), '$') - 1 AS BIGINT) AS place, substr(s, strpos(replace(s, '\', '$'), '$')) AS rest, CAST(NULL AS BIGINT) AS start, CAST(NULL AS VARCHAR) AS tex, false AS display, 0 AS wide FROM t
  UNION ALL
  SELECT doc_id, place + len(skipped) + used AS place, substr(rest, used + len(skipped) + 1) AS rest, CASE WHEN tex IS NOT NULL THEN place END AS start, tex, display, wide FROM (
    SELECT *, regexp_extract(substr(rest, used + 1), '^[^$\\]*') AS skipped FROM (
      SELECT doc_id, place, rest, display, wide, CASE WHEN good THEN body END AS tex, CASE WHEN good THEN len(body) + 2 * wide WHEN first = '\' THEN 2 ELSE wide END AS used FROM (
        SELECT *, CASE WHEN body IS NULL OR body = '' OR regexp_full_match(body, '{_JS_SPACE}*') THEN false WHEN first <> '$' OR wide = 2 THEN true
            ELSE NOT regexp_matches(left(body, 1), '{_JS_SPACE}') AND NOT regexp_matches(right(body, 1), '{_JS_SPACE}') AND NOT regexp_matches(substr(rest, len(body) + 3, 1), '[0-9]') END AS good FROM (
          SELECT doc_id, place, rest, left(rest, 1) AS first, left(rest, 2) IN ('$$', '\[') AS display, CASE WHEN left(rest, 2) = '$$' OR left(rest, 1) = '\' THEN 2 ELSE 1 END AS wide,
            CASE WHEN left(rest, 2) = '\(' AND strpos(substr(rest, 3), '\)') > 0 THEN substr(rest, 3, strpos(substr(rest, 3), '\)') - 1) WHEN left(rest, 2) = '\[' AND strpos(substr(rest, 3), '\]') > 0 THEN substr(rest, 3, strpos(substr(rest, 3), '\]') - 1)
              WHEN left(rest, 2) = '$$' AND regexp_matches(rest, '^\$\$(?s:(?:\$?(?:[^$\\]|\\.))*)\$\$') THEN regexp_extract(rest, '^\$\$((?s:(?:\$?(?:[^$\\]|\\.))*))\$\$', 1)
              WHEN left(rest, 1) = '$' AND left(rest, 2) <> '$$' AND regexp_matches(rest, '^\$(?s:(?:[^$\\]|\\.)*)\$') THEN regexp_extract(rest, '^\$((?s:(?:[^$\\]|\\.)*))\$', 1) END AS body
          FROM step WHERE rest <> ''))))),
found AS (SELECT doc_id, start, start + len(tex) + 2 * wide AS stop, tex, display FROM step WHERE tex IS NOT NULL)
SELECT doc_id, start, stop, tex, display FROM found""")
def document_formulas(spark, sf_dir):
    """Formulas of all documents, each with some of every sort and amounts of money after its own text."""
    more = [F.lit(" Giá 5$ và 10$; $x_"), F.col("doc_id").cast("string"), F.lit("$, \\(a"), F.col("lang"), F.lit("\\), \\[c\\], \\$3 $$y$$ $ z$")]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", *more).alias("text"))
    return formulas.formulas(docs, ["doc_id"], "text").select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "tex", "display")


@query("""
WITH p AS (SELECT page_id, page_id % 10 AS bank, page_id % 8 AS k, coalesce(url, '') AS url FROM pages),
h AS (SELECT *, lpad(printf('%x', list_reduce(list_prepend(2166136261, list_transform(string_split(url, ''), lambda c: CAST(CASE WHEN c = '' THEN 0 ELSE ord(c) END AS BIGINT))), lambda a, b: xor(a, b) * 16777619 % 4294967296)), 8, '0') AS fnv FROM p)
SELECT page_id, CASE k WHEN 4 THEN 'images/img_' || fnv || '.png' WHEN 5 THEN 'https://x.org/y.png' WHEN 6 THEN NULL ELSE 'images/anh_' || page_id || '.png' END AS out,
  CASE k WHEN 0 THEN 'exact' WHEN 1 THEN 'decoded' WHEN 2 THEN 'any_case' WHEN 3 THEN 'file_name' WHEN 4 THEN 'embedded' WHEN 7 THEN 'given' END AS way,
  CASE k WHEN 5 THEN 'remote' WHEN 6 THEN 'scheme' END AS code
FROM h""")
def page_pictures(spark, sf_dir):
    """Pictures that pages refer to, in every way; those within data: addresses are cut out and named by their contents."""
    n, bank, k = F.col("page_id"), F.col("page_id") % 10, F.col("page_id") % 8
    pages, id_ = table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    said = [F.concat(F.lit("Media/Anh "), id_, F.lit(".PNG")), F.concat(F.lit("./Media/Anh%20"), id_, F.lit(".PNG?x=1#y")), F.concat(F.lit("media\\anh "), id_, F.lit(".png")), F.concat(F.lit("other/ANH%20"), id_, F.lit(".png")), F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode(F.coalesce("url", F.lit("")), "UTF-8"))), F.lit("https://x.org/y.png"), F.lit("ftp://x.org"), F.concat(F.lit("images/anh_"), id_, F.lit(".png"))]
    refs = pages.select(bank.alias("bank"), n.alias("n"), F.get(F.array(*said), k.cast("int")).alias("src"))
    paths = pages.select(bank.alias("bank"), said[0].alias("key"), F.concat(F.lit("anh_"), id_, F.lit(".png")).alias("name"), n.alias("ord"))
    return pictures.resolve_pictures(refs, paths, paths.select("bank", "name")).select(F.col("n").alias("page_id"), "out", "way", "code")


# -- items ------------------------------------------------------------------------------------------------------------------------
_KINDS = ("mc", "ma", "short", "num", "blanks", "dropdowns", "matching", "essay", "text")


def _document_items(spark, sf_dir):
    """A question for each document, of one of nine types by its number, as the XML of an item."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    a, b = F.coalesce("source", F.lit("?")), F.concat(F.lit("<b>"), F.coalesce("lang", F.lit("und")), F.lit("</b>"))
    kind = F.get(F.array(*map(F.lit, _KINDS)), (i % len(_KINDS)).cast("int"))
    choice = lambda html, right: F.struct(F.lit("A").alias("id"), html.alias("html"), F.lit(right).alias("correct"))
    right_first = F.array(choice(a, True), choice(b, False), choice(F.lit("2 < 3"), True))
    number = lambda x: F.lit(x).cast("double")
    columns = {
        "ident": F.concat(F.lit("d"), i.cast("string")), "pos": (i % 100 + 1).cast("int"), "type": kind, "points": (i % 4 + 1) / 4, "title": F.lit("T"), "stem": a, "feedback": F.when(i % 2 == 0, b),
        "choices": F.when(kind == "ma", right_first).otherwise(F.array(choice(a, False), choice(b, True))), "answers": F.array(a, F.lit("é & è")),
        "numeric": F.struct(F.col("n_chars").cast("double").alias("exact"), number(0.5).alias("margin"), number(None).alias("min"), number(None).alias("max")),
        "blanks": F.array(F.struct(F.lit("b1").alias("id"), F.array(a, F.lit("x")).alias("accepts")), *[F.struct(F.lit(k).alias("id"), F.array(F.lit("y")).alias("accepts")) for k in ("b2", "b3")]),
        "dropdowns": F.array(F.struct(F.lit("b1").alias("id"), F.array(F.lit("x"), a).alias("options"), F.lit(1).alias("correct"))),
        "pairs": F.array(F.struct(F.lit("l1").alias("left"), a.alias("right")), F.struct(b.alias("left"), F.lit("zz").alias("right"))), "distractors": F.array(F.lit("0")),
    }
    return cut(docs.select("doc_id", *[v.alias(k) for k, v in columns.items()]).select("doc_id", items.item_of().alias("xml")))


@query("""
WITH d AS (SELECT *, coalesce(source, '?') AS a, '<b>' || coalesce(lang, 'und') || '</b>' AS b, doc_id % 9 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'multiple_choice_question' WHEN 1 THEN 'multiple_answers_question' WHEN 2 THEN 'short_answer_question' WHEN 3 THEN 'numerical_question' WHEN 4 THEN 'fill_in_multiple_blanks_question'
    WHEN 5 THEN 'multiple_dropdowns_question' WHEN 6 THEN 'matching_question' WHEN 7 THEN 'essay_question' ELSE 'text_only_question' END AS type,
  CASE WHEN k = 8 THEN 0 ELSE (doc_id % 4 + 1) / 4 END::DOUBLE AS points,
  CASE k WHEN 0 THEN 'response1=' || b WHEN 1 THEN 'response1=' || a || '|response1=2 < 3' WHEN 2 THEN 'response1=' || a || '|response1=é & è' WHEN 3 THEN 'response1=' || n_chars || '|response1=' || (n_chars - 1) || '.5..' || n_chars || '.5'
    WHEN 4 THEN 'response_b1=' || a || '@33.33|response_b2=y@33.33|response_b3=y@33.33' WHEN 5 THEN 'response_b1=' || a || '@100.0'
    WHEN 6 THEN 'response_' || (doc_id % 100 * 100 + 101) || '=' || a || '@50.0|response_' || (doc_id % 100 * 100 + 102) || '=zz@50.0' ELSE '' END AS accepted FROM d""")
def items_read_back(spark, sf_dir):
    """Items of all types written with their response processing, and what each accepts by that alone."""
    read = items.accepted(items.parsed(_document_items(spark, sf_dir)))
    shown = F.transform("accepted", lambda x: F.concat(x["response"], F.lit("="), x["value"], F.coalesce(F.concat(F.lit("@"), x["share"].cast("string")), F.lit(""))))
    return read.select("doc_id", "type", "points", F.coalesce(F.array_join(shown, "|"), F.lit("")).alias("accepted"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 9 AS k, doc_id % 7 AS fault, doc_id % 100 * 100 + 101 AS label FROM documents)
SELECT doc_id, level, code FROM (
  SELECT doc_id, 'error' AS level, 'not_well_formed' AS code FROM d WHERE fault = 1
  UNION ALL SELECT doc_id, 'warn', 'no_title' FROM d WHERE fault = 2 UNION ALL SELECT doc_id, 'error', 'unknown_type' FROM d WHERE fault = 3
  UNION ALL SELECT doc_id, 'error', 'earns_nothing' FROM d WHERE fault = 4 AND k < 7 OR fault = 3 AND k >= 7 UNION ALL SELECT doc_id, 'error', 'shares' FROM d WHERE fault = 5 AND k IN (4, 6)
  UNION ALL SELECT doc_id, 'error', 'points_form' FROM d WHERE fault = 6)""")
def item_faults(spark, sf_dir):
    """What is wrong with items that were spoilt one way in seven: cut off, untitled, of an odd type, unpaid, short of a share, with odd points.

    Of an odd type, an essay or a text is told to earn nothing as well.
    """
    xml, fault = F.col("xml"), F.col("doc_id") % 7
    spoilt = (
        F.when(fault == 1, F.substring(xml, F.lit(1), F.char_length(xml) - 3)).when(fault == 2, F.replace(xml, F.lit('title="T"'), F.lit('title=" "'))).when(fault == 3, F.regexp_replace(xml, "_question<", "_riddle<"))
        .when(fault == 4, F.replace(xml, F.lit("setvar"), F.lit("novar"))).when(fault == 5, F.regexp_replace(xml, ">(33.33|50.00)</setvar>", ">20.00</setvar>")).when(fault == 6, F.regexp_replace(xml, "(points_possible</fieldlabel><fieldentry>)[^<]*", "$1,5")).otherwise(xml)
    )
    return items.item_issues(_document_items(spark, sf_dir).select("doc_id", spoilt.alias("xml")), ["doc_id"]).select("doc_id", "level", "code")


# -- boxes that are checked ---------------------------------------------------------------------------------------------------------
@query("""
WITH c(k, code, level) AS (VALUES (1, 'blanks_none', 'error'), (2, 'blanks_id', 'error'), (3, 'blanks_id_twice', 'error'), (4, 'blanks_not_in_stem', 'error'), (5, 'blanks_often_in_stem', 'error'), (6, 'blanks_in_stimulus', 'warn'),
  (7, 'blank_without_answer', 'error'), (8, 'blank_answer_html', 'error'), (9, 'dropdown_few', 'error'), (10, 'dropdown_undecided', 'error'), (11, 'dropdown_option_empty', 'error'), (11, 'dropdown_option_twice', 'warn'), (12, 'dropdowns_none', 'error'), (13, 'dropdowns_not_in_stem', 'error'))
SELECT doc_id, level, code FROM documents JOIN c ON c.k = doc_id % 14""")
def box_faults(spark, sf_dir):
    """Questions with blanks or lists to choose from, one fault in each shape: what the rules tell of them."""
    k, source = F.col("doc_id") % 14, F.coalesce("source", F.lit("?"))
    blank = lambda name, *accepts: F.struct(F.lit(name).alias("id"), F.array(*[a if not isinstance(a, str) else F.lit(a) for a in accepts]).alias("accepts"))
    list_ = lambda correct, *options: F.struct(F.lit("b1").alias("id"), F.array(*map(F.lit, options)).alias("options"), F.lit(correct).alias("correct"))
    first, second = blank("b1", source), blank("b2", "y")
    given = {
        "bank": F.lit("b"), "pos": F.lit(1), "id": F.concat(F.lit("d"), F.col("doc_id").cast("string")), "points": F.lit(1.0), "type": F.when(k < 9, "blanks").otherwise("dropdowns"),
        "stem": F.when(k == 4, "x [b2]").when(k == 5, "[b1] [b1] [b2]").when(k == 13, "nothing").otherwise("[b1] [b2]"), "stimulus": F.when(k == 6, "in [b1]").otherwise(""),
        "blanks": F.when(k == 1, F.array().cast("array<struct<id:string,accepts:array<string>>>")).when(k == 2, F.array(blank("B 1", "x"), second)).when(k == 3, F.array(first, blank("b1", "y"))).when(k == 7, F.array(first, blank("b2", " "))).when(k == 8, F.array(first, blank("b2", "<b>x</b>"))).otherwise(F.array(first, second)),
        "dropdowns": F.when(k == 9, F.array(list_(0, "only"))).when(k == 10, F.array(list_(5, "x", "y"))).when(k == 11, F.array(list_(0, "x", "X ", ""))).when(k == 12, F.array().cast("array<struct<id:string,options:array<string>,correct:int>>")).otherwise(F.array(list_(1, "x", "y"))),
    }
    kinds = spark.createDataFrame([], validation.QUESTION).schema
    rows = table(spark, sf_dir, "documents").select("doc_id", *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])
    return validation.issues(rows).select(F.substring("id", 2, 30).cast("long").alias("doc_id"), "level", "code")
