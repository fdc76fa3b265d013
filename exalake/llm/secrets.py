"""Secrets in texts, in DataFrame functions alone: fixed patterns, and two character Markov models compared.

One model is that of random strings, made by hashing numbers; the other that of ordinary identifiers, from every distinct word of
the corpus as it stands and joined as identifiers are.  Both count which character follows which.  A run of characters that
no pattern found is a secret if the log-likelihood ratio of the two models over the whole run passes a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exalake.llm.fingerprints import let
from exalake.llm.text_arrays import materialise

#: What the models tell apart; an index of a pair of characters is first * SIZE + second.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SIZE = len(ALPHABET)
RUN = r"[A-Za-z0-9+/_-]"
#: The shortest run that is scored, and the shortest word that is a sample of ordinary ones.
LEAST_RUN, LEAST_WORD = 16, 4
#: Random strings that the one model is counted from; the other's samples grow with the corpus.
RANDOM_STRINGS, RANDOM_CHARS = 20_000, 40
#: Lines of each symbol among the ordinary samples.
LINES = 50
#: Added to each count.
SMOOTHING = 0.5
#: Thousandths of a natural logarithm for each step of a run: how much likelier it must be as a random string, for how rare those are.
THRESHOLD = 1_500
#: A long run is scored in pieces of so many characters; the steps from one piece to the next don't count.
PIECE = 256


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


#: Fixed patterns of the base kinds in the order of ties, and the group that must be long enough, with its length.
PATTERNS = {
    "assign": (f"({'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token')))}|{either_case('api')}_?{either_case('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}
KINDS = (*PATTERNS, "random")
#: A text without such a run needs no closer look.
MAY_HOLD = {"assign": PATTERNS["assign"][0], "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
#: Elements of a block of running sums.
BLOCK = 64


# -- places of matches ----------------------------------------------------------------------------------------------------
def _sums_before(xs: Column) -> Column:
    return F.transform(xs, lambda x, i: F.aggregate(F.slice(xs, F.lit(1), i), F.lit(0), lambda a, b: a + b))


def running(xs: Column) -> Column:
    """The sum of what stands before each element, block by block, so that long arrays take time in proportion."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda block: F.aggregate(block, F.lit(0), lambda a, b: a + b)
    within = lambda block, base: F.transform(_sums_before(block), lambda s: s + base)
    return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(let(blocks, lambda bs: let(F.transform(bs, total), lambda ts: F.flatten(F.zip_with(bs, _sums_before(ts), within)))))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, stop, value) of the leftmost non-overlapping matches, in characters from 0; value is what the group matched."""
    before = F.transform(F.split(text, pattern), lambda p: F.char_length(p))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
    sized = F.zip_with(before, found, lambda n, f: F.struct(n.alias("gap"), F.char_length(f["m"]).alias("size"), f["v"].alias("value")))
    sized = F.filter(sized, lambda s: s["size"].isNotNull())  # what follows the last match

    def places(rows: Column) -> Column:
        step = F.transform(rows, lambda s: s["gap"] + s["size"])
        one = lambda s, at: F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + s["size"]).alias("stop"), s["value"].alias("value"))
        return let(step, lambda steps: F.zip_with(rows, running(steps), one))

    return let(sized, places)


def base_spans(text: Column) -> Column:
    """(kind, start, stop) of the fixed patterns; kind is its place in KINDS.  Matches that are too short are dropped."""

    def spans(i: int, kind: str) -> Column:
        pattern, group, least = PATTERNS[kind]
        # a match of a single class is a whole run, so the short ones can be left out of the search
        pattern = {"access": "AKIA[A-Z0-9]{12,}", "hex": "(?<![0-9a-f])[0-9a-f]{32,}"}.get(kind, pattern)
        rows = F.filter(matches(text, pattern, group), lambda m: F.char_length(m["value"]) >= least)
        found = F.transform(rows, lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))
        return F.when(text.rlike(MAY_HOLD[kind]), found).otherwise(F.array().cast("array<struct<kind:int,start:int,stop:int>>"))

    return F.concat(*[spans(i, kind) for i, kind in enumerate(PATTERNS)])


# -- models ---------------------------------------------------------------------------------------------------------------
def random_samples(spark: SparkSession, rows: int = RANDOM_STRINGS) -> DataFrame:
    """(text, label 1): hexadecimal, base64 (of both alphabets), letters and digits, also all capitals or none, from hashed numbers."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    forms = [digest, b64, F.translate(b64, "+/", "-_"), F.translate(b64, "+/=", ""), F.upper(F.translate(b64, "+/=", "")), F.lower(F.translate(b64, "+/=", ""))]
    text = F.get(F.array(*forms), (F.col("id") % len(forms)).cast("int"))
    return spark.range(rows).select(F.rtrim(F.substring(text, 1, RANDOM_CHARS), F.lit("=")).alias("text"), F.lit(1).alias("label"))


def ordinary_samples(docs: DataFrame, text_col: str) -> DataFrame:
    """(text, label 0): each distinct word of all texts between underscores, what stands at the seam of two such words in capitals
    (as in camelCase), and lines drawn with symbols.

    Runs that may be secrets themselves (LEAST_RUN characters or more with both digits and letters) are not samples.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(text_col, F.lit(f"{RUN}{{{LEAST_WORD},}}"), F.lit(0))).alias("w"))
    word = F.col("w")
    unsure = (F.char_length(word) >= LEAST_RUN) & word.rlike("[0-9]") & word.rlike("[A-Za-z]")
    words = runs.where(~unsure).groupBy("w").agg(F.count("*").alias("n"))
    seam = F.concat(F.right(word, F.lit(1)), F.upper(F.left(word, F.lit(1))))
    texts = words.select(F.explode(F.array(F.concat(F.lit("_"), word, F.lit("_")), seam)).alias("text"))
    lines = docs.sparkSession.range(LINES).select(F.explode(F.array(*[F.lit(c * RANDOM_CHARS) for c in "+/_-"])).alias("text"))
    return texts.union(lines).select("text", F.lit(0).alias("label"))


def _place(char: Column) -> Column:
    """The place of a character in ALPHABET, from 0."""
    return F.get(_constant([ALPHABET.find(chr(i)) for i in range(128)]), F.ascii(char))


def train(samples: DataFrame) -> DataFrame:
    """(id, weight) for each pair of characters: by how many thousandths the second is likelier after the first in a random string.

    samples: (text, label) with label 1 for random strings.  Pairs of ordinary ones count in capitals too, and with any of the
    symbols that join words.  Characters outside ALPHABET and null texts don't count.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("text") - 1), lambda i: F.substring(F.col("text"), i, F.lit(2)))
    seen = samples.where(F.char_length("text") >= 2).select("label", F.explode(pairs).alias("pair")).where(F.col("pair").rlike(f"^{RUN}{{2}}$")).groupBy("label", "pair").agg(F.count("*").alias("n"))
    forms = F.array_distinct(F.array(F.col("pair"), F.upper("pair"), F.translate("pair", "_", "-"), F.translate("pair", "_", "/")))
    seen = seen.select("label", F.explode(F.when(F.col("label") == 0, forms).otherwise(F.array("pair"))).alias("pair"), "n")
    first, second = _place(F.substring("pair", 1, 1)), _place(F.substring("pair", 2, 1))
    seen = seen.groupBy((first * SIZE + second).alias("id")).agg(*[F.coalesce(F.sum(F.when(F.col("label") == v, F.col("n"))), F.lit(0)).alias(f"n{v}") for v in (0, 1)])
    # SIZE * SIZE rows from here on
    every = samples.sparkSession.range(SIZE * SIZE).join(seen, "id", "left").na.fill(0, ["n0", "n1"]).withColumn("first", F.floor(F.col("id") / SIZE))
    total = every.groupBy("first").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    chance = lambda v: (F.col(f"n{v}") + SMOOTHING) / (F.col(f"t{v}") + SMOOTHING * SIZE)
    return every.join(total, "first").select("id", F.round(F.log(chance(1) / chance(0)) * 1000).cast("int").alias("weight"))


def _constant(values: list[int]) -> Column:
    """An array of integers as one literal (Spark folds it)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def weights(model: DataFrame) -> Column:
    """The model's SIZE * SIZE weights as one array by id, for use in expressions over any table."""
    return _constant([r.weight for r in sorted(model.collect())])


def ratio(run: Column, model: Column) -> Column:
    """The log-likelihood ratio of a run of ALPHABET characters in thousandths."""

    def piece(chars: Column) -> Column:
        steps = F.zip_with(chars, F.slice(chars, 2, PIECE), lambda a, b: F.get(model, a * SIZE + b))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, w: total + F.coalesce(w, F.lit(0)))

    places = lambda p: F.transform(F.split(p, ""), _place)
    each = F.transform(F.regexp_extract_all(run, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), lambda p: let(places(p), piece))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)


def _touches(spans: Column, x: Column) -> Column:
    """Whether one of spans (apart from each other, in order) overlaps x: the last that starts before x ends is looked at."""
    heads = F.filter(spans, lambda s, i: i % BLOCK == 0)
    last = F.size(F.filter(heads, lambda s: s["start"] < x["stop"]))
    block = F.slice(spans, F.greatest(last - 1, F.lit(0)) * BLOCK + 1, F.lit(BLOCK))
    return F.exists(block, lambda s: (s["start"] < x["stop"]) & (s["stop"] > x["start"]))


def secrets(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, base and spans, arrays of (kind, start, stop) in order of start, then kind as in KINDS.

    Places are in characters, stop exclusive; kind is the place in KINDS.  spans are those of base and the runs of LEAST_RUN
    characters or more that the models tell to be random (`random`) and that overlap none of base.  A null or empty text has
    none.  Repeated rows and ids get a result each; a null id stays; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    run = f"(?<!{RUN}){RUN}{{{LEAST_RUN},}}"
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    table = weights(model)
    long_runs = F.when(F.col("text").rlike(f"{RUN}{{{LEAST_RUN}}}"), matches(F.col("text"), run))
    likely = F.filter(long_runs, lambda m: ratio(m["value"], table) >= (m["stop"] - m["start"] - 1) * threshold)
    found = rows.select("id", base_spans(F.col("text")).alias("base"), likely.alias("likely"))
    kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    found = found.withColumns({f"k{k}": kind(k) for k in range(len(PATTERNS))})
    free = F.filter("likely", lambda m: ~(_touches(F.col("k0"), m) | _touches(F.col("k1"), m) | _touches(F.col("k2"), m)))
    added = F.transform(free, lambda m: F.struct(F.lit(KINDS.index("random")).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))
    added = F.coalesce(added, F.array().cast("array<struct<kind:int,start:int,stop:int>>"))
    return found.select(F.col("id").alias(id_col), _ordered(F.col("base")).alias("base"), _ordered(F.concat("base", added)).alias("spans"))


def _ordered(spans: Column) -> Column:
    """Spans in order of start, then kind, with the kind's name."""
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"])))
    return F.transform(keyed, lambda s: F.struct(F.get(F.lit(list(KINDS)), s["kind"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def trained(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The model of all texts of docs, written (it has SIZE * SIZE rows)."""
    return materialise(train(ordinary_samples(docs, text_col).unionByName(random_samples(docs.sparkSession))).coalesce(1), "models")


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans as kind:start:stop joined by commas."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(count, PATTERNS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: The same digest columns as DuckDB SQL over `documents`, the models counted there too.
SECRETS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
forms AS (SELECT i, h, base64(unhex(h)) AS b FROM (SELECT i, sha256('sample ' || i) AS h FROM range({RANDOM_STRINGS}) AS r(i))),
words AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '{RUN}{{{LEAST_WORD},}}')) AS w FROM docs)
  WHERE NOT (len(w) >= {LEAST_RUN} AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]'))),
samples AS (
  SELECT 1 AS label, rtrim(substr(CASE i % 6 WHEN 0 THEN h WHEN 1 THEN b WHEN 2 THEN replace(replace(b, '+', '-'), '/', '_')
    WHEN 3 THEN regexp_replace(b, '[+/=]', '', 'g') WHEN 4 THEN upper(regexp_replace(b, '[+/=]', '', 'g')) ELSE lower(regexp_replace(b, '[+/=]', '', 'g')) END, 1, {RANDOM_CHARS}), '=') AS text FROM forms
  UNION ALL SELECT 0, '_' || w || '_' FROM words UNION ALL SELECT 0, right(w, 1) || upper(left(w, 1)) FROM words
  UNION ALL SELECT 0, repeat(c, {RANDOM_CHARS}) FROM range({LINES}), (VALUES ('+'), ('/'), ('_'), ('-')) AS s(c)),
pairs AS (SELECT label, pair, count(*) AS n FROM (SELECT label, substr(text, CAST(i AS INTEGER), 2) AS pair FROM (SELECT label, text, unnest(range(1, len(text))) AS i FROM samples))
  WHERE regexp_full_match(pair, '{RUN}{{2}}') GROUP BY ALL),
spread AS (SELECT label, unnest(CASE WHEN label = 0 THEN list_distinct([pair, upper(pair), replace(pair, '_', '-'), replace(pair, '_', '/')]) ELSE [pair] END) AS pair, n FROM pairs),
letters AS (SELECT substr('{ALPHABET}', CAST(i AS INTEGER), 1) AS c FROM range(1, {SIZE + 1}) AS r(i)),
counts AS (SELECT a.c AS a, a.c || b.c AS pair, coalesce(sum(n) FILTER (label = 0), 0) AS n0, coalesce(sum(n) FILTER (label = 1), 0) AS n1
  FROM letters AS a CROSS JOIN letters AS b LEFT JOIN spread ON spread.pair = a.c || b.c GROUP BY ALL),
model AS (SELECT pair, CAST(round(ln((n1 + {SMOOTHING}) / (sum(n1) OVER (PARTITION BY a) + {SMOOTHING * SIZE}) / ((n0 + {SMOOTHING}) / (sum(n0) OVER (PARTITION BY a) + {SMOOTHING * SIZE}))) * 1000) AS BIGINT) AS weight FROM counts),
kinds(k, kind, pattern, grp, least) AS (VALUES {", ".join(f"({i}, '{k}', '{p.replace(chr(39), chr(39) * 2)}', {g}, {n})" for i, (k, (p, g, n)) in enumerate((*PATTERNS.items(), ("random", (f"{RUN}{{{LEAST_RUN},}}", 0, LEAST_RUN)))))}),
cut AS ({" UNION ALL ".join(f"SELECT rid, k, kind, least, string_split_regex(text, '{p.replace(chr(39), chr(39) * 2)}') AS gaps, regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 0) AS found, regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', {g}) AS vals FROM docs, kinds WHERE k = {i}" for i, (p, g) in enumerate((*((p, g) for p, g, _ in PATTERNS.values()), (f"{RUN}{{{LEAST_RUN},}}", 0))))}),
each AS (SELECT rid, k, kind, least, i, len(gaps[i]) AS gap, len(found[i]) AS size, vals[i] AS val FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM cut)),
placed AS (SELECT *, stop - size AS start FROM (SELECT rid, k, kind, size, val, least, sum(gap + size) OVER (PARTITION BY rid, k ORDER BY i) AS stop FROM each)),
base AS (SELECT * FROM placed WHERE k < {len(PATTERNS)} AND len(val) >= least),
runs AS (SELECT DISTINCT val FROM placed WHERE k = {len(PATTERNS)}),
scores AS (SELECT val, sum(weight) AS score FROM (SELECT val, unnest(range(1, len(val))) AS i FROM runs) JOIN model ON pair = substr(val, CAST(i AS INTEGER), 2) WHERE i % {PIECE} <> 0 GROUP BY val),
added AS (SELECT p.* FROM placed AS p JOIN scores USING (val) WHERE k = {len(PATTERNS)} AND score >= (len(val) - 1) * {THRESHOLD}
  AND NOT EXISTS (SELECT 1 FROM base AS b WHERE b.rid = p.rid AND b.start < p.stop AND p.start < b.stop)),
shown AS (SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM (FROM base UNION ALL FROM added) GROUP BY rid),
digests AS (SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans, {", ".join(f"count(*) FILTER (k = {i}) AS n_{k}" for i, k in enumerate(PATTERNS))} FROM base GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in PATTERNS)}, sha256(coalesce(d.spans, '')) AS base_sha256, coalesce(s.spans, '') AS spans
FROM docs LEFT JOIN digests AS d USING (rid) LEFT JOIN shown AS s USING (rid)
"""
