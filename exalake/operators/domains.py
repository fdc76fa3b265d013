"""Answers looked up in what may be chosen: options, word banks, people, headings; from both sides, in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exalake.sources.forms import items, letter, same_word
from exalake.sources.shared import cut

CHOICES, SHARED = ("mcq", "mistake"), {"letters": ("person", "people"), "select": ("heading", "headings")}
GROUP = ["package", "form", "part", "grp"]
ENTRY = "array<struct<domain:string,scope:int,key:string,place:int,text:string,example:boolean>>"
TRY = "array<struct<domain:string,scope:int,key:string,ask:int,by:int,answer:string>>"


def _entry(domain: str, scope: Column, key: Column, place: Column, text: Column, example: Column | None = None) -> Column:
    return F.struct(F.lit(domain).alias("domain"), scope.cast("int").alias("scope"), key.alias("key"), place.cast("int").alias("place"), text.alias("text"), (F.lit(False) if example is None else F.coalesce(example, F.lit(False))).alias("example"))


def _try(domain: str, scope: Column, key: Column, answer: Column, by: Column | int = 0, ask: Column | int = 0) -> Column:
    number = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(F.lit(domain).alias("domain"), scope.cast("int").alias("scope"), key.alias("key"), number(ask).alias("ask"), number(by).alias("by"), answer.alias("answer"))


def _pick(kind: dict, otherwise: str) -> Column:
    out = F.lit(None).cast(otherwise)
    for names, value in kind.items():
        out = F.when(F.col("type").isin(*names), value.cast(otherwise)).otherwise(out)
    return out


def entries(read: DataFrame, rows: DataFrame) -> DataFrame:
    """(group, domain, scope, key, place, text, example): what answers of a group (scope -1) or of an item may name, keys once each.

    An option is in two domains: by its key, and by the letter of its place.
    """
    group = F.lit(-1)
    given = F.coalesce("example", F.array().cast("array<string>"))
    words = F.transform("bank", lambda w, i: _entry("word", group, same_word(w), i, w, F.array_contains(F.transform(given, same_word), same_word(w))))
    named = {(kind,): _named(domain, column, given) for kind, (domain, column) in SHARED.items()}
    shared = {("multi",): F.transform("options", lambda o, i: _entry("option", group, o["k"], i, o["t"])), ("bank",): words} | named
    own = F.coalesce("own_options", "options")
    both = F.concat(F.transform(own, lambda o, i: _entry("option", F.col("item"), o["k"], i, o["t"])), F.transform(own, lambda o, i: _entry("place", F.col("item"), letter(i), i, o["t"])))
    every = read.select(*GROUP, F.explode(_pick(shared, ENTRY)).alias("e")).unionByName(rows.select(*GROUP, F.explode(_pick({CHOICES: both}, ENTRY)).alias("e")))
    first = every.select(*GROUP, "e.*").where("key IS NOT NULL").groupBy(*GROUP, "domain", "scope", "key")
    return first.agg(F.min(F.struct("place", "text", "example")).alias("entry"))


def _named(domain: str, column: str, given: Column) -> Column:
    example = lambda k: F.array_contains(given, k) | (k == F.col("example_key"))
    return F.transform(column, lambda x, i: _entry(domain, F.lit(-1), x["k"], i, x["t"], example(x["k"])))


def tries(read: DataFrame, rows: DataFrame) -> DataFrame:
    """(group, item, no, domain, scope, key, ask, by, answer): where each answer is looked for, in order of `by`."""
    group, one = F.lit(-1), F.get("answers", F.lit(0))
    choice = F.array(_try("option", F.col("item"), one, one), _try("place", F.col("item"), F.when(one.rlike("^[A-Z]$"), one), one, 1))
    words = F.transform("answers", lambda a, i: _try("word", group, same_word(a), a, i))
    named = {(kind,): F.array(_try(domain, group, one, one)) for kind, (domain, _) in SHARED.items()}
    of_items = rows.select(*GROUP, "item", "no", F.explode(_pick({CHOICES: choice, ("bank",): words} | named, TRY)).alias("t"))
    chosen = F.transform("chosen", lambda a, i: _try("option", group, a, a, 0, i))
    of_groups = read.select(*GROUP, F.lit(-1).alias("item"), F.lit(None).cast("string").alias("no"), F.explode(_pick({("multi",): chosen}, TRY)).alias("t"))
    return of_items.unionByName(of_groups).select(*GROUP, "item", "no", "t.*")


def resolve(read: DataFrame) -> DataFrame:
    """groups of forms to one row for each answer and each entry that no answer names:

    package, form, part, grp, item (-1 of the group), no, ask, domain, answer, by, place (from 0), text, state.  state is resolved
    (found in `domain`, by the how many-th way), unresolved, unused, or example: an unused entry that the worked example
    names.  Of several ways the first that is found counts, but each of them uses its entry.  A missing answer is unresolved;
    equal entries are one, that of the least place.  Types without a closed set of answers have no rows.
    """
    read = cut(read)  # four sides are made of it
    rows = items(read)
    asked, known = tries(read, rows), entries(read, rows)
    on = [*GROUP, "domain", "scope", "key"]
    a, k = asked.alias("a"), known.alias("k")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"k.{c}")) if c == "package" else F.col(f"a.{c}") == F.col(f"k.{c}") for c in on]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    met = a.join(k, cond, "full_outer")
    free = F.col("a.by").isNull()
    either = lambda c: F.coalesce(f"a.{c}", f"k.{c}").alias(c)
    found = F.col("k.entry").isNotNull()
    flat = met.where(~free | (F.col("k.domain") != "place")).select(
        *[either(c) for c in GROUP], F.coalesce("a.item", "k.scope").alias("item"), "a.no", "a.ask", F.when(free, F.struct("k.domain", "k.key")).alias("_free"),
        F.struct((~found).alias("missed"), F.col("a.by").alias("by"), either("domain"), F.col("a.answer").alias("answer"), F.col("k.entry.place").alias("place"), F.col("k.entry.text").alias("text"), F.col("k.entry.example").alias("example")).alias("_try"),
    )
    best = flat.groupBy(*GROUP, "item", "no", "ask", "_free").agg(F.min("_try").alias("t"))
    state = F.when(F.col("_free").isNotNull(), F.when(F.col("t.example"), "example").otherwise("unused")).when(F.col("t.missed"), "unresolved").otherwise("resolved")
    return best.select(*GROUP, "item", "no", "ask", F.when(~F.col("t.missed"), F.col("t.domain")).alias("domain"), "t.answer", F.when(~F.col("t.missed"), F.col("t.by")).alias("by"), "t.place", "t.text", state.alias("state"))
