"""Personal data by a semi-Markov conditional random field.

Base spans come from fixed patterns.  Around every digit or @ a region of tokens is scored by the field: whole-span features
rate each candidate segment (bounded in tokens) and each type, and dynamic programming picks boundaries and types of the
region jointly.  Segments that don't touch a base span are added.  Outside the regions no segment is a candidate, so the
best labelling of a text is that of its regions.
"""

from __future__ import annotations

import bisect
import collections
import functools
import itertools
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exalake.llm.text_arrays import byte_slices

#: Base kinds in the order of ties, then those that only the field finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account")
#: The longest entity in tokens; the dynamic program looks no further back.
MAX_TOKENS = 12
CONTEXT_WORDS = 2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't start inside a run of digits, so the runs are tried once each
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z0-9_]+|[^\W\d_]+|\S")
_ANCHOR = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost without overlap within a kind, in order of start, then kind."""
    out: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Field:
    """The trained field: weights of span features by type and of neighbouring types."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    # -- features ---------------------------------------------------------------------------------------------------
    @staticmethod
    def features(text: str, start: int, end: int, left: str) -> list[str]:
        """What a whole candidate span looks like; the type is put before each."""
        s = text[start:end]
        digits = re.sub(r"[^0-9]", "", s)
        n = len(digits)
        before, after = text[start - 1 : start], text[end : end + 1]
        shape = re.sub(r"9+", "9", re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", s)))
        out = ["bias", f"digits{min(n, 20)}", f"all{len(s) == n}", f"first{'+' if s[0] == '+' else '9' if s[0].isdigit() else 'a' if s[0].isalpha() else s[0]}", f"last{'9' if s[-1].isdigit() else 'a' if s[-1].isalpha() else 'x'}"]
        out += [f"shape{shape[:24]}", f"cut{before.isalnum()}{after.isalnum()}", f"quoted{before in chr(34) + chr(39) and before != ''}", f"at{s.count('@')}", f"space{min(2, s.count(' '))}", f"left{left}"]
        if n >= 12 and re.fullmatch(r"[0-9 -]+", s):
            out += [f"luhn{luhn(digits)}", f"long{13 <= n <= 19}"]
        if len(parts := s.split(".")) == 4:
            out.append(f"octets{all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}")
        if re.fullmatch(r"[A-Za-z0-9_]{16,}", s):
            out += [f"hex{bool(re.fullmatch(r'[0-9a-fA-F]+', s))}", f"mixed{0 < n < len(s)}", f"blob{min(4, len(s) // 16)}"]
        if s.count("(") == s.count(")") and n >= 9 and re.fullmatch(r"\+?[0-9 ().-]+", s):
            out.append(f"dialled{len(re.findall(r'[0-9]+', s))}{'(' in s}")
        return out

    def candidates(self, text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
        """For each end (in tokens): the starts of candidate segments with their features."""
        out: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(tokens) + 1)]
        words = [text[a:b] for a, b in tokens]
        for j in range(1, len(tokens) + 1):
            if not (words[j - 1][-1].isalnum()):
                continue
            for i in range(max(0, j - MAX_TOKENS), j):
                a, b = tokens[i][0], tokens[j - 1][1]
                if not (words[i][0].isalnum() or words[i] in "+(") or not _ANCHOR.search(text, a, b) or text.find("\n", a, b) >= 0:
                    continue
                left = next((w.lower() for w in reversed(words[max(0, i - 4) : i]) if w.isalpha()), "")
                out[j].append((i, self.features(text, a, b, left if left in KEY_WORDS else "other")))
        return out

    def score(self, kind: str, feats: list[str]) -> float:
        w = self.weights
        return sum([w.get(f"{kind}|{f}", 0.0) for f in feats])

    # -- decoding ---------------------------------------------------------------------------------------------------
    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """The best segmentation: Viterbi over ends, types and bounded lengths."""
        cand = self.candidates(text, tokens)
        names = ("O", *KINDS)
        trans = {(p, k): self.weights.get(f"{p}>{k}", 0.0) for p in names for k in names}
        best: list[dict[str, tuple[float, int, str]]] = [{"O": (0.0, 0, "")}]
        for j in range(1, len(tokens) + 1):
            here = {"O": max((v[0] + trans[p, "O"], j - 1, p) for p, v in best[j - 1].items())}
            for i, feats in cand[j]:
                for kind in KINDS:
                    s = self.score(kind, feats)
                    x = max((v[0] + trans[p, kind] + s, i, p) for p, v in best[i].items())
                    if kind not in here or x > here[kind]:
                        here[kind] = x
            best.append(here)
        out, j = [], len(tokens)
        kind = max(best[j], key=lambda k: best[j][k][0])
        while j > 0:
            _, i, p = best[j][kind]
            if kind != "O":
                out.append((kind, tokens[i][0], tokens[j - 1][1]))
            j, kind = i, p
        return out[::-1]

    # -- training ---------------------------------------------------------------------------------------------------
    def gradient(self, text: str, tokens: list[tuple[int, int]], gold: list[tuple[str, int, int]]) -> dict[str, float]:
        """Of the log-likelihood: features of the gold segments less those expected under the field."""
        names, n = ("O", *KINDS), len(tokens)
        cand = self.candidates(text, tokens)
        trans = {(p, k): self.weights.get(f"{p}>{k}", 0.0) for p in names for k in names}
        alpha: list[dict[str, float]] = [{"O": 0.0}]
        segs: list[list[tuple[int, str, float, list[str]]]] = [[] for _ in range(n + 1)]
        add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
        for j in range(1, n + 1):
            segs[j] = [(j - 1, "O", 0.0, [])] + [(i, k, self.score(k, f), f) for i, f in cand[j] for k in KINDS]
            into: dict[str, list[float]] = {}
            for i, k, s, _ in segs[j]:
                into.setdefault(k, []).extend(alpha[i][p] + trans[p, k] + s for p in alpha[i])
            alpha.append({k: add(v) for k, v in into.items()})
        total = add(list(alpha[n].values()))
        beta: list[dict[str, float]] = [{} for _ in range(n + 1)]
        beta[n] = dict.fromkeys(alpha[n], 0.0)
        grad: dict[str, float] = {}
        for j in range(n, 0, -1):
            for i, k, s, f in segs[j]:
                if k not in beta[j]:
                    continue
                for p in alpha[i]:
                    tail = trans[p, k] + s + beta[j][k]
                    beta[i][p] = add([beta[i][p], tail]) if p in beta[i] else tail
                    q = math.exp(alpha[i][p] + tail - total)
                    if q > 1e-6:
                        grad[f"{p}>{k}"] = grad.get(f"{p}>{k}", 0.0) - q
                        for x in f:
                            grad[f"{k}|{x}"] = grad.get(f"{k}|{x}", 0.0) - q
        at = {(a, b): k for k, a, b in gold}
        j, prev = 0, "O"
        while j < n:
            hit = next(((e, k) for e in range(min(n, j + MAX_TOKENS), j, -1) if (k := at.get((tokens[j][0], tokens[e - 1][1])))), None)
            end, k = hit or (j + 1, "O")
            grad[f"{prev}>{k}"] = grad.get(f"{prev}>{k}", 0.0) + 1
            if hit:
                for x in next((f for i, f in cand[end] if i == j), []):
                    grad[f"{k}|{x}"] = grad.get(f"{k}|{x}", 0.0) + 1
            j, prev = end, k
        return grad


#: Words that tell what follows them; other words before a span are one feature.
KEY_WORDS = frozenset("token key secret password passwd pwd api apikey bearer card account iban tel phone call fax ip host mail email version page order item room".split())


def samples(n: int, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up sentences with known entities, and numbers that are none."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        d = num(15)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return d if rng.random() < 0.5 else rng.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{num(2)} {num(4)} {num(4)}"])

    def entity() -> tuple[str, str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            return kind, rng.choice(["", "mail "]), f"{word()}{rng.choice(['', '.'])}{num(2)}@{word()}.{rng.choice(['example.com', 'org', 'de'])}"
        if kind == "ip":
            return kind, rng.choice(["", "host "]), ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return kind, rng.choice(["", "card "]), card()
        if kind == "phone":
            return kind, rng.choice(["", "tel ", "call "]), phone()
        if kind == "secret":
            blob = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40])))
            blob = blob if rng.random() < 0.7 else "sk_" + "".join(rng.choice("0123456789abcdefXYZKQ") for _ in range(24))
            return kind, rng.choice(["token", "key", "secret", "api"]) + rng.choice([" = ", ": "]), blob
        return kind, rng.choice(["", "account "]), next(d for _ in range(99) if not luhn(d := num(rng.choice([14, 16, 16, 18]))))

    out = []
    for _ in range(n):
        text, gold = f"{word()} {word()} ", []
        for _ in range(rng.randint(1, 2)):
            if rng.random() < 0.35:
                text += rng.choice([f"version {num(1)}.{num(1)}", f"page {num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)} {word()}", f"{num(1)},{num(3)},{num(3)}", f"{word()} @ {word()}", f"{num(3)} {num(2)}", f"v{num(1)}.{num(2)}.{num(1)}"])
            else:
                kind, lead, body = entity()
                quote = '"' if kind == "secret" and rng.random() < 0.6 else ""
                text += lead + quote
                gold.append((kind, len(text), len(text) + len(body)))
                text += body + quote
            text += rng.choice([" ", ". ", ", ", "\n"]) + f"{word()} {word()} "
        out.append((text, gold))
    return out


@functools.cache
def trained_field(n: int = 240, rounds: int = 4, seed: int = 7) -> Field:
    """Weights by stochastic ascent of the likelihood (adaptive steps) over made-up sentences; the same at every call."""
    field, seen = Field({}), {}
    data = samples(n, seed)
    for _ in range(rounds):
        for text, gold in data:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            for f, g in field.gradient(text, tokens, gold).items():
                seen[f] = seen.get(f, 0.0) + g * g
                field.weights[f] = 0.9995 * field.weights.get(f, 0.0) + 0.5 * g / math.sqrt(1e-3 + seen[f])
    field.weights = {f: w for f, w in field.weights.items() if abs(w) > 1e-3}
    return field


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches with a digit or @, with two words before and one after; stretches that meet are one.  One pass over the words."""
    open_at, open_to, reach = -1, -1, 0
    before = collections.deque(maxlen=CONTEXT_WORDS + 1)
    for m in _WORD.finditer(text):
        before.append(m.start())
        if reach:  # the word before had an anchor
            open_to, reach = m.end(), 0
        if _ANCHOR.search(text, m.start(), m.end()):
            if open_at >= 0 and before[0] > open_to:
                yield open_at, open_to
                open_at = -1
            open_at, open_to, reach = before[0] if open_at < 0 else open_at, m.end(), 1
    if open_at >= 0:
        yield open_at, open_to


def find(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    if not text or not _ANCHOR.search(text):
        return [], []
    base = base_spans(text)
    starts = [a for _, a, _ in base]
    reach = [*itertools.accumulate((e for _, _, e in base), max)]  # how far the spans up to each one go
    more = []
    for a, b in regions(text):
        tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
        for s in field.decode(text, tokens):
            i = bisect.bisect_left(starts, s[2])
            if not i or reach[i - 1] <= s[1]:
                more.append(s)
    return base, sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, base and spans, arrays of (kind, start, end) in code points, the end exclusive.

    base has the fixed patterns, spans also what the field adds; both by start, then kind.  A null or empty text has none;
    repeated rows and null ids give a row each; other columns are ignored.  Cost is linear in a text's length.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    field = trained_field()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            got = [find(t, field) for t in part.column("text").to_pylist()]
            lists = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in g[i]] for g in got], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *lists], ["id", "base", "spans"])

    kind, spans = source.schema["id"].dataType.simpleString(), "array<struct<kind:string,start:long,end:long>>"
    return source.mapInArrow(scan, f"id {kind}, base {spans}, spans {spans}").withColumnRenamed("id", id_col)


def span_text(column: str):
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the text with every span replaced by its kind in brackets; overlapping spans are one, named after the first."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    field = trained_field()

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for k, a, b in find(text, field)[1]:
            if a >= at:
                out += [text[at:a], f"[{k}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([one(t) for t in part.column("text").to_pylist()], pa.string())], ["id", "text"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string").toDF(id_col, text_col)


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans and all spans as text."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[n(k) for k in BASE_KINDS], F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
