"""Personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans; boosted trees judge each
by its format and its surroundings; a threshold, calibrated per kind on examples
kept out of the fit, selects what is redacted. Spans of the base patterns are
personal data by definition: they always stay, and what overlaps one is not
proposed again.

The trees are fitted here, to two kinds of examples. ``examples`` makes a fixed
number from a seed: a number or address format in a line of words, some of them
personal data and some look-alikes (dates, versions, amounts, identifiers).
``harvest`` takes them from the texts themselves: a base span in its own
surroundings, written so that the base patterns miss it, is personal data; what
looks like a base span but fails its test (a check digit, a number of digits, a
part over 255) or is a date is not. ``learn`` fits to both, with at most
``MOST_EXAMPLES`` of the latter, and sets thresholds on what is kept out of the fit.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, documents, slices, smallest

KINDS = ("email", "ip", "card", "phone")
#: As a match takes whole runs of digits, none starts within one: said so, long runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL, DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

#: The generators: wider than what they are meant to find.
WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?(?:dot|DOT) ?[\])}]) ?[A-Za-z0-9-]{1,63}){1,5}"),
    "ip": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}"),
    "card": re.compile(r"[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}"),
    "phone": re.compile(r"(?:00|\+ ?)?\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,4}"),
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from each at sign backwards; trying every start of a long run would be quadratic."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            yield a, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail their test are dropped. By start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


CUES = {
    "email": re.compile(r"mail|contact|write|adresse|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|addr|host|server|from", re.I),
    "card": re.compile(r"card|visa|master|credit|pay|karte|carte|tarjeta|iban", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|fax|cell|ring|anruf|appel|llam", re.I),
}
AGAINST = re.compile(r"order|invoice|version|section|page|total|date|isbn|ref|id\b|no\.|#|\$|€|£|year|build", re.I)
NAMES = ("kind", "digits", "length", "groups", "longest", "shortest", "luhn", "plus", "parentheses", "dots", "slashes", "hyphens", "spaces", "letters", "left", "right", "cue", "against", "date", "zero", "distinct", "first")


def features(text: str, span: Span) -> list[float]:
    """Format of the span, and what stands around it (40 characters on either side)."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 40]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s) or [""]
    left, right = before[-1:], after[:1]
    near = lambda c: 0.0 if not c else 1.0 if c.isspace() or c in "()[]{},;:\"'" else 2.0 if not c.isalnum() else 3.0
    date = bool(re.fullmatch(r"(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]|[0-3]?[0-9][ ./-][01]?[0-9][ ./-](?:19|20)?[0-9]{2}", s))
    return [
        float(KINDS.index(kind)), float(len(d)), float(b - a), float(len(groups)), float(max(map(len, groups))), float(min(map(len, groups))), float(len(d) > 11 and luhn(d)), float("+" in s), float("(" in s or "[" in s or "{" in s),
        float(s.count(".")), float(s.count("/")), float(s.count("-")), float(s.count(" ")), float(sum(c.isalpha() for c in s)), near(left), near(right), float(bool(CUES[kind].search(before))), float(bool(AGAINST.search(before[-16:]))),
        float(date), float(d[:1] == "0"), float(len(set(d))), float(d[:1] or 0),
    ]


@dataclass
class Trees:
    """Gradient-boosted regression trees for log-loss, on features cut at quantiles."""

    edges: list[np.ndarray]
    trees: list[list[tuple[int, int, int, int, float]]]  # nodes: feature (-1: leaf), bin, left, right, value
    start: float
    curve: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1], method="lower")) for j in range(x.shape[1])]
        bins = cls._bins(x, edges)
        p0 = min(0.99, max(0.01, float(y.mean())))
        out = cls(edges, [], float(np.log(p0 / (1 - p0))))
        margin = np.full(len(y), out.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            nodes: list = []

            def grow(rows: np.ndarray, left_depth: int) -> int:
                at = len(nodes)
                nodes.append(None)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best = (1e-6, -1, -1)
                if left_depth and len(rows) >= 8:
                    for j, e in enumerate(edges):
                        sg = np.cumsum(np.bincount(bins[rows, j], g[rows], len(e) + 1))[:-1]
                        sh = np.cumsum(np.bincount(bins[rows, j], h[rows], len(e) + 1))[:-1]
                        if len(sg):
                            gain = sg**2 / (sh + ridge) + (total_g - sg) ** 2 / (total_h - sh + ridge) - total_g**2 / (total_h + ridge)
                            k = int(gain.argmax())
                            if gain[k] > best[0]:
                                best = (float(gain[k]), j, k)
                if best[1] < 0:
                    value = rate * total_g / (total_h + ridge)
                    nodes[at] = (-1, 0, 0, 0, float(value))
                    margin[rows] += value
                else:
                    _, j, k = best
                    low = bins[rows, j] <= k
                    nodes[at] = (j, k, grow(rows[low], left_depth - 1), grow(rows[~low], left_depth - 1), 0.0)
                return at

            grow(np.arange(len(y)), depth)
            out.trees.append(nodes)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x, self.edges)
        total = np.full(len(x), self.start)
        for nodes in self.trees:
            feature, cut, low, high, value = (np.array(c) for c in zip(*nodes))
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():  # all rows go down one level at a time
                rows, n = np.flatnonzero(inner), at[inner]
                at[rows] = np.where(bins[rows, feature[n]] <= cut[n], low[n], high[n])
            total += value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -30, 30)))


def _card_number(rng: random.Random, n: int = 16) -> str:
    body = [rng.choice("3456"), *[str(rng.randrange(10)) for _ in range(n - 2)]]
    return next(s for k in range(10) if luhn(s := "".join(body) + str(k)))


def examples(n: int = 3000, seed: int = 42) -> list[tuple[str, Span, int]]:
    """(text, span, personal or not): formats in lines of made-up words, with and without telling words before them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    num = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    grouped = lambda s, sep: sep.join(s[k : k + 4] for k in range(0, len(s), 4))
    yes = [
        ("email", lambda: f"{word()}.{word()} {rng.choice(['(at)', '[at]', '( at )', '{at}', '[AT]'])} {word()} {rng.choice(['(dot)', '[dot]', '.'])} {rng.choice(['com', 'org', 'net', 'de'])}", "mail"),
        ("ip", lambda: ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), "host"),
        ("card", lambda: grouped(_card_number(rng), rng.choice([".", "/", "_", "  "])), "card"),
        ("phone", lambda: f"({num(3)}) {rng.choice(['555', num(3)])}-{num(4)}", "call"),
        ("phone", lambda: f"{rng.randint(200, 999)}-{num(3)}-{num(4)}", "phone"),
        ("phone", lambda: f"00{rng.randint(10, 99)} {num(3)} {num(3)} {num(3)}", "tel"),
    ]
    no = [
        ("email", lambda: f"{word()} (at) {word()} . {word()}", "look"),
        ("ip", lambda: ":".join(num(2) for _ in range(6)), "time"),
        ("card", lambda: grouped(num(16), rng.choice([".", "/"])), "ref"),
        ("phone", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", "date"),
        ("phone", lambda: f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(1900, 2030)}", "on"),
        ("phone", lambda: f"{num(2)}.{num(2)}", "version"),
        ("phone", lambda: f"{num(3)} {num(3)}", "total"),
        ("phone", lambda: f"{num(4)}-{num(4)}", "id"),
        ("phone", lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(3)}", "build"),
        ("phone", lambda: " ".join(num(rng.randint(2, 4)) for _ in range(rng.randint(2, 5))), "page"),
        ("phone", lambda: f"{num(4)}-{num(4)}-{num(4)}", "order"),
    ]
    out = []
    for k in range(n):
        label = k % 2
        kind, make, cue = rng.choice(yes if label else no)
        s = make()
        lead = " ".join(word() for _ in range(rng.randint(1, 6))) + (f" {cue} " if rng.random() < (0.6 if label else 0.5) else " ")
        glue = rng.choice(["", "", "", "x", "#"]) if not label else ""
        out.append((f"{lead}{glue}{s} {word()} {word()}.", (kind, len(lead) + len(glue), len(lead) + len(glue) + len(s)), label))
    return out


#: Examples taken from texts, at most: those with the smallest hash of their surroundings.
MOST_EXAMPLES = 4_000
AROUND = 60


def _at(text: str, kind: str, near: int) -> Span | None:
    """What the generators propose of a kind at a place."""
    return next((s for s in propose(text) if s[0] == kind and s[1] <= near < s[2]), None)


def harvest(text: str | None) -> list[tuple[str, Span, int]]:
    """(surroundings, span, personal or not) out of one text."""
    text, out = text or "", []
    if not DIGIT.search(text) and "@" not in text:
        return out
    base = base_spans(text)
    taken = {(a, b) for _, a, b in base}
    for kind, a, b in base:
        before, own, after = text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND]
        turn = sum(map(ord, own)) % 3  # a matter of the span, so that reruns agree
        if kind == "email":
            own = own.replace("@", (" (at) ", " [at] ", "{at}")[turn], 1)
        elif kind == "card":
            d = _digits(own)
            own = "./_"[turn].join(d[k : k + 4] for k in range(0, len(d), 4))
        elif kind == "phone":
            own = "00" + own[1:].lstrip()
        near = before + own + after
        if kind != "ip" and (s := _at(near, kind, len(before))):
            out.append((near, s, 1))
    for kind, pattern in (("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            if (m.start(), m.end()) not in taken and 7 <= len(_digits(m[0])) <= 24:
                near = text[max(0, m.start() - AROUND) : m.end() + AROUND]
                s = _at(near, kind, min(m.start(), AROUND)) or _at(near, "phone", min(m.start(), AROUND))
                if s:
                    out.append((near, s, 0))
    return out


def learn(docs: DataFrame, most: int = MOST_EXAMPLES) -> Judge:
    """A judge fitted to made examples and to at most ``most`` of those that ``docs(text)`` hold; only their surroundings come to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(near, k, a, b, y) for t in batch.column(0).to_pylist() for near, (k, a, b), y in harvest(t)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["near", "kind", "a", "b", "y"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "near string, kind string, a int, b int, y int")
    found = Scratch(docs.sparkSession, "pii").table(found, "examples")
    rows = smallest(found, F.xxhash64("near"), ["near", "kind", "a", "y"], most, found.count()).to_pylist()
    return _fitted(examples() + [(r["near"], (r["kind"], r["a"], r["b"]), r["y"]) for r in rows])


@dataclass
class Judge:
    trees: Trees
    threshold: dict[str, float]


@functools.cache
def train(n: int = 3000, seed: int = 42, precision: float = 0.99) -> Judge:
    """A judge fitted to made examples alone."""
    return _fitted(examples(n, seed), precision)


def _fitted(made: list[tuple[str, Span, int]], precision: float = 0.99) -> Judge:
    """Fit on two thirds, calibrate (Platt) on the rest; a kind's threshold is the least with the wanted precision there, and 0.5 at least."""
    x, y = np.array([features(t, s) for t, s, _ in made]), np.array([float(v) for *_, v in made])
    out = np.arange(len(y)) % 3 == 2
    trees = Trees.fit(x[~out], y[~out])
    m, w = trees.margin(x[out]), np.array([1.0, 0.0])
    design = np.c_[m, np.ones(len(m))]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), design.T @ (y[out] - p) - 0.1 * (w - [1.0, 0.0]))
    trees.curve = (float(w[0]), float(w[1]))
    p, threshold = trees.probability(x[out]), {}
    for k, kind in enumerate(KINDS):
        own = x[out][:, 0] == k
        levels = [t for t in np.unique(np.floor(p[own] * 1000) / 1000) if t >= 0.5 and y[out][own][p[own] >= t].mean() >= precision]
        threshold[kind] = float(levels[0]) if levels else 1.1  # no level has the precision: nothing of this kind is added
    return Judge(trees, threshold)


def propose(text: str) -> list[Span]:
    """All candidates, overlapping or not, beside the base patterns' own."""
    out: list[Span] = []
    if "at" in text or "AT" in text or "@" in text:
        if any(x in text for x in "[({"):
            out += [("email", m.start(), m.end()) for m in WIDE["email"].finditer(text)]
    if DIGIT.search(text):
        out += [(k, m.start(), m.end()) for k in ("card", "phone") for m in WIDE[k].finditer(text) if len(_digits(m[0])) >= 7]
    if text.count(":") >= 5:
        out += [("ip", m.start(), m.end()) for m in WIDE["ip"].finditer(text)]
    return out


def find(text: str | None, judge: Judge) -> tuple[list[Span], list[Span]]:
    """Base spans, and those the trees add: likelier first, none overlapping one already taken."""
    text = text or ""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    free = lambda a, b: (k := bisect.bisect_left(taken, (b, -1))) == 0 or max(e for _, e in taken[max(0, k - 4) : k]) <= a
    some = [s for s in propose(text) if free(s[1], s[2])]
    added: list[Span] = []
    if some:
        p = judge.trees.probability(np.array([features(text, s) for s in some]))
        for k in sorted(range(len(some)), key=lambda k: (-p[k], some[k][1], KINDS.index(some[k][0]))):
            if p[k] >= judge.threshold[some[k][0]] and free(some[k][1], some[k][2]):
                added.append(some[k])
                bisect.insort(taken, some[k][1:])
    return base, added


def detect(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``doc_id, base, added``: spans (kind, start, end in code points, end exclusive) of every row of ``docs(doc_id, text)``.

    Null and empty texts have none; texts are read whole; repeated rows and null
    ids are like any other; other columns are ignored.
    """
    judge = judge or train()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, judge) for t in batch.column(1).to_pylist()]
            columns = [pa.array([[{"kind": k, "first": a, "last": b} for k, a, b in x[side]] for x in found], kind) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "added"])

    spans = "array<struct<kind: string, first: long, last: long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {spans}, added {spans}")


def redact(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (overlapping spans by the first one's); all columns stay, of any name.

    Null texts stay null, empty ones empty; texts are read whole; repeated rows are
    treated alike; an empty table gives no rows.
    """
    judge = judge or train()

    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            base, added = find(text, judge)
            out, at = [], 0
            for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                if a >= at:
                    out += [text[at:a], f"[{kind}]"]
                at = max(at, b)
            return "".join(out) + text[at:]

        return texts.map(one)

    return docs.withColumn("text", clean(F.col("text").cast("string")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans counted by kind and digested, and all spans, of every row of documents; the spans are those of ``detect``."""
    docs = documents(spark, sf_dir)
    found = detect(docs, learn(docs))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))), ",")
    place = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    before = lambda x, y: F.when(x["first"] != y["first"], x["first"] - y["first"]).otherwise(place(x) - place(y)).cast("int")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    every = F.array_sort(F.concat("base", "added"), before)
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
