"""Personal data: high-recall generators, boosted trees, calibrated thresholds, all as DataFrame expressions.

Four base kinds (email, ip, card, phone) follow fixed patterns and checks, and always stay. Further generators propose
spans that may overlap (masked addresses, account and identity numbers, local phone numbers, secrets). Each proposal gets
format and context features; an ensemble of boosted trees, fitted on the driver to generated examples (`EXAMPLES` rows,
fixed seed) and compiled to CASE expressions, scores it; a threshold per kind, calibrated on held-out examples for
precision, selects spans. Of spans that overlap, base ones stay; where there are none, the best proposal.

Patterns never need to backtrack over a run: possessive quantifiers, and look-behinds that let a run start only at its
first character or where the last match ended. Positions come from the lengths of the pieces between matches. Sums and
maxima over the spans of a text are prefix scans of log2(n) passes, so a text may hold very many.

Defined results: null and empty texts have no spans; equal rows are judged one by one; an empty table gives an empty
result; columns other than `doc_id` and `text` pass through redact() untouched.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

BASE = ("email", "ip", "card", "phone")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
EMAIL_CHARS = "A-Za-z0-9._%+-"

PATTERNS = {
    "email": rf"(?:\G|(?<![{EMAIL_CHARS}]))[{EMAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "masked_email": rf"(?i)(?<![{EMAIL_CHARS}])[{EMAIL_CHARS}]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9A-Za-z+(.-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+(?![A-Za-z0-9_+/-])",
}
PROPOSED = tuple(k for k in PATTERNS if k not in BASE)
CONTEXT, PIECE = 24, 1024
SECRET_WORDS = r"(?i)token|secret|passw|pwd|api.?key|bearer|credential|akia"
PHONE_WORDS = r"(?i)phone|tel\b|tel\.|tel:|call|fax|mobile|whatsapp"
ID_WORDS = r"(?i)iban|account|ssn|social|identity|passport|konto"
FEATURES = ("length", "digits", "upper", "lower", "marks", "distinct", "hex", "secret_word", "phone_word", "id_word", "assigned", "kind")
EXAMPLES, SEED = 4000, 11


# ---- features: the same definitions for the fit (Python) and for the plan (expressions)


def features_of(kind: str, match: str, before: str) -> list[float]:
    count = lambda p, s=match: len(re.findall(p, s))
    return [len(match), count("[0-9]"), count("[A-Z]"), count("[a-z]"), len(match) - count("[0-9A-Za-z]"), len(set(match)), float(not re.search("[^0-9A-Fa-f]", match)),
            float(bool(re.search(SECRET_WORDS, before + match))), float(bool(re.search(PHONE_WORDS, before))), float(bool(re.search(ID_WORDS, before))), float(bool(re.search("[=:] ?[\"']?$", before))), PROPOSED.index(kind)]


def feature_columns(kind: str, match: Column, before: Column) -> list[Column]:
    left = lambda p: F.length(F.regexp_replace(match, p, ""))
    flag = lambda c, p: c.rlike(p).cast("double")
    size = F.length(match)
    cols = [size, size - left("[0-9]"), size - left("[A-Z]"), size - left("[a-z]"), left("[0-9A-Za-z]"), F.size(F.array_distinct(F.split(match, ""))), 1 - flag(match, "[^0-9A-Fa-f]"),
            flag(F.concat(before, match), SECRET_WORDS), flag(before, PHONE_WORDS), flag(before, ID_WORDS), flag(before, "[=:] ?[\"']?$"), F.lit(PROPOSED.index(kind))]
    return [c.cast("double").alias(n) for c, n in zip(cols, FEATURES, strict=True)]


# ---- examples, boosting, calibration


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated proposals with labels: formats in telling context, and look-alikes from ordinary text."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    hexa, alnum, digit, lower = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: pick(lower, rnd.randint(2, 9))
    plain = lambda: (" ".join(word() for _ in range(4)) + " ")[-CONTEXT:]
    x, y = [], []

    def add(kind: str, match: str, before: str, label: int) -> None:
        x.append(features_of(kind, match, before[-CONTEXT:]))
        y.append(label)

    for _ in range(n // 10):
        assign = rnd.choice([" = \"", "=", ": ", ":", " = '"])
        add("secret", pick(rnd.choice([hexa, alnum]), rnd.choice([20, 24, 32, 40, 64])), plain() + rnd.choice(["token", "secret", "password", "api_key", "apikey", "bearer"]) + assign, 1)
        add("secret", "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), plain(), 1)
        add("secret", rnd.choice(["-".join([word(), word(), word(), pick(digit, 2)]) + "-" * 0 + word() * 2, word() + word() + pick(digit, rnd.randint(1, 4)) + word(), "/".join([word() * 2, pick(digit, 4), pick(digit, 2), word() * 2]), pick(digit, rnd.randint(16, 24))]), plain(), 0)
        add("masked_email", f"{word()}[at]{word()}[dot]com" if rnd.random() < 0.5 else f"{word()} (at) {word()}.org", plain(), 1)
        add("iban", rnd.choice(["DE", "FR", "ES", "GB"]) + pick(digit, 2) + "".join(rnd.choice(["", " "]) + pick(digit, 4) for _ in range(4)) + pick(digit, 2), plain() + rnd.choice(["", "", "iban ", "account: "]), 1)
        add("iban", pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2) + pick(digit, 2) + "".join(" " + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4) for _ in range(3)), plain(), 0)
        add("national_id", f"{pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}", plain() + rnd.choice(["ssn ", "social security ", "SSN: "]), 1)
        add("national_id", f"{pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}", plain() + rnd.choice(["", "part no ", "pages "]), 0)
        add("local_phone", rnd.choice([f"({pick(digit, 3)}) {pick(digit, 3)}-{pick(digit, 4)}", f"0{pick(digit, 2)} {pick(digit, 7)}"]), plain() + rnd.choice(["phone ", "tel. ", "call ", "Tel: ", "mobile "]), 1)
        add("local_phone", rnd.choice([pick(digit, rnd.randint(7, 15)), f"{pick(digit, 4)}-{pick(digit, 2)}-{pick(digit, 2)}", " ".join(pick(digit, 2) for _ in range(5))]), plain() + rnd.choice(["", "", "on ", "order ", "no. "]), 0)
    return np.array(x, float), np.array(y, float)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float):
    """A regression tree on gradients: a leaf value, or (feature, threshold, left, right)."""
    gain, best = 1e-3, None
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[:-1] + values[1:])[:: max(1, len(values) // 16)] / 2:
                m = x[:, f] <= t
                a, b = (g[m].sum() ** 2 / (h[m].sum() + 1), g[~m].sum() ** 2 / (h[~m].sum() + 1))
                if (s := a + b - g.sum() ** 2 / (h.sum() + 1)) > gain:
                    gain, best = s, (f, float(t), m)
    if best is None:
        return float(rate * g.sum() / (h.sum() + 1))
    f, t, m = best
    return f, t, _grow(x[m], g[m], h[m], depth - 1, rate), _grow(x[~m], g[~m], h[~m], depth - 1, rate)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, _apply(low, x), _apply(high, x))


@functools.lru_cache(maxsize=1)
def model(trees: int = 16, depth: int = 3, rate: float = 0.5, precision: float = 0.98) -> tuple[list, float, float, dict[str, float]]:
    """Trees, Platt scale and shift, and a threshold for each proposed kind."""
    x, y = examples(EXAMPLES, SEED)
    held = np.arange(len(y)) // 10 % 4 == 0
    score, forest = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score[~held]))
        forest.append(_grow(x[~held], y[~held] - p, p * (1 - p), depth, rate))
        score += _apply(forest[-1], x)
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt scaling on the held-out part
        p = 1 / (1 + np.exp(-np.clip(a * score[held] + b, -30, 30)))
        w, r = p * (1 - p) + 1e-6, y[held] - p
        m = np.array([[(w * score[held] ** 2).sum() + 1, (w * score[held]).sum()], [(w * score[held]).sum(), w.sum() + 1]])
        a, b = np.array([a, b]) + np.linalg.solve(m, [(r * score[held]).sum() - (a - 1), r.sum() - b])
    prob = 1 / (1 + np.exp(-(a * score + b)))
    cut = {}
    for k, kind in enumerate(PROPOSED):
        mine = held & (x[:, -1] == k)
        ok = [t for t in np.arange(0.5, 1.0, 0.02) if y[mine & (prob >= t)].size and y[mine & (prob >= t)].mean() >= precision]
        cut[kind] = float(ok[0]) if ok else 1.01
    return forest, float(a), float(b), cut


def tree_sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    f, t, low, high = tree
    return f"CASE WHEN v.x.{FEATURES[f]} <= {t!r}D THEN {tree_sql(low)} ELSE {tree_sql(high)} END"


# ---- spans


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once a row, wherever f uses it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scan(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix combinations of an array by an associative f, in log2(n) passes over it."""
    n = F.size(values)
    rounds = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(now: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(now, lambda v, i: F.when(i >= back, f(F.get(now, i - back), v)).otherwise(v))

    return F.aggregate(rounds, values, step)


def cut(text: Column) -> Column:
    """A text as pieces of PIECE code points, so that a place far into it is reached without reading all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text that cut() has cut."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    return F.when(end > start, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * PIECE + 1, end - start)).otherwise("")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


#: A cheap test that a text can hold a kind at all.
NEEDS = {"email": lambda t: t.contains("@"), "masked_email": lambda t: t.rlike(r"(?i)[\[(]at[\])]"), "phone": lambda t: t.contains("+") & t.rlike(r"\+[0-9]")}


def find(docs: DataFrame) -> DataFrame:
    """Add `base` and `spans`, arrays of (start, no, end, kind), sorted, to a table with `text`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [*docs.columns]
    out = docs.withColumn("_text", text).withColumn("_digit", F.col("_text").rlike("[0-9]"))
    text, plain = F.col("_text"), lambda v: F.struct(v["start"].alias("start"), v["no"].alias("no"), v["end"].alias("end"), v["kind"].alias("kind"))

    def matches(kind: str) -> Column:
        has = F.col("_digit") if kind not in NEEDS else NEEDS[kind](text)
        return F.when(has, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)))

    def gaps(kind: str) -> Column:
        m = F.col(f"_m_{kind}")
        return F.when(F.size(m) > 0, F.transform(F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(m)), F.length))

    def steps(kind: str) -> Column:
        return let(F.zip_with(F.col(f"_g_{kind}"), F.col(f"_m_{kind}"), lambda a, v: a + F.length(v)), lambda sizes: scan(sizes, lambda x, y: x + y))

    def spans(kind: str) -> Column:
        no = F.lit(list(PATTERNS).index(kind))
        raw = F.zip_with(F.col(f"_r_{kind}"), F.col(f"_m_{kind}"), lambda e, v: F.struct((e - F.length(v)).alias("start"), no.alias("no"), e.alias("end"), F.lit(kind).alias("kind"), v.alias("match")))
        return F.filter(raw, lambda v: valid(kind, v["match"]))

    def measured(kind: str) -> Column:
        def all_(pieces: Column) -> Column:
            before = lambda v: part(pieces, F.greatest(v["start"] - CONTEXT, F.lit(0)), v["start"])
            return F.transform(F.col(f"_s_{kind}"), lambda v: F.struct(plain(v).alias("span"), F.struct(*feature_columns(kind, v["match"], before(v))).alias("x")))

        return F.when(F.size(F.col(f"_s_{kind}")) > 0, let(cut(text), all_))

    forest, a, b, limits = model()

    def selected(kind: str) -> Column:
        limit = math.log(limits[kind] / (1 - limits[kind])) if limits[kind] < 1 else math.inf
        logit = f"({' + '.join(map(tree_sql, forest))}) * {a!r}D + {b!r}D"
        scored = F.expr(f"transform(_x_{kind}, v -> struct({logit} as score, v.span as span))")
        return F.filter(scored, lambda v: v["score"] >= limit)

    for name, make, kinds in (("m", matches, PATTERNS), ("g", gaps, PATTERNS), ("r", steps, PATTERNS), ("s", spans, PATTERNS), ("x", measured, PROPOSED), ("p", selected, PROPOSED)):
        out = out.withColumns({f"_{name}_{k}": make(k) for k in kinds})
    none = F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>")
    base = F.concat(*(F.coalesce(F.transform(F.col(f"_s_{k}"), plain), none) for k in BASE))
    out = out.withColumn("base", F.array_sort(base))
    empty = F.array().cast("array<struct<score:double,span:struct<start:int,no:int,end:int,kind:string>>>")
    out = out.withColumn("_prop", F.concat(*(F.coalesce(F.col(f"_p_{k}"), empty) for k in PROPOSED)))
    out = out.withColumn("spans", F.when(F.size("_prop") > 0, let(F.array_sort(F.concat(F.transform("base", lambda v: ranked(v, F.lit(None).cast("double"))), F.transform("_prop", lambda v: ranked(v["span"], v["score"])))), resolved)).otherwise(F.col("base")))
    return out.select(*[c for c in own], "base", "spans")


def ranked(v: Column, score: Column) -> Column:
    """A span with its score; base spans have none."""
    return F.struct(v["start"].alias("start"), v["no"].alias("no"), v["end"].alias("end"), v["kind"].alias("kind"), score.alias("score"))


def resolved(spans: Column) -> Column:
    """Of sorted ranked spans, those that stay: spans that overlap in a chain form a cluster; its base spans stay, else its best."""

    def clusters(ends: Column) -> Column:
        fresh = F.transform(spans, lambda v, i: F.when((i > 0) & (v["start"] < F.get(ends, i - 1)), 0).otherwise(1))
        return let(fresh, lambda f: scan(f, lambda x, y: x + y))

    def marked(number: Column) -> Column:
        keys = F.transform(spans, lambda v, i: F.struct(F.get(number, i).alias("c"), v["score"].isNull().cast("int").alias("base"), F.coalesce(v["score"], F.lit(0.0)).alias("score"), (-v["start"]).alias("a"), (-v["no"]).alias("b")))
        return let(keys, chosen)

    def chosen(keys: Column) -> Column:
        best = lambda x, y: F.when(x["c"] == y["c"], F.greatest(x, y)).otherwise(y)
        ahead, behind = let(keys, lambda k: scan(k, best)), F.reverse(let(F.reverse(keys), lambda k: scan(k, best)))
        top = let(ahead, lambda x: let(behind, lambda y: F.transform(keys, lambda v, i: (v["base"] == 1) | ((F.get(x, i) == v) & (F.get(y, i) == v)))))
        stay = let(top, lambda t: F.filter(spans, lambda v, i: F.get(t, i)))
        return F.transform(stay, lambda v: F.struct(v["start"].alias("start"), v["no"].alias("no"), v["end"].alias("end"), v["kind"].alias("kind")))

    ends = let(F.transform(spans, lambda v: v["end"]), lambda e: scan(e, F.greatest))
    return let(let(ends, clusters), marked)


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda v: F.concat_ws(":", v["kind"], v["start"], v["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """All columns of docs, with every selected span (overlaps merged) replaced by its kind in angle brackets."""
    found = find(docs.withColumnRenamed("base", "_own_base").withColumnRenamed("spans", "_own_spans"))
    text = F.col("text")

    def joined(spans: Column) -> Column:
        # a span starts a cut unless an earlier one reaches into it; a cut ends with the furthest of the spans it meets
        reach = let(F.transform(spans, lambda v: v["end"]), lambda e: scan(e, F.greatest))

        def written(ends: Column, pieces: Column) -> Column:
            since = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            out = F.transform(spans, lambda v, i: F.when(v["start"] >= since(i), F.concat(part(pieces, since(i), v["start"]), F.lit("<"), F.upper(v["kind"]), F.lit(">"))).otherwise(""))
            return F.array_join(F.concat(out, F.array(part(pieces, F.element_at(ends, -1), F.length(text)))), "")

        return let(reach, lambda ends: let(cut(text), lambda pieces: written(ends, pieces)))

    fold = let(F.col("spans"), joined)
    out = found.withColumn("text", F.when(F.size("spans") > 0, fold).otherwise(text)).drop("base", "spans")
    return out.withColumnRenamed("_own_base", "base").withColumnRenamed("_own_spans", "spans").select(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda k: F.size(F.filter("base", lambda v: v["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
