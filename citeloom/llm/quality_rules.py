"""Rule-based quality filter run as a short-circuit cascade.

Every document gets whole-text counts. Documents that pass the two base limits go through a list of further rules. Each
rule's cost (seconds a document) and selectivity (share it rejects) are estimated on a sample; rules run in order of
rejections per second and a document leaves at its first failure. The order changes the time only: the verdict is the
conjunction of all rules.

Defined results: a null or empty text has no words, fails the base limits and is not kept; rows with equal ids are
judged one by one; an empty table gives an empty result; columns other than `id_col` and `text_col` are not read.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, read, slices, task

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass
class Doc:
    """A text with the counts that rules share; more is computed when a rule asks for it."""

    text: str
    raw: bytes
    words: list[bytes]
    counts: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by width-word windows that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    base = len(index)
    if base**width < 1 << 62:
        key = ids[:n].copy()
        for j in range(1, width):
            key = key * base + ids[j : j + n]
    else:  # ranks stay exact where the product would overflow
        key = ids[:n]
        for j in range(1, width):
            key = np.unique(key * base + ids[j : j + n], return_inverse=True)[1].astype(np.int64)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    cover[at] += 1
    np.subtract.at(cover, at + width, 1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> Doc:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    doc = Doc(text, raw, raw.split())  # bytes split on exactly the six ASCII white-space characters
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    doc.counts = {
        "n_words": len(doc.words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(doc.words),
        "n_lines": len(lines),
    }
    return doc


def base_failed(doc: Doc) -> bool:
    c = doc.counts
    return c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]


def _shouting(doc: Doc) -> bool:
    upper = len(doc.raw) - len(doc.raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(doc.raw) - len(doc.raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return upper > lower


def _letterless(doc: Doc) -> bool:
    return 10 * sum(w.lower() != w.upper() or w[0] > 127 for w in doc.words) < 6 * len(doc.words)


RULES = (
    Rule("symbols", lambda d: 10 * d.counts["n_symbols"] > d.counts["n_words"]),
    Rule("exclamations", lambda d: 10 * (d.text.count("!") + d.text.count("?")) > 3 * d.counts["n_words"]),
    Rule("shouting", _shouting),
    Rule("duplicate_lines", lambda d: 10 * d.counts["n_dup_lines"] > 3 * d.counts["n_lines"]),
    Rule("word_length", lambda d: not 2 * d.counts["n_words"] <= d.counts["word_chars"] <= 15 * d.counts["n_words"]),
    Rule("one_word", lambda d: 5 * Counter(d.words).most_common(1)[0][1] > 2 * len(d.words)),
    Rule("letterless", _letterless),
    Rule("ellipses", lambda d: 10 * (d.text.count("...") + d.text.count("…")) > 3 * d.counts["n_words"]),
)


def some_files(docs: DataFrame, files: int = 8) -> DataFrame:
    """The rows of at most so many of the files, evenly chosen by name."""
    found = sorted(re.sub("^file:/+", "file:/", p) for p in docs.inputFiles())  # as the file source writes paths
    if len(found) > files:
        try:
            docs = docs.where(F.col("_metadata.file_path").isin(found[:: -(-len(found) // files)]))
        except AnalysisException:  # not a plain scan of files
            pass
    return docs


def plan_cascade(docs: DataFrame, rules=RULES, text_col: str = "text", most: int = 250) -> list[Rule]:
    """Rules ordered by rejections per second, both measured on the first `most` rows of each task over a few files.

    Only two sums a rule reach the driver. The order decides about time only, so the sample may be small.
    """

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, cut, n, seen = [0.0] * len(rules), [0] * len(rules), 0, 0
        for b in slices(batches, 50):
            if seen >= most:
                break
            for t in b.column(0).to_pylist():
                seen += 1
                doc = measure(t)
                if base_failed(doc):
                    continue
                n += 1
                for k, r in enumerate(rules):
                    began = time.perf_counter()
                    cut[k] += r.rejects(doc)
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": pa.array(range(len(rules)), pa.int32()), "spent": spent, "cut": pa.array(cut, pa.int64()), "n": pa.array([n] * len(rules), pa.int64())})

    tried = some_files(docs).select(text_col).mapInArrow(trial, "rule int, spent double, cut long, n long")
    found = {r["rule"]: r for r in tried.groupBy("rule").sum("spent", "cut", "n").collect()}

    def worth(k: int) -> float:
        if k not in found or not found[k]["sum(n)"]:
            return 0.0
        return (found[k]["sum(cut)"] + 0.5) / max(found[k]["sum(spent)"], 1e-9)

    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-worth(k), k))]


def judge(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, counts, base_failed, kept and rejected_by (the first rule of the cascade that fails)."""
    rules = plan_cascade(docs, text_col=text_col) if rules is None else list(rules)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    @task("quality_rules")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000, 1):
            out: dict[str, list] = {c: [] for c in (*counts, "base_failed", "kept", "rejected_by")}
            for t in b.column(1).to_pylist():
                doc = measure(t)
                failed = base_failed(doc)
                by = "base" if failed else next((r.name for r in rules if r.rejects(doc)), None)
                for c in counts:
                    out[c].append(doc.counts[c])
                out["base_failed"].append(failed)
                out["kept"].append(by is None)
                out["rejected_by"].append(by)
            cols = [pa.array(out[c], pa.int64()) for c in counts] + [pa.array(out["base_failed"], pa.bool_()), pa.array(out["kept"], pa.bool_()), pa.array(out["rejected_by"], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols], ["doc_id", *counts, "base_failed", "kept", "rejected_by"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, rejected_by string"
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; only texts go to Python, only verdicts come back."""
    rules = plan_cascade(docs)

    def passes(texts: pa.Array) -> pa.Array:
        alone("quality_rules")
        mask = []
        for k in range(len(texts)):
            doc = measure(texts[k].as_py())
            mask.append(not base_failed(doc) and not any(r.rejects(doc) for r in rules))
        return pa.array(mask, pa.bool_())

    verdict = F.arrow_udf(passes, "boolean")
    return docs.where(verdict(F.col("text")))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("rejected_by")
