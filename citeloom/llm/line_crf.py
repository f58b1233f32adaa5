"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score is linear in its own features and those of the lines before and after it; a
transition weight ties neighbours. The field is fitted to at most `SAMPLE` labelled documents of at most `LINES` lines (all
lines of a document carry its label) by gradient ascent on the conditional likelihood, on the driver, which so holds
SAMPLE * LINES lines of N numbers at most. Scores take whole texts of any length. Forward-backward gives each line the
probability of being good; their mean, weighted by line length, calibrated on the same sample, is the document's score.

Labels come only from rows outside the held-out fold; labels, lang, source and doc_id never enter a score.

Defined results: null and empty texts count as one empty line and get a score; without usable labels of both classes every
score is 0.5; equal rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, settle, slices

SAMPLE, LINES, FOLDS, HELD_OUT, THRESHOLD = 4000, 500, 4, 2, 0.7
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
SYMBOLS, DIGITS, MARKS, PIPES = b"#*$%&<>", b"0123456789", b"!?", b"|"
N = 13


def line_features(line: str) -> tuple[float, ...]:
    raw = line.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words) or 1, len(raw) or 1
    count = lambda cs: len(raw) - len(raw.translate(None, cs))
    upper, lower = count(UPPER), count(LOWER)
    distinct = len(set(words))
    return (
        1.0, np.log1p(len(words)) / 5, min(upper / (upper + lower + 1), 1.0), 5 * min(count(SYMBOLS) / n, 1.0), 5 * min(count(MARKS) / n, 1.0), 5 * min(count(PIPES) / n, 1.0),
        5 * min(count(DIGITS) / size, 1.0), min(size / n / 10, 3.0), 3 * (1 - distinct / n), float(distinct < 0.5 * n and n > 5), float(line.rstrip()[-1:] in (".", "!", "?", '"')), float(len(words) == 0), float(len(words) < 4),
    )


def own_features(lines: list[str]) -> np.ndarray:
    return np.array([line_features(x) for x in lines]).reshape(len(lines), N)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """lines x 3N features: each line's own, those of the line before and of the one after."""
    around = np.zeros((len(own), 3 * N))
    around[:, :N] = own
    around[1:, N : 2 * N] = own[:-1]
    around[:-1, 2 * N :] = own[1:]
    return around


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x 3N features, lengths): each line with its neighbours."""
    lines = (text or "").split("\n")
    return with_neighbours(own_features(lines)), np.array([len(x) + 1 for x in lines], float)


def line_scores(text: str | None, weights: np.ndarray, block: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """text_features(text) @ weights and the lengths, with the features of a block of lines in memory at a time."""
    lines = (text or "").split("\n")
    parts = weights.reshape(3, N).T
    each = np.concatenate([own_features(lines[k : k + block]) @ parts for k in range(0, len(lines), block)])
    score = each[:, 0].copy()
    score[1:] += each[:-1, 1]
    score[:-1] += each[1:, 2]
    return score, np.array([len(x) + 1 for x in lines], float)


@dataclass
class Model:
    weights: np.ndarray
    stay: float
    scale: float = 1.0
    shift: float = 0.0

    def score(self, x: np.ndarray, sizes: np.ndarray) -> float:
        good = marginals([x @ self.weights], self.stay)[0][0]
        return float(self.calibrated((good * sizes).sum() / sizes.sum()))

    def calibrated(self, q):
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-np.clip(self.scale * np.log(q / (1 - q)) + self.shift, -30, 30)))


def marginals(scores: list[np.ndarray], stay: float) -> tuple[list[np.ndarray], list[float], float]:
    """For each document P(good) of its lines, its expected number of equal neighbours, and the sum of log Z.

    State good has potential s, bad 0; equal neighbours have potential `stay`. All documents advance together.
    """
    sizes = np.array([len(s) for s in scores])
    longest, docs = int(sizes.max()), len(scores)
    s = np.zeros((longest, docs))
    on = np.arange(longest)[:, None] < sizes[None]
    for k, v in enumerate(scores):
        s[: len(v), k] = v
    ahead, behind = np.zeros((longest, docs, 2)), np.zeros((longest, docs, 2))
    ahead[0, :, 1] = s[0]
    for t in range(1, longest):
        a = ahead[t - 1]
        step = np.stack([np.logaddexp(a[:, 0] + stay, a[:, 1]), np.logaddexp(a[:, 0], a[:, 1] + stay) + s[t]], 1)
        ahead[t] = np.where(on[t][:, None], step, a)
    for t in range(longest - 2, -1, -1):
        b = behind[t + 1] + np.stack([np.zeros(docs), s[t + 1]], 1)
        step = np.stack([np.logaddexp(b[:, 0] + stay, b[:, 1]), np.logaddexp(b[:, 0], b[:, 1] + stay)], 1)
        behind[t] = np.where(on[t + 1][:, None], step, 0.0)
    z = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
    both = ahead + behind
    p = np.exp(np.minimum(both[:, :, 1] - z[None], 0.0))
    same = np.zeros(docs)
    for t in range(longest - 1):
        nxt = behind[t + 1] + np.stack([np.zeros(docs), s[t + 1]], 1)
        pair = np.exp(np.minimum(ahead[t, :, 0] + stay + nxt[:, 0] - z, 0)) + np.exp(np.minimum(ahead[t, :, 1] + stay + nxt[:, 1] - z, 0))
        same += np.where(on[t + 1], pair, 0.0)
    return [p[: len(v), k] for k, v in enumerate(scores)], same.tolist(), float(z.sum())


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> Model:
    """Maximum conditional likelihood by Adam, then logistic calibration of the documents' mean marginals."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(3 * N), 0.0, 0.0, 0.0)
    order = sorted(range(len(docs)), key=lambda k: len(docs[k][0]))
    groups = [order[at : at + 400] for at in range(0, len(order), 400)]  # documents of like length advance together
    share = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    theta, first, second = np.zeros(3 * N + 1), np.zeros(3 * N + 1), np.zeros(3 * N + 1)
    for step in range(1, steps + 1):
        grad = -ridge * theta * len(docs)
        for g in groups:
            p, same, _ = marginals([docs[k][0] @ theta[:-1] for k in g], theta[-1])
            for k, q, e in zip(g, p, same, strict=True):
                weight = share[k] / len(q)
                grad[:-1] += weight * (docs[k][0].T @ (labels[k] - q))
                grad[-1] += weight * (len(q) - 1 - e)
        grad /= len(docs)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model = Model(theta[:-1], float(theta[-1]))
    q = np.array([(marginals([x @ model.weights], model.stay)[0][0] * n).sum() / n.sum() for x, n in docs])
    q = np.clip(q, 1e-4, 1 - 1e-4)
    f, a = np.log(q / (1 - q)), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a[0] * f + a[1], -30, 30)))
        w = p * (1 - p) + 1e-6
        h = np.array([[(w * f * f).sum() + 1, (w * f).sum()], [(w * f).sum(), w.sum() + 1]])
        a = a + np.linalg.solve(h, [((labels - p) * f).sum() - (a[0] - 1), (labels - p).sum() - a[1]])
    model.scale, model.shift = float(a[0]), float(a[1])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 200, 0):
        found = [(t or "").split("\n") for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([own_features(x).tobytes() for x in found], pa.binary()), pa.array([np.array([len(y) + 1.0 for y in x]).tobytes() for x in found], pa.binary()), b.column(1)], ["x", "n", "quality"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most SAMPLE labelled documents outside the held-out fold, drawn by hash; those of more than LINES lines are passed over."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    drawn = settle(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # SAMPLE rows at most
    rows = rows.where(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) < LINES).select("text", "quality").limit(2 * SAMPLE)  # ids may repeat
    got = rows.mapInArrow(_pack, "x binary, n binary, quality int").collect()
    got.sort(key=lambda r: (r["quality"], bytes(r["x"])))
    found = [(with_neighbours(np.frombuffer(r["x"]).reshape(-1, N)), np.frombuffer(r["n"])) for r in got]
    return fit(found, np.array([r["quality"] for r in got], float)) if found else Model(np.zeros(3 * N), 0.0, 0.0, 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256, 1):
            found = [line_scores(t, model.weights) for t in b.column(1).to_pylist()]
            out = np.zeros(len(found))
            short = [k for k in range(len(found)) if len(found[k][0]) <= 200]
            groups = [short] * bool(short) + [[k] for k in range(len(found)) if len(found[k][0]) > 200]
            for g in groups:
                for k, p in zip(g, marginals([found[k][0] for k in g], model.stay)[0], strict=True):
                    out[k] = model.calibrated((p * found[k][1]).sum() / found[k][1].sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    out = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
