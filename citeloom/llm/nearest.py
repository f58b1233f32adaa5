"""Approximate nearest neighbours: inverted lists, searched by an adaptive scan over column blocks.

Vectors are assigned to lists (k-means on at most `SAMPLE` vectors drawn by hash, seeded; the number of lists grows with
the square root of the table) and rotated by a random orthogonal matrix, so that a few leading coordinates estimate a
distance. How many lists a query probes is calibrated on the same sample: as many as find `TARGET` of the true neighbours
of sampled queries, so data with clusters probe few lists and data without structure many. Each list is held in chunks of
bounded size, its rotated vectors as column blocks. Within a chunk a query adds up block after block and drops a candidate
as soon as a hypothesis test on the partial distance says that it cannot be among the k nearest so far. Survivors get the
exact distance of the original vectors in double precision.

Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest; the others are left out before lists are cut
into chunks, so a vector that a third of the rows hold costs no more than another. Centroids and rotation are of fixed size
and travel with the tasks; candidates and queries are dealt out by (list, chunk) and sorted, so that a task holds one chunk
while queries stream past it. Every candidate is dealt once; queries go to all chunks of their lists.

Defined results: vectors that are null, zero, of another dimension than most or hold null or non-finite components take
no part; equal vectors tie and go by smaller id; rows that repeat an id are candidates of their own; fewer candidates
than k are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, settle, shuffle_partitions

K, SAMPLE, CHUNK, BLOCK, EPSILON, SEED = 10, 20_000, 2_000, 16, 2.1, 5
#: Bounds of the number of lists, the share of true neighbours that calibration asks for, and the queries it tries.
LEAST_LISTS, MOST_LISTS, TARGET, TRIED = 16, 1024, 0.96, 200


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with finite, non-zero vectors as arrays of doubles."""
    t = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null and vec_id is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return t.where(fine)


def fit(vectors: np.ndarray, lists: int, seed: int = SEED, steps: int = 12) -> np.ndarray:
    """k-means centroids."""
    rnd = np.random.default_rng(seed)
    distinct = np.unique(vectors, axis=0)
    centres = distinct[rnd.permutation(len(distinct))[: min(lists, len(distinct))]].copy()
    for _ in range(steps):
        near = ((centres**2).sum(1)[None] - 2 * vectors @ centres.T).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, vectors)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0][:, None]
    return centres


def calibrate(vectors: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET, tried: int = TRIED) -> int:
    """Lists to probe, nearest first, so that `target` of the k nearest sampled vectors of sampled queries are found."""
    if len(vectors) <= k or len(centres) < 2:
        return len(centres)
    norm, weight = (vectors**2).sum(1), (centres**2).sum(1)
    filed = np.concatenate([(weight[None] - 2 * part @ centres.T).argmin(1) for part in np.array_split(vectors, len(vectors) // 4096 + 1)])
    queries = np.unique(np.linspace(0, len(vectors) - 1, tried).astype(int))
    order = np.argsort(np.argsort(weight[None] - 2 * vectors[queries] @ centres.T, axis=1, kind="stable"), axis=1)
    needed = []
    for row, q in enumerate(queries):
        gap = norm - 2 * vectors @ vectors[q]
        gap[q] = np.inf
        needed.append(order[row, filed[np.argpartition(gap, k)[:k]]])
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def scan(base: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, turned: np.ndarray, turned_q: np.ndarray, k: int, bound: float = np.inf) -> list[tuple[float, int]]:
    """The k nearest of a chunk to one query, as (distance, id): partial distances block by block, then exact ones."""
    dims = base.shape[1]
    live = np.flatnonzero(ids != own)
    if not len(live):
        return []
    if not np.isfinite(bound) and len(live) > 4 * k:  # a first bound from a few exact distances
        some = live[:: max(1, len(live) // (4 * k))]
        bound = np.partition(((base[some] - query) ** 2).sum(1), k - 1)[k - 1]
    part, at = np.zeros(len(live)), 0
    while at < dims and len(live) > k:
        to = min(dims, at + BLOCK)
        gap = turned[at:to][:, live] - turned_q[at:to, None]
        part = part + np.einsum("ij,ij->j", gap, gap)
        at = to
        # partial distances scale to whole ones with a relative error of about epsilon / sqrt(at)
        keep = part * dims / at <= bound * (1 + EPSILON / np.sqrt(at)) ** 2 + 1e-12
        if not keep.all():
            live, part = live[keep], part[keep]
    gap = base[live] - query
    exact = np.sqrt((gap * gap).sum(1))
    order = np.lexsort((ids[live], exact))[:k]
    return [(float(exact[i]), int(ids[live[i]])) for i in order]


def search(table: DataFrame, queries: DataFrame, k: int = K, lists: int | None = None, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries`, its k nearest rows of `table` other than itself."""
    spark = table.sparkSession
    base, asked = usable(table, id_col, vector_col), usable(queries, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    shape = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return spark.createDataFrame([], schema)
    dims, total = shape["d"], shape["count"]
    base, asked = base.where(F.size("v") == dims), asked.where(F.size("v") == dims)
    share = min(1.0, 1.2 * SAMPLE / total)
    drawn = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()  # the bounded fitting sample
    sample = np.array([r["v"] for r in drawn], float).reshape(len(drawn), dims) if drawn else np.zeros((1, dims))
    centres = fit(sample, lists or int(np.clip(2 * np.sqrt(total), LEAST_LISTS, MOST_LISTS)))
    probes = probes or calibrate(sample, centres, k)
    turn = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))[0]

    def near(v: np.ndarray) -> np.ndarray:
        return (centres**2).sum(1)[None] - 2 * v @ centres.T

    def matrix(column) -> np.ndarray:
        return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dims)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = near(matrix(b.column(1))).argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32())], ["vec_id", "v", "list"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.argsort(near(matrix(b.column(1))), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.tolist(), pa.list_(pa.int32()))], ["query_id", "q", "lists"])

    filed = base.mapInArrow(assign, "vec_id long, v array<double>, list int").withColumn("_hash", F.xxhash64("v"))
    twins = W.partitionBy("list", "_hash", "v").orderBy("vec_id")  # a limit on ranks is applied before rows are dealt out, too
    filed = settle(filed.withColumn("_twin", F.row_number().over(twins)).where(F.col("_twin") <= k + 1).drop("_twin", "_hash"))
    counts = filed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # a row a list
    filed = filed.join(F.broadcast(counts), "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).drop("chunks")
    put = asked.mapInArrow(visit, "query_id long, q array<double>, lists array<int>").withColumn("list", F.explode("lists")).drop("lists")
    put = put.join(F.broadcast(counts), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk is gathered, then queries pass by it; both come sorted by (list, chunk, ask)."""
        at, parts, chunk = None, [], None
        for b in batches:
            place = np.stack([b.column(c).to_numpy() for c in (0, 1, 2)], 1)
            cut = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), b.num_rows]
            out: list[tuple] = []
            for lo, hi in zip(cut, cut[1:], strict=False):
                if lo == hi:
                    continue
                where, rows, ids = tuple(place[lo, :2]), matrix(b.column(4).slice(lo, hi - lo)), b.column(3).slice(lo, hi - lo).to_numpy()
                if where != at:
                    at, parts, chunk = where, [], None
                if not place[lo, 2]:
                    parts.append((rows, ids))
                elif parts:
                    if chunk is None:
                        base = np.concatenate([x for x, _ in parts])
                        chunk = base, np.concatenate([x for _, x in parts]), np.ascontiguousarray((base @ turn).T)
                    for q, i in zip(rows, ids.tolist(), strict=True):
                        out += [(i, x, s) for s, x in scan(chunk[0], chunk[1], q, i, chunk[2], q @ turn, k)]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    cols = ["list", "chunk", "ask", "id", "v"]
    both = filed.select("list", "chunk", F.lit(0).alias("ask"), F.col("vec_id").alias("id"), "v").unionByName(put.select("list", "chunk", F.lit(1).alias("ask"), F.col("query_id").alias("id"), F.col("q").alias("v")))
    dealt = both.select(*cols).repartition(shuffle_partitions(spark), "list", "chunk").sortWithinPartitions("list", "chunk", "ask")
    found = dealt.mapInArrow(meet, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return search(table, table.where("vec_id % 100 = 0"))
