"""Exact n-gram Jaccard join with token-combination prefixes.

Tokens are word shingles. All documents' tokens are counted into a sketch of fixed width; its counts give each token a
frequency class, and sets are ordered by (class, hash), rare first. Two sets of similarity t share a token within their
prefixes of n - ceil(t n) + 1 tokens, and k tokens within prefixes longer by k - 1. So a set whose prefix holds only rare
classes is indexed by single tokens; one that reaches frequent classes extends its prefix by `GROUPS` tokens and is
indexed by its rare tokens singly and, for frequent ones, by two-token combinations within `GROUPS` hash groups: of
GROUPS + 1 shared tokens either one is rare, or two fall into one group. Any pair that links shares a key either way. Sets
too small or too large for combinations index frequent tokens singly; sets near those sizes do both, so that a pair on
either side of a line still meets. Candidates are verified on the whole sets (see simgraph).

Equal sets collapse to one entity before anything is joined. An entity is named by 64 bits of a 128-bit digest; where two
sets share these, the other 64 bits tell them apart (see clashes). The order affects the work, never the result.

Defined results: null, empty and wordless texts have an empty set and stand alone; a text shorter than a shingle is one
shingle; rows that repeat a doc_id are documents of their own and share the id; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_settled, parity, read, release, settle, shingle_batch, slices, task
from .simgraph import components, shared_rows

WIDTH, NUM, DEN = 4, 85, 100
#: Sets of FEW to SINGLES tokens index frequent tokens by pairs within GROUPS groups.
FEW, SINGLES, GROUPS = 16, 512, 8
SLICE, OFTEN, MOST_BITS = 1 << 14, 4, 24
#: Names that a partition remembers, to index equal sets once; beyond that, copies give their rows again.
REMEMBERED = 200_000


def entity(items: np.ndarray, clashing: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Signed 64-bit name of a set, and the rest of its 128-bit digest; names in `clashing` give way to one of both halves."""
    digest = xxhash.xxh3_128_digest(items.tobytes())
    name, check = (int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:]))
    return (renamed(name, check) if name in clashing else name), check


def renamed(name: int, check: int) -> int:
    """The name of a set whose first name clashes."""
    both = name.to_bytes(8, "little", signed=True) + check.to_bytes(8, "little", signed=True)
    return int.from_bytes(xxhash.xxh3_64_digest(both, 1), "little", signed=True)


def clashes(table: DataFrame) -> frozenset[int]:
    """Names that stand for several digests. Of n sets about n * n / 2**65 are expected: some hundred of 10**11."""
    found = table.groupBy("ent").agg(F.min("check").alias("_lo"), F.max("check").alias("_hi")).where("_lo <> _hi")
    return frozenset(r["ent"] for r in found.select("ent").toLocalIterator())


def prefix_keys(items: np.ndarray, classes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index keys of one set of sorted hashes; classes has a frequency class for each leading-bits bucket."""
    n = len(items)
    need = -(-num * n // den)
    if n < 2 or need < 2:  # such sets link only with equal ones
        return np.empty(0, np.uint64)
    cls = classes[items >> np.uint64(64 - (len(classes).bit_length() - 1))]
    items = items[np.lexsort((items, cls))]
    cls = np.sort(cls, kind="stable")
    p = n - need + 1
    if cls[p - 1] < OFTEN:
        return items[:p]
    ext = items[: min(n, p + GROUPS)]
    rare = int(np.searchsorted(cls[: len(ext)], OFTEN))
    keys = [ext[:rare]]
    if FEW <= n <= SINGLES:
        often = np.sort(ext[rare:])
        group = (often >> np.uint64(17)) % np.uint64(GROUPS)
        for g in range(GROUPS):
            own = often[group == g]
            i, j = np.triu_indices(len(own), 1)
            keys.append(own[i] * np.uint64(0x9E3779B97F4A7C15) + (own[j] ^ np.uint64(0xD1B54A32D192ED03)))
    if den * n >= num * SINGLES or num * n < den * FEW:
        keys.append(np.setdiff1d(items[:p], ext[:rare]))
    return np.concatenate(keys)


def frequency_classes(docs: DataFrame, width: int, bits: int) -> tuple[DataFrame, bytes]:
    """The settled (doc_id, ent, check, n, odd) table and the classes: one byte for each of 2**bits buckets.

    class = floor(4 * log2(count / mean count)), 0 at least; from twice the mean on (class `OFTEN`) a class is frequent.
    The sketch has a fixed size, bits is at most MOST_BITS (64 MB of counts in a task, 16 MB of classes to broadcast).
    """

    @task("jaccard_join")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for b in slices(batches, 1000, 1):
            sets = shingle_batch(b.column(1).to_pylist(), width)
            for items in sets:
                at = (items >> np.uint64(64 - bits)).astype(np.int64)  # sorted, as the items are
                new = np.flatnonzero(np.diff(at, prepend=-1))
                counts[at[new]] += np.diff(new, append=len(at)).astype(np.uint32)
            none, ents = pa.nulls(len(sets)), [entity(s) for s in sets]
            cols = [pa.array([e[0] for e in ents], pa.int64()), pa.array([e[1] for e in ents], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(parity, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols, none.cast(pa.int32()), none.cast(pa.binary())], names)
        step = min(SLICE, 1 << bits)
        for k in range((1 << bits) // step):
            part = counts[k * step : (k + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (*[pa.int64()] * 4, pa.list_(pa.int64()))), pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names)

    names = ["doc_id", "ent", "check", "n", "odd", "slice", "sketch"]
    both = settle(docs.mapInArrow(run, "doc_id long, ent long, check long, n long, odd array<long>, slice int, sketch binary"))

    def add(rows: pa.Table) -> pa.Table:
        total = None
        for raw in rows.column("sketch"):
            part = np.frombuffer(zlib.decompress(raw.as_py()), np.uint32).astype(np.uint64)
            total = part if total is None else total + part
        packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
        return pa.table([rows.column("slice")[:1], pa.array([0], pa.int32()), pa.array([packed], pa.binary())], ["slice", "salt", "sketch"])

    parts = both.where("slice is not null").select("slice", F.pmod(F.xxhash64("sketch"), F.lit(32)).cast("int").alias("salt"), "sketch")
    parts = parts.groupBy("slice", "salt").applyInArrow(add, "slice int, salt int, sketch binary").groupBy("slice").applyInArrow(add, "slice int, salt int, sketch binary")
    counts = np.zeros(1 << bits, np.uint32)
    step = min(SLICE, 1 << bits)
    for r in parts.toLocalIterator():  # fixed number of slices
        counts[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(zlib.decompress(bytes(r["sketch"])), np.uint32)
    mean = max(float(counts.mean(dtype=np.float64)), 8.0)
    classes = np.concatenate([np.clip(np.floor(4 * np.log2(np.maximum(part, 1) / mean)), 0, 255).astype(np.uint8) for part in np.split(counts, len(counts) // step)])
    return both.where("slice is null").select("doc_id", "ent", "check", "n", "odd"), classes.tobytes()


def link(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each document."""
    spark = docs.sparkSession
    docs = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    bits = int(np.clip(np.ceil(np.log2(max(docs.count(), 2))) + 3, 16, MOST_BITS))
    table, packed = frequency_classes(docs, width, bits)
    classes, clashing = spark.sparkContext.broadcast(packed), clashes(table)
    if clashing:
        bad, again = F.col("ent").isin(*clashing), F.udf(renamed, "long")  # a handful of rows
        table = table.where(~bad).unionByName(table.where(bad).withColumn("ent", again("ent", "check")))

    @task("jaccard_join")
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, own = np.frombuffer(classes.value, np.uint8), set()
        for b in slices(batches, 500, 1):
            keys, ents, sizes = [np.empty(0, np.uint64)], [], []
            for items in shingle_batch(b.column(1).to_pylist(), width):
                ent = entity(items, clashing)[0]
                if ent in own:
                    continue
                if len(own) < REMEMBERED:
                    own.add(ent)
                k = prefix_keys(items, cls, num, den)
                keys.append(k)
                ents.append(np.full(len(k), ent, np.int64))
                sizes.append(np.full(len(k), len(items), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate([np.empty(0, np.int64), *ents])), pa.array(np.concatenate([np.empty(0, np.int32), *sizes]))], ["key", "ent", "n"])

    shared = shared_rows(docs.mapInArrow(index, "key long, ent long, n int"))
    wanted = shared.select("ent").distinct()
    entities = settle(table.join(wanted, "ent").groupBy("ent").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("odd").alias("odd")))

    @task("jaccard_join")
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500, 1):
            sets = shingle_batch(b.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([pa.array([entity(s, clashing)[0] for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["ent", "items"])

    def fetch(wanted: DataFrame) -> DataFrame:
        ids = settle(entities.join(wanted, "ent").select("doc_id"))
        chosen = docs.join(broadcast_if_small(ids, ids.count()), "doc_id", "left_semi")
        if not ids.where("doc_id is null").isEmpty():  # sets that occur only in rows without id
            chosen = chosen.unionByName(docs.where("doc_id is null"))
        return chosen.mapInArrow(whole, "ent long, items array<long>")

    roots = components(shared, entities, fetch, num, den)
    # entities take the root of their component, documents the smallest id under a root
    named = table.join(roots.withColumnRenamed("node", "ent"), "ent", "left").withColumn("_root", F.coalesce("root", "ent"))
    named = settle(named.select("doc_id", F.col("n").alias("n_shingles"), "_root"))
    drop_settled(shared, entities, roots, table)
    release(spark)
    first = named.where("n_shingles > 0").groupBy("_root").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    out = named.join(first, "_root", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("_first", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"))
