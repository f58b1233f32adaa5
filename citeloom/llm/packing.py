"""Best-fit packing of tokenised documents into sequences of bounded length.

Lengths are integers up to the capacity, so the packing problem is a histogram of at most `capacity` rows however many
documents there are. The histogram is packed once: pieces above a third of the capacity pair greedily, largest first with
the largest partner that fits (at most two of them share a sequence), smaller ones go best-fit, longest first, into the
tightest remaining gap. The result is a table of segments (length, ranks) -> (sequences, offset); each piece finds its
segment by its rank among pieces of its length. Ranks come from counts per (length, bucket), so no length is ever gathered
in one task, and the driver sees at most `capacity` counts.

Defined results: a null or empty text is one piece holding the end token; equal rows get places of their own; a document
longer than the capacity is cut into full pieces, the shorter remainder first; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, settle, shuffle_partitions, slices, task

CAPACITY, END = 1024, 2
#: Fixed value: how byte-level BPE cuts a text into pre-tokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts by the vocabulary of a byte-level BPE tokenizer file.

    Merges are applied in the order of token ids, which is checked against the file's list. Texts that hold the string of an added token go
    to the tokenizer itself, as such strings match before a text is cut.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or spec["normalizer"] or merged != sorted(merged):
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        self.path, self.added = path, [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def whole(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(a in text for a in self.added):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.asarray(ids, "<u4").tobytes()


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece."""

    @task("packing", shared_encoder.cache_clear)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(path), np.asarray([END], "<u4").tobytes()
        for b in slices(batches, 256, 1):
            rows: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                for k, (at, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + n)]
                    rows.append((i, k, at, n, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, kinds, strict=True))[: 5 + with_ids]], names[: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, count, per sequence, first sequence, offset) that place every piece."""
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    segments: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)

    def put(n: int, count: int, per: int, first: int, offset: int) -> None:
        segments.append((n, used[n], count, per, first, offset))
        used[n] += count
        left[n] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):  # greedy matching: the largest that is left with the largest that fits beside it
        while left[n]:
            k = bisect.bisect_right(large, capacity - n) - 1
            while k >= 0 and left[large[k]] - (large[k] == n) < 1:
                k -= 1
            mate = large[k] if k >= 0 else None
            if mate is None:
                count = left[n]
                first, bins = bins, bins + count
                put(n, count, 1, first, 0)
                gaps.setdefault(capacity - n, []).append((first, count))
                continue
            count = left[n] // 2 if mate == n else min(left[n], left[mate])
            first, bins = bins, bins + count
            put(n, count, 1, first, 0)
            put(mate, count, 1, first, n)
            gaps.setdefault(capacity - n - mate, []).append((first, count))
    gaps.pop(0, None)
    sizes = sorted(gaps)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(sizes, n)
            if k == len(sizes):
                runs, gap = [(bins, -(-left[n] // (capacity // n)))], capacity
                bins += runs[0][1]
            else:
                gap = sizes.pop(k)
                runs = gaps.pop(gap)
            first, room = runs.pop()
            per = gap // n
            full = min(room, left[n] // per)
            rest = []
            if full:
                put(n, full * per, per, first, capacity - gap)
                rest.append((gap - per * n, first, full))
            if full < room and left[n]:
                some = left[n]  # fewer than one sequence takes
                put(n, some, some, first + full, capacity - gap)
                rest.append((gap - some * n, first + full, 1))
                full += 1
            if full < room:
                rest.append((gap, first + full, room - full))
            if runs:
                rest.extend((gap, a, c) for a, c in runs)
            for g, a, c in rest:
                if g:
                    if g not in gaps:
                        bisect.insort(sizes, g)
                    gaps.setdefault(g, []).append((a, c))
    return segments


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table with doc_id, piece, start, length and ids_crc32."""
    spark = table.sparkSession
    table = settle(table)
    buckets = shuffle_partitions(spark)
    table = table.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = settle(table.groupBy("length", "_bucket").agg(F.count("*").alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    segments = spark.createDataFrame(plan(histogram, capacity), "length long, _first long, _count long, _per long, _sequence long, _offset long")
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = table.withColumn("_rank", F.row_number().over(own) - 1).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    placed = ranked.join(F.broadcast(segments), "length").where("_rank >= _first and _rank < _first + _count")  # a few thousand segments at any size
    within = F.col("_rank") - F.col("_first")
    return placed.withColumn("sequence_id", F.expr("_sequence + (_rank - _first) div _per")).withColumn("offset", F.col("_offset") + within % F.col("_per") * F.col("length")).select(*[c for c in table.columns if c != "_bucket"], "sequence_id", "offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(read(spark, sf_dir, "documents"), tokenizer_path()))
