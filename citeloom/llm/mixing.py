"""Mixing sources to target weights by entropy balancing.

Documents are units of equal base weight. Among all rates between 0 and `cap` that meet the token target of every source,
entropy balancing takes those closest to 1 in relative entropy. The dual is convex with one multiplier a source, and a
document's rate is tilted exponentially: min(cap, exp(lambda of its source * its size)). Newton steps on the dual are
aggregations over the histogram (source, size, documents): gradient, words taken less target; Hessian, the sum of
size**2 * rate over rates below the cap. Every step stays inside a bracket of the multiplier, which it narrows, and all
sources advance together. All of it is DataFrame operations.

Rates are then rounded into whole copies: documents of a source stand in order of size, and each takes the copies that keep
the running count nearest to the running rate, which holds the error below half a document; last steps move copies of a
single size to close what is left. Ranks inside a source come from counts per (source, size, bucket), so that no source
is gathered in one task.

Defined results: null or empty texts have size 0 and are taken 0 words; a null source is a source of its own and the last
one; equal rows count each for itself; with no words at all every target is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_settled, read, settle, shuffle_partitions

CAP = 3.0


def word_count(text: Column) -> Column:
    """Number of runs of non-white-space (ASCII)."""
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(blank, " "), lambda w: w != "")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """(source, source_size, rank): rank from 0 by code point, null last. Sorted by range; a window runs over the counts of ranges only."""
    n = shuffle_partitions(sources.sparkSession)
    last = F.col("source").isNull()
    spots = sources.repartitionByRange(n, last, "source").sortWithinPartitions(last, "source")
    spots = settle(spots.withColumn("_id", F.monotonically_increasing_id()))  # range in the upper bits, place in the lower 33
    spots = spots.withColumn("_range", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1))
    counts = spots.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_before"))
    return spots.join(F.broadcast(starts), "_range").select("source", "source_size", (F.col("_before") + F.col("_place")).alias("rank"))


def targets(sources: DataFrame, cap: float = CAP, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add weight and target to a table (source, source_size). One row a source; all steps are aggregations over it.

    Sources by code point take the weights in turn; a target stops at `cap` times the size, the excess is shared anew by
    weight until none is above. Each pass fixes at least one more source, so the loop ends.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    table = settle(ranked(sources).select("source", "source_size", weight.alias("weight")))
    full = F.col("source_size") * F.lit(cap)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, -1
    while True:  # water level: min(cap * size, weight * level) summed over sources meets the total
        over = (full <= F.col("weight") * level) if level else F.lit(False)
        got = table.agg(F.sum(F.when(over, full)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if got[2] == fixed or not got[1]:
            break
        fixed, level = got[2], max(0.0, total - (got[0] or 0.0)) / got[1]
        if not level:
            break
    return table.withColumn("target", F.least(full, F.col("weight") * level).cast("double"))


def balance(sizes: DataFrame, table: DataFrame, cap: float = CAP, steps: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """Add `tilt`, the multiplier, to (source, source_size, target): Newton on the dual over sizes (source, size, _m).

    Sizes are 1 or more, so that at ln(cap) every rate is cap and at ln(target / source_size) < 0 too few words are taken:
    the bracket holds the solution. A source whose target or size is 0 has no tilt.
    """
    live = (F.col("source_size") > 0) & (F.col("target") > 0)
    share = F.when(live, F.try_divide(F.col("target"), F.col("source_size")))
    now = table.withColumn("tilt", F.when(live, F.lit(0.0))).withColumn("_lo", F.least(F.lit(0.0), F.log(share))).withColumn("_hi", F.when(share > 1, F.lit(math.log(cap))).otherwise(F.lit(0.0))).withColumn("_off", F.lit(1.0))
    now = settle(now)
    n = now.count()
    grown = F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(math.log(cap))))
    for _ in range(steps):
        state = now.where("_off > 0").select(F.col("source").alias("_s"), "tilt")
        cells = sizes.where("size > 0").join(broadcast_if_small(state, n), F.col("source").eqNullSafe(F.col("_s")))
        words = F.col("_m") * F.col("size")
        free = F.col("tilt") * F.col("size") < math.log(cap)
        sums = cells.groupBy("_s").agg(F.sum(words * grown).alias("_taken"), F.sum(F.when(free, words * F.col("size") * grown).otherwise(0.0)).alias("_bend"))
        met = now.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.col("_taken") - F.col("target")
        off = F.when(F.abs(gap) > tolerance * F.col("target"), F.try_divide(F.abs(gap), F.col("target"))).otherwise(0.0)
        lo, hi = F.when(gap < 0, F.col("tilt")).otherwise(F.col("_lo")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("_hi"))
        met = met.withColumn("_lo", F.coalesce(lo, "_lo")).withColumn("_hi", F.coalesce(hi, "_hi")).withColumn("_off", F.coalesce(off, F.lit(0.0)))
        newton = F.col("tilt") - F.try_divide(gap, F.col("_bend"))
        middle = (F.col("_lo") + F.col("_hi")) / 2
        step = F.when((F.col("_bend") > 0) & (newton >= F.col("_lo")) & (newton <= F.col("_hi")), newton).otherwise(middle)
        # a bracket of one point, or a gap within the tolerance, is the end
        met = met.withColumn("_off", F.when(step == F.col("tilt"), F.lit(0.0)).otherwise(F.col("_off")))
        met = met.withColumn("tilt", F.when(F.col("_off") > 0, step).otherwise(F.col("tilt"))).select(*now.columns)
        after = settle(met)
        drop_settled(now)
        now = after
        if now.where("_off > 0").isEmpty():
            break
    return now.drop("_lo", "_hi", "_off")


def closer(by_size: DataFrame, cap: float) -> DataFrame:
    """Move whole copies of one size in each source, so that the words taken come as near the target as one size allows."""
    by_size = settle(by_size)
    off = by_size.groupBy(F.col("source").alias("_s")).agg((F.first("target") - F.sum(F.col("size") * (F.col("_low") * F.col("_m") + F.col("_extra")))).alias("_off"))
    room = F.when(F.col("_low") < F.floor(F.lit(cap)), F.col("_m") - F.col("_extra")).otherwise(F.lit(0))
    k = F.greatest(-F.col("_extra"), F.least(room, F.round(F.col("_off") / F.col("size")))).cast("long")
    moved = by_size.where("size > 0").join(off, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_k", k)
    rest = F.abs(F.col("_off") - F.col("_k") * F.col("size"))
    best = moved.groupBy(F.col("source").alias("_s")).agg(F.min(F.struct(rest.alias("_rest"), "size", "_k")).alias("_best"))
    best = best.select("_s", F.col("_best.size").alias("_z"), F.col("_best._k").alias("_k"))
    out = by_size.join(best, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    return out.withColumn("_extra", F.col("_extra") + F.coalesce(F.col("_k"), F.lit(0))).select(*by_size.columns)


def copies(sized: DataFrame, table: DataFrame, cap: float = CAP) -> DataFrame:
    """Whole copies for each row of (doc_id, source, size, ...): adds source_size, target, rate and copies."""
    also = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    spark = sized.sparkSession
    buckets = shuffle_partitions(spark)
    sized = sized.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    cells = settle(sized.groupBy("source", "size", "_bucket").agg(F.count("*").alias("_n")))
    # counts of a size come first, then positions of its buckets: two short windows instead of one over the documents
    by_size = cells.groupBy("source", "size").agg(F.sum("_n").alias("_m"))
    table = balance(by_size, table, cap)
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(math.log(cap)))))
    rates = table.select(F.col("source").alias("_s"), "source_size", "target", "tilt")
    by_size = by_size.join(rates, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("rate", F.when(F.col("size") > 0, F.coalesce(tilted, F.lit(0.0))).otherwise(0.0))
    run = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, W.currentRow)
    part = F.col("_m") * (F.col("rate") - F.floor("rate"))
    up = F.sum(part).over(run)
    by_size = by_size.withColumn("_up", up).withColumn("_part", part)
    extra = F.least(F.col("_m"), F.greatest(F.lit(0), F.floor(F.col("_up") + 0.5) - F.floor(F.col("_up") - F.col("_part") + 0.5)))
    by_size = by_size.select("source", "size", "source_size", "target", "rate", "_m", extra.cast("long").alias("_extra"), F.floor("rate").alias("_low"))
    for _ in range(3):
        by_size = closer(by_size, cap)
    by_size = by_size.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "_extra", "_low", "source_size", "target", "rate")
    before = W.partitionBy("source", "size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    spots = cells.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    spots = spots.join(by_size, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_bucket").alias("_b"), "_start", "_extra", "_low", "source_size", "target", "rate")
    own = W.partitionBy("source", "size", "_bucket").orderBy("doc_id", *also)
    ranked = sized.withColumn("_rank", F.row_number().over(own) - 1)
    out = ranked.join(spots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_bucket") == F.col("_b")))
    more = (F.col("_rank") + F.col("_start") < F.col("_extra")).cast("long")
    return out.withColumn("copies", F.when(F.col("size") > 0, F.col("_low") + more).otherwise(0).cast("long")).select("doc_id", *also, "source", "size", "source_size", "target", "rate", "copies")


def mix(docs: DataFrame, cap: float = CAP, row_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken for all documents, with the number of the row if named."""
    sized = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([row_col] if row_col else []), "source", word_count(F.col("text")).alias("size")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return copies(sized, targets(sources, cap), cap).withColumn("taken", F.col("copies") * F.col("size"))


def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
