"""Passages that repeat across documents: MinHash banding over paragraphs, of lines and of runs of words.

A paragraph is a line of a text with `MIN_WORDS` words or more (a passage; headings and footers of a few words are not).
Equal shingle sets collapse to one entity. MinHash signatures are cut into bands tuned for recall; paragraphs that share
a band are candidates, verified by exact Jaccard similarity on five-word shingles (see simgraph), and grouped into
components. Of each component the first paragraph by (doc_id, para) stays, the others are marked for removal.

Line breaks hide passages that are wrapped into short lines, cut differently or lie inside longer lines. So every window of
`RUN` words of a text, whatever its line breaks, is a paragraph, too. Its signature is one band of one MinHash over its
`ANCHOR`-word shingles: equal windows always collide, and neighbouring windows share most minima, so that a text has few
(`anchors`). Colliding places are verified against the first place of their key by (doc_id, place): anchors in step with
it form chains, whose words are equal, and the words around a chain are compared one by one. A chain that so reaches RUN
words is a passage; it is removed, the first place stays. Anchors whose match is shorter may yet share a run with a third
row; all windows around them are compared by equality. So every run of RUN words that two rows share meets a passage, and
what is removed has an equal that stays: each removal points to an earlier row.

Passages of the second kind have para = -1 - start, and n_shingles counts their five-word windows (of those that stay, in the longest copy); paragraphs of the first
have the number of their line. `row` names a row of the table (rows of equal id and text are numbered).

Defined results: null and empty texts have no paragraphs; equal rows repeat their paragraphs, which are removed but for
the first; rows of the result exist only for paragraphs that repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, broadcast_if_small, drop_settled, mix64, parity, read, release, settle, slices, task, windows, words_of
from .jaccard_join import REMEMBERED, clashes, entity, renamed
from .simgraph import components, shared_rows

WIDTH, NUM, DEN, MIN_WORDS, RECALL, MOST_HASHES = 5, 80, 100, 30, 0.998, 64
#: A run of RUN words has RUN - ANCHOR + 1 = ANCHOR windows of ANCHOR words, one of which is an anchor in any text.
RUN, ANCHOR = 51, 26
AROUND = RUN - ANCHOR


def tune_bands(threshold: float, recall: float, most: int, noise: float = 0.2) -> tuple[int, int]:
    """(bands, rows): of those that reach the recall at the threshold within `most` hashes, the fewest candidates at `noise`."""
    fits = [(b, r) for r in range(1, 12) for b in range(1, most // r + 1) if 1 - (1 - threshold**r) ** b >= recall]
    least = {r: min(b for b, q in fits if q == r) for _, r in fits}
    return min(((b, r) for r, b in least.items()), key=lambda x: (1 - (1 - noise ** x[1]) ** x[0]) * 40 + x[0])


def paragraphs(words: Words, width: int, min_words: int) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(text, line, start, end, set) of the lines with enough words; places count code points, a set is sorted shingles."""
    buf = np.frombuffer(words.raw, np.uint8)
    ends = np.flatnonzero(buf == 10)  # every text has its last break
    starts = np.concatenate([[0], ends[:-1] + 1])
    first = np.searchsorted(words.starts, np.concatenate([starts, [len(buf)]]))
    chosen = np.flatnonzero(np.diff(first) >= min_words)
    if not len(chosen):
        return []
    text = np.searchsorted(words.text_at, starts[chosen], "right") - 1
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    base = points[words.text_at[text]]
    line = chosen - np.searchsorted(starts, words.text_at[text])
    rolled, out = windows(words.hashes, width), []
    for k, t, n, a, b in zip(chosen.tolist(), text.tolist(), line.tolist(), (points[starts[chosen]] - base).tolist(), (points[ends[chosen]] - base).tolist(), strict=True):
        out.append((t, n, a, b, np.unique(rolled[first[k] : first[k + 1] - width + 1])))
    return out


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of band keys for each of the sets, none of them empty; minima of a hash are taken over all sets at once."""
    if not sets:
        return np.empty((0, bands), np.uint64)
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    seeds = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = [np.minimum.reduceat(mix64(flat ^ s), at) for s in seeds]
    keys = np.empty((len(sets), bands), np.uint64)
    for k in range(bands):
        key = np.full(len(sets), k, np.uint64)
        for j in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + low[k * rows + j])
        keys[:, k] = key
    return keys


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x, span = f(x[:-span], x[span:]), 2 * span
    rest = width - span
    return f(x[:-rest], x[rest:]) if rest else x


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the minimum of some `width` neighbours: any `width` neighbours have one, whatever stands around them."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    edge = np.zeros(width - 1, np.uint64)
    low = np.concatenate([edge, slide(hashes, width, np.minimum), edge])
    return np.flatnonzero(slide(low, width, np.maximum) == hashes)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with `row`: a name of (doc_id, text); rows equal in both are numbered."""
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    again = settle(docs.groupBy("row").agg(F.count("*").alias("_n")).where("_n > 1").select("row"))
    n = again.count()
    if not n:
        return docs
    again = broadcast_if_small(again, n)
    twins = docs.join(again, "row", "left_semi").withColumn("_copy", F.row_number().over(W.partitionBy("row").orderBy("doc_id", "text")))
    twins = twins.withColumn("row", F.when(F.col("_copy") > 1, F.xxhash64("row", "_copy")).otherwise(F.col("row"))).drop("_copy")
    return docs.join(again, "row", "left_anti").unionByName(twins).select(*docs.columns)


def asked(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """docs with the arrays of ids (row, column); broadcast only if their entries, and so their bytes, are few."""
    rows, entries = ids.agg(F.count("*"), F.sum(F.size(column))).first()
    small = rows <= 500_000 and (entries or 0) <= 4_000_000
    return docs.join(F.broadcast(ids) if small else ids, "row")


def chains(hits: DataFrame, reach: int, *more: Column) -> DataFrame:
    """(row, doc_id, row0, doc0, delta, a, b) of hits (row, doc_id, pos, row0, doc0, pos0): neighbours in step, at most `reach` apart.

    more: other aggregates over the hits of a chain.
    """
    hits = hits.withColumn("delta", F.col("pos0") - F.col("pos"))
    order = W.partitionBy("row", "row0", "delta").orderBy("pos")
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(order) > reach, F.lit(True)).cast("int")
    hits = hits.withColumn("_fresh", fresh).withColumn("_chain", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return hits.groupBy("row", "doc_id", "row0", "doc0", "delta", "_chain").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), *more).drop("_chain")


def first_place(of: str, *more: str) -> Column:
    """The first by (doc_id, place), rows without id last, with more columns of its row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", F.col(of).alias("pos"), *more)).alias("lead")


def passages(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of repeats() for runs of RUN words that two rows or more of (doc_id, text, row) share; marks: (row, doc_id, pos, key)."""
    spark = docs.sparkSession
    lead = marks.groupBy("key").agg(first_place("pos"), F.min("row").alias("_lo"), F.max("row").alias("_hi")).where("_lo <> _hi").select("key", "lead")
    first = lead = settle(lead)  # a table of its own, so that the join can split a key that a third of the rows hold
    hits = marks.join(lead, "key").where("row <> lead.row")
    hits = settle(hits.select("key", "row", "doc_id", "pos", F.col("lead.row").alias("row0"), F.col("lead.doc_id").alias("doc0"), F.col("lead.pos").alias("pos0")))
    steps = settle(chains(hits, ANCHOR).withColumn("b", F.col("b") + ANCHOR).withColumn("_l", (F.col("a") + F.col("delta")) * 2).withColumn("_r", (F.col("b") + F.col("delta")) * 2 + 1))

    @task("passage_dedup")
    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Up to AROUND words before a place (even want) or after it (odd), nearest first, and the code points where they begin or end."""
        for b in slices(batches, 200, 0):
            words, out = words_of(b.column(0).to_pylist()), []
            for k, (row, wants) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                h, (starts, ends) = words.hashes[words.of(k)].astype(np.uint32), words.places(k)
                for want in wants:
                    at = want // 2
                    if want % 2:
                        out.append((row, want, h[at : at + AROUND].tobytes(), ends[at - 1 : at + AROUND]))
                    else:
                        to = max(0, at - AROUND)
                        out.append((row, want, h[to:at][::-1].tobytes(), starts[to : at + 1][::-1]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)], ["row", "want", "near", "place"])

    wants = steps.select(F.col("row0").alias("row"), F.explode(F.array("_l", "_r")).alias("want")).distinct()
    wants = settle(wants.groupBy("row").agg(F.collect_set("want").alias("wants")))  # at most two for each anchor of a text
    seen = settle(asked(docs, wants, "wants").select("text", "row", "wants").mapInArrow(context, "row long, want long, near binary, place array<long>"))
    places = seen.count()

    def beside(t: DataFrame, *columns: str) -> DataFrame:
        """t with columns of seen for both ends of a chain, at its first place."""
        for side in ("_l", "_r"):
            end = seen.select(F.col("row").alias("row0"), F.col("want").alias(side), *(F.col(c).alias(c + side) for c in columns))
            t = t.join(broadcast_if_small(end, places, 200_000), ["row0", side])
        return t

    @task("passage_dedup")
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many words around a chain are equal to those around its first place (l, r), and where in the text it then lies."""
        names = ["row", "doc_id", "row0", "doc0", "delta", "a", "b", "l", "r", "start", "end"]
        for b in slices(batches, 200, 2):
            words, out = words_of(b.column(2).to_pylist()), []
            for k, (row, i, each) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                h, (starts, ends) = words.hashes[words.of(k)].astype(np.uint32), words.places(k)
                for c in each:
                    x, y = c["a"], c["b"]
                    left, right = np.frombuffer(c["near_l"], np.uint32), np.frombuffer(c["near_r"], np.uint32)
                    grown = []
                    for own, other in ((h[max(0, x - AROUND) : x][::-1], left), (h[y : y + AROUND], right)):
                        n = min(len(own), len(other))
                        off = np.flatnonzero(own[:n] != other[:n])
                        grown.append(int(off[0]) if len(off) else n)
                    out.append((row, i, c["row0"], c["doc0"], c["delta"], x, y, *grown, int(starts[x - grown[0]]), int(ends[y + grown[1] - 1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [()] * 11], names)

    wide = beside(steps, "near").groupBy("row").agg(F.collect_list(F.struct("row0", "doc0", "delta", "a", "b", "near_l", "near_r")).alias("each"))  # at most a text's anchors
    rows = steps.select("row").distinct()
    some = docs.join(broadcast_if_small(settle(rows), rows.count()), "row", "left_semi")
    grown = some.join(wide, "row").select("row", "doc_id", "text", "each").mapInArrow(compare, ", ".join(f"{c} long" for c in ("row", "doc_id", "row0", "doc0", "delta", "a", "b", "l", "r", "start", "end")))
    grown = settle(grown.withColumn("n", F.col("b") - F.col("a") + F.col("l") + F.col("r")))
    spot = ("row", "doc_id", "start", "end", "wa", "wb", "row0", "doc0", "start0", "end0")
    spans = grown.where(f"n >= {RUN}").withColumn("_l", (F.col("a") + F.col("delta")) * 2).withColumn("_r", (F.col("b") + F.col("delta")) * 2 + 1)
    at = lambda side, n: F.get(f"place_{side}", F.col(n).cast("int"))
    spans = beside(spans, "place").withColumn("start0", at("l", "l")).withColumn("end0", at("r", "r"))
    spans = spans.withColumn("wa", F.col("a") - F.col("l")).withColumn("wb", F.col("b") + F.col("r")).select(*spot)

    # keys with a shorter match somewhere: all their places, but for those where every window equals the first place's
    step = hits.withColumn("delta", F.col("pos0") - F.col("pos")).alias("h").join(grown.select("row", "row0", "delta", "a", "b", "l", "r", F.col("n").alias("_n")).alias("g"), ["row", "row0", "delta"]).where("pos >= a and pos < b")
    short = step.where(f"_n < {RUN}").select("key").distinct()
    whole = step.where(f"pos - {AROUND} >= a - l and pos + {RUN} <= b + r").select("row", "pos")
    open_ = marks.join(short, "key", "left_semi").join(whole, ["row", "pos"], "left_anti").groupBy("row").agg(F.collect_set("pos").alias("wants"))  # at most a text's anchors
    open_ = settle(open_)

    @task("passage_dedup")
    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of RUN words that have a wanted anchor as their minimum."""
        for b in slices(batches, 200, 1):
            words = words_of(b.column(1).to_pylist())
            cols: list[list] = [[np.empty(0, np.int64)] for _ in range(5)]
            owner: list = []
            for k, (i, row, wants) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                own = words.hashes[words.of(k)]
                long, short = windows(own, RUN).view(np.int64), windows(own, ANCHOR)
                low = slide(short, AROUND + 1, np.minimum)
                pos = [np.arange(max(0, p - AROUND), min(p + 1, len(long))) for p in wants]
                pos = np.unique(np.concatenate([x[low[x] == short[p]] for x, p in zip(pos, wants, strict=True)]))
                starts, ends = words.places(k)
                for c, x in zip(cols, (long[pos], np.full(len(pos), row, np.int64), pos, starts[pos], ends[pos + RUN - 1]), strict=True):
                    c.append(x)
                owner += [i] * len(pos)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), *(pa.array(np.concatenate(c)) for c in cols)], ["doc_id", "h", "row", "pos", "start", "end"])

    found = settle(asked(docs, open_, "wants").select("doc_id", "text", "row", "wants").mapInArrow(around, "doc_id long, h long, row long, pos long, start long, end long"))
    lead = found.groupBy("h").agg(first_place("pos", "start", "end"), F.min("row").alias("_lo"), F.max("row").alias("_hi")).where("_lo <> _hi").select("h", "lead")
    again = settle(lead)
    more = found.join(again, "h").where("row <> lead.row").select("row", "doc_id", "pos", "start", "end", *(F.col(f"lead.{c}").alias(n) for c, n in (("row", "row0"), ("doc_id", "doc0"), ("pos", "pos0"), ("start", "start0"), ("end", "end0"))))
    # both texts advance within a chain, so its ends are those of its first and last window
    more = settle(chains(more, 1, *(F.min(c).alias(c) for c in ("start", "start0")), *(F.max(c).alias(c) for c in ("end", "end0"))))
    spans = settle(spans.unionByName(more.withColumn("wa", F.col("a")).withColumn("wb", F.col("b") + RUN).select(*spot)).distinct())

    def unions(t: DataFrame, row: str, start: str, end: str) -> DataFrame:
        """t with `_part`, the same for overlapping spans of a row."""
        order = W.partitionBy(row).orderBy(start, end)
        before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
        fresh = F.coalesce(F.col(start) >= before, F.lit(True)).cast("int")
        return t.withColumn("_fresh", fresh).withColumn("_part", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_fresh")

    # first places stay, each union of them a component; what goes is in the component of its first part
    size = (F.max("wb") - F.min("wa") - WIDTH + 1).alias("n_shingles")
    firsts = spans.groupBy("row0", "doc0", "start0", "end0").agg(F.max(F.col("wb") - F.col("wa")).alias("n"))
    part = W.partitionBy("row0", "_part")
    firsts = settle(unions(firsts, "row0", "start0", "end0").withColumn("_a", F.min("start0").over(part)).withColumn("_b", F.max("end0").over(part)))
    name = lambda c: (-1 - F.col(c)).cast("int")
    stay = firsts.groupBy("row0", "doc0", "_a", "_b").agg((F.max("n") - WIDTH + 1).alias("n_shingles"))
    stay = stay.select(F.col("doc0").alias("doc_id"), F.col("row0").alias("row"), name("_a").alias("para"), F.col("_a").alias("start"), F.col("_b").alias("end"), "n_shingles", F.col("doc0").alias("component_doc"), name("_a").alias("component_para"), F.lit(False).alias("removed"))
    gone = unions(spans, "row", "start", "end").join(firsts.select("row0", "start0", "end0", "_a"), ["row0", "start0", "end0"])
    head = F.min(F.struct("start", "doc0", "_a")).alias("head")
    gone = gone.groupBy("doc_id", "row", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end"), size, head)
    gone = gone.select("doc_id", "row", name("start").alias("para"), "start", "end", "n_shingles", F.col("head.doc0").alias("component_doc"), name("head._a").alias("component_para"), F.lit(True).alias("removed"))
    out = settle(stay.unionByName(gone))
    drop_settled(hits, steps, wants, seen, grown, open_, found, more, spans, firsts, first, again)
    release(spark)
    return out


def repeats(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, para, start, end, n_shingles, component_doc, component_para, removed: a row for each repeated paragraph."""
    docs = numbered(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text"))
    bands, rows = tune_bands(num / den, RECALL, MOST_HASHES)

    @task("passage_dedup")
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of all paragraphs, with band keys and sketch at the first of equal sets within a partition; for each text its anchors (para null)."""
        own: set[int] = set()
        for b in slices(batches, 500, 1):
            ids, names = b.column(0).to_pylist(), b.column(2).to_pylist()
            words = words_of(b.column(1).to_pylist())
            lines = paragraphs(words, width, min_words)
            ents, first = [entity(x[4]) for x in lines], []
            for k, (ent, _) in enumerate(ents):
                if ent not in own:
                    if len(own) < REMEMBERED:
                        own.add(ent)
                    first.append(k)
            keys, odd = [None] * len(lines), [None] * len(lines)
            for k, row in zip(first, band_keys([lines[k][4] for k in first], bands, rows).view(np.int64), strict=True):
                keys[k], odd[k] = row, parity(lines[k][4])
            short = windows(words.hashes, ANCHOR)
            marks = []
            for k in range(b.num_rows):
                at = words.of(k)
                part = short[at.start : max(at.start, at.stop - ANCHOR + 1)]
                pos = anchors(part, AROUND + 1)
                if len(pos):
                    marks.append((ids[k], names[k], part[pos].view(np.int64), pos))
            size = len(marks)
            cols = [[*(ids[x[0]] for x in lines), *(m[0] for m in marks)], [*(names[x[0]] for x in lines), *(m[1] for m in marks)], [*(x[1] for x in lines), *[None] * size], [*(x[2] for x in lines), *[None] * size], [*(x[3] for x in lines), *[None] * size]]
            cols += [[*(e[0] for e in ents), *[None] * size], [*(e[1] for e in ents), *[None] * size], [*(len(x[4]) for x in lines), *[None] * size], [*keys, *(m[2] for m in marks)], [*odd, *(m[3] for m in marks)]]
            kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "row", "para", "start", "end", "ent", "check", "n", "keys", "odd"])

    both = settle(docs.mapInArrow(scan, "doc_id long, row long, para int, start long, end long, ent long, check long, n long, keys array<long>, odd array<long>"))
    table = both.where("para is not null").drop("keys", "odd")
    clashing = clashes(table)
    lines = both.where("para is not null")
    if clashing:
        bad, again = F.col("ent").isin(*clashing), F.udf(renamed, "long")  # a handful of rows
        lines = lines.where(~bad).unionByName(lines.where(bad).withColumn("ent", again("ent", "check")))
    table = lines.select("doc_id", "row", "para", "start", "end", "ent", "n")
    signed = lines.where("keys is not null").select("keys", "ent", F.col("n").cast("int").alias("n"), "odd")
    shared = shared_rows(signed.select(F.explode("keys").alias("key"), "ent", "n"))
    wanted = shared.select("ent").distinct()
    entities = signed.join(wanted, "ent").groupBy("ent").agg(F.first("n").alias("n"), F.first("odd").alias("odd"))
    places = table.join(wanted, "ent").groupBy("ent").agg(F.min("row").alias("row"))
    entities = settle(entities.join(places, "ent").select("ent", "n", "odd", "row"))

    @task("passage_dedup")
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500, 0):
            want, out = [set(x) for x in b.column(1).to_pylist()], {}
            for x in paragraphs(words_of(b.column(0).to_pylist()), width, min_words):
                if (ent := entity(x[4], clashing)[0]) in want[x[0]]:
                    out[ent] = x[4].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.list_(pa.int64()))], ["ent", "items"])

    def fetch(wanted: DataFrame) -> DataFrame:
        ids = settle(entities.join(wanted, "ent").groupBy("row").agg(F.collect_set("ent").alias("ents")))  # at most a text's paragraphs
        return asked(docs, ids, "ents").select("text", "ents").mapInArrow(whole, "ent long, items array<long>")

    roots = components(shared, entities, fetch, num, den)
    release(docs.sparkSession)
    named = table.join(roots.withColumnRenamed("node", "ent"), "ent", "left").withColumn("_root", F.coalesce("root", "ent"))
    named = settle(named.drop("root", "ent"))
    place = F.struct("doc_id", "para", "row")
    group = named.groupBy("_root").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).where("_n > 1")
    out = named.join(group, "_root").select("doc_id", "row", "para", "start", "end", F.col("n").alias("n_shingles"), F.col("_first.doc_id").alias("component_doc"), F.col("_first.para").alias("component_para"), (place != F.col("_first")).alias("removed"))
    marks = both.where("para is null").select("row", "doc_id", F.explode(F.arrays_zip("keys", "odd")).alias("m")).select("row", "doc_id", F.col("m.odd").alias("pos"), F.col("m.keys").alias("key"))
    out = settle(out)
    drop_settled(named, roots, entities, shared)
    more = passages(docs, marks)
    drop_settled(both)
    return out.unionByName(more)


def strip(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the lines and passages that repeats() marks as removed; other columns stay. Only the marked row loses them."""
    gone = found.where("removed").groupBy(F.col("row").alias("_gone_row")).agg(F.array_sort(F.collect_set(F.struct("start", "end", "para"))).alias("_gone"))
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*docs.columns).alias("_all")))
    # a line goes with its line break, or with the one before if it is the last
    cut = F.expr("""aggregate(_gone, struct(array('') as s, 0L as at), (a, g) -> struct(
        concat(a.s, array(substring(text, int(a.at) + 1, greatest(0, int(g.start - a.at) - if(g.para >= 0 and g.end = length(text), 1, 0))))) as s,
        greatest(a.at, g.end + if(g.para >= 0, 1L, 0L)) as at), a -> array_join(concat(a.s, array(substring(text, int(a.at) + 1))), ''))""")
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(cut)
    out = rows.join(gone, F.col("row") == F.col("_gone_row"), "left").withColumn("_left", left)
    return out.select(*(F.col("_left").alias(c) if c == "text" else F.col("_all")[c].alias(c) for c in docs.columns))


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents"))
