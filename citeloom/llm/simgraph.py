"""Exact similarity links and connected components behind a candidate index.

An index row (key, ent, n) says that the set `ent` of size n stands under `key`; any two sets that may link share a key.
Sets under a key are not joined all with all:

- Keys of more than `block` sets go through star rounds: each key names a leader, its members are verified against it, and
  what links is contracted. Rounds go on as long as they link anything and such keys still span several components.
- Keys of more than `crowd` sets are then compared in tiles of at most 2 * block rows, by sketches that cannot miss a link.
  A tile gives a forest of the likeliest pairs, which joins what its near pairs join with fewer rows than it has sets. When
  these are verified and contracted, a tile names the sets that are still near one of another component, and these are
  compared as whole sets inside the tile, which gives a forest of links. No step gives more rows than it takes: near pairs
  that do not link, whose number is the square of a group's, never leave a task.
- Small keys meet by an equi-join, across components only.

All links are verified on the whole sets. Links, labels and components stay distributed; each step is written to the shared
folder, so a lost executor repeats one step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITS, SMALL_SET, broadcast_if_small, drop_settled, parity, settle, shuffle_partitions, task

CROWD, BLOCK, STARS = 16, 2048, 8
#: Items of the sets that one side of a tile of whole sets holds (8 MB), unless a single set has more.
MOST_ITEMS = 1 << 20
#: Edges that one task joins (8 MB); above that, star rounds over all tasks.
FEW_EDGES = 500_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and the smallest node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def connected(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component.

    At most `few` edges are joined by one task. More go through alternating large and small stars; every step is a minimum
    per node (combined map-side) and an equi-join.
    """

    @task("simgraph")
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(c).to_numpy() for c in (0, 1)]) for b in batches]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in smallest(*np.concatenate(parts, axis=1))], ["node", "root"])

    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= few:
        out = settle(now.coalesce(1).mapInArrow(join, "node long, root long"))
        drop_settled(now)
        return out
    while not stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        small = settle(small)
        drop_settled(now)
        now = small
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether each node of edges (a, b), a > b, has one edge, and no b is an a: then b is the smallest node of its component."""
    roots = edges.select(F.col("b").alias("a")).distinct().withColumn("_root", F.lit(True))
    more = edges.groupBy("a").agg(F.count("*").alias("_n")).join(roots, "a", "left").where("_n > 1 or _root")
    return more.isEmpty()


def shared_rows(index: DataFrame) -> DataFrame:
    """Index rows whose key holds two sets or more, once each."""
    index = settle(index)
    keys = index.groupBy("key").agg(F.min("ent").alias("_lo"), F.max("ent").alias("_hi")).where("_lo <> _hi").select("key")
    out = settle(index.join(keys, "key", "left_semi").distinct())
    drop_settled(index)
    return out


def near_rows(size: np.ndarray, label: np.ndarray, side: np.ndarray, odd: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, positions near it, distances) of a tile's sets that may link: side 1 meets side 2, side 3 both; across labels only.

    The caller may merge labels meanwhile.
    """
    words = BITS // 64
    fold = np.array([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in odd]).view(np.uint64)
    large = size > SMALL_SET
    at = np.cumsum(large) - 1
    whole = np.array([odd[k] for k in np.flatnonzero(large)]).view(np.uint64) if large.any() else None
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    for k in range(0, len(left), 32):
        i = left[k : k + 32]
        apart = np.bitwise_count(fold[i, None, :] ^ fold[None, right, :]).sum(2, dtype=np.int64)
        if whole is not None:
            p, q = np.flatnonzero(large[i]), np.flatnonzero(large[right])
            if len(p) and len(q):
                for x in p:
                    apart[x, q] = np.bitwise_count(whole[at[i[x]]] ^ whole[at[right[q]]]).sum(1, dtype=np.int64)
        n, m = size[i, None], size[None, right]
        ok = (apart * (den + num) <= (n + m) * (den - num)) & (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (label[i, None] != label[None, right])
        for x in np.flatnonzero(ok.any(1)):
            near = np.flatnonzero(ok[x])
            near = near[label[right[near]] != label[i[x]]]
            if len(near):
                yield int(i[x]), right[near], apart[x, near]


def merge(label: np.ndarray, a: int, near: np.ndarray) -> np.ndarray:
    """The first of each label among the positions `near`; their labels become that of a."""
    kinds, first = np.unique(label[near], return_index=True)
    label[np.isin(label, kinds)] = label[a]
    return near[first]


def near_pairs(size: np.ndarray, comp: np.ndarray, side: np.ndarray, odd: list[np.ndarray], num: int, den: int, forest: bool) -> list[tuple[int, int]]:
    """Positions of pairs of a tile that may link, across components only.

    forest: of the pairs between two components that earlier pairs have not joined, the one of the closest sketches.
    """
    label = np.unique(comp, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for a, near, apart in near_rows(size, label, side, odd, num, den):
        if forest:
            near = merge(label, a, near[np.argsort(apart, kind="stable")])
        out.extend((a, int(b)) for b in near)
    return out


def linked_pairs(size: np.ndarray, comp: np.ndarray, side: np.ndarray, items: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Positions of pairs of a tile that link, counted on the whole sets: a forest that joins what all its links join."""
    label = np.unique(comp, return_inverse=True)[1]
    names, flat = np.unique(np.concatenate(items), return_inverse=True)
    parts = np.split(flat, np.cumsum(size)[:-1])
    mark, out = np.zeros(len(names), bool), []
    for a, near, _ in near_rows(size, label, side, [np.array(parity(x.view(np.uint64))) for x in items], num, den):
        mark[parts[a]] = True
        same = np.array([np.count_nonzero(mark[parts[b]]) for b in near])
        mark[parts[a]] = False
        near = near[den * same >= num * (size[a] + size[near] - same)]
        if len(near):
            out.extend((a, int(b)) for b in merge(label, a, near))
    return out


def by_tile(rows: DataFrame, by: list[str], of: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """of() for the rows of each group, dealt by the columns `by`; groups of one task pass one by one."""

    @task("simgraph")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [*rest, b]).combine_chunks()
            cut = np.zeros(max(0, t.num_rows - 1), bool)
            for c in by:
                x = t.column(c).to_numpy()
                cut |= x[1:] != x[:-1]
            at = (np.flatnonzero(cut) + 1).tolist()
            if at:
                yield from groups(t, [0, *at])
                t = t.slice(at[-1])
            rest = t.to_batches()
        if rest:
            t = pa.Table.from_batches(rest)
            yield from groups(t, [0, t.num_rows])

    def groups(t: pa.Table, at: list[int]) -> Iterator[pa.RecordBatch]:
        for lo, hi in zip(at, at[1:], strict=False):
            found = of(t.slice(lo, hi - lo).combine_chunks())
            if found is not None:
                yield found

    return rows.repartition(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(run, schema)


def tile_columns(t: pa.Table, last: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    size, comp, side = (t.column(c).to_numpy() for c in ("n", "comp", "side"))
    return size.astype(np.int64), comp, side, [x.values.to_numpy() for x in t.column(last)]


def pair_batch(t: pa.Table, found: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not found:
        return None
    x = t.column("ent").to_numpy()[np.array(found)]
    x.sort(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def forest_pairs(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of rows (key, tile, side, ent, n, comp, odd): the forest of each tile's near pairs."""
    return by_tile(tiles, ["key", "tile"], lambda t: pair_batch(t, near_pairs(*tile_columns(t, "odd"), num, den, True)), "a long, b long")


def open_rows(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """Those rows of tiles, without sketches, that are near a row of another component."""
    names = ["key", "tile", "side", "ent", "n", "comp"]

    def of(t: pa.Table) -> pa.RecordBatch | None:
        size, comp, side, odd = tile_columns(t, "odd")
        kept = np.zeros(len(size), bool)
        for a, near, _ in near_rows(size, comp, side, odd, num, den):
            kept[a] = kept[near] = True
        return t.filter(pa.array(kept)).select(names).combine_chunks().to_batches()[0] if kept.any() else None

    return by_tile(tiles, ["key", "tile"], of, "key long, tile long, side int, ent long, n int, comp long")


def forest_links(rows: DataFrame, sets: DataFrame, num: int, den: int, most: int = MOST_ITEMS) -> DataFrame:
    """(a, b) that join what the links within each tile of open_rows() join; sets: (ent, items).

    Tiles of more than `most` items are cut into cells, so that a task holds few sets however large they are.
    """
    parts = settle(rows.groupBy("key", "tile").agg(F.ceil(F.sum("n") / most).alias("parts")))
    wide = rows.join(broadcast_if_small(parts, parts.count(), 500_000), ["key", "tile"])
    many = wide.where("parts > 1").withColumn("_own", F.pmod(F.xxhash64("ent", F.lit(1)), F.col("parts"))).withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = wide.where("parts = 1").withColumn("cell", F.lit(0).cast("long"))
    names = ["key", "tile", "cell", "side", "ent", "n", "comp"]
    for side, cell in ((1, "_own * parts + _to"), (2, "_to * parts + _own")):
        cells = cells.select(*names).unionByName(many.where(F.col("side").bitwiseAND(side) > 0).withColumn("side", F.lit(side)).withColumn("cell", F.expr(cell)).select(*names))
    cells = cells.join(sets.dropDuplicates(["ent"]), "ent")
    return by_tile(cells, ["key", "tile", "cell"], lambda t: pair_batch(t, linked_pairs(*tile_columns(t, "items"), num, den)), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked): den * intersection >= num * union, counted on the whole sets."""
    one = sets.select(F.col("ent").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("ent").alias("b"), F.col("items").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    linked = den * same >= num * (F.size("x") + F.size("y") - same)
    return pairs.join(one, "a").join(two, "b").select("a", "b", linked.alias("linked")).distinct()


def components(shared: DataFrame, entities: DataFrame, fetch: Callable[[DataFrame], DataFrame], num: int, den: int, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(node, root) over sets that link with another, at Jaccard similarity num/den or more.

    `shared` comes from shared_rows(); `entities` has (ent, n, odd), odd a parity sketch; fetch(table of ent) gives (ent,
    items) for those sets. A pair goes to the exact count only if its sketches allow the similarity: sets that differ in
    d items differ in d bits at most, so this test drops no link.
    """
    state = shared.withColumn("comp", F.col("ent"))
    done, links, owned = None, None, []
    sizes = F.expr(f"{den} * least(n, m) >= {num} * greatest(n, m)")
    one = entities.select(F.col("ent").alias("a"), F.col("n").alias("na"), F.col("odd").alias("x"))
    two = entities.select(F.col("ent").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("y"))
    near = F.expr(f"size(x) <> size(y) or aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v) * {den + num} <= (na + nb) * {den - num}")

    def verify(pairs: DataFrame) -> bool:
        """Whether new links are found."""
        nonlocal done, links
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        close = settle(pairs.join(one, "a").join(two, "b").where(near).select("a", "b"))
        if close.isEmpty():
            return False
        sets = fetch(close.select(F.col("a").alias("ent")).unionByName(close.select(F.col("b").alias("ent"))).distinct())
        seen = settle(verified(close, sets, num, den))
        drop_settled(close)
        done = seen.select("a", "b") if done is None else done.unionByName(seen.select("a", "b"))
        new = seen.where("linked").select("a", "b")
        if new.isEmpty():
            return False
        links = new if links is None else links.unionByName(new)
        return True

    def contract(state: DataFrame) -> DataFrame:
        """New components; keys that lie within one are done with."""
        nonlocal owned
        roots = connected(links).withColumnRenamed("node", "ent")
        now = settle(state.drop("comp").join(roots, "ent", "left").withColumn("comp", F.coalesce("root", "ent")).drop("root"))
        open_keys = now.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("key")
        out = settle(now.join(open_keys, "key", "left_semi"))
        drop_settled(now, *owned)
        owned = [out]
        return out

    for k in range(STARS):
        lead = F.min(F.struct(F.xxhash64("ent", "key", F.lit(k)).alias("h"), "ent", "n", "comp")).alias("lead")
        leader = state.groupBy("key").agg(F.count("*").alias("c"), lead).where(F.col("c") > block)
        leader = settle(leader.select("key", F.col("lead.ent").alias("a0"), F.col("lead.n").alias("m"), F.col("lead.comp").alias("lead_comp")))
        if leader.isEmpty():
            break
        met = state.join(broadcast_if_small(leader, leader.count(), 100_000), "key").where("comp <> lead_comp").where(sizes)
        if not verify(met.select(F.least("a0", "ent").alias("a"), F.greatest("a0", "ent").alias("b"))):
            break
        state = contract(state)

    for forest in (True, False):
        crowded = settle(state.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > crowd))
        if crowded.isEmpty():
            break
        blocks = F.ceil(F.col("c") / block)
        wide = state.join(broadcast_if_small(crowded.select("key", blocks.alias("blocks")), crowded.count(), 500_000), "key")
        own = F.pmod(F.xxhash64("ent"), F.col("blocks"))
        # a key of one block is one tile; in others, what lies outside the largest component meets all blocks
        part = wide.where("blocks > 1").groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("_big"))
        many = wide.where("blocks > 1").join(part, "key").withColumn("_own", own)
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        ask = many.where("comp <> _big.comp").withColumn("_to", F.explode(every)).withColumn("tile", F.col("_own") * F.col("blocks") + F.col("_to")).withColumn("side", F.lit(1))
        base = many.withColumn("_to", F.explode(every)).withColumn("tile", F.col("_to") * F.col("blocks") + F.col("_own")).withColumn("side", F.lit(2))
        cols = ["key", "tile", "side", "ent", "n", "comp"]
        tiles = wide.where("blocks = 1").withColumn("tile", F.lit(0).cast("long")).withColumn("side", F.lit(3)).select(*cols)
        tiles = tiles.unionByName(ask.select(*cols)).unionByName(base.select(*cols)).join(entities.select("ent", "odd"), "ent")
        if forest:
            if verify(forest_pairs(tiles, num, den)):
                state = contract(state)
            continue
        left = settle(open_rows(tiles, num, den))
        if not left.isEmpty():
            new = settle(forest_links(left, fetch(left.select("ent").distinct()), num, den).distinct())
            if not new.isEmpty():
                links = new if links is None else links.unionByName(new)
                state = contract(state)
        drop_settled(left)
    small = state.groupBy("key").count().where(F.col("count") <= crowd).select("key")
    rows = settle(state.join(small, "key", "left_semi"))
    left = rows.select("key", F.col("ent").alias("a0"), "n", F.col("comp").alias("c0"))
    right = rows.select("key", F.col("ent").alias("b0"), F.col("n").alias("m"), F.col("comp").alias("c1"))
    met = left.join(right, "key").where("c0 < c1").where(sizes)
    verify(met.select(F.least("a0", "b0").alias("a"), F.greatest("a0", "b0").alias("b")))
    return connected(links) if links is not None else shared.sparkSession.createDataFrame([], "node long, root long")
