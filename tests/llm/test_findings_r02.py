"""Cases of the second review: each failed before its finding was settled."""

import bisect
import collections
import hashlib
import math
import re
import time

import numpy as np
import pyarrow as pa

from citeloom.llm import html_text, jaccard_join, line_crf, mixing, nearest, packing, passage_dedup, pii, quality_rules, simgraph, url_filter
from citeloom.llm.common import parity, read, shingle_batch, slices, words_of

SF = "/root/testdata/sf0.001"


def test_slices_bound_rows_and_bytes():
    b = pa.RecordBatch.from_pydict({"t": ["x" * 600, None, "y" * 600, "z" * 5000, "", "w"]})
    got = [p.column(0).to_pylist() for p in slices([b, b.slice(0, 0)], 2, 0, 1000)]
    assert [x for p in got for x in p] == b.column(0).to_pylist()
    assert [len(p) for p in got] == [2, 1, 1, 2]


def test_words_by_bytes():
    texts = ["É a b  c\n", None, "", " \t", "x" * 90 + " " + "X" * 90, "one TWO\x0bthree"]
    words = words_of(texts)
    for k, t in enumerate(texts):
        starts, ends = words.places(k)
        assert [*zip(starts.tolist(), ends.tolist(), strict=True)] == [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
    long = words.hashes[words.of(4)]
    assert long[0] == long[1] and words_of(["two"]).hashes[0] == words.hashes[words.of(5)][1]


def test_quality_verdict_against_all_rules(spark):
    """kept, by rules written out again."""
    texts = {r.doc_id: r.text for r in read(spark, "/root/testdata/sf0.01", "documents").collect()}
    for r in quality_rules.op1_quality_rules(spark, "/root/testdata/sf0.01").collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = len(w)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        bad = r.base_failed or sum(map(t.count, "#*$%&|<>")) > n / 10 or t.count("!") + t.count("?") > 0.3 * n or len(re.findall("[A-Z]", t)) > len(re.findall("[a-z]", t))
        bad = bad or 10 * (len(lines) - len(set(lines))) > 3 * len(lines) or not 2 * n <= sum(map(len, w)) <= 15 * n or 5 * collections.Counter(w).most_common(1)[0][1] > 2 * n
        bad = bad or 10 * sum(bool(re.match(r"[^\x00-\x7f]", x) or re.search("[A-Za-z]", x)) for x in w) < 6 * n or t.count("...") + t.count("…") > 0.3 * n
        assert r.kept == (not bad), r.doc_id


def test_quality_sample_is_bounded(spark, tmp_path):
    spark.range(1000).selectExpr("id as doc_id", "'a b' as text").repartition(20).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert quality_rules.some_files(table).select("doc_id").distinct().count() in range(1, 500) and len(quality_rules.plan_cascade(table)) == len(quality_rules.RULES)
    derived = table.groupBy("doc_id").agg({"text": "max"}).withColumnRenamed("max(text)", "text")  # not a scan of files
    assert sorted(r.name for r in quality_rules.plan_cascade(derived)) == sorted(r.name for r in quality_rules.RULES)


def test_clashing_names():
    sets = shingle_batch(["a b c d e f", "g h i j k l"], 4)
    plain = [jaccard_join.entity(s) for s in sets]
    again = [jaccard_join.entity(s, frozenset({plain[0][0]}))[0] for s in sets]
    assert again == [jaccard_join.renamed(*plain[0]), plain[1][0]] and again[0] != plain[0][0]


def test_clashes_are_found(spark):
    rows = [(7, 1), (7, 2), (8, 3), (8, 3)]
    assert jaccard_join.clashes(spark.createDataFrame(rows, "ent long, check long")) == frozenset({7})


def test_crowded_tiles_miss_no_link():
    """Pairs of a forest join what all near pairs join; all near pairs hold every link."""
    rnd = np.random.default_rng(5)
    sets = []
    for size in (30, 1200):
        base = rnd.integers(0, 1 << 63, size, np.uint64)
        for _ in range(60):
            own = base.copy()
            at = rnd.integers(0, size, max(1, size // 12))
            own[at] = rnd.integers(0, 1 << 63, len(at), np.uint64)
            sets.append(np.unique(own))
    n = np.array([len(s) for s in sets])
    odd = [np.array(parity(s)) for s in sets]
    label, side = np.arange(len(sets)), np.full(len(sets), 3)
    near = {(min(p), max(p)) for p in simgraph.near_pairs(n, label, side, odd, 80, 100, False)}
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (n[i] + n[j] - k)}
    assert linked and {(min(p), max(p)) for p in linked} <= near

    def groups(pairs):
        root = list(range(len(sets)))
        for i, j in sorted(pairs):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    forest = simgraph.near_pairs(n, label, side, odd, 80, 100, True)
    assert groups(forest) == groups(near) and len(forest) < len(sets)


def test_large_keys_go_through_stars_and_tiles(spark):
    """Keys of more sets than a block holds give the components of brute force."""
    rnd, rows = np.random.default_rng(9), []
    base = [f"b{k}" for k in range(40)]
    for k in range(60):
        text = list(base)
        for at in rnd.integers(0, 40, rnd.integers(0, 3)):
            text[at] = f"z{rnd.integers(1 << 30)}"
        rows.append((k, " ".join(text)))
    sets = {i: s for (i, _), s in zip(rows, shingle_batch([t for _, t in rows], 4), strict=True)}
    items = spark.createDataFrame([(i, len(s), parity(s), s.view(np.int64).tolist()) for i, s in sets.items()], "ent long, n long, odd array<long>, items array<long>")
    shared = spark.createDataFrame([(1, i, len(s)) for i, s in sets.items()], "key long, ent long, n int")
    got = {r.node: r.root for r in simgraph.components(shared, items, lambda wanted: items.join(wanted, "ent").select("ent", "items"), 85, 100, crowd=4, block=8).collect()}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            k = len(np.intersect1d(sets[i], sets[j]))
            if i < j and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root[i], root[j]
                root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    size = collections.Counter(root.values())
    assert got == {i: r for i, r in root.items() if size[r] > 1} and len(got) > 10


def test_strip_takes_from_the_marked_row_only(spark):
    line = " ".join(f"w{k}" for k in range(40))
    own = [" ".join(f"o{i}x{k}" for k in range(40)) for i in range(3)]
    rows = [(1, line + "\n" + own[0]), (2, own[1] + "\n" + line), (2, own[2] + "\nlast"), (2, own[2] + "\nlast"), (None, "free"), (3, None)]
    docs = spark.createDataFrame([(i, t, "keep", 1) for i, t in rows], "doc_id long, text string, row string, para int")
    left = passage_dedup.strip(docs, passage_dedup.repeats(docs))
    assert left.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in left.collect()))
    assert got == sorted([(1, line + "\n" + own[0]), (2, own[1]), (2, own[2] + "\nlast"), (2, "last"), (0, "free"), (3, "")])


def test_pii_many_spans_in_one_text(spark):
    words = [f"word api_key={hashlib.sha256(str(k).encode()).hexdigest()} mail{k}@x.org" for k in range(3000)]
    began = time.time()
    text = pii.redact(spark.createDataFrame([(" ".join(words),)], "text string")).first().text
    assert text.count("<EMAIL>") == 3000 and text.count("<SECRET>") > 2900 and "@" not in text and time.time() - began < 60


def test_pii_overlaps(spark):
    """Base spans win; of proposals that overlap, one stays."""
    table = spark.createDataFrame([("ssn 123-45-6789 phone 030 1234567 iban DE89370400440532013000 x",)], "text string")
    r = pii.find(table).first()
    spans = [(s.start, s.end) for s in r.spans]
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert {"national_id", "iban"} <= {s.kind for s in r.spans}


PLAIN = "<html><body><div class='a1'><p>Choice of words {0} and more</p></div><div class='b2'><p>Body of {0} has many words {0} in it, as bodies do, and so it goes on, for as long as the one who writes has things to tell of {0} to those who read it, more than all around it holds.</p><p>Second {0} part.</p><p>Write to us any time.</p></div><div class='c3'><p>Company, all rights</p></div></body></html>"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_html_template_decides_without_telling_names(spark):
    rows = [(k, f"http://h.org/{k}", PLAIN.format(f"no{chr(97 + k)}")) for k in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(pages_of(spark, rows)).collect()}
    assert got == {k: f"Body of no{c} has many words no{c} in it, as bodies do, and so it goes on, for as long as the one who writes has things to tell of no{c} to those who read it, more than all around it holds.\n\nSecond no{c} part." for k, c in enumerate("abcdef")}
    assert all(html_text.main_text(h) != got[k] for k, _, h in rows)  # without a template it reads otherwise


def test_html_odd_pages(spark):
    rows = [(1, "http://h.org/", "<p>a"), (1, "http://h.org/", "<p>a"), (None, None, "<div>b</div>"), (2, "http://h.org/x", "<div>" * 50_000 + "deep"), (3, "http://h.org/y", "<a <a <p")]
    table = pages_of(spark, rows).selectExpr("*", "'x' as text", "1 as host", "2 as main")
    got = sorted(((r.page_id or 0, r.text) for r in html_text.extract(table).collect()))
    assert got[:4] == [(0, "b"), (1, "a"), (1, "a"), (2, "deep")] and html_text.extract(table.limit(0)).count() == 0


def test_url_long_paths_and_hosts():
    began = time.time()
    assert len(list(url_filter.candidates("a." * 100_000 + "com", "/x" * 100_000, 15, 4))) < 40
    assert time.time() - began < 2
    assert set(url_filter.candidates("www.Example.com".lower(), "/en/x/", 15, 4)) == {b"com/", b"com/en/", b"example.com/", b"example.com/en/", b"www.example.com/", b"www.example.com/en/"}


def test_url_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda rule: len(rule) % 3)
    url_filter.write_index(url_filter.RULES, str(tmp_path / "rules"))
    index = url_filter.Index(str(tmp_path / "rules"))
    keys = [r.encode() for r in url_filter.RULES] + [b"org/", b"net/xx/"]
    assert index.find(keys) == {k: v == "allow" for k, v in enumerate(url_filter.RULES.values())}
    assert (index.longest_host, index.longest_path) == (15, 4)


def test_url_odd_rows(spark):
    rows = [(1, "http://a.com/" + "x/" * 50_000), (1, "http://a.com/" + "x/" * 50_000), (None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'b' as host", "'c' as rule")
    got = url_filter.judge(table, url_filter.RULES)
    assert sorted((r.page_id or 0, r.rule) for r in got.select("page_id", "rule").collect()) == [(0, None), (1, "com/"), (1, "com/")]
    assert url_filter.judge(table.limit(0), url_filter.RULES).count() == 0


def test_crf_long_texts():
    model = line_crf.Model(np.random.default_rng(2).normal(size=3 * line_crf.N), 0.4)
    text = "\n".join(f"line {k} of it." * (k % 4) for k in range(3001))
    x, n = line_crf.text_features(text)
    scores, sizes = line_crf.line_scores(text, model.weights, 1000)
    assert np.allclose(scores, x @ model.weights) and (n == sizes).all()


def test_encoder_against_the_tokenizer():
    """All of sf0.001 and random strings of letters, marks, white space, other scripts and the added token."""
    import random

    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    fast, whole, rnd = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path()), random.Random(4)
    parts = ["a", "b", "1", "²", ".", "'s", "'", " ", "\n", "\t", "\xa0", "é", "À", "的", "😀", "̀", "<|endoftext|>", "<|"]
    texts = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist() + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    assert all(np.frombuffer(fast.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts)


def test_mixing_dual(spark):
    """Rates are min(3, exp(lambda * size)) with the multiplier of a plain bisection; targets are met before rounding."""
    table = read(spark, SF, "documents")
    got = mixing.mix(table).toPandas()
    assert got.groupby("source").rate.nunique().max() > 5
    for _, g in got[got["size"] > 0].groupby("source"):
        size, target = g["size"].to_numpy(float), g["target"].iloc[0]
        words = lambda t, size=size: (size * np.minimum(3, np.exp(np.minimum(t * size, 2)))).sum()
        lo, hi = -2.0, math.log(3)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if words(mid) < target else (lo, mid)
        assert np.allclose(g.rate, np.minimum(3, np.exp(np.minimum(hi * size, 2))), atol=1e-6)
        assert abs((g.rate * size).sum() - target) <= 1e-6 * target
        assert abs(g.taken.sum() - target) <= size.max() / 2 + 1


def test_mixing_targets_against_sql(spark):
    import duckdb

    sql = r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from read_parquet('%s/documents.parquet')),
    s as (select source, sum(size) as n, (row_number() over (order by source is null, source collate "C") - 1) %% 3 + 1 as w from d group by source),
    l as (select max(n) as top, sum(n) as total from s),
    -- the level at which min(3 n, w x) sums to the total: between breakpoints 3 n / w it is linear in x
    b as (select 3.0 * n / w as x from s), f as (select x, (select sum(least(3.0 * n, w * b.x)) from s) as filled from b),
    low as (select coalesce(max(x), 0) as x from f, l where filled <= total),
    level as (select (total - (select sum(case when 3.0 * n / w <= low.x then 3.0 * n else 0 end) from s)) / (select sum(case when 3.0 * n / w <= low.x then 0 else w end) from s) as x from low, l)
    select d.doc_id, d.size, s.n as source_size, least(3.0 * n, w * level.x) as target from d join s on d.source is not distinct from s.source, level"""
    for sf in (SF, "/root/testdata/sf0.01"):
        want = duckdb.sql(sql % sf).df().sort_values("doc_id")
        got = mixing.op9_entropy_mixing(spark, sf).toPandas().sort_values("doc_id")
        assert (got["size"].to_numpy() == want["size"].to_numpy()).all() and (got.source_size.to_numpy() == want.source_size.to_numpy()).all()
        assert np.allclose(got.target, want.target.astype(float), rtol=1e-9)


def test_nearest_on_embeddings(spark):
    """Recall against brute force, with the settings of the query; repeated ids, extra columns, many equal vectors."""
    for sf in (SF, "/root/testdata/sf0.1"):
        e = read(spark, sf, "embeddings").toPandas()
        v, ids = np.stack(e.embedding.to_numpy()).astype(float), e.vec_id.to_numpy()
        hits = total = 0
        got = collections.defaultdict(dict)
        for r in nearest.op10_nearest(spark, sf).collect():
            got[r.query_id][r.rank] = (r.vec_id, r.score)
        for q in ids[ids % 100 == 0]:
            d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
            want = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
            assert sorted(got[q]) == list(range(1, 11))
            hits, total = hits + len({x for x, _ in got[q].values()} & set(want)), total + 10
            assert all(abs(s - d[ids == x][0]) < 1e-12 for x, s in got[q].values())
        assert hits >= 0.9 * total
    rows = [(k, [1.0, 2.0], 0, "a") for k in range(300)] + [(300, [1.0, 2.5], 1, "b"), (300, [1.0, 2.5], 1, "b"), (5, [9.0, 9.0], 1, "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, chunk string")
    found = {(r.query_id, r.rank): r.vec_id for r in nearest.search(table, table.where("vec_id in (0, 200)")).collect()}
    assert [found[0, k] for k in range(1, 11)] == list(range(1, 11)) and [found[200, k] for k in range(1, 11)] == list(range(10))


def test_packing_plan_against_best_fit():
    """All pieces are placed without overlap, and in no more sequences than plain best fit, longest first, takes (1 % and one aside)."""
    rnd = np.random.default_rng(8)
    for top in (1024, 600, 300):
        lengths = np.concatenate([rnd.integers(1, top + 1, 3000), rnd.integers(1, 60, 2000)])
        histogram = collections.Counter(lengths.tolist())
        used, ranks = collections.defaultdict(list), collections.Counter()
        for n, first, count, per, sequence, offset in packing.plan(dict(histogram), 1024):
            assert first == ranks[n]
            ranks[n] += count
            for k in range(count):
                at = offset + k % per * n
                used[sequence + k // per].append((at, at + n))
        assert ranks == histogram
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        gaps: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            k = bisect.bisect_left(gaps, n)
            room = gaps.pop(k) if k < len(gaps) else 1024
            bisect.insort(gaps, room - n)
        assert len(used) <= 1.01 * len(gaps) + 1


def test_crf_scores_against_all_labellings(spark):
    """Scores are the calibrated mean of the marginals by line length, marginals by enumeration of all labellings."""
    import itertools

    rnd = np.random.default_rng(6)
    model = line_crf.Model(rnd.normal(size=3 * line_crf.N), 0.8, 1.3, -0.2)
    texts = ["One line.", "Two lines\nof words", "a\n\nB C d e f!\n12 | 3", ""]
    table = spark.createDataFrame([(k, t, "x", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, lang string, score double")
    for r in line_crf.score(table, model).collect():
        x, sizes = line_crf.text_features(texts[r.doc_id])
        s = x @ model.weights
        weigh = {y: math.exp(sum(a * b for a, b in zip(s, y, strict=True)) + model.stay * sum(a == b for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(s))}
        good = [sum(v for y, v in weigh.items() if y[k]) / sum(weigh.values()) for k in range(len(s))]
        q = sum(g * n for g, n in zip(good, sizes, strict=True)) / sizes.sum()
        assert abs(r.score - 1 / (1 + math.exp(-(1.3 * math.log(q / (1 - q)) - 0.2)))) < 1e-9


def lookalikes(n: int, pairs: int) -> list[np.ndarray]:
    """n sets of 80 items with equal sketches, of similarity 0.6; for the first `pairs` a set that links with each."""
    rnd = np.random.default_rng(3)
    low = rnd.integers(0, 1024, 70, np.uint64)
    draw = lambda low: rnd.integers(0, 1 << 40, len(low), np.uint64) << np.uint64(12) | low
    common = draw(low[:60])
    sets = [np.concatenate([common, draw(low[60:]), draw(low[60:])]) for _ in range(n)]
    for k in range(pairs):
        sets.append(np.concatenate([sets[k][:-1], draw(low[69:])]))
    return [np.sort(s) for s in sets]


def test_near_pairs_that_do_not_link_stay_in_tasks(spark, monkeypatch):
    """No step of a crowded key gives more rows than it takes, and its links are found."""
    sets = dict(enumerate(lookalikes(200, 10)))
    items = spark.createDataFrame([(i, len(s), parity(s), s.view(np.int64).tolist()) for i, s in sets.items()], "ent long, n long, odd array<long>, items array<long>")
    shared = spark.createDataFrame([(key, i, len(s)) for i, s in sets.items() for key in (1, 2)], "key long, ent long, n int")
    rows, settle = [], simgraph.settle

    def counted(df):
        out = settle(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(simgraph, "settle", counted)
    got = {r.node: r.root for r in simgraph.components(shared, items, lambda wanted: items.join(wanted, "ent").select("ent", "items"), 85, 100).collect()}
    assert got == {i: i % 200 for i in (*range(10), *range(200, 210))} and max(rows) <= 2 * len(sets)


def test_cells_of_a_tile_miss_no_link(spark):
    """A tile of many items, cut into cells, links what the whole tile does, with one side and with two."""
    sets = lookalikes(30, 8)
    items = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "ent long, items array<long>")
    for side in (lambda i: 3, lambda i: 1 + (i >= 30)):
        rows = spark.createDataFrame([(7, 0, side(i), i, len(s), i) for i, s in enumerate(sets)], "key long, tile long, side int, ent long, n int, comp long")
        for most in (simgraph.MOST_ITEMS, 600):
            assert {tuple(r) for r in simgraph.forest_links(rows, items, 85, 100, most).collect()} == {(k, 30 + k) for k in range(8)}


def test_few_edges_are_joined_in_one_step(spark, monkeypatch):
    """A small table of edges takes two settled tables, a chain of any length included, and gives what star rounds give."""
    rnd, settle, steps = np.random.default_rng(4), simgraph.settle, []
    monkeypatch.setattr(simgraph, "settle", lambda df: steps.append(1) or settle(df))
    chain = rnd.permutation(np.arange(-50, 50)).tolist()
    pairs = [*zip(chain, chain[1:], strict=False), *(tuple(x) for x in (rnd.integers(1000, 1400, (150, 2))).tolist()), (7000, 7000)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = sorted(tuple(r) for r in simgraph.connected(edges).collect())
    assert len(steps) == 2 and dict(got)[49] == -50 and 7000 not in dict(got)
    assert got == sorted(tuple(r) for r in simgraph.connected(edges, 0).collect()) and len(steps) > 4
    assert simgraph.connected(edges.limit(0)).count() == 0
