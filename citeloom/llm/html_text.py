"""Main text of web pages by template deduction.

Tokens of a page are its elements, each named by the path of tags, classes and ids above it (digits dropped), and its texts,
each named by the element it stands in and held by the nearest element around it that the page has once. Over the pages of a host, a token's occurrence vector, its count on each page, is
folded into a commutative fingerprint (sum of hashes of page and count), so equal vectors are found by one aggregation
that combines map-side and never gathers a host. Tokens with one fingerprint form an equivalence class. A class is valid
if its tokens occur once a page, on most pages of the host, and it holds two tokens or more, or all pages. Valid classes
are nested, those on more pages first: a token joins the template if the element around it belongs to it already.

The template decides what is extracted. Its elements bound slots, and the main slot is the innermost one that still holds
most of the host's text outside links; elements that say by tag or name that they are menus, footers or the like are
no candidates. Below the main slot everything is text but for what is noise there by tag or name, and for the
template's own texts (the same on most pages, `LEAST_PAGES` at least), unless a page has no other text. In an article or a main
slot, a part of a name (related-work) makes noise only where most of the text is links.

Pages without a template (hosts of one page, pages that lack the main slot) fall back on tags and names: an article, else all that
is not noise. Names of wrappers do not make an article noise where such a page has no other.

Elements carry 64-bit path names, so memory is linear in a page, however deep it nests.

Defined results: null and empty html give an empty text; broken markup (open elements, cut tags and references) is read
as far as it goes; pages that repeat an id are extracted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, settle, slices
from .url_filter import host_path

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"'<]++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Element names by the part they play.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg math object canvas".split())
NOISE_TAGS = frozenset("nav footer aside form head title button select option menu dialog fieldset".split())
NOISE_NAMES = re.compile(r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|notice|cookies?|consent|gdpr|banner|ads?|adverts?|advertisement|sponsor(?:ed)?|promo|share|social|related|comments?|disqus|replies|newsletter|subscribe|login|signup|search|breadcrumbs?|pagination|popup|modal)(?:$|[-_\s])", re.I)
#: Elements that hold no main text even if an article stands in them.
ASIDE_TAGS = frozenset("nav footer aside head title button select option menu".split())
#: A text that fewer pages share may be a copied page.
LEAST_PAGES = 3
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "option", "button"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass(slots=True)
class Block:
    """A text: its element, characters in links, and whether it is noise for the template, by all wrappers, or by tags that hold no main text."""

    element: int
    text: str
    linked: int
    below: bool
    noise: bool
    article: bool
    own: bool
    doubts: tuple[int, ...] = ()


@dataclass(slots=True)
class Element:
    """An element path: times seen, the path around it, characters outside links below it, whether it or what is around it is noise."""

    around: int
    depth: int
    noise: bool
    count: int = 0
    free: int = 0


@dataclass(slots=True)
class Open:
    """An open element. inside: in the main slot; below: noise by what lies between the slot and here."""

    tag: str
    name: int
    noise: bool
    article: bool
    own: bool
    doubts: tuple[int, ...]
    inside: bool
    below: bool
    free: int = 0


#: Around all elements of a page.
ROOT = Open("", 0, False, False, False, (), False, False)


def named(around: int, label: str) -> int:
    """A signed 64-bit name of a path or text below another."""
    raw = around.to_bytes(8, "little", signed=True) + label.encode("utf-8", "surrogatepass")
    return int.from_bytes(xxhash.xxh3_64_digest(raw), "little", signed=True)


@functools.lru_cache(50_000)
def noisy(names: str) -> int:
    """2 if a whole name says noise, 1 if a part of one does, else 0."""
    kind = 0
    for name in names.split():
        if NOISE_NAMES.search(name):
            kind = max(kind, 2 if all(NOISE_NAMES.search(x) for x in re.split("[-_]+", name) if x) else 1)
    return kind


def parse(page: str | None, main: int | None = None) -> tuple[list[Block], dict[int, Element]]:
    """The text blocks of a page, in order, and its element paths by name. main: the path that is the main slot."""
    page = page or ""
    stack: list[Open] = []
    opened: Counter[str] = Counter()
    blocks: list[Block] = []
    paths: dict[int, Element] = {}
    parts: list[str] = []
    doubt: list[list[int]] = []  # characters in links and in all, of elements that a part of a name calls noise
    linked = links = at = aside = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1] if stack else ROOT
            blocks.append(Block(top.name, text, linked, not top.inside or top.below, top.noise, top.article, top.own, top.doubts))
            top.free += max(0, len(text) - linked)
            for k in top.doubts:
                doubt[k][0] += linked
                doubt[k][1] += len(text)
        parts.clear()
        linked = 0

    def close() -> str:
        nonlocal aside
        top = stack.pop()
        opened[top.tag] -= 1
        aside -= top.tag in ASIDE_TAGS
        paths[top.name].free += top.free
        if stack:
            stack[-1].free += top.free
        return top.tag

    def pop(tags) -> None:
        """Close open elements down to the nearest of tags, if one is open in the same section."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    close()
                return
            if stack[k].tag in ("article", "section", "div", "table", "ul", "ol", "body"):
                return

    def words(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = entities.unescape(raw)
            parts.append(raw)
            if links:
                linked += len(raw)

    pos = 0
    while m := MARKUP.search(page, at):
        words(page[pos : m.start()])
        pos = at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS and opened[tag]:
                flush()
                while close() != tag:
                    pass
            continue
        if tag in RAW:
            if not m[3].endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                pos = at = end.end() if end else len(page)
            continue
        if tag == "a":
            links += 1
        elif tag == "br" or tag in VOID - BLOCKS:
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag in CLOSES_P and opened["p"]:
                pop({"p"})
            if any(opened[x] for x in SIBLINGS.get(tag, ())):
                pop(SIBLINGS[tag])
            links = 0 if tag in ("p", "div", "article", "section") else links
            if tag == "hr":
                continue
            names = " ".join(x[1] or x[2] or x[3] for x in NAMES.findall(m[3]))
            up = stack[-1] if stack else ROOT
            article, doubts = up.article or tag in ("article", "main"), up.doubts
            kind = noisy(names) if names and tag not in ("html", "body") else 0
            if kind == 1 and (up.article or up.inside):
                kind, doubts = 0, (*doubts, len(doubt))
                doubt.append([0, 0])
            here = tag in NOISE_TAGS or (tag == "header" and not article) or kind > 0
            # own: without what wrappers around an article say by name, or as a form
            own = up.own or (here if up.article else tag in ASIDE_TAGS or kind == 2 and tag not in ("article", "main") or tag == "header" and not article)
            if article and not up.article and not aside:
                own = False
            name = named(up.name, tag + ("." + re.sub(r"\d+", "", names.lower()) if names else ""))
            stack.append(Open(tag, name, up.noise or here, article, own, doubts, up.inside or name == main, up.inside and (up.below or here)))
            opened[tag] += 1
            aside += tag in ASIDE_TAGS
            if name not in paths:
                paths[name] = Element(up.name, len(stack), up.noise or here)
            paths[name].count += 1
    words(page[pos:])
    flush()
    while stack:
        close()
    for b in blocks:
        if any(2 * doubt[k][0] > doubt[k][1] for k in b.doubts):
            b.below = b.noise = b.own = True
    return blocks, paths


TOKENS = "host string, token long, around long, depth int, page long, count long, free long, noise boolean"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of each page; the page itself is token 0, texts have no depth."""
    for b in slices(batches, 500, 2):
        out: list[tuple] = []
        for i, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
            host = host_path(u)[0]
            blocks, paths = parse(h)
            out.append((host, 0, None, 0, i, 1, 0, False))
            out.extend((host, name, e.around, e.depth, i, e.count, e.free, e.noise) for name, e in paths.items())
            bounds = {0: 0}
            for x in blocks:
                up = x.element
                while up not in bounds and paths[up].count > 1:
                    up = paths[up].around
                bounds[x.element] = bounds.get(up, up)
            texts = Counter((named(x.element, x.text), bounds[x.element]) for x in blocks)
            out.extend((host, name, around, None, i, n, 0, False) for (name, around), n in texts.items())
        cols = list(zip(*out, strict=True)) or [()] * 8
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "token", "around", "depth", "page", "count", "free", "noise"])


@dataclass(slots=True)
class Token:
    token: int
    around: int
    depth: int | None
    vector: str
    pages: int
    free: int
    noise: bool


def nest(tokens: list[Token], pages: int) -> tuple[dict[int, Token], int | None]:
    """The template of a host of so many pages, made of the valid classes of tokens that occur once a page; and its main slot."""
    classes: dict[tuple[int, str], list[Token]] = {}
    for t in tokens:
        classes.setdefault((t.pages, t.vector), []).append(t)
    template: dict[int, Token] = {}
    for (n, _), members in sorted(classes.items(), key=lambda x: (-x[0][0], x[0][1])):
        if len(members) < 2 and n < pages:
            continue
        for t in sorted(members, key=lambda t: (t.depth is None, t.depth or 0, t.token)):  # elements from the outside, then texts
            if t.around == 0 or t.around in template:
                template[t.token] = t
    slots = [t for t in template.values() if t.depth and not t.noise]
    within: dict[int, int] = {}  # the most text outside links that one slot below holds
    for t in sorted(slots, key=lambda t: -t.depth):
        around = template.get(t.around)
        best = max(t.free, within.get(t.token, 0))
        if around is not None:
            within[around.token] = max(within.get(around.token, 0), best)
    inner = [t for t in slots if not within.get(t.token, 0) >= 0.8 * t.free]
    main = max(inner, key=lambda t: (t.free, t.depth, t.token), default=None)
    return template, main.token if main and main.free else None


def templates(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """(host, main, fixed): the main slot of each host's template, and the texts that belong to the template."""
    tokens = pages.mapInArrow(_tokens, TOKENS)
    vector = F.sum(F.xxhash64("page", "count").cast("decimal(38,0)")).cast("string").alias("vector")
    seen = settle(tokens.groupBy("host", "token").agg(vector, F.first("around").alias("around"), F.first("depth").alias("depth"), F.count("*").alias("pages"), F.sum("count").alias("total"), F.sum("free").alias("free"), F.max("noise").alias("noise")))
    hosts = seen.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    # once a page, on most pages: no more tokens than twice those of a page
    often = seen.where(f"token <> 0 and total = pages and pages >= if(depth is null, {LEAST_PAGES}, 2)").join(hosts, "host").where(F.col("pages") >= support * F.col("host_pages"))

    def deduce(rows: pa.Table) -> pa.Table:
        each = rows.to_pylist()
        template, main = nest([Token(*(r[c] for c in Token.__slots__)) for r in each], each[0]["host_pages"])
        fixed = sorted(t.token for t in template.values() if t.depth is None)
        return pa.table([pa.array([each[0]["host"]], pa.string()), pa.array([main], pa.int64()), pa.array([fixed], pa.list_(pa.int64()))], ["host", "main", "fixed"])

    return often.groupBy("host").applyInArrow(deduce, "host string, main long, fixed array<long>")


def main_text(page: str | None, main: int | None = None, fixed: frozenset[int] = frozenset()) -> str:
    """The text of the main slot less the template's own texts; by tags and names where the page has no such slot."""
    blocks, _ = parse(page, main)
    slot = [b for b in blocks if not b.below]
    slot = [b for b in slot if named(b.element, b.text) not in fixed] or slot
    return "\n\n".join(b.text for b in slot or by_names(blocks, fixed))


def by_names(blocks: list[Block], fixed: frozenset[int]) -> list[Block]:
    own = [b for b in blocks if named(b.element, b.text) not in fixed] or blocks
    clean = [b for b in own if not b.noise]
    inside = [b for b in clean if b.article]
    if not inside:  # an article in wrappers of noisy names is no noise
        inside = [b for b in own if not b.own and b.article]
    return inside or clean or [b for b in own if not b.own]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    pages = pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"`{url_col}` as url", f"`{html_col}` as html")
    found = settle(templates(pages))
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hosts, texts = found.agg(F.count("*"), F.sum(F.size("fixed"))).first()
    small = hosts <= 100_000 and (texts or 0) <= 2_000_000  # 16 MB of names
    joined = pages.withColumn("host", host).join(F.broadcast(found) if small else found, "host", "left").select("page_id", "url", "html", "main", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500, 2):
            out = [main_text(h, m, frozenset(f or ())) for h, m, f in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
