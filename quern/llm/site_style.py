"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: its nodes are element paths (tags with their classes and ids), under
each hang the layouts (sequences of child elements) and the texts that pages show there. From one aggregation over
all pages come the nodes' importances, both entropies to the base of the number of pages with the node:

- of presentation: high if pages lay the node out in many ways, 0 if all do it alike;
- of content: one less the mean, over all texts below the node, of the entropy of a text's pages; 0 if every page
  shows the same texts, 1 if no two pages share any.

A page counts once in them, however many copies of it a host has. The tree is made from whole pages, furniture
included, and is asked first. A branch goes if its composite importance is low and enough pages have it; of a branch
that its element or class names call furniture (navigation, footers, forms, advert and comment containers), less
importance than that of the text around it is low enough. What is inside the chosen ``article`` never goes by
repetition; nor do branches that hold a good part of a site's article text, or most of the different texts that its
pages would give without the tree. Names alone decide about furniture that the tree leaves: on hosts with few pages,
and where each page shows another advert; but on a page that would have no article text then, elements named so stay if
they hold an article or most of the page's text. What is left of ``article`` elements is the text; if ``main`` has more
beside them, both; without any, the body's. ``decided_by`` tells which rule made a page's text.

Null and empty html give the empty text. A null url is a host of its own. Markup may be broken: unclosed elements end
with their parents or with the next element that cannot be inside, stray end tags are passed over, an unfinished tag at
the end is dropped. Pages are read whole, however long. Repeated pages give the same text each, and equal importances
are treated alike, so that there are no ties. An empty table gives no rows. Columns named text, n_chars and decided_by
are replaced, others pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import own_name, stable, structs, values

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
SILENT = frozenset("head button select script style noscript template iframe object embed svg canvas audio video map textarea input".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ()}
# Classes, ids and roles of furniture, and words that may stand beside them in one.
NOISE = re.compile(
    r"(?:ads?|adverts?|advert[a-z]*|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|"
    r"side-?bar|nav(?:bar|igation)?|menu|bread-?crumbs?|footer|masthead|page-?header|site-?header|header|toolbar|pagination|pager|comments?|"
    r"comment-?list|respond|disqus|replies|reader-?comments|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|"
    r"search|widget|skip-?link|contentinfo|complementary|alert|disclaimer|tags)",
    re.I,
)
AROUND = frozenset("area bar block bottom box button buttons container desktop fixed form global holder icons inner item items left link links list mobile outer posts primary right row secondary site slot sticky text top unit widgets wrap wrapper".split())
TAG = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(frozen=True)
class Pruning:
    """``least`` importance; of furniture by name, ``named`` times the text's; ``pages`` that must have a node to judge
    it; shares of article text and of all that protect."""

    least: float = 0.35
    named: float = 0.95
    pages: int = 8
    share: float = 0.10
    returned: float = 0.50
    mixing: float = 0.9


def key(path: str) -> int:
    n = xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass"))
    return n - (n >> 63 << 64)


def _noisy(names: str, in_article: bool) -> bool:
    """Whether a whole name is furniture's; a header in an article has its title."""
    for name in names.split():
        parts = [x for x in re.split(r"[_\-]+", name) if x]
        words = [bool(NOISE.fullmatch(x)) for x in parts]
        if NOISE.fullmatch(name) or any(words) and all(w or x.lower() in AROUND for w, x in zip(words, parts, strict=True)):
            if not (in_article and "header" in name.lower()):
                return True
    return False


class _Node:
    """``hard``: furniture by element; ``named``: where the innermost element around that is so by name starts, or -1;
    ``silent``: what has no text of its own to judge, as hidden elements and furniture inside a line."""

    __slots__ = ("tag", "path", "hard", "named", "silent", "kind", "children", "block")

    def __init__(self, tag: str, path: str, hard: bool, named: int, silent: bool, kind: str, block: bool) -> None:
        self.tag, self.path, self.hard, self.named, self.silent, self.kind, self.block = tag, path, hard, named, silent, kind, block
        self.children: list[str] = []

    @property
    def noise(self) -> bool:
        return self.hard or self.named >= 0


def _open(tag: str, attributes: str, parent: _Node, at: int, spared: frozenset[int]) -> _Node:
    names, noise, named = "", parent.hard or tag in FURNITURE, False
    silent = parent.silent or tag in SILENT
    if attributes and not silent:
        for a, *values_ in ATTRIBUTE.findall(attributes):
            value, a = next(filter(None, values_), ""), a.lower()
            if a in ("class", "id"):
                names += "." + " ".join(sorted(re.sub(r"\d+", "0", value).split()))
            named = named or a in ("class", "id", "role") and tag not in ("html", "body", "main", "article") and _noisy(value, parent.kind == "article")
            silent = silent or a == "hidden" or a == "aria-hidden" and value.lower() == "true" or a == "style" and bool(HIDDEN.search(value))
    kind = parent.kind
    if tag == "article":
        noise = noise or parent.kind == "article"  # an article in an article is a reader's comment
        kind = "article"
    elif tag == "main" or "role" in attributes and re.search(r"role\s*=\s*[\"']?main", attributes):
        kind = kind if kind == "article" else "main"
    elif tag == "header" and parent.kind != "article":
        noise = True
    block = tag not in INLINE
    named_at = at if named and at not in spared else parent.named
    silent = silent or not block and not parent.noise and (noise or named_at >= 0)
    return _Node(tag, f"{parent.path}>{tag}{names}" if block else parent.path, noise, named_at, silent, kind, block)


Block = tuple[str, str, str | None, bool]


def blocks(page: str | None) -> Iterator[Block]:
    """(path, kind, text, furniture by name) of each block of text, in page order, and (path, children, None, False) of
    each element that ends."""
    found: dict[int, list] = {}
    rows = list(_read(page, frozenset(), found))
    spared = frozenset()
    if found and not any(kind == "article" for _, kind, text, noise in rows if text is not None and not noise):
        whole = sum(len(text) for _, _, text, noise in rows if text is not None and not noise) + sum(chars for chars, _, _ in found.values())
        for at in sorted(found, reverse=True):  # elements after those around them
            chars, holds, around = found[at]
            if around >= 0:
                found[around][0] += chars
                found[around][1] |= holds
        holding = frozenset(at for at, x in found.items() if x[1] and x[0])
        spared = holding or frozenset(at for at, x in found.items() if 2 * x[0] > whole)
    yield from _read(page, spared, {}) if spared else rows


def _read(page: str | None, spared: frozenset[int], found: dict[int, list]) -> Iterator[Block]:
    """As blocks. found: of each element that goes by name, its characters, whether it holds an article, the one around."""
    source = page or ""
    stack, buffer, at = [_Node("", "", False, -1, False, "", True)], [], 0

    def count(text: str) -> None:
        if not stack[-1].hard and stack[-1].named in found:
            found[stack[-1].named][0] += len(" ".join(text.split()))

    def flush() -> Iterator[Block]:
        text = " ".join(html.unescape("".join(buffer)).split()) if buffer else ""
        buffer.clear()
        if text:
            count(text)
            yield stack[-1].path, stack[-1].kind, text, stack[-1].noise

    def pop() -> Block | None:
        n = stack.pop()
        return (n.path, "".join(n.children), None, False) if n.block and not n.silent and n.children else None

    while at < len(source):
        m = TAG.search(source, at)
        if not m:
            (count if stack[-1].silent else buffer.append)(source[at:])
            break
        if m.start() > at:
            (count if stack[-1].silent else buffer.append)(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or m[5] and not m[0].endswith(">"):  # a comment, a declaration or the unfinished end
            continue
        if m[1] or m[4]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if not depth:
                continue
            if any(n.block for n in stack[depth:]):
                yield from flush()
            while len(stack) > depth:
                if (done := pop()) is not None:
                    yield done
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:  # as text up to its end tag
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag in VOID:
            if tag == "hr":
                yield from flush()
            elif tag == "br" and not stack[-1].silent:
                buffer.append(" ")
            continue
        if tag not in INLINE:
            yield from flush()
            if tag in CLOSES_P or tag in SAME:
                wanted, walls = ("p", ()) if tag in CLOSES_P else (tag, SAME[tag])
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (wanted,))
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in same:
                        while len(stack) > i:
                            if (done := pop()) is not None:
                                yield done
                        break
                    if stack[i].tag in walls or wanted == "p" and stack[i].block:
                        break
            run = stack[-1].children
            if not run or run[-1] != tag + " ":
                run.append(tag + " ")
        node = _open(tag, attributes, stack[-1], m.start(), spared)
        if node.named == m.start():
            found[node.named] = [0, False, stack[-1].named]
        if node.named >= 0 and tag in ("article", "main") and not node.hard:
            found[node.named][1] = True
        if node.silent and not stack[-1].silent and not node.block:
            buffer.append(" ")
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "path", "use"):
            stack.append(node)
    yield from flush()
    while len(stack) > 1:
        if (done := pop()) is not None:
            yield done


def _prefixes(path: str) -> list[int]:
    """Keys of a path and all above it; a class may hold the separator, which then makes one more prefix."""
    parts = path.split(">")
    return [key(">".join(parts[:i])) for i in range(2, len(parts) + 1)]


ROW = pa.struct(
    [("path", pa.int64()), ("feature", pa.int64()), ("chars", pa.int32()), ("inside", pa.bool_()), ("noise", pa.bool_()), ("returned", pa.bool_()), ("first", pa.bool_()), ("above", pa.list_(pa.int64()))]
)
FEATURES = "same binary, rows array<struct<path:long,feature:long,chars:int,inside:boolean,noise:boolean,returned:boolean,first:boolean,above:array<long>>>"


def _rows_of(page: str | None) -> tuple[bytes, list[tuple]]:
    """A digest by which copies of a page are known, and a row of ROW for each block and layout."""
    rows, seen, all_ = [], set(), list(blocks(page))
    chosen = _chosen([(kind, text) for _, kind, text, noise in all_ if text is not None and not noise])
    for path, kind, text, noise in all_:
        k = key(path)
        if text is None:
            rows.append((k, key(kind), -1, False, False, False, False, []))
            continue
        first = k not in seen
        seen.add(k)
        rows.append((k, key(text), len(text), kind == "article", noise, kind in chosen and not noise, first, _prefixes(path) if first else []))
    same = b"".join(x[0].to_bytes(8, "little", signed=True) + x[1].to_bytes(8, "little", signed=True) for x in rows)
    return xxhash.xxh3_128_digest(same), rows


def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in values(batches):
        out = list(map(_rows_of, part))
        flat = structs([row for _, rows in out for row in rows], [(f.name, f.type) for f in ROW])
        ends = np.cumsum([0, *(len(rows) for _, rows in out)])
        yield pa.StructArray.from_arrays([pa.array([same for same, _ in out], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["same", "rows"])


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][\w+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """A row for each host and node: host, path, pages, presentation, content, share (of the article text), inside,
    returned (share of the different texts that pages would give without the tree), noise (furniture by name), top (the
    content importance of the texts that pages would give). Pages are different ones."""
    features = F.arrow_udf(_features, FEATURES)
    read = pages.select(_host(url).alias("host"), features(F.col(page)).alias("x")).select("host", "x.*")
    # copies of a page have the same rows, and meet in partial results before they are exchanged
    once = read.groupBy("host", "same").agg(F.first("rows").alias("rows"))
    rows = once.select("host", F.explode("rows").alias("x")).select("host", "x.*")
    # rows of one text and node meet in partial sums before they are exchanged
    counted = rows.groupBy("host", "path", "feature", (F.col("chars") < 0).alias("layout")).agg(
        F.count("*").alias("n"), F.sum(F.col("first").cast("long")).alias("pages"), F.sum("chars").alias("chars"),
        F.max("inside").alias("inside"), F.max("above").alias("above"), F.max(F.when(F.col("returned"), F.col("chars")).otherwise(0)).alias("returned"), F.min("noise").alias("noise"),
    )
    surprise = F.col("n") * F.log(F.col("n").cast("double"))
    nodes = counted.groupBy("host", "path", "layout").agg(
        F.sum("n").alias("n"), F.sum(surprise).alias("s"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"),
        F.max("inside").alias("inside"), F.max("above").alias("above"), F.sum("returned").alias("returned"), F.min("noise").alias("noise"),
        F.sum(F.when(F.col("returned") > 0, F.col("n"))).alias("given_n"), F.sum(F.when(F.col("returned") > 0, surprise)).alias("given_s"),
    )
    n = pages.count()
    nodes = stable(nodes, BLOCKS_A_PAGE * n)
    laid = nodes.filter("layout").select("host", "path", (F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)).alias("presentation"))
    text = nodes.filter(~F.col("layout")).withColumn("node", F.explode("above"))
    inside_chars = F.sum(F.when(F.col("inside"), F.col("chars")).otherwise(0))
    below = text.groupBy("host", F.col("node").alias("path")).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("pages").alias("pages"), inside_chars.alias("chars"), F.min("inside").alias("inside"), F.sum("returned").alias("returned"), F.min("noise").alias("noise")
    )
    whole = nodes.filter(~F.col("layout")).groupBy("host").agg(
        inside_chars.alias("all_chars"), F.sum("returned").alias("all_returned"), F.sum("given_n").alias("given_n"), F.sum("given_s").alias("given_s"), F.max(F.when(F.col("given_n") > 0, F.col("pages"))).alias("given_pages")
    )
    unlike = lambda n, s, m: F.when(F.col(m) > 1, F.greatest(F.lit(0.0), 1 - F.col(s) / F.col(n) / F.log(F.col(m).cast("double")))).otherwise(1.0)
    share = F.when(F.col("all_chars") > 0, F.col("chars") / F.col("all_chars")).otherwise(0.0)
    returned = F.when(F.col("all_returned") > 0, F.col("returned") / F.col("all_returned")).otherwise(0.0)
    whole = whole.withColumn("top", unlike("given_n", "given_s", "given_pages")).drop("given_n", "given_s", "given_pages")
    joined = below.join(laid, ["host", "path"], "left").join(whole, "host")
    return joined.select(
        "host", "path", "pages", F.coalesce("presentation", F.lit(0.0)).alias("presentation"), unlike("n", "s", "pages").alias("content"), share.alias("share"), "inside", returned.alias("returned"), "noise", "top"
    )


def unimportant(tree: DataFrame, p: Pruning = Pruning()) -> DataFrame:
    """(host, gone): the paths of branches that go."""
    importance = F.when(F.col("presentation") > 0, (1 - p.mixing) * F.col("presentation") + p.mixing * F.col("content")).otherwise(F.col("content"))
    spared = F.col("inside") | (F.col("share") >= p.share) | (F.col("returned") >= p.returned)
    low = (importance < p.least) | (F.col("noise") & (F.col("content") < p.named * F.col("top")))
    return tree.filter((F.col("pages") >= p.pages) & ~spared & low).groupBy("host").agg(F.collect_set("path").alias("gone"))


def _chosen(texts: list[tuple[str, str]]) -> frozenset[str]:
    """The kinds of blocks that make the text, by its amount; an article that is less than what main has beside it is a teaser."""
    chars = {"article": 0, "main": 0, "": 0}
    for kind, text in texts:
        chars[kind] += len(text)
    if chars["main"] > chars["article"]:
        return frozenset(("article", "main"))
    return frozenset(("article" if chars["article"] else "",))


def decide(page: str | None, gone: frozenset[int] = frozenset(), names: bool = True) -> tuple[str, str]:
    """The text, and what decided it: ``tree`` if all that went went by importance, ``names`` if elements and classes
    had to tell the rest, ``nothing`` if nothing went. Without ``names`` only the tree is asked."""
    texts: list[tuple[str, str]] = []
    lost: dict[str, bool] = {}
    by_tree = by_name = False
    for path, kind, text, noise in blocks(page):
        if text is None:
            continue
        if gone and kind != "article":
            if path not in lost:
                lost[path] = not gone.isdisjoint(_prefixes(path))
            if lost[path]:
                by_tree = True
                continue
        if noise and names:
            by_name = True
            continue
        texts.append((kind, text))
    chosen = _chosen(texts) if names else frozenset(("article", "main", ""))
    kept = [text for kind, text in texts if kind in chosen]
    return "\n\n".join(kept), "names" if by_name or len(kept) < len(texts) else "tree" if by_tree else "nothing"


def main_text(page: str | None, gone: frozenset[int] = frozenset()) -> str:
    return decide(page, gone)[0]


#: Blocks and layouts that a page is taken to have, to size intermediate files.
BLOCKS_A_PAGE = 64
#: The table of branches is broadcast up to this many; beyond, it is joined by host, of which AQE splits large ones.
MOST_BRANCHES = 100_000


def extract(pages: DataFrame, page: str = "html", url: str = "url", p: Pruning = Pruning(), names: bool = True) -> DataFrame:
    """The pages with ``text`` (blocks joined by an empty line), ``n_chars`` and ``decided_by``."""
    gone = stable(unimportant(style_tree(pages, page, url), p), BLOCKS_A_PAGE * pages.count())
    n = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("n")).first()["n"]

    @F.arrow_udf("text string, decided_by string")
    def text_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html_, lists in batches:
            for part in zip(values([html_]), values([lists]), strict=True):
                rows = [decide(x, frozenset(g or ()), names) for x, g in zip(*part, strict=True)]
                yield structs(rows, (("text", pa.string()), ("decided_by", pa.string())))

    host, branches, found = (own_name(pages, x) for x in ("_host", "_gone", "_found"))
    hosted = pages.withColumn(host, _host(url))
    small = gone.select(F.col("host").alias(host), F.col("gone").alias(branches))
    joined = hosted.join(F.broadcast(small) if n <= MOST_BRANCHES else small, host, "left") if n else hosted.withColumn(branches, F.lit(None).cast("array<long>"))
    out = joined.withColumn(found, text_of(F.col(page), F.col(branches)))
    out = out.withColumns({"text": F.col(found)["text"], "decided_by": F.col(found)["decided_by"]})
    return out.withColumn("n_chars", F.length("text").cast("long")).drop(host, branches, found)
