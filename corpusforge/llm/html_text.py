"""Main text of web pages by wrapper induction.

The block elements of a page are a tree.  The shapes of a host's pages are aligned by simple tree matching and merged
into the host's wrapper; every text block of a page then has a slot of it.  Over all pages of the host, slots that repeat a
few texts are template and slots whose texts vary are content.  Elements that HTML itself marks as navigation, forms,
notices and the like never are content, and what stands in an article goes before what doesn't.
"""

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.arrow_text import chunks, worker_path
from corpusforge.session import stored

#: A slot is template when one text stands in it on two different pages or more, or when its distinct texts are at most this
#: share of all.  A text counts once for every different page, so copies of a page weigh once.
TEMPLATE_VARIETY = 0.3
#: A host's wrapper merges all its shapes, about so many trees in one step.  What a step gives has at most WRAPPER_NODES
#: nodes and those that all its trees have; blocks of nodes left out have a slot by their path instead.
MERGED_TREES, WRAPPER_NODES = 16, 512

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
                    "span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object select option".split())
_NEVER = frozenset("head nav aside form footer button dialog menu fieldset".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                 "td": {"td", "th"}, "th": {"td", "th"}}
_LIST_LIKE = frozenset("ul ol dl table article section div main body aside nav".split())
_BOILER = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
                    "consent gdpr notice menu nav navbar navigation sidebar footer comment comments respond disqus share "
                    "sharing social related recommended newsletter subscribe subscription popup modal overlay breadcrumb "
                    "breadcrumbs toolbar widget pagination pager login signup search skip".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+|\d+")


def _marked(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """The node's name for alignment (tag and class), and whether it never holds content."""
    name, never = tag, tag in _NEVER or tag == "header" and not in_article
    if attributes:
        for kind, *values in _ATTRIBUTE.findall(attributes):
            value, kind = "".join(values).lower(), kind.lower()
            if kind == "hidden":
                never = True
            elif kind == "role":
                never = never or value in _ROLES
            else:
                words = set(_NAME.findall(value))
                never = never or bool(words & _BOILER) and tag not in ("body", "html") or "header" in words and not in_article
                if kind == "class":
                    name = f"{tag}.{value}"
    return name, never


class Page:
    """Text blocks of a page (text, node path, standing) and its tree of block elements, runs of equal siblings as one.

    A block's standing is 0 where content never is, 1 in the body, 2 in a main element, 3 in an article.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, list, int]] = []
        self.root = ["#root", []]
        self._read(source)

    def _read(self, source: str) -> None:
        # Open elements: tag, tree node, never content, standing.
        stack = [("#root", self.root, False, 1)]
        parts: list[str] = []

        def flush() -> None:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                leaf = ["#", []]
                stack[-1][1][1].append(leaf)
                self.blocks.append((text, leaf, 0 if stack[-1][2] else stack[-1][3]))

        at = 0
        while True:
            found = _TOKEN.search(source, at)
            if found is None:
                parts.append(source[at:])
                break
            parts.append(source[at:found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            closing, attributes = found[1] or found[4], found[3] if found[2] else found[6]
            if tag in _RAW:
                if not closing and not attributes.endswith("/"):
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            if tag in _INLINE:
                if tag in ("br", "img"):
                    parts.append(" ")
                if closing or tag in _VOID or not attributes:
                    continue
                _, never = _marked(tag, attributes, True)
                if not never:
                    continue
                # An inline element marked as boilerplate ends the block, as its text is not part of it.
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            closes = _SELF_CLOSING.get(tag)
            for k in range(len(stack) - 1, 0, -1):
                if closes and stack[k][0] in closes or stack[k][0] == "p" and tag not in _INLINE:
                    del stack[k:]
                    break
                if stack[k][0] in _LIST_LIKE:
                    break
            if tag in _VOID:
                continue
            _, parent, never, standing = stack[-1]
            name, own = _marked(tag, attributes, standing == 3)
            if tag == "article":
                standing = 3
            elif tag == "main" or "main" in attributes and re.search(r"role\s*=\s*[\"']?main", attributes):
                standing = max(standing, 2)
            node = [name, []]
            parent[1].append(node)
            stack.append((tag, node, never or own, standing))
        flush()

    def shape(self) -> tuple[list, list[int]]:
        """The tree with runs of equal siblings as one node, and the leaf number of every block in it."""
        number: dict[int, int] = {}
        count = 0

        def folded(node: list) -> tuple:
            out, own = [], []
            for child in node[1]:
                if child[0] == "#":
                    entry, members = ("#",), [[child]]
                else:
                    entry, members = folded(child)
                    if not members:
                        continue
                if out and out[-1] == entry:
                    own[-1] = [a + b for a, b in zip(own[-1], members, strict=True)]
                else:
                    out.append(entry)
                    own.append(members)
            return (node[0], *out), [m for members in own for m in members]

        tree, leaves = folded(self.root)
        for members in leaves:
            for leaf in members:
                number[id(leaf)] = count
            count += 1
        return tree, [number[id(leaf)] for _, leaf, _ in self.blocks]


def match(a: list, b: list, seen: dict) -> tuple[int, list]:
    """Simple tree matching: the most pairs of nodes of two ordered trees that keep order and parents, and the child pairs."""
    key = (id(a), id(b))
    if key in seen:
        return seen[key]
    if a[0] != b[0]:
        seen[key] = (0, [])
        return seen[key]
    left, right = a[1:], b[1:]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + match(x, y, seen)[0])
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i + 1, j + 1))
    seen[key] = (best[-1][-1] + 1, pairs[::-1])
    return seen[key]


def merged(wrapper: list, page: list, held: dict | None = None, seen: dict | None = None) -> list:
    """The wrapper with the nodes of a page that it lacks, put in between the aligned ones.

    ``held`` maps the id of a node to how many merged trees have it, with the node itself; others are of one tree.
    """
    seen = {} if seen is None else seen
    _, pairs = match(wrapper, page, seen)
    out, i, j = [wrapper[0]], 1, 1
    for x, y in [*pairs, (len(wrapper), len(page))]:
        out += wrapper[i:x] + page[j:y]
        if x < len(wrapper):
            out.append(merged(wrapper[x], page[y], held, seen))
        i, j = x + 1, y + 1
    if held is not None:
        held[id(out)] = (held.get(id(wrapper), (1,))[0] + held.get(id(page), (1,))[0], out)
    return out


def _most_shared(wrapper: list, held: dict) -> list:
    """The wrapper with the nodes of the most trees: at most WRAPPER_NODES, or those of every tree if they are more."""
    def times(node: list) -> int:
        return held.get(id(node), (1,))[0]

    def all_of(node: list) -> Iterator[int]:
        yield times(node)
        for child in node[1:]:
            yield from all_of(child)

    def kept(node: list, least: int) -> list:
        return [node[0], *(kept(child, least) for child in node[1:] if times(child) >= least)]

    counts = sorted(all_of(wrapper), reverse=True)
    if len(counts) <= WRAPPER_NODES:
        return wrapper
    return kept(wrapper, min(counts[WRAPPER_NODES] + 1, counts[0]))


def slots(wrapper: list, page: list) -> list[int]:
    """For every leaf of the page, in order, the number of its leaf in the wrapper, or a negative hash of its path."""
    numbers: dict[int, int] = {}

    def count(node: list) -> None:
        if node[0] == "#":
            numbers[id(node)] = len(numbers)
        for child in node[1:]:
            count(child)

    count(wrapper)
    seen, out = {}, []

    def walk(node: list, partner: list | None, path: str) -> None:
        path += f"/{node[0]}"
        if node[0] == "#":
            digest = hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            out.append(numbers[id(partner)] if partner else -1 - (int.from_bytes(digest, "big") >> 1))
        by_child = {y: x for x, y in match(partner, node, seen)[1]} if partner else {}
        for k, child in enumerate(node[1:], 1):
            walk(child, partner[by_child[k]] if k in by_child else None, path)

    walk(page, wrapper, "")
    return out


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, shape (tree as JSON, one per distinct shape hash), blocks (text, leaf, standing)."""
    fields = pa.list_(pa.struct([("text", pa.string()), ("leaf", pa.int32()), ("standing", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "html", 1 << 20):
                shapes, blocks = [], []
                for source in batch.column("html").to_pylist():
                    page = Page(source or "")
                    tree, leaves = page.shape()
                    shapes.append(json.dumps(tree))
                    blocks.append([{"text": t, "leaf": n, "standing": s} for (t, _, s), n in zip(page.blocks, leaves, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(shapes), pa.array(blocks, fields)],
                    names=["page_id", "url", "shape", "blocks"])

    worker_path(pages.sparkSession)
    parsed = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, shape string, blocks array<struct<text string, leaf int, standing int>>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    # Without a host only pages of one shape are taken together, as others may be of any site.
    return parsed.withColumn("host", F.when(host == "", F.concat(F.lit("?"), F.hex(F.xxhash64("shape")))).otherwise(host))


def _wrappers(shapes: DataFrame) -> DataFrame:
    """host, wrapper: the merged tree of all shapes of each host."""
    def induce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pages", "tree"], ascending=[False, True])
        trees, held = [json.loads(s) for s in rows["tree"]], {}
        wrapper = trees[0]
        for tree in trees[1:]:
            wrapper = merged(wrapper, tree, held)
        if len(trees) > 1:
            wrapper = _most_shared(wrapper, held)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "open": [rows["open"].iloc[0]], "pages": [rows["pages"].sum()],
                             "tree": [json.dumps(wrapper)]})

    # Steps of about MERGED_TREES trees, until every host has one: no host meets in one task, however many shapes it has.
    sizes = shapes.groupBy("host").agg(F.count("*").alias("open"))
    trees = shapes.join(sizes, "host").select("host", "open", "pages", F.col("shape").alias("tree"))
    most = sizes.agg(F.max("open")).first()[0] or 0
    while most > 1:
        most = -(-most // MERGED_TREES)
        trees = trees.withColumn("open", F.ceil(F.col("open") / MERGED_TREES).cast("long"))
        trees = stored(trees.groupBy("host", "open", F.pmod(F.xxhash64("tree"), F.col("open"))).applyInPandas(
            induce, "host string, open long, pages long, tree string"), "page-trees")
    return trees.select("host", F.col("tree").alias("wrapper"))


def _aligned(shapes: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, shape, slots: every distinct shape of a host aligned with its wrapper."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrapper, page = batch.column("wrapper").to_pylist(), batch.column("shape").to_pylist()
            found = [slots(json.loads(w), json.loads(s)) for w, s in zip(wrapper, page, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), pa.array(found, pa.list_(pa.int64()))],
                                             names=["host", "shape", "slots"])

    return shapes.join(wrappers, "host").select("host", "shape", "wrapper").mapInArrow(
        run, "host string, shape string, slots array<long>")


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of (page_id, url, html): page_id, url, text (blocks joined by line feeds), n_chars (code points).

    Null and empty pages have empty text, pages without a usable URL are of one host where their shapes are equal, repeated rows each give a row but are
    one page to the wrapper.  Broken markup is read as far as it goes.  Texts are never cut.
    """
    parsed = stored(_parsed(pages), "page-blocks")
    shapes = stored(parsed.groupBy("host", "shape").agg(F.count("*").alias("pages")), "page-shapes")
    wrappers = stored(_wrappers(shapes), "page-wrappers")
    aligned = stored(_aligned(shapes, wrappers), "page-slots")
    # Pages of a host with equal texts are one page here, whatever their number: one of their shapes stands for all.
    able = F.filter("blocks", lambda b: b["standing"] > 0)
    hashed = parsed.select("host", F.xxhash64("shape").alias("form"), F.transform(able, lambda b: F.struct(
        b["leaf"].alias("leaf"), F.xxhash64(b["text"]).alias("h"))).alias("held")).filter(F.size("held") > 0)
    page = F.xxhash64(F.transform("held", lambda b: b["h"]))
    pages_once = hashed.groupBy("host", page.alias("page")).agg(F.min(F.struct("form", "held")).alias("p"))
    placed = pages_once.select("host", "p.form", "p.held").join(
        aligned.select("host", F.xxhash64("shape").alias("form"), "slots"), ["host", "form"])
    # A text counts once per page and slot.
    texts = placed.select("host", F.explode(F.array_distinct(F.transform("held", lambda b: F.struct(
        F.element_at("slots", b["leaf"] + 1).alias("slot"), b["h"].alias("h"))))).alias("b")).select("host", "b.slot", "b.h")
    repeated = texts.groupBy("host", "slot", "h").count().groupBy("host", "slot").agg(
        F.sum("count").alias("texts"), F.count("*").alias("distinct"))
    template = repeated.filter((F.col("texts") >= 2) & (F.col("distinct") <= F.greatest(F.lit(1), F.col("texts") * TEMPLATE_VARIETY)))
    template = template.groupBy("host").agg(F.collect_set("slot").alias("template"))
    known = stored(aligned.join(template, "host", "left").select("host", "shape", F.expr(
        "filter(transform(slots, (s, i) -> if(array_contains(template, s), i, -1)), i -> i >= 0)").alias("fixed")), "page-template")
    rows = parsed.join(known, ["host", "shape"], "left")
    usable = F.filter("blocks", lambda b: (b["standing"] > 0) & ~F.array_contains(F.coalesce("fixed", F.array().cast("array<int>")), b["leaf"]))
    best = F.array_max(F.transform("usable", lambda b: b["standing"]))
    text = F.array_join(F.transform(F.filter("usable", lambda b: b["standing"] == best), lambda b: b["text"]), "\n")
    return rows.withColumn("usable", usable).select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long"))


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
