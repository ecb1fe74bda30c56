"""Main text of web pages by site style trees.

A page is a tree of elements. The trees of all pages of a host are merged: elements with the same path of names and
classes are one node of the site's tree. Two entropies say how important a node is:

- presentation: over the ways in which pages lay out its children. One way on all pages says nothing, many ways mean
  that authors wrote it.
- content: over the texts that pages show there. The same text on all pages is part of the site.

A node of low importance is noise wherever it stands, inside what a page marks as its article too: its text is removed,
and with it the whole branch, unless something important hangs below. Equal pages of a host count once, and a node's
importance is trusted from ``LEAST_PAGES`` different pages on; a node of fewer pages is unknown, not noise. What a page
says itself about its parts (elements, roles, classes) is known ahead of the tree: menus, forms, adverts and comments
are removed, and text outside of a marked article isn't part of it. Parts that are never text always go.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loglantern.llm.frames import written
from loglantern.llm.pieces import balanced

# A branch of less importance goes.
THRESHOLD = 0.2
# Weight of a node's own presentation, against that of its children: 1 - DECAY ** (number of layouts).
DECAY = 0.9
# Different pages from which the importance of a node is trusted.
LEAST_PAGES = 5
BATCH_BYTES = 4 << 20
# Paths of low importance that go to all tasks, in bytes, and the groups of a host where there are more.
SHARED_BYTES = 8 << 20
SALTS = 32

# Elements without an end. Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text is never shown or not prose.
_NEVER = frozenset(
    "script style noscript template head title svg canvas iframe object video audio map form button select option textarea input label".split()
)
# Elements around the article.
_AROUND = frozenset("nav footer aside menu dialog".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that a new one of the same kind ends, and those that keep it from doing so.
_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INLINE_FORMATS = frozenset("a b i em strong u s small big code font tt strike".split())
# Words of classes and ids that name what isn't the article, and words that go with them. A class or id counts if all of
# its words (parted by - and _, digits at the end aside) are of these and one is of the first kind: "share-buttons" is, "share-price" isn't.
_NOISE = re.compile(
    r"(ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|footer|masthead|topbar|sitehead(er)?"
    r"|sidebar|widgets?|related|recommend\w*|share|sharing|social|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w*|signup"
    r"|login|search|pagination|pager|comments?|commentlist|replies|reply|respond|discussion|disqus|toolbar|skiplink|copyright)"
)
_BESIDE = frozenset(
    "area article articles author bar block body bottom box btn button buttons card col column container content count fixed form group header holder icon icons"
    " inline inner item items label layer left link links list main meta module outer page panel post posts primary right row secondary section side site skip"
    " slot space sticky text thread title top unit user wrap wrapper".split()
)
_WORDS = re.compile(r"[-_]+")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_SPACE = re.compile(r"\s+")


def hash_of(*parts: object) -> int:
    """A signed 64-bit digest."""
    text = "\x1f".join(map(str, parts))
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _names_noise(names: str) -> bool:
    for name in names.split():
        words = [w for w in (part.rstrip("0123456789") for part in _WORDS.split(name)) if w]
        if any(_NOISE.fullmatch(w) for w in words) and all(w in _BESIDE or _NOISE.fullmatch(w) for w in words):
            return True
    return False


class _Node:
    """``path`` is a digest of the names and classes from the root on, so that deep nodes take no more room than others."""

    __slots__ = ("name", "path", "parts", "parent", "never", "noise", "article", "inside")

    def __init__(self, name: str, path: int, parent: _Node | None):
        self.name, self.path, self.parent = name, path, parent
        self.parts: list[_Node | str] = []
        self.never = self.noise = self.article = False
        self.inside = parent is not None and (parent.inside or parent.article)


class _Builder(HTMLParser):
    """The tree of a page. Ends that are missing are put where browsers put them, ends without a start are left out."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", 0, None)
        self.bodies = 0

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.bodies += 1
            if self.bodies > 1:
                return
        if tag in _BLOCKS:
            self._end_paragraph()
        if tag in _ENDS:
            self._end(tag, _ENDS[tag])
            if tag in ("td", "th"):
                self._end("th" if tag == "td" else "td", _ENDS[tag])
            if tag in ("dt", "dd"):
                self._end("dd" if tag == "dt" else "dt", _ENDS[tag])
        if tag in _HEADINGS and self.at.name in _HEADINGS:
            self.at = self.at.parent
        has = dict(attributes)
        known = " ".join(sorted((has.get("class") or "").lower().split()))
        node = _Node(tag, hash_of(self.at.path, tag, known), self.at)
        node.article = tag in ("article", "main") or (has.get("role") or "").lower() == "main"
        node.never = tag in _NEVER or "hidden" in has or (has.get("aria-hidden") or "") == "true"
        node.never |= "display:none" in (has.get("style") or "").replace(" ", "").lower()
        named = tag not in ("html", "body", "main") and _names_noise(f"{known} {(has.get('id') or '').lower()}")
        role = (has.get("role") or "").lower() in _ROLES
        node.noise = tag in _AROUND or role or named or (tag == "header" and not node.inside)
        self.at.parts.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)  # outside of void elements the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag == "p" and not any(n.name == "p" for n in self._open()):
            return
        stop = () if tag in _BLOCKS else ("article", "section", "td", "th", "body", "html")
        for node in self._open():
            if node.name == tag:
                self.at = node.parent
                return
            if node.name in stop or (tag in _INLINE_FORMATS and node.name in _BLOCKS and node.name != "p"):
                return

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)

    def _open(self) -> Iterator[_Node]:
        node = self.at
        while node.parent is not None:
            yield node
            node = node.parent

    def _end(self, tag: str, stop: set[str]) -> None:
        for node in self._open():
            if node.name == tag:
                self.at = node.parent
                return
            if node.name in stop:
                return

    def _end_paragraph(self) -> None:
        for node in self._open():
            if node.name == "p":
                self.at = node.parent
                return
            if node.name in _BLOCKS:
                return


def parse(html: str) -> _Node:
    """The tree of a page. A script or style without an end takes the rest of the page."""
    builder = _Builder()
    # A declaration or comment that never ends would otherwise hold back all that follows.
    builder.feed(html)
    builder.close()
    return builder.root


def _clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def _own_text(node: _Node) -> str:
    """The text of a node outside of blocks below it."""
    out: list[str] = []
    stack: list[_Node | str] = list(reversed(node.parts))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        elif part.name == "br":
            out.append(" ")
        elif part.name not in _BLOCKS and not part.never:
            stack += reversed(part.parts)
    return _clean("".join(out))


def style_nodes(root: _Node) -> list[tuple[int, int, str]]:
    """``(path, layout of the children, own text)`` of the blocks of a page that have text of their own."""
    out: list[tuple[int, int, str]] = []
    stack = [root]
    while stack:
        node = stack.pop()
        children = [p for p in node.parts if not isinstance(p, str)]
        if node.parent is not None and node.name in _BLOCKS:
            shown: list[int] = []
            for child in children:  # repeats of a child are one, lists of any length are one layout
                if child.name in _BLOCKS and not child.never and (not shown or shown[-1] != child.path):
                    shown.append(child.path)
            text = _own_text(node)
            if text:
                out.append((node.path, hash_of(*shown), text))
        stack += [c for c in children if not c.never]
    return out


def blocks(root: _Node, low: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The texts of the blocks that remain, in page order. ``low`` holds the paths of low importance.

    Of a node of low importance its own text goes; what hangs below it has a path, and an importance, of its own.
    """
    marked = _has_article(root)
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _clean("".join(run))
        run.clear()
        if text:
            out.append(text)

    # (node or text, inside the article, in a block of low importance); None ends a block.
    stack: list[tuple[_Node | str | None, bool, bool]] = [(root, False, False)]
    while stack:
        part, inside, quiet = stack.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            if not quiet and (inside or not marked):
                run.append(part)
        elif part.name == "br":
            run.append(" ")
        elif part.never or part.noise:
            if part.name in _BLOCKS:
                end()
            else:
                run.append(" ")
        else:
            within = inside or part.article
            if part.name in _BLOCKS:
                end()
                stack.append((None, inside, quiet))
                quiet = part.path in low
            stack += [(p, within, quiet) for p in reversed(part.parts)]
    end()
    return out


def _has_article(root: _Node) -> bool:
    """Whether a part outside of noise is marked as the article and has text."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        for part in node.parts:
            if isinstance(part, str):
                if inside and part.strip():
                    return True
            elif not part.never and not part.noise:
                stack.append((part, inside or part.article))
    return False


def host(url: str = "url") -> Column:
    """The host of an address, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_trees(pages: DataFrame, least_pages: int = LEAST_PAGES, decay: float = DECAY) -> DataFrame:
    """``_host``, ``_path``, ``_pages`` and ``_importance`` of the nodes of all sites that ``least_pages`` different pages have.

    Each different page of a host counts once for each layout and text of a node. Tasks and partial groups merge what is
    alike before it is shuffled, and groups are by node, so a host with any number of pages is spread over all tasks.
    A node's importance is the greater of its content (entropy of its texts) and its presentation (entropy of its
    layouts, weighted by how many there are), both to the base of the number of pages.
    """
    source = pages.select(host().alias("_host"), F.coalesce("html", F.lit("")).alias("_html"))
    names = ["_host", "_path", "_layout", "_text", "_page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in balanced(pc.binary_length(batch.column(1)).to_pylist(), BATCH_BYTES):
                found: set[tuple] = set()
                for site, html in set(zip(batch.column(0).slice(first, last - first).to_pylist(), batch.column(1).slice(first, last - first).to_pylist())):
                    page, seen = hash_of(html), {}
                    for path, layout, text in style_nodes(parse(html)):
                        shapes, shown = seen.setdefault(path, ({}, []))
                        shapes[layout] = None
                        shown.append(text)
                    for path, (shapes, shown) in seen.items():
                        found.add((site, path, hash_of(*shapes), hash_of(*shown), page))
                columns = list(zip(*found)) or [()] * 5
                arrays = [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    found = source.mapInArrow(run, "_host string, _path long, _layout long, _text long, _page long").distinct()
    counted = found.groupBy(*names[:4]).agg(F.count("*").alias("_n"))
    counted = written(counted, "styles")

    def spread(column: str, entropy: str) -> DataFrame:
        """Entropy of a column over the pages that have the node, to the base of their number; 1 for a single page."""
        by = counted.groupBy("_host", "_path", column).agg(F.sum("_n").alias("_k"))
        total = by.groupBy("_host", "_path").agg(
            F.sum("_k").alias("_pages"), F.sum(F.col("_k") * F.log("_k")).alias("_sum"), F.count("*").alias("_kinds")
        )
        # -sum p log p with p = k / n is log n - sum(k log k) / n.
        value = (F.log("_pages") - F.col("_sum") / F.col("_pages")) / F.log("_pages")
        return total.select("_host", "_path", "_pages", F.when(F.col("_pages") > 1, value).otherwise(1.0).alias(entropy), F.col("_kinds").alias(f"{entropy}_kinds"))

    shapes = spread("_layout", "_shape").select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "_shape", "_shape_kinds")
    nodes = spread("_text", "_shown").join(shapes, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")))
    own = (1 - F.pow(F.lit(decay), F.col("_shape_kinds"))) * F.col("_shape")
    return nodes.filter(F.col("_pages") >= least_pages).select("_host", "_path", "_pages", F.greatest("_shown", own).alias("_importance"))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, threshold: float = THRESHOLD, decay: float = DECAY) -> DataFrame:
    """Per row of ``pages``: page_id, url, ``text`` (empty if none) and ``n_chars``.

    Blocks are joined in page order by an empty line, white space inside a block is one space, character references
    are decoded. Null html gives no text; a null or odd address is a host of its own name, the empty one; repeated rows
    and equal pages of a host count once in its tree and give repeated results. Long and deeply nested pages take time in
    proportion to their size. Only page_id, url and html are read.

    The paths of low importance go to all tasks while they are at most ``SHARED_BYTES``, so pages stay where they lie;
    beyond that, pages and paths meet by host, large hosts in ``SALTS`` groups.
    """
    trees = site_trees(pages, least_pages, decay)
    low = written(trees.filter(F.col("_importance") < threshold).select("_host", "_path"), "low")
    source = pages.select("page_id", "url", host().alias("_host"), F.coalesce("html", F.lit("")).alias("_html"))
    fields = [source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType(fields)
    size = low.agg(F.sum(F.octet_length("_host") + 8)).first()[0] or 0
    shared = None
    if size <= SHARED_BYTES:
        known: dict[str, set[int]] = {}
        for site, path in low.collect():
            known.setdefault(site, set()).add(path)
        shared = pages.sparkSession.sparkContext.broadcast(known)
        source = source.select("page_id", "url", "_html", "_host")
    else:
        by_host = low.groupBy(F.col("_host").alias("_h")).agg(F.collect_list("_path").alias("_low"))
        by_host = by_host.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = source.withColumn("_salt", F.pmod(F.xxhash64("page_id", "_html"), F.lit(SALTS)).cast("int"))
        salted = salted.join(by_host, (F.col("_host") == F.col("_h")) & (F.col("_salt") == F.col("_s")), "left")
        source = salted.select("page_id", "url", "_html", "_low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in balanced(pc.binary_length(batch.column(2)).to_pylist(), BATCH_BYTES):
                part = batch.slice(first, last - first)
                keys = part.column(3).to_pylist()
                paths = [set(x or ()) for x in keys] if shared is None else [shared.value.get(x, frozenset()) for x in keys]
                found = ["\n\n".join(blocks(parse(html), low)) for html, low in zip(part.column(2).to_pylist(), paths)]
                arrays = [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return source.mapInArrow(run, schema)
