"""Main text of web pages by a site style tree.

Pages of one host are merged into a tree of nodes: a node is the path of tags, classes and marks from the body, known by a running
hash (XXH64) of all of them. Pages are one article and count once if they have the same longest block, of those that half of the
node's pages show at most; so copies do not make their article look like boilerplate. Over the articles of a host that show a
node, two entropies are measured:

* content: of each text, how evenly the node's articles share it (0: all of them show it; 1: one alone does), and of the node, how much
  its texts differ;
* presentation: how much the children (tags, classes, ids) of the node that holds the text differ.

The composite of both, ``GAMMA`` parts content, is the importance of a text or node. The names of a branch are a prior worth ``PRIOR_PAGES``
articles: 1 where classes or ids say article, ``UNMARKED`` where they say nothing; tags and roles that say so are worth ``TAG_PAGES``. What falls below ``THRESHOLD`` goes: a text that
more than half of the node's articles show, or all texts of a node.

Branches marked as navigation, advert, comment, notice and the like go by their mark, since they differ from page to page as
articles do. A mark by class or id names alone is outvoted where nothing else speaks: if the branch holds nearly all
of a host's differing text (``VOICE``) over ``ENOUGH`` articles or more and its composite is at least ``SURE``, it is the main branch.
What is left is text, one line per block.

Statistics are combined per node and text before anything is brought together. What goes is joined to the pages' own nodes and texts, so
a page gets a list of its own, however many pages its host has; the lists are sent to all executors up to a
checked size (``common.small``).

Results: a null html is empty and gives an empty text. Rows are kept as they come, repeated or without id; a row
without url belongs to an unnamed host. Markup that is cut off or badly nested is read as browsers do in the main:
unclosed blocks end where the next begins. Of longest blocks of one length the greatest hash counts. Other columns play no part. An
empty table gives an empty one.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import map_texts, small, stored, texts_of

THRESHOLD, GAMMA = 0.3, 0.9
PRIOR_PAGES, TAG_PAGES, UNMARKED = 5, 50, 0.6
KEPT_MARKS = ("article", "content", "")
VOICE, ENOUGH, SURE = 0.9, 6, 0.5

# Fixed values of the markup language and of how sites name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript head template svg math canvas"
                    " object audio video select button datalist map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small"
                   " span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
CONTENT_ROLES = frozenset("main article".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner banners sponsor sponsored promo promos promotion"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead comment comments"
    " commentlist respond disqus reply replies notice notices cookie cookies consent gdpr popup modal overlay newsletter"
    " subscribe subscription signup login search searchbox share sharing social related recommended widget widgets pagination"
    " pager toolbar topbar alert toast form".split())
CONTENT_NAMES = frozenset("article content main post entry story".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile("[a-z]+")
_DIGITS = re.compile("[0-9]+")
_ABOUT = frozenset("has with no without is".split())  # "has-sidebar" tells of another node
_TITLES = frozenset("header masthead banner".split())  # within an article they hold its title
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
                      " header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}
_BARRIERS = frozenset("body table ul ol dl div article section main td th blockquote".split())


def _marks(tag: str, attributes: str, in_content: bool) -> tuple[str, str, bool]:
    """Name of a node, its mark (noise and article by tag or role; named and content by names alone; or none), and whether
    it is hidden."""
    if not attributes.strip():
        found = {}
    else:
        found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    name = " ".join([tag, *(_DIGITS.sub("0", n) for n in names)]) + (f"\n@{role}" if role else "")
    hidden = ("hidden" in found or found.get("aria-hidden", "").lower() == "true"
              or bool(_HIDDEN.search(found.get("style", ""))))
    if tag in NOISE_TAGS or role in NOISE_ROLES or tag == "header" and not in_content:
        return name, "noise", hidden
    noisy = {w for n in names if (parts := _NAME.findall(n)) and parts[0] not in _ABOUT for w in parts if w in NOISE_NAMES}
    if noisy - (_TITLES if in_content else set()) and not CONTENT_NAMES & set(names) and tag not in ("html", "body", *CONTENT_TAGS):
        return name, "named", hidden
    if tag in CONTENT_TAGS or role in CONTENT_ROLES:
        return name, "article", hidden
    if tag in ("div", "section") and any(w in CONTENT_NAMES for n in names for w in _NAME.findall(n)):
        return name, "content", hidden
    return name, "", hidden


class _Node:
    __slots__ = ("tag", "path", "mark", "gone", "up", "root")

    def __init__(self, tag: str, path: int, mark: str, gone: bool, up: int = 0, root: int | None = None):
        self.tag, self.path, self.mark, self.gone, self.up, self.root = tag, path, mark, gone, up, root


def blocks(page: str, styles: dict[int, list] | None = None):
    """The blocks of a page in order: (path, mark, path of the node above, root of a named branch or None, text).

    ``styles`` is filled with the names of the children that each node of the page has.
    """
    stack = [_Node("", 0, "", False)]
    parts: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text and not stack[-1].gone:
            node = next(n for n in reversed(stack) if n.tag not in INLINE)
            return [(node.path, node.mark, node.up, node.root, text)]
        return []

    def pop(at: int):
        del stack[at:]

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        start = token.start() if token else size
        if start > at and not stack[-1].gone:
            parts.append(page[at:start])
        if not token:
            break
        at = token.end()
        if token[2] is None:
            continue
        tag, closing = token[2].lower(), bool(token[1])
        if tag in INLINE:
            if closing:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag == tag:
                        if parts and stack[n].gone != stack[n - 1].gone:
                            parts.clear()
                        del stack[n]
                        break
                    if stack[n].tag not in INLINE:
                        break
            elif tag not in VOID:
                top = stack[-1]
                _, mark, gone = _marks(tag, token[3], top.mark in ("article", "content")) if token[3].strip() else ("", "", False)
                gone = gone or mark in ("noise", "named")
                if gone and not top.gone:
                    yield from flush()
                stack.append(_Node(tag, top.path, top.mark, top.gone or gone, top.up, top.root))
            continue
        yield from flush()
        if closing:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    pop(n)
                    break
            continue
        if tag in _CLOSES_P:
            _close(stack, ("p",), pop)
        if tag in _SIBLINGS:
            _close(stack, _SIBLINGS[tag], pop)
        if tag in _HEADINGS:
            _close(stack, tuple(_HEADINGS), pop)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        top = stack[-1]
        name, mark, gone = _marks(tag, token[3], top.mark in ("article", "content"))
        both = (top.mark, mark)
        mark = next((m for m in ("noise", "named", "article") if m in both), mark or top.mark)
        path = xxhash.xxh64_intdigest(f"{top.path}/{mark}/{name}") - (1 << 63)
        if styles is not None:
            styles.setdefault(top.path, []).append(name)
        root = top.root if top.root is not None or mark != "named" else path
        stack.append(_Node(tag, path, mark, top.gone or gone or tag in DROPPED, top.path, root))
    yield from flush()


def _close(stack: list[_Node], tags: tuple[str, ...], pop) -> None:
    """End an open element of ``tags``, if no other kind of block was opened since."""
    for n in range(len(stack) - 1, 0, -1):
        if stack[n].tag in tags:
            pop(n)
            return
        if stack[n].tag in _BARRIERS:
            return


def host(url: Column) -> Column:
    """The host of a url in lower case, without port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def text_key(path: int, text: str) -> int:
    """A text at a node, as a signed number."""
    return xxhash.xxh64_intdigest(f"{path}/{text}") - (1 << 63)


_SHOWN = ("row long, host string, page long, kind string, path long, mark string, up long, root long, key long, size long")


def shown(pages: DataFrame) -> DataFrame:
    """What every page shows, stored: a row per text (``key``, ``size`` in characters) and per node with its style (``key`` of its
    children's names). pages: row, host, html."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in _SHOWN.split(", ")]

    def make():
        def step(batch):
            rows = []
            for row, host_name, page in zip(batch.column("row").to_pylist(), batch.column("host").to_pylist(), texts_of(batch, "html")):
                styles: dict[int, list] = {}
                found = list(blocks(page, styles))
                whole = xxhash.xxh64_intdigest(page) - (1 << 63)
                rows += [(row, host_name, whole, "text", path, mark, up, root, text_key(path, text), len(text))
                         for path, mark, up, root, text in found]
                rows += [(row, host_name, whole, "node", path, "", 0, None, xxhash.xxh64_intdigest("\0".join(of)) - (1 << 63), len(of))
                         for path, of in styles.items()]
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        return step

    return stored(map_texts(pages, _SHOWN, make, "html"), "page-nodes")


def _evenness(total: Column, log_sum: Column) -> Column:
    """Entropy of counts as a share of the largest possible; log_sum: of c * log(c)."""
    return F.when(total > 1, (F.log(total) - log_sum / total) / F.log(total)).otherwise(1.0)


def with_article(shown: DataFrame) -> DataFrame:
    """The rows of ``shown`` with the article that their page tells: its longest text, of those that are not on most pages."""
    node = ["host", "path"]
    texts = shown.where("kind = 'text'").select("host", "page", "path", "key", "size").distinct()
    counts = texts.groupBy(*node, "key").agg(F.count(F.lit(1)).alias("c"))
    pages = texts.select(*node, "page").distinct().groupBy(*node).agg(F.count(F.lit(1)).alias("m"))
    # A node has few such texts, at most twice as many as a page shows there.
    common = counts.join(pages, node).where("m > 1 AND c * 2 > m").select(*node, "key")
    told = texts.join(small(stored(common, "common-texts")), [*node, "key"], "left_anti").groupBy("host", "page").agg(
        F.max_by("key", F.struct("size", "key")).alias("article"))
    return shown.join(told, ["host", "page"], "left").withColumn("article", F.coalesce("article", "page"))


def importance(shown: DataFrame) -> DataFrame:
    """Of every text at a node (``host``, ``path``, ``mark``, ``up``, ``root``, ``key``, ``size``): ``c`` and ``m``, the articles that show it
    and its node, the composite importance ``measured`` of the text and ``node_measured`` of the node, and both with the
    prior of the mark: ``importance`` and ``node_importance``."""
    node = ["host", "path"]
    seen = shown.where("kind = 'text'").groupBy(*node, "mark", "up", "root", "key", "article").agg(F.max("size").alias("size"))
    texts = stored(seen.groupBy(*node, "mark", "up", "root", "key").agg(
        F.count(F.lit(1)).alias("c"), F.max("size").alias("size")), "texts")
    nodes = texts.groupBy(*node).agg(
        _evenness(F.sum("c"), F.sum(F.col("c") * F.log("c"))).alias("differ"))
    articles = seen.select(*node, "article").distinct().groupBy(*node).agg(F.count(F.lit(1)).alias("m"))
    # The style of a node is that of all its places in an article; copies of an article may have several.
    styled = (shown.where("kind = 'node'").select("host", F.col("path").alias("up"), "article", "key").distinct()
              .groupBy("host", "up", "key").agg(F.count(F.lit(1)).alias("s")))
    styles = styled.groupBy("host", "up").agg(F.sum("s").alias("n"), F.sum(F.col("s") * F.log("s")).alias("logs"))
    looks = styles.select("host", "up", F.when(F.col("n") > 1, _evenness(F.col("n"), F.col("logs"))).otherwise(1.0).alias("looks"))
    # A node's figures go to its texts, which may be very many: sent around, or joined as tables that can be split.
    joined = texts.join(small(stored(nodes.join(articles, node), "nodes")), node).join(
        small(stored(looks, "node-styles")), ["host", "up"])
    alone = F.when(F.col("m") > 1, 1 - F.log("c") / F.log("m")).otherwise(1.0)
    prior = F.when(F.col("mark").isin("article", "content"), 1.0).otherwise(UNMARKED)
    worth = F.when(F.col("mark") == "article", TAG_PAGES).otherwise(PRIOR_PAGES)

    def composite(content: Column) -> Column:
        return content * GAMMA + F.col("looks") * (1 - GAMMA)

    def weighed(measured: Column) -> Column:
        return (F.col("m") * measured + prior * worth) / (F.col("m") + worth)

    return joined.withColumns({"measured": composite(alone), "node_measured": composite(F.col("differ"))}).withColumns({
        "importance": weighed(F.col("measured")), "node_importance": weighed(F.col("node_measured"))})


def main_branches(texts: DataFrame) -> DataFrame:
    """Per host whose text all stands in one branch that its names call noise: ``host`` and ``kept_root``, that branch."""
    said = F.col("size") * F.col("c") * F.col("measured")
    heard = F.sum(F.when(F.col("mark").isin(*KEPT_MARKS), said).otherwise(0.0))
    whole = texts.groupBy("host").agg(heard.alias("elsewhere"))
    branches = texts.where("root IS NOT NULL").groupBy("host", "root").agg(
        F.sum(said).alias("says"), F.max("m").alias("articles"), (F.sum(said) / F.sum(F.col("size") * F.col("c"))).alias("sure"))
    loudest = branches.groupBy("host").agg(F.max_by(F.struct("root", "articles", "sure", "says"), F.struct("says", "root")).alias("b"))
    return loudest.join(whole, "host").where(
        (F.col("b.articles") >= ENOUGH) & (F.col("b.sure") >= SURE) & (F.col("elsewhere") <= (1 - VOICE) * F.col("b.says"))
    ).select("host", F.col("b.root").alias("kept_root"))


def main_text(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): ``page_id``, ``url`` and ``text``."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), "url", "html",
                        host(F.col("url")).alias("host"))
    nodes = shown(rows.where("html IS NOT NULL").select("row", "host", "html"))
    texts = stored(importance(stored(with_article(nodes), "page-articles")), "page-texts")
    kept = small(stored(main_branches(texts), "main-branches"))
    low = (F.col("importance") < THRESHOLD) & (F.col("c") * 2 > F.col("m")) | (F.col("node_importance") < THRESHOLD)
    # Noise goes by its mark, but for the branches that are kept after all.
    judged = texts.where(low).join(kept, "host", "left").where(F.col("mark").isin(*KEPT_MARKS) | (F.col("root") == F.col("kept_root")))
    gone = small(stored(judged.select("host", "path", "key"), "low-texts"))
    lists = (nodes.where("kind = 'text'").select("row", "host", "path", "key").join(gone, ["host", "path", "key"])
             .groupBy("row").agg(F.collect_set("key").alias("removed")))
    joined = rows.join(small(stored(lists, "page-lists")), "row", "left").join(kept, "host", "left").select(
        "page_id", "url", "html", "removed", "kept_root")
    kind = joined.schema["page_id"].dataType.simpleString()

    def make():
        def step(batch):
            lists, roots = batch.column("removed").to_pylist(), batch.column("kept_root").to_pylist()
            texts = ["\n".join(kept_texts(page, frozenset(removed or ()), root))
                     for page, removed, root in zip(texts_of(batch, "html"), lists, roots)]
            return pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        return step

    return map_texts(joined, f"page_id {kind}, url string, text string", make, "html")


def kept_texts(page: str, removed=frozenset(), kept_root: int | None = None) -> list[str]:
    """The texts of a page that stay. removed: keys of texts; kept_root: the named branch that counts as content."""
    return [text for path, mark, _, root, text in blocks(page)
            if (mark in KEPT_MARKS or mark == "named" and root == kept_root) and (not removed or text_key(path, text) not in removed)]
