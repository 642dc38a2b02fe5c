"""The main text of HTML pages, with site templates removed.

Every element's subtree has a hash of its tags and text. Spark counts on how
many pages of a host each hash is; subtrees that recur are the site's template
and are deleted. How often they must recur depends on where they stand: some
pages are enough beside the main part, half of the host's pages within it, and
passages of an ``article`` always stay. What is left of the article, without the
parts whose tag or name says they are no text of it, is the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from trunkwatch.llm.common import stored, table, text_of
from trunkwatch.llm.url_filter import host
from trunkwatch.sources.tables import named

#: A subtree within the main part is template on this share of a host's pages, and on so many.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 4
#: One beside it on that many, too, and this share of the host's pages or the number behind it.
BESIDE_SHARE, BESIDE_PAGES = 0.01, 1000
#: Where a subtree stands: in a part that is not read, beside the main part, in it, or as a passage of an article.
UNREAD, BESIDE, WITHIN, SAFE = range(4)

#: Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset("head script style noscript template svg math nav header footer aside form button select textarea "
                    "input iframe object embed canvas audio video dialog menu title option label".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                   "option p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "title"}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: An opening tag that closes an open one of the named, up to the barrier.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"}), "article": ({"nav"}, {"body"}), "main": ({"nav"}, {"body"})}
_P_BARRIERS = frozenset("article aside body button div section main td th table li blockquote nav header footer form".split())
#: Words in a class, id or role that name no text of the article.
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banners?|sidebars?|menus?|"
    r"nav(?:bar|igation)?|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|"
    r"newsletter|subscribe|signup|login|comments?|disqus|replies|reply|respond|share|sharing|social|related|recommended|"
    r"widgets?|pagination|pager|toolbar|search|skip|contentinfo|complementary|site-header|page-header|header)(?:$|[\s_-])", re.I)
#: Those of them that in an article may also name a part of its text: there they count for parts that are not mostly passages.
_DOUBTFUL = re.compile(
    r"(?:^|[\s_-])(?:promo(?:tion)?s?|banners?|menus?|masthead|alerts?|overlay|related|recommended|widgets?|pagination|pager|"
    r"toolbar|search|skip|contentinfo|complementary|site-header|page-header|header)(?=$|[\s_-])", re.I)
#: Names that say it of a passage or of a part of a line, too, when they are a whole name.
_ADVERT = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|cookie-notice|hidden-element)(?:$|\s)", re.I)
#: Dropped elsewhere; in an article their text belongs to it.
_TEXT_IN_ARTICLE = frozenset("svg math title label".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|$)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.I)


class Element:
    __slots__ = ("tag", "names", "children", "hash", "has_text", "size", "prose", "flat")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.children = tag, names, []
        self.hash, self.has_text = 0, False
        # characters, those in passages, and whether no block is in it
        self.size, self.prose, self.flat = 0, 0, True


def parse(page: str) -> Element:
    """The tree of a page, however broken; texts are strings with references decoded."""
    root = Element("#root")
    stack, at, size = [root], 0, len(page)
    open_: dict[str, list[int]] = {}  # by tag, where its open elements are in the stack

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw))

    def innermost(tags) -> int:
        return max((open_[tag][-1] for tag in tags if open_.get(tag)), default=0)

    def leave(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop().tag].pop()

    def close(tags: set[str], barriers) -> None:
        depth = innermost(tags)
        if depth and depth >= innermost(barriers):
            leave(depth)

    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        if found.group(1) is not None:
            text(found.group(1))
            continue
        tag = (found.group(3) or "").lower()
        if not tag:
            continue
        if found.group(2):
            if open_.get(tag):
                leave(open_[tag][-1])
            continue
        names = " ".join((v or k).strip("\"'") if k.lower() != "hidden" else "hidden-element"
                         for k, v in _NAMES.findall(found.group(4))) if found.group(4) else ""
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in CLOSES_P:
            close({"p"}, _P_BARRIERS)
        element = Element(tag, names)
        stack[-1].children.append(element)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*>?", re.I).search(page, at)
            element.children.append(page[at:end.start() if end else size])
            at = end.end() if end else size
        elif not found.group(4).endswith("/") or tag in BLOCKS:
            open_.setdefault(tag, []).append(len(stack))
            stack.append(element)
    _hash(root)
    return root


def _hash(root: Element) -> None:
    """Hashes from the leaves up; white space and empty elements do not count."""
    order, todo = [], [root]
    while todo:
        element = todo.pop()
        order.append(element)
        todo.extend(c for c in element.children if isinstance(c, Element))
    for element in reversed(order):
        parts = [element.tag, element.names]
        for child in element.children:
            if isinstance(child, Element):
                if child.has_text:
                    parts.append(f"\x01{child.hash:x}")
                    element.has_text = True
                    if child.tag not in RAW:
                        element.size += child.size
                        element.prose += child.prose
                        element.flat &= child.flat and child.tag not in BLOCKS
            elif words := " ".join(child.split()):
                parts.append(f"\x02{words}")
                element.has_text = True
                element.size += len(words)
        if element.tag in PROSE:
            element.prose = element.size
        element.hash = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))


def _elements(root: Element) -> Iterator[Element]:
    todo = [root]
    while todo:
        element = todo.pop()
        yield element
        todo.extend(c for c in reversed(element.children) if isinstance(c, Element))


def subtrees(root: Element) -> set[int]:
    """The hashes of the elements with text, whole pages, their head and body apart."""
    return set(places(root))


def _is_boilerplate(element: Element) -> bool:
    return element.tag in DROPPED or bool(element.names) and (
        "hidden-element" in element.names or _BOILERPLATE.search(element.names) is not None)


def _left_out(element: Element) -> bool:
    """:func:`_is_boilerplate` of an element in an article.

    What a name says counts for parts, not for passages and parts of a line, unless
    the whole name says it; and a doubtful name only for a part that is not mostly passages.
    """
    if element.tag in DROPPED and element.tag not in _TEXT_IN_ARTICLE:
        return True
    if not element.names:
        return False
    if element.tag in PROSE or element.tag not in BLOCKS:
        return _ADVERT.search(element.names) is not None
    if element.prose and 2 * element.prose >= element.size:
        return "hidden-element" in element.names or _BOILERPLATE.search(_DOUBTFUL.sub(" ", element.names)) is not None
    return _is_boilerplate(element)


def _text(root: Element, template: set[int]) -> str:
    """The text of an article, whose own headers keep their headings, or of another element."""
    found, todo, article = [], [root], root.tag == "article"
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            found.append(node)
            continue
        if article and node.tag == "header":
            todo += [" ", *reversed([e for e in _elements(node) if e.tag in _HEADINGS and not _left_out(e)]), " "]
            continue
        if node is not root and ((_left_out if article else _is_boilerplate)(node) or node.hash in template):
            found.append(" " if node.tag in BLOCKS else "")
            continue
        if node.tag in BLOCKS:
            found.append(" ")
            todo.append(" ")
        todo.extend(reversed(node.children))
    return " ".join("".join(found).split())


def _roots(root: Element) -> list[Element]:
    """The articles, or the main part, or all."""
    articles, mains, todo = [], [], [root]
    while todo:
        element = todo.pop()
        if element.tag != "#root" and (element.tag in ("html", "body") or not _is_boilerplate(element)):
            if element.tag == "article":
                articles.append(element)
                continue
            if element.tag == "main" or "articleBody" in element.names:
                mains.append(element)
        elif element.tag != "#root":
            continue
        todo.extend(c for c in reversed(element.children) if isinstance(c, Element))
    return articles or mains[:1] or [root]


def main_text(root: Element, template: set[int] = frozenset()) -> str:
    """The text of the article; of the whole body where no element is the article or main part."""
    return " ".join(filter(None, (_text(r, template) for r in _roots(root))))


def _main_part(root: Element) -> Element:
    """Where no article is, the element with most text in passages of its own."""
    best, most, todo = root, 0, [root]
    while todo:
        element = todo.pop()
        own = 0
        for child in element.children:
            if isinstance(child, str):
                own += len(" ".join(child.split()))
            elif child.tag in ("html", "body") or not _is_boilerplate(child):
                todo.append(child)
                if child.tag in PROSE or child.flat and child.tag not in ("li", "dt", "dd", "td", "th"):
                    own += child.size
        # of equals the outer one, which is seen first
        if own > most:
            best, most = element, own
    return best


def places(root: Element) -> dict[int, int]:
    """The hashes of the elements with text, whole pages, their head and body apart, and where they stand.

    Of several places of one hash it has the one that protects most. In an article,
    passages and what holds them are safe, and so is everything if passages are not
    most of it.
    """
    roots = _roots(root)
    start = BESIDE if roots[0] is root else UNREAD
    within, holds = set(), set()
    if roots[0].tag != "article":
        part = _main_part(roots[0])
        within, holds = {id(part)}, {id(part)}
        for element in reversed(list(_elements(roots[0]))):
            if any(id(c) in holds for c in element.children):
                holds.add(id(element))
    articles = {id(r) for r in roots if r.tag == "article"}
    found: dict[int, int] = {}
    todo = [(root, start, False)]
    while todo:
        element, place, keeps = todo.pop()
        own = place
        if id(element) in articles:
            own, place, keeps = SAFE, WITHIN, 2 * element.prose < element.size
        elif id(element) in within:
            own = place = WITHIN
        elif id(element) in holds:
            own = WITHIN
            place = BESIDE if element is roots[0] else place
        elif place == WITHIN and articles and (keeps or element.prose):
            own = SAFE
            keeps = keeps or element.tag in PROSE
        if element.has_text and element.tag not in ("#root", "html", "body") and element.tag not in RAW:
            found[element.hash] = max(own, found.get(element.hash, own))
        todo.extend((c, place, keeps) for c in element.children if isinstance(c, Element) and c.tag != "head")
    return found


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _content(root: Element) -> int:
    """What tells a page from its copies: the hash of its main text, templates included."""
    return _signed(xxhash.xxh3_64_intdigest(main_text(root).encode("utf-8", "surrogatepass")))


def _standing(rows: DataFrame) -> DataFrame:
    """``host, mark, content, hash, place`` of the subtrees of (host, mark, page) that may be template; a null hash for each page."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, contents, found, where = [], [], [], []
            for row, text in enumerate(batch.column(2)):
                root = parse(text.as_py())
                own = [(h, p) for h, p in places(root).items() if p != SAFE]
                # a page without subtrees is a page of its host as well
                at += [row] * (len(own) + 1)
                contents += [_content(root)] * (len(own) + 1)
                found += [None, *(_signed(h) for h, _ in own)]
                where += [UNREAD, *(p for _, p in own)]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(contents, pa.int64()),
                 pa.array(found, pa.int64()), pa.array(where, pa.int32())], names=["host", "mark", "content", "hash", "place"])

    return stored(rows.select("host", "mark", "page").mapInArrow(
        hashes, "host string, mark long, content long, hash long, place int"), "host-subtrees")


def _templates(standing: DataFrame, share: float, least: int) -> DataFrame:
    """``host, hash, wide``: the subtrees that are template beside the main part, and whether within it, too."""
    # pages of one main text count as one
    counted = stored(standing.select("host", "content", "hash").distinct().groupBy("host", "hash")
                     .agg(F.count("*").alias("n")).where(F.col("hash").isNull() | (F.col("n") >= least)), "host-counts")
    n_pages = counted.where("hash is null").select("host", F.col("n").alias("pages"))
    many = counted.where("hash is not null").join(n_pages, "host").withColumn("wide", F.col("n") >= share * F.col("pages"))
    beside = F.col("n") >= F.least(BESIDE_SHARE * F.col("pages"), F.lit(BESIDE_PAGES))
    return stored(many.where(F.col("wide") | beside).select("host", "hash", "wide"), "host-templates")


def _rows(pages: DataFrame, url: str, page: str) -> DataFrame:
    rows = pages.select(host(named(url).cast("string")).alias("host"), text_of(page).alias("page"))
    return rows.select("host", F.xxhash64("page").alias("mark"), "page")


def host_templates(pages: DataFrame, url: str = "url", page: str = "html", share: float = TEMPLATE_SHARE,
                   least: int = TEMPLATE_PAGES) -> DataFrame:
    """``host, template``: the hashes of the subtrees that are template somewhere on each host, for a look.

    Pages of a host with the same main text count as one, whatever stands around it.
    """
    standing = _standing(_rows(pages, url, page))
    stands = standing.where("hash is not null").groupBy("host", "hash").agg(F.min("place").alias("place"))
    found = stands.join(_templates(standing, share, least), ["host", "hash"]).where(F.col("wide") | (F.col("place") < WITHIN))
    return found.groupBy("host").agg(F.collect_list("hash").alias("template"))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html",
                      share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> DataFrame:
    """``page_id, url, text`` for every row.

    A null or empty page has an empty text. Pages without a host share an empty
    one. Rows that repeat, and copies of one main text on a host, count as one page
    of it, and each gets its text; an empty table gives no rows. Other columns are
    not read.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(parse(p.as_py()), {h % (1 << 64) for h in t.as_py() or ()})
                     for p, t in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    rows = pages.select(named(page_id).cast("long").alias("page_id"), named(url).cast("string").alias("url"),
                        text_of(page).alias("page"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("mark", F.xxhash64("page"))
    standing = _standing(rows)
    templates = _templates(standing, share, least)
    # each page has only its own: a host may have any number of them
    asked = standing.where(f"hash is not null and place > {UNREAD}").select("host", "mark", "hash", "place").distinct()
    own = asked.join(templates, ["host", "hash"]).where(F.col("wide") | (F.col("place") == BESIDE))
    # written first: pages then need not move to their host's task, or a hot page's can be split
    found = stored(own.groupBy("host", "mark").agg(F.collect_list("hash").alias("template")), "page-templates")
    joined = rows.join(found, ["host", "mark"], "left")
    return joined.select("page_id", "url", "page", "template").mapInArrow(extract, "page_id long, url string, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
