"""Main text of web pages, with site template removal.

1. Every page is parsed, and each block element below the page's frame, and each
   inline element that stands alone in a container, is hashed with its whole
   subtree: tags and text. Rows, cells and captions count with their table or
   list only (``PARTS``).
2. Spark counts, per host, the distinct pages that hold a subtree. One that is
   on ``PAGES`` distinct pages or more is template, however large the host. Pages with equal html count once, so copies of a page make no
   template; counts are aggregated before the shuffle, so a host may hold any
   share of all pages.
3. A page that shows template is parsed again with the hashes of that; its text
   is taken without them.

Text comes from the article: the outermost ``article`` elements, else ``main``,
else an element named as content, else the body; of these the first that has at
least half as much prose as the richest one. Articles whose text is mostly links are
teasers and go if there is another one; so do articles in a ``main`` element chosen
before them. Template goes there, prose or
not; only in an ``article`` element nothing but recurring containers without a
paragraph or heading of prose goes, so an article's own passages stay however
often they recur. Elements that are never an article's text (``DROPPED``) and
elements named as menus, sidebars, notices, adverts, forms or comments always go. A
name is a whole token of class or id whose words are all in ``NAMED`` or ``AROUND``,
one at least in ``NAMED``: ``ad-slot`` and ``site-footer``, but not ``form-factor`` or
``related-work``; in an ``article`` element, the id of a section of prose isn't a name.

Block elements end a block; inside a block white space becomes one space and
the ends are trimmed; blocks are joined by a line feed. Character references
are decoded.

Cases: null or empty html gives an empty text; broken markup is read as far as
it goes, unclosed elements end with their parents; a null url has the empty
host; null or repeated ids are kept; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamer.llm.store import short_batches, written

#: Distinct pages of a host from which on a subtree is template.
PAGES = 5

# Element names and words of class, id and role attributes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("head title script style noscript template iframe object embed svg canvas annotation annotation-xml nav header footer aside form button select option textarea input label fieldset dialog menu audio video map".split())
CONTAINERS = set("div section nav header footer aside ul ol dl table form menu details figure center main".split())
BLOCKS = CONTAINERS | set("html body article p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre address figcaption hr hgroup search summary legend".split())
PARTS = set("html body td th tr thead tbody tfoot dt dd caption figcaption legend summary hr".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CLOSES_P = BLOCKS - {"td", "th", "tr", "li", "dt", "dd", "thead", "tbody", "tfoot", "caption", "body", "html"}
NAMED = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer colophon sidebar aside rail widget widgets "
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored sponsors "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist disqus respond reply replies discussion "
    "share sharing social related recommended recommendations pagination pager toolbar skip hidden search searchbox form".split()
)
AROUND = set(
    "site page main global top bottom left right upper lower inner outer sticky fixed floating mobile desktop primary secondary "
    "bar box block area wrapper wrap container holder panel list item items section slot unit row column col group content links link buttons button icons icon "
    "text body title heading message module component element policy thread count form post entry article user reader by for and the my our js".split()
)
CONTENT = set("article post entry content story main body text maincontent articlebody postbody postcontent entrycontent storybody".split())
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MODIFIED = re.compile(r"(?i)\b(?:has|with|without|no)[-_]\w+")
_RAW = {t: re.compile(rf"(?i)</{t}(?=[\s/>])") for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}


class Node:
    __slots__ = ("children", "key", "said", "tag")

    def __init__(self, tag: str, said: str) -> None:
        self.tag, self.said, self.children, self.key = tag, said, [], 0

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.said)} if self.said.strip() else {}


def _close(opened: list[Node], tags: set[str], until: set[str]) -> None:
    """Close up to the innermost open element of these names, if none of ``until`` is in between."""
    for i in range(len(opened) - 1, 0, -1):
        if opened[i].tag in tags:
            del opened[i:]
            return
        if opened[i].tag in until:
            return


#: What a start tag closes: these elements, unless one of those lies between.
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ENDS = {t: [({"p"}, {"article", "div", "section", "td", "th", "table", "button", "body"})] for t in CLOSES_P}
for _t in _HEADINGS:
    _ENDS[_t] = [*_ENDS[_t], (_HEADINGS, BLOCKS - _HEADINGS)]
for _t, _own, _until in (("li", {"li"}, {"ul", "ol", "menu"}), ("dt", {"dt", "dd"}, {"dl"}), ("dd", {"dt", "dd"}, {"dl"}), ("td", {"td", "th"}, {"table", "tr"}), ("th", {"td", "th"}, {"table", "tr"}), ("tr", {"tr"}, {"table"}), ("option", {"option"}, {"select"}), ("body", {"head"}, {"body"})):
    _ENDS[_t] = [*_ENDS.get(_t, []), (_own, _until)]


def parsed(html: str | None) -> Node:
    """The tree of a page; text nodes are strings with character references decoded."""
    html = html or ""
    root = Node("", "")
    opened, at, end = [root], 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else end]
        if text:
            opened[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            inline = tag not in BLOCKS
            for i in range(len(opened) - 1, 0, -1):
                if opened[i].tag == tag:
                    del opened[i:]
                    break
                if inline and opened[i].tag in BLOCKS:
                    break
            continue
        for tags, until in _ENDS.get(tag, ()):
            _close(opened, tags, until)
        node = Node(tag, m[3])
        opened[-1].children.append(node)
        if tag in _RAW:
            close = _RAW[tag].search(html, at)
            stop = close.start() if close else end
            node.children.append(html[at:stop])
            at = html.find(">", stop) + 1 or end
        elif tag not in VOID:
            opened.append(node)
    return root


def _every(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]


def hashed(root: Node) -> None:
    """Set ``key`` of every node: the hash of its tag and its children's keys and text."""
    for node in reversed(list(_every(root))):
        h = xxhash.xxh64(node.tag)
        for c in node.children:
            h.update(c.key.to_bytes(8, "little") if isinstance(c, Node) else b"\0" + " ".join(c.split()).encode("utf-8", "surrogatepass"))
        node.key = h.intdigest()


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _words(token: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(token)]


def _names(said: dict[str, str]) -> set[str]:
    """The words of class and id, without those that a modifier like has- introduces."""
    return set(_words(_MODIFIED.sub(" ", f"{said.get('class', '')} {said.get('id', '')}")))


def _named(text: str) -> bool:
    """Whether a token is a name of what isn't the article; a title or body with the header of an article is none."""
    for token in _MODIFIED.sub(" ", text).split():
        words = set(_words(token))
        strong = words & NAMED
        if words & {"article", "post", "entry", "section"} or len(words) > 1 and words & {"title", "heading", "text", "content"}:
            strong -= {"header", "masthead"}
        if strong and words <= NAMED | AROUND:
            return True
    return False


def _holds_prose(node: Node) -> bool:
    return any(x.tag in PROSE for x in _every(node))


def unwanted(node: Node, in_article: bool = False) -> bool:
    if node.tag in DROPPED:
        return True
    if not node.said:
        return False
    said = node.attributes()
    if said.get("role", "").lower() in ROLES or "hidden" in said or said.get("aria-hidden") == "true":
        return True
    if node.tag in ("html", "body", "main") or node.tag in PROSE:
        return False
    if _named(said.get("class", "")):
        return True
    return _named(said.get("id", "")) and not (in_article and node.tag in ("section", "div") and _holds_prose(node))


def _outermost(root: Node, wanted: Callable[[Node], bool]) -> list[Node]:
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if unwanted(x):
            continue
        if x is not root and wanted(x):
            found.append(x)
        else:
            stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    return found


def _lengths(node: Node, skip: set[int] = frozenset()) -> tuple[int, int, int]:
    """Characters of wanted text, of those in prose, and of those in links."""
    whole = prose = links = 0
    stack = [(node, False, False)]
    while stack:
        x, in_prose, in_link = stack.pop()
        if isinstance(x, str):
            n = len("".join(x.split()))
            whole, prose, links = whole + n, prose + n * in_prose, links + n * in_link
        elif x is node or not (id(x) in skip or unwanted(x)):
            stack += [(c, in_prose or x.tag in PROSE, in_link or x.tag == "a") for c in x.children]
    return whole, prose, links


def regions(root: Node) -> tuple[list[Node], set[int]]:
    """Where the main text is, and what in it goes as teasers."""
    articles = _outermost(root, lambda x: x.tag == "article")
    if len(articles) > 1:
        sizes = [_lengths(x) for x in articles]
        own = [x for x, (whole, _, links) in zip(articles, sizes, strict=True) if 2 * links < whole]
        articles = own or articles
    mains = _outermost(root, lambda x: x.tag == "main" or "role" in x.said and x.attributes().get("role") == "main")
    inside = {id(x) for x in articles}
    named = [] if articles or mains else _outermost(root, lambda x: x.tag in ("div", "section", "td") and bool(x.said) and bool(_names(x.attributes()) & CONTENT))
    if not mains:
        return articles or named, set()
    if not articles:
        return mains, set()
    prose = lambda where, skip=frozenset(): sum(_lengths(x, skip)[1] for x in where)
    if 2 * prose(articles) >= prose(mains, {id(x) for m in mains for x in _every(m) if x.tag == "article"}):
        return articles, set()
    return mains, {id(x) for m in mains for x in _every(m) if x.tag == "article"} | inside


def candidates(root: Node, where: list[Node]) -> Iterator[Node]:
    """The elements that can be template and hold anything."""
    frame = set(map(id, where))
    alone: set[int] = set()
    for x in _every(root):
        if (x.tag in CONTAINERS or x.tag in ("", "html", "body", "article", "li")) and not any(isinstance(c, str) and c.strip() for c in x.children):
            alone.update(id(c) for c in x.children if isinstance(c, Node))
        counts = x.tag not in PARTS if x.tag in BLOCKS else id(x) in alone and x.tag not in DROPPED
        if counts and x.children and id(x) not in frame:
            yield x


def removable(node: Node, in_article: bool) -> bool:
    """Whether a region gives this element up if it is template."""
    return not in_article or (node.tag in CONTAINERS and not _holds_prose(node))


def subtrees(html: str | None) -> dict[int, bool]:
    """Hashes of a page's elements that can be template, with whether the page's text would lose one."""
    root = parsed(html)
    hashed(root)
    where, teasers = regions(root)
    shown: set[int] = set()
    for top in where or [root]:
        stack, in_article = [top], top.tag == "article"
        while stack:
            x = stack.pop()
            if x is not top and (id(x) in teasers or unwanted(x, in_article)):
                continue
            if removable(x, in_article):
                shown.add(id(x))
            stack += [c for c in x.children if isinstance(c, Node)]
    found: dict[int, bool] = {}
    for x in candidates(root, where):
        key = _signed(x.key)
        found[key] = found.get(key, False) or id(x) in shown
    return found


def main_text(html: str | None, template: set[int]) -> str:
    """The main text of a page without the elements of these hashes."""
    root = parsed(html)
    where, teasers = regions(root)
    gone: set[int] = set()
    if template:
        hashed(root)
        gone = {id(x) for x in candidates(root, where) if _signed(x.key) in template}
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if words := "".join(line).split():
            blocks.append(" ".join(words))
        line.clear()

    for top in where or [root]:
        stack: list[Node | str | None] = [top]
        in_article = top.tag == "article"
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag == "br":
                line.append(" ")
            elif x is top or not (id(x) in teasers or unwanted(x, in_article) or (id(x) in gone and removable(x, in_article))):
                if x.tag in BLOCKS:
                    end()
                    stack.append(None)
                stack += reversed(x.children)
        end()
    return "\n".join(blocks)


def host(url: Column) -> Column:
    """The host of a url in lower case without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, keys, shown = [], [], []
        for i, html in enumerate(batch.column(1)):
            found = subtrees(html.as_py())
            rows += [i] * len(found)
            keys += found
            shown += found.values()
        yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64()), pa.array(shown, pa.bool_())], names=["page", "key", "shown"])


def templates(pages: DataFrame, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """((host, html_hash, key, shown) of all that can be template, (host, key) of those that are)."""
    one = pages.select(host(F.col(url_col)).alias("host"), F.xxhash64(F.coalesce(html_col, F.lit(""))).alias("html_hash"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = one.select(F.struct("host", "html_hash").alias("page"), "html").mapInArrow(_hashes, "page struct<host: string, html_hash: long>, key long, shown boolean")
    held = written(rows.select("page.*", "key", "shown").distinct(), "html-subtrees")
    counts = held.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.max("shown").alias("shown")).where((F.col("n") >= PAGES) & F.col("shown"))
    return held, written(counts.select("host", "key"), "html-templates")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py(), set(t.as_py() or ())) for h, t in zip(batch.column(1), batch.column(2), strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars."""
    short_batches(pages.sparkSession)
    held, template = templates(pages, url_col, html_col)
    own = held.where("shown").join(template, ["host", "key"]).groupBy("host", "html_hash").agg(F.collect_list("key").alias("keys"))
    own = written(own.select(F.col("host").alias("t_host"), F.col("html_hash").alias("t_hash"), "keys"), "html-found")
    one = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("row"), host(F.col(url_col)).alias("host"), F.xxhash64(F.coalesce(html_col, F.lit(""))).alias("html_hash"), F.coalesce(html_col, F.lit("")).alias("html"))
    ready = one.join(own, (F.col("host") == F.col("t_host")) & (F.col("html_hash") == F.col("t_hash")), "left").select("row", "html", "keys")
    out = ready.mapInArrow(_texts, f"row {ready.schema['row'].dataType.simpleString()}, text string")
    return out.select(F.col("row.id").alias(id_col), F.col("row.url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
