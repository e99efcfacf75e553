"""Main text of web pages: rule-based boilerplate and subtrees that recur on many pages of a host."""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of, written

#: Element names and class or id words that mark what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form button select script style textarea title noscript template iframe svg dialog menu object canvas audio video noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul xmp".split())
INLINE = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments cookie cookies consent disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
#: Words that may stand beside one of those in a compound such as site-footer; with any other word the name tells nothing.
NEUTRAL = frozenset("area bar block bottom box buttons container content footer global google group holder icons inner js links list items main module outer page pane panel placeholder popup posts primary region row secondary section signup site slot top unit wrap wrapper".split())
#: Those that take away prose of the main element, too.
COMMENTS = frozenset("comment commentlist comments replies reply respond disqus".split())
INSERTED = COMMENTS | frozenset("ad ads advert adverts advertisement advertising newsletter promo promoted sponsor sponsored subscribe subscription".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
MAIN = frozenset(("article", "main"))
#: Inside the main element these are its text: no class and no recurrence takes them away, nor lists unless of links.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead tfoot caption figcaption article main a xmp".split())
LISTS = frozenset("ul ol dl table figure".split())
#: An open element of the first kind ends where one of the second starts inside the same parent.
CLOSES = {"p": BLOCKS - {"br"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody")), "th": frozenset(("td", "th", "tr", "tbody")), "option": frozenset(("option",))}
CLOSED_BY = {name: [c for c, by in CLOSES.items() if name in by] for name in BLOCKS}

TAG = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][^\s/><]*)([^>\"']*)>")
TAG_END = re.compile(r"[>\"']")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: A site template stands on half of a host's different pages, three at least, or on so many of them.
LEAST_PAGES = 3
LEAST_SHARE = 0.5
MANY_PAGES = 50

class Node:
    __slots__ = ("children", "closed", "drop", "has_main", "links", "mark", "name", "soft", "words")

    def __init__(self, name: str, drop: bool = False, soft: bool = False):
        self.name, self.drop, self.soft = name, drop, soft
        self.children: list[Node | str] = []
        self.has_main = name in MAIN
        self.closed = False
        self.mark = self.words = self.links = 0


BREAK = Node("br")


def marked_by_words(names: str, telling: frozenset[str] = BOILERPLATE) -> bool:
    """Whether one of the class or id names is a telling word, alone or with neutral words."""
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if any(w in telling for w in words) and all(w in telling or w in NEUTRAL for w in words):
            return True
    return False


def boilerplate(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element isn't main text, and whether only its class or id says so; inside: in the main element."""
    if name in DROPPED and not (name == "header" and inside):
        return True, name == "form"
    if not attributes or name in ("html", "body"):
        return False, False
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in values or values.get("aria-hidden") == "true" or HIDDEN.search(values.get("style", "")):
        return True, False
    if values.get("role", "").lower() in ROLES:
        return True, False
    names = values.get("class", "") + " " + values.get("id", "")
    if name in MAIN:
        return marked_by_words(names, COMMENTS), False
    if inside and (name in PROSE or name in INLINE or name in LISTS and not marked_by_words(names) or name == "header"):
        return marked_by_words(names, INSERTED), False
    if inside and "header" in names.lower():
        names = " ".join(n for n in names.split() if "header" not in n.lower())
    return marked_by_words(names), True


def tag_end(html: str, at: int) -> int:
    """Where the tag whose attributes start here ends, quoted values passed over; -1 if nowhere."""
    while (m := TAG_END.search(html, at)) is not None:
        if m[0] == ">":
            return m.start()
        k = m.start() - 1
        while k > 0 and html[k].isspace():
            k -= 1
        close = html.find(m[0], m.end()) if html[k] == "=" else -1
        at = close + 1 if close >= 0 else m.end()
    return -1


class Tree:
    """The open elements while a page is read; every step costs a constant beside what it closes."""

    def __init__(self):
        self.root = Node("#root")
        self.open = [self.root]
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks = [0]
        self.barriers = [0]
        self.mains = 0

    def text(self, text: str) -> None:
        self.open[-1].children.append(text)

    def push(self, node: Node) -> None:
        k = len(self.open)
        self.open[-1].children.append(node)
        self.open.append(node)
        self.at[node.name].append(k)
        if node.name in BLOCKS:
            self.blocks.append(k)
            if node.name != "p":
                self.barriers.append(k)
        self.mains += node.name in MAIN and not node.drop

    def pop(self, down_to: int, tagged: bool = False) -> None:
        """Close all elements from the innermost to this one; what has no end tag of its own keeps main text."""
        while len(self.open) > down_to:
            node = self.open.pop()
            k = len(self.open)
            self.at[node.name].pop()
            for marks in (self.blocks, self.barriers):
                if marks[-1] == k:
                    marks.pop()
            self.mains -= node.name in MAIN and not node.drop
            if node.drop and node.has_main and (node.soft or k > down_to or not tagged):
                node.drop = False
            self.open[-1].has_main |= node.has_main and not node.drop

    def end(self, name: str) -> None:
        if self.at[name] and (name in BLOCKS or self.at[name][-1] > self.blocks[-1]):  # a stray inline end tag ends no block
            self.pop(self.at[name][-1], True)

    def start(self, name: str, attributes: str) -> bool:
        """Open an element; whether it stays open."""
        if name in ("br", "hr"):
            if name == "hr" and self.at["p"] and self.at["p"][-1] >= self.barriers[-1]:
                self.pop(self.at["p"][-1])
            self.text(BREAK)
            return False
        if name in BLOCKS:
            while (last := max((self.at[c][-1] for c in CLOSED_BY[name] if self.at[c]), default=-1)) >= self.barriers[-1]:
                self.pop(last)
        elif name == "a" and self.at["a"] and self.at["a"][-1] > self.blocks[-1]:
            self.pop(self.at["a"][-1])
        if name in VOID:
            return False
        drop, soft = boilerplate(name, attributes, self.mains > 0)
        if name in INLINE and not drop and not self.at[name]:
            return False
        if attributes.endswith("/") and name not in BLOCKS | RAW:
            return False
        self.push(Node(name, drop, soft))
        return True


def parse(html: str) -> Node:
    """A tree of elements and texts; forgiving about missing and stray end tags. Linear in the page's length.

    Formatting elements are passed over, so that a paragraph is one run of text. Where a tag never ends outside
    quotes, the rest of the page is read without heed of quotes; a < that begins nothing is text.
    """
    tree = Tree()
    at, end, last = 0, len(html), html.rfind(">")
    quotes = True
    while at < end:
        i = html.find("<", at)
        if i < 0 or i > last:
            tree.text(html[at:])
            break
        if i > at:
            tree.text(html[at:i])
        following = html[i + 1 : i + 2]
        if following in ("!", "?"):
            if html.startswith("<!--", i):
                if html.startswith((">", "->"), i + 4):
                    at = html.index(">", i + 4) + 1
                else:
                    m = COMMENT_END.search(html, i + 4)
                    at = m.end() if m else end
            elif html.startswith("<![CDATA[", i):
                k = html.find("]]>", i)
                tree.text(html[i + 9 : k if k >= 0 else end].replace("&", "&amp;"))
                at = k + 3 if k >= 0 else end
            else:
                at = html.index(">", i) + 1
            continue
        m = PLAIN_TAG.match(html, i + 1) if quotes else TAG.match(html, i + 1)
        if m is not None and quotes:
            close = m.end() - 1
        else:
            m = TAG.match(html, i + 1)
            if m is None:
                if following == "/":  # </> and the like are comments
                    at = html.index(">", i) + 1
                else:
                    tree.text("<")
                    at = i + 1
                continue
            close = tag_end(html, m.end()) if quotes else -1
            if close < 0:
                quotes = False
                close = html.index(">", i)
        at = close + 1
        name = m[2].lower()
        if m[1]:
            tree.end(name)
            continue
        if not tree.start(name, html[m.end(2) : close]) or name not in RAW:
            continue
        found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
        if name == "xmp":
            tree.text(html[at : found.start() if found else end].replace("&", "&amp;"))
        at = found.end() if found else end
        tree.pop(len(tree.open) - 1, True)
    tree.pop(1)
    keep_only_content(tree.root)
    return tree.root


def keep_only_content(root: Node) -> None:
    """Take back what the rules dropped although it is the page: its only main element, and a form around nearly all of its prose."""
    mains, forms, seen, prose = [], [], 0, 0
    stack = [(root, False, False)]
    while stack:
        node, dropped, text = stack.pop()
        if node.name in MAIN:
            seen += 1
            if node.drop and not dropped:
                mains.append(node)
        if node.name == "form" and node.drop and not dropped:
            forms.append(node)
        below = dropped or node.drop
        text = text or node.name in PROSE and node.name != "a"
        for c in node.children:
            if isinstance(c, Node):
                stack.append((c, below, text))
            elif text and not below:
                prose += len(c.split())
    if seen == 1:
        for m in mains:
            m.drop = False
    for f in forms:
        f.drop = False
        own = prose_words(f, within=PROSE - {"a"})
        f.drop = not own or own < 4 * prose


def hash_subtrees(root: Node) -> list[Node]:
    """Hash, words and words in links of each element, children included; returns those that may be templates.

    Within the main element these are only containers that aren't prose, and lists only where most of their words
    are links: an article's own paragraphs and lists stay whatever their number.
    """
    out: list[Node] = []
    stack = [(root, False, iter(root.children), xxhash.xxh64("#root"))]
    while stack:
        node, within, rest, digest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                words = child.split()
                if words:
                    digest.update(" ".join(words))
                    node.words += len(words)
            elif not child.drop and child is not BREAK:
                stack.append((child, within or child.name in MAIN, iter(child.children), xxhash.xxh64("<" + child.name)))
                break
        else:
            stack.pop()
            node.mark = digest.intdigest() - (1 << 63)
            node.closed = node.closed or node.name in MAIN
            if node.name == "a":
                node.links = node.words
            prose = within and (node.name in PROSE or node.name in LISTS and 2 * node.links <= node.words)
            if node.words and not node.closed and not prose and node.name not in ("#root", "html", "body"):
                out.append(node)
            if stack:
                above = stack[-1]
                above[3].update(digest.digest() + b">")
                above[0].words += node.words
                above[0].links += node.links
                above[0].closed |= node.closed
    return out


def delete_templates(root: Node, gone: set[int]) -> None:
    """Drop the outermost subtrees whose hash is in gone.

    Where they hold four fifths of the page's words, whatever their number, they are its main text and not a template;
    then only those go that consist mostly of links.
    """
    may_go = {id(n) for n in hash_subtrees(root) if n.mark in gone}
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        for c in node.children:
            if isinstance(c, Node) and not c.drop and c is not BREAK:
                (found if id(c) in may_go else stack).append(c)
    total = sum(n.words for n in found)
    if 5 * total >= 4 * root.words:
        found = [n for n in found if 2 * n.links > n.words]
    for n in found:
        n.drop = True


def blocks_of(node: Node) -> Iterator[str]:
    """Text blocks in page order, white space collapsed."""
    parts: list[str] = []

    def flush() -> Iterator[str]:
        text = " ".join(references.unescape("".join(parts)).split())
        parts.clear()
        if text:
            yield text

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            yield from flush()
        elif isinstance(x, str):
            parts.append(x)
        elif not x.drop:
            block = x.name in BLOCKS
            if block:
                yield from flush()
                stack.append(None)
            stack += reversed(x.children)
    yield from flush()


def prose_words(node: Node, within: frozenset[str] | None = None) -> int:
    """Words outside links of what isn't dropped; of text inside certain elements only, if they are given."""
    total, stack = 0, [(node, within is None)]
    while stack:
        x, counts = stack.pop()
        for c in x.children:
            if isinstance(c, str):
                total += len(c.split()) if counts else 0
            elif not c.drop and c.name != "a":
                stack.append((c, counts or c.name in within))
    return total


def mostly_links(node: Node) -> bool:
    """Whether links hold more than half of the words that aren't dropped."""
    words, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                words += len(c.split())
            elif not c.drop:
                stack.append(c)
    return 2 * prose_words(node) < words


def outermost(root: Node, name: str) -> list[Node]:
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.name == name:
            found.append(x)
        else:
            stack += [c for c in reversed(x.children) if isinstance(c, Node) and not c.drop]
    return found


def largest_run(root: Node) -> int:
    """Most prose words that stand right below one container outside of articles, in its text and its paragraphs."""
    most, stack = 0, [root]
    while stack:
        x, own = stack.pop(), 0
        for c in x.children:
            if isinstance(c, str):
                own += len(c.split())
            elif not c.drop and c.name not in ("a", "article"):
                if c.name in PROSE:
                    own += prose_words(c)
                else:
                    stack.append(c)
        if x.name not in ("#root", "html", "body"):
            most = max(most, own)
    return most


def around(main: Node, ruling: list[Node]) -> None:
    """Drop what stands beside the ruling articles of a main element without being its headline or text: teasers and links."""
    rules, stack = {id(a) for a in ruling}, [main]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str) or c.drop or c is BREAK or id(c) in rules:
                continue
            if c.name == "article" or not c.has_main and c.name not in INLINE and mostly_links(c):
                c.drop = True
            else:
                stack.append(c)


def main_nodes(root: Node) -> list[Node]:
    """The main parts in page order.

    The main element is taken with all that isn't boilerplate; where one article in it holds most of its words outside
    links, other articles and lists of links beside it are teasers and go. Without a main element the articles, unless
    more words stand together in another container, or three quarters of the page's words outside links elsewhere: then
    the page, for the articles are teasers beside a story.
    """
    mains = [m for m in outermost(root, "main") if prose_words(m)]
    for m in mains:
        whole = prose_words(m)
        ruling = [a for a in outermost(m, "article") if 2 * prose_words(a) > whole]
        if ruling:
            around(m, ruling)
    if mains:
        return mains
    articles = outermost(root, "article")
    own = sum(map(prose_words, articles))
    return articles if articles and own >= largest_run(root) and 4 * own >= prose_words(root) else [root]


def main_text(root: Node) -> str:
    return " ".join(b for node in main_nodes(root) for b in blocks_of(node))


def host_of(url: Column | str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def site_templates(marked: DataFrame, least_pages: int, least_share: float, many_pages: int) -> DataFrame:
    """(host, mark) of the subtrees that recur: counted over different contents, so that a repeated page is one page."""
    sizes = marked.groupBy("host").agg(F.count_distinct("content").alias("pages"))
    counts = marked.select("host", "content", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count_distinct("content").alias("n")).where(F.col("n") >= least_pages)
    enough = F.least(F.lit(float(many_pages)), least_share * F.col("pages"))
    return counts.join(sizes, "host").where(F.col("n") >= enough).select("host", "mark")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars, for each row of pages.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by element name,
    role, class or id; inside an article or main element its header stays, and of its prose only adverts and reader
    comments go by class. The page's only main element and a form around nearly all of its prose always stay.
    Then site templates: every remaining subtree's hash is counted per host over pages of different content, and a
    subtree that stands on least_share of them and least_pages, or on many_pages, is deleted, except what holds the
    main element, prose within it, and subtrees that hold four fifths of the page's words (see delete_templates). The
    text is that of the main element or the articles (see main_nodes), else of the page; references are decoded,
    white space in a block is one space, blocks are joined by one space.

    Pages without a host belong to no site and have no templates. Null and empty html give an empty text; broken
    markup is read forgivingly, very long pages in linear time. Rows that repeat give repeated rows and count as one
    page; other columns are never read. The hashes are counted by partial aggregations and found again by a salted
    join, so no task holds a host.
    """
    base = pages.select("page_id", "url", "html").withColumn("host", host_of("url")).withColumn("tie", F.xxhash64("page_id", "url", "html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            content, marks = [], []
            for t in texts_of(batch, "html"):
                root = parse((t or b"").decode("utf-8", "replace"))
                marks.append(list({n.mark for n in hash_subtrees(root)}))
                content.append(root.mark)
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("tie"), pa.array(content, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], names=["host", "tie", "content", "marks"])

    marked = written(base.where("host <> ''").select("host", "tie", "html").mapInArrow(hashes, "host string, tie long, content long, marks array<long>"), "page-subtrees")
    common = site_templates(marked, least_pages, least_share, many_pages)
    salts = 16
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = marked.select("host", "tie", F.pmod("tie", F.lit(salts)).cast("int").alias("salt"), F.explode("marks").alias("mark"))
    cut = placed.join(common, ["host", "mark", "salt"]).groupBy("tie").agg(F.collect_set("mark").alias("gone"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for t, gone in zip(texts_of(batch, "html"), batch.column("gone").to_pylist(), strict=True):
                root = parse((t or b"").decode("utf-8", "replace"))
                if gone:
                    delete_templates(root, set(gone))
                out.append(main_text(root))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    id_kind = pages.schema["page_id"].dataType.simpleString()
    return base.join(cut, "tie", "left").select("page_id", "url", "html", "gone").mapInArrow(texts, f"page_id {id_kind}, url string, text string, n_chars long")
