"""Main text of web pages, with site template removal.

Elements whose subtree recurs across many pages of a host are template. Subtrees
of the whole page are hashed bottom-up (tag, text, children); Spark counts, for
every host, the distinct pages that hold each hash, so a page that is stored many times or
under many urls votes once. Those on ``MIN_PAGES`` distinct pages or more, whatever the
host's size, are deleted before the article is looked for. A subtree that holds an article
or more than half of the text is looked into instead, and a page that would be left empty keeps its text.

The article is every outermost ``<article>``, else ``<main>`` (or an element
marked as such), else the body. What the counts can't know, menus and notices that
differ from page to page, goes by tag, role and name: an element is chrome if all words
of one of its class names or of its id say so; inside an article that holds for containers only.
Inside an article or main element, paragraphs, headings, list items and other
text leaves are content and stay even if many pages share them: only containers
there can be template. Without such an element every block may be.

Plan: (1) one Arrow pass parses pages and emits distinct (host, hash) pairs;
(2) two partial aggregations count them, and joins deal a huge host over many tasks;
(3) recurring hashes come back as one set per page and join the pages by page id;
(4) a second Arrow pass deletes and extracts.

Null html gives an empty text, null url the empty host. Pages with a null id
keep everything that only the host's counts could remove. Rows that repeat a page id share
the sets of all of them. Repeated rows come out as often as they went in.
"""

from __future__ import annotations

import html as entities
import re
import sys

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread_join, table, written

#: So many distinct pages make a template on any host.
MIN_PAGES = 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math xmp noembed noframes".split())
DROP = RAW | frozenset("head nav footer aside form button select option dialog menu canvas object audio video datalist fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that are never template as a whole.
WHOLE = frozenset("html body article main".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th tr tbody thead caption summary".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words that mark chrome, and words that may stand beside them in a name.
CHROME = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login "
    "search share sharing social comment comments disqus respond replies related recommended pagination pager toolbar skip".split()
)
BESIDE = frozenset(
    "a bar block bottom box btn button buttons container content count counts cta desktop fixed float form global group header heading hidden icon icons inner item items js label "
    "large layer left link links list main mobile module new on outer page panel policy post posts primary right row secondary section shell side site slot small stack sticky strip "
    "tab tabs thread title tools top unit view wrap wrapper zone".split()
)
#: Words that mark a notice or advert in the name of a paragraph or an inline element, where all words are such.
NOTICE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup newsletter".split())
COMMENT = frozenset("comment comments disqus respond replies reply".split())
MAIN_WORDS = frozenset("article post entry content story".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
#: Frames that a page's tree may take; elements nest deeper on broken pages than Python allows by default.
DEEPEST = 1_000_000


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "text")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.hash = self.text = 0

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(self.attrs)} if self.attrs else {}


def parse(source: str) -> Node:
    """A lenient tree: void and raw elements, implied ends of p, li, dt, dd, tr, td and th."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
    root = Node("#root")
    stack = [root]
    at, n = 0, len(source)
    find = _TAG.search

    def close_to(i: int) -> None:
        del stack[i:]

    while at < n:
        m = find(source, at)
        if m is None:
            stack[-1].kids.append(source[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close_to(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # an inline end never closes a block
                if stack[i].tag in ("article", "main") and tag not in ("article", "main", "body", "html"):
                    break
            continue
        attrs = (m[3] if m[2] else m[6]) or ""
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close_to(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    close_to(i)
                    if tag != "tr":
                        break
                elif stack[i].tag in BOUNDS.get(tag, ()):
                    break
        node = Node(tag, attrs.strip().rstrip("/"))
        stack[-1].kids.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            stop = source.find(">", end.start()) if end else -1
            at = stop + 1 if stop >= 0 else n
            continue
        stack.append(node)
    return root


def words_of(name: str) -> list[str]:
    return _WORD.findall(_CAMEL.sub(r"\1 \2", name).lower())


def names_chrome(name: str) -> bool:
    """Whether every word of a class name or id is chrome's, or may stand beside such a word; ``search-term`` is not."""
    words = words_of(name)
    return any(w in CHROME for w in words) and all(w in CHROME or w in BESIDE or w.isdigit() for w in words)


def names_header(name: str) -> bool:
    """A page's header by name; that of a post is content."""
    words = words_of(name)
    return "header" in words and all(w in BESIDE or w.isdigit() for w in words) and not MAIN_WORDS & set(words) and not {"section", "title", "post"} & set(words)


def names_notice(name: str) -> bool:
    words = words_of(name)
    return bool(words) and all(w in NOTICE for w in words)


def names_comment(name: str) -> bool:
    words = words_of(name)
    return bool(COMMENT & set(words)) and all(w in CHROME or w in BESIDE or w in COMMENT or w == "body" or w.isdigit() for w in words)


def is_chrome(node: Node, inside: bool) -> bool:
    """``inside``: within an article or main element, whose text leaves are content whatever they are called."""
    if node.tag in DROP or node.tag == "header" and not inside:
        return True
    if not node.attrs:
        return False
    a = node.attributes()
    if a.get("role", "").lower() in ROLES or a.get("hidden") is not None or a.get("aria-hidden") == "true":
        return True
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if node.tag in ("html", "body"):
        return False
    names = [*a.get("class", "").split(), a.get("id", "")]
    if node.tag in ("article", "main"):  # an article may be a reader's comment
        return any(names_comment(n) for n in names)
    if inside and (node.tag in LEAF or node.tag not in BLOCK):
        return any(names_notice(n) for n in names)
    return any(names_chrome(n) or not inside and names_header(n) for n in names)


def is_marked(node: Node) -> bool:
    if node.tag in ("article", "main"):
        return True
    a = node.attributes() if node.attrs else {}
    return a.get("role") == "main" or a.get("itemprop") == "articleBody"


def holds_marked(node: Node) -> bool:
    """Whether an article or main element lies within."""
    todo = [node]
    while todo:
        for k in todo.pop().kids:
            if not isinstance(k, str):
                if is_marked(k):
                    return True
                todo.append(k)
    return False


def roots(tree: Node, template: frozenset[int] | set[int] = frozenset()) -> tuple[list[Node], bool]:
    """The content elements in page order, and whether they're marked as such; template subtrees are passed over."""
    tiers: list[list[Node]] = [[], [], []]

    def walk(node: Node, in_main: bool, in_words: bool) -> None:
        for k in node.kids:
            if isinstance(k, str) or is_chrome(k, False):
                continue
            if template and k.tag in BLOCK and k.hash in template and k.tag not in WHOLE and not holds_marked(k):
                continue
            a = k.attributes() if k.attrs else {}
            if k.tag == "article":
                tiers[0].append(k)
                continue
            main = k.tag == "main" or a.get("role") == "main" or a.get("itemprop") == "articleBody"
            words = not main and k.tag in ("div", "section") and bool(MAIN_WORDS & set(_WORD.findall(f"{a.get('class', '')} {a.get('id', '')}".lower())))
            if main and not in_main:
                tiers[1].append(k)
            if words and not in_words:
                tiers[2].append(k)
            walk(k, in_main or main, in_words or words)

    walk(tree, False, False)
    for i, found in enumerate(tiers):
        if found:
            return found, i < 2
    return [tree], False


def subtree_hash(node: Node) -> int:
    """Hash of tag, text and children; 0 for a subtree without text."""
    parts, full = [node.tag], False
    for k in node.kids:
        if isinstance(k, str):
            t = " ".join(entities.unescape(k).split())
            if t:
                parts.append(t)
                full = True
        else:
            h = subtree_hash(k)
            full = full or bool(h)
            parts.append(str(h))
    node.hash = xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "replace")) & ((1 << 63) - 1) if full else 0
    return node.hash


def template_candidates(source: str | None) -> tuple[int, set[int]]:
    """A page's own hash, and those of its subtrees that may be template."""
    found: set[int] = set()
    tree = parse(source or "")
    subtree_hash(tree)

    def walk(node: Node, inside: bool) -> None:
        for k in node.kids:
            if isinstance(k, str):
                continue
            if k.hash and k.tag in BLOCK and k.tag not in WHOLE and not (inside and k.tag in LEAF):
                found.add(k.hash)
            walk(k, inside or is_marked(k))

    walk(tree, False)
    return tree.hash, found


def blocks_of(content: list[Node], marked: bool, goes) -> list[str]:
    """Texts of the blocks of elements in page order; ``goes`` tells which template subtrees do."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    def walk(node: Node) -> None:
        for k in node.kids:
            if isinstance(k, str):
                line.append(entities.unescape(k))  # a reference never spans two nodes
            elif k.tag == "br":
                line.append(" ")
            elif not is_chrome(k, marked):
                block = k.tag in BLOCK
                if block:
                    flush()
                    if goes(k):
                        continue
                walk(k)
                if block:
                    flush()
            elif k.tag in BLOCK:
                flush()

    for r in content:
        walk(r)
        flush()
    return blocks


def main_text(source: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the article in page order, one a line."""
    tree = parse(source or "")
    if not template:
        return "\n".join(blocks_of(*roots(tree, template), lambda k: False))
    subtree_hash(tree)
    content, marked = roots(tree, template)
    whole = blocks_of(content, marked, lambda k: False)
    size = sum(map(len, whole))

    def goes(k: Node) -> bool:
        if k.hash not in template or k.tag in WHOLE or marked and k.tag in LEAF:
            return False
        return 2 * sum(map(len, blocks_of([k], marked, lambda _: False))) <= size

    return "\n".join(blocks_of(content, marked, goes) or whole)


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def recurring(pages: DataFrame, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, hashes)``: for every page that has any, its template subtrees."""

    def run(batches):
        for b in batches:
            ids, hosts, whole, hashes = [], [], [], []
            for i, host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                page, found = template_candidates(source.as_py())
                for h in sorted(found):
                    ids.append(i)
                    hosts.append(host)
                    whole.append(page)
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(hashes, pa.int64())], names=["id", "host", "page", "hash"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), F.col(html_col))
    pairs = written(map_arrow(rows, run, "id long, host string, page long, hash long"), "subtrees")
    # equal pages of a host vote once; what moves is one row a task for each of their subtrees
    votes = pairs.select("host", "page", "hash").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= min_pages).select("host", "hash")
    named = pairs.where("id is not null")
    rows = named.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    common = written(votes.join(rows, ["host", "hash"]), "common")
    return spread_join(named, common.select("host", "hash"), ["host", "hash"], None, common).groupBy("id").agg(F.collect_set("hash").alias("hashes"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` for every page of a table read from files."""
    template = written(recurring(pages, min_pages, id_col, url_col, html_col), "template")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    # the same plan at every size: the narrow side is hashed, so pages aren't sorted, an id of very many rows is dealt over tasks, and pages without id stay where they are
    named = spread_join(rows.where("id is not null"), template, ["id"], None, counts, "shuffle_hash", "left")
    rows = named.select("id", "url", "html", "hashes").unionByName(rows.where("id is null").withColumn("hashes", F.lit(None).cast("array<long>")))

    def run(batches):
        for b in batches:
            texts = [main_text(s.as_py(), frozenset(t or ())) for s, t in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "text", "n_chars"])

    return map_arrow(rows, run, "id long, url string, text string, n_chars long")


def op10_html(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
