"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree of element paths. An element has
the entropy of the ways its children are laid out over the host's pages
(presentation) and the entropy of its own texts over the pages that hold it
(content). Its importance is the largest of these and of its children's
importances, bottom-up. A branch of low importance is removed; where only the
direct text of an element repeats, that text alone is removed. Branches that HTML
itself marks as navigation, headers, footers, forms, notices, adverts or comments
are removed too.

Node statistics are counts by host and path, combined before they are shuffled;
a page then meets only its own nodes' importances. A host that holds a third of
all pages is counted like any other and its pages stay spread.
"""
from __future__ import annotations

import html as _html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import Scratch

LEAST_PAGES = 4        # pages of a host that must hold a node before its entropy tells anything
LEAST_IMPORTANCE = 0.2
DEEPEST = 512          # as in browsers, elements nested deeper are part of the element at this depth
LEVELS = 32            # elements below this depth are judged one by one, and count in the branches above it
VARIETY = 0.5          # content entropy that some node of a host must have: a site of copies has no boilerplate
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
# fixed values of HTML
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg annotation "
                 "annotation-xml".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s "
                    "samp small span strike strong sub sup time tt u var wbr br img math maction menclose merror mfenced mfrac mi "
                    "mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup "
                    "msup mtable mtd mtext mtr munder munderover semantics".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                      "h5 h6 header hr main menu nav ol p pre section table ul".split())
# elements and names that are no part of an article
_AROUND = frozenset("nav footer aside head button select dialog menu object canvas audio video map datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adslot|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|"
    r"popup|modal|overlay|newsletter|subscri\w*|signup|login|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|widget\w*|"
    r"footer\w*|header|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|comment\w*|respond|disqus\w*|"
    r"replies|pagination|pager|skip|hidden|search\w*|tags?|tagcloud|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)
_ARTICLE = re.compile(r"/article(?:\.[^/]*)?(?=/|$)")
_MAIN = re.compile(r"/main(?:\.[^/]*)?(?=/|$)")
_PARAGRAPH = re.compile(r"/p(?:\.[^/]*)?$")
_SPACE = re.compile(r"\s+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _marked(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether HTML itself says that an element is not part of the main text."""
    if tag in _AROUND or (tag == "header" and not in_article):
        return True
    if attrs:
        style = attrs.get("style", "").replace(" ", "").lower()
        if "hidden" in attrs or attrs.get("aria-hidden", "") == "true" or "display:none" in style:
            return True
        if attrs.get("role", "").lower() in _ROLES:
            return True
        if tag not in ("article", "main", "body", "html") and _NAMES.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"):
            return True
    return False


class Page:
    """Blocks of one page in order: (path, text, marked), whether it has an unmarked article, and each unmarked path's layout of children.

    A form is marked as a whole at the end, unless it is the page's frame: it holds
    an unmarked article, or most of the unmarked text or of that in paragraphs.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, bool]] = []
        self.layout: dict[str, list[str]] = {}
        self.has_article = False
        path, stack, buffer = "", [], []   # stack: (tag, path before, marked before, form before)
        marked, article, at, n = False, 0, 0, len(source)
        form, forms, frames, holders = 0, 0, set(), []   # number of the outermost open form, of forms, framing forms, each block's form

        def flush():
            if buffer:
                text = _SPACE.sub(" ", _html.unescape("".join(buffer))).strip()
                buffer.clear()
                if text:
                    self.blocks.append((path, text, marked))
                    holders.append(form)

        def close(depth):
            nonlocal path, marked, article, form
            while len(stack) > depth:
                tag, path_, marked_, form_ = stack.pop()
                if tag not in _INLINE:
                    flush()
                if tag == "article":
                    article -= 1
                path, marked, form = path_, marked_, form_

        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                buffer.append(source[at:])
                break
            if m.start() > at:
                buffer.append(source[at:m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:  # comment, declaration or character data
                if m[0].startswith("<![CDATA["):
                    buffer.append(m[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if m[1]:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
                else:
                    if tag not in _INLINE:
                        flush()
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if tag in _VOID:
                if tag == "br":
                    buffer.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag not in _INLINE:
                flush()
                if tag in _CLOSES_P:  # an open paragraph ends here, with the inline elements in it
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == "p":
                            close(depth)
                            break
                        if stack[depth][0] not in _INLINE:
                            break
                elif tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] == tag:
                            close(depth)
                            break
                        if stack[depth][0] in ("ul", "ol", "table", "dl", "select"):
                            break
            attrs = _attributes(m[3])
            stack.append((tag, path, marked, form))
            if tag == "article":
                article += 1
            marked = marked or _marked(tag, attrs, article > 0)
            if tag == "article" and not marked:
                self.has_article = True
                frames.add(form)
            elif tag == "form" and not form:
                forms += 1
                form = forms
            if tag not in _INLINE:
                name = tag + "".join(f".{_SPACE.sub('.', attrs[k]).replace('/', '_')}" for k in ("id", "class") if attrs.get(k))
                if len(stack) <= DEEPEST:
                    if not stack[-1][2]:
                        self.layout.setdefault(path, []).append(name)
                    path = f"{path}/{name}"
        close(0)
        flush()
        if forms:
            everything, paragraphs = [0] * (forms + 1), [0] * (forms + 1)
            for (path, text, marked), form in zip(self.blocks, holders):
                if not marked:
                    everything[form] += len(text)
                    if _PARAGRAPH.search(path):
                        paragraphs[form] += len(text)
            for sizes in (everything, paragraphs):
                frames.update(i for i in range(1, forms + 1) if 2 * sizes[i] > sum(sizes))
            self.blocks = [(path, text, marked or (form > 0 and form not in frames))
                           for (path, text, marked), form in zip(self.blocks, holders)]


def _node_rows(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value, n): hashed texts and child layouts of every node, added up per batch."""
    def run(batches):
        for batch in batches:
            counts: dict[tuple[str, str, int, int], int] = {}
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = Page(source or "")
                texts: dict[str, list[str]] = {}
                for path, text, marked in page.blocks:
                    if not marked:
                        texts.setdefault(path, []).append(text)
                for path, found in texts.items():
                    key = (host, path, 0, xxhash.xxh3_64_intdigest("\n".join(found)) >> 1)
                    counts[key] = counts.get(key, 0) + 1
                for path, found in page.layout.items():
                    key = (host, path, 1, xxhash.xxh3_64_intdigest(" ".join(dict.fromkeys(found))) >> 1)
                    counts[key] = counts.get(key, 0) + 1
            if counts:
                host, path, kind, value = zip(*counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(host), pa.array(path), pa.array(kind, pa.int32()), pa.array(value, pa.int64()),
                     pa.array(list(counts.values()), pa.int64())], ["host", "path", "kind", "value", "n"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, kind int, value long, n long")


def style_tree(pages: DataFrame) -> DataFrame:
    """Importance of every node of the tree of each host in ``pages(host, html)``.

    Columns: host, path, pages, content, presentation (NULL for a node without
    texts or children), seen (pages with either), importance (NULL below
    ``LEVELS``), variety (the host's largest content entropy).

    Entropies are taken to the base of the number of pages that hold the node,
    so they run from 0 (the same on every page) to 1 (different on every page).
    The importance is the largest entropy in the branch.
    """
    values = _node_rows(pages).groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    nodes = (values.groupBy("host", "path", "kind")
             .agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn")))
    entropy = F.when(F.col("pages") > 1, 1 - F.col("nlogn") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
    nodes = nodes.withColumn("entropy", F.greatest(F.lit(0.0), entropy))
    nodes = nodes.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 0, F.col("pages"))).alias("pages"),
        F.max(F.when(F.col("kind") == 0, F.col("entropy"))).alias("content"),
        F.max(F.when(F.col("kind") == 1, F.col("entropy"))).alias("presentation"),
        F.max("pages").alias("seen"))
    # every node counts in the branches that hold it: children's importances bottom-up, in one aggregation
    steps = F.slice(F.split("path", "/"), 2, LEVELS)
    above = F.transform(F.sequence(F.lit(1), F.size(steps)),
                        lambda i: F.concat(F.lit("/"), F.concat_ws("/", F.slice(steps, 1, i))))
    branches = (nodes.where("path <> ''")
                .select("host", F.explode(above).alias("path"), F.greatest("content", "presentation").alias("entropy"))
                .groupBy("host", "path").agg(F.max("entropy").alias("importance")))
    nodes = nodes.join(branches, ["host", "path"], "left")
    variety = nodes.groupBy("host").agg(F.max(F.when(F.col("pages") >= LEAST_PAGES, F.col("content"))).alias("variety"))
    return nodes.join(variety, "host")


def main_text(pages: DataFrame, scratch: Scratch, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row of ``pages(url, html, ...)`` with text and n_chars.

    Blocks are joined by one newline in page order; white space inside a block
    is one space; nothing else is dropped. If the articles of a page,
    or else its main element, hold half or more of its important text, only blocks
    inside them count. NULL or empty html gives an empty text; pages
    without a host form a site of their own; a node on fewer than
    ``LEAST_PAGES`` pages of its host is judged by HTML's own marks and by the
    branches that hold it; repeated pages repeat their rows and count as pages of the site.
    """
    host = F.lower(F.regexp_replace(
        F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[a-zA-Z][\w+.-]*://([^/?#]*)", 1), "^.*@", ""))
    rows = pages.select(*dict.fromkeys([*keep, "url", "html"])).withColumn("host", host)
    branch = F.expr(f"coalesce(seen >= {LEAST_PAGES} and importance < {LEAST_IMPORTANCE}, false)")
    direct = F.expr(f"coalesce(pages >= {LEAST_PAGES} and content < {LEAST_IMPORTANCE}, false)")
    low = (style_tree(rows).where(F.col("variety") >= VARIETY).where(branch | direct)
           .groupBy("host").agg(F.collect_set(F.when(branch, F.col("path"))).alias("low"),
                                F.collect_set(F.when(direct, F.col("path"))).alias("own")))
    low = scratch.save(low, "low_nodes")

    def run(batches):
        for batch in batches:
            texts = []
            for source, low, own in zip(*(batch.column(c).to_pylist() for c in ("html", "low", "own"))):
                texts.append("\n".join(kept_blocks(Page(source or ""), set(low or ()), set(own or ()))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return rows.join(low, "host", "left").select(*dict.fromkeys([*keep, "html", "low", "own"])).mapInArrow(
        run, f"{kinds}, text string, n_chars long")


def kept_blocks(page: Page, low: set[str], own: set[str] = frozenset()) -> list[str]:
    """Texts of a page's important blocks, given its host's unimportant branches and the paths whose own text repeats."""
    for scope, there in ((_ARTICLE, page.has_article), (_MAIN, any(not b[2] and _MAIN.search(b[0]) for b in page.blocks))):
        if there:
            blocks = list(_important(page, low, own, scope))
            if 2 * sum(len(text) for inside, text in blocks if inside) >= sum(len(text) for _, text in blocks):
                return [text for inside, text in blocks if inside]
    return [text for _, text in _important(page, low, own, None)]


def _important(page: Page, low: set[str], own: set[str], scope: re.Pattern | None):
    """(whether in the scope, text) of the blocks that neither marks nor repetition remove."""
    for path, text, marked in page.blocks:
        if marked:
            continue
        inside = scope.search(path) if scope else None
        start = inside.end() if inside else 0
        # inside the scope, only elements with a class or id are judged
        steps = [i for i in range(start, len(path) + 1) if i and (i == len(path) or path[i] == "/")
                 and (not inside or "." in path[path.rindex("/", 0, i):i])] if low or own else ()
        if not any(path[:i] in low for i in steps) and not (steps and steps[-1] == len(path) and path in own):
            yield inside is not None, text
