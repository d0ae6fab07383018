"""Main text of web pages, without the parts that a site repeats on its pages.

Tasks parse pages into element trees and hash every block element's subtree.  Spark counts, for each host, on how many
pages a subtree occurs and beside how many different articles: copies of a page, however many, are one article.  A
subtree outside articles that stands beside a few different ones is the site's template; inside an article it must be
on a large share of the host's pages, with different other content.  Template subtrees are deleted, beside the
elements whose kind or name says that they are no part of an article.  Different articles are counted by 64-bit masks
of their hashes, which never count too many, so counts are summed before they are shuffled and a host with a third of
all pages is no hot group.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import cut

#: A subtree inside an article belongs to a host's template from this share of its pages and this many different articles;
#: one outside, or a container without prose where the markup names no article, from the second pair.
SHARE, ARTICLES = 0.3, 5
OUTER_SHARE, OUTER_ARTICLES = 0.002, 3
#: Template subtrees up to which they are broadcast, as 8 bytes each; more of them are joined to pages by host and salt.
BROADCAST = 4_000_000
SALTS = 64

# names of HTML elements by role, from the HTML standard
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search
    section summary table tbody td tfoot th thead tr ul""".split())
PROSE = set("article blockquote h1 h2 h3 h4 h5 h6 p pre".split())
ITEMS = set("caption dd dt legend li option summary tbody td tfoot th thead tr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg math iframe textarea title canvas object audio video noframes xmp".split())
NO_TEXT = set("head nav footer aside form button select dialog menu input search fieldset".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
          "option": {"select"}}
# words in class, id and role names that mark parts outside an article
NAMES = set("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs carousel comment comments
    complementary consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr header leaderboard legal login masthead
    menu modal nav navbar navigation navigations newsletter notice notices notification outbrain overlay pager pagination popup
    promo promoted promotion reactions recommended related replies respond search share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription taboola toolbar widget widgets""".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MASK = 2**64 - 1
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _outside(tag: str, attributes: str) -> bool:
    """Whether an element's kind or names say that it is no part of an article."""
    if tag in NO_TEXT:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
        return True
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name == "aria-hidden":
            if value.lower() == "true":
                return True
        elif tag not in ("html", "body", "main", "article") or name == "class" and tag == "article":
            words = [w.lower() for w in WORD.findall(value)]
            if tag == "article":
                words = [w for w in words if w in ("comment", "ad", "advert", "promo", "sponsored", "related", "teaser")]
            if not NAMES.isdisjoint(words):
                return True
    return False


class Page:
    """Element tree: tags, parents, whether an element is outside articles, and texts and children in order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.outside, self.items, self.main = ["#"], [-1], [False], [[]], [False]
        stack, at, n = [0], 0, len(source)
        while at < n:
            found = TAG.search(source, at)
            if found is None:
                self._text(stack[-1], source[at:])
                break
            if found.start() > at:
                self._text(stack[-1], source[at:found.start()])
            at = found.end()
            closing, name, attributes = found[1] or found[4], found[2] or found[5], found[3] or ""
            if name is None or found[0][-1] != ">":  # a comment, a declaration, or a tag that the page's end cuts off
                continue
            tag = name.lower()
            if closing:
                self._close(stack, tag)
                continue
            if tag in RAW:
                if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else n
                continue
            if tag in CLOSES:
                self._end_of(stack, CLOSES[tag], SCOPES[tag])
            elif tag in BLOCKS:
                self._end_of(stack, {"p"}, BLOCKS - {"p"})
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.outside.append(_outside(tag, attributes) or tag == "header" and not any(self.tags[i] in ("article", "main") for i in stack))
            self.main.append(tag == "main" or 'role="main"' in attributes)
            self.items.append([])
            self.items[stack[-1]].append(node)
            if tag not in VOID:
                stack.append(node)

    def _text(self, node: int, text: str) -> None:
        self.items[node].append(html.unescape(text) if "&" in text else text)

    def _end_of(self, stack: list[int], tags: set[str], scope: set[str]) -> None:
        """Closes the innermost open element of these tags, unless one of the scope lies in between."""
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[i]]
            if tag in tags:
                del stack[i:]
                return
            if tag in scope:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tags[stack[i]] == tag:
                del stack[i:]
                return
            if tag not in BLOCKS and self.tags[stack[i]] in BLOCKS:
                return  # an inline element ends with its block

    def hashes(self) -> list[int]:
        """Hash of each subtree: its tag, its texts without needless white space, its children."""
        out = [0] * len(self.tags)
        for node in range(len(out) - 1, -1, -1):
            parts = [" ".join(x.split()) if isinstance(x, str) else f"\x00{out[x]}" for x in self.items[node]]
            out[node] = xxhash.xxh3_64_intdigest("\x01".join([self.tags[node], *(p for p in parts if p)])) - 2**63
        return out

    def outer(self) -> list[bool]:
        """Whether each node lies outside the article; without one in the markup, whether it is a container without prose."""
        roots = [tag == "article" or main for tag, main in zip(self.tags, self.main)]
        n = len(roots)
        if any(roots):
            out = [True] * n
            for node in range(1, n):
                out[node] = not roots[node] and out[self.parents[node]]
            return out
        prose = [tag in PROSE for tag in self.tags]
        for node in range(n - 1, 0, -1):
            prose[self.parents[node]] = prose[self.parents[node]] or prose[node]
        return [tag in BLOCKS and tag not in ITEMS and not p for tag, p in zip(self.tags, prose)]

    def keys(self, host: str) -> tuple[list[int], list[int]]:
        """For each node: the hash of host, place (outer or not) and subtree; and a hash of the article beside it.

        What is beside a node are the texts of the article, or of all prose if the markup has none, without its own.
        """
        values, outer, n = self.hashes(), self.outer(), len(self.tags)
        article = [tag == "article" or main for tag, main in zip(self.tags, self.main)]
        if not any(article):
            article = [tag in PROSE for tag in self.tags]
        for node in range(1, n):
            article[node] = article[node] or article[self.parents[node]]
        texts = [sum(xxhash.xxh3_64_intdigest(" ".join(x.split())) for x in own if isinstance(x, str) and not x.isspace()) if a else 0
                 for own, a in zip(self.items, article)]
        for node in range(n - 1, 0, -1):
            texts[self.parents[node]] += texts[node]
        return ([xxhash.xxh3_64_intdigest(f"{host}\x00{int(o)}\x00{v}") - 2**63 for v, o in zip(values, outer)],
                [(texts[0] - t) & MASK for t in texts])

    def repeatable(self, node: int) -> bool:
        return self.tags[node] in BLOCKS and self.tags[node] not in ("html", "body", "main", "article") and bool(self.items[node])

    def text(self, host: str = "", template: np.ndarray | None = None) -> str:
        """The text without subtrees whose keys are in the sorted template."""
        deleted = list(self.outside)
        if template is not None and len(template):
            keys = np.array(self.keys(host)[0])
            found = template[np.minimum(np.searchsorted(template, keys), len(template) - 1)] == keys
            for node in np.flatnonzero(found).tolist():
                deleted[node] = deleted[node] or self.repeatable(node)
        for node in range(1, len(deleted)):
            deleted[node] = deleted[node] or deleted[self.parents[node]]
        articles = [n for n, tag in enumerate(self.tags) if tag == "article" and not deleted[n]]
        mains = [n for n, is_main in enumerate(self.main) if is_main and not deleted[n]]
        for roots in (articles, mains):
            top = [n for n in roots if not any(m in roots for m in self._above(n))]
            found = self._blocks(top, deleted)
            if found:
                return "\n\n".join(found)
        return "\n\n".join(self._blocks([0], deleted))

    def _above(self, node: int) -> Iterator[int]:
        while (node := self.parents[node]) > 0:
            yield node

    def _blocks(self, roots: list[int], deleted: list[bool]) -> list[str]:
        out, block = [], []

        def flush() -> None:
            words = "".join(block).split()
            if words:
                out.append(" ".join(words))
            block.clear()

        for root in roots:
            flush()
            todo: list = [root]
            while todo:
                item = todo.pop()
                if item is None:
                    flush()
                elif isinstance(item, str):
                    block.append(item)
                elif not deleted[item]:
                    if self.tags[item] in BLOCKS:
                        flush()
                        todo.append(None)
                    elif self.tags[item] in VOID:
                        block.append(" ")
                    todo.extend(reversed(self.items[item]))
            flush()
        return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages by subtree, and the mask of the articles beside it, for a block of pages."""
    counts: dict[tuple[str, int], list] = {}

    def taken() -> pa.RecordBatch:
        rows = [(h, key, n, mask - 2**64 if mask >= 2**63 else mask, inside) for (h, key), (n, mask, inside) in counts.items()]
        counts.clear()
        columns = list(zip(*rows))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "subtree", "pages", "articles", "inside"])

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(source or "")
            keys, beside = page.keys(host)
            outer = page.outer()
            for key, node in {keys[n]: n for n in range(len(keys)) if page.repeatable(n)}.items():
                seen = counts.setdefault((host, key), [0, 0, not outer[node]])
                seen[0] += 1
                seen[1] |= 1 << (beside[node] % 64)
            if len(counts) > 200_000:
                yield taken()
    if counts:
        yield taken()


def _text_batches(batches: Iterator[pa.RecordBatch], shared=None) -> Iterator[pa.RecordBatch]:
    """Texts of pages; template subtrees are shared by all pages, or else stand beside each."""
    for batch in batches:
        ids, urls, sources, hosts = batch.columns[:4]
        own = batch.column(4).to_pylist() if shared is None else [shared.value] * batch.num_rows
        texts = [Page(s or "").text(h, None if t is None else t if shared is not None else np.sort(np.array(t, np.int64)))
                 for s, h, t in zip(sources.to_pylist(), hosts.to_pylist(), own)]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def templates(rows: DataFrame) -> DataFrame:
    """host, subtree: the keys of the template subtrees of rows(host, html)."""
    named = rows.filter("host <> ''")
    sizes = named.groupBy("host").agg(F.count("*").alias("all")).filter(F.col("all") >= OUTER_ARTICLES)
    counts = (named.select("host", "html").mapInArrow(_count_batches, "host string, subtree long, pages long, articles long, inside boolean")
              .groupBy("host", "subtree").agg(F.sum("pages").alias("pages"), F.bit_or("articles").alias("articles"), F.first("inside").alias("inside"))
              .withColumn("articles", F.bit_count("articles")).filter(F.col("articles") >= OUTER_ARTICLES))
    share, least = (F.when(F.col("inside"), F.lit(a)).otherwise(F.lit(b)) for a, b in ((SHARE, OUTER_SHARE), (ARTICLES, OUTER_ARTICLES)))
    wide = (F.col("pages") >= F.col("all") * share) & (F.col("articles") >= least)
    return counts.join(sizes, "host").filter(wide).select("host", "subtree")


def extract_text(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars.

    Blocks of the article are joined by two line breaks; n_chars counts code points.  Null html is empty, and empty or
    text-free pages give an empty text.  Pages without a host have no template.  Copies of a page, and repeated rows, are
    one article when templates are counted, and are extracted each.  Whole pages are read, however long; an empty table
    gives an empty result.  Other columns are ignored.
    """
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
                        host_of(F.col("url").cast("string")).alias("host"))
    found = cut(templates(rows), "templates")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    rows = rows.select("page_id", "url", "html", "host")
    if found.count() <= broadcast:
        keys = np.sort(found.select("subtree").distinct().toPandas()["subtree"].to_numpy(np.int64))
        return rows.mapInArrow(partial(_text_batches, shared=pages.sparkSession.sparkContext.broadcast(keys)), schema)
    # a host's pages are spread over salts, and its template goes to each of them
    salted = found.groupBy("host").agg(F.collect_list("subtree").alias("template")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "host", "template").mapInArrow(_text_batches, schema)
