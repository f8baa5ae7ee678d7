"""Main text of web pages by deducing each host's template from token equivalence classes."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.common import materialise, small_batches

#: Comments, declarations, raw-text elements with their content, and tags; anything else is text.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|template|textarea|iframe|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that never hold article text.
OUTSIDE = set("head nav header footer aside form button dialog menu search select svg".split())
#: Elements that are part of a sentence, and those that hold sentences.
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
SENTENCES = HEADINGS | set("p li dt dd td th caption figcaption blockquote summary".split())
#: What a new element closes, up to the nearest of the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Names of a class, id or role that mark boilerplate.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations comment comments disqus reply replies"
    " respond widget toolbar pagination pager contentinfo complementary dialog search login outbrain taboola".split()
)
HEADER_HINTS = {"header", "topbar"}
#: Words that say what part or place of a page a name is for; a name of hints and such words alone is a hint, any other word makes it another thing.
FRAME = set(
    "area articles article bar block body bottom box button buttons close container content count desktop fixed floating footer form global group header icon icons inline inner item items left link links list"
    " main message mobile outer page panel placeholder post posts primary region right row secondary section site slot sticky stories thread title tools top unit wrap wrapper zone".split()
)
#: Hints of lists that often hold articles or much text of their own.
LISTS = set("comment comments disqus reply replies respond related recommended recommendations outbrain taboola".split())


#: Beginning of the names of working columns.
HOST = "__varloom_host"


class Page:
    """Tokens of one page: tags with their place and text runs, in order.

    A hint never drops what holds the page's main or article, or most of its
    text: the page is read again without the hints of such elements.
    """

    def __init__(self, text: str):
        self.spared: frozenset[int] = frozenset()
        self._read(text)
        spared = self._wrappers()
        if spared:
            self.spared = spared
            self._read(text)

    def _wrappers(self) -> frozenset[int]:
        """Numbers of the hinted elements that hold the page's main, its longest article, or most of its text."""
        spared: set[int] = set()
        roots = [r for r in self.roots if not r[3]]
        mains = [r for r in roots if r[0] == "main"]
        articles = [r for r in roots if r[0] == "article"]
        plain = [r for r in articles if not r[2]]
        if mains and all(r[2] for r in mains):
            spared.update(max(mains, key=lambda r: r[1])[2])
        elif articles and not mains:
            longest = max(articles, key=lambda r: r[1])
            listed = any(self.hinted[k][1] & LISTS for k in longest[2])
            if longest[2] and longest[1] > (self.plain if not plain else 0) and not (listed and plain):
                spared.update(longest[2])
        for k, (size, words, paragraphs, h1) in enumerate(self.hinted):
            if 2 * size > self.size and (h1 or paragraphs > 2) and not words & LISTS:
                spared.add(k)
        return frozenset(spared)

    def _read(self, text: str) -> None:
        self.items: list[tuple[str, str, bool, bool, bool]] = []  # kind, content, outside, in article, heading
        self.has_main = self.has_article = False
        self.hinted: list[list] = []  # text held, hints, paragraphs, title: elements outside by a hint alone
        self.roots: list[list] = []  # name, text held, hinted elements around, outside by element
        self.size = self.plain = 0  # text that no element puts outside; that outside hints and roots
        self.begun = False  # whether the block that is open has text already
        stack: list[tuple] = []  # name, outside, content root, outside by element, hinted elements, roots
        at = 0
        for m in MARKUP.finditer(text):
            if m.start() > at:
                self._text(text[at : m.start()], stack)
            at = m.end()
            name = m["name"]
            if not name:
                if m["raw"] and m["raw"].lower() in ("textarea", "iframe"):
                    self.items.append(("tag", m["raw"].lower(), True, False, False))
                continue
            name = name.lower()
            if m["close"]:
                self._close(name, stack)
            else:
                self._open(name, m["attrs"], stack)
        if at < len(text):
            self._text(text[at:], stack)

    def _flags(self, stack) -> tuple[bool, bool, bool]:
        if not stack:
            return False, False, False
        return stack[-1][1], stack[-1][2], any(s[0] in HEADINGS for s in stack[-3:])

    def _text(self, text: str, stack) -> None:
        held, roots = stack[-1][4:6] if stack else ((), ())
        if not stack or not stack[-1][3]:
            n = len("".join(text.split()))
            self.begun |= n > 0
            self.size += n
            self.plain += 0 if held or roots or stack and stack[-1][1] else n
            for k in held:
                self.hinted[k][0] += n
            for k in roots:
                self.roots[k][1] += n
        self.items.append(("text", text, *self._flags(stack)))

    def _open(self, name: str, attrs: str, stack) -> None:
        if name in BLOCK and any(s[0] == "p" for s in stack):
            while stack and stack[-1][0] != "p":
                if stack[-1][0] in BLOCK or stack[-1][0] in ("button", "object"):
                    break
                stack.pop()
            if stack and stack[-1][0] == "p":
                stack.pop()
        if name in BLOCK and name not in ("option", "hr", "legend"):
            for k in range(len(stack) - 1, -1, -1):  # a block ends a list of choices or a drawing left open
                if stack[k][0] == "foreignobject":
                    break
                if stack[k][0] in ("select", "svg"):
                    del stack[k:]
                    break
        if name in CLOSES:
            shut, bounds = CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in bounds:
                    break
                if stack[k][0] in shut:
                    del stack[k:]
                    break
        if name == "body":
            for k, s in enumerate(stack):
                if s[0] == "head":
                    del stack[k:]
                    break
        outside, inside, _ = self._flags(stack)
        solid, held, roots = stack[-1][3:6] if stack else (False, (), ())
        names, hidden = _names(attrs) if attrs and attrs != "/" else (set(), False)
        words = frozenset().union(*map(_marks, names)) if names else frozenset()
        if name in BLOCK:
            self.begun = False
        elif name in INLINE and (self.begun or any(s[0] in SENTENCES for s in stack)):
            words = frozenset()
        if name in ("main", "article"):
            self.roots.append([name, 0, held, solid])
            roots = (*roots, len(self.roots) - 1)
        if name in ("main", "article") and not outside:
            inside = True
            self.has_main |= name == "main"
            self.has_article |= name == "article"
        if name not in ("html", "body", "main", "article"):
            solid = solid or hidden or name in OUTSIDE and name != "header" or name == "noscript" and not roots
            outside = outside or solid or name == "header"
            if name not in HEADINGS and (words - HEADER_HINTS or not inside and words):
                self.hinted.append([0, words, 0, False])
                outside = outside or len(self.hinted) - 1 not in self.spared
                held = (*held, len(self.hinted) - 1)
            if not solid and name in ("p", "h1"):
                for k in held:
                    self.hinted[k][2] += name == "p"
                    self.hinted[k][3] |= name == "h1"
        elif name == "article" and words & {"comment", "comments", "reply", "related"}:
            outside = solid = True
        if name in HEADINGS and inside and any(s[0] == "header" for s in stack) and not _banned(stack):
            outside = False  # the title of an article stands in its header
        self.items.append(("tag", name + "".join(sorted("." + w for w in names)), outside, inside, False))
        if name not in VOID and not attrs.endswith("/"):
            stack.append((name, outside, inside, solid, held, roots))

    def _close(self, name: str, stack) -> None:
        if name in BLOCK:
            self.begun = False
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                outside, inside, _ = self._flags(stack[:k])
                del stack[k:]
                self.items.append(("tag", "/" + name, outside, inside, False))
                return
        self.items.append(("tag", "/" + name, *self._flags(stack)[:2], False))


def _banned(stack) -> bool:
    """Whether anything but an article's own header puts this place outside."""
    for k, (name, outside, inside, *_) in enumerate(stack):
        if outside and not (name == "header" and inside) and not (k and stack[k - 1][1]):
            return True
    return False


def _names(attrs: str) -> tuple[set[str], bool]:
    """Whole names of class, id and role in lower case, and whether the element is hidden."""
    names: set[str] = set()
    hidden = False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if m[5]:
            hidden = True
        elif key in ("class", "id", "role"):
            names.update(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().replace("_", "-").split())
        elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return names, hidden


@lru_cache(maxsize=4096)
def _marks(name: str) -> frozenset[str]:
    """The hints that a whole name is made of; none where any other word is part of it, as in share-price."""
    parts = {p for p in name.split("-") if p and not p.isdigit()}
    found = parts & (HINTS | HEADER_HINTS)
    return frozenset(found) if found and parts <= HINTS | HEADER_HINTS | FRAME else frozenset()


def _token(kind: str, content: str) -> int:
    """64-bit token; text tokens are odd, tags even."""
    return (xxhash.xxh64_intdigest(content) >> 1) & ~1 | (kind == "text")


def page_tokens(page: Page) -> list[int]:
    """One token for each item: tags by name, hints and whether they stand in the article, text by its words."""
    out = []
    for kind, content, _, inside, _ in page.items:
        text = " ".join(content.split()) if kind == "text" else f"<{content}>{int(inside)}"
        out.append(_token(kind, text) if text else 0)
    return out


def main_text(page: Page, tokens: list[int], template: set[int]) -> str:
    """The remaining slots of a page that are article text, block by block.

    Template text goes; so does everything in menus and the like. With a main or
    article element only what is inside counts.
    """
    rooted = page.has_main or page.has_article
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(text)
        parts.clear()

    for (kind, content, outside, inside, _), token in zip(page.items, tokens, strict=True):
        if kind == "tag":
            name = content.lstrip("/").partition(".")[0]
            if name in BLOCK:
                flush()
            elif name == "br":
                parts.append(" ")
        elif not outside and (inside or not rooted) and token not in template:
            parts.append(html_lib.unescape(content))
    flush()
    return "\n".join(blocks)


def host_templates(pages: DataFrame, min_pages: int = 3, min_share: float = 0.5, min_inside: int = 10) -> DataFrame:
    """host, page, template: the text tokens that each page shares with its host's template.

    A token's occurrence vector, its count on every page of the host, is kept as
    an exclusive or of hashes of (page, count); equal pages count once, by the
    hash of their text. Tokens with one vector on at least min_pages pages form
    a class, so each page design of a host has classes of its own. A class of
    two tokens or more is valid when its count is the same on all pages that
    have it and its text is at most half of theirs; more would be copies of a
    page, unless min_share of the host's pages have it. Classes are sets: their
    order on the page is not judged. A page's template has at most as many
    tokens as the page.
    """
    small_batches(pages.sparkSession, 500)

    def tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, key, text in zip(batch["host"], batch["page"], batch["html"], strict=True):
                seen: dict[int, list] = {}
                size = 0
                page = Page(text)
                for t, item in zip(page_tokens(page), page.items, strict=True):
                    if t:
                        chars = len(item[1]) if item[0] == "text" else 0
                        size += chars
                        one = seen.setdefault(t, [0, chars, False])
                        one[0] += 1
                        one[2] |= item[0] == "text" and item[3] and not item[2]
                out.append((host, key, page.has_main or page.has_article, size, list(seen), [n for n, _, _ in seen.values()], [c for _, c, _ in seen.values()], [i for _, _, i in seen.values()]))
            yield pd.DataFrame(out, columns=["host", "page", "rooted", "size", "t", "n", "c", "i"])

    each = pages.where("host is not null and html is not null").select("host", F.xxhash64("html").alias("page"), "html").mapInPandas(tokens_of, "host string, page long, rooted boolean, size long, t array<long>, n array<int>, c array<int>, i array<boolean>")
    each = each.groupBy("host", "page").agg(F.any_value(F.struct("rooted", "size", F.arrays_zip("t", "n", "c", "i").alias("z"))).alias("p")).select("host", "page", "p.*")
    each = materialise(each, "page-tokens")
    size = each.groupBy("host").agg(F.count("*").alias("pages"))
    vectors = each.select("host", "page", "size", F.explode("z").alias("z")).groupBy("host", "z.t").agg(
        F.count("*").alias("on"), F.bit_xor(F.xxhash64("page", "z.n")).alias("vector"), F.min("z.n").alias("low"), F.max("z.n").alias("high"), F.max("z.c").alias("chars"), F.sum("size").alias("all")
    )
    classes = vectors.where((F.col("on") >= min_pages) & (F.col("low") == F.col("high"))).groupBy("host", "on", "vector", "all").agg(F.collect_list("t").alias("tokens"), F.sum(F.col("low") * F.col("chars")).alias("chars"))
    half, part = F.col("on") >= F.col("pages") * min_share, 2 * F.col("chars") * F.col("on") <= F.col("all")
    valid = classes.where(F.size("tokens") >= 2).join(size, "host").where(half | part)
    valid = valid.select("host", (half & part & (F.col("on") >= min_inside)).alias("wide"), F.explode("tokens").alias("t")).where("t & 1 = 1")
    own = each.select("host", "page", "rooted", F.explode("z").alias("z")).where("z.t & 1 = 1 and (not rooted or z.i)").select("host", "page", "rooted", "z.t")
    return own.join(valid, ["host", "t"]).where("wide or not rooted").groupBy("host", "page").agg(F.collect_list("t").alias("template"))


def extract_main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """The input's rows and columns plus text: the article of each whole page.

    A null page or one without an article gives an empty text. The host is the
    authority of the url, lower case; pages without one have no template and
    are judged by their own markup, as are hosts of under three different pages.
    Rows are kept as they are, repeated ones too; a column named text is
    replaced. Templates are one short row for each page that has any and meet
    the pages in a join that Spark may broadcast or split.
    """
    small_batches(pages.sparkSession, 500)
    base = pages.drop(text_col)
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    own = base.withColumn(HOST, F.when(host != "", host))
    templates = host_templates(own.select(F.col(HOST).alias("host"), F.col(html_col).alias("html")))
    templates = materialise(templates, "templates").select(F.col("host").alias(f"{HOST}_h"), F.col("page").alias(f"{HOST}_p"), F.col("template").alias(f"{HOST}_t"))

    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sets in batches:
            out = []
            for text, tokens in zip(texts, sets, strict=True):
                if text is None or text != text:
                    out.append("")
                    continue
                page = Page(text)
                out.append(main_text(page, page_tokens(page), set() if tokens is None else set(map(int, tokens))))
            yield pd.Series(out, dtype=object)

    joined = own.join(templates, (F.col(HOST) == F.col(f"{HOST}_h")) & (F.xxhash64(html_col) == F.col(f"{HOST}_p")), "left")
    return joined.withColumn(text_col, F.pandas_udf(extracted, T.StringType())(html_col, f"{HOST}_t")).select(*base.columns, text_col)
