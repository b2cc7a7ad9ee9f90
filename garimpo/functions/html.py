"""Extraction from HTML: by expressions, and by a parser where a page needs one."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

STRIP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<!--.*?-->"
PARAGRAPH = r"(?i)<p\b[^>]*>"
CUT = r"(?is)^(.*?)(?:</?(?:p|div|h[1-6]|ul|ol|table|article|section|main|body|header|aside)\b|\z)"
TAG = r"<[^>]*>"
HREF = r'(?i)<a\b[^>]*?href\s*=\s*"([^"]*)"'
#: Scheme and authority of an address.
ROOT = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)"
#: Fixed value: a paragraph that counts as long.
LONG_PARAGRAPH = r"(?d)<p[^>]*>.{80,}</p>"
#: Marks of a page whose content a script fills in, case-sensitive.
SPA_MARKERS = ('<div id="root"></div>', '<div id="app"></div>', '<div id="__next"></div>', "ng-version=", "data-reactroot")
#: Classes of elements that hold no content.
REMOVED_CLASSES = frozenset(("most-read", "related-posts", "newsletter-embed", "offcanvas-wrapper", "site-header", "site-footer", "share--article"))


def stripped(html: Column) -> Column:
    """Scripts, styles, navigation, footers and comments become a blank."""
    return F.regexp_replace(html, STRIP, " ")


def title(html: Column) -> Column:
    """Text of the first h1 outside removed parts; empty if there is none."""
    inner = F.regexp_extract(stripped(html), r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    return F.trim(F.regexp_replace(inner, TAG, ""))


def paragraphs(html: Column) -> Column:
    """Trimmed texts of all paragraphs joined by a blank; a paragraph without an end
    tag ends at the next block tag, an empty one adds an empty text."""
    chunks = F.split(stripped(html), PARAGRAPH)
    texts = F.transform(F.slice(chunks, 2, F.greatest(F.size(chunks), F.lit(1))), lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, CUT, 1), TAG, "")))
    return F.array_join(texts, " ")


def links(html: Column) -> Column:
    """The href values of all anchors, in order, as written."""
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def resolved(href: Column, base: Column) -> Column:
    """An absolute http(s) address for an href as written, against the address of its
    page: with a scheme as it is, ``//host`` with the page's scheme, ``/path`` from the
    host, ``?query`` and relative paths from the page's folder, ``.`` and ``..`` taken
    out. Fragments are cut. Null for other schemes, for an href that is empty or only
    a fragment, and where the page has no host and the href is relative."""
    link = F.regexp_replace(F.trim(href), r"#.*$", "")
    root = F.regexp_extract(base, ROOT, 1)
    path = F.regexp_replace(F.regexp_replace(base, ROOT, ""), r"[?#].*$", "")
    folder = F.concat(root, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")))
    joined = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(root == "", F.lit(None))
        .when(link.startswith("//"), F.concat(F.regexp_extract(root, r"^[^:]*:", 0), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, F.when(path == "", F.lit("/")).otherwise(path), link))
        .otherwise(F.concat(folder, link))
    )
    return F.when((link != "") & joined.rlike(r"^(?i:https?)://[^/?#]"), _without_dots(joined))


def _without_dots(url: Column) -> Column:
    """Path segments ``.`` dropped and ``..`` taken out with the one before them."""
    head, tail = F.regexp_extract(url, ROOT, 0), F.regexp_replace(url, ROOT, "")
    query = F.regexp_extract(tail, r"\?.*$", 0)
    path = F.regexp_replace(tail, r"\?.*$", "")
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/")
    start = F.array().cast("array<string>")
    kept = F.aggregate(parts, start, lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.array_append(a, p)))
    last = F.element_at(parts, -1)
    closed = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.concat(head, F.when(path == "", F.lit("")).otherwise(F.concat(F.lit("/"), closed)), query)


def content_sufficient(html: Column) -> Column:
    """At least 500 characters, no script marker, and two paragraphs of 80 or more
    characters on one line each."""
    plain = ~F.coalesce(*[F.when(html.contains(m), True) for m in SPA_MARKERS], F.lit(False))
    long = F.size(F.regexp_extract_all(html, F.lit(LONG_PARAGRAPH), F.lit(0))) >= 2
    return F.coalesce((F.trim(html) != "") & (F.length(html) >= 500) & plain & long, F.lit(False))


class _Page(HTMLParser):
    """Title, paragraph texts and links of a page. Text inside removed tags and
    removed classes is skipped; paragraphs come from the first ``entry-content``
    element if there is one, else from the whole body."""

    REMOVED = {"nav", "footer", "script", "style"}
    BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "article", "section", "main", "body", "header", "aside"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, removed_classes: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.removed_classes = removed_classes
        self.open: list[tuple[str, bool, bool]] = []  # tag, removed here, in the content element
        self.heading: list[str] | None = None
        self.titles: list[str] = []
        self.paragraph: tuple[bool, list[str]] | None = None
        self.found: list[tuple[bool, str]] = []
        self.links: list[str] = []

    def _end_paragraph(self) -> None:
        if self.paragraph is not None:
            self.found.append((self.paragraph[0], "".join(self.paragraph[1]).strip()))
            self.paragraph = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: v or "" for k, v in attrs}
        classes = set(values.get("class", "").split())
        removed = tag in self.REMOVED or bool(classes & self.removed_classes) or bool(self.open and self.open[-1][1])
        content = "entry-content" in classes or bool(self.open and self.open[-1][2])
        if tag in self.BLOCK:
            self._end_paragraph()
        if tag == "a" and "href" in values:
            self.links.append(values["href"])
        if not removed and tag == "p":
            self.paragraph = (content, [])
        if not removed and tag == "h1":
            self.heading = []
        if tag not in self.VOID:
            self.open.append((tag, removed, content))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.BLOCK:
            self._end_paragraph()
        if tag == "h1" and self.heading is not None:
            self.titles.append("".join(self.heading).strip())
            self.heading = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        if self.heading is not None:
            self.heading.append(data)
        if self.paragraph is not None:
            self.paragraph[1].append(data)


def parse_page(html: str | None, removed_classes: frozenset[str] = REMOVED_CLASSES) -> tuple[str, str, list[str]]:
    """(title, body, links) of a page; a null page is empty."""
    page = _Page(removed_classes)
    page.feed(html or "")
    page.close()
    page._end_paragraph()
    inside = [text for content, text in page.found if content]
    return (page.titles or [""])[0], " ".join(inside or [text for _, text in page.found]), page.links


PAGE = StructType([StructField("title", StringType()), StructField("body", StringType()), StructField("links", ArrayType(StringType()))])


def extract(html: Column, removed_classes: frozenset[str] = REMOVED_CLASSES) -> Column:
    """Title, body and links by the parser, for pages with classes to remove."""

    @F.arrow_udf(PAGE)
    def run(pages: pa.Array) -> pa.Array:
        rows = [parse_page(p, removed_classes) for p in pages.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string())))], ["title", "body", "links"])

    return run(html)


def absolute(url: str, base: str | None = None) -> str | None:
    joined = urljoin(base, url.strip()) if base else url.strip()
    parts = urlparse(joined)
    return joined if parts.scheme and parts.netloc else None


def feed_links(xml: str | None) -> list[str]:
    """Absolute links of the items of a feed; nothing from malformed XML."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    found = []
    for item in root.iter():
        if isinstance(item.tag, str) and item.tag.rpartition("}")[2] == "item":
            link = next((x for x in item if isinstance(x.tag, str) and x.tag.rpartition("}")[2] == "link"), None)
            if link is not None and (url := absolute(link.text or "")):
                found.append(url)
    return found


def rss_links(xml: Column) -> Column:
    @F.arrow_udf(ArrayType(StringType()))
    def run(feeds: pa.Array) -> pa.Array:
        return pa.array([feed_links(x) for x in feeds.to_pylist()], pa.list_(pa.string()))

    return run(xml)
