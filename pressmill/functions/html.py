"""Text, metadata and dates of saved pages, by Arrow UDFs over a streaming parser."""

from __future__ import annotations

import gzip
import html
import io
import ipaddress
import json
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "noscript"}
_BLOCKS = {"p", "article", "section", "li", "blockquote", "h1", "h2", "h3", "td", "div", "header", "footer", "nav", "aside", "table", "ul", "ol"}
# Metas that state a page's dates.
_DATE_NAMES = {"article:published_time", "article:modified_time", "datepublished", "datemodified", "pubdate", "publishdate"}
_ARTICLE_TYPES = {"Article", "NewsArticle", "ReportageNewsArticle", "AnalysisNewsArticle", "BlogPosting", "LiveBlogPosting"}


class PageReader(HTMLParser):
    """One pass over a page: visible parts, title, metas, JSON-LD blocks, language, article marks, body paragraphs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.in_title, self.in_data, self.in_article, self.in_paragraph = 0, False, False, 0, False
        self.parts: list[str] = []
        self.body: list[str] = []
        self.title, self.data = "", ""
        self.blocks: list[str] = []
        self.dates: list[tuple[str, str]] = []
        self.lang = self.locale = None
        self.has_article = False

    def handle_starttag(self, tag, attrs):
        values = {k.lower(): v or "" for k, v in attrs}
        if tag in _HIDDEN:
            self.hidden += 1
        if tag == "title":
            self.in_title = True
        elif tag == "html" and values.get("lang"):
            self.lang = values["lang"]
        elif tag == "article":
            self.in_article += 1
            self.has_article = True
        elif tag == "script":
            self.in_data = values.get("type", "").strip().lower() == "application/ld+json"
            self.data = ""
        elif tag == "meta":
            name = (values.get("property") or values.get("name") or values.get("itemprop") or "").lower()
            content = values.get("content", "")
            if name in _DATE_NAMES and content:
                self.dates.append((name, content))
            if name == "og:locale":
                self.locale = content
            if name == "og:type" and content.lower() == "article":
                self.has_article = True
        if tag in _BLOCKS:  # a paragraph ends where another block begins
            self.in_paragraph = tag == "p" and not self.hidden
            if self.in_paragraph:
                self.body.append("")

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in _BLOCKS:
            self.in_paragraph = False
        if tag == "title":
            self.in_title = False
        elif tag == "article":
            self.in_article = max(0, self.in_article - 1)
        elif tag == "script" and self.in_data:
            self.blocks.append(self.data)
            self.in_data = False

    def handle_data(self, data):
        if self.in_data:
            self.data += data
        if self.in_title:
            self.title += data
        if not self.hidden:
            part = " ".join(data.split())
            if part:
                self.parts.append(part)
                if self.in_paragraph:
                    self.body[-1] = f"{self.body[-1]} {part}".strip()


def read_page(page: str | None) -> PageReader:
    reader = PageReader()
    if page:
        reader.feed(page)
        reader.close()
    return reader


def visible_parts(page: str | None) -> list[str]:
    """Visible text, one part per text node, white space collapsed."""
    return read_page(page).parts


def identifies(identity, url: str) -> bool:
    """Whether a JSON-LD identity (text, or an object with @id or url) names the page, fragment and last slash aside."""
    if isinstance(identity, dict):
        return any(identifies(identity.get(k), url) for k in ("@id", "url") if identity.get(k))
    bare = lambda x: x.split("#", 1)[0].rstrip("/")
    return isinstance(identity, str) and bare(identity) == bare(url)


def page_dates(value, url: str, path: str = "$") -> Iterator[tuple[str, str, str]]:
    """(field, value, JSON path) of publication dates of objects whose identity is the page."""
    if isinstance(value, list):
        for i, item in enumerate(value):
            yield from page_dates(item, url, f"{path}[{i}]")
    elif isinstance(value, dict):
        if any(identifies(value.get(k), url) for k in ("@id", "url", "mainEntityOfPage")):
            for name in ("datePublished", "dateModified", "dateCreated"):
                if isinstance(value.get(name), str):
                    yield name, value[name], f"{path}.{name}"
        for key, item in value.items():
            if isinstance(item, (dict, list)):
                yield from page_dates(item, url, f"{path}.{key}")


def articles_in(value) -> Iterator[dict]:
    """All objects of an article type, at any depth."""
    if isinstance(value, list):
        for item in value:
            yield from articles_in(item)
    elif isinstance(value, dict):
        kinds = value.get("@type")
        if set(kinds if isinstance(kinds, list) else [kinds]) & _ARTICLE_TYPES:
            yield value
        for item in value.values():
            if isinstance(item, (dict, list)):
                yield from articles_in(item)


def primary_article(blocks: list, url: str) -> dict | None:
    """The article that is the page, or the only one there is."""
    found = [a for b in blocks for a in articles_in(b)]
    own = [a for a in found if any(identifies(a.get(k), url) for k in ("@id", "url", "mainEntityOfPage"))]
    return own[0] if own else found[0] if len(found) == 1 else None


def parsed_blocks(page: str | None) -> list:
    out = []
    for block in read_page(page).blocks:
        try:
            out.append(json.loads(block))
        except ValueError:
            continue
    return out


def body_text(page: str | None, url: str = "") -> str:
    """Paragraphs of the page; where they hold less than the JSON-LD article body, that body."""
    reader = read_page(page)
    text = "\n".join(p for p in reader.body if p)
    article = primary_article(parsed_blocks(page), url)
    stated = html.unescape(article.get("articleBody") or "") if article else ""
    return stated if len(stated) > len(text) else text


def decode(raw: bytes | None, encoding: str | None, most_bytes: int = 5_000_000) -> str | None:
    """Text of a saved response; null if its gzip is broken or expands beyond ``most_bytes``."""
    if raw is None:
        return None
    if (encoding or "").strip().lower() == "gzip":
        try:
            with gzip.GzipFile(fileobj=io.BytesIO(raw)) as stream:
                raw = stream.read(most_bytes + 1)
        except (OSError, EOFError, zlib.error):
            return None
        if len(raw) > most_bytes:
            return None
    return bytes(raw).decode("utf-8", "replace")


def _decoded(raws: pd.Series, encodings: pd.Series) -> pd.Series:
    return pd.Series([decode(r, e) for r, e in zip(raws, encodings, strict=True)], dtype=object)


def _visible_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: "\n".join(visible_parts(p)))


def _page_metadata(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for page in pages:
        r = read_page(page)
        rows.append((" ".join(r.title.split()) or None, r.lang, r.locale, r.has_article, [{"name": n, "value": v} for n, v in r.dates], len(r.blocks), body_text(page)))
    return pd.DataFrame(rows, columns=["title", "lang", "locale", "has_article", "dates", "blocks", "body"])


def _jsonld_dates(pages: pd.Series, urls: pd.Series) -> pd.Series:
    def dates(page, url):
        return [{"field": f, "value": v, "location": p} for b in parsed_blocks(page) for f, v, p in page_dates(b, url or "")]

    return pd.Series([dates(p, u) for p, u in zip(pages, urls, strict=True)])


def is_public(url: str | None) -> bool:
    """Whether an address may be fetched from the open network: http(s), usual port, no user, no private or local host."""
    try:
        parts = urlsplit(url or "")
        port, name = parts.port, (parts.hostname or "").lower().rstrip(".")
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not name or "@" in parts.netloc or port not in (None, 80, 443):
        return False
    if name == "localhost" or name.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        return ipaddress.ip_address(name).is_global
    except ValueError:
        return "." in name


def wire(url: str, secure: bool = False) -> str:
    """The address as sent: host in ASCII, path and query quoted, no fragment, https where preferred."""
    parts = urlsplit(url)
    scheme, port = parts.scheme.lower(), parts.port
    if secure and scheme == "http" and port in (None, 80):
        scheme, port = "https", None
    name = (parts.hostname or "").encode("idna").decode() if parts.hostname and not parts.hostname.isascii() else parts.hostname or ""
    name = f"[{name}]" if ":" in name else name
    place = name if port is None else f"{name}:{port}"
    return urlunsplit((scheme, place, quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._"), quote(parts.query, safe="=&%:@!$'()*+,;/?~-._"), ""))


def _wire_or_none(url: str | None, secure: bool) -> str | None:
    try:
        return wire(url, secure) if url else None
    except (ValueError, UnicodeError):
        return None


def _public_url(urls: pd.Series) -> pd.Series:
    return urls.map(is_public)


def _wire_url(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: _wire_or_none(u, True))


# The type of each function's result; the UDFs are made when called, since that needs a session.
_TYPES = {
    "decoded": "string",
    "visible_text": "string",
    "page_metadata": "struct<title:string,lang:string,locale:string,has_article:boolean,dates:array<struct<name:string,value:string>>,blocks:int,body:string>",
    "jsonld_dates": "array<struct<field:string,value:string,location:string>>",
    "public_url": "boolean",
    "wire_url": "string",
}


def _made(name: str, *columns) -> Column:
    return F.pandas_udf(globals()[f"_{name}"], _TYPES[name])(*columns)


def decoded(raw, encoding) -> Column:
    """Text of a saved response's bytes under its content encoding, null where they can't be decoded."""
    return _made("decoded", raw, encoding)


def visible_text(page) -> Column:
    """Visible text of a page, one line per text node."""
    return _made("visible_text", page)


def page_metadata(page) -> Column:
    """Title, language, locale, article mark, dates, number of JSON-LD blocks and body of a page."""
    return _made("page_metadata", page)


def jsonld_dates(page, url) -> Column:
    """Dates that the page's JSON-LD states of the page itself."""
    return _made("jsonld_dates", page, url)


def public_url(url) -> Column:
    return _made("public_url", url)


def wire_url(url) -> Column:
    return _made("wire_url", url)


_WAIT = re.compile(r"\s*\d+\s*")


def retry_delay(value: str | None, attempt: int = 0, now: float | None = None) -> float:
    """Seconds to wait by a Retry-After value (seconds or HTTP date), never less than 30 doubled per attempt."""
    from email.utils import parsedate_to_datetime

    floor = 30.0 * 2**attempt
    try:
        if value is None:
            return floor
        if _WAIT.fullmatch(value):
            return max(floor, float(value))
        import time

        return max(floor, parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return floor
