"""Stored responses: urls, headers, outcomes, and what is read from pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What tells that a source refuses.
REFUSED_STATUS = (401, 403, 407, 429)
REFUSED_HEADERS = ("www-authenticate", "proxy-authenticate", "cf-mitigated", "x-captcha", "x-challenge")
REFUSED_MARKERS = ("captcha", "access denied", "challenge-platform", "cloudflare")
#: Bytes of a body in which a marker is looked for.
MARKER_BYTES = 256 * 1024


def normal_url(url: Column, group: Column) -> Column:
    """The url as it is asked for: https, host of the group or below it, no user, fragment or other port; else null."""

    def part(name: str) -> Column:
        return F.try_parse_url(url, F.lit(name))

    host = F.lower(part("HOST"))
    port = F.regexp_extract(part("AUTHORITY"), r":([0-9]*)$", 1)
    ok = (F.lower(part("PROTOCOL")) == "https") & part("USERINFO").isNull() & port.isin("", "443") & ((host == group) | host.endswith(F.concat(F.lit("."), group)))
    path = F.when(F.coalesce(part("PATH"), F.lit("")) == "", "/").otherwise(part("PATH"))
    return F.when(ok, F.concat(F.lit("https://"), host, path, F.coalesce(F.concat(F.lit("?"), part("QUERY")), F.lit(""))))


def lower_headers(headers: Column) -> Column:
    """Header names in lower case; of names that then meet, the last."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def refused(status: Column, headers: Column, body: Column) -> Column:
    """Whether status, headers (names in lower case) or the body's start tell that the source refuses."""
    start = F.lower(F.decode(F.substring(body, F.lit(1), F.lit(MARKER_BYTES)), "ISO-8859-1"))
    marked = F.lit(False)
    for m in REFUSED_MARKERS:
        marked = marked | start.contains(m)
    named = F.arrays_overlap(F.map_keys(headers), F.array(*[F.lit(h) for h in REFUSED_HEADERS]))
    return F.coalesce(status.isin(*REFUSED_STATUS), F.lit(False)) | F.coalesce(named, F.lit(False)) | F.coalesce(marked, F.lit(False))


def outcome(status: Column, headers: Column, body: Column, asked: Column, answered: Column) -> Column:
    """What became of a request: the first that holds, in this order."""
    return (
        F.when(refused(status, headers, body), "blocked")
        .when(asked != answered, "redirect")
        .when(status == 304, "not_modified")
        .when(status.between(300, 399), "redirect")
        .when(status.isin(404, 410), "not_found")
        .when((status >= 500) | (status == 408), "temporary")
        .when(status.between(200, 299), "ok")
        .when(status.between(400, 499), "blocked")
        .otherwise("temporary")
    )


def title(page: Column) -> Column:
    """The first title of a page, blanks at its ends aside, by a regular expression; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


class _Data(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.titles: list[str] = []
        self.all: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "title"

    def handle_endtag(self, tag):
        self.depth -= tag == "title" and self.depth > 0

    def handle_data(self, data):
        self.all.append(data)
        if self.depth:
            self.titles.append(data)


def page_data(page: Column) -> Column:
    """(title, text, state) by a full HTML parser; text is all data with blanks made single spaces."""
    return F.pandas_udf(_page_data, "title string, text string, state string")(page)


def _page_data(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        rows = []
        for page in batch:
            parser = _Data()
            try:
                parser.feed(page or "")
                parser.close()
                rows.append(("".join(parser.titles).strip(), " ".join(" ".join(parser.all).split()), "PARSED"))
            except (AssertionError, ValueError):
                rows.append((None, None, "PARSE_ERROR"))
        yield pd.DataFrame(rows, columns=["title", "text", "state"])


class _Tables(HTMLParser):
    """Finds closed tables marked as synthetic whose header and data cells name the same two fields."""

    def __init__(self, mark: tuple[str, str], fields: frozenset[str]) -> None:
        super().__init__()
        self.mark, self.fields, self.open, self.found = mark, fields, [], False

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "table":
            self.open.append((named.get(self.mark[0]) == self.mark[1], {"th": set(), "td": set()}))
        elif tag in ("th", "td") and self.open:
            self.open[-1][1][tag].add(named.get("data-field"))

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            marked, cells = self.open.pop()
            self.found |= marked and all(self.fields <= c for c in cells.values())


def has_table(mark: tuple[str, str], *fields: str):
    """A function: whether a page has a closed table with this attribute, in which th and td cells name all fields."""

    @F.pandas_udf("boolean")
    def check(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            out = []
            for page in batch:
                parser = _Tables(mark, frozenset(fields))
                parser.feed(page or "")
                parser.close()
                out.append(parser.found)
            yield pd.Series(out, dtype=bool)

    return check


def escape_html(text: Column) -> Column:
    # Characters and their references.
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def label(value: Column, names: dict[str, str]) -> Column:
    """The label of a value, or the value itself."""
    out = value
    for k, v in names.items():
        out = F.when(value == k, v).otherwise(out)
    return out
