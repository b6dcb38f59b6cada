"""Markup made safe: only named elements and attributes are written back, whatever the input looks like.

One pass over the text, each character looked at a bounded number of times; runs over Arrow batches. Null stays null.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.functions.addresses import resolve_url
from newsloom.functions.text import html_to_text, internal_links, og_image

# The elements and attributes that stay, and what a link may begin with.
TAGS = ("p", "br", "strong", "em", "u", "s", "blockquote", "code", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "a", "img", "figure", "figcaption",
        "table", "thead", "tbody", "tr", "td", "th")
ATTRIBUTES = {"a": ("href", "title", "rel"), "img": ("src", "alt", "title")}
SCHEMES = ("http", "https", "mailto")
SHORT_HTML, MOST_TEXT, MOST_HTML = 400, 50_000, 200_000

#: Elements without an end tag, and elements whose content is no text.
VOID, HIDDEN = frozenset(("br", "img")), ("script", "style", "noscript", "template", "iframe", "object")
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+|=[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)?))?")
_TAG_REST = re.compile(r"[\s/]*>")
_UNSEEN = re.compile(r"[\x00-\x20\x7f-\xa0​-‏ -‮﻿]")


def _safe_link(value: str) -> bool:
    """Whether a link, as a browser reads it, is relative or of a scheme that may stay."""
    bare = _UNSEEN.sub("", html.unescape(html.unescape(value))).lower()
    scheme = re.match(r"([^/?#:]*):", bare)
    return scheme is None or scheme.group(1) in SCHEMES


def _tag(text: str, at: int) -> tuple[str, list[tuple[str, str]], int]:
    """Name (with a slash before it for an end tag), attributes and the place after a tag whose name begins at `at`; the end of
    the text where the tag has none."""
    name = _NAME.match(text, at)
    at, found = name.end(), []
    while at < len(text):
        if end := _TAG_REST.match(text, at):
            return name.group().lower(), found, end.end()
        part = _ATTRIBUTE.match(text, at)
        if not part or part.end() == at:
            at += 1
            continue
        found.append((part.group(1).lower(), next((g for g in part.groups()[1:] if g is not None), "")))
        at = part.end()
    return name.group().lower(), [], len(text)


def clean(text: str, tags: tuple[str, ...] = TAGS, attributes: dict[str, tuple[str, ...]] = ATTRIBUTES) -> str:
    """The markup with the named elements and attributes only. Other elements leave their text, those of HIDDEN nothing;
    comments, declarations and tags that never end go; elements are closed in order; stray < and > are escaped."""
    out: list[str] = []
    open_: list[str] = []
    lower, at, n = None, 0, len(text)
    while at < n:
        to = text.find("<", at)
        to = n if to < 0 else to
        out.append(text[at:to].replace(">", "&gt;"))
        if to == n:
            break
        at = to + 1
        if text.startswith("!--", at):
            end = text.find("-->", at + 1)
            at = n if end < 0 else end + 3
        elif text[at : at + 1] in ("!", "?"):
            end = text.find(">", at)
            at = n if end < 0 else end + 1
        elif not _NAME.match(text, at):
            out.append("&lt;")
        else:
            name, found, at = _tag(text, at)
            if name in HIDDEN:
                lower = lower if lower is not None else text.lower() if len(text.lower()) == n else text
                end = lower.find(f"</{name}", at)
                at = n if end < 0 else _tag(text, end + 1)[2]
            elif name.startswith("/"):
                if name[1:] in open_:
                    while (last := open_.pop()) != name[1:]:
                        out.append(f"</{last}>")
                    out.append(f"</{name[1:]}>")
            elif name in tags and (at <= n and text[at - 1] == ">"):
                kept = {k: v for k, v in reversed(found) if k in attributes.get(name, ()) and (k not in ("href", "src") or _safe_link(v))}
                out.append(f"<{name}" + "".join(f' {k}="{html.escape(html.unescape(kept[k]))}"' for k in attributes.get(name, ()) if k in kept) + ">")
                if name not in VOID:
                    open_.append(name)
    out += [f"</{name}>" for name in reversed(open_)]
    return "".join(out)


@F.pandas_udf(StringType())
def sanitize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Markup made safe by `clean` with TAGS and ATTRIBUTES."""
    for batch in batches:
        yield batch.map(clean, na_action="ignore")


def normalize_articles(rows: DataFrame) -> DataFrame:
    """rows: content_html, description, image_url, url and page_html, the page fetched (null where it was not). Adds content_text,
    content_html_safe, image, links and used_page.

    A page counts only where content_html has fewer than SHORT_HTML characters. The text is the page's, else that of content_html,
    else the description; the markup is content_html's, else the page's; an article without image has the page's, resolved
    against its URL. Texts have MOST_TEXT characters at most, markup MOST_HTML (cut before it is made safe, so that it stays so).
    """
    own, page = F.coalesce("content_html", F.lit("")), F.when(F.length(F.coalesce("content_html", F.lit(""))) < SHORT_HTML, F.nullif("page_html", F.lit("")))
    df = rows.withColumns({"__own": own, "__page": page})
    text = F.coalesce(F.nullif(html_to_text("__page"), F.lit("")), F.nullif(html_to_text("__own"), F.lit("")), F.when(F.col("__own") == "", F.coalesce("description", F.lit(""))), F.lit(""))
    markup = F.coalesce(F.nullif("__own", F.lit("")), "__page")
    shown = F.coalesce(F.nullif("image_url", F.lit("")), resolve_url(F.trim(og_image("__page")), "url"))
    return df.withColumns({
        "content_text": F.substring(text, 1, MOST_TEXT), "content_html_safe": sanitize(F.substring(markup, 1, MOST_HTML)), "image": shown,
        "links": internal_links(F.coalesce(markup, F.lit("")), "url"), "used_page": F.col("__page").isNotNull()}).drop("__own", "__page")
