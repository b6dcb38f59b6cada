"""Scalar text functions of the news domain, as column expressions; pandas UDFs only where Spark has no expression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

def _decomposable() -> tuple[str, str]:
    """Letters that compatibility decomposition turns into one ASCII letter or digit and marks, and these."""
    import unicodedata

    pairs = []
    for point in range(0x80, 0x2500):
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode().lower()
        if len(plain) == 1 and plain.isalnum():
            pairs.append((chr(point), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _decomposable()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_term(x) -> Column:
    """Trimmed, lower case, white space collapsed; accents stay."""
    return F.regexp_replace(F.lower(F.regexp_replace(_c(x), r"^\s+|\s+$", "")), r"\s+", " ")


def url_hash(x) -> Column:
    """SHA-256 of the URL without white space at its ends."""
    return F.sha2(F.regexp_replace(_c(x), r"^\s+|\s+$", ""), 256)


def slugify(x, length: int = 96) -> Column:
    """Lower-case ASCII words joined by hyphens, `length` characters at most, without a hyphen at the end. Letters lose their
    marks; what has no ASCII letter under its marks is dropped. Null gives an empty slug."""
    low = F.lower(F.translate(F.coalesce(_c(x), F.lit("")), ACCENTED, PLAIN))
    dashed = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[^\x00-\x7F]", ""), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, length), "-+$", "")


def parse_date(x) -> Column:
    """ISO 8601 or RFC 822 to a timestamp; null for anything else."""
    c = _c(x)
    bare = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")))


def source_domain(*urls) -> Column:
    """Host and port of the first URL that has one, lower case."""
    return F.lower(F.coalesce(*[F.nullif(F.try_parse_url(_c(u), F.lit("AUTHORITY")), F.lit("")) for u in urls]))


def encode_cursor(published_at, row_id) -> Column:
    """Keyset cursor: base64url of `time|id` without padding."""
    text = F.concat(F.date_format(_c(published_at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("|"), _c(row_id).cast("string"))
    return F.rtrim(F.translate(F.regexp_replace(F.base64(text.cast("binary")), r"\s", ""), "+/", "-_"), F.lit("="))


def decode_cursor(x) -> tuple[Column, Column]:
    """(time, id) of a cursor; nulls for anything that is none."""
    c = F.translate(_c(x), "-_", "+/")
    text = F.try_to_binary(F.rpad(c, (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")).cast("string")
    return F.try_to_timestamp(F.substring_index(text, "|", 1)).cast("timestamp_ntz"), F.substring_index(text, "|", -1).try_cast("bigint")


def html_to_text(x, drop: tuple[str, ...] = ("script", "style", "noscript")) -> Column:
    """Text of markup without the named elements. Tags that re-emerge from character references go in a second pass."""
    out = _c(x)
    for _ in range(2):
        for tag in drop:
            out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
        out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]*>", " ")
        for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
            out = F.replace(out, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def internal_links(html, base_url, most: int = 20) -> Column:
    """array<struct<url, text>>: links of the base URL's host, each URL once, in order, `most` at most; texts of 200 characters."""
    host = F.try_parse_url(_c(base_url), F.lit("HOST"))
    root = F.concat(F.try_parse_url(_c(base_url), F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(_c(base_url), F.lit("AUTHORITY")))
    found = F.regexp_extract_all(_c(html), F.lit(r"(?is)(<a\s[^>]*href=[\"'][^\"'#]+[\"'][^>]*>.*?</a>)"), F.lit(1))
    pairs = F.transform(found, lambda a: F.struct(
        F.regexp_extract(a, r"(?is)href=[\"']([^\"'#]+)[\"']", 1).alias("url"),
        F.substring(F.trim(F.regexp_replace(F.regexp_replace(a, "<[^>]*>", " "), r"\s+", " ")), 1, 200).alias("text")))
    whole = F.transform(pairs, lambda p: F.struct(F.when(p["url"].startswith("/"), F.concat(root, p["url"])).otherwise(p["url"]).alias("url"), p["text"].alias("text")))
    own = F.filter(whole, lambda p: F.try_parse_url(p["url"], F.lit("HOST")) == host)
    first = F.filter(own, lambda p, i: F.array_position(F.transform(own, lambda q: q["url"]), p["url"]) == i + 1)
    return F.slice(F.filter(first, lambda p: F.length(p["text"]) > 0), 1, most)


def og_image(html) -> Column:
    """og:image, else twitter:image, by property or name."""
    c = F.coalesce(_c(html), F.lit(""))
    pick = lambda key: F.nullif(F.regexp_extract(c, rf"(?is)<meta[^>]+(?:property|name)=[\"']{key}[\"'][^>]*content=[\"']([^\"']+)", 1), F.lit(""))
    return F.coalesce(pick("og:image"), pick("twitter:image"))


def open_graph(html, base_url) -> Column:
    """struct<title, description, image, icon>: each from og: properties, else the meta of that name, else (title) the title
    element; the icon is the page's, else /favicon.ico of its host. Texts have 500 characters at most; null without any."""
    c = F.coalesce(_c(html), F.lit(""))
    tags = F.regexp_extract_all(c, F.lit(r"(?is)(<meta\s[^>]*>)"), F.lit(1))

    def meta(key: str) -> Column:
        own = F.filter(tags, lambda t: t.rlike(rf"(?i)(?:property|name)\s*=\s*[\"']?{key}[\"'\s/>]"))
        values = F.transform(own, lambda t: F.trim(F.regexp_extract(t, r"(?is)content\s*=\s*[\"']([^\"']*)[\"']", 1)))
        return F.get(F.filter(values, lambda v: v != ""), F.lit(0))

    title = F.nullif(F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    icon = F.nullif(F.regexp_extract(c, r"(?is)<link\s[^>]*rel=[\"'](?:shortcut )?icon[\"'][^>]*href=[\"']([^\"']+)", 1), F.lit(""))
    root = F.concat(F.try_parse_url(_c(base_url), F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(_c(base_url), F.lit("AUTHORITY")))
    return F.struct(
        F.substring(F.coalesce(meta("og:title"), meta("title"), title), 1, 500).alias("title"),
        F.substring(F.coalesce(meta("og:description"), meta("description")), 1, 500).alias("description"),
        F.coalesce(meta("og:image"), meta("image")).alias("image"), F.coalesce(icon, F.concat(root, F.lit("/favicon.ico"))).alias("icon"))


def title_and_description(title, description) -> Column:
    """`title. description`, without what is null or blank."""
    return F.concat_ws(". ", F.nullif(F.trim(_c(title)), F.lit("")), F.nullif(F.trim(_c(description)), F.lit("")))


@F.pandas_udf(StringType())
def fix_mojibake(x: pd.Series) -> pd.Series:
    """UTF-8 that was read as Windows-1252, read again; anything else unchanged."""

    def mend(s: str | None) -> str | None:
        try:
            return s if s is None else s.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return s

    return x.map(mend)


def mark_matches(text, pattern: str) -> Column:
    """Highlight: matches of a pattern inside <mark> elements, the first 180 characters around the first one."""
    c = _c(text)
    at = F.regexp_instr(c, F.lit(f"(?iu){pattern}"))
    return F.regexp_replace(F.substring(c, F.greatest(at - 60, F.lit(1)), F.lit(180)), f"(?iu)({pattern})", "<mark>$1</mark>")
