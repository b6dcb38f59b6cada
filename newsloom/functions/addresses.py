"""IP addresses and networks as 128-bit numbers, and references of URLs, as column expressions.

An address is two longs, `hi` and `lo`, the halves of its 128 bits; IPv4 addresses (and IPv6 ones that only wrap them) have 0
and their 32 bits. A network's length counts from the first of 128 bits, so IPv4 lengths are 96 greater than written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUPS = "(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _v4(text: Column) -> Column:
    """32 bits of a valid dotted address."""
    parts = F.split(text, r"\.")
    return sum((F.get(parts, F.lit(i)).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, wherever the optimizer puts the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(text: Column) -> Column:
    """struct<hi, lo> of an IPv6 address in lower case without a dotted end; null for anything else."""
    # every group with four digits, then zeros for the groups that `::` stands for
    wide = F.regexp_replace(F.regexp_replace(text, "(^|:)([0-9a-f])", "$1000$2"), "0{0,3}([0-9a-f]{4})(?=:|$)", "$1")

    def numbers(digits: Column) -> Column:
        half = lambda i: F.conv(F.substring(digits, i, 16), 16, -10).cast("long")
        wrapped = F.substring(digits, 1, 24) == "0" * 20 + "ffff"
        return F.struct(F.when(wrapped, 0).otherwise(half(1)).cast("long").alias("hi"),
                        F.when(wrapped, F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")).otherwise(half(17)).alias("lo"))

    def filled(four: Column, bare: Column, left: Column) -> Column:
        fits = F.when(F.instr(text, "::") > 0, F.length(bare) <= 28).otherwise(F.length(bare) == 32)
        return F.when(fits, F.concat(left, F.repeat(F.lit("0"), 32 - F.length(bare)), bare.substr(F.length(left) + 1, F.length(bare))))

    colons = lambda c: F.replace(c, F.lit(":"), F.lit(""))
    digits = _let(wide, lambda four: _let(colons(four), lambda bare: _let(colons(F.substring_index(four, "::", 1)), lambda left: filled(four, bare, left))))
    return F.when(text.rlike(f"^{_GROUPS}(?:::{_GROUPS})?$"), _let(digits, lambda d: F.when(d.isNotNull(), numbers(d))))


def address(ip: Column | str) -> Column:
    """struct<hi, lo> of an IPv4 or IPv6 address; null for anything else (zones among it), and for null."""

    def of(low: Column) -> Column:
        tail = _v4(F.nullif(F.regexp_extract(low, rf":({_V4})$", 1), F.lit("")))
        hexed = lambda n: F.when(n.isNotNull(), F.concat(F.regexp_replace(low, f"{_V4}$", ""), F.format_string("%x:%x", F.shiftright(n, 16), n.bitwiseAND(F.lit(0xFFFF))))).otherwise(low)
        v4 = F.struct(F.lit(0).cast("long").alias("hi"), _v4(low).alias("lo"))
        return F.when(low.rlike(f"^{_V4}$"), v4).otherwise(_let(_let(tail, hexed), _groups))

    return _let(F.lower(F.trim(_c(ip))), of)


def masks(length: Column) -> tuple[Column, Column]:
    """The halves of a mask of so many first bits."""
    ones = F.lit(-1).cast("long")
    shifted = lambda n: F.call_function("shiftleft", ones, n.cast("int"))
    return (F.when(length >= 64, ones).when(length <= 0, F.lit(0)).otherwise(shifted(64 - length)),
            F.when(length >= 128, ones).when(length <= 64, F.lit(0)).otherwise(shifted(128 - length)))


def network(text: Column | str) -> Column:
    """struct<hi, lo, length> of `address/length` (without a length: of the one address), bits beyond the length set to 0; null
    for anything else."""

    def of(parts: Column) -> Column:
        base = F.get(parts, F.lit(0))
        v4, given = base.rlike(rf"^\s*{_V4}\s*$"), F.get(parts, F.lit(1))
        written = F.when(F.size(parts) == 1, F.when(v4, 32).otherwise(128)).when((F.size(parts) == 2) & given.rlike("^[0-9]{1,3}$"), given.try_cast("int"))
        length = _let(written, lambda n: F.when(v4 & (n <= 32), n + 96).when(~v4 & (n <= 128), n))
        return _let(length, lambda n: _let(address(base), lambda at: F.when(at.isNotNull() & n.isNotNull(), kept(at, n))))

    def kept(at: Column, length: Column) -> Column:
        hi, lo = masks(length)
        return F.struct(at["hi"].bitwiseAND(hi).alias("hi"), at["lo"].bitwiseAND(lo).alias("lo"), length.alias("length"))

    return _let(F.split(F.trim(_c(text)), "/", -1), of)


def _url(text: Column) -> dict[str, Column]:
    """Scheme, authority, path, query and fragment of a reference, by the pattern of RFC 3986 (B); null where undefined."""
    pattern = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
    got = lambda i: F.regexp_extract(text, pattern, i)
    return {
        "scheme": F.when(text.rlike(r"^[^:/?#]+:"), got(1)), "authority": F.when(text.rlike(r"^(?:[^:/?#]+:)?//"), got(2)), "path": got(3),
        "query": F.when(text.rlike(r"^[^?#]*\?"), got(4)), "fragment": F.when(text.rlike("#"), got(5)),
    }


def without_dots(path: Column) -> Column:
    """A path without its dot segments (RFC 3986, 5.2.4)."""
    rooted = path.startswith("/")
    parts = F.split(F.when(rooted, path.substr(F.lit(2), F.length(path))).otherwise(path), "/", -1)
    last = F.element_at(parts, -1)
    empty = F.array().cast("array<string>")
    step = lambda kept, p: F.when(p == ".", kept).when(p == "..", F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)).otherwise(F.array_append(kept, p))
    kept = F.aggregate(parts, empty, step)
    kept = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"))


def resolve_url(reference: Column | str, base: Column | str) -> Column:
    """The target of a reference on a page of that base URL (RFC 3986, 5.2.2). Null for nulls."""
    r, b = _url(F.trim(_c(reference))), _url(F.trim(_c(base)))
    own, near = r["scheme"].isNotNull(), r["authority"].isNotNull()
    none, rooted = r["path"] == "", r["path"].startswith("/")
    folder = F.regexp_extract(b["path"], "^(.*/)?", 0)
    merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(folder, r["path"]))
    path = F.when(own | near | rooted, without_dots(r["path"])).when(none, b["path"]).otherwise(without_dots(merged))
    query = F.when(own | near | ~none | r["query"].isNotNull(), r["query"]).otherwise(b["query"])
    authority = F.when(own | near, r["authority"]).otherwise(b["authority"])
    part = lambda before, c: F.coalesce(F.concat(F.lit(before), c), F.lit(""))
    scheme = F.coalesce(F.concat(F.coalesce(r["scheme"], b["scheme"]), F.lit(":")), F.lit(""))
    whole = F.concat(scheme, part("//", authority), path, part("?", query), part("#", r["fragment"]))
    return F.when(_c(reference).isNotNull() & _c(base).isNotNull(), whole)
