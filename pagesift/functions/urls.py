"""URL functions: plain ``Column`` expressions following RFC 3986.

Percent escapes are written with upper-case hex digits.

URLs are page data and can be megabytes long, as inline images are.  Regular
expressions here are anchored or find single characters: none repeats a group
(which recurses once per character) and none looks for the end of the text from
every position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.binding import chunks, let
from pagesift.functions.text import has_any_word, is_blank, trim_ws

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_LEGAL = r"A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;="
#: Those of them that ``url_encode`` encodes.
_LEGAL_MARKS = "~:/?#[]@!$&'()+,;="


def url_escape(x: Column) -> Column:
    """URI component escaping: everything but letters, digits and ``-_.~`` (space -> ``%20``)."""
    return F.replace(
        F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")),
        F.lit("%7E"),
        F.lit("~"),
    )


def form_escape(x: Column) -> Column:
    """Form escaping: space -> ``+``; letters, digits and ``-_.!*()`` stay."""
    out = F.url_encode(x)
    for code, char in (("%21", "!"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def fill_template_uri(template: Column, query: Column) -> Column:
    return F.replace(template, F.lit("{0}"), url_escape(query))


def fill_template_form(template: Column, query: Column) -> Column:
    return F.replace(template, F.lit("{0}"), form_escape(query))


def is_absolute(url: Column) -> Column:
    return F.coalesce(url.rlike(_SCHEME), F.lit(False))


def _escape_illegal(x: Column) -> Column:
    """Percent-encode characters a URL may not hold; valid escapes stay.

    All characters are encoded, then those that may stay are put back: each step
    replaces one fixed text, and no step makes a text that another one looks for.
    """
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for char in _LEGAL_MARKS:
        out = F.replace(out, F.lit(f"%{ord(char):02X}"), F.lit(char))
    out = F.regexp_replace(out, r"%25([0-9A-Fa-f][0-9A-Fa-f])", "%$1")
    dirty = x.rlike(rf"[^{_LEGAL}%]|%(?![0-9A-Fa-f][0-9A-Fa-f])")
    return F.when(dirty, out).otherwise(x)


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; the first segment, before the first slash, is never removed."""
    segments = F.filter(F.split(path, "/"), lambda s: s != ".")

    def net(part: Column) -> Column:
        """What a part of the path does: how many segments before it go, and which of its own stay."""
        none = F.struct(F.lit(0).alias("up"), F.array().cast("array<string>").alias("kept"))

        def step(acc: Column, s: Column) -> Column:
            own = F.size(acc["kept"])
            dropped = F.struct(
                (acc["up"] + F.when(own == 0, 1).otherwise(0)).alias("up"),
                F.slice(acc["kept"], F.lit(1), F.greatest(own - 1, F.lit(0))).alias("kept"),
            )
            kept = F.struct(acc["up"].alias("up"), F.array_append(acc["kept"], s).alias("kept"))
            return F.when(s == "..", dropped).otherwise(kept)

        return F.aggregate(part, none, step)

    def resolved(found: Column) -> Column:
        # From the end: each part loses as many segments as the parts behind it go up.
        none = F.struct(F.lit(0).alias("up"), F.array().cast("array<array<string>>").alias("parts"))

        def step(acc: Column, part: Column) -> Column:
            own = F.size(part["kept"])
            left = F.slice(part["kept"], F.lit(1), F.greatest(own - acc["up"], F.lit(0)))
            return F.struct(
                (part["up"] + F.greatest(acc["up"] - own, F.lit(0))).alias("up"), F.array_append(acc["parts"], left).alias("parts")
            )

        return F.aggregate(F.reverse(found), none, step, lambda acc: F.flatten(F.reverse(acc["parts"])))

    def whole(all_: Column) -> Column:
        rest = chunks(F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0))))
        return F.array_join(F.concat(F.slice(all_, 1, 1), let(F.transform(rest, net), resolved)), "/")

    tail = F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    has_dots = path.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(has_dots, F.concat(let(segments, whole), tail)).otherwise(path)


# scheme ":" [ "//" authority ] path rest
_SHAPE = r"^([A-Za-z][A-Za-z0-9+.\-]*:)(//[^/?#]*)?([^?#]*)(.*)$"


def _join(base: Column, ref: Column) -> Column:
    """The reference resolved on the base, not yet canonical."""
    scheme = F.regexp_extract(base, _SHAPE, 1)
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?", 0)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*/)?", 1)
    return (
        F.when(is_absolute(ref), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), ref))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), ref))
    )


def _canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, ``/`` for an empty path, dots removed, escapes added."""
    scheme = F.lower(F.regexp_extract(url, _SHAPE, 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _SHAPE, 2)), r"^(//.*):$", "$1")
    path = F.regexp_extract(url, _SHAPE, 3)
    return F.when(
        F.regexp_extract(url, _SHAPE, 2) != "",
        F.concat(
            F.regexp_replace(
                F.regexp_replace(F.concat(scheme, host), r"^(https://.*):443$", "$1"), r"^(http://.*):80$", "$1"
            ),
            let(path, lambda p: F.when(p == "", F.lit("/")).otherwise(_remove_dots(p))),
            F.regexp_extract(url, _SHAPE, 4),
        ),
    ).otherwise(url)


def abs_url(base: Column, url: Column) -> Column:
    """Resolve a possibly relative URL on an absolute base; null when either is unusable."""
    joined = let(trim_ws(url), lambda ref: let(trim_ws(base), lambda b: _join(b, ref)))
    whole = let(let(joined, _canonical), _escape_illegal)
    return F.when(~is_blank(url) & is_absolute(trim_ws(base)), whole)


def search_template(site_url: Column, action: Column, input_name: Column) -> Column:
    """The GET form as a URL template: the action's own query is replaced by ``name={0}``.

    A default port is not written and a fragment is kept.
    """
    target = abs_url(site_url, F.when(is_blank(action), site_url).otherwise(action))
    return let(
        target,
        lambda t: F.concat(
            F.regexp_extract(t, r"^[^?#]*", 0),
            F.lit("?"),
            url_escape(input_name),
            F.lit("={0}"),
            F.regexp_extract(t, r"#.*$", 0),
        ),
    )


def _segments(path: Column) -> Column:
    """Segments between slashes; empty ones do not count."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_slug(url: Column) -> Column:
    """Last path segment of an absolute URL with ``-`` and ``_`` as spaces, else empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)
    slug = let(_segments(path), lambda parts: F.get(parts, F.size(parts) - 1))
    plain = let(slug, lambda s: F.when(is_blank(s), F.lit("")).otherwise(F.translate(s, "-_", "  ")))
    return F.when(url.isNotNull(), plain)


def is_result_href(href: Column, skip_words: list[str]) -> Column:
    """False for a blank href, or when the second-to-last ``/`` segment holds a listing word."""
    parent = let(_segments(href), lambda parts: F.get(parts, F.size(parts) - 2))
    return ~is_blank(href) & ~has_any_word(parent, skip_words)
