"""URL handling as native column expressions (RFC 3986 resolution)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from .binding import let

# scheme, authority, path, query and fragment (RFC 3986, appendix B)
_PARTS = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
_AUTHORITY = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_RELATIVE_SCHEMES = ["http", "https", "ftp", "file", ""]
# Links that are already in normal form: plain segments, nothing to resolve or drop.
_PLAIN_SEGMENTS = r"(?:/[A-Za-z0-9_~\-][A-Za-z0-9_.~%,!$&'()*+=:@\-]*)+$"
_PLAIN_PATH = "^" + _PLAIN_SEGMENTS
_PLAIN_URL = r"^https?://[A-Za-z0-9.:\-]+" + _PLAIN_SEGMENTS
_ORIGIN = r"^https?://[^/?#\x00-\x20]+"
_CONTROL_OR_SPACE = "".join(chr(c) for c in range(33))
# A code point that is never text, to cut one match into its groups.
_CUT = "\uffff"


def _clean(url: Column) -> Column:
    """Leading control characters and inner tabs or line breaks are not part of a URL."""
    return F.ltrim(F.translate(url, "\t\r\n", ""), F.lit(_CONTROL_OR_SPACE))


def parts(url: Column) -> Column:
    """scheme, host, path, query and fragment as a struct, from one match."""
    groups = F.regexp_replace(_clean(url), _PARTS, _CUT.join(f"${i}" for i in range(1, 6)))
    return let(
        F.split(groups, _CUT, -1),
        lambda g: F.struct(
            F.lower(g[0]).alias("scheme"),
            g[1].alias("host"),
            g[2].alias("path"),
            g[3].alias("query"),
            g[4].alias("fragment"),
        ),
    )


def _without_params(full_path: Column) -> Column:
    short = F.regexp_extract(full_path, r"(?s)^(.*/[^/;]*|[^/;]*)", 1)
    return F.when(F.instr(full_path, ";") > 0, short).otherwise(full_path)


def path(url: Column) -> Column:
    """Path without the ';parameters' of its last segment."""
    full = F.regexp_extract(_clean(url), _PARTS, 3)
    return let(F.when(url.rlike(_PLAIN_PATH), url).otherwise(full), _without_params)


def site(url: Column) -> Column:
    """Host (and port) in lower case without a leading 'www.'; other subdomains stay."""
    return let(
        F.lower(F.regexp_extract(_clean(url), _AUTHORITY, 1)),
        lambda host: F.when(host.startswith("www."), F.substring(host, 5, 2**31 - 1)).otherwise(host),
    )


def same_site(url: Column, other: Column) -> Column:
    return site(url) == site(other)


def _rebuild(sch: Column, host: Column, rest: Column, qry: Column) -> Column:
    return F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        rest,
        F.when(qry != "", F.concat(F.lit("?"), qry)).otherwise(""),
    )


def _remove_dot_segments(joined: Column) -> Column:
    """Resolve '.' and '..' and drop empty inner segments of an absolute path."""

    def drop_empty(segments: Column) -> Column:
        last = F.size(segments) - 1
        return F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == last))

    def walk(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        ends_in_dots = F.element_at(segments, -1).isin(".", "..")
        closing = F.when(ends_in_dots, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(kept, closing), "/")

    def resolved(given: Column) -> Column:
        walked = let(let(F.split(given, "/", -1), drop_empty), walk)
        return F.when(given.rlike(r"/\.|//"), walked).otherwise(given)

    # Climbing past the root removes the leading slash; a path keeps it.
    return let(
        let(joined, resolved),
        lambda out: F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out)),
    )


def resolve_with_fragment(base: Column, href: Column) -> Column:
    """``resolve`` that keeps the fragment of ``href``."""

    def join(given: Column) -> Column:
        target = F.regexp_extract(given, r"(?s)(#.+)$", 1)
        return let(
            resolve(base, given),
            lambda whole: F.when(F.instr(whole, "#") > 0, whole).otherwise(F.concat(whole, target)),
        )

    return let(href, join)


def resolve(base: Column, href: Column) -> Column:
    """``href`` as seen from the page at ``base``, without its fragment.

    An href of another scheme (mailto:, tel:, ...) is returned as it is.
    """

    def combine(x: Column) -> Column:
        base_parts, ref = x["base"], x["ref"]
        scheme = F.when(ref["scheme"] == "", base_parts["scheme"]).otherwise(ref["scheme"])
        foreign = (scheme != base_parts["scheme"]) | ~scheme.isin(_RELATIVE_SCHEMES)
        directory = F.regexp_replace(base_parts["path"], r"(?s)[^/]*$", "")
        merged = (
            F.when(ref["path"].startswith("/"), ref["path"])
            .when(directory == "", F.concat(F.lit("/"), ref["path"]))
            .otherwise(F.concat(directory, ref["path"]))
        )
        has_host, no_path = ref["host"] != "", ref["path"] == ""
        target = (
            F.when(has_host, ref["path"])
            .when(no_path, base_parts["path"])
            .otherwise(_remove_dot_segments(merged))
        )
        keeps_query = ~has_host & no_path & (ref["query"] == "")
        return F.when(foreign, x["raw"]).otherwise(
            _rebuild(
                scheme,
                F.when(has_host, ref["host"]).otherwise(base_parts["host"]),
                target,
                F.when(keeps_query, base_parts["query"]).otherwise(ref["query"]),
            )
        )

    known = F.struct(
        parts(base).alias("base"), parts(href).alias("ref"), _clean(href).alias("raw")
    )
    return F.when(href.isNotNull(), let(known, combine))


def _decode(part: Column) -> Column:
    """Percent-decoding that leaves a stray '%' alone."""
    decoded = F.url_decode(F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25"))
    return F.when(part.rlike("[%+]"), decoded).otherwise(part)


def _encode(part: Column) -> Column:
    java = F.url_encode(part)
    encoded = F.replace(F.replace(java, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.when(part.rlike("[^A-Za-z0-9_.~-]"), encoded).otherwise(part)


def _canonical_query(raw: Column) -> Column:
    """Tracking parameters removed, the rest sorted by decoded name and value."""

    def pair(text: Column) -> Column:
        return let(
            F.substring_index(text, "=", 1),
            lambda name: F.struct(
                _decode(name).alias("k"),
                _decode(F.substring(text, F.length(name) + 2, F.lit(2**31 - 1))).alias("v"),
            ),
        )

    given = F.filter(F.split(raw, "&", -1), lambda p: p != "")
    kept = F.filter(
        F.transform(given, pair), lambda p: ~F.lower(p["k"]).isin(K.TRACKING_PARAMS)
    )
    spelled = F.transform(
        F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))
    )
    return F.array_join(spelled, "&")


def normalise(url: Column) -> Column:
    """One spelling per page: no fragment, tracking parameters or trailing slash."""

    def rebuild(p: Column) -> Column:
        raw_path = _without_params(p["path"])
        params = F.when(
            F.instr(p["path"], ";") > 0, F.regexp_extract(p["path"], r"(?s)(;[^/]*)$", 1)
        ).otherwise("")
        clean_path = F.coalesce(F.nullif(F.rtrim(raw_path, F.lit("/")), F.lit("")), F.lit("/"))
        clean_query = F.when(p["query"] == "", "").otherwise(_canonical_query(p["query"]))
        return _rebuild(p["scheme"], p["host"], F.concat(clean_path, params), clean_query)

    return let(parts(url), rebuild)


def link_target(base: Column, href: Column) -> Column:
    """The normal form of ``href`` as seen from ``base``.

    The same as ``normalise(resolve(base, href))``; hrefs that are plain paths or
    plain urls, which most are, take a short way.
    """
    origin = F.regexp_extract(base, _ORIGIN, 0)
    return (
        F.when(href.rlike(_PLAIN_PATH) & (origin != ""), F.concat(origin, href))
        .when(href.rlike(_PLAIN_URL), href)
        .otherwise(normalise(resolve(base, href)))
    )


def kind_by_path(url: Column) -> Column:
    """product, promotional, category or unknown, judged by the path alone."""
    return let(
        path(url),
        lambda where: F.when(where.rlike(K.PRODUCT_PATH), F.lit("product"))
        .when(where.rlike(K.PROMO_PATH), F.lit("promotional"))
        .when(where.rlike(K.CATEGORY_PATH), F.lit("category"))
        .otherwise(F.lit("unknown")),
    )
