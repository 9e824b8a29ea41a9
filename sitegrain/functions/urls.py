"""Column helpers for URLs: parts, normal form, resolution, slugs, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.text import any_of, bind, escape_html, strip, text_or_empty
from sitegrain.vocab import (
    LOCAL_HOSTNAMES,
    NON_HTML_EXTENSIONS,
    PRIVATE_IPV4,
    PRIVATE_IPV6_PREFIXES,
    SKIP_SEGMENTS,
)

_ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+"
_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
_SEARCH = r"^[^?#]*(\?[^#]*)"
# Addresses that are their own normal form: lower-case host without port, a path without dot segments, no fragment, nothing to encode.
_NORMAL = r"^https?://[a-z0-9.-]+(?:/(?!\.{1,2}(?:[/?]|\z))[!$-.0-;=@-_a-z|~]*)+(?:\?[!$-;=?-_a-z|~]+)?\z"


def is_absolute(url: Column) -> Column:
    return url.rlike(_ABSOLUTE)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """Lower-case host with its port, default ports removed."""
    host = F.lower(F.regexp_extract(url, _AUTHORITY, 1))
    http = F.regexp_replace(host, r":80$", "")
    https = F.regexp_replace(host, r":443$", "")
    return F.when(url.rlike("^(?i)http:"), http).when(url.rlike("^(?i)https:"), https).otherwise(host)


def hostname(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), r":\d*$", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def path(url: Column) -> Column:
    p = F.regexp_extract(url, _PATH, 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def search(url: Column) -> Column:
    s = F.regexp_extract(url, _SEARCH, 1)
    return F.when(s == "?", F.lit("")).otherwise(s)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


_UNSAFE = r"[^!#-;=?-_a-z|~]"


def _percent_encode(c: Column) -> Column:
    """Percent-encode blanks, quotes, angle brackets and non-ASCII characters."""

    def encoded(v: Column) -> Column:
        per_character = F.transform(
            F.split(v, ""),
            lambda ch: F.when(ch == " ", F.lit("%20"))
            .when(ch.rlike(_UNSAFE), F.url_encode(ch))
            .otherwise(ch),
        )
        return F.when(v.rlike(_UNSAFE), F.array_join(per_character, "")).otherwise(v)

    return bind(c, encoded)


def _resolve_dots(p: Column) -> Column:
    """Remove ``.`` and ``..`` segments from a path that starts with ``/``."""

    def folded(parts: Column) -> Column:
        body = F.aggregate(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        # A final dot segment names a folder: the path keeps its closing slash.
        closing = F.when(
            F.element_at(parts, -1).isin(".", "..") & (F.size(body) > 0), F.lit("/")
        ).otherwise(F.lit(""))
        return F.concat(F.lit("/"), F.array_join(body, "/"), closing)

    def fixed(v: Column) -> Column:
        return F.when(v.rlike(r"/\.{1,2}(?:/|$)"), bind(F.split(v, "/"), folded)).otherwise(v)

    return bind(p, fixed)


def canonical(url: Column) -> Column:
    """Absolute URL in normal form, fragment dropped; null when not absolute."""

    def normal(u: Column) -> Column:
        return F.when(
            is_absolute(u),
            F.concat(origin(u), _percent_encode(F.concat(_resolve_dots(path(u)), search(u)))),
        )

    # Most addresses are in normal form, which one pattern tells.
    return bind(url, lambda u: F.when(u.rlike(_NORMAL), u).otherwise(bind(strip(u), normal)))


def url_key(url: Column) -> Column:
    return F.lower(canonical(url))


def base_url(value: Column) -> Column:
    """Origin of a URL or bare host; https when no scheme is given."""
    full = bind(
        strip(text_or_empty(value)),
        lambda v: F.when(v.rlike("^(?i)https?://"), v).otherwise(F.concat(F.lit("https://"), v)),
    )
    return bind(full, lambda u: F.when(is_absolute(u), origin(u)))


def resolve_all(base: Column, hrefs: Column) -> Column:
    """Resolve an array of links against an absolute page URL.

    A link without a host becomes null. The parts of the page URL are computed
    once per page, not once per link.
    """
    base_path = path(base)
    parts = F.struct(
        F.concat(scheme(base), F.lit(":")).alias("scheme"),
        origin(base).alias("origin"),
        F.concat(origin(base), base_path).alias("page"),
        F.concat(origin(base), F.regexp_extract(base_path, r"^(.*/)", 1)).alias("folder"),
        base.alias("full"),
    )

    def absolute(b: Column, href: Column) -> Column:
        return (
            F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(b["scheme"], href))
            .when(href.startswith("/"), F.concat(b["origin"], href))
            .when(href.startswith("?"), F.concat(b["page"], href))
            .when(href.startswith("#"), b["full"])
            .otherwise(F.concat(b["folder"], href))
        )

    return bind(parts, lambda b: F.transform(hrefs, lambda h: canonical(absolute(b, h))))


def resolve(base: Column, href: Column) -> Column:
    return F.element_at(resolve_all(base, F.array(href)), 1)


# --- anchors, sections, slugs ------------------------------------------------


def _last_segment(url: Column, fallback: str) -> Column:
    last = F.try_element_at(segments(url), F.lit(-1))
    return F.coalesce(last, F.lit(fallback))


def planner_anchor(url: Column) -> Column:
    """Last path segment, dashes to spaces, lower-case, untrimmed."""
    return F.lower(F.regexp_replace(_last_segment(url, "home"), r"[-_]+", " "))


def suggestion_anchor(url: Column) -> Column:
    """Last path segment, dashes to spaces, trimmed, case kept."""
    anchor = F.trim(F.regexp_replace(_last_segment(url, "home"), r"[-_]+", " "))
    return F.when(is_absolute(url), anchor).otherwise(F.lit("related page"))


def section_root(url: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(url), F.lit(1)), F.lit("root"))


def slug_words(url: Column) -> Column:
    """Last path segment as words; empty for the root or a bad URL."""
    return F.regexp_replace(_last_segment(url, ""), r"[-_]+", " ")


def page_file_slug(url: Column) -> Column:
    p = F.regexp_replace(path(url), r"/+$", "")
    joined = F.regexp_replace(F.regexp_replace(p, r"^/+", ""), "/", "--")
    slug = F.when(p == "", F.lit("home")).otherwise(joined)
    return F.regexp_replace(slug, r"[^a-zA-Z0-9_-]+", "-")


def audit_page_slug(url: Column) -> Column:
    p = F.regexp_replace(path(url), r"/+$", "")
    cleaned = F.regexp_replace(F.regexp_replace(p, r"^/+", ""), r"[^a-zA-Z0-9/_-]+", "-")
    return F.when(p == "", F.lit("home")).otherwise(F.regexp_replace(cleaned, "/", "--"))


def batch_file_name(url: Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(path(url), r"^/", ""), r"/$", "")
    return F.concat(F.regexp_replace(trimmed, "/", "--"), F.lit(".md"))


def domain_slug(host: Column) -> Column:
    return F.regexp_replace(host, r"[^a-zA-Z0-9.-]+", "-")


# --- predicates -----------------------------------------------------------------


def same_host(url: Column, host: Column) -> Column:
    return is_absolute(url) & (hostname(url) == host)


def likely_html(url: Column) -> Column:
    return is_absolute(url) & ~path(url).rlike(rf"(?i)\.{any_of(NON_HTML_EXTENSIONS)}$")


def skip_for_audit(url: Column) -> Column:
    p = F.lower(path(url))
    return is_absolute(url) & (p != "/") & p.rlike(rf"/{any_of(SKIP_SEGMENTS)}(?:/|$)")


def block_reason(url: Column, allow_hosts: tuple[str, ...] = ()) -> Column:
    """First failing safety rule, or null when the URL may be fetched.

    The bracketed form of an IPv6 host keeps its brackets, so it matches
    neither the local names nor the IPv6 prefixes and passes.
    """
    u = strip(text_or_empty(url))
    host = hostname(u)
    proto = F.concat(scheme(u), F.lit(":"))
    local = host.isin(*LOCAL_HOSTNAMES) | host.endswith(".localhost")
    ipv4 = host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    private = ipv4 & host.rlike("^(?:" + "|".join(PRIVATE_IPV4) + ")")
    reason = (
        F.when(~u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:."), F.concat(F.lit("Invalid URL: "), text_or_empty(url)))
        .when(~scheme(u).isin("http", "https"), F.concat(F.lit("Blocked URL protocol: "), proto))
        .when(~is_absolute(u), F.concat(F.lit("Invalid URL: "), text_or_empty(url)))
        .when(local, F.concat(F.lit("Blocked local hostname: "), host))
        .when(private, F.concat(F.lit("Blocked private IP target: "), host))
    )
    if allow_hosts:
        allowed = [h.lower() for h in allow_hosts]
        reason = reason.when(
            ~host.isin(*allowed), F.concat(F.lit("Blocked host outside allowlist: "), host)
        )
    return reason


def is_private_ip(ip: Column) -> Column:
    """Private-range test for a bare IPv4 or IPv6 address; empty counts as private."""
    low = F.lower(text_or_empty(ip))
    v6 = (low == "::1") | low.rlike("^(?:" + "|".join(PRIVATE_IPV6_PREFIXES) + ")")
    return (
        F.when(low == "", F.lit(True))
        .when(low.contains(":"), v6)
        .otherwise(low.rlike("^(?:" + "|".join(PRIVATE_IPV4) + ")"))
    )


def safe_href(value: Column) -> Column:
    """Href for output: known forms pass html-escaped, everything else is ``#``."""
    raw = strip(text_or_empty(value))
    relative = raw.rlike(r"^(?:#|/|\./|\.\./)")
    safe = raw.rlike(r"^(?i)https?:/*[^/?#\s]") | raw.rlike(r"^(?i)(?:mailto|tel):")
    return F.when(raw == "", F.lit("#")).when(relative | safe, escape_html(raw)).otherwise(F.lit("#"))
