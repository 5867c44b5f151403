"""Page and link expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import any_word, rlike, squeeze, strip_ws

# The entities that occur in titles and links.
_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&amp;", "&"),
)
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def unescape(c: Column) -> Column:
    for entity, char in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def host(url: Column) -> Column:
    """Lower-case host without user, port and a leading ``www.``."""
    name = F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", ""))
    return F.regexp_replace(name, r"^www\.", "")


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag in either attribute order; empty when absent."""
    n = re.escape(name)
    forward = rf"""(?i)<meta[^>]+(?:property|name)=["']{n}["'][^>]+content=["']([^"']+)"""
    backward = rf"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+(?:property|name)=["']{n}["']"""
    found = F.coalesce(
        F.nullif(F.regexp_extract(html, forward, 1), F.lit("")),
        F.nullif(F.regexp_extract(html, backward, 1), F.lit("")),
        F.lit(""),
    )
    return F.substring(strip_ws(unescape(found)), 1, 1000)


def title(html: Column, url: Column) -> Column:
    has = rlike(html, r"(?is)<title[^>]*>.*?</title>")
    plain = F.substring(strip_ws(unescape(squeeze_inner(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))), 1, 180)
    return F.coalesce(
        F.nullif(meta(html, "og:title"), F.lit("")),
        F.nullif(meta(html, "twitter:title"), F.lit("")),
        F.when(has, plain).otherwise(F.lower(F.regexp_replace(netloc(url), r":\d*$", ""))),
    )


def squeeze_inner(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def description(html: Column) -> Column:
    return F.coalesce(F.nullif(meta(html, "og:description"), F.lit("")), meta(html, "description"))


def login_wall(title_: Column, description_: Column) -> Column:
    return any_word(F.lower(F.concat_ws(" ", title_, description_)), K.LOGIN_SIGNALS)


def profile_page(url: Column) -> Column:
    """A social profile (not one publication)?"""
    h, parts = host(url), F.transform(path_parts(url), F.lower)
    out = F.lit(False)
    for site, marks, first_only in reversed(K.POST_PATHS):
        allowed = F.array(*[F.lit(m) for m in marks])
        is_post = (
            F.coalesce(F.array_contains(allowed, F.get(parts, F.lit(0))), F.lit(False))
            if first_only else F.arrays_overlap(parts, allowed)
        )
        out = F.when(F.endswith(h, F.lit(site)), ~is_post).otherwise(out)
    return out


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of a link found on a page."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(F.concat(path(base), F.lit("")), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    joined = (
        F.when(rlike(link, r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme(base), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(rlike(link, r"^[?#]"), F.concat(root, path(base), link))
        .otherwise(F.concat(root, folder, link))
    )
    for _ in range(3):
        joined = F.regexp_replace(joined, r"(?<=[^:/])/(?!\.\.?/)[^/?#]+/\.\./", "/")
    return F.regexp_replace(joined, r"(?<=[^:])/\./", "/")


def image_urls(html: Column, url: Column, wall: Column) -> Column:
    """Publication images of a page: social cards, then ``<img>``; noise dropped."""
    cards = F.when(profile_page(url), F.array().cast("array<string>")).otherwise(
        F.array(meta(html, "og:image"), meta(html, "twitter:image"))
    )
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)<img[^>]+(?:src|data-src)=["']([^"']+)"""), F.lit(1))
    links = F.filter(
        F.transform(F.slice(F.concat(cards, tags), 1, 80), lambda x: strip_ws(unescape(x))), lambda x: x != ""
    )
    full = F.transform(links, lambda x: resolve(url, x))
    good = F.filter(
        full,
        lambda u: scheme(u).isin("http", "https") & (host(u) != "")
        & ~any_word(F.lower(F.concat(netloc(u), path(u))), K.IMAGE_NOISE),
    )
    return F.when(wall, F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(good), 1, 12))


def profile_handle(url: Column) -> Column:
    """User name of a profile link; null for publications and other sites."""
    full = F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("https://"), url))
    first = F.lower(F.get(path_parts(full), F.lit(0)))
    ok = F.endswith(host(full), F.lit("instagram.com")) & ~first.isin(*K.HANDLE_STOP) & rlike(first, r"^[a-z0-9._]{1,40}$")
    return F.when(ok, first)
