"""URL identity and scope."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingoscope.functions.binding import once


def page_url(raw: Column) -> Column:
    """Identity of an absolute http(s) URL, in column expressions.

    Lower-case scheme and host, no default port, no query, no fragment, and no
    slash at the end of a path other than the root.  NULL for anything else.
    """

    def parts(text: Column) -> Column:
        path = F.regexp_extract(text, r"^(?i:https?)://[^/?#]+([^?#]*)", 1)
        return F.struct(F.lower(F.regexp_extract(text, r"^(?i)(https?)://", 1)).alias("scheme"), F.lower(F.regexp_extract(text, r"^(?i:https?)://([^/?#]+)", 1)).alias("host"), path.alias("path"))

    def whole(url: Column) -> Column:
        port = F.when(url["scheme"] == "http", ":80$").otherwise(":443$")
        path = F.when(F.length(url["path"]) > 1, F.regexp_replace(url["path"], "/$", "")).when(url["path"] == "", F.lit("/")).otherwise(url["path"])
        return F.when((url["scheme"] != "") & (url["host"] != ""), F.concat(url["scheme"], F.lit("://"), F.regexp_replace(url["host"], port, F.lit("")), path))

    return once(once(F.trim(raw), parts), whole)


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i)(https?://[^/?#]+)", 1))


def extension_of(url: Column) -> Column:
    """What follows the last dot of a path, lower-cased; empty if nothing does."""
    return F.lower(F.regexp_extract(path_of(url), r"\.([^.]*)$", 1))


def in_scope(path: Column, include: Column, exclude: Column) -> Column:
    """Excluded prefixes win; no inclusion covers all; an inclusion covers itself and what is below it."""
    bare = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)

    def covers(entry: Column) -> Column:
        e = F.when(F.length(entry) > 1, F.regexp_replace(entry, "/+$", "")).otherwise(entry)
        return (e == bare) | ((e != "/") & F.startswith(bare, F.concat(e, F.lit("/"))))

    excluded = F.exists(F.coalesce(exclude, F.array().cast("array<string>")), lambda p: F.startswith(path, p))
    included = F.coalesce(include, F.array().cast("array<string>"))
    return ~excluded & ((F.size(included) == 0) | F.exists(included, covers))


def ancestors(url: Column) -> Column:
    """The addresses above a URL, up to its origin's root."""
    parts = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    up_to = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.concat(origin_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(up_to)


def resolve(raw: str, base: str) -> str | None:
    """Identity of a URL as it stands in a page at ``base``."""
    raw = re.sub(r"[\t\n\r]", "", raw).strip(" \f")
    if not raw:
        raw = base
    try:
        url = urlsplit(urljoin(base, raw.replace("\\", "/")))
        if url.scheme.lower() not in ("http", "https") or not url.hostname:
            return None
        port = f":{url.port}" if url.port and url.port != {"http": 80, "https": 443}[url.scheme.lower()] else ""
    except ValueError:
        return None
    path = quote(url.path, safe="/%:@!$&'()*+,;=~-._[]|^`") or "/"
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    return f"{url.scheme.lower()}://{url.hostname.lower()}{port}{path}"


_HOST = r"https?://[a-z0-9][a-z0-9.-]*"
_STEP = r"[A-Za-z0-9_~%+-][A-Za-z0-9_~%+.-]*"
#: Addresses whose identity is what is written: no port, no dots or blanks to take away, nothing to quote.
_WRITTEN = re.compile(rf"({_HOST})?((?:/{_STEP})*)(/?)(?:[?#][!-~]*)?")
_BESIDE = re.compile(rf"({_STEP}(?:/{_STEP})*)/?(?:[?#][!-~]*)?")
_BASE = re.compile(rf"({_HOST})((?:/{_STEP})*/?)")


@lru_cache(maxsize=20_000)
def _resolve_once(raw: str, base: str) -> str | None:
    return resolve(raw, base)


def resolver(base: str | None) -> Callable[[str], str | None]:
    """``resolve`` at one base: addresses that are plain are not taken apart, the others are if they weren't just now."""
    own = _BASE.fullmatch(base) if base else None
    if own is None:
        return lambda raw: resolve(raw, base)
    site, folder = own[1], own[2].rpartition("/")[0]

    def one(raw: str) -> str | None:
        found = _WRITTEN.fullmatch(raw)
        if found and (found[1] or found[2] or found[3]):
            return (found[1] or site) + (found[2] or "/")
        if beside := _BESIDE.fullmatch(raw):
            return f"{site}{folder}/{beside[1]}"
        # what begins with a slash means the same on all pages of a site
        return _resolve_once(raw, f"{site}/" if raw.startswith("/") else base)

    return one


def over_lists(lists: pa.Array, beside: pa.Array, made: Callable[[str], Callable], kind: pa.DataType) -> pa.Array:
    """A list for each list: what ``made(value beside it)`` gives for each of its texts; NULL stays NULL."""
    out, bounds, at = [], [0], 0
    texts, sizes = lists.flatten().to_pylist(), lists.value_lengths().to_pylist()
    for n, by in zip(sizes, beside.to_pylist()):
        if n:
            one = made(by)
            out += [None if x is None else one(x) for x in texts[at : at + n]]
            at += n
        bounds.append(len(out))
    nulls = pa.array([n is None for n in sizes], pa.bool_()) if lists.null_count else None
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out, kind), mask=nulls)


@F.arrow_udf(T.ArrayType(T.StringType()))
def resolved(raw: pa.Array, base: pa.Array) -> pa.Array:
    """Identities of a page's raw addresses (relative ones too), in order; NULL where there is none."""
    return over_lists(raw, base, resolver, pa.string())
