"""Response headers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directives that a colon may follow, and the headers that are compared.
ROBOT_DIRECTIVES = (
    "all noindex nofollow none noarchive nocache nosnippet noimageindex notranslate noodp noydir "
    "indexifembedded unavailable_after max-snippet max-image-preview max-video-preview"
).split()
SECURITY_HEADERS = (
    "strict-transport-security", "content-security-policy", "x-content-type-options", "x-frame-options", "referrer-policy", "permissions-policy",
)


def robots_header(value: Column) -> Column:
    """(crawler, directive) pairs of an X-Robots-Tag value.

    ``name:`` that isn't a directive's own colon addresses what follows, up to
    the next such name, to one crawler.
    """
    start = F.struct(F.lit(None).cast("string").alias("scope"), F.array().cast("array<struct<crawler:string,directive:string>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        text = F.lower(F.trim(part))
        name = F.trim(F.regexp_extract(text, r"^([^:]*):", 1))
        scoped = F.contains(text, F.lit(":")) & (name != "") & ~name.isin(ROBOT_DIRECTIVES)
        scope = F.when(scoped, name).otherwise(acc["scope"])
        rest = F.when(scoped, F.trim(F.regexp_replace(text, r"^[^:]*:", ""))).otherwise(text)
        more = F.when(rest != "", F.array(F.struct(scope.alias("crawler"), rest.alias("directive")))).otherwise(F.array().cast("array<struct<crawler:string,directive:string>>"))
        return F.struct(scope.alias("scope"), F.concat(acc["out"], more).alias("out"))

    return F.when(value.isNotNull(), F.aggregate(F.split(value, ","), start, step, lambda acc: acc["out"]))


def security_headers(headers: Column) -> Column:
    """Of a map of headers, those that are compared; a header that wasn't sent has no key."""
    kept = F.map_filter(headers, lambda name, _: F.lower(name).isin(list(SECURITY_HEADERS)))
    return F.transform_values(F.transform_keys(kept, lambda name, _: F.lower(name)), lambda _, value: F.substring(value, 1, 1000))


def malformed(header: Column, value: Column) -> Column:
    """Whether a header's own value defeats it."""
    bare = F.lower(F.trim(value))
    return (
        (bare == "")
        | ((header == "strict-transport-security") & ~bare.rlike(r"max-age\s*="))
        | ((header == "x-content-type-options") & (bare != "nosniff"))
    )
