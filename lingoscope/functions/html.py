"""Facts of a page's HTML, as column expressions over the ``html`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingoscope.functions.binding import once
from lingoscope.functions.urls import extension_of, resolved
from lingoscope.schema import MAX_LISTED_IMAGES, MAX_METADATA_CHARS, MIN_COMPARABLE_CHARS

#: Entities that are read, robots names, and what counts as a raster or modern image.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " "}
ROBOT_NAMES = ("robots", "googlebot", "googlebot-news", "bingbot")
RASTER = ("jpg", "jpeg", "png", "gif", "bmp", "tiff")
MODERN = ("webp", "avif")
#: Fixed patterns: blocks whose presence is compared, and marks of unfinished templates.
BLOCK_TAGS = {"heading": "h[1-6]", "form": "form", "table": "table", "media": "(img|video|audio|picture|iframe|figure)", "list": "(ul|ol|dl)"}
UNRENDERED = r"\{\{[^{}]{1,120}\}\}|\$\{[^{}]{1,120}\}|\[\[[^\[\]]{1,120}\]\]"

_KEPT = "\u0001"


def element(html: Column, tag: str) -> Column:
    """What the first ``tag`` element holds; NULL without one."""
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def _without(html: Column, *tags: str) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return html


def _entities(text: Column, others: str) -> Column:
    """Reads known entities; ``others`` replaces the rest."""

    def read(text: Column) -> Column:
        out = text
        for name, value in ENTITIES.items():
            out = F.regexp_replace(out, f"(?i){name}", value)
        out = F.regexp_replace(out, "(?i)&amp;", _KEPT)  # a read ampersand must not open another entity
        out = F.regexp_replace(out, r"(?i)&[a-z]+;|&#[0-9]+;", others)
        return F.when(F.contains(text, F.lit("&")) | F.contains(text, F.lit(_KEPT)), F.regexp_replace(out, _KEPT, "&")).otherwise(text)

    return once(text, read)


#: The entities with a name that a title or description may use.
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}


def decoded_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal entities as characters; others stay as they are written."""

    def one(part: Column) -> Column:
        hexadecimal = F.regexp_extract(part, r"^(?i)&#x0*([0-9a-f]{1,6});$", 1)
        decimal = F.regexp_extract(part, r"^&#0*([0-9]{1,7});$", 1)
        code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(decimal != "", decimal).try_cast("int")

        def read(code: Column) -> Column:
            known = code.between(0x20, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
            return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

        named = F.element_at(F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair)), F.lower(part))
        return F.when(F.startswith(part, F.lit("&")), F.coalesce(named, once(code, read), part)).otherwise(part)

    def whole(text: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(r"(?i)(&#x[0-9a-f]+;|&#[0-9]+;|&[a-z]+;|[^&]+|&)"), 1)
        return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)

    return once(text, whole)


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def visible_text(markup: Column) -> Column:
    """What a reader sees, in lower case, white space collapsed."""
    text = F.regexp_replace(_without(markup, "script", "style"), "<[^>]*>", " ")
    return F.lower(_collapsed(_entities(text, " ")))


def content_region(html: Column) -> Column:
    """(region, isolated): main, else a lone article, else the body, else everything."""
    lone = F.size(F.regexp_extract_all(html, F.lit(r"(?i)(<article\b[^>]*>)"), 1)) == 1
    marked = F.coalesce(element(html, "main"), F.when(lone, element(html, "article")))
    return once(marked, lambda m: F.struct(F.coalesce(m, element(html, "body"), html).alias("region"), m.isNotNull().alias("isolated")))


def text_digest(text: Column) -> Column:
    """SHA-256 of a text that is long enough to compare, else NULL."""
    return F.when(F.length(text) >= MIN_COMPARABLE_CHARS, F.sha2(text, 256))


def blocks(region: Column) -> Column:
    return F.struct(*(region.rlike(rf"(?i)<{tag}\b").alias(name) for name, tag in BLOCK_TAGS.items()))


def markers(html: Column) -> Column:
    """Kinds of placeholder left in a page, outside code samples."""
    kinds = {"lorem_ipsum": "lorem ipsum", "unrendered_expression": UNRENDERED}
    return once(visible_text(_without(html, "code", "pre")), lambda shown: F.array_compact(F.array(*(F.when(shown.rlike(test), F.lit(kind)) for kind, test in kinds.items()))))


def text_facts(html: Column) -> Column:
    """(text_length, text_digest) of what a page's content region shows."""
    return once(visible_text(content_region(html)["region"]), lambda t: F.struct(F.length(t).cast("int").alias("text_length"), text_digest(t).alias("text_digest")))


def content(html: Column, is_html: Column) -> Column:
    def full(part: Column) -> Column:
        def described(text: Column) -> Column:
            return F.struct(
                F.lit(True).alias("is_html"), part["isolated"].alias("isolated"), text_digest(text).alias("text_digest"), F.length(text).cast("int").alias("text_length"),
                markers(html).alias("markers"), blocks(part["region"]).alias("blocks"),
            )

        return once(visible_text(part["region"]), described)

    no = F.struct(*(F.lit(False).alias(name) for name in BLOCK_TAGS))
    empty = F.struct(
        is_html.alias("is_html"), F.lit(False).alias("isolated"), F.lit(None).cast("string").alias("text_digest"), F.lit(0).alias("text_length"),
        F.array().cast("array<string>").alias("markers"), no.alias("blocks"),
    )
    return F.when(is_html & (F.trim(html) != ""), once(content_region(html), full)).otherwise(empty)


def head_region(html: Column) -> Column:
    before = F.when(html.rlike(r"(?is)<body\b"), F.regexp_extract(html, r"(?is)^(.*?)<body\b", 1))
    return F.coalesce(element(html, "head"), before, html)


def plain_text(markup: Column) -> Column:
    """A title or description: tags out, entities read, unknown ones kept; NULL if nothing is left."""
    text = _collapsed(decoded_entities(F.regexp_replace(markup, "<[^>]*>", " ")))
    return once(text, lambda t: F.when(t != "", F.substring(t, 1, MAX_METADATA_CHARS)))


def tags(html: Column, name: str) -> Column:
    """All opening tags of a name, in document order."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)(<{name}\b[^>]*>)"), 1)


def attribute(tag: Column, name: str, before: str = r"[\s\"'/]") -> Column:
    """An attribute's value, trimmed; NULL if the tag has none.  ``before`` must precede the name."""
    pattern = rf"(?i){before}{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)"
    # an attribute that is there has a character at least, a quote or another
    return once(F.regexp_extract(tag, pattern, 1), lambda found: F.when(found != "", F.trim(F.regexp_replace(found, r"^[\"']|[\"']$", ""))))


def _title(head: Column) -> Column:
    return plain_text(element(head, "title"))


def _description(head: Column) -> Column:
    metas = F.filter(tags(head, "meta"), lambda t: F.lower(attribute(t, "name")) == "description")
    return plain_text(attribute(F.get(metas, F.lit(0)), "content"))


def title(html: Column) -> Column:
    return once(head_region(html), _title)


def description(html: Column) -> Column:
    return once(head_region(html), _description)


def head_facts(head: Column) -> Column:
    """(title, description, robots) of a head region."""
    return F.struct(_title(head).alias("title"), _description(head).alias("description"), _robots_meta(head).alias("robots"))


def raw_canonicals(html: Column) -> Column:
    links = F.filter(tags(head_region(html), "link"), lambda t: F.array_contains(F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), r"\s+"), "canonical"))
    return F.array_compact(F.transform(links, lambda t: attribute(t, "href")))


def directives(value: Column) -> Column:
    """A robots value's directives: lower case, trimmed, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(value), ","), lambda x: F.trim(x)), lambda x: x != ""))


def robots_meta(html: Column) -> Column:
    return once(head_region(html), _robots_meta)


def _robots_meta(head: Column) -> Column:
    metas = F.filter(tags(head, "meta"), lambda t: F.lower(attribute(t, "name")).isin(list(ROBOT_NAMES)) & attribute(t, "content").isNotNull())

    def one(t: Column) -> Column:
        name = F.lower(attribute(t, "name"))
        return F.struct(F.when(name != "robots", name).alias("crawler"), directives(attribute(t, "content")).alias("directives"))

    return F.transform(metas, one)


def quoted(tag: Column, name: str) -> Column:
    """An attribute's value if it is quoted and not empty, else NULL."""
    pattern = rf"(?i){name}\s*=\s*[\"']([^\"']+)[\"']"
    return F.when(tag.rlike(pattern), F.regexp_extract(tag, pattern, 1))


def raw_hreflang(html: Column) -> Column:
    """(locale, href) of every alternate link, in document order."""
    links = F.filter(tags(html, "link"), lambda t: t.rlike(r"(?i)rel\s*=\s*[\"']?alternate") & quoted(t, "hreflang").isNotNull() & quoted(t, "href").isNotNull())
    return F.transform(links, lambda t: F.struct(F.lower(quoted(t, "hreflang")).alias("locale"), quoted(t, "href").alias("href")))


def raw_links(html: Column) -> Column:
    """Quoted addresses of all anchors but mail and telephone, in document order."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*')"), 1)
    return F.filter(F.transform(found, lambda h: F.regexp_replace(h, r"^[\"']|[\"']$", "")), lambda h: ~F.lower(F.trim(h)).rlike("^(mailto|tel):"))


def first_of_srcset(value: Column) -> Column:
    first = F.get(F.split(F.trim(F.get(F.split(value, ","), F.lit(0))), r"\s+"), F.lit(0))
    return F.when(first != "", first)


def images(df: DataFrame, keys: list[str], html: str = "html", base: str = "url") -> DataFrame:
    """(keys, images): one summary for each page, an address counted once.

    An address is dimensioned, or modern, if any of its uses is.  An ``img`` in
    a ``picture`` that offers a modern format is that offer's fallback.
    """
    page = df.select(*keys, F.col(html).alias("_h"), F.col(base).alias("_b"))
    any_edge = r"\b"
    used = page.select(*keys, "_b", F.posexplode(tags(F.col("_h"), "img")).alias("at", "tag"))
    src = F.coalesce(attribute(F.col("tag"), "src", any_edge), first_of_srcset(attribute(F.col("tag"), "srcset", any_edge)))
    sized = attribute(F.col("tag"), "width", any_edge).isNotNull() & attribute(F.col("tag"), "height", any_edge).isNotNull()
    used = used.select(*keys, "_b", src.alias("src"), sized.alias("dimensioned")).where("src is not null and src <> '' and not startswith(src, 'data:')")
    used = used.withColumn("img", F.get(resolved(F.array("src"), F.col("_b")), F.lit(0))).where("img is not null")

    pictures = page.select(*keys, "_b", F.explode(F.regexp_extract_all("_h", F.lit(r"(?is)<picture\b[^>]*>(.*?)</picture>"), 1)).alias("inner"))
    sources = tags(F.col("inner"), "source")
    types = F.exists(sources, lambda t: F.coalesce(attribute(t, "type", any_edge).rlike("(?i)image/(webp|avif)"), F.lit(False)))
    offered = F.array_compact(F.transform(sources, lambda t: first_of_srcset(attribute(t, "srcset", any_edge))))
    fallbacks = F.array_compact(F.transform(tags(F.col("inner"), "img"), lambda t: attribute(t, "src", any_edge)))
    pictures = pictures.select(*keys, types.alias("typed"), resolved(offered, F.col("_b")).alias("offered"), resolved(fallbacks, F.col("_b")).alias("inside"))
    modern = F.col("typed") | F.exists("offered", lambda u: F.coalesce(extension_of(u).isin(list(MODERN)), F.lit(False)))
    covered = pictures.where(modern).select(*keys, F.explode("inside").alias("img")).where("img is not null").distinct().withColumn("covered", F.lit(True))

    refs = used.groupBy(*keys, "img").agg(F.bool_or("dimensioned").alias("dimensioned")).join(covered, [*keys, "img"], "left")
    refs = refs.withColumn("legacy", extension_of(F.col("img")).isin(list(RASTER)) & F.col("covered").isNull())
    listed = F.array_sort(F.collect_list(F.struct("img", "dimensioned", "legacy")))
    summed = refs.groupBy(*keys).agg(listed.alias("refs"))

    def urls(test) -> Column:
        return F.transform(F.filter("refs", test), lambda r: r["img"])

    undimensioned, legacy = urls(lambda r: ~r["dimensioned"]), urls(lambda r: r["legacy"])
    summary = F.struct(
        F.size("refs").alias("total"), F.size(undimensioned).alias("undimensioned"), F.size(legacy).alias("legacy"),
        F.slice(undimensioned, 1, MAX_LISTED_IMAGES).alias("undimensioned_urls"), F.slice(legacy, 1, MAX_LISTED_IMAGES).alias("legacy_urls"),
        F.slice(urls(lambda r: F.lit(True)), 1, 4 * MAX_LISTED_IMAGES).alias("urls"),
    )
    return summed.select(*keys, summary.alias("images"))
