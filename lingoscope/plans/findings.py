"""What a finding is about: the identity that survives from run to run, and the pages it implicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed table: the parts of a finding's detail that name it, by type ([] marks a set, kind= a part that depends on the kind).
IDENTITY = {
    "missing_locale": ["groupKey", "missingLocale"],
    "hreflang_target_failed": ["declaredBy", "locale", "target"],
    "hreflang_target_unreached": ["declaredBy", "locale", "target"],
    "no_hreflang": ["url"],
    "hreflang_family_inconsistent": ["groupKey"],
    "variant_diverged": ["brokenUrl"],
    "content_untranslated": ["kind", "groupKey", "url"],
    "content_structure_differs": ["groupKey"],
    "metadata_missing": ["url"],
    "metadata_duplicated": ["field", "language", "value"],
    "canonical_missing": ["url"],
    "canonical_conflicting": ["kind", "url"],
    "canonical_target_broken": ["url", "canonical"],
    "noindex_present": ["url"],
    "content_duplicated": ["digest"],
    "link_broken": ["target"],
    "link_external_broken": ["target"],
    "certificate_problem": ["kind", "origin"],
    "security_header_contradiction": ["kind", "header"],
    "sitemap_url_failed": ["entries[*].normalised"],
    "page_missing_from_sitemap": ["urls[]"],
    "robots_blocks_indexable": ["rule", "userAgentGroup"],
    "page_orphaned": ["urls[]"],
    "redirect_chain": ["from"],
    "image_missing_dimensions": ["url"],
    "image_legacy_format": ["url"],
    "image_oversized": ["url"],
    "console_error": ["url"],
    "visual_changed": ["url"],
}
#: Fixed table: (subject, origin) fields of the detail, by type.
EVIDENCE = {
    "missing_locale": ("memberUrls[]", "memberUrls[]"),
    "hreflang_family_inconsistent": ("memberUrls[]", "memberUrls[]"),
    "content_structure_differs": ("memberUrls[]", "memberUrls[]"),
    "hreflang_target_failed": ("target", "declaredBy"),
    "hreflang_target_unreached": ("target", "declaredBy"),
    "variant_diverged": ("brokenUrl", "declaredBy[]"),
    "content_untranslated": ("url urls[]", "url urls[]"),
    "metadata_duplicated": ("urls[]", "urls[]"),
    "content_duplicated": ("urls[]", "urls[]"),
    "canonical_conflicting": ("canonical canonicals[]", "url"),
    "canonical_target_broken": ("canonical", "url"),
    "link_broken": ("target", "linkedFrom[]"),
    "link_external_broken": ("target", "linkedFrom[]"),
    "security_header_contradiction": ("affectedUrls[]", "affectedUrls[]"),
    "certificate_problem": ("", ""),
    "page_missing_from_sitemap": ("urls[]", ""),
    "page_orphaned": ("urls[]", ""),
    "robots_blocks_indexable": ("urls[]", ""),
    "sitemap_url_failed": ("entries[*].normalised", ""),
}
ON_THE_PAGE = ("url", "url")



def _strings(detail: Column, path: str) -> Column:
    """The strings at a path of a JSON detail: none, one or several."""
    empty = F.array().cast("array<string>")
    if path.endswith("[]"):
        return F.coalesce(F.from_json(F.get_json_object(detail, f"$.{path[:-2]}"), "array<string>"), empty)
    if "[*]" in path:
        held, field = path.split("[*].")
        rows = F.from_json(F.get_json_object(detail, f"$.{held}"), f"array<struct<{field}: string>>")
        return F.coalesce(F.transform(rows, lambda r: r[field]), empty)
    value = F.get_json_object(detail, f"$.{path}")
    return F.when(value.isNotNull(), F.array(value)).otherwise(empty)


def _by_type(kind: Column, choices: dict, default: Column) -> Column:
    out = None
    for name, value in choices.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out.otherwise(default)


def identity(kind: Column, detail: Column, url: Column) -> Column:
    """A key that stays while observations, counts and populations move."""

    def part(path: str) -> Column:
        if path.endswith("[]") or "[*]" in path:
            return F.array_join(F.array_sort(F.array_distinct(_strings(detail, path))), "\u0001")
        return F.coalesce(F.get_json_object(detail, f"$.{path}"), F.lit(""))

    keys = {name: F.concat_ws("\u0000", F.lit(name), *(part(p) for p in parts)) for name, parts in IDENTITY.items()}
    # a type that isn't known is named by the address it speaks of, and only without one by its whole detail
    subject = F.array_join(F.array_sort(F.array_distinct(_strings(detail, "url"))), "\u0001")
    whole = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(detail, "map<string,string>")))))
    return _by_type(kind, keys, F.concat_ws("\u0000", kind, F.when(subject != "", subject).otherwise(whole)))


def roles(kind: Column, detail: Column) -> Column:
    """(subject, origin): the addresses that are wrong, and the pages where that is put right."""

    def of(at: int) -> Column:
        def strings(paths: str) -> Column:
            parts = [_strings(detail, p) for p in paths.split()]
            return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")

        return _by_type(kind, {name: strings(both[at]) for name, both in EVIDENCE.items()}, strings(ON_THE_PAGE[at]))

    linked = _strings(detail, "linkedFrom[]")
    subject = F.when(kind == "redirect_chain", F.when(F.size(linked) > 0, F.array().cast("array<string>")).otherwise(_strings(detail, "from"))).otherwise(of(0))
    origin = F.when(kind == "redirect_chain", linked).otherwise(of(1))
    return F.struct(subject.alias("subject"), origin.alias("origin"))


def pages_involved(evidence: Column) -> Column:
    """Every address a finding touches, once."""
    same = F.array_sort(F.array_distinct(evidence["subject"])) == F.array_sort(F.array_distinct(evidence["origin"]))
    return F.when(same, evidence["origin"]).otherwise(F.array_distinct(F.concat(evidence["origin"], evidence["subject"])))
