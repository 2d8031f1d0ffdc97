"""Schemas and constants of the crawl data model.

NULL means "not recorded" everywhere; it is never zero, false or empty.
"""

from __future__ import annotations

HOP = "STRUCT<url: STRING, status: INT, location: STRING>"
ROBOTS_META = "ARRAY<STRUCT<crawler: STRING, directives: ARRAY<STRING>>>"
CONTENT = (
    "STRUCT<is_html: BOOLEAN, isolated: BOOLEAN, text_digest: STRING, text_length: INT, markers: ARRAY<STRING>, "
    "blocks: STRUCT<heading: BOOLEAN, form: BOOLEAN, table: BOOLEAN, media: BOOLEAN, list: BOOLEAN>>"
)
METADATA = f"STRUCT<title: STRING, description: STRING, canonicals: ARRAY<STRING>, robots: {ROBOTS_META}>"
IMAGES = "STRUCT<total: INT, undimensioned: INT, legacy: INT, undimensioned_urls: ARRAY<STRING>, legacy_urls: ARRAY<STRING>, urls: ARRAY<STRING>>"

PAGES = (
    f"run_id STRING, url STRING, http_status INT, fetch_error STRING, hreflang MAP<STRING, STRING>, links ARRAY<STRING>, content {CONTENT}, "
    f"metadata {METADATA}, images {IMAGES}, x_robots_tag STRING, security_headers MAP<STRING, STRING>, redirect_chain ARRAY<{HOP}>"
)
RUNS = (
    "run_id STRING, base STRING, crawl_complete BOOLEAN, scope_narrowed BOOLEAN, entry_url STRING, expected_locales ARRAY<STRING>, "
    "include_paths ARRAY<STRING>, exclude_paths ARRAY<STRING>, requested ARRAY<STRING>, external_complete BOOLEAN, weights_complete BOOLEAN, "
    "render_complete BOOLEAN, sitemap_source STRING, sitemap_discovery STRING, now TIMESTAMP"
)
REVERIFIED = "run_id STRING, url STRING, http_status INT, fetch_error STRING, confirmed BOOLEAN"
ALIASES = f"run_id STRING, requested STRING, served STRING, chain ARRAY<{HOP}>"
EXTERNAL = "run_id STRING, url STRING, http_status INT, fetch_error STRING, confirmed BOOLEAN"
IMAGE_WEIGHTS = "run_id STRING, url STRING, bytes LONG"
SITEMAP = "run_id STRING, raw STRING, url STRING"
ROBOTS = "run_id STRING, group_ix INT, user_agents ARRAY<STRING>, rule_ix INT, kind STRING, pattern STRING, line STRING, line_number INT, evaluable BOOLEAN"
CERTIFICATES = "run_id STRING, origin STRING, issuer STRING, subject STRING, valid_from TIMESTAMP, valid_to TIMESTAMP, authorization_error STRING"
OBSERVATIONS = "run_id STRING, url STRING, ttfb_ms INT, lcp_ms INT, cls STRING, first_party_errors INT, third_party_errors INT, messages ARRAY<STRING>, render_error STRING"
VISUAL = (
    "run_id STRING, url STRING, comparable BOOLEAN, reason STRING, changed_pixels LONG, compared_pixels LONG, "
    "regions ARRAY<STRUCT<x: INT, y: INT, width: INT, height: INT>>, regions_capped BOOLEAN, height_delta INT"
)
FINDINGS = "run_id STRING, ord LONG, type STRING, url STRING, detail STRING"

#: Fixed values that decide results.
MIN_COMPARABLE_CHARS = 200
MAX_METADATA_CHARS = 1000
MAX_LISTED_IMAGES = 10
OVERSIZED_BYTES = 500_000
CERTIFICATE_DAYS = 30
MIN_CHANGED_SHARE = 0.0005
MAX_REGIONS = 8
REGION_CELL = 16
PIXEL_THRESHOLD = 0.1
MAX_RENDERS = 12
MAX_MASKS = 50
MAX_SELECTOR_CHARS = 255
MAX_SITEMAPS = 50
SNAPSHOTS_KEPT = 3
MAX_REDIRECT_HOPS = 10
TREND_RUNS = 12
GRID_ROWS = 14
MAX_UNBROKEN_PAGES = 20
MAX_LISTED_PAGES = 250
FAILURE_BURST = 5
FAILURE_RATE = 0.3
FAILURE_SAMPLE = 20
#: Vital -> (good up to, poor above).
VITALS = {"lcp": (2500, 4000), "cls": (0.1, 0.25), "ttfb": (800, 1800)}
BLOCKS = ("heading", "form", "table", "media", "list")
RULES = (
    "missing_locale hreflang_target_failed hreflang_target_unreached no_hreflang hreflang_family_inconsistent variant_diverged "
    "content_untranslated content_structure_differs metadata_missing metadata_duplicated canonical_missing canonical_conflicting "
    "canonical_target_broken noindex_present content_duplicated link_broken certificate_problem security_header_contradiction "
    "sitemap_url_failed page_missing_from_sitemap robots_blocks_indexable page_orphaned link_external_broken redirect_chain "
    "image_missing_dimensions image_legacy_format image_oversized console_error visual_changed"
).split()
