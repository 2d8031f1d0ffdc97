"""Language tags and locales, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two-letter language codes of ISO 639-1.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy "
    "ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw "
    "ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()

#: One pattern instead of a list of literals, which plans would repeat at every use.
_ONE = f"^({'|'.join(LANGUAGES)})$"


def primary(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^([^-_]*)", 1))


def is_language_tag(tag: Column) -> Column:
    """Whether a declared locale names a language; ``x-default`` doesn't."""
    return F.coalesce(primary(tag).rlike(_ONE), F.lit(False))


def locale_from_path(path: Column) -> Column:
    """The locale that a path's first segment implies, or NULL."""
    segment = F.lower(F.regexp_extract(path, r"^/([A-Za-z]{2}(?:[-_][A-Za-z]{2})?)(?:/|$)", 1))
    return F.when(is_language_tag(segment), F.regexp_replace(segment, "_", "-"))


def answers(present: Column, declared: Column) -> Column:
    """Whether a page in ``present`` serves ``declared``: the same, or a region of it."""
    p, d = F.lower(present), F.lower(declared)
    return (p == d) | F.startswith(p, F.concat(d, F.lit("-")))
