"""Language codes from locales, and the choice of the active language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_language(tag: Column) -> Column:
    """ISO 639-1 part of a locale tag, lower case; an empty first part gives ``en``."""
    first = F.lower(F.element_at(F.split(tag, "[-_]"), 1))
    return F.when(tag.isNotNull(), F.when(first == "", "en").otherwise(first))


def supported_language(tag: Column, supported: Column) -> Column:
    """The tag's base language if it is supported, else null."""
    base = base_language(tag)
    return F.when(F.array_contains(supported, base), base)


def resolve_language(preferred: Column, tag: Column, supported: Column, default: Column) -> Column:
    """STRUCT<code, source>: preference if supported, else locale if supported, else default."""
    from_tag = supported_language(tag, supported)
    pair = lambda code, source: F.struct(code.alias("code"), F.lit(source).alias("source"))
    return (
        F.when(F.array_contains(supported, preferred), pair(preferred, "UserPreference"))
        .when(from_tag.isNotNull(), pair(from_tag, "SystemLocale"))
        .otherwise(pair(default, "DefaultFallback"))
    )
