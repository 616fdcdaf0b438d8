"""URLs, identifiers and image addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from adledger import lexicon as lx
from adledger.functions.text import blank_to_null, case, first_group, text_or_empty

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def authority(url: Column) -> Column:
    """Host with port (and user), lower-cased; '' when the URL has none."""
    return F.lower(F.regexp_extract(url, _AUTHORITY, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def canonical_url(url: Column) -> Column:
    """Scheme, lower-case host and path without trailing slashes; nothing else."""
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    host = authority(url)
    path = F.regexp_replace(url_path(url), "/+$", "")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
        path,
    )


def stable_id(source: Column, source_listing_id: Column, url: Column) -> Column:
    """Source name plus ten hex digits of the listing's own id (else of its URL)."""
    raw = F.coalesce(blank_to_null(source_listing_id), canonical_url(url))
    prefix = F.replace(F.lower(source), F.lit(" "), F.lit("_"))
    return F.concat(prefix, F.lit("_"), F.left(F.sha1(raw.cast("binary")), F.lit(10)))


def url_join(base: Column, href: Column) -> Column:
    """Resolve ``href`` against ``base`` (absolute, protocol-, root- or path-relative)."""
    href = text_or_empty(href)
    scheme = F.concat(F.regexp_extract(base, _SCHEME, 1), F.lit(":"))
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    suffix = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(url_path(base), r"^(.*/)[^/]*$", 1)
    merged = F.concat(
        F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_extract(href, r"^([^?#]*)", 1)
    )
    resolved = F.aggregate(
        F.split(merged, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(
            part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        ).when(part == ".", done).otherwise(F.array_append(done, part)),
    )
    return (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(root, F.array_join(resolved, "/"), suffix))
    )


def identify_source(url: Column) -> Column:
    host = authority(url)
    return case([(host.contains(mark), source) for mark, source in lx.HOST_MARKS])


def identity_token(url: Column) -> Column:
    """The part of an offer URL that survives slug rewrites."""
    return F.coalesce(
        F.lower(first_group(url, lx.GUID, 0)),
        first_group(url_path(url), lx.NUMERIC_AD_ID),
        first_group(url, lx.QUERY_AD_ID),
    )


def listing_id_from_url(url: Column, fallback: Column) -> Column:
    return F.coalesce(first_group(url, lx.NUMERIC_AD_ID), fallback)


def has_real_id(source_listing_id: Column) -> Column:
    """True for a marketplace's own id, false for none or a positional placeholder."""
    sid = text_or_empty(source_listing_id)
    placeholder = reduce(
        lambda a, b: a | b, [sid.startswith(p) for p in lx.PLACEHOLDER_ID_PREFIXES]
    )
    return (sid != "") & ~placeholder


def large_as24_image(url: Column) -> Column:
    return F.when(
        url.contains(lx.AS24_IMAGE_HOST), F.regexp_replace(url, lx.AS24_RENDITION, lx.AS24_LARGE)
    ).otherwise(url)


def large_ka_image(url: Column) -> Column:
    replacement = lx.KA_LARGE.replace("$", r"\$")
    return (
        F.when(~url.contains(lx.KA_IMAGE_HOST), url)
        .when(url.contains("?rule="), F.regexp_replace(url, lx.KA_RULE, replacement))
        .otherwise(F.concat(url, F.lit(lx.KA_LARGE)))
    )


def large_images(urls: Column) -> Column:
    """Rewrite every image address to its large rendition and drop repeats."""
    return F.array_distinct(F.transform(urls, lambda u: large_ka_image(large_as24_image(u))))


def first_per_base(urls: Column) -> Column:
    """Keep the first address per image, comparing without the query part."""
    def step(kept: Column, url: Column) -> Column:
        base = F.substring_index(url, "?", 1)
        known = F.exists(kept, lambda k: F.substring_index(k, "?", 1) == base)
        return F.when(known, kept).otherwise(F.array_append(kept, url))

    return F.aggregate(urls, F.array().cast("array<string>"), step)
