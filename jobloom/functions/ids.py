"""Identity of a posting: URLs, keys, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, normalize_text, strip, text

#: Query keys that only track visitors.
TRACKING_KEYS = ("fbclid", "gclid", "li_fat_id", "lipi", "refid", "trk", "trackingid")


def _encoded(c: Column) -> Column:
    """Form encoding as query strings have it: "~" stays, "*" doesn't."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking, no slash at the end, query pairs sorted; text without scheme or host is folded."""
    raw = strip(c)
    scheme = F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    host = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    path = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.struct(
            _decoded(F.substring_index(x, "=", 1)).alias("k"),
            _decoded(F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~(fold(p["k"]).startswith("utm_") | fold(p["k"]).isin(*TRACKING_KEYS))))
    rebuilt = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    url = F.concat(fold(scheme), F.lit("://"), fold(host), path, F.when(rebuilt != "", F.concat(F.lit("?"), rebuilt)).otherwise(F.lit("")))
    return F.when(raw == "", F.lit("")).when((scheme == "") | (host == ""), normalize_text(raw)).otherwise(url)


def presence_url(c: Column) -> Column:
    """The looser form by which a posting is looked up in a board's listing: scheme and host folded, no query, no fragment, no slash at the end."""
    raw = strip(c)
    scheme = F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    host = F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    path = F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.concat(fold(scheme), F.lit("://"), fold(host), F.regexp_replace(path, "/+$", ""))


def presence_keys(ats: Column, url: Column) -> Column:
    """By what a saved posting is found in the listing of its board: its address, or the id that its address holds."""
    greenhouse, bamboohr = F.regexp_extract(text(url), r"gh_jid=(\d+)", 1), F.regexp_extract(text(url), r"/careers/(\d+)", 1)
    keys = F.array(
        F.concat(F.lit("url:"), presence_url(url)),
        F.when((fold(ats) == "greenhouse") & (greenhouse != ""), F.concat(F.lit("id:"), greenhouse)),
        F.when((fold(ats) == "bamboohr") & (bamboohr != ""), F.concat(F.lit("id:"), bamboohr)),
    )
    return F.filter(keys, lambda k: k.isNotNull())


def dedup_key(source: Column, url: Column, company: Column, title: Column, city_region: Column) -> Column:
    by_url = normalize_url(url)
    fallback = F.concat_ws("|", normalize_text(company), normalize_text(title), normalize_text(city_region))
    return F.when(by_url != "", F.concat_ws("|", normalize_text(source), F.lit("url"), by_url)).otherwise(F.concat_ws("|", normalize_text(source), F.lit("fallback"), fallback))


def source_slug(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(normalize_text(c), r"(?U)[^\w]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.lit("job")).otherwise(slug)


def job_id(source: Column, key: Column) -> Column:
    return F.concat(source_slug(source), F.lit("_"), F.substring(F.sha1(F.encode(key, "UTF-8")), 1, 12))


def company_title_key(company: Column, title: Column) -> Column:
    """Lower case only (no folding), blanks squeezed."""
    one = lambda c: F.lower(F.trim(F.regexp_replace(text(c), r"(?U)\s+", " ")))
    return F.concat(one(company), F.lit("|"), one(title))


def app_key(job: Column, url: Column) -> Column:
    """job_id, or "url:" and the normalised URL for rows typed in by hand; null without either."""
    return F.when(strip(job) != "", strip(job)).when(strip(url) != "", F.concat(F.lit("url:"), normalize_url(url)))
