"""URL keys, codes and identifiers as native column expressions.

Four URL keys exist side by side because the jobs that use them disagree on
slashes, case and fragments; each job names the one it needs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code patterns per retailer, one set per kind of job.
CODE_PATTERNS = {
    "markdown": {
        "revolve": r"/dp/([A-Z0-9\-]+)/?",
        "asos": r"/prd/(\d+)",
        "aritzia": r"/([A-Z0-9\-]+)/?$",
        "anthropologie": r"/shopop/([A-Z0-9\-]+)",
        "abercrombie": r"/shop/([A-Za-z0-9\-]+)/?$",
        "hm": r"\.([0-9]+)\.html",
        "uniqlo": r"/([A-Z0-9\-]+)/?$",
        "urban_outfitters": r"/([A-Za-z0-9\-]+)/?$",
        "nordstrom": r"-(\d+)\.html",
        "mango": r"/([A-Z0-9\-]+)\.html",
    },
    "listing": {
        "revolve": r"/dp/([A-Z0-9\-]+)/?",
        "anthropologie": r"/shopop/([A-Z0-9\-]+)",
        "abercrombie": r"/shop/([A-Za-z0-9\-]+)/?$",
        "urban_outfitters": r"/([A-Za-z0-9\-]+)/?$",
        "aritzia": r"/([A-Z0-9\-]+)/?$",
        "nordstrom": r"/s/[^/]+/(\d+)",
    },
    "product": {
        "revolve": r"/dp/([A-Z0-9\-]+)/?",
        "anthropologie": r"/shop/([A-Z0-9\-]+)",
        "abercrombie": r"/shop/([A-Za-z0-9\-]+)/?$",
        "urban_outfitters": r"/([A-Za-z0-9\-]+)/?$",
        "aritzia": r"/([A-Z0-9\-]+)/?$",
        "nordstrom": r"/s/[^/]+/(\d+)",
    },
    "monitor": {
        "revolve": r"(?i)/dp/([A-Z0-9\-]+)/?",
    },
}

# Host text to retailer, first hit wins.
RETAILER_HOSTS = [
    ("revolve.com", "revolve"),
    ("asos.com", "asos"),
    ("mango.com", "mango"),
    ("hm.com", "hm"),
    ("h&m", "hm"),
    ("uniqlo.com", "uniqlo"),
    ("aritzia.com", "aritzia"),
    ("anthropologie.com", "anthropologie"),
    ("urbanoutfitters.com", "urban_outfitters"),
    ("abercrombie.com", "abercrombie"),
    ("nordstrom.com", "nordstrom"),
]


def url_key_v1(url: Column) -> Column:
    """Cut at the first ``?``, then trailing slashes; case and fragment stay."""
    return F.rtrim(F.substring_index(url, "?", 1), F.lit("/"))


def url_authority_and_path(url: Column) -> Column:
    """Authority plus path, without query, fragment or last-segment parameters."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r";[^/]*$", "")
    return F.when(
        bare.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//"),
        F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//", ""),
    ).otherwise(bare)


def url_key_v2(url: Column) -> Column:
    """Scheme, authority (port and user kept) and path; slashes stay."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    return F.concat(scheme, F.lit("://"), url_authority_and_path(url))


def url_key_v3(url: Column) -> Column:
    """V2 without trailing slashes, lower case."""
    return F.lower(F.rtrim(url_key_v2(url), F.lit("/")))


def url_key_v4(url: Column) -> Column:
    """No scheme, no leading www., no query, no trailing slash."""
    no_scheme = F.regexp_replace(url, r"https?://(www\.)?", "")
    return F.rtrim(F.regexp_replace(no_scheme, r"\?.*", ""), F.lit("/"))


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def url_pattern(url: Column) -> Column:
    """Host plus first path segment, the grain of download statistics.

    A link without a host keeps its first 100 characters (fixed value).
    """
    bare = F.regexp_replace(url, r"^https?://", "")
    return F.when(bare.rlike(r"^[^/]"), F.regexp_extract(bare, r"^([^/]+(/[^/]+)?)", 1)).otherwise(
        F.substring(bare, 1, 100))


def last_segment(url: Column, cut_fragment: bool = True) -> Column:
    """Last path segment without query (and fragment)."""
    tail = F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)
    tail = F.substring_index(tail, "?", 1)
    return F.substring_index(tail, "#", 1) if cut_fragment else tail


def product_code(url: Column, retailer: Column, pattern_set: str = "markdown") -> Column:
    """Code from the URL by the retailer's pattern.

    Every set but ``monitor`` falls back to the last path segment; ``monitor``
    gives NULL for retailers it has no pattern for.
    """
    key = retailer if pattern_set == "markdown" else F.lower(retailer)
    found = None
    for name, pattern in CODE_PATTERNS[pattern_set].items():
        hit = F.when((key == name) & url.rlike(pattern), F.regexp_extract(url, pattern, 1))
        found = hit if found is None else F.coalesce(found, hit)
    if pattern_set == "monitor":
        return found
    return F.coalesce(found, last_segment(url, cut_fragment=pattern_set == "markdown"))


def code_from_image(image_url: Column) -> Column:
    """File name up to the extension, the first hyphen and the first underscore."""
    name = F.substring_index(image_url, "/", -1)
    stem = F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    code = F.substring_index(F.substring_index(stem, "-", 1), "_", 1)
    return F.nullif(code, F.lit(""))


def product_identifier(url: Column) -> Column:
    """Stable id of a batch URL: the code for one retailer, host and path otherwise."""
    pattern = CODE_PATTERNS["monitor"]["revolve"]
    return F.when(
        F.contains(F.lower(url), F.lit("revolve.com")) & url.rlike(pattern),
        F.concat(F.lit("revolve:"), F.regexp_extract(url, pattern, 1)),
    ).otherwise(url_authority_and_path(url))


def retailer_from_url(url: Column) -> Column:
    low = F.lower(url)
    out = None
    for text, name in RETAILER_HOSTS:
        hit = F.contains(low, F.lit(text))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def absolute_url(link: Column, base: Column) -> Column:
    """``//x`` and ``/x`` made absolute, http kept, anything else NULL."""
    return (F.when(link.startswith("//"), F.concat(F.lit("https:"), link))
            .when(link.startswith("/"), F.concat(F.rtrim(base, F.lit("/")), link))
            .when(link.startswith("http"), link))
