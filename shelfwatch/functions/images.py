"""Image URL rules: validity, upgrade to full size, quality scores, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwatch.functions.text import contains_any

# Patterns that mark placeholder or decoration images.
STATIC_EXCLUSIONS = [
    r"placeholder", r"loading", r"spinner", r"blank\.gif", r"spacer\.gif", r"data:image",
    r"\.svg$", r"_icon", r"logo", r"badge", r"/icons?/", r"/badges?/",
]

# Texts of the second and third filter.
INVALID_TEXTS = ["placeholder", "loading", "spinner", "icon", "logo", "svg", "1x1", "data:image"]
VALID_TEXTS = [".jpg", ".jpeg", ".png", ".webp", "scene7", "cloudinary", "imgix"]
PAGE_EXCLUSIONS = ["icon", "logo", "sprite", "banner", "placeholder", "thumbnail", "badge",
                   "social", "favicon"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".gif"]
IMAGE_WORDS = ["image", "img", "photo", "product", "media"]

# Regex replacements per retailer, applied in order.
UPGRADES = {
    "anthropologie": [
        (r"(?i)_(\d+)_(\d+)\.(jpg|jpeg|png)", "_1094_1405.$3"),
        (r"(?i)_sw\.(jpg|jpeg)", "_xl.$1"),
        (r"(?i)_s\.(jpg|jpeg)", "_l.$1"),
        (r"(?i)_m\.(jpg|jpeg)", "_xl.$1"),
        (r"(?i)_thumb\.(jpg|jpeg)", "_main.$1"),
        (r"\$product\$", r"\$zoom\$"),
        (r"\$thumbnail\$", r"\$large\$"),
        (r"wid=\d+", "wid=1200"),
        (r"hei=\d+", "hei=1500"),
    ],
    "aritzia": [
        (r"(?i)_small\.(jpg|jpeg|png)", "_large.$1"),
        (r"(?i)_medium\.(jpg|jpeg|png)", "_large.$1"),
        (r"(?i)_thumb\.(jpg|jpeg|png)", "_large.$1"),
        (r"w=\d+", "w=1200"),
        (r"width=\d+", "width=1200"),
    ],
    "uniqlo": [
        (r"/\d{3}w/", "/1200w/"),
        (r"(?i)_\d{3}\.(jpg|jpeg|png)", "_1200.$1"),
        (r"w=\d+", "w=1200"),
    ],
    "abercrombie": [
        (r"wid=\d+", "wid=1200"),
        (r"hei=\d+", "hei=1500"),
        (r"qlt=\d+", "qlt=90"),
        (r"(?i)_product\.(jpg|jpeg)", "_prod.$1"),
    ],
    "revolve": [(r"/n/ct/", "/n/uv/")],
    "urban_outfitters": [
        (r"(?i)_(\d+)x(\d+)\.(jpg|jpeg|png)", "_1200x1500.$3"),
        (r"(?i)_small\.(jpg|jpeg)", "_xlarge.$1"),
    ],
    "nordstrom": [
        (r"/\d{3}/", "/1200/"),
        (r"(?i)_\d{3}\.(jpg|jpeg)", "_1200.$1"),
    ],
}
GENERIC_UPGRADE = [
    (r"(?i)_small\.(jpg|jpeg|png)", "_large.$1"),
    (r"(?i)_thumb\.(jpg|jpeg|png)", "_full.$1"),
    (r"(?i)_\d{2,3}\.(jpg|jpeg|png)", "_1200.$1"),
    (r"w=\d+", "w=1200"),
    (r"width=\d+", "width=1200"),
]

# Score terms (texts, points); the flag says whether case counts.
SCORE_A = [
    (["large", "big", "xlarge"], 10, False), (["zoom", "detail"], 8, False),
    (["1000", "1200", "1500", "2000", "3000"], 12, True),
    (["product", "main", "hero"], 5, False), ([".jpg", ".png"], 3, False),
    (["high", "hq"], 7, False), (["thumb", "thumbnail"], -15, False),
    (["small", "tiny", "mini"], -10, False), (["_50", "_100", "_200", "_300"], -8, True),
    (["icon", "badge"], -20, False), ([".gif"], -5, False),
]
SCORE_B = [
    (["large", "big"], 10, False), (["1000", "2000", "3000"], 8, True),
    (["zoom", "detail"], 7, False), (["product", "main"], 5, False),
    ([".jpg", ".png"], 3, False), (["thumb", "thumbnail"], -10, False),
    (["small", "tiny"], -8, False), (["_50", "_100", "_200"], -5, True), (["icon"], -15, False),
]


def static_valid(url: Column) -> Column:
    """Filter A without learned patterns: http(s), ten characters, no exclusion."""
    bad = "(?i)" + "|".join(f"(?:{p})" for p in STATIC_EXCLUSIONS)
    return (F.length(url) >= 10) & ~url.rlike(bad) & (
        url.startswith("http://") | url.startswith("https://"))


def strategy_valid(url: Column, retailer: Column) -> Column:
    """Filter B: no invalid text; an extension, an image host or the retailer's name."""
    low = F.lower(url)
    return ~contains_any(low, INVALID_TEXTS) & (
        contains_any(low, VALID_TEXTS) | F.contains(low, F.lower(retailer)))


def page_valid(url: Column) -> Column:
    """Filter C: no exclusion; an extension or an image word; absolute or rooted."""
    low = F.lower(url)
    return ((F.length(url) >= 10) & ~contains_any(low, PAGE_EXCLUSIONS)
            & (contains_any(low, IMAGE_EXTENSIONS) | contains_any(low, IMAGE_WORDS))
            & (url.startswith("http://") | url.startswith("https://") | url.startswith("/")))


def _replaced(url: Column, rules) -> Column:
    for pattern, new in rules:
        url = F.regexp_replace(url, pattern, new)
    return url


def upgraded(url: Column, retailer: Column) -> Column:
    """The retailer's rules for a full-size image; generic rules for all others."""
    out = None
    for name, rules in UPGRADES.items():
        new = _replaced(url, rules)
        if name == "anthropologie":
            untouched = (new == url) & ~F.contains(new, F.lit("?"))
            new = (F.when(untouched & F.contains(new, F.lit("scene7.com")),
                          F.concat(new, F.lit("?wid=1200&hei=1500&fmt=jpeg&qlt=85")))
                   .when(untouched & F.contains(new, F.lit("anthropologie.com")),
                         F.concat(new, F.lit("?format=1200w"))).otherwise(new))
        out = F.when(retailer == name, new) if out is None else out.when(retailer == name, new)
    return out.otherwise(_replaced(url, GENERIC_UPGRADE))


def _points(url: Column, terms) -> Column:
    low, total = F.lower(url), F.lit(0)
    for texts, points, exact in terms:
        total = total + F.when(contains_any(url if exact else low, texts), points).otherwise(0)
    return total


def quality_score(url: Column, retailer: Column) -> Column:
    low = F.lower(url)
    return (_points(url, SCORE_A)
            + F.when(F.length(url) > 200, 3).when(F.length(url) > 150, 2).otherwise(0)
            + F.when((retailer == "anthropologie") & F.contains(url, F.lit("1094_1405")), 15)
            .otherwise(0)
            + F.when((retailer == "aritzia") & F.contains(low, F.lit("_large")), 10).otherwise(0)
            + F.when(F.contains(url, F.lit("scene7.com")) & F.contains(low, F.lit("zoom")), 10)
            .otherwise(0))


def page_quality_score(url: Column) -> Column:
    return _points(url, SCORE_B) + F.when(F.length(url) > 200, 2).otherwise(0)


def file_name(title: Column, url: Column, index: Column) -> Column:
    safe = F.substring(F.regexp_replace(title, r"[^\w\s-]", ""), 1, 50)
    safe = F.regexp_replace(safe, r"[-\s]+", "_")
    low = F.lower(url)
    ext = (F.when(low.endswith(".png"), "png").when(low.endswith(".webp"), "webp")
           .otherwise("jpg"))
    return F.concat(safe, F.lit("_"), F.substring(F.md5(url), 1, 8), F.lit("_"),
                    index.cast("string"), F.lit("."), ext)
