"""Text clean-up, canonical maps and small text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Retailer names removed from titles.
TITLE_RETAILER_NAMES = {"revolve": "REVOLVE", "asos": "ASOS", "mango": "Mango", "hm": "H&M"}

# A brand equal to one of these is no brand.
RETAILER_BRANDS = ["revolve", "asos", "mango", "h&m", "hm", "uniqlo"]

# Size ranges that expand.
SIZE_RANGES = {
    "XS-XL": ["XS", "S", "M", "L", "XL"],
    "XS-L": ["XS", "S", "M", "L"],
    "S-XL": ["S", "M", "L", "XL"],
}

# Raw clothing type to canonical type.
CLOTHING_TYPES = {
    "dress": ["dress", "dresses", "gown", "gowns", "maxi dress", "midi dress", "mini dress"],
    "top": ["top", "tops", "shirt", "shirts", "blouse", "blouses", "tee", "t-shirt", "tshirt",
            "sweater", "cardigan", "hoodie"],
    "dress_top": ["dress top", "dress tops", "dress-top", "dress-tops", "dress_top", "dress_tops",
                  "tunic", "tunics", "long top", "oversized top"],
    "bottom": ["bottom", "bottoms", "pants", "pant", "jeans", "skirt", "skirts", "shorts",
               "trousers"],
    "outerwear": ["outerwear", "jacket", "jackets", "coat", "coats", "blazer", "blazers"],
}

# Clothing type to store product type.
STORE_TYPES = {
    "Dresses": ["dress", "dresses"],
    "Dress Tops": ["dress top", "dress tops", "dress-top", "dress-tops", "dress_top",
                   "dress_tops"],
    "Tops": ["top", "tops", "shirt", "shirts", "blouse", "blouses"],
    "Bottoms": ["bottom", "bottoms", "pants", "jeans", "skirt", "skirts"],
    "Outerwear": ["outerwear", "jacket", "jackets", "coat", "coats"],
    "Activewear": ["activewear", "sportswear"],
    "Swimwear": ["swimwear"],
    "Lingerie": ["lingerie", "underwear"],
    "Accessories": ["accessories"],
    "Shoes": ["shoes", "footwear"],
}

# Store product types whose tag is not the type itself.
SINGULAR_TAGS = {
    "Dresses": "Dress", "Dress Tops": "Dress Top", "Tops": "Top", "Bottoms": "Bottom",
    "Pants": "Pant", "Jeans": "Jean", "Skirts": "Skirt", "Shorts": "Short",
    "Jackets": "Jacket", "Coats": "Coat", "Accessories": "Accessory", "Shoes": "Shoe",
}

# Keyword lists of the modesty heuristic.
NOT_MODEST_WORDS = ["mini", "crop", "bikini", "revealing", "sheer"]
MODEST_WORDS = ["modest", "maxi", "long sleeve", "high neck", "ankle length"]

# The characters that count as white space around a title.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
               "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Status spellings brought to one form.
SALE_STATUS_FORMS = {"on sale": "on_sale", "on_sale": "on_sale",
                     "not on sale": "regular", "regular": "regular"}
STOCK_STATUS_FORMS = {"in stock": "in_stock", "in_stock": "in_stock",
                      "low in stock": "low_stock", "low_stock": "low_stock",
                      "out of stock": "out_of_stock", "out_of_stock": "out_of_stock"}


def contains_any(text: Column, phrases) -> Column:
    """True if any literal phrase occurs; plain substring tests, no regex."""
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, F.lit(phrase))
    return out


def map_values(key: Column, groups: dict[str, list[str]], default) -> Column:
    """Small fixed map as an ordered ``when`` chain over value lists."""
    out = None
    for value, keys in groups.items():
        out = F.when(key.isin(keys), value) if out is None else out.when(key.isin(keys), value)
    return out.otherwise(default)


def map_forms(key: Column, forms: dict[str, str], default) -> Column:
    out = None
    for name, value in forms.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(default)


def title_case(text: Column) -> Column:
    """Capital after every non-letter, as apostrophes and hyphens count too.

    The built-in ``initcap`` only looks at blanks, so the text is cut into runs
    of letters and non-letters and every run is capitalised on its own.
    """
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def title_key(title: Column) -> Column:
    """Lower case, trimmed of all white space."""
    return F.lower(F.btrim(title, F.lit(WHITE_SPACE)))


def clean_title(title: Column, retailer: Column) -> Column:
    out = F.regexp_replace(title, r"(?i)\b(NEW|SALE|EXCLUSIVE|LIMITED)\b", "")
    for name, text in TITLE_RETAILER_NAMES.items():
        out = F.when(retailer == name, F.replace(out, F.lit(text), F.lit(""))).otherwise(out)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def valid_brand(brand: Column) -> Column:
    has_letters = brand.rlike(r"\p{L}")
    shouting = (brand == F.upper(brand)) & has_letters & (F.length(brand) > 3)
    return (F.when(brand.isNull() | F.lower(brand).isin(RETAILER_BRANDS), F.lit(""))
            .otherwise(F.trim(F.when(shouting, title_case(brand)).otherwise(brand))))


def _split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")


def parse_sizes(text: Column) -> Column:
    out = (F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
           .when(F.contains(text, F.lit(",")), _split_list(text)))
    for span, sizes in SIZE_RANGES.items():
        out = out.when(text == span, F.array(*[F.lit(s) for s in sizes]))
    return out.otherwise(F.array(F.trim(text)))


def parse_colors(text: Column) -> Column:
    return (F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
            .when(F.contains(text, F.lit(",")), _split_list(text))
            .otherwise(F.array(F.trim(text))))


def clothing_type(raw: Column) -> Column:
    return map_values(title_key(raw), CLOTHING_TYPES, F.lit("other"))


def store_type(raw: Column) -> Column:
    return F.when(raw.isNull() | (raw == ""), F.lit("Clothing")).otherwise(
        map_values(title_key(raw), STORE_TYPES, title_case(raw)))


def singular_tag(product_type: Column) -> Column:
    return map_forms(product_type, SINGULAR_TAGS, product_type)


def modesty_keyword_class(title: Column, description: Column) -> Column:
    """Not-modest words win, then modest words, else the middle class."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")),
                               F.coalesce(description, F.lit(""))))
    return (F.when(contains_any(text, NOT_MODEST_WORDS), "not_modest")
            .when(contains_any(text, MODEST_WORDS), "modest")
            .otherwise("moderately_modest"))


def canonical_sale(status: Column) -> Column:
    return map_forms(status, SALE_STATUS_FORMS, status)


def canonical_stock(status: Column) -> Column:
    return map_forms(status, STOCK_STATUS_FORMS, status)


def prompt_key(prompt: Column) -> Column:
    """Prompt with URLs, long numbers and codes replaced, lower case, trimmed."""
    out = F.regexp_replace(prompt, r"https?://[^\s]+", "[URL]")
    out = F.regexp_replace(out, r"\b\d{6,}\b", "[ID]")
    out = F.regexp_replace(out, r"\b[A-Z]{2,}\d+\b", "[CODE]")
    return F.regexp_replace(F.lower(out), r"^\s+|\s+$", "")


def prompt_hash(prompt: Column) -> Column:
    return F.md5(prompt_key(prompt))


def prompt_category(prompt: Column) -> Column:
    low = F.lower(prompt)
    return (F.when(F.contains(low, F.lit("extract from")), "extraction")
            .when(F.contains(low, F.lit("screenshot")), "screenshot").otherwise("other"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def description_html(description: Column) -> Column:
    body = F.concat(F.lit("<p>"), F.replace(description, F.lit("\n"), F.lit("</p><p>")),
                    F.lit("</p>"))
    return F.when(F.coalesce(description, F.lit("")) == "",
                  F.lit("<p>Product description coming soon.</p>")).otherwise(
        F.regexp_replace(body, r"<p>\s*</p>", ""))


def fenced_json(reply: Column) -> Column:
    """Reply text; a fenced one loses its first and last line."""
    bare = F.regexp_replace(reply, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(bare, r"^[^\n]*\n", ""), r"\n[^\n]*$", "")
    return F.when(bare.startswith("```"), inner).otherwise(bare)


def reply_json(reply: Column, kind: str) -> Column:
    """Parsed reply if it is of the kind asked for (``object`` or ``array``), else NULL."""
    parsed = F.try_parse_json(fenced_json(reply))
    return F.when(F.schema_of_variant(parsed).startswith(kind.upper()), parsed)
