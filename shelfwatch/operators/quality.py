"""Checks on crawled pages, extracted products and whole crawls."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions import similarity as S
from shelfwatch.functions import text as X
from shelfwatch.functions import urls as U
from shelfwatch.functions.prices import price_first_number
from shelfwatch.functions.text import contains_any
from shelfwatch.operators import fuzzy
from shelfwatch.operators.keyed import computed_once, shuffled, spread_for_compute
from shelfwatch.session import staged

# Texts of a blocked page, and words every retailer's page has.
BLOCK_PHRASES = [
    "access denied", "you have been blocked", "security check required",
    "unusual traffic detected", "verification required", "please verify you are a human",
    "captcha challenge", "we apologize",
]
PAGE_INDICATORS = {
    "nordstrom": ["nordstrom", "data-reactroot", "product"],
    "anthropologie": ["anthropologie", "product", "anf"],
    "revolve": ["revolve", "revolveassets", "product"],
    "aritzia": ["aritzia", "product", "productinfo"],
    "hm": ["h&m", "hm.com", "product"],
    "abercrombie": ["abercrombie", "product", "anf"],
    "urban_outfitters": ["urban outfitters", "urbanoutfitters", "product"],
    "urbanoutfitters": ["urban outfitters", "urbanoutfitters", "product"],
    "asos": ["asos", "product"],
    "mango": ["mango", "product"],
    "uniqlo": ["uniqlo", "product"],
}

# Titles of a home page answered in place of the page asked for.
HOMEPAGE_PHRASES = ["Clothing | REVOLVE", "Women's Clothing | ", "Shop Women | ",
                    "New Arrivals | ", "Category: ", "Browse | ", "| Shop ", "Welcome to "]

# Titles that are no titles.
GENERIC_TITLES = ["product", "item", "untitled", "n/a", "loading", "skip to", "main content"]
PLACEHOLDER_TITLES = ["extracted by", "no title", "not found"]
FAKE_TITLES = [r"\[url only", r"unknown product", r"product \d+", r"^\s*$", r"^n/a$", r"^none$",
               r"^null$"]

# Advertising texts.
AD_PHRASES = ["shop now", "shop all", "shop the", "save now", "discover our", "explore our",
              "advertisement"]
AD_WORDS = ["sale", "shop", "ad"]

# Texts that tell the stock status, in the order they are tried.
DELISTED_PHRASES = ["no longer available", "not available", "discontinued", "item not found",
                    "removed", "product no longer exists", "page not found", "404",
                    "this product is unavailable", "item unavailable"]
IN_STOCK_PHRASES = ["in stock", "available", "add to bag"]
OUT_OF_STOCK_PHRASES = ["out of stock", "sold out", "coming soon"]
GONE_PAGE_PHRASES = ["404", "page not found", "item not found", "product not found"]

# Smallest plausible crawl per retailer, and for all others.
EXPECTED_MINIMUM = {"revolve": 40, "anthropologie": 50, "urban_outfitters": 50,
                    "abercrombie": 60, "nordstrom": 40, "aritzia": 40}
DEFAULT_MINIMUM = 20
MIN_CATALOG_ROWS = 10

# Extraction routes; the first list that has the retailer wins.
COMMERCIAL_RETAILERS = ["nordstrom", "anthropologie", "abercrombie", "hm", "aritzia",
                        "urban_outfitters"]
MARKDOWN_RETAILERS = ["revolve", "asos", "mango", "hm", "uniqlo"]
PATCHRIGHT_RETAILERS = ["anthropologie", "urban_outfitters", "abercrombie", "aritzia",
                        "nordstrom"]

# Markers of the product part of a listing page.
LISTING_MARKERS = ["product-card", "ProductCard", "product-item", "data-product",
                   'class="product']


# --- pages ---------------------------------------------------------------------------

def page_validity(pages: DataFrame) -> DataFrame:
    """``valid``, ``error`` and ``warning`` per page; the whole page is searched, whatever its size."""
    pages = computed_once(pages, _low=F.lower("html"))
    low, size = F.col("_low"), F.length("html")
    blocked = None
    for p in BLOCK_PHRASES:
        hit = F.contains(low, F.lit(p))
        blocked = F.when(hit, p) if blocked is None else blocked.when(hit, p)
    any_phrase = low.rlike("|".join(re.escape(p) for p in BLOCK_PHRASES))
    error = F.when(size < 1000, F.lit("too_short")).when(any_phrase, F.concat(F.lit("blocked: "), blocked))
    name = F.regexp_replace(F.lower("retailer"), "[ &]", "")
    found = None
    for retailer, words in PAGE_INDICATORS.items():
        has = contains_any(low, words)
        found = F.when(name == retailer, has) if found is None else found.when(
            name == retailer, has)
    return pages.withColumns({
        "error": error, "valid": error.isNull(),
        "warning": F.when(error.isNull() & ~F.coalesce(found, F.lit(True)),
                          F.lit("missing_retailer_indicators"))}).drop("_low")


def homepage_redirect(content: Column, url: Column) -> Column:
    """A home page title, or a source line that names another page."""
    source = F.regexp_extract(content, r"URL Source:\s*(https?://[^\s\n]+)", 1)
    asked, got = U.url_key_v4(url), U.url_key_v4(source)
    other = (source != "") & ~F.contains(got, asked) & ~F.contains(asked, got)
    return contains_any(content, HOMEPAGE_PHRASES) | other


def listing_window(content: Column, budget: int | None = None) -> Column:
    """The part of a long listing page that holds products.

    Without a ``budget`` pages stay whole. With one, longer pages are cut to so many characters from 500 before the
    first marker: for a reader that takes no more, never ahead of another operator.
    """
    if budget is None:
        return content
    at = F.least(*[F.nullif(F.instr(content, m), F.lit(0)) for m in LISTING_MARKERS])
    start = F.when(at > 1, F.greatest(at - 500, F.lit(1))).otherwise(F.lit(1))
    return F.when(F.length(content) > budget, F.substring(content, start, F.lit(budget))) \
        .otherwise(content)


def size_gate(pages: DataFrame, content: str = "html") -> DataFrame:
    tokens = X.token_estimate(F.col(content))
    return pages.withColumns({"tokens": tokens, "too_large": tokens > 15000})


def truncated(text: Column, max_tokens: int | None = None) -> Column:
    """Text within a token budget, marked where it was cut; whole without a budget."""
    if max_tokens is None:
        return text
    limit = max_tokens * 4
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("\n\n[HTML TRUNCATED]")))


# --- products --------------------------------------------------------------------------

def _images(c: str = "image_urls") -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _no_text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _no_price(c: str = "price") -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0


def errors_strict(min_images: int = 1) -> Column:
    """Rule set A: title, price range, images."""
    return F.array_compact(F.array(
        F.when(_no_text("title"), F.lit("missing_title")),
        F.when(_no_price(), F.lit("missing_price")),
        F.when(contains_any(F.lower("title"), GENERIC_TITLES), F.lit("generic_title")),
        F.when((F.col("price") < 1) | (F.col("price") > 10000), F.lit("unreasonable_price")),
        F.when(_images() < min_images, F.lit("insufficient_images"))))


def errors_rigorous() -> Column:
    """Rule set B: lengths, placeholders, price format, at least two images but for one retailer."""
    size = F.length("title")
    price = F.col("price").cast("string")
    return F.array_compact(F.array(
        F.when(_no_text("title"), F.lit("missing_title")),
        F.when(_no_price(), F.lit("missing_price")),
        F.when(_images() == 0, F.lit("missing_images")),
        F.when(~_no_text("title") & ((size < 5) | (size > 200)), F.lit("title_length")),
        F.when(contains_any(F.lower("title"), PLACEHOLDER_TITLES), F.lit("placeholder_title")),
        F.when(~_no_price() & ~price.rlike(r"[\$£€]?\d+([.,]\d{2})?"), F.lit("price_format")),
        F.when(_images() == 0, F.lit("no_images"))
        .when((_images() < 2) & (F.col("retailer") != "hm"), F.lit("few_images"))))


def passes_minimum(min_images: int = 1) -> Column:
    """Rule set C: required fields and the image minimum."""
    return ~_no_text("title") & ~_no_price() & (_images() >= min_images)


def ad_reasons(product_path: str = "/s/") -> Column:
    """Why a listing row looks like an advertisement; an empty array keeps it."""
    low = F.lower(F.coalesce("title", F.lit("")))
    return F.array_compact(F.array(
        F.when(~_no_text("url") & ~F.contains("url", F.lit(product_path)), F.lit("url_path")),
        F.when(contains_any(low, AD_PHRASES), F.lit("ad_phrase")),
        F.when((F.length(low) < 10) & contains_any(low, AD_WORDS), F.lit("short_generic_title")),
        F.when(_no_price(), F.lit("missing_price"))))


def stock_status(text: Column, page_text: Column, has_product: Column,
                 has_button: Column) -> Column:
    """Stock status from its text, else from page-level signs."""
    low = F.lower(text)
    return (F.when(contains_any(low, DELISTED_PHRASES), "no_longer_available")
            .when(contains_any(low, IN_STOCK_PHRASES), "in_stock")
            .when(contains_any(low, OUT_OF_STOCK_PHRASES), "out_of_stock")
            .when(contains_any(F.lower(page_text), GONE_PAGE_PHRASES) & ~has_product,
                  "no_longer_available")
            .when(has_button, "in_stock").otherwise("unknown"))


def assessment_route(retailer: Column, clothing_type: Column) -> Column:
    """One retailer only sends dresses and tops to review; its rest becomes drafts."""
    picky = (F.lower(retailer) == "mango") & ~F.coalesce(clothing_type, F.lit("other")).isin(
        "dress", "top", "dress_top")
    return F.when(picky, "draft").otherwise("assessment")


def with_clothing_type(products: DataFrame) -> DataFrame:
    """Category overrides the extracted type for all retailers but one."""
    own = F.lower("retailer") == "mango"
    return products.withColumns({
        "clothing_type": X.clothing_type(F.when(own, F.coalesce("clothing_type", F.lit("unknown")))
                                         .otherwise(F.coalesce("category", F.lit("")))),
        "clothing_type_source": F.when(own, "extraction").otherwise("category_override")})


def extraction_route(retailer: Column) -> Column:
    return (F.when(F.lower(retailer).isin(COMMERCIAL_RETAILERS), "commercial")
            .when(retailer.isin(MARKDOWN_RETAILERS), "markdown")
            .when(retailer.isin(PATCHRIGHT_RETAILERS), "patchright").otherwise("default"))


def missing_image_failures(products: DataFrame) -> DataFrame:
    """Failure rows of listings without images: field empty, or field absent."""
    present = F.col("images").isNotNull() | F.col("image_urls").isNotNull()
    n = F.coalesce(F.size("images"), F.lit(0)) + _images()
    return products.filter(n == 0).select(
        "url", F.when(present, "field present but empty").otherwise("no image fields")
        .alias("reason"), F.lit("image_extraction").alias("stage"),
        F.when(present, "known_error").otherwise("uncertain").alias("certainty"),
        (~_no_price()).alias("has_price"), (~_no_text("title")).alias("has_title"))


# --- reconciling two extractions of a page -------------------------------------------------

def reconcile_by_position(first: DataFrame, second: DataFrame) -> DataFrame:
    """Merge two extractions of a page row by row where both found as many rows.

    Rows are matched by their order on the page, whatever numbers the positions are. The second gives title and price. A title similarity under 0.7 or a price
    difference of 1 or more is a mismatch; under 0.5 or from 5 on the first
    extraction overrides. ``first`` has (page_id, position, url, dom_title,
    dom_price), ``second`` (page_id, position, title, price).
    """
    counts = (first.groupBy("page_id").agg(F.count(F.lit(1)).alias("n1"))
              .join(second.groupBy("page_id").agg(F.count(F.lit(1)).alias("n2")), "page_id")
              .filter("n1 = n2").select("page_id"))
    order = Window.partitionBy("page_id").orderBy("position")
    place = lambda rows: rows.withColumn("_nth", F.row_number().over(order))
    rows = place(first.join(counts, "page_id", "left_semi")).join(
        place(second).drop("position"), ["page_id", "_nth"]).drop("_nth")
    both_t = ~_no_text("dom_title") & ~_no_text("title")
    dom_price = price_first_number(F.col("dom_price"), None)
    rows = rows.withColumns({
        "similarity": F.when(both_t, S.sequence_ratio()(F.lower("dom_title"), F.lower("title"))),
        "price_gap": F.when(~_no_text("dom_price") & ~_no_price(),
                            F.abs(dom_price - F.col("price")))})
    sim, gap = F.col("similarity"), F.col("price_gap")
    return rows.select(
        "page_id", "position", "url",
        F.when(sim < 0.5, F.col("dom_title")).otherwise(F.col("title")).alias("title"),
        F.when(gap >= 5, dom_price).otherwise(F.col("price")).alias("price"),
        (sim.isNotNull().cast("int") + gap.isNotNull().cast("int")).alias("validations"),
        (F.coalesce(sim < 0.7, F.lit(False)).cast("int")
         + F.coalesce(gap >= 1, F.lit(False)).cast("int")).alias("mismatches"),
        F.when(sim < 0.5, "dom_override").alias("title_source"),
        F.when(gap >= 5, "dom_override").alias("price_source"))


def reconcile_by_slug(first: DataFrame, second: DataFrame) -> DataFrame:
    """Merge two extractions of different length by title against the url's last segment.

    Each row of ``second`` takes its most similar link of the page above 0.5,
    the earlier one on ties; without one it is dropped. Links nobody took are
    appended with ``needs_reprocessing``.

    At one half no key is exact, so titles meet the links of their page, but
    only bounds are worked out for all pairs: the characters in common, read from
    bags made once per text. A title is scored against the link of the highest
    bound first, and then only against links whose bound is not below that score.
    """
    threshold = 0.5
    slug = F.substring_index(F.lower("url"), "/", -1)
    links = first.select("page_id", F.col("position").alias("link_position"), "url", "dom_title",
                         "dom_price", slug.alias("slug"))
    rows = second.withColumn("low", F.lower(F.coalesce("title", F.lit(""))))
    scored = slug_scores(rows.select("page_id", "low"), links.select("page_id", "slug"), threshold)
    scored = scored.filter(F.col("similarity") > threshold)
    # The best link is the title's, whichever rows have it, so it is found before the rows are met.
    linked = (scored.join(shuffled(links.select("page_id", "slug", "link_position", "url")), ["page_id", "slug"])
              .groupBy("page_id", "low")
              .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "link_position", "url"))
                   .alias("m")))
    best = (rows.select("page_id", "low", "position", "title", "price").repartition("page_id", "low").distinct()
            .join(shuffled(linked), ["page_id", "low"])
            .select("page_id", F.col("m.url").alias("url"), "title", "price",
                    (-F.col("m.s")).alias("match_confidence"),
                    F.lit(False).alias("needs_reprocessing")))
    price = F.coalesce(price_first_number(F.col("dom_price"), None), F.lit(0.0))
    left = links.join(best.select("page_id", "url"), ["page_id", "url"], "left_anti").select(
        "page_id", "url",
        F.when(_no_text("dom_title"), F.concat(
            F.lit("[URL only: "), F.substring_index("url", "/", -1), F.lit("]")))
        .otherwise(F.col("dom_title")).alias("title"), price.alias("price"),
        F.lit(None).cast("double").alias("match_confidence"),
        (_no_text("dom_title") | (price <= 0)).alias("needs_reprocessing"))
    return best.unionByName(left)


def slug_scores(titles: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(page_id, low, slug, similarity) of the pairs of a page that can be a title's best above ``threshold``.

    Every pair whose score is a title's highest, and above the threshold, is among them.
    """
    bag = lambda c: F.explode(F.array(S.char_bag(F.col(c))))  # noqa: E731  a value of its own, made once per text
    # The texts of a page meet in one task before bags are made, which take several times their bytes.
    left = spread_for_compute(titles.filter(F.col("low") != ""), "page_id").distinct().select("page_id", "low", bag("low").alias("_left"))
    right = spread_for_compute(links.filter(F.col("slug") != ""), "page_id").distinct().select("page_id", "slug", bag("slug").alias("_right"))
    a, b = F.length("low"), F.length("slug")
    reach = 2.0 * F.least(a, b) / (a + b) > threshold
    bound = 2.0 * F.size(F.array_intersect("_left", "_right")) / (a + b)
    pairs = left.join(shuffled(right), "page_id").filter(reach)
    pairs = pairs.select("page_id", "low", "slug", F.explode(F.array(bound)).alias("bound")).filter(F.col("bound") > threshold)
    highest = F.max(F.struct("bound", "slug")).over(Window.partitionBy("page_id", "low"))
    pairs = staged(pairs.withColumn("first", F.col("slug") == highest["slug"]), "slug-bounds")
    first = pairs.filter("first").select("page_id", "low", "slug")

    def scored(some: DataFrame) -> DataFrame:
        texts = fuzzy.ratios(some.select(F.col("low").alias("lt"), F.col("slug").alias("rt")).distinct())
        return some.join(texts.select(F.col("lt").alias("low"), F.col("rt").alias("slug"), F.col("ratio").alias("similarity")), ["low", "slug"])

    head = staged(scored(first), "slug-first").select("page_id", "low", "slug", "similarity")
    rest = pairs.join(head.select("page_id", "low", F.col("slug").alias("_done"), F.col("similarity").alias("_best")), ["page_id", "low"])
    rest = rest.filter((F.col("slug") != F.col("_done")) & (F.col("bound") >= F.col("_best") - 1e-9)).select("page_id", "low", "slug")
    return head.unionByName(scored(rest).select("page_id", "low", "slug", "similarity"))


def title_cross_check(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Similarity of two titles of one record; above 0.8 they validate each other.

    Distinct title pairs are scored, those that need matching in Python; rows without one of the titles have no score.
    """
    low = rows.withColumns({"_lt": F.lower(left), "_rt": F.lower(right)})
    there = F.col("_lt").isNotNull() & F.col("_rt").isNotNull()
    texts = fuzzy.ratios(low.filter(there).select(F.col("_lt").alias("lt"), F.col("_rt").alias("rt")).distinct())
    scored = low.join(texts, (F.col("_lt") == F.col("lt")) & (F.col("_rt") == F.col("rt")), "left")
    return scored.withColumnRenamed("ratio", "similarity").drop("_lt", "_rt", "lt", "rt").withColumn("validated", F.col("similarity") > 0.8)


def reconciliation_statistics(merged: DataFrame) -> DataFrame:
    v, m = F.sum("validations"), F.sum("mismatches")
    return merged.agg(v.alias("validations"), m.alias("mismatches"),
                      F.count(F.lit(1)).alias("total_products"),
                      F.try_divide((v - m) * 100.0, v).alias("accuracy"))


# --- whole crawls -----------------------------------------------------------------------------

def expected_minimum(retailer: Column) -> Column:
    out = None
    for name, n in EXPECTED_MINIMUM.items():
        hit = F.lower(retailer) == name
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.otherwise(DEFAULT_MINIMUM)


def crawl_quality(rows: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Audit of extracted ``rows`` against the number of ``links`` per crawl.

    ``by`` are the crawl keys and must hold ``retailer``.
    """
    title, n = F.col("title"), F.count(F.lit(1))
    fake = F.lower(F.trim(title)).rlike("|".join(f"(?:{p})" for p in FAKE_TITLES))
    have = ~_no_text("title")
    stats = rows.groupBy(*by).agg(
        n.alias("rows"), F.count_if(have & fake).alias("fake_titles"),
        F.count_if(~have).alias("missing_titles"),
        F.count_if(have & F.col("price").isNull()).alias("missing_prices"),
        F.count_if(have & (F.col("price") <= 0)).alias("invalid_prices"))
    out = (links.groupBy(*by).agg(n.alias("links")).join(stats, by, "left")
           .na.fill(0, ["rows", "fake_titles", "missing_titles", "missing_prices",
                        "invalid_prices"]))
    ratio, low = F.col("rows") / F.col("links"), expected_minimum(F.col("retailer"))
    too_few = (F.col("rows") < low) & (F.col("links") > low)
    errors = F.array_compact(F.array(
        F.when(F.col("fake_titles") > 0, F.lit("fake_titles")),
        F.when(too_few, F.lit("below_minimum"))))
    warnings = F.array_compact(F.array(
        F.when((F.col("links") > 20) & (ratio < 0.3), F.lit("low_extraction_ratio")),
        F.when(F.col("missing_titles") > F.col("rows") * 0.1, F.lit("missing_titles")),
        F.when(F.col("missing_prices") > F.col("rows") * 0.1, F.lit("missing_prices")),
        F.when(F.col("invalid_prices") > 0, F.lit("invalid_prices"))))
    return out.withColumns({"extraction_ratio": ratio, "errors": errors, "warnings": warnings,
                            "valid": F.size(errors) == 0})


def catalog_validation(rows: DataFrame, by: str) -> DataFrame:
    """Per crawl: row minimum, rows without url, duplicate urls.

    Duplicates are counted by grouping (crawl, url) first, so a crawl however
    large is never held as one distinct set.
    """
    urls = (rows.groupBy(by, "url").agg(F.count(F.lit(1)).alias("k")).groupBy(by).agg(
        F.sum("k").alias("rows"),
        F.coalesce(F.sum(F.when(_no_text("url"), F.col("k"))), F.lit(0)).alias("missing_urls"),
        F.coalesce(F.sum(F.when(~_no_text("url"), F.col("k") - 1)), F.lit(0))
        .alias("duplicate_urls")))
    return urls.withColumn("valid", (F.col("rows") >= MIN_CATALOG_ROWS)
                           & (F.col("missing_urls") == 0))


def acceptance(rows: DataFrame) -> DataFrame:
    """Per retailer: rows, urls, titles, prices; accepted at 80 percent and the minimum."""
    n = F.count(F.lit(1))
    out = rows.groupBy("retailer").agg(
        n.alias("total"), F.count_if(~_no_text("url")).alias("with_urls"),
        F.count_if(F.length("title") > 5).alias("with_titles"),
        F.count_if(F.col("price") > 0).alias("with_prices"))
    return out.withColumn(
        "meets_expectations",
        (F.col("total") >= expected_minimum(F.col("retailer")))
        & (F.col("with_titles") >= F.col("total") * 0.8)
        & (F.col("with_prices") >= F.col("total") * 0.8))


def completeness(products: DataFrame) -> DataFrame:
    has = {"has_title": F.coalesce(F.length("title") > 5, F.lit(False)),
           "has_price": F.coalesce(F.col("price") > 0, F.lit(False)),
           "has_images": _images() > 0}
    return products.withColumns(has).withColumn(
        "complete", F.col("has_title") & F.col("has_price") & F.col("has_images"))


def completeness_totals(products: DataFrame, by: str) -> DataFrame:
    ok = F.col("success")
    return completeness(products).groupBy(by).agg(
        F.count_if(F.col("complete") & ok).alias("passed"),
        F.count_if(ok & ~F.col("complete")).alias("partial"), F.count_if(~ok).alias("failed"))
