"""Product rows out of a table of crawled pages.

All rules are native expressions over the page column, applied in one pass
without multiplying the page text: a field takes the first of its ordered rules
that finds something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import images as I
from shelfwatch.functions import urls as U
from shelfwatch.functions.prices import price_digits
from shelfwatch.operators import quality
from shelfwatch.operators.keyed import computed_once

EMBEDDED = "title string, price double, description string, image_urls array<string>, " \
           "stock_status string, brand string, product_id string"

# Where each retailer's page keeps its embedded state.
STATE_PATTERNS = {
    "urban_outfitters":
        r"(?s)(?:window\.__INITIAL_STATE__|__NUXT__)\s*=\s*(\{.+?\});?\s*(?:</script|$)",
    "aritzia":
        r"(?s)(?:__NEXT_DATA__|window\.__INITIAL_STATE__)\s*=\s*(\{.+?\});?\s*(?:</script|$)",
}
CATALOG_PATTERN = r"(?s)productCatalog\[\d+\]\s*=\s*(\{[^;]+\});"
PRICES_PATTERN = r"(?s)productPrices\[\d+\]\s*=\s*(\{[^;]+\});"
IMAGE_HOST = "https://img.abercrombie.com/is/image/anf/"
IMAGE_POLICY = "?policy=product-large"

# Paths of the product inside the state, and of its fields.
STATE_ROOTS = {"urban_outfitters": ["$.product", "$.data.product", "$"],
               "aritzia": ["$.props.pageProps.product", "$.product", "$"]}
STATE_PATHS = {
    "title": ["$.name", "$.title"],
    "price": ["$.price.current", "$.currentPrice", "$.price"],
    "description": ["$.description"],
    "product_id": ["$.id", "$.productId", "$.sku"],
}

# Listing-tile rules per retailer.
TILE_RULES = {
    "anthropologie": {"marker": r'<[a-z]+\b[^>]*class="[^"]*\bo-pwa-product-tile(?![\w-])[^"]*"[^>]*>',
                      "link": r'href="([^"?]*/shop/[^"?]*)', "low": 10, "high": 5000},
    "revolve": {"marker": r'<li\b[^>]*class="[^"]*\bplp__product(?![\w-])[^"]*"[^>]*>',
                "link": r'href="([^"?]*/dp/[^"?]*)', "low": 15, "high": 2000},
}


def by_class(tag: str, name: str) -> str:
    """Pattern for the content of a tag with a class."""
    return rf'(?is)<{tag}\b[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</{tag}>'


def by_tag(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"


def by_attribute(tag: str, attribute: str, value: str) -> str:
    return rf'(?is)<{tag}\b[^>]*{attribute}="{value}"[^>]*>(.*?)</{tag}>'


# Field rules as (field, ordered patterns); the star applies to all retailers.
FIELD_RULES = {
    "*": {
        "title": [by_class("h1", "product-title"), by_class("h1", "product-name"),
                  by_attribute("h1", "itemprop", "name"), by_tag("h1")],
        "price": [by_class("span", "product-price"), by_class("span", "price"),
                  by_class("div", "price")],
        "description": [by_class("div", "product-description"),
                        by_attribute("div", "itemprop", "description")],
        "stock_text": [by_class("span", "availability"),
                       by_attribute("span", "itemprop", "availability")],
    },
    "nordstrom": {
        "title": [by_attribute("h1", "data-testid", "product-title")],
        "price": [by_attribute("span", "data-testid", "product-price")],
    },
    "anthropologie": {
        "title": [by_class("h1", "c-pwa-product-meta__name")],
        "price": [by_class("[a-z]+", "c-pwa-product-price__current")],
    },
}

# Listing-link rules: texts the href must hold, tried in order.
LINK_RULES = {"nordstrom": ["/s/"], "anthropologie": ["/shop/"], "revolve": ["/dp/"],
              "*": ["/"]}


def plain_text(html: Column) -> Column:
    """Text of a fragment: tags out, blanks folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", ""), r"\s+", " "))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _number(text: Column) -> Column:
    return text.try_cast("double")


# --- embedded data -------------------------------------------------------------------------

def json_ld_products(pages: DataFrame) -> DataFrame:
    """First structured-data product of every page that has one."""
    pattern = r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all(
        "html", F.lit(pattern), F.lit(1))).alias("pos", "block"))
    blocks = computed_once(blocks, v=F.try_parse_json("block")).drop("block")
    v = F.col("v")
    is_product = "$['@type']"
    in_list = F.get(F.filter(_get(v, "$", "array<variant>"),
                             lambda x: _get(x, is_product) == "Product"), F.lit(0))
    rows = blocks.select("page_id", "pos", F.coalesce(
        in_list, F.when(_get(v, is_product) == "Product", v)).alias("p")).filter("p IS NOT NULL")
    p = F.col("p")
    rows = computed_once(rows, offer=F.coalesce(_get(p, "$.offers[0]", "variant"),
                                                _get(p, "$.offers", "variant")))
    offer = F.col("offer")
    many = F.coalesce(_get(offer, is_product), F.lit("")) == "AggregateOffer"
    price = F.when(many, F.coalesce(_get(offer, "$.lowPrice"), _get(offer, "$.highPrice"),
                                    _get(offer, "$.offers[0].price"))).otherwise(
        _get(offer, "$.price"))
    currency = F.coalesce(_get(offer, "$.priceCurrency"), F.lit("USD"))
    stock = F.lower(F.coalesce(_get(offer, "$.availability"), F.lit("")))
    gone = F.contains(stock, F.lit("outofstock")) | F.contains(stock, F.lit("discontinued"))
    images = F.coalesce(_get(p, "$.image", "array<string>"),
                        F.array_compact(F.array(_get(p, "$.image"))))
    found = rows.select(
        "page_id", "pos", F.coalesce(_get(p, "$.name"), F.lit("")).alias("title"),
        _number(F.trim(F.replace(price, currency, F.lit("")))).alias("price"),
        F.coalesce(_get(p, "$.description"), F.lit("")).alias("description"),
        images.alias("image_urls"),
        F.when(gone, "out_of_stock").otherwise("in_stock").alias("stock_status"),
        F.coalesce(_get(p, "$.brand.name"), _get(p, "$.brand")).alias("brand"),
        F.coalesce(_get(p, "$.sku"), _get(p, "$.productID")).alias("product_id"))
    cols = [c for c in found.columns if c not in ("page_id", "pos")]
    return (found.groupBy("page_id").agg(F.min(F.struct("pos", *cols)).alias("m"))
            .select("page_id", *[F.col(f"m.{c}").alias(c) for c in cols]))


def _state_struct(root: Column, retailer: str) -> Column:
    def first(field, kind="string"):
        return F.coalesce(*[F.nullif(_get(root, p, kind), F.lit("" if kind == "string" else 0.0))
                            for p in STATE_PATHS[field]])

    def pictures(path):
        return F.array_compact(F.transform(_get(root, path, "array<variant>"), lambda x: F.coalesce(
            _get(x, "$.url"), _get(x, "$.src"))))

    live = F.coalesce(_get(root, "$.available", "boolean"), F.lit(False)) | F.coalesce(
        _get(root, "$.inStock", "boolean"), F.lit(False))
    brand = F.lit("Aritzia") if retailer == "aritzia" else F.coalesce(
        _get(root, "$.brand"), F.lit("Urban Outfitters"))
    return F.struct(
        first("title").alias("title"), _number(first("price")).alias("price"),
        first("description").alias("description"),
        F.coalesce(pictures("$.images"), pictures("$.media")).alias("image_urls"),
        F.when(live, "in_stock").otherwise("out_of_stock").alias("stock_status"),
        brand.alias("brand"), first("product_id").alias("product_id")).cast(
        f"struct<{_as_struct(EMBEDDED)}>")


def _as_struct(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ":", 1) for f in fields.split(", "))


def _keyed_struct(catalog: Column, prices: Column) -> Column:
    """Product of a page with a catalog object and a price object.

    Prices are held per item; the first item counts, its offer price where that
    is below the list price.
    """
    items = _get(prices, "$.items", "map<string, variant>")
    item = F.get(F.map_values(items), F.lit(0))
    sale, full = _get(item, "$.offerPrice", "double"), _get(item, "$.listPrice", "double")

    def pictures(path):
        ids = F.transform(_get(catalog, path, "array<variant>"), lambda x: _get(x, "$.id"))
        ids = F.filter(ids, lambda i: i.isNotNull() & (i != ""))
        return F.transform(ids, lambda i: F.concat(F.lit(IMAGE_HOST), i, F.lit(IMAGE_POLICY)))

    model, prod = pictures("$.imageSets.model"), pictures("$.imageSets.prod")
    return F.struct(
        F.coalesce(F.nullif(_get(catalog, "$.name"), F.lit("")), _get(catalog, "$.name_EN"))
        .alias("title"),
        F.when((sale != 0) & (sale < full), sale).otherwise(full).alias("price"),
        F.coalesce(F.nullif(_get(catalog, "$.longDesc"), F.lit("")), _get(catalog, "$.shortDesc"))
        .alias("description"),
        F.when(F.size(model) > 0, model).otherwise(prod).alias("image_urls"),
        F.lit("in_stock").alias("stock_status"),
        F.coalesce(_get(catalog, "$.productAttrs.brand"), F.lit("Abercrombie & Fitch"))
        .alias("brand"), _get(catalog, "$.productId").alias("product_id")).cast(
        f"struct<{_as_struct(EMBEDDED)}>")


def state_products(pages: DataFrame) -> DataFrame:
    """Products from the state objects some retailers embed; needs ``retailer``."""
    def state(name):
        return F.try_parse_json(F.nullif(F.regexp_extract(
            "html", STATE_PATTERNS[name], 1), F.lit("")))

    def keyed(pattern):
        return F.when(F.col("retailer") == "abercrombie", F.try_parse_json(F.nullif(
            F.regexp_extract("html", pattern, 1), F.lit(""))))

    parsed = computed_once(
        pages.filter(F.col("retailer").isin("abercrombie", *STATE_PATTERNS)),
        **{f"s_{n}": F.when(F.col("retailer") == n, state(n)) for n in STATE_PATTERNS},
        catalog=keyed(CATALOG_PATTERN), prices=keyed(PRICES_PATTERN)).drop("html")
    parsed = computed_once(parsed, **{f"r_{n}": F.coalesce(*[
        _get(F.col(f"s_{n}"), path, "variant") for path in STATE_ROOTS[n]])
        for n in STATE_PATTERNS})
    product = F.when(F.col("catalog").isNotNull() | F.col("prices").isNotNull(),
                     _keyed_struct(F.col("catalog"), F.col("prices")))
    for n in STATE_PATTERNS:
        product = product.when(F.col(f"s_{n}").isNotNull(), _state_struct(F.col(f"r_{n}"), n))
    return (computed_once(parsed.select("page_id", "catalog", "prices", *[
        f"{k}_{n}" for k in "sr" for n in STATE_PATTERNS]), p=product)
            .filter(F.coalesce(F.col("p.title"), F.lit("")) != "").select("page_id", "p.*"))


def embedded_products(pages: DataFrame) -> DataFrame:
    """State objects first, structured data for the pages without."""
    state = state_products(pages)
    ld = json_ld_products(pages.join(state.select("page_id"), "page_id", "left_anti"))
    return state.unionByName(ld.filter(F.col("title") != ""))


# --- rules -----------------------------------------------------------------------------------

def _first_hit(html: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(plain_text(F.regexp_extract(html, p, 1)), F.lit(""))
                        for p in patterns])


def rule_fields(pages: DataFrame, rules: dict = FIELD_RULES) -> DataFrame:
    """Fields by ordered rules: a retailer's own first, then the common ones."""
    return computed_once(pages, **dict(_rule_columns(rules))).select("page_id", *rules["*"])


def _rule_columns(rules: dict):
    for field, common in rules["*"].items():
        value = _first_hit(F.col("html"), common)
        for name, own in rules.items():
            if name != "*" and field in own:
                value = F.when(F.col("retailer") == name, F.coalesce(
                    _first_hit(F.col("html"), own[field]), value)).otherwise(value)
        yield field, value


def rule_products(pages: DataFrame, rules: dict = FIELD_RULES) -> DataFrame:
    """Products by rules, with images, in the shape of :func:`embedded_products`."""
    fields = computed_once(pages, **dict(_rule_columns(rules)), image_urls=image_list())
    return fields.select(
        "page_id", F.coalesce("title", F.lit("")).alias("title"),
        price_digits(F.col("price")).alias("price"), "description", "image_urls",
        quality.stock_status(F.col("stock_text"), F.lit(""), F.lit(True), F.lit(False))
        .alias("stock_status"), F.lit(None).cast("string").alias("brand"),
        F.lit(None).cast("string").alias("product_id"))


def _site(retailer: Column) -> Column:
    return F.concat(F.lit("https://www."), retailer, F.lit(".com"))


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf'(?i)\s{name}="([^"]*)"', 1), F.lit(""))


def page_images(pages: DataFrame, rules: tuple[str, ...] = ("product-image", "")) -> DataFrame:
    """Valid image urls per page: the first rule (text inside the tag) with any."""
    return pages.select("page_id", image_list(rules).alias("image_urls"))


def image_list(rules: tuple[str, ...] = ("product-image", "")) -> Column:
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1))
    site = _site(F.col("retailer"))

    def sources(rule):
        src = F.transform(F.filter(tags, lambda t: F.contains(t, F.lit(rule))),
                          lambda t: F.coalesce(*[_attribute(t, a) for a in (
                              "src", "data-src", "data-zoom-image", "data-large-image")]))
        good = F.filter(src, lambda u: u.isNotNull() & I.strategy_valid(u, F.col("retailer")))
        return F.array_distinct(F.transform(
            good, lambda u: F.coalesce(U.absolute_url(u, site), u)))

    tried = F.array(*[sources(r) for r in rules])
    return F.coalesce(F.get(F.filter(tried, lambda x: F.size(x) > 0), F.lit(0)),
                      F.array().cast("array<string>"))


def _with_href(text: str) -> Column:
    return F.filter("anchors", lambda a: F.contains(
        F.regexp_extract(a, r'(?i)href="([^"]*)"', 1), F.lit(text)))


def listing_links(pages: DataFrame, rules: dict = LINK_RULES, limit: int | None = None) -> DataFrame:
    """Product links of listing pages: the first rule with any; all of them, or the first ``limit`` of a page."""
    anchors = F.regexp_extract_all("html", F.lit(r'(?is)(<a\b[^>]*href="[^"]*"[^>]*>.*?</a>)'),
                                   F.lit(1))
    rows = computed_once(pages.select("page_id", "retailer", "html"), anchors=anchors)
    texts = list(dict.fromkeys(t for group in rules.values() for t in group))
    rows = computed_once(rows, hits=F.array(*[_with_href(t) for t in texts]))

    def picked(group):
        tried = [F.get("hits", F.lit(texts.index(t))) for t in group]
        return F.coalesce(*[F.when(F.size(x) > 0, x) for x in tried])

    chosen = picked(rules["*"])
    for name, group in rules.items():
        if name != "*":
            chosen = F.when(F.col("retailer") == name, picked(group)).otherwise(chosen)
    out = rows.select("page_id", "retailer", F.posexplode(chosen if limit is None else F.slice(chosen, 1, limit))
                      .alias("position", "a"))
    href = F.regexp_extract("a", r'(?i)href="([^"]*)"', 1)
    return (out.select("page_id", "position",
                       F.when(href.startswith("/"), F.concat(_site(F.col("retailer")), href))
                       .when(href.startswith("http"), href).alias("url"),
                       plain_text(F.col("a")).alias("title"))
            .filter(F.col("url").isNotNull()))


def listing_tiles(pages: DataFrame, rules: dict = TILE_RULES) -> DataFrame:
    """Listing tiles: url, title, price in the retailer's range, position; first per url."""
    parts = None
    for name, r in rules.items():
        cut = F.slice(F.split("html", r["marker"]), 2, 2**31 - 1)  # what stands before the first tile is left out
        parts = F.when(F.col("retailer") == name, cut) if parts is None else parts.when(
            F.col("retailer") == name, cut)
    rows = pages.select("page_id", "retailer", F.posexplode(parts).alias("position", "tile"))
    tile = F.col("tile")

    def by_retailer(make):
        out = None
        for name, r in rules.items():
            out = F.when(F.col("retailer") == name, make(r)) if out is None else out.when(
                F.col("retailer") == name, make(r))
        return out

    link = by_retailer(lambda r: F.nullif(F.regexp_extract(tile, r["link"], 1), F.lit("")))
    sources = [plain_text(F.regexp_extract(tile, by_class("[a-z0-9]+", r"[\w-]*heading"), 1)),
               F.trim(F.regexp_extract(tile, r'(?is)<img\b[^>]*alt="([^"]*)"', 1)),
               F.trim(F.regexp_extract(tile, r'(?is)<a\b[^>]*aria-label="([^"]*)"', 1))]
    title = F.coalesce(*[F.when(F.length(s) > 5, s) for s in sources])
    prices = F.transform(F.regexp_extract_all(tile, F.lit(r"\$\s*(\d+\.?\d*)"), F.lit(1)),
                         lambda p: F.rtrim(p, F.lit(".")).try_cast("double"))
    price = by_retailer(lambda r: F.get(F.filter(
        prices, lambda p: p.between(r["low"], r["high"])), F.lit(0)))
    found = rows.select("page_id", (F.col("position") + 1).alias("position"), F.coalesce(
        U.absolute_url(link, _site(F.col("retailer"))), link).alias("url"),
        title.alias("title"), price.alias("price")).filter(F.col("url").isNotNull())
    return (found.groupBy("page_id", "url")
            .agg(F.min(F.struct("position", "title", "price")).alias("m"))
            .select("page_id", "url", "m.*"))


def tile_coverage(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("tiles"), F.count("title").alias("with_titles"),
        F.count("price").alias("with_prices"))


def product_section(content: Column, links: int | None = None, at_least: int = 0) -> Column:
    """Heading, first price and image links of a long reply.

    All links, or the first ``links``; NULL where no more than ``at_least`` characters are left (0: never NULL).
    """
    title = F.regexp_extract(content, r"# (.*?)\n", 1)
    price = F.regexp_extract(content, r"(\$\d+\.\d+|\$\d+)", 1)
    found = F.regexp_extract_all(content, F.lit(r"(https?://lp2\.hm\.com/hmgoepprod\?[^\s\)]+)"), F.lit(1))
    found = found if links is None else F.slice(found, 1, links)
    section = F.concat(
        F.lit("# "), title, F.lit("\n\n"),
        F.when(price != "", F.concat(F.lit("Price: "), price, F.lit("\n\n"))).otherwise(""),
        F.when(F.size(found) > 0, F.concat(F.lit("Images:\n"), F.array_join(found, "\n"),
                                           F.lit("\n\n"))).otherwise(""))
    return F.when(F.length(section) > at_least, section)


# --- fallbacks ---------------------------------------------------------------------------------

def products_with_fallback(pages: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Product per page by the first strategy that gives a valid one.

    Embedded data, then rules (used for pages without an embedded title), then
    supplied reply rows for the pages that are still invalid. Adds ``method``
    and ``valid``; pages nothing could read stay as invalid rows.
    """
    embedded = embedded_products(pages).withColumn("method", F.lit("embedded"))
    rest = pages.join(embedded.select("page_id"), "page_id", "left_anti")
    first = embedded.unionByName(rule_products(rest).withColumn("method", F.lit("rules")))
    first = first.withColumn("valid", F.size(quality.errors_strict()) == 0)
    if replies is None:
        return first
    given = replies.withColumn("method", F.lit("reply"))
    given = given.withColumn("valid", F.size(quality.errors_strict()) == 0)
    r = given.select("page_id", F.struct(*[c for c in first.columns if c != "page_id"]).alias("r"))
    use = ~F.col("valid") & F.coalesce(F.col("r.valid"), F.lit(False))
    return first.join(r, "page_id", "left").select("page_id", *[
        F.when(use, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
        for c in first.columns if c != "page_id"])


def listings_with_fallback(pages: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Listing rows per page: links by rules where the page passes, else reply rows."""
    links = listing_links(pages).withColumn("method", F.lit("rules"))
    passed = quality.catalog_validation(links, "page_id").filter("valid").select("page_id")
    good = links.join(passed, "page_id", "left_semi")
    if replies is None:
        return good
    rest = replies.join(passed, "page_id", "left_anti").select(
        "page_id", "position", "url", "title").withColumn("method", F.lit("reply"))
    return good.unionByName(rest)
