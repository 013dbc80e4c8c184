"""Matching of listings against known products, one level at a time and as cascades.

A cascade is a chain of joins with key tables that hold one row per key, so
no level multiplies rows; key tables are shuffled and never broadcast, as the
size of a product's keys is not that of its compressed file. Rows are written to the shared folder
where the cascade parts: linked rows leave it there, only the others go on, and no level is derived anew for the next one.
Levels that look the same key up share one table and one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import urls as U
from shelfwatch.functions.text import title_key
from shelfwatch.operators import fuzzy
from shelfwatch.operators.keyed import (
    first_of, shuffled, smallest_of_levels, smallest_per_key, spread_for_compute, spread_nulls)
from shelfwatch.session import staged

# Confidence of each level when linking and when classifying.
LINK_CONFIDENCE = {"exact_url": 1.0, "normalized_url": 0.95, "product_code": 0.90,
                   "exact_title_price": 0.95}
CLASS_CONFIDENCE = {"exact_url": 1.0, "normalized_url": 0.95, "product_code": 0.95,
                    "title_price": 1.0, "image_url": 0.90}

LONG_GRAM, SHORT_GRAM = 8, 4


def _truthy_price(price: Column) -> Column:
    return price.isNotNull() & (price != 0)


def unify_fields(listings: DataFrame) -> DataFrame:
    """One url column and one image column, whichever names the rows came with.

    An empty text or an empty image array counts as absent.
    """
    have = set(listings.columns)

    def pick(names, target):
        found = []
        for n in names:
            if n in have:
                c = F.col(n)
                if listings.schema[n].dataType.typeName() == "array":
                    found.append(F.when(F.size(c) > 0, c))
                else:
                    found.append(F.nullif(c, F.lit("")))
        return F.coalesce(*found).alias(target) if found else None

    url = pick(["url", "catalog_url"], "catalog_url")
    images = pick(["image_urls", "images"], "image_urls")
    rest = [c for c in listings.columns if c not in ("url", "catalog_url", "image_urls", "images")]
    return listings.select(*rest, *[c for c in (url, images) if c is not None])


# --- single levels -----------------------------------------------------------------

def match_exact_url(listings: DataFrame, products: DataFrame, url: str = "catalog_url") -> DataFrame:
    known = smallest_per_key(products, {"retailer": F.col("retailer"), "_k": F.col("url")},
                             "url", "linked_product_url")
    return (listings.withColumn("_k", F.col(url)).join(known, ["retailer", "_k"], "left").drop("_k")
            .withColumn("link_confidence",
                        F.when(F.col("linked_product_url").isNotNull(), F.lit(1.0))))


def match_normalized_url(listings: DataFrame, products: DataFrame,
                         url: str = "catalog_url") -> DataFrame:
    known = smallest_per_key(
        products, {"retailer": F.col("retailer"), "_k": U.url_key_v1(F.col("url"))},
        "url", "linked_product_url")
    return (listings.withColumn("_k", U.url_key_v1(F.col(url)))
            .join(known, ["retailer", "_k"], "left").drop("_k")
            .withColumn("link_confidence",
                        F.when(F.col("linked_product_url").isNotNull(), F.lit(0.95))))


def match_product_code(listings: DataFrame, products: DataFrame,
                       confidence: float = LINK_CONFIDENCE["product_code"]) -> DataFrame:
    known = smallest_per_key(
        products, {"retailer": F.col("retailer"), "_k": F.nullif(F.col("product_code"), F.lit(""))},
        "url", "linked_product_url")
    return (listings.withColumn("_k", spread_nulls(F.nullif(F.col("product_code"), F.lit("")),
                                                   F.col("catalog_url")))
            .join(known, ["retailer", "_k"], "left").drop("_k")
            .withColumn("link_confidence",
                        F.when(F.col("linked_product_url").isNotNull(), F.lit(confidence))))


def _substrings(text: Column, width: int) -> Column:
    return F.when(F.length(text) >= width, F.transform(
        F.sequence(F.lit(1), F.length(text) - F.lit(width - 1)),
        lambda i: F.substring(text, i, F.lit(width)))).otherwise(
        F.array().cast("array<string>"))


def codes_in_urls(codes: DataFrame, products: DataFrame) -> DataFrame:
    """Smallest product url per (retailer, code) whose url contains the code.

    Equi-joins only: a code of eight characters or more is looked up by one of
    its pieces of eight, a shorter one by one of four, and the hit is then checked
    whole. Urls are counted by piece first (combined before the shuffle), a code
    takes the piece that the fewest urls have, and one of whose pieces no url has
    is not looked up at all; so a piece that all urls share pairs nothing. Codes of
    up to three characters meet a table of all substrings of their own length,
    already reduced to one row each.
    """
    codes = codes.select("retailer", "code").filter(F.col("code") != "").distinct()
    size = F.length("code")
    url_rows = spread_for_compute(products.select("retailer", "url"), "url")

    own = F.when(size >= LONG_GRAM, _substrings(F.col("code"), LONG_GRAM)).when(size >= SHORT_GRAM, _substrings(F.col("code"), SHORT_GRAM))
    asked = codes.withColumn("_own", F.array_distinct(own)).filter(F.col("_own").isNotNull())
    asked = asked.select("retailer", "code", F.size("_own").alias("_asked"), F.explode("_own").alias("_g"))
    grams = url_rows.withColumn("_g", F.explode(F.concat(
        _substrings(F.col("url"), LONG_GRAM), _substrings(F.col("url"), SHORT_GRAM))))
    counts = grams.join(shuffled(asked.select("retailer", "_g").distinct()), ["retailer", "_g"], "left_semi").groupBy("retailer", "_g").agg(F.count(F.lit(1)).alias("_urls"))
    rarest = (asked.join(shuffled(counts), ["retailer", "_g"]).groupBy("retailer", "code", "_asked")
              .agg(F.min(F.struct("_urls", "_g")).alias("m"), F.count(F.lit(1)).alias("_there"))
              .filter(F.col("_there") == F.col("_asked")).select("retailer", "code", F.col("m._g").alias("_g")))
    long_hits = (staged(rarest, "code-pieces").join(shuffled(grams), ["retailer", "_g"])
                 .filter(F.contains("url", "code"))
                 .groupBy("retailer", "code").agg(F.min("url").alias("url")))

    tiny = url_rows.withColumn("code", F.explode(F.concat(
        *[_substrings(F.col("url"), w) for w in range(1, SHORT_GRAM)]))) \
        .groupBy("retailer", "code").agg(F.min("url").alias("url"))
    tiny_hits = codes.filter(size < SHORT_GRAM).join(shuffled(tiny), ["retailer", "code"])
    return long_hits.unionByName(tiny_hits)


def match_code_or_url(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Code equality first, else the smallest url that contains the code."""
    equal = match_product_code(listings, products, CLASS_CONFIDENCE["product_code"]) \
        .withColumnRenamed("linked_product_url", "_eq").drop("link_confidence")
    codes = equal.filter(F.col("_eq").isNull()).select(
        "retailer", F.col("product_code").alias("code"))
    inside = codes_in_urls(codes, products).withColumnRenamed("url", "_in")
    return (equal.withColumn("code", spread_nulls(F.col("product_code"), F.col("catalog_url")))
            .join(shuffled(inside), ["retailer", "code"], "left").drop("code")
            .withColumn("linked_product_url", F.coalesce("_eq", "_in")).drop("_eq", "_in")
            .withColumn("link_confidence", F.when(F.col("linked_product_url").isNotNull(),
                                                  F.lit(CLASS_CONFIDENCE["product_code"]))))


def match_title_price(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Title (lower case, trimmed) and price both equal."""
    known = smallest_per_key(
        products.filter(_truthy_price(F.col("price"))),
        {"retailer": F.col("retailer"), "_t": title_key(F.col("title")), "_p": F.col("price")},
        "url", "linked_product_url")
    return (listings
            .withColumn("_t", spread_nulls(F.nullif(title_key(F.col("title")), F.lit("")),
                                           F.col("catalog_url")))
            .withColumn("_p", F.col("price"))
            .join(known, ["retailer", "_t", "_p"], "left").drop("_t", "_p")
            .withColumn("link_confidence", F.when(F.col("linked_product_url").isNotNull(),
                                                  F.lit(CLASS_CONFIDENCE["title_price"]))))


def title_price_within(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Exact title, price within a dollar: smallest url per (retailer, title, price) value."""
    band = fuzzy.AbsoluteBand(1.0)
    left = (listings.select("retailer", "title", F.col("price").alias("lp"))
            .filter((F.col("title") != "") & _truthy_price(F.col("lp"))).distinct()
            .withColumn("bucket", fuzzy._near_buckets(band, F.col("lp"))))
    right = (products.filter(F.col("price").isNotNull())
             .groupBy("retailer", "title", F.col("price").alias("rp"))
             .agg(F.min("url").alias("url")).withColumn("bucket", band.bucket(F.col("rp"))))
    return (left.join(shuffled(right), ["retailer", "title", "bucket"])
            .filter(band.holds(F.col("lp"), F.col("rp")))
            .groupBy("retailer", "title", "lp").agg(F.min("url").alias("url")))


def match_title_near_price(listings: DataFrame, products: DataFrame) -> DataFrame:
    hits = title_price_within(listings, products).select(
        "retailer", F.col("title").alias("_t"), F.col("lp").alias("_p"),
        F.col("url").alias("linked_product_url"))
    return (listings.withColumn("_t", spread_nulls(F.col("title"), F.col("catalog_url")))
            .withColumn("_p", F.col("price"))
            .join(shuffled(hits), ["retailer", "_t", "_p"], "left").drop("_t", "_p")
            .withColumn("link_confidence", F.when(
                F.col("linked_product_url").isNotNull(),
                F.lit(LINK_CONFIDENCE["exact_title_price"]))))


def match_first_image(listings: DataFrame, products: DataFrame) -> DataFrame:
    """First listing image equal to any stored image of the retailer."""
    known = smallest_per_key(
        products.select("retailer", "url", F.explode("image_urls").alias("_i")),
        {"retailer": F.col("retailer"), "_i": F.col("_i")}, "url", "linked_product_url")
    return (listings.withColumn("_i", spread_nulls(F.get("image_urls", F.lit(0)),
                                                   F.col("catalog_url")))
            .join(known, ["retailer", "_i"], "left").drop("_i")
            .withColumn("link_confidence", F.when(F.col("linked_product_url").isNotNull(),
                                                  F.lit(CLASS_CONFIDENCE["image_url"]))))


def _image_set(images: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(images, lambda x: x.isNotNull())))


def _shared_images(left_sets: DataFrame, right_sets: DataFrame) -> DataFrame:
    """Pairs of image sets that share at least half of the left set, and two images.

    A left set of n images that must share k of them shares one of its n-k+1
    rarest. Only those are joined on, so an image a third of all products carry
    (a size chart) pairs nothing unless the sets agree on rarer images too.
    Sets that share a single image are found without pairs, see the caller.
    """
    spread = right_sets.select("retailer", F.explode("rimgs").alias("i")) \
        .groupBy("retailer", "i").agg(F.count(F.lit(1)).alias("f"))
    n = F.size("imgs")
    need = F.greatest(F.ceil(n / 2).cast("int"), F.lit(2))
    ranked = (left_sets.filter(n >= 2).select("retailer", "imgs", F.explode("imgs").alias("i"))
              .join(shuffled(spread), ["retailer", "i"])
              .groupBy("retailer", "imgs")
              .agg(F.array_sort(F.collect_list(F.struct("f", "i"))).alias("known")))
    # Images no product has cannot be shared, so they count as the rarest ones.
    width = n - need + 1 - (n - F.size("known"))
    rare = ranked.filter(width > 0).select("retailer", "imgs", F.explode(
        F.slice("known", F.lit(1), width)).alias("k"))
    return (rare.select("retailer", "imgs", F.col("k.i").alias("i"))
            .join(shuffled(right_sets.select("retailer", "rimgs", F.explode("rimgs").alias("i"))),
                  ["retailer", "i"])
            .select("retailer", "imgs", "rimgs").distinct()
            .withColumn("shared", F.size(F.array_intersect("imgs", "rimgs")))
            .filter(F.col("shared") >= need)
            .select("retailer", "imgs", "rimgs", (F.col("shared") / n).alias("overlap")))


def image_overlap_values(listings: DataFrame, products: DataFrame,
                         patterns: DataFrame | None = None) -> DataFrame:
    """Best image-set overlap per distinct (retailer, price, image set).

    Prices within ten dollars, at least half of the listing's images shared,
    the smallest url on ties. Both sides are reduced to distinct (image set,
    price) values first. Sharing one image is only enough for sets of one or
    two; there the smallest url per (image, price) decides, and no sets are
    paired.
    """
    band = fuzzy.AbsoluteBand(10.0)
    left = staged(listings.select("retailer", F.coalesce("price", F.lit(0.0)).alias("lp"),
                                  _image_set(F.col("image_urls")).alias("imgs"))
                  .filter(F.size("imgs") > 0).distinct(), "listing-images")
    right = staged(products.select("retailer", F.col("price").alias("rp"), "url",
                                   _image_set(F.col("image_urls")).alias("rimgs"))
                   .filter((F.size("rimgs") > 0) & F.col("rp").isNotNull())
                   .groupBy("retailer", "rp", "rimgs").agg(F.min("url").alias("url")),
                   "product-images")
    # The smaller side is multiplied: a product lies in each bucket from which a listing can meet it.
    near = right.withColumn("bucket", fuzzy._near_buckets(band, F.col("rp")))
    left = left.withColumn("bucket", band.bucket(F.col("lp")))
    in_band = band.holds(F.col("lp"), F.col("rp"))
    key = ["retailer", "lp", "imgs"]

    pairs = _shared_images(left.select("retailer", "imgs").distinct(),
                           right.select("retailer", "rimgs").distinct())
    several = (left.join(shuffled(pairs), ["retailer", "imgs"])
               .join(shuffled(near), ["retailer", "rimgs", "bucket"]).filter(in_band)
               .select(*key, "overlap", "url"))
    per_image = (right.select("retailer", "rp", "url", F.explode("rimgs").alias("i"))
                 .groupBy("retailer", "rp", "i").agg(F.min("url").alias("url"))
                 .withColumn("bucket", fuzzy._near_buckets(band, F.col("rp"))))
    single = (left.filter(F.size("imgs") <= 2)
              .select("*", F.explode("imgs").alias("i"))
              .join(shuffled(per_image), ["retailer", "bucket", "i"]).filter(in_band)
              .select(*key, (F.lit(1.0) / F.size("imgs")).alias("overlap"), "url"))
    best = (several.unionByName(single).groupBy(*key)
            .agg(F.min(F.struct((-F.col("overlap")).alias("n"), "url")).alias("m"))
            .select(*key, F.col("m.url").alias("url"), (-F.col("m.n")).alias("overlap")))
    if patterns is None:
        steady = F.lit(False)
    else:
        best = best.join(patterns.select("retailer", "image_urls_consistent"), "retailer", "left")
        steady = F.coalesce(F.col("image_urls_consistent").cast("boolean"), F.lit(False))
    return best.select(*key, "url", "overlap", F.when(
        steady, F.lit(0.75) + F.col("overlap") * 0.20).otherwise(
        F.lit(0.65) + F.col("overlap") * 0.15).alias("confidence"))


def match_image_overlap(listings: DataFrame, products: DataFrame,
                        patterns: DataFrame | None = None) -> DataFrame:
    best = image_overlap_values(listings, products, patterns).select(
        "retailer", F.col("lp").alias("_p"), F.concat_ws("\u0001", "imgs").alias("_s"),
        F.col("url").alias("linked_product_url"), F.col("confidence").alias("link_confidence"))
    own = F.concat_ws("\u0001", _image_set(F.col("image_urls")))
    return (listings.withColumn("_p", F.coalesce(F.col("price"), F.lit(0.0)))
            .withColumn("_s", spread_nulls(F.nullif(own, F.lit("")), F.col("catalog_url")))
            .join(shuffled(best), ["retailer", "_p", "_s"], "left").drop("_p", "_s"))


# --- cascades -------------------------------------------------------------------------

def _policies(patterns: DataFrame | None) -> DataFrame | None:
    """The fields of ``patterns`` that cascades read: learned from a whole history, they are worked out once."""
    if patterns is None:
        return None
    read = ["retailer", "url_stability_score", "best_dedup_method", "image_urls_consistent"]
    return staged(patterns.select(*[c for c in read if c in patterns.columns]), "retailer-policies")


def _with_policy(listings: DataFrame, patterns: DataFrame | None) -> DataFrame:
    """Adds ``_fuzzy_only``: the retailer's urls are too unstable for key levels."""
    if patterns is None:
        return listings.withColumn("_fuzzy_only", F.lit(False))
    policy = patterns.select("retailer", F.coalesce(
        (F.col("url_stability_score") < 0.50)
        | (F.col("best_dedup_method") == "fuzzy_title_price"), F.lit(False)).alias("_fuzzy_only"))
    return (listings.join(policy, "retailer", "left")
            .withColumn("_fuzzy_only", F.coalesce("_fuzzy_only", F.lit(False))))


def _add_hit(listings: DataFrame, known: DataFrame, keys: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Left join on a one-row-per-key table by ``by`` (the retailer) and ``keys``, adding its other columns."""
    keyed = listings.select("*", *[key.alias(name) for name, key in keys.items()])
    return keyed.join(shuffled(known), [*(["retailer"] if by is None else by), *keys], "left").drop(*keys)


def _links(rows: DataFrame, columns: list[str], url: Column, confidence: Column, method: Column) -> DataFrame:
    """``columns`` of rows with their link; without a url there is neither confidence nor method."""
    found = url.isNotNull()
    return rows.select(*columns, url.alias("linked_product_url"), F.when(found, confidence).alias("link_confidence"),
                       F.when(found, method).alias("link_method"))


def _key_levels(listings: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links by exact url, normalized url and code; rows without a link by url; those of them without a link by code.

    Equal urls are equal when normalized, so one join serves both url levels. Its table has the first and last url of
    a normalized one: a listing's url that is one of them is known, one that lies outside is not, and only one that
    lies between them is looked up itself.
    """
    columns, gate, by = listings.columns, ~F.col("_fuzzy_only"), F.col("catalog_url")
    columns = [c for c in columns if c != "_fuzzy_only"]
    normalized = products.select("retailer", U.url_key_v1(F.col("url")).alias("_k"), "url").filter(
        F.col("retailer").isNotNull() & F.col("_k").isNotNull())
    known = normalized.groupBy("retailer", "_k").agg(F.min("url").alias("_norm"), F.max("url").alias("_last"))
    rows = staged(_add_hit(listings, known, {"_k": spread_nulls(F.when(gate, U.url_key_v1(by)), by)}), "url-links")
    between = F.coalesce((by > F.col("_norm")) & (by < F.col("_last")), F.lit(False))
    at_end = F.coalesce((by == F.col("_norm")) | (by == F.col("_last")), F.lit(False))

    def by_url(some: DataFrame, exact: Column) -> DataFrame:
        return _links(some, columns, F.when(exact, by).otherwise(F.col("_norm")), F.when(exact, 1.0).otherwise(0.95),
                      F.when(exact, "exact_url").otherwise("normalized_url"))

    exact = smallest_per_key(products, {"retailer": F.col("retailer"), "_k": F.col("url")}, "url", "_exact")
    linked = by_url(rows.filter(F.col("_norm").isNotNull() & ~between), at_end).unionByName(
        by_url(_add_hit(rows.filter(between), exact, {"_k": by}), F.col("_exact").isNotNull()))

    unknown = rows.filter(F.col("_norm").isNull()).drop("_norm", "_last")
    code = F.when(gate, F.nullif(F.col("product_code"), F.lit("")))
    codes = smallest_per_key(
        products, {"retailer": F.col("retailer"), "_k": F.nullif(F.col("product_code"), F.lit(""))}, "url", "_code")
    coded = _add_hit(unknown.filter(code.isNotNull()), codes, {"_k": code})
    linked = linked.unionByName(_links(
        coded.filter(F.col("_code").isNotNull()), columns, F.col("_code"), F.lit(0.90), F.lit("product_code")))
    rest = coded.filter(F.col("_code").isNull()).select(*columns).unionByName(unknown.filter(code.isNull()).select(*columns))
    return linked, unknown, rest


def _add_fuzzy(rows: DataFrame, products: DataFrame) -> DataFrame:
    """``rows`` with ``_fuzzy`` and ``_fconf``; those without a title or price are not looked up. Reads ``rows`` several times."""
    links = fuzzy.fuzzy_links(rows, products).select(
        "retailer", F.col("lt").alias("_t"), F.col("lp").alias("_p"),
        F.col("linked_product_url").alias("_fuzzy"), F.col("link_confidence").alias("_fconf"))
    title, price = title_key(F.col("title")), F.col("price").cast("double")
    asked = F.coalesce((title != "") & (price > 0), F.lit(False))
    return _add_hit(rows.filter(asked), links, {"_t": title, "_p": price}).unionByName(rows.filter(~asked), allowMissingColumns=True)


def _add_image(rows: DataFrame, products: DataFrame, patterns: DataFrame | None) -> DataFrame:
    """``rows`` with ``_img`` and ``_iconf``; those without images are not looked up. Reads ``rows`` several times."""
    best = image_overlap_values(rows, products, patterns).select(
        "retailer", F.col("lp").alias("_p"), F.concat_ws("\u0001", "imgs").alias("_s"),
        F.col("url").alias("_img"), F.col("confidence").alias("_iconf"))
    own = F.concat_ws("\u0001", _image_set(F.col("image_urls")))
    asked = own != ""
    return _add_hit(rows.filter(asked), best, {"_p": F.coalesce(F.col("price"), F.lit(0.0)), "_s": own}) \
        .unionByName(rows.filter(~asked), allowMissingColumns=True)


def link_listings(listings: DataFrame, products: DataFrame, patterns: DataFrame | None = None,
                  images: bool = True) -> DataFrame:
    """Linking cascade: exact, normalized, code, fuzzy title and price, image overlap.

    First hit wins; the key levels are skipped for retailers whose policy says
    so. Adds ``linked_product_url``, ``link_confidence`` and ``link_method``.
    Listings are written to the shared folder with all their columns, so those nobody reads are better left out before.
    """
    columns, patterns = listings.columns, _policies(patterns)
    linked, _, rest = _key_levels(_with_policy(listings, patterns), products)
    rows = _add_fuzzy(staged(rest, "unlinked"), products)
    fuzzy_link = (F.col("_fuzzy"), F.col("_fconf"), F.lit("fuzzy_title_price"))
    if not (images and "image_urls" in columns):
        return linked.unionByName(_links(rows, columns, *fuzzy_link))
    rows = staged(rows, "fuzzy-links")
    linked = linked.unionByName(_links(rows.filter(F.col("_fuzzy").isNotNull()), columns, *fuzzy_link))
    rows = _add_image(rows.filter(F.col("_fuzzy").isNull()).select(*columns), products, patterns)
    return linked.unionByName(_links(rows, columns, F.col("_img"), F.col("_iconf"), F.lit("image_url_match")))


def backfill_links(snapshots: DataFrame, products: DataFrame, patterns: DataFrame | None = None,
                   min_confidence: float = 0.85, fuzzy_level: bool = True) -> DataFrame:
    """History form of the cascade: unlinked rows only, a title-and-near-price
    level before fuzzy, no image level, links under ``min_confidence`` dropped."""
    old = [c for c in ("linked_product_url", "link_confidence", "link_method")
           if c in snapshots.columns]
    todo = snapshots
    if "linked_product_url" in old:
        todo = todo.filter(F.col("linked_product_url").isNull())
    todo = todo.drop(*old)
    columns = todo.columns
    linked, unknown, rest = _key_levels(_with_policy(todo, _policies(patterns)), products)
    # The titles of rows that a code may link, too: they are read from the shared folder, those of the rest take a join more.
    near = title_price_within(unknown, products).select(
        "retailer", F.col("title").alias("_t"), F.col("lp").alias("_p"),
        F.col("url").alias("_title"))
    rows = _add_hit(rest, near, {
        "_t": spread_nulls(F.col("title"), F.col("catalog_url")), "_p": F.col("price")})
    title_link = (F.col("_title"), F.lit(0.95), F.lit("exact_title_price"))
    if fuzzy_level:
        rows = staged(rows, "title-links")
        linked = linked.unionByName(_links(rows.filter(F.col("_title").isNotNull()), columns, *title_link))
        rows = _add_fuzzy(rows.filter(F.col("_title").isNull()).select(*columns), products)
        out = linked.unionByName(_links(rows, columns, F.col("_fuzzy"), F.col("_fconf"), F.lit("fuzzy_title_price")))
    else:
        out = linked.unionByName(_links(rows, columns, *title_link))
    good = F.col("link_confidence") >= min_confidence
    return out.select(*columns, *[F.when(good, F.col(c)).alias(c) for c in (
        "linked_product_url", "link_confidence", "link_method")])


def _url_level(listings: DataFrame, products: DataFrame, history: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows whose url products have (``_exact``, of any retailer) or the retailer's history (``_seen``), and the others.

    One join by url serves both. Its table has the first and last retailer of a url in the history; only a row whose
    retailer lies between them is looked up by retailer and url.
    """
    by, retailer = F.col("catalog_url"), F.col("retailer")
    urls = products.select(F.col("url").alias("_k"), F.lit(True).alias("_own"), F.lit(None).cast(listings.schema["retailer"].dataType).alias("_r"))
    if history is not None:
        urls = urls.unionByName(history.filter(by.isNotNull() & retailer.isNotNull()).select(
            by.alias("_k"), F.lit(False).alias("_own"), retailer.alias("_r")))
    known = urls.groupBy("_k").agg(F.max("_own").alias("_own"), F.min("_r").alias("_first"), F.max("_r").alias("_last"))
    rows = staged(_add_hit(listings, known, {"_k": spread_nulls(by, F.col("title"))}, by=[]), "seen-urls")
    own = F.coalesce("_own", F.lit(False))
    at_end = F.coalesce((retailer == F.col("_first")) | (retailer == F.col("_last")), F.lit(False))
    between = F.coalesce(~own & (retailer > F.col("_first")) & (retailer < F.col("_last")), F.lit(False))
    exact, seen = F.when(own, by).alias("_exact"), F.when(at_end & ~own, by).alias("_seen")
    sure = rows.filter(~between).select(*listings.columns, exact, seen)
    if history is None:
        found = sure
    else:
        pairs = smallest_per_key(history, {"retailer": retailer, "_k": by}, "catalog_url", "_seen")
        found = sure.unionByName(staged(_add_hit(rows.filter(between).select(*listings.columns, exact), pairs, {"_k": by}), "seen-between"))
    known_url = F.coalesce("_exact", "_seen").isNotNull()
    return found.filter(known_url), found.filter(~known_url).select(*listings.columns)


def classify_listings(listings: DataFrame, products: DataFrame, history: DataFrame | None = None,
                      use_fuzzy: bool = True) -> DataFrame:
    """Status per listing: confirmed_existing, suspected_duplicate or confirmed_new.

    Key levels look in the products first, then in the snapshot ``history``.
    Adds ``status``, ``match_method``, ``confidence`` and ``matched_url``.
    The exact level ignores the retailer for products. Listings are written to the shared folder with all their columns.
    """
    by = F.col("catalog_url")
    retailer = {"retailer": F.col("retailer")}
    code = F.coalesce(F.nullif(F.col("product_code"), F.lit("")),
                      U.product_code(by, F.col("retailer"), "monitor"))
    if history is not None:
        read = ["retailer", "catalog_url", "title", "price", "product_code"]
        history = staged(history.select(*[c for c in read if c in history.columns]), "history")
    found, chain = _url_level(listings.withColumn("_c", code), products, history)
    # Codes no product has as its own; a lookup table, so it needs no join chain.
    eq = smallest_per_key(
        products, {**retailer, "_k": F.nullif(F.col("product_code"), F.lit(""))}, "url", "_code")
    open_codes = (chain.select("retailer", F.col("_c").alias("code")).filter(F.col("code").isNotNull())
                  .distinct().join(shuffled(eq.select("retailer", F.col("_k").alias("code"))),
                                   ["retailer", "code"], "left_anti"))
    # Taking all urls apart is the dear step and the result is small: once, to the shared folder.
    inside = staged(codes_in_urls(open_codes, products), "codes-in-urls")

    norm = smallest_per_key(products, {**retailer, "_k": U.url_key_v1(F.col("url"))}, "url", "_norm")
    chain = staged(_add_hit(chain, norm, {
        "_k": spread_nulls(U.url_key_v1(U.url_key_v2(by)), F.col("title"))}), "normalized-urls")
    found = found.unionByName(chain.filter(F.col("_norm").isNotNull()), allowMissingColumns=True)
    chain = chain.filter(F.col("_norm").isNull()).drop("_norm")
    own_code = {**retailer, "_k": F.nullif(F.col("product_code"), F.lit(""))}
    by_code = {"_code": (products, own_code, "url"), "_inside": (inside, {**retailer, "_k": F.col("code")}, "url")}
    title = title_key(F.col("title"))
    own_tp = {**retailer, "_t": title, "_p": F.col("price")}
    by_tp = {"_tp": (products.filter(_truthy_price(F.col("price"))), own_tp, "url")}
    if history is not None:
        if "product_code" in history.columns:
            by_code["_seencode"] = (history, own_code, "catalog_url")
        by_tp["_seentp"] = (history.filter(_truthy_price(F.col("price"))), own_tp, "catalog_url")
    coded = F.col("_c").isNotNull()
    chain = _add_hit(chain.filter(coded), smallest_of_levels(by_code), {"_k": F.col("_c")}).unionByName(
        chain.filter(~coded), allowMissingColumns=True)
    tp_key = {"_t": spread_nulls(F.nullif(title, F.lit("")), by), "_p": F.col("price")}
    chain = _add_hit(chain, smallest_of_levels(by_tp), tp_key)
    known = [*by_code, *by_tp]
    method_of = {"_exact": "exact_url", "_seen": "exact_url", "_norm": "normalized_url",
                 "_code": "product_code", "_inside": "product_code", "_seencode": "product_code", "_tp": "title_price",
                 "_seentp": "title_price"}
    outcome = [(h, "confirmed_existing", method_of[h], F.lit(CLASS_CONFIDENCE[method_of[h]]))
               for h in ["_exact", "_seen", "_norm", *known]]
    images = "image_urls" in listings.columns and "image_urls" in products.columns
    if use_fuzzy or images:
        chain = staged(chain, "known-listings")
        is_known = F.coalesce(*known).isNotNull()
        found = found.unionByName(chain.filter(is_known), allowMissingColumns=True)
        chain = chain.filter(~is_known).drop(*known)
    if use_fuzzy:
        stage = F.col("lifecycle_stage")
        eligible = products
        if "lifecycle_stage" in products.columns:
            eligible = products.filter(stage.isNull() | ~(
                stage.rlike("(?i)not.modest") | stage.rlike("(?i)no.longer.available")))
        suspects = fuzzy.fuzzy_suspects(chain, eligible).select(
            "retailer", F.col("lt").alias("_t"), F.col("lp").alias("_p"),
            F.col("url").alias("_fuzzy"), F.col("ratio").alias("_ratio"))
        chain = _add_hit(chain, suspects, tp_key)
        outcome.append(("_fuzzy", "suspected_duplicate", "fuzzy_title", F.col("_ratio")))
    if images:
        stored = smallest_per_key(
            products.select("retailer", "url", F.explode("image_urls").alias("_i")),
            {**retailer, "_i": F.col("_i")}, "url", "_img")
        chain = _add_hit(chain, stored, {
            "_i": spread_nulls(F.get("image_urls", F.lit(0)), by)})
        outcome.append(("_img", "suspected_duplicate", "image_url",
                        F.lit(CLASS_CONFIDENCE["image_url"])))
    every = found.unionByName(chain, allowMissingColumns=True)
    hit = [F.col(h).isNotNull() for h, _, _, _ in outcome]
    return every.select(
        *listings.columns,
        F.coalesce(first_of(*[(t, F.lit(o[1])) for t, o in zip(hit, outcome)]),
                   F.lit("confirmed_new")).alias("status"),
        F.coalesce(first_of(*[(t, F.lit(o[2])) for t, o in zip(hit, outcome)]),
                   F.lit("none")).alias("match_method"),
        F.coalesce(first_of(*[(t, o[3]) for t, o in zip(hit, outcome)]),
                   F.lit(0.0)).alias("confidence"),
        F.coalesce(*[F.col(o[0]) for o in outcome]).alias("matched_url"))


# --- price changes and anti joins -------------------------------------------------------

def price_changes(listings: DataFrame, products: DataFrame, as_of: Column) -> DataFrame:
    """Update work items for listings whose price differs from the known product.

    Match on the exact url, else the normalized one; both prices must be
    present and not zero, and differ by a cent or more.
    """
    known = products.groupBy("retailer", U.url_key_v1(F.col("url")).alias("_n")).agg(
        F.min(F.struct("url", "price")).alias("_nm"))
    exact = products.groupBy("retailer", F.col("url").alias("_k")).agg(
        F.min(F.struct("url", "price")).alias("_em"))
    rows = (listings.filter(F.col("catalog_url").isNotNull() & (F.col("catalog_url") != "")
                            & _truthy_price(F.col("price")))
            .withColumn("_k", F.col("catalog_url"))
            .withColumn("_n", U.url_key_v1(F.col("catalog_url")))
            .join(shuffled(exact), ["retailer", "_k"], "left").join(shuffled(known), ["retailer", "_n"], "left")
            .withColumn("_m", F.coalesce("_em", "_nm")))
    difference = F.col("price") - F.col("_m.price")
    return (rows.filter(_truthy_price(F.col("_m.price")) & (F.abs(difference) >= 0.01))
            .select(*[c for c in listings.columns if c not in ("price", "retailer")],
                    F.col("_m.url").alias("product_url"), "retailer",
                    F.when(F.abs(difference) > 50, "high").otherwise("normal").alias("priority"),
                    F.lit("price_change_detected_in_catalog").alias("reason"),
                    F.col("price").alias("catalog_price"),
                    F.col("_m.price").alias("products_price"),
                    difference.alias("price_difference"),
                    as_of.alias("detected_at")))


def remaining_urls(all_urls: DataFrame, processed: DataFrame, url: str = "url") -> DataFrame:
    """Rows of a batch not yet processed; order columns and duplicates stay."""
    return all_urls.join(shuffled(processed.select(url).distinct()), url, "left_anti")


def disappeared_since(snapshots: DataFrame, latest: Column, previous: Column) -> DataFrame:
    """Listings of the previous run date that the latest run no longer has."""
    before = snapshots.filter(F.col("discovered_date") == previous) \
        .select("retailer", "catalog_url").distinct()
    now = snapshots.filter(F.col("discovered_date") == latest).select("retailer", "catalog_url")
    return before.join(now, ["retailer", "catalog_url"], "left_anti")


def with_remainder(matched: DataFrame, remainder: DataFrame) -> DataFrame:
    """Matched rows together with the rows no match was found for; the latter lack the link columns."""
    return matched.unionByName(remainder, allowMissingColumns=True)
