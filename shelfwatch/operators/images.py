"""Image lists of products: filter, upgrade, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import images as I
from shelfwatch.operators.learning import placeholder_patterns


def exclusion_patterns(learned: DataFrame, retailers: DataFrame) -> DataFrame:
    """Static patterns for every retailer together with its learned ones, distinct."""
    static = retailers.select("retailer").distinct().withColumn(
        "pattern", F.explode(F.array(*[F.lit(p) for p in I.STATIC_EXCLUSIONS])))
    top = placeholder_patterns(learned).select("retailer", "pattern")
    return static.unionByName(top).distinct()


def filter_images(products: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """Keep valid image urls, by the static rules and the retailer's learned patterns.

    At most twenty learned patterns exist per retailer, so they travel as one
    small array per retailer row.
    """
    if learned is None:
        return products.withColumn("image_urls", F.filter("image_urls", I.static_valid))
    per = (placeholder_patterns(learned).groupBy("retailer")
           .agg(F.collect_list("pattern").alias("_patterns")))
    rows = products.join(per, "retailer", "left")
    none = F.array().cast("array<string>")
    return rows.withColumn("image_urls", F.filter(
        "image_urls", lambda u: I.static_valid(u) & ~F.exists(
            F.coalesce("_patterns", none),
            lambda p: F.regexp_like(u, F.concat(F.lit("(?i)"), p))))).drop("_patterns")


def enhance_images(products: DataFrame) -> DataFrame:
    """Upgraded urls, each once and in first-seen order, with the number changed."""
    new = F.transform("image_urls", lambda u: I.upgraded(u, F.col("retailer")))
    rows = products.withColumn("_new", new)
    changed = F.size(F.filter(F.zip_with("image_urls", "_new", lambda a, b: a != b), lambda x: x))
    return (rows.withColumn("enhanced_count", changed)
            .withColumn("image_urls", F.array_distinct("_new")).drop("_new"))


def best_images(products: DataFrame, n: int = 5, page_score: bool = False) -> DataFrame:
    """The ``n`` best urls of each product by score; equal scores keep their order.

    An image list belongs to one row, so it is ranked inside the row: no
    explode and no shuffle.
    """
    def entry(u, i):
        score = I.page_quality_score(u) if page_score else I.quality_score(u, F.col("retailer"))
        return F.struct((-score).alias("s"), i.alias("i"), u.alias("u"))

    ranked = F.slice(F.array_sort(F.transform("image_urls", entry)), 1, n)
    return products.withColumn("image_urls", F.transform(ranked, lambda x: x["u"]))


def image_files(products: DataFrame) -> DataFrame:
    """One row per image with the file name it is stored under."""
    return products.select("url", "title", F.posexplode("image_urls").alias("i", "image_url")) \
        .select("url", "image_url", I.file_name(
            F.col("title"), F.col("image_url"), F.col("i")).alias("file_name"))


def set_overlap(left, right):
    """Shared images and their share of the left list."""
    both = F.size(F.array_intersect(left, right))
    return both, F.try_divide(both, F.size(F.array_distinct(left)))
