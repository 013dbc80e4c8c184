"""Fuzzy title joins within a price band.

Every step that narrows the pairs is exact: no pair whose ratio reaches the
threshold is lost, and nothing is capped.

1. Work on distinct (retailer, title, price) values. Copies of one listing,
   however many, are a single row from here on.
2. Equal titles have ratio 1.0, the best there is, and need no scoring: one
   equi-join on the title settles them.
3. The rest is blocked on (retailer, price bucket, piece of the title). A
   listing's title is cut into more pieces than it can have edits against a
   partner above the threshold. Only pieces within the pair's edits of their own
   place count. Enough of them must be there, and one must fit as the first
   unharmed piece from the left, one as the first from the right: as many edits
   lie beyond such a piece as pieces do, which fixes how far it can have moved.
4. Distinct title pairs pass the character-multiset bound and are scored once.
5. Which product of a title comes first within the band is read off nested price
   cells: one that lies in the band as a whole gives its smallest url, only the
   cells at the band's two ends are opened.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import similarity as S
from shelfwatch.functions.text import title_key
from shelfwatch.operators.keyed import shuffled, spread_for_compute
from shelfwatch.session import staged


class AbsoluteBand:
    """Prices closer than ``width`` dollars. A bucket is as wide as a band, which so lies in two."""

    #: Levels of cells below the buckets that :func:`smallest_in_band` opens.
    levels = 1

    def __init__(self, width: float):
        self.width = width

    def bucket(self, price: Column, cells: int = 1) -> Column:
        return F.floor(price / F.lit(2 * self.width) * F.lit(float(cells))).cast("long")

    def ends(self, price: Column) -> tuple[Column, Column]:
        """No price that the band holds lies beyond these; rounding keeps the order."""
        return price - F.lit(self.width), price + F.lit(self.width)

    def holds(self, left: Column, right: Column) -> Column:
        return F.abs(right - left) < self.width


class RelativeBand:
    """Right price closer than ``share`` of the left price (both positive). Buckets are a little wider than a band."""

    levels = 2

    def __init__(self, share: float):
        self.share = share
        self._log = math.log((1 + share) / (1 - share)) * 1.05

    def bucket(self, price: Column, cells: int = 1) -> Column:
        return F.floor(F.log(price) / F.lit(self._log) * F.lit(float(cells))).cast("long")

    def ends(self, price: Column) -> tuple[Column, Column]:
        """No price that the band holds lies beyond these, by more than all rounding."""
        return price * F.lit((1 - self.share) * (1 - 1e-9)), price * F.lit((1 + self.share) * (1 + 1e-9))

    def holds(self, left: Column, right: Column) -> Column:
        return F.abs(left - right) / left < self.share


#: Cells a bucket or a cell is cut into; a power of two, so that cells nest exactly.
FAN = 16


def _near_buckets(band, price: Column) -> Column:
    return F.explode(F.sequence(*[band.bucket(end) for end in band.ends(price)]))


def _listing_values(listings: DataFrame) -> DataFrame:
    return (listings.select("retailer", title_key(F.col("title")).alias("lt"),
                            F.col("price").cast("double").alias("lp"))
            .filter((F.col("lt") != "") & (F.col("lp") > 0)).distinct())


def _product_values(products: DataFrame) -> DataFrame:
    return (products.select("retailer", title_key(F.col("title")).alias("rt"),
                            F.col("price").cast("double").alias("rp"), "url")
            .filter((F.col("rt") != "") & (F.col("rp") > 0))
            .groupBy("retailer", "rt", "rp").agg(F.min("url").alias("url")))


def candidate_title_pairs(left: DataFrame, right: DataFrame, band, threshold: float) -> DataFrame:
    """Distinct (lt, rt) pairs that can reach the threshold inside the band.

    The larger side, the listings, is cut into its few pieces; the products
    list every substring a piece may equal, with its place. Both meet by a hash of
    retailer, bucket and piece; what meets by chance is a pair more to score.
    """
    cell = F.xxhash64("retailer", "bucket", "piece").alias("cell")
    lefts = (spread_for_compute(
        left.select("retailer", "lt", _near_buckets(band, F.col("lp")).alias("bucket")).distinct(),
        "retailer", "lt", "bucket")
        .select("*", F.posexplode(S.pieces(F.col("lt"), threshold)).alias("nth", "piece")).select(cell, "lt", "nth"))
    rights = (spread_for_compute(
        right.select("retailer", "rt", band.bucket(F.col("rp")).alias("bucket")).distinct(),
        "retailer", "rt", "bucket")
        .withColumn("gram", F.explode(S.grams_for_partners(F.col("rt"), threshold)))
        .select("retailer", "bucket", "rt", "gram.piece", "gram.place").select(cell, "rt", "place"))
    ll, rl = F.length("lt"), F.length("rt")
    nth, shift = F.col("nth"), F.col("place") - F.col("nth") * S.piece_width(ll, threshold)
    total, edits = F.floor(ll / S.piece_width(ll, threshold)), S.pair_edits(ll, rl, threshold)
    rest = rl - ll - shift
    met = (lefts.join(shuffled(rights), "cell")
           .filter(rl.between(S.min_length(ll, threshold), S.max_length(ll, threshold)))
           .filter(S.unharmed(shift, ll, rl, threshold)).filter(F.col("lt") != F.col("rt")))
    # Pieces past the 60th share marks: a mark then counts once, and only titles with that many pieces are counted low.
    mark = F.expr("shiftleft(1L, cast(least(nth, 60) as int))")
    pairs = met.groupBy("lt", "rt").agg(
        F.bit_or(mark).alias("shared_marks"), F.bool_or(S.outermost(nth, shift, rest, edits)).alias("from_left"),
        F.bool_or(S.outermost(total - 1 - nth, rest, shift, edits)).alias("from_right"))
    enough = (F.bit_count("shared_marks") >= total - edits) | (total > 60)
    return (pairs.filter(F.col("from_left") & F.col("from_right") & enough)
            .select("lt", "rt", F.bit_count("shared_marks").alias("shared")))


def scored_title_pairs(pairs: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    """Score distinct title pairs; keeps those at the threshold.

    The bound is tied to the aggregate ``shared``: on the titles alone the
    optimizer would push it below the aggregates and into the join condition,
    where it would run once per shared piece instead of once per pair.
    """
    bounded = pairs.filter(F.when(
        F.col("shared") > 0, S.bag_bound(F.col("lt"), F.col("rt")) >= threshold - 1e-9))
    scored = spread_for_compute(bounded.select("lt", "rt"), "lt", "rt").withColumn("ratio", S.sequence_ratio()(F.col("lt"), F.col("rt")))
    keep = F.col("ratio") >= threshold if inclusive else F.col("ratio") > threshold
    return scored.filter(keep)


def ratios(pairs: DataFrame) -> DataFrame:
    """``pairs`` of distinct (lt, rt) with their exact ratio; only pairs that native rules leave open reach Python."""
    known = pairs.withColumn("ratio", S.settled_ratio(F.col("lt"), F.col("rt")))
    # A generator holds the value, so that the two filters below read it.
    known = known.select("lt", "rt", F.explode(F.array("ratio")).alias("ratio"))
    left = spread_for_compute(known.filter(F.col("ratio").isNull()).select("lt", "rt"), "lt", "rt")
    return known.filter(F.col("ratio").isNotNull()).unionByName(left.withColumn("ratio", S.sequence_ratio()(F.col("lt"), F.col("rt"))))


def smallest_in_band(near: DataFrame, right: DataFrame, band) -> DataFrame:
    """``near`` (retailer, rt, lp, bucket and more) without the bucket, with urls among which is the smallest of ``right`` in the band.

    A title can have as many prices as its products. Joined one by one they make listings times products rows, which
    the aggregate behind sorts and spills. Here a row meets one row a bucket, with the FAN cells below it: cells that lie
    in the band with their lowest and highest price do so as a whole, as the band's test is monotonous on either side
    of the listing's price. At most the two cells at the band's ends go on to the next level, the last are compared by value.
    """
    keep = [c for c in near.columns if c != "bucket"]
    # A row whose cells are settled goes on with its url and meets nothing; no bucket lies that low.
    nothing = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("lp"), F.lit(1 << 20))

    def lies(part: str, c: Column) -> Column:
        low, high = band.holds(F.col("lp"), c["low"]), band.holds(F.col("lp"), c["high"])
        if part == "inside":
            return low & high
        return ~(low & high) & ~((c["high"] < F.col("lp")) & ~high) & ~((c["low"] > F.col("lp")) & ~low)

    rows, cells = near.select(*keep, F.lit(None).cast("string").alias("url"), F.col("bucket").alias("_cell")), 1
    for _ in range(band.levels):
        below = right.groupBy("retailer", "rt", band.bucket(F.col("rp"), cells).alias("_cell"), band.bucket(F.col("rp"), cells * FAN).alias("id")).agg(
            F.min("rp").alias("low"), F.max("rp").alias("high"), F.min("url").alias("_url"))
        table = below.groupBy("retailer", "rt", "_cell").agg(F.collect_list(F.struct("id", "low", "high", "_url")).alias("_below"))
        met = rows.join(shuffled(table), ["retailer", "rt", "_cell"], "inner" if cells == 1 else "left")
        inside = F.array_min(F.transform(F.filter("_below", lambda c: lies("inside", c)), lambda c: c["_url"]))
        ends = F.transform(F.filter("_below", lambda c: lies("partly", c)), lambda c: c["id"])
        rows = met.select(*keep, F.least("url", inside).alias("url"), F.explode_outer(ends).alias("_cell")).filter("url IS NOT NULL OR _cell IS NOT NULL") \
            .withColumn("_cell", F.coalesce("_cell", nothing))
        cells *= FAN
    values = right.select("retailer", "rt", F.col("rp").alias("_rp"), F.col("url").alias("_url"), band.bucket(F.col("rp"), cells).alias("_cell"))
    met = rows.join(shuffled(values), ["retailer", "rt", "_cell"], "left")
    return met.select(*keep, F.least("url", F.when(band.holds(F.col("lp"), F.col("_rp")), F.col("_url"))).alias("url")).filter(F.col("url").isNotNull())


def best_fuzzy(listings: DataFrame, products: DataFrame, band, threshold: float) -> DataFrame:
    """Best product per distinct (retailer, lt, lp): ``url`` and ``ratio``.

    Ratio must exceed ``threshold``; ties go to the smallest url.

    The distinct values of both sides are used several times below, and the
    listings of a cascade come at the end of a chain of joins: they are written
    to the shared folder once and not derived anew for each use.
    """
    left = staged(_listing_values(listings), "listing-titles")
    right = staged(_product_values(products), "product-titles")
    near = left.withColumn("bucket", _near_buckets(band, F.col("lp")))
    key = ["retailer", "lt", "lp"]

    same = staged(smallest_in_band(near.withColumn("rt", F.col("lt")), right, band)
                  .groupBy(*key).agg(F.min("url").alias("url")), "same-titles").withColumn("ratio", F.lit(1.0))
    open_left = left.join(shuffled(same.select(*key)), key, "left_anti")
    pairs = scored_title_pairs(
        candidate_title_pairs(open_left, right, band, threshold), threshold)
    close = (smallest_in_band(open_left.withColumn("bucket", _near_buckets(band, F.col("lp"))).join(shuffled(pairs), "lt"), right, band)
             .groupBy(*key).agg(F.min(F.struct((-F.col("ratio")).alias("n"), "url")).alias("m"))
             .select(*key, F.col("m.url").alias("url"), (-F.col("m.n")).alias("ratio")))
    return same.unionByName(close)


def link_confidence(ratio: Column) -> Column:
    return F.lit(0.85) + (ratio - F.lit(0.90)) * F.lit(0.5)


def fuzzy_links(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Linking form: ratio above 0.90, prices within a dollar."""
    best = best_fuzzy(listings, products, AbsoluteBand(1.0), 0.90)
    return best.select("retailer", "lt", "lp", F.col("url").alias("linked_product_url"), "ratio",
                       link_confidence(F.col("ratio")).alias("link_confidence"))


def fuzzy_suspects(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Classifying form: ratio above 0.85, price within ten percent."""
    return best_fuzzy(listings, products, RelativeBand(0.10), 0.85)


def title_price_pairs(listings: DataFrame, threshold: float = 0.90,
                      tolerance: float = 1.0) -> DataFrame:
    """Distinct (title, price) value pairs of one retailer that count as the same product.

    Threshold inclusive. Values, not rows, are paired: copies carry a count
    (``left_rows``, ``right_rows``) instead of being multiplied out.
    """
    band = AbsoluteBand(tolerance)
    values = (listings.select("retailer", title_key(F.col("title")).alias("t"),
                              F.col("price").cast("double").alias("p"))
              .filter((F.col("t") != "") & F.col("p").isNotNull())
              .groupBy("retailer", "t", "p").agg(F.count(F.lit(1)).alias("rows")))
    left = values.select("retailer", F.col("t").alias("lt"), F.col("p").alias("lp"),
                         F.col("rows").alias("left_rows"))
    right = (values.select("retailer", F.col("t").alias("rt"), F.col("p").alias("rp"),
                           F.col("rows").alias("right_rows"))
             .withColumn("bucket", band.bucket(F.col("rp"))))
    pairs = scored_title_pairs(candidate_title_pairs(left, right, band, threshold),
                               threshold, inclusive=True)
    near = left.withColumn("bucket", _near_buckets(band, F.col("lp")))
    in_band = band.holds(F.col("lp"), F.col("rp"))
    ordered = F.struct("lt", "lp") < F.struct("rt", "rp")
    same = (near.withColumn("rt", F.col("lt")).join(shuffled(right), ["retailer", "bucket", "rt"])
            .filter(in_band & (F.col("lp") < F.col("rp"))).withColumn("ratio", F.lit(1.0)))
    close = (near.join(shuffled(pairs), "lt").join(shuffled(right), ["retailer", "bucket", "rt"])
             .filter(in_band & ordered))
    cols = ["retailer", "lt", "lp", "left_rows", "rt", "rp", "right_rows", "ratio"]
    return same.select(*cols).unionByName(close.select(*cols))
