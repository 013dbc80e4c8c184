"""Image lists and the store feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_queries.base import AS_OF, BINDINGS, as_of, query
from catalog_queries.linking import with_images
from shelfwatch.functions import images as I
from shelfwatch.functions import text as X
from shelfwatch.operators import feed, images

# Image lists of several retailers with thumbnails, icons and duplicates.
BINDINGS["b_imaged"] = """
SELECT p_partkey, concat('https://shop.example.com/', CAST(p_partkey AS STRING)) AS url, p_name AS title,
  CASE p_size % 4 WHEN 0 THEN 'anthropologie' WHEN 1 THEN 'aritzia' WHEN 2 THEN 'revolve' ELSE 'other' END AS retailer,
  concat('https://a.scene7.com/x', CAST(p_partkey AS STRING), ',https://b.example.com/', CAST(p_partkey AS STRING), '_330_430.jpg,https://c.example.com/n/ct/', CAST(p_size AS STRING), '_V1.jpg,https://d.example.com/thumb_small.png,https://e.example.com/zoom/', CAST(p_partkey AS STRING), '_small.jpg,https://d.example.com/thumb_small.png,https://f.example.com/icons/logo.svg,//g.example.com/photo_200.gif,https://h.example.com/main_large_1200.webp?w=300') AS image_csv
FROM part
"""


def imaged(v):
    return with_images(v.b_imaged)


def joined(df, *more):
    return df.select("p_partkey", F.array_join("image_urls", ",").alias("images"), *more)


ITEMS = "WITH i AS (SELECT p_partkey, retailer, title, unnest(string_split(image_csv, ',')) AS u, generate_subscripts(string_split(image_csv, ','), 1) AS pos FROM b_imaged)\n"
BAD = "|".join(I.STATIC_EXCLUSIONS)
VALID_A = f"length(u) >= 10 AND NOT regexp_matches(u, '{BAD}', 'i') AND (starts_with(u, 'http://') OR starts_with(u, 'https://'))"


def sql_any(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def collected(where, u="u"):
    return (ITEMS + f"SELECT p.p_partkey, coalesce(string_agg({u}, ',' ORDER BY pos), '') AS images FROM b_imaged p LEFT JOIN (SELECT * FROM i WHERE {where}) i ON p.p_partkey = i.p_partkey GROUP BY ALL")


@query("F7a_static_image_filter", collected(VALID_A))
def filter_a(v):
    return joined(images.filter_images(imaged(v)))


LEARNED = "CASE WHEN retailer = 'other' THEN regexp_matches(u, 'zoom', 'i') WHEN retailer = 'revolve' THEN regexp_matches(u, '_v\\d', 'i') ELSE false END"


def learned(v):
    return v.b_imaged.filter("retailer IN ('other', 'revolve')").groupBy("retailer").agg(
        F.count(F.lit(1)).alias("detection_count")).withColumn(
        "pattern", F.when(F.col("retailer") == "other", "zoom").otherwise(r"_v\d"))


@query("F7a_learned_image_filter", collected(f"{VALID_A} AND NOT {LEARNED}"))
def filter_learned(v):
    return joined(images.filter_images(imaged(v), learned(v)))


@query("F7b_strategy_image_filter", collected(
    f"NOT {sql_any('lower(u)', I.INVALID_TEXTS)} AND ({sql_any('lower(u)', I.VALID_TEXTS)} OR contains(lower(u), retailer))"))
def filter_b(v):
    return joined(imaged(v).withColumn("image_urls", F.filter(
        "image_urls", lambda u: I.strategy_valid(u, F.col("retailer")))))


@query("F7c_page_image_filter", collected(
    f"length(u) >= 10 AND NOT {sql_any('lower(u)', I.PAGE_EXCLUSIONS)} AND ({sql_any('lower(u)', I.IMAGE_EXTENSIONS)} OR {sql_any('lower(u)', I.IMAGE_WORDS)}) AND (starts_with(u, 'http') OR starts_with(u, '/'))"))
def filter_c(v):
    return joined(imaged(v).withColumn("image_urls", F.filter("image_urls", I.page_valid)))


@query("U4_exclusion_patterns", " UNION ALL ".join(
    f"SELECT DISTINCT retailer, '{p}' AS pattern FROM b_imaged" for p in I.STATIC_EXCLUSIONS)
       + " UNION ALL SELECT 'other', 'zoom' UNION ALL SELECT 'revolve', '_v\\d'")
def exclusion_union(v):
    return images.exclusion_patterns(learned(v), v.b_imaged)


def sql_rules(rules):
    out = "u"
    for p, r in rules:
        flag = "gi" if p.startswith("(?i)") else "g"
        p = p.removeprefix("(?i)")
        r = r.replace("\\$", "\x00").replace("$", "\\").replace("\x00", "$")
        out = f"regexp_replace({out}, '{p}', '{r}', '{flag}')"
    return out


ANT = sql_rules(I.UPGRADES["anthropologie"])
NEW = f"""CASE retailer WHEN 'anthropologie' THEN CASE WHEN {ANT} = u AND NOT contains(u, '?') AND contains(u, 'scene7.com') THEN concat(u, '?wid=1200&hei=1500&fmt=jpeg&qlt=85')
  WHEN {ANT} = u AND NOT contains(u, '?') AND contains(u, 'anthropologie.com') THEN concat(u, '?format=1200w') ELSE {ANT} END
  WHEN 'aritzia' THEN {sql_rules(I.UPGRADES['aritzia'])} WHEN 'revolve' THEN {sql_rules(I.UPGRADES['revolve'])} ELSE {sql_rules(I.GENERIC_UPGRADE)} END"""
UPGRADED = ITEMS[:-1] + f""", n AS (SELECT *, {NEW} AS nu FROM i), k AS (SELECT p_partkey, retailer, nu, min(pos) AS pos FROM n GROUP BY ALL),
c AS (SELECT p_partkey, count(*) FILTER (nu <> u) AS enhanced_count FROM n GROUP BY ALL)
"""


@query("X17_E8_enhance_images", UPGRADED + """
SELECT k.p_partkey, string_agg(nu, ',' ORDER BY pos) AS images, c.enhanced_count FROM k JOIN c USING (p_partkey) GROUP BY ALL""")
def enhance(v):
    return joined(images.enhance_images(imaged(v)), "enhanced_count")


@query("D5_distinct_images", ITEMS + """,
k AS (SELECT p_partkey, u, min(pos) AS pos FROM i GROUP BY ALL) SELECT p_partkey, string_agg(u, ',' ORDER BY pos) AS images FROM k GROUP BY ALL""".lstrip())
def distinct_images(v):
    return joined(imaged(v).withColumn("image_urls", F.array_distinct("image_urls")))


def sql_points(u, terms):
    return " + ".join(f"CASE WHEN {sql_any(u if exact else f'lower({u})', ws)} THEN {n} ELSE 0 END"
                      for ws, n, exact in terms)


A = (f"({sql_points('u', I.SCORE_A)} + CASE WHEN length(u) > 200 THEN 3 WHEN length(u) > 150 THEN 2 ELSE 0 END "
     "+ CASE WHEN retailer = 'anthropologie' AND contains(u, '1094_1405') THEN 15 ELSE 0 END "
     "+ CASE WHEN retailer = 'aritzia' AND contains(lower(u), '_large') THEN 10 ELSE 0 END "
     "+ CASE WHEN contains(u, 'scene7.com') AND contains(lower(u), 'zoom') THEN 10 ELSE 0 END)")
B = f"({sql_points('u', I.SCORE_B)} + CASE WHEN length(u) > 200 THEN 2 ELSE 0 END)"


@query("X18_quality_scores", ITEMS + f"SELECT p_partkey, pos::BIGINT - 1 AS pos, {A} AS score_a, {B} AS score_b FROM i")
def scores(v):
    rows = imaged(v).select("p_partkey", "retailer", F.posexplode("image_urls").alias("pos", "u"))
    return rows.select("p_partkey", F.col("pos").cast("long").alias("pos"),
                       I.quality_score(F.col("u"), F.col("retailer")).alias("score_a"),
                       I.page_quality_score(F.col("u")).alias("score_b"))


def best_sql(score, n):
    return ITEMS + f""", r AS (SELECT p_partkey, u, row_number() OVER (PARTITION BY p_partkey ORDER BY {score} DESC, pos) AS rk FROM i)
SELECT p_partkey, string_agg(u, ',' ORDER BY rk) AS images FROM r WHERE rk <= {n} GROUP BY ALL"""


@query("T3_best_images", best_sql(A, 5))
def best_five(v):
    return joined(images.best_images(imaged(v)))


@query("T3b_best_images_by_page_score", best_sql(B, 10))
def best_ten(v):
    return joined(images.best_images(imaged(v), 10, page_score=True))


@query("X23_file_names", ITEMS + """
SELECT concat('https://shop.example.com/', p_partkey) AS url, u AS image_url, concat(regexp_replace(substr(regexp_replace(title, '[^\\w\\s-]', '', 'g'), 1, 50), '[-\\s]+', '_', 'g'), '_', md5(u)[1:8], '_', pos - 1, '.',
  CASE WHEN ends_with(lower(u), '.png') THEN 'png' WHEN ends_with(lower(u), '.webp') THEN 'webp' ELSE 'jpg' END) AS file_name FROM i""")
def files(v):
    return images.image_files(imaged(v))


@query("U1_image_overlap", """
SELECT x.url, len(list_intersect(string_split(x.image_csv, ','), string_split(p.image_csv, ','))) AS shared, round(len(list_intersect(string_split(x.image_csv, ','), string_split(p.image_csv, ','))) / len(list_distinct(string_split(x.image_csv, ','))), 6) AS ratio
FROM b_extracts x JOIN b_products_full p ON x.url = p.url WHERE x.image_csv <> '' AND p.image_csv <> ''""")
def overlaps(v):
    x = with_images(v.b_extracts.filter("image_csv <> ''")).select("url", F.col("image_urls").alias("a"))
    p = with_images(v.b_products_full.filter("image_csv <> ''")).select("url", F.col("image_urls").alias("b"))
    both, ratio = images.set_overlap(F.col("a"), F.col("b"))
    return x.join(p, "url").select("url", both.cast("long").alias("shared"), F.round(ratio, 6).alias("ratio"))


@query("U3_same_image_set", """
SELECT x.url, list_sort(list_distinct(string_split(x.image_csv, ','))) = list_sort(list_distinct(string_split(p.image_csv, ','))) AS same FROM b_extracts x JOIN b_products_full p ON x.url = p.url""")
def same_sets(v):
    x = v.b_extracts.select("url", F.split("image_csv", ",").alias("a"))
    p = v.b_products_full.select("url", F.split("image_csv", ",").alias("b"))
    return x.join(p, "url").select("url", (
        (F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("b", "a")) == 0)).alias("same"))


# --- feed --------------------------------------------------------------------------------

def cap(c):
    """Title case of blank-separated plain words."""
    return f"array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')"


STORE = "CASE {} ELSE " + "array_to_string(list_transform(string_split(clothing_type, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')" + " END"
PTYPE = STORE.format(" ".join("WHEN lower(trim(clothing_type)) IN ({}) THEN '{}'".format(
    ", ".join(repr(k) for k in ks), t) for t, ks in X.STORE_TYPES.items()))
FEED_ROWS = f"""
WITH f AS (SELECT *, {PTYPE} AS ptype, coalesce(modesty_status, 'pending_review') AS decision FROM b_products_full),
t AS (SELECT *, CASE ptype WHEN 'Dresses' THEN 'Dress' ELSE ptype END AS singular FROM f)
"""
TAGS = f"""concat_ws(', ', {cap('decision')}, concat(upper(retailer[1]), regexp_replace(retailer[2:], '', '')), 'Auto-Scraped', singular, CASE WHEN sale_status = 'on_sale' THEN 'On Sale' END,
  CASE WHEN lower(brand) <> retailer THEN concat(brand[1], lower(brand[2:])) END, stock_status, CASE WHEN decision = 'pending_review' THEN 'not-assessed' END)"""


@query("K10_product_feed", FEED_ROWS + f"""
SELECT url, title, concat('<p>', description, '</p>') AS body_html, brand AS vendor, ptype AS product_type, CASE WHEN decision IN ('modest', 'moderately_modest') THEN 'active' ELSE 'draft' END AS status,
  {TAGS} AS tags, printf('%.2f', price) AS price, CASE WHEN sale_status = 'on_sale' AND original_price IS NOT NULL THEN printf('%.2f', original_price) END AS compare_at_price, product_code AS sku,
  CASE stock_status WHEN 'out_of_stock' THEN 0 ELSE 100 END AS inventory_quantity FROM t""")
def product_feed(v):
    return feed.product_feed(v.b_products_full, as_of())


@query("K10_feed_json", FEED_ROWS + f"""
SELECT url, to_json({{'product': {{'title': title, 'body_html': concat('<p>', description, '</p>'), 'vendor': brand, 'product_type': ptype,
  'status': CASE WHEN decision IN ('modest', 'moderately_modest') THEN 'active' ELSE 'draft' END, 'tags': {TAGS},
  'variants': [{{'option1': 'Default', 'price': printf('%.2f', price), 'compare_at_price': CASE WHEN sale_status = 'on_sale' AND original_price IS NOT NULL THEN printf('%.2f', original_price) END,
    'sku': product_code, 'inventory_quantity': CASE stock_status WHEN 'out_of_stock' THEN 0 ELSE 100 END, 'inventory_management': 'shopify', 'inventory_policy': 'deny',
    'fulfillment_service': 'manual', 'requires_shipping': true, 'taxable': true, 'weight': 0.5::DOUBLE, 'weight_unit': 'kg'}}],
  'options': [{{'name': 'Title', 'position': 1, 'values': ['Default']}}], 'images': []::VARCHAR[]}}}})::VARCHAR AS value FROM t""")
def feed_json(v):
    return feed.feed_json(feed.product_feed(v.b_products_full, as_of()))


@query("X13_tags", FEED_ROWS + f"SELECT url, {TAGS} AS tags FROM t")
def tag_lists(v):
    return feed.product_feed(v.b_products_full, as_of()).select("url", "tags")


@query("K11_metafields", """
SELECT url, unnest(['custom','inventory','custom','custom','custom','custom','custom','custom','custom','clothing','clothing','clothing','clothing']) AS namespace,
  unnest(['stock_status','source_urls','last_updated','product_id','modesty_level','retailer_source','scraping_method_used','sale_status','original_price','neckline','sleeve_length','visual_analysis_confidence','visual_analysis_source']) AS key,
  unnest([stock_status, concat('["', url, '"]'), '2001-12-01T00:00:00Z', concat('["', product_code, '"]'), coalesce(modesty_status, 'pending_review'), retailer, 'openmanus', sale_status, '', 'unknown', 'unknown', '', '']) AS value,
  unnest(['single_line_text_field','json','date_time','json','single_line_text_field','single_line_text_field','single_line_text_field','single_line_text_field','single_line_text_field','single_line_text_field','single_line_text_field','single_line_text_field','single_line_text_field']) AS type FROM b_products_full""")
def fields(v):
    return feed.metafields(v.b_products_full.drop("original_price"), as_of())


@query("K16_edit_tags", """
WITH f AS (SELECT url, p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Dress, not-assessed, modest' WHEN 1 THEN ' pending-modesty-review ,Top' ELSE '' END AS tags, 'draft' AS status FROM b_products_full),
d AS (SELECT url, modesty_status AS d FROM b_products_full WHERE modesty_status IS NOT NULL)
SELECT f.url, CASE WHEN d IS NULL THEN tags ELSE CASE p_partkey % 3 WHEN 0 THEN CASE WHEN d = 'modest' THEN 'Dress, modest' ELSE concat('Dress, modest, ', d) END WHEN 1 THEN concat('Top, ', d) ELSE d END END AS tags,
  CASE WHEN d IN ('modest', 'moderately_modest') THEN 'active' ELSE status END AS status FROM f LEFT JOIN d ON f.url = d.url""")
def edited(v):
    p = v.b_products_full
    rows = p.select("url", F.when(F.col("p_partkey") % 3 == 0, "Dress, not-assessed, modest")
                    .when(F.col("p_partkey") % 3 == 1, " pending-modesty-review ,Top").otherwise("")
                    .alias("tags"), F.lit("draft").alias("status"))
    d = p.filter("modesty_status IS NOT NULL").select("url", F.col("modesty_status").alias("review_decision"))
    return feed.edit_tags(rows, d)


@query("X7_brands", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN concat('Free People''S ', p_partkey, 'A-Line') WHEN 2 THEN 'AFF' ELSE brand END AS brand FROM
(SELECT p_partkey, p_size, concat(p_brand, ' co') AS brand FROM part)""")
def brands(v):
    k = F.col("p_partkey").cast("string")
    m = F.col("p_size") % 4
    b = (F.when(m == 0, "H&M").when(m == 1, F.concat(F.lit("FREE PEOPLE'S "), k, F.lit("A-LINE")))
         .when(m == 2, "AFF").otherwise(F.concat(F.col("p_brand"), F.lit(" co"))))
    return v.part.select("p_partkey", X.valid_brand(b).alias("brand"))


@query("X8_sizes_and_colors", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'XS|S|M|L' WHEN 1 THEN '0|2|4' WHEN 2 THEN 'M-L' ELSE 'One size' END AS sizes, CASE WHEN p_size % 2 = 0 THEN 'Black|Navy' ELSE 'Red' END AS colors FROM part""")
def sizes(v):
    m = F.col("p_size") % 4
    s = F.when(m == 0, "XS-L").when(m == 1, "0, 2,4 ,").when(m == 2, "M-L").otherwise(" One size ")
    c = F.when(F.col("p_size") % 2 == 0, "Black, Navy").otherwise("Red")
    return v.part.select("p_partkey", F.array_join(X.parse_sizes(s), "|").alias("sizes"),
                         F.array_join(X.parse_colors(c), "|").alias("colors"))


@query("X14_descriptions", """
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '<p>Product description coming soon.</p>' ELSE md5(regexp_replace(concat('<p>', replace(text, chr(10), '</p><p>'), '</p>'), '<p>\\s*</p>', '', 'g')) END AS html_hash FROM documents""")
def descriptions(v):
    t = F.col("text")
    h = X.description_html(t)
    return v.documents.select("doc_id", F.when(F.coalesce(t, F.lit("")) == "", h).otherwise(F.md5(h))
                              .alias("html_hash"))


@query("X16_sku_and_stock", """
SELECT p_partkey, concat(upper(p_brand[1:3]), '-', upper(concat(string_split(p_name, ' ')[1], coalesce(string_split(p_name, ' ')[2], '')))[1:6], '-164800') AS sku, CASE p_size % 3 WHEN 0 THEN 100 WHEN 1 THEN 5 ELSE 0 END AS quantity FROM part""")
def skus(v):
    m = F.col("p_size") % 3
    s = F.when(m == 0, "in stock").when(m == 1, "low in stock").otherwise("out_of_stock")
    return v.part.select("p_partkey", feed.sku(F.lit(None).cast("string"), F.col("p_brand"),
                                               F.col("p_name"), as_of()).alias("sku"),
                         feed.inventory(s).alias("quantity"))
