"""All queries of the listing engine, and the DuckDB SQL that checks each on its own terms: cards are read back to the values they were rendered from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import listings as L
from ..operators import present as V
from ..operators.query import ListingQuery
from ..sources import dims
from ..sources.html import PROFILES, scan_anchors, scan_cards
from .cards import SUBURBS, cards, pick
from .flagship import flagship, located

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return X.parse_listing(cards(spark, sf_dir), columns=columns or tuple(X.PARSED))


def detailed(rows: DataFrame) -> DataFrame:
    """rows with the struct f of what their detail pages say."""
    return X.settled(rows, f=X.detail_features(F.col("detailText")))


#: What each card says, from the columns it was made of.
_SUBURB = "[" + ", ".join(f"'{s}'" for s in SUBURBS) + f"][p_partkey % {len(SUBURBS)} + 1]"
BASE = f"""
WITH b AS (
  SELECT *, p_partkey AS k, CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE ((floor(p_retailprice * 100)::BIGINT * p_size) % 9000000 + 500)::INTEGER END AS price,
    p_partkey % 5 = 4 AS on_request, (p_partkey % 6 + 1)::INTEGER AS rooms,
    CASE WHEN p_partkey % 4 < 2 THEN (p_partkey % 5 + 1)::INTEGER WHEN p_partkey % 6 = 0 THEN 1 END AS bedrooms,
    CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END::INTEGER AS bathrooms,
    (p_size + 20 + CASE WHEN p_partkey % 3 = 1 THEN 0.5 ELSE 0 END)::DOUBLE AS sqm, (p_partkey % 20 + 1)::INTEGER AS arr
  FROM part
), c AS (
  SELECT *, CASE k % 8 WHEN 0 THEN 'Paris ' || arr || 'e' WHEN 1 THEN 'Paris ' || arr || 'ème' WHEN 2 THEN 'Paris ' || arr || 'th' WHEN 3 THEN 'PARIS ' || arr || 'EME'
      WHEN 4 THEN 'Paris ' || arr WHEN 5 THEN '750' || lpad(arr::VARCHAR, 2, '0') || ')' WHEN 6 THEN {_SUBURB} ELSE '12 rue de la Paix' END AS address,
    CASE WHEN k % 8 < 6 THEN CASE WHEN arr = 1 THEN 'Paris 1er' ELSE 'Paris ' || arr || 'e' END WHEN k % 8 = 6 THEN {_SUBURB} ELSE '12 rue de la Paix' END AS area,
    CASE WHEN k % 8 < 6 THEN 'paris' WHEN k % 8 = 6 THEN 'suburb' ELSE 'other' END AS kind, CASE WHEN k % 8 < 6 THEN arr END AS arrondissement,
    CASE k % 5 WHEN 0 THEN true WHEN 2 THEN true ELSE false END AS elevator, k % 3 <> 1 AS balcony,
    CASE k % 5 WHEN 0 THEN true WHEN 3 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS furnished,
    ['Barnes', 'SeLoger', 'Junot', 'DanielFeau'][k % 4 + 1] AS source, ['rent', 'sale'][k % 2 + 1] AS kind_of, k % 9 = 0 AS share
  FROM b
) """


@register(BASE + "SELECT k AS p_partkey, price, on_request AS price_on_request FROM c")
def parse_price(spark, sf_dir):
    return parsed(spark, sf_dir, "price", "priceOnRequest").select("p_partkey", "price", F.col("priceOnRequest").alias("price_on_request"))


@register(BASE + "SELECT k AS p_partkey, rooms, bedrooms, bathrooms FROM c")
def parse_rooms(spark, sf_dir):
    return parsed(spark, sf_dir, "rooms", "bedrooms", "bathrooms").select("p_partkey", "rooms", "bedrooms", "bathrooms")


@register(BASE + "SELECT k AS p_partkey, sqm, floor(sqm * 10.764::DOUBLE + 0.5)::BIGINT AS sqft FROM c")
def parse_surface(spark, sf_dir):
    return parsed(spark, sf_dir, "sqm", "sqft").select("p_partkey", "sqm", "sqft")


@register(BASE + "SELECT k AS p_partkey, address FROM c")
def parse_address(spark, sf_dir):
    return parsed(spark, sf_dir, "address").select("p_partkey", "address")


@register(BASE + """SELECT k AS p_partkey, CASE WHEN k % 7 > 1 AND price > 0 THEN floor(price / sqm + 0.5)::BIGINT END AS price_per_sqm,
  CASE k % 7 WHEN 0 THEN 25 WHEN 1 THEN 50 ELSE 100 END AS match_score, k % 7 > 1 AS is_exact FROM c""")
def derive_metrics(spark, sf_dir):
    """Cards of which two in seven say little: the street only, or the street and a price."""
    little = F.when(F.col("p_partkey") % 7 == 0, "12 rue de la Paix").when(F.col("p_partkey") % 7 == 1, "12 rue de la Paix\n900 €/mois").otherwise(F.col("rawText"))
    return X.parse_listing(cards(spark, sf_dir).withColumn("rawText", little)).select("p_partkey", F.col("pricePerSqm").alias("price_per_sqm"), F.col("matchScore").alias("match_score"), F.col("isExactListing").alias("is_exact"))


@register(BASE + "SELECT k AS p_partkey, elevator, balcony, furnished, (k % 3 + 1)::INTEGER AS bathrooms, (k % 4 + 1)::INTEGER AS bedrooms FROM c")
def detail_features(spark, sf_dir):
    return detailed(cards(spark, sf_dir)).select("p_partkey", "f.elevator", "f.balcony", "f.furnished", F.col("f.bathroomsFromDetail").alias("bathrooms"), F.col("f.bedroomsFromDetail").alias("bedrooms"))


@register(BASE + """SELECT k AS p_partkey,
  CASE source WHEN 'Junot' THEN false WHEN 'SeLoger' THEN CASE WHEN k % 10 < 7 THEN elevator END ELSE CASE WHEN k % 10 < 7 THEN elevator ELSE false END END AS elevator,
  CASE source WHEN 'Junot' THEN false WHEN 'SeLoger' THEN CASE WHEN k % 10 < 7 THEN balcony END ELSE CASE WHEN k % 10 < 7 THEN balcony ELSE false END END AS balcony,
  CASE WHEN k % 10 < 7 THEN furnished END AS furnished, coalesce(bathrooms, CASE WHEN k % 10 < 7 THEN (k % 3 + 1)::INTEGER END) AS bathrooms,
  coalesce(bedrooms, CASE WHEN k % 10 < 7 AND NOT (source = 'SeLoger' AND k % 4 + 1 > rooms) THEN (k % 4 + 1)::INTEGER END) AS bedrooms FROM c""")
def merge_features(spark, sf_dir):
    """Details exist for seven cards in ten; how they are merged depends on the source."""
    rows = X.settled(parsed(spark, sf_dir, "rooms", "bedrooms", "bathrooms"), card=X.detail_features(F.col("rawText")))
    details = detailed(cards(spark, sf_dir).filter(F.col("p_partkey") % 10 < 7)).select("url", F.col("f").alias("detail"))
    return L.enrich(rows, details, L.policy_dim(spark)).select("p_partkey", "elevator", "balcony", "furnished", "bathrooms", "bedrooms")


@register(BASE + "SELECT k AS p_partkey, area, kind, arrondissement FROM c")
def normalize_area(spark, sf_dir):
    return X.with_area(parsed(spark, sf_dir, "address")).select("p_partkey", "normalizedArea.area", "normalizedArea.kind", "normalizedArea.arrondissement")


@register(BASE + "SELECT k AS p_partkey FROM c WHERE NOT share")
def room_share_filter(spark, sf_dir):
    return L.drop_room_shares(parsed(spark, sf_dir, "isRoomShare")).select("p_partkey")


@register(BASE + "SELECT k AS p_partkey FROM c WHERE NOT (kind_of = 'sale' AND k % 11 = 0)")
def sold_filter(spark, sf_dir):
    return L.drop_sold(cards(spark, sf_dir), P.SOLD_FR).select("p_partkey")


@register("SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0")
def valid_filter(spark, sf_dir):
    rows = cards(spark, sf_dir).withColumn("rawText", F.when(F.col("p_partkey") % 7 == 0, "T3").otherwise(F.col("rawText")))
    return L.valid_rows(X.parse_listing(rows)).select("p_partkey")


LINE_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate"


@register(f"""SELECT l_partkey, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY r, {LINE_ORDER}) AS rn FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS r FROM lineitem)
) WHERE rn = 1 OR r = 0""")
def dedup_first_wins(spark, sf_dir):
    """Line items as listings of three sources, keyed by part; the first source is not deduped by itself."""
    return L.merge_sources(_lines(spark, sf_dir), "l_partkey", ("src_rank", *LINE_ORDER.split(", "))).select("l_partkey", "l_orderkey", "l_linenumber")


def _lines(spark, sf_dir):
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return read(spark, sf_dir, "lineitem").withColumn("src_rank", rank)


@register(f"""WITH s AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS r FROM lineitem),
m AS (SELECT l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY r, {LINE_ORDER}) AS rn FROM s) WHERE rn = 1 OR r = 0)
SELECT a.artifact, CASE WHEN a.error IS NULL THEN (SELECT count(*) FROM m WHERE m.l_returnflag = a.artifact) ELSE 0 END AS found, a.error,
  CASE WHEN a.error IS NULL THEN a.artifact || ': ' || (SELECT count(*) FROM m WHERE m.l_returnflag = a.artifact) || ' listings' ELSE a.artifact || ': FAILED — ' || a.error END AS line
FROM (VALUES ('A', NULL), ('N', NULL), ('R', NULL), ('X', 'Isolated job artifact not found')) a(artifact, error)""")
def source_status(spark, sf_dir):
    kept = L.merge_sources(_lines(spark, sf_dir), "l_partkey", ("src_rank", *LINE_ORDER.split(", "))).select(F.col("l_returnflag").alias("artifact"))
    artifacts = spark.createDataFrame([("A", None), ("N", None), ("R", None), ("X", "Isolated job artifact not found")], "artifact string, error string")
    status = L.source_status(artifacts, kept)
    return status.withColumn("line", V.status_line(F.col("artifact"), F.col("found"), F.col("error")))


@register(BASE + """SELECT k AS p_partkey, price FROM c
WHERE area IN ('Paris 16e', 'Paris 8e', 'Suresnes') AND source = 'DanielFeau' AND (price = 0 OR price <= 4000000) AND bathrooms >= 1 AND sqm >= 25""")
def facet_filter(spark, sf_dir):
    rows = X.with_area(parsed(spark, sf_dir, "price", "bathrooms", "sqm", "address"))
    q = ListingQuery(areas=frozenset({"Paris 16e", "Paris 8e", "Suresnes"}), source="DanielFeau", max_price=4_000_000, bathrooms=1, min_sqm=25)
    return q.filter(rows).select("p_partkey", "price")


@register(BASE + "SELECT k AS p_partkey FROM c WHERE elevator AND furnished IS NOT DISTINCT FROM true AND price <> 0 AND price >= 100000")
def amenity_filter(spark, sf_dir):
    rows = detailed(parsed(spark, sf_dir, "price")).withColumns({c: F.col(f"f.{c}") for c in ("elevator", "balcony", "furnished")})
    return ListingQuery(min_price=100_000, amenities=frozenset({"elevator", "furnished"})).filter(rows).select("p_partkey")


@register("SELECT s_suppkey FROM supplier WHERE contains(lower(s_name || ' ' || 'https://example.org/' || s_suppkey), '#00000001')")
def free_text_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("address"), F.concat(F.lit("https://example.org/"), F.col("s_suppkey").cast("string")).alias("url"))
    return ListingQuery(text="#00000001").filter(rows).select("s_suppkey")


@register("""SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END ASC NULLS LAST, c_custkey)::INTEGER AS up,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END DESC NULLS LAST, c_custkey)::INTEGER AS down FROM customer""")
def sort_nulls_last(spark, sf_dir):
    """Ranks that the query's sort gives within each nation, in both directions."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("price"))
    rank = lambda q: F.row_number().over(L.Window.partitionBy("c_nationkey").orderBy(*q.order(ordinal="c_custkey")))
    q = ListingQuery()
    return rows.select("c_custkey", "c_nationkey", rank(q).alias("up"), rank(q.sort_by("price")).alias("down"))


@register("SELECT DISTINCT p_brand FROM part")
def facet_options(spark, sf_dir):
    return L.facet_options(read(spark, sf_dir, "part"), "p_brand")


@register("""WITH e AS (SELECT 'u' || c_custkey AS url, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END AS starred FROM customer WHERE c_custkey % 2 = 0),
f AS (SELECT DISTINCT 'u' || o_custkey AS url FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01')
SELECT f.url, coalesce(e.starred, '') AS starred, 'Active' AS status FROM f LEFT JOIN e USING (url)
UNION ALL SELECT url, starred, 'No Longer Listed' FROM e WHERE starred <> '' AND url NOT IN (SELECT url FROM f)""")
def carry_forward(spark, sf_dir):
    c = F.col("c_custkey")
    sheet = read(spark, sf_dir, "customer").filter(c % 2 == 0).select(F.concat(F.lit("u"), c.cast("string")).alias("url"), F.when(c % 3 == 0, "x").otherwise("").alias("starred"), c.alias("row_index"))
    fresh = read(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp")).select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url")).distinct()
    return L.carry_forward(L.latest_rows(sheet).drop("row_index"), fresh).select("url", "starred", "status")


@register("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE (rn - 1) % 3 = 1")
def shard_modulo(spark, sf_dir):
    return L.shard_modulo(read(spark, sf_dir, "orders"), 3, 1, ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "o_custkey")


@register("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE o_custkey % 5 = 0 OR rn <= o_custkey % 5")
def stated_limit(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("stated", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 5))
    return L.stated_limit(rows, "stated", ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "o_custkey")


@register("""WITH p AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL),
q AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT l_suppkey, l_linenumber, n FROM q WHERE before < 150""")
def soft_cap(spark, sf_dir):
    kept = L.soft_cap(read(spark, sf_dir, "lineitem"), 150, "l_linenumber", ["l_suppkey"])
    return kept.groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT page_id, (i - 1)::INTEGER AS pos, h[i] AS href FROM (
  SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages))""")
def anchor_scan(spark, sf_dir):
    return scan_anchors(read(spark, sf_dir, "pages"))


@register(BASE + """SELECT k AS p_partkey, 0::INTEGER AS pos, '/annonce-immobiliere/' || k AS url, price, rooms, sqm FROM c WHERE NOT on_request""")
def card_scan(spark, sf_dir):
    """Cards rendered as HTML pages, found again by their links and read; those without a price are no cards."""
    r = cards(spark, sf_dir)
    link = F.concat(F.lit('<a href="/annonce-immobiliere/'), F.col("p_partkey").cast("string"), F.lit('?src=x">Voir</a>'))
    body = F.concat(F.lit("<p>"), F.replace("rawText", F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    html = F.concat(F.lit("<div><section>"), body, F.lit("<div>"), link, F.lit("</div>"), link, F.lit('</section><aside><a href="/contact">9 €</a></aside></div>'))
    found = scan_cards(r.select("p_partkey", F.when(F.col("rawText").contains("€"), html).otherwise(F.replace(html, F.lit("9 €"), F.lit("9"))).alias("html")), PROFILES["DanielFeau"], "p_partkey")
    return X.parse_listing(r.drop("url", "rawText").join(found, "p_partkey")).select("p_partkey", "pos", "url", "price", "rooms", "sqm")


@register("SELECT page_id, split_part(url, '?', 1) AS url FROM pages")
def strip_query(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.strip_query(F.col("url")).alias("url"))


@register("SELECT split_part(split_part(url, '//', 2), '/', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def page_hosts(spark, sf_dir):
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return read(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT p_partkey, regexp_replace(p_name || p_type, '([a-z])([A-Z])', '\\1 \\2', 'g') AS text FROM part")
def deglue_text(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.deglue(F.concat("p_name", "p_type")).alias("text"))


@register(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(?:the|les|die)\b') AS common, regexp_matches(text, '(?i)\bidiot\b') AS rude FROM documents""")
def keyword_flags(spark, sf_dir):
    text = F.col("text")
    words = lambda w: text.rlike(rf"{P.I}{P.EDGE}(?:{w}){P.EDGE}")
    return read(spark, sf_dir, "documents").select("doc_id", words("the|les|die").alias("common"), words("idiot").alias("rude"))


@register("""SELECT user_id, rows, attempts, errors, CASE WHEN errors > 0 THEN 'timed out' ELSE '' END AS messages, CASE WHEN errors = attempts THEN 'failed' WHEN rows = 0 THEN 'empty' ELSE 'ok' END AS outcome FROM (
  SELECT user_id, sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 4 END)::BIGINT AS rows, count(*) AS attempts, count(*) FILTER (event_id % 5 = 0) AS errors FROM events GROUP BY user_id)""")
def location_outcomes(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).alias("n"), F.when(F.col("event_id") % 5 == 0, "timed out").alias("error"))
    return L.location_outcomes(e, "user_id", "n", "error").withColumn("messages", F.array_join("messages", "; "))


@register("""SELECT l_orderkey, max_by(l_suppkey, l_linenumber) FILTER (l_suppkey % 2 = 0) AS stated FROM (
  SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def last_stated(spark, sf_dir):
    pages = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"))
    pages = pages.withColumn("stated", F.when(F.col("s") % 2 == 0, F.col("s")))
    return L.last_stated(pages, ["l_orderkey"], "stated", "l_linenumber")


@register(BASE + """SELECT k AS p_partkey, CASE WHEN on_request THEN 'On request' ELSE price::VARCHAR END AS price_label,
  CASE WHEN on_request THEN 'On request' WHEN price <> 0 THEN format('{:,}', price) ELSE '—' END AS ui_price, coalesce(bedrooms::VARCHAR, '—') AS bedrooms,
  CASE WHEN furnished THEN 'Yes' WHEN NOT furnished THEN 'No' ELSE 'Not mentioned' END AS furnished, CASE WHEN furnished THEN 'Yes' WHEN NOT furnished THEN 'No' ELSE '' END AS furnished_sheet,
  CASE WHEN price > 0 THEN price::DOUBLE / sqm END AS per_sqm, CASE WHEN rooms = 1 THEN '1 listing' ELSE rooms || ' listings' END AS n FROM c""")
def presentation_labels(spark, sf_dir):
    r = detailed(parsed(spark, sf_dir, "price", "priceOnRequest", "bedrooms", "rooms", "sqm"))
    price, asked = F.col("price"), F.col("priceOnRequest")
    return r.select(
        "p_partkey", V.price_label(price, asked).alias("price_label"), V.ui_price(price, asked).alias("ui_price"), V.or_blank(F.col("bedrooms"), "—").alias("bedrooms"),
        V.yes_no(F.col("f.furnished")).alias("furnished"), V.yes_no(F.col("f.furnished"), "").alias("furnished_sheet"), V.price_per_sqm(price, F.col("sqm")).alias("per_sqm"), V.count_text(F.col("rooms")).alias("n"),
    )


@register(BASE + """SELECT 'x' AS "Starred", 'Active' AS "Status", source AS "Source", CASE WHEN on_request THEN 'On request' ELSE price::VARCHAR END AS "Price (€)",
  coalesce(bedrooms::VARCHAR, '') AS "Bedrooms", coalesce(bathrooms::VARCHAR, '') AS "Bathrooms", sqm::VARCHAR AS "m²", area AS "Area", address AS "Address",
  CASE WHEN elevator THEN 'Yes' ELSE 'No' END AS "Elevator", CASE WHEN furnished THEN 'Yes' WHEN NOT furnished THEN 'No' ELSE '' END AS "Furnished",
  CASE WHEN balcony THEN 'Yes' ELSE 'No' END AS "Balcony", 'https://example.org/' || k AS "URL" FROM c WHERE NOT share""")
def sheet_layout(spark, sf_dir):
    rows = detailed(located(spark, sf_dir)).withColumns({c: F.col(f"f.{c}") for c in ("elevator", "balcony", "furnished")})
    return V.sheet_rows(rows.withColumns({"starred": F.lit("x"), "status": F.lit("Active")}))


@register("""SELECT i::INTEGER AS arrondissement, 'paris-' || CASE WHEN i = 1 THEN '1er' ELSE i || 'eme' END || '-arrondissement-750' || lpad(i::VARCHAR, 2, '0') AS slug, '750' || lpad(i::VARCHAR, 2, '0') AS postal,
  'ad09fr' || (25 + i) AS "geoCode", CASE WHEN i = 1 THEN 'Paris 1er' ELSE 'Paris ' || i || 'ème' END AS "displayName", count(*) AS n_customers FROM (SELECT c_custkey % 20 + 1 AS i FROM customer) GROUP BY i""")
def arrondissement_dim(spark, sf_dir):
    """The generated arrondissements, with the customers dealt to each."""
    dealt = read(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 20 + 1).cast("int").alias("arrondissement")).agg(F.count(F.lit(1)).alias("n_customers"))
    return dims.with_known(dealt, dims.arrondissement_dim(spark), "arrondissement").select("arrondissement", "slug", "postal", "geoCode", "displayName", "n_customers")


@register(f"""SELECT p_partkey, s AS slug, array_to_string(list_transform(string_split(s, '-'), lambda w, i:
  CASE WHEN i > 1 AND w IN ('sur', 'en', 'la', 'le', 'les', 'de', 'des', 'du', 'et', 'd''') THEN w ELSE upper(w[1]) || w[2:] END), '-') AS name
FROM (SELECT p_partkey, {dims.LOCATION_SLUGS}[p_partkey % {len(dims.LOCATION_SLUGS)} + 1] AS s FROM part)""")
def all_slug_names(spark, sf_dir):
    """Parts dealt to all location slugs, by name."""
    rows = read(spark, sf_dir, "part").select("p_partkey", pick(dims.LOCATION_SLUGS, F.col("p_partkey")).alias("slug"))
    return rows.select("p_partkey", "slug", X.slug_to_display(F.col("slug")).alias("name"))


@register("SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 0 THEN NULL ELSE round(100 * (n_nationkey // 2)::DOUBLE / n_nationkey, 1) END AS percent FROM nation")
def coverage(spark, sf_dir):
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name", L.coverage_percent(F.floor(n / 2), n).alias("percent"))


@register(BASE + """SELECT k AS ordinal, 'https://example.org/' || k AS url, price, rooms, sqm, area FROM c
WHERE NOT share AND area IN ('Paris 16e', 'Paris 8e', 'Suresnes', 'Le Vésinet') AND price >= 1000""")
def flagship_listings(spark, sf_dir):
    return flagship(spark, sf_dir)


@register("""SELECT count(DISTINCT h) AS n_hrefs FROM (SELECT unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS h FROM pages)""")
def distinct_hrefs(spark, sf_dir):
    return L.distinct_hrefs(scan_anchors(read(spark, sf_dir, "pages")))


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def row_cap(spark, sf_dir):
    """The hard limit of a source: its first 200 rows in order."""
    return L.first_n(read(spark, sf_dir, "orders"), 200, [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "o_totalprice")


@register("""SELECT page_id, page_id % 5 IN (1, 3) OR length(html) < 2000 AS blocked, length(html) < 500 AS short FROM pages""")
def page_flags(spark, sf_dir):
    status = F.when(F.col("page_id") % 5 == 1, 403).when(F.col("page_id") % 5 == 3, 429).otherwise(200)
    return read(spark, sf_dir, "pages").select("page_id", L.blocked(status, F.col("html")).alias("blocked"), L.short_page(F.col("html")).alias("short"))


@register("""SELECT o_orderkey, 'https://www.seloger.com/classified-search?distributionTypes=' || CASE WHEN o_orderkey % 2 = 0 THEN 'Buy' ELSE 'Rent' END || '&estateTypes=Apartment&locations=AD09FR' || (26 + o_custkey % 20) || '&page=' || (o_orderkey % 30 + 1) AS url FROM orders""")
def page_urls(spark, sf_dir):
    """Orders as visits of result pages: their customer's arrondissement, search type and page make the address."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20 + 1).cast("int").alias("arrondissement"), F.when(F.col("o_orderkey") % 2 == 0, "sale").otherwise("rent").alias("kind"), (F.col("o_orderkey") % 30 + 1).alias("page"))
    rows = dims.with_known(rows, dims.arrondissement_dim(spark), "arrondissement")
    return rows.select("o_orderkey", X.page_url("SeLoger", F.col("kind"), geo=F.col("geoCode"), page=F.col("page")).alias("url"))


@register(BASE + """SELECT k AS p_partkey, CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 50 WHEN 3 THEN 75 ELSE 100 END AS match_score, k % 5 > 2 AS is_exact, CASE k % 5 WHEN 2 THEN 900 WHEN 3 THEN 900 WHEN 4 THEN 900 ELSE 0 END AS price,
  CASE WHEN k % 5 > 1 THEN '900' ELSE '' END AS sheet, CASE WHEN k % 5 > 1 THEN '900' ELSE '—' END AS shown FROM c""")
def match_scores(spark, sf_dir):
    """Cards that say nothing, the street, also a price, also the rooms, also the surface; an unknown price is blank in the sheet and a dash on the page."""
    said = ["", "12 rue de la Paix", "\n900 €/mois", "\nT3", "\n60 m²"]
    k = F.col("p_partkey") % 5
    text = F.concat(*[F.when(k >= i, s).otherwise("") for i, s in enumerate(said)])
    rows = X.parse_listing(cards(spark, sf_dir).withColumn("rawText", text))
    price, asked = F.col("price"), F.col("priceOnRequest")
    return rows.select("p_partkey", F.col("matchScore").alias("match_score"), F.col("isExactListing").alias("is_exact"), "price", V.sheet_price(price, asked).alias("sheet"), V.ui_price(price, asked).alias("shown"))


@register("""SELECT n_nationkey, CASE WHEN n_nationkey % 7 IN (1, 3) THEN true WHEN n_nationkey % 7 = 2 THEN false END AS furnished FROM nation""")
def category_flags(spark, sf_dir):
    """Categories that say whether their flats are furnished."""
    n = F.col("n_nationkey") % 7
    name = F.when(n.isin(1, 3), "furnished").when(n == 2, "unfurnished").otherwise("sale")
    return read(spark, sf_dir, "nation").select("n_nationkey", X.furnished_from_category(name).alias("furnished"))


@register(BASE + """SELECT k AS p_partkey, 'Junot' AS source, kind_of AS "searchType", true AS "isExactListing", CASE WHEN k % 3 = 0 THEN 'Puteaux' ELSE address END AS address, area FROM (
  SELECT * REPLACE (CASE WHEN k % 3 = 0 THEN 'Puteaux' ELSE area END AS area) FROM c)""")
def stamped_listings(spark, sf_dir):
    """Cards of a source with its constants; where the town searched is known, it is the address, and so the area."""
    rows = parsed(spark, sf_dir, "address", "isExactListing")
    out = L.stamp(rows.filter("searchType = 'rent'"), "Junot", "rent", F.when(F.col("p_partkey") % 3 == 0, "Puteaux"))
    out = out.unionByName(L.stamp(rows.filter("searchType = 'sale'"), "Junot", "sale", F.when(F.col("p_partkey") % 3 == 0, "Puteaux")))
    return X.with_area(out).select("p_partkey", "source", "searchType", "isExactListing", "address", F.col("normalizedArea.area").alias("area"))


@register(BASE + """SELECT k AS p_partkey, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false END AS furnished, bathrooms AS card_bathrooms,
  coalesce(bathrooms, (k % 3 + 1)::INTEGER) AS bathrooms FROM c""")
def category_listings(spark, sf_dir):
    """A source whose categories say what is furnished: neither card nor detail page changes that, but details fill bathrooms."""
    rows = X.settled(parsed(spark, sf_dir, "rooms", "bedrooms", "bathrooms"), card=X.detail_features(F.col("rawText")))
    category = F.element_at(F.array(*map(F.lit, ("furnished", "unfurnished", "sale", "other"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = L.stamp(rows.withColumn("card_bathrooms", F.col("bathrooms")), "ParisRental", "rent", category=category)
    details = detailed(cards(spark, sf_dir)).select("url", F.col("f").alias("detail"))
    return L.enrich(rows, details, L.policy_dim(spark)).select("p_partkey", "furnished", "card_bathrooms", "bathrooms")


@register("""SELECT p_partkey, p_partkey % 2 = 1 AND p_partkey % 3 < 2 AS gone FROM part""")
def english_sold_flags(spark, sf_dir):
    """Sale cards that say they are sold, or under preliminary agreement; the English rule."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("Flat, "), F.element_at(F.array(*map(F.lit, ("SOLD", "under preliminary sales agreement", "resold soldiers"))), (k % 3 + 1).cast("int")), F.lit("!"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 1, "sale").otherwise("rent").alias("searchType"), text.alias("rawText"))
    left = L.drop_sold(rows, P.SOLD_EN).select("p_partkey", F.lit(True).alias("__left"))
    return rows.join(left, "p_partkey", "left").select("p_partkey", F.col("__left").isNull().alias("gone"))


@register("""SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def pages_first_wins(spark, sf_dir):
    """A source's pages in turn: the first page that shows a listing keeps it."""
    rows = read(spark, sf_dir, "lineitem").withColumn("pos", F.struct("l_orderkey", "l_partkey"))
    return L.first_pages(rows, "l_linenumber", "pos", "l_suppkey").select("l_orderkey", "l_suppkey", "l_linenumber")


@register("""SELECT l_orderkey, n BETWEEN 1 AND 9 AS short_last_page FROM (
  SELECT l_orderkey, sum(l_quantity) FILTER (l_linenumber = m)::BIGINT AS n FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY l_orderkey)""")
def short_last_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("n"))
    return L.short_last_page(pages, ["l_orderkey"], "n", "l_linenumber")


@register("""SELECT n_nationkey, n_nationkey || ' listings · updated 0' || (1 + n_nationkey % 9) || '/07/2001, 10:00:00' AS line FROM nation""")
def meta_lines(spark, sf_dir):
    n = F.col("n_nationkey")
    when = F.make_timestamp(F.lit(2001), F.lit(7), (1 + n % 9).cast("int"), F.lit(10), F.lit(0), F.lit(0))
    return read(spark, sf_dir, "nation").select("n_nationkey", X.meta_line(n, when).alias("line"))


@register(BASE + """SELECT source AS "Source", CASE WHEN on_request THEN 'On request' ELSE price::VARCHAR END AS "Price (€)", rooms AS "Rooms", bathrooms AS "Bathrooms", sqm AS "m²",
  CASE WHEN price > 0 THEN price::DOUBLE / sqm END AS "€/m²", address AS "Address", CASE WHEN elevator THEN 'Yes' ELSE 'No' END AS "Elevator", CASE WHEN balcony THEN 'Yes' ELSE 'No' END AS "Balcony",
  CASE WHEN furnished THEN 'Yes' WHEN NOT furnished THEN 'No' ELSE 'Not mentioned' END AS "Furnished", 'https://example.org/' || k || '?src=x' AS "URL" FROM c""")
def workbook_layout(spark, sf_dir):
    rows = detailed(parsed(spark, sf_dir)).withColumns({c: F.col(f"f.{c}") for c in ("elevator", "balcony", "furnished")})
    return V.write_workbook(rows)


from . import workflows  # noqa: E402, F401  registers its queries here
