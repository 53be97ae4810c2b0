"""Queries that go the whole way: files written, damaged and read back, sheets synced again, pages followed until they end. Their inputs are rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import listings as L
from ..operators import present as V
from ..operators.combine import combine, dataset_meta, merge_folder, sync_sheets
from ..operators.query import ListingQuery
from ..operators.sheets import Sheets
from ..session import new_folder, written
from ..sources import artifacts as A
from ..sources import dims
from ..sources.html import PROFILES, scan_cards
from .cards import cards, pick
from .registry import BASE, parsed, read, register

#: Listings of one artifact, and what the jobs are: the first is the main file, the next two are agencies, the others take turns.
PER_JOB = 50
TURNS = ["suburb towns", "arrondissements", "categories", "suburb towns", "categories"]
TOWNS = [t[0] for t in dims.TOWNS]


def jobs_sql(broken: bool) -> str:
    """The jobs' files by name, and what the merge keeps of them."""
    error = f"CASE WHEN j % 7 = 3 THEN '{A.NO_JSON}' WHEN j % 7 = 4 THEN '{A.NO_TEXT}' WHEN j % 7 = 5 THEN '{A.NO_ENVELOPE}' WHEN j % 7 = 6 THEN 'timed out' END" if broken else "NULL"
    return f"""
WITH l AS (SELECT p_partkey AS k, p_partkey // {PER_JOB} AS j, 'u' || (p_partkey * 7 % 1000 + p_partkey // 1000 * 900) AS url FROM part),
n AS (
  SELECT j, CASE j WHEN 0 THEN 'main' WHEN 1 THEN 'Junot' WHEN 2 THEN 'DanielFeau' ELSE {TURNS}[j % 5 + 1] END AS grp, {TOWNS}[j % 21 + 1] AS slug, j % 20 + 1 AS arr,
    ['furnished', 'unfurnished'][j % 2 + 1] AS category FROM (SELECT DISTINCT j FROM l)
), a AS (
  SELECT *, CASE grp WHEN 'main' THEN 'output-main.json' WHEN 'Junot' THEN 'output-junot.json' WHEN 'DanielFeau' THEN 'output-danielfeau.json' WHEN 'suburb towns' THEN 'output-seloger-' || slug || '-shard-' || j || '.json'
      WHEN 'arrondissements' THEN 'output-seloger-arr-' || arr || '-shard-' || j || '.json' ELSE 'output-parisrental-' || category || '-' || j || '.json' END AS artifact,
    CASE grp WHEN 'main' THEN 0 WHEN 'suburb towns' THEN 1 WHEN 'arrondissements' THEN 2 WHEN 'categories' THEN 3 WHEN 'DanielFeau' THEN 4 ELSE 6 END AS src_rank,
    CASE grp WHEN 'main' THEN 'Barnes' WHEN 'suburb towns' THEN 'SeLoger-Suburb-' || slug WHEN 'arrondissements' THEN 'SeLoger-Paris-' || arr || 'e' WHEN 'categories' THEN 'ParisRental-' || category ELSE grp END AS source,
    {error} AS error FROM n
), m AS (
  SELECT * FROM (SELECT l.*, a.artifact, a.src_rank, row_number() OVER (PARTITION BY url ORDER BY src_rank, artifact, k) AS rn FROM l JOIN a USING (j) WHERE error IS NULL) WHERE rn = 1 OR src_rank = 0
)"""


def rendered_jobs(spark, sf_dir: str):
    """(listings with job and pos, jobs) from part: PER_JOB listings a job, so the files grow in number with the table."""
    k, job = F.col("p_partkey"), F.floor(F.col("p_partkey") / PER_JOB).cast("int")
    part = read(spark, sf_dir, "part")
    url = F.concat(F.lit("u"), (k * 7 % 1000 + F.floor(k / 1000) * 900).cast("string"))
    rows = part.select(job.alias("job"), k.alias("pos"), url.alias("url"), F.col("p_size").alias("price"), F.lit("Paris 5e").alias("address"), (k % 9 == 0).alias("isRoomShare"))
    j = F.col("job")
    group = F.when(j == 0, "main").when(j == 1, "Junot").when(j == 2, "DanielFeau").otherwise(pick(TURNS, j))
    told = F.array(F.struct(F.lit("Barnes").alias("source"), F.lit(PER_JOB).alias("found"), F.lit(None).cast("string").alias("error")))
    jobs = rows.select("job").distinct().select(
        "job", group.alias("group"), pick(TOWNS, j).alias("slug"), (j % 20 + 1).alias("arrondissement"), pick(["furnished", "unfurnished"], j).alias("category"), j.alias("page"), j.alias("shard"),
        F.when(j % 7 == 6, "timed out").alias("error"), told.alias("sourceStatus"),
    )
    return rows, jobs


@register(jobs_sql(True) + f""" SELECT source, artifact, CASE WHEN src_rank = 0 THEN {PER_JOB} WHEN error IS NULL THEN (SELECT count(*) FROM m WHERE m.artifact = a.artifact) ELSE 0 END AS found, error FROM a
UNION ALL SELECT 'Eiffel Housing', 'Eiffel Housing', 0, '{A.MISSING}'""")
def broken_artifacts(spark, sf_dir):
    """Jobs' envelopes as files, of which some are cut off, empty, or no envelopes; all merged, each with its status."""
    folder = new_folder(spark, "artifacts")
    spark.dataSource.register(A.EnvelopeSink)
    files = A.envelope_files(*rendered_jobs(spark, sf_dir), "rent")
    number = F.coalesce(F.regexp_extract("name", r"-(\d+)\.json$", 1).try_cast("int"), F.when(F.col("name") == "output-junot.json", 1).when(F.col("name") == "output-danielfeau.json", 2).otherwise(0)) % 7
    body = F.when(number == 3, F.left("body", F.lit(200))).when(number == 4, "").when(number == 5, F.concat(F.lit("["), "body", F.lit("]"))).otherwise(F.col("body"))
    files.select("name", body.alias("body")).write.format("envelopes").mode("append").save(folder)
    return merge_folder(spark, folder)[1].select("source", "artifact", "found", "error")


@register(jobs_sql(False) + """ SELECT m.url, p_size AS price, m.artifact, 'Paris 5e' AS area FROM m JOIN part ON p_partkey = m.k WHERE p_partkey % 9 <> 0""")
def artifact_round_trip(spark, sf_dir):
    """The jobs' files written and merged: listings in order of precedence, room shares gone, areas known."""
    folder = new_folder(spark, "artifacts")
    rows, jobs = rendered_jobs(spark, sf_dir)
    A.write_artifacts(rows, jobs.withColumn("error", F.lit(None).cast("string")), folder)
    return merge_folder(spark, folder)[0].select("url", "price", "artifact", F.col("normalizedArea.area").alias("area"))


@register("""
WITH RECURSIVE pg AS (
  SELECT run, loc, page, urls, row_number() OVER (PARTITION BY run ORDER BY loc, page) AS seq, lag(loc) OVER (PARTITION BY run ORDER BY loc, page) AS last_loc, lag(page) OVER (PARTITION BY run ORDER BY loc, page) AS last_page
  FROM (SELECT l_suppkey AS run, l_returnflag AS loc, l_linenumber AS page, list(DISTINCT l_quantity::BIGINT) AS urls FROM lineitem GROUP BY ALL)
), rec AS (
  SELECT run, 0::BIGINT AS seq, NULL::VARCHAR AS loc, 0 AS page, []::BIGINT[] AS seen, []::BIGINT[] AS fresh, true AS open FROM (SELECT DISTINCT run FROM pg)
  UNION ALL
  SELECT run, seq, loc, page, list_concat(seen, fresh) AS seen, fresh, visit AND len(fresh) > 0 AND len(seen) + len(fresh) < 45 AS open FROM (
    SELECT p.run, p.seq, p.loc, p.page, r.seen, p.last_loc IS DISTINCT FROM p.loc OR (r.open AND p.page = p.last_page + 1) AS visit,
      CASE WHEN p.last_loc IS DISTINCT FROM p.loc OR (r.open AND p.page = p.last_page + 1) THEN list_filter(p.urls, lambda u: NOT list_contains(r.seen, u)) ELSE [] END AS fresh
    FROM rec r JOIN pg p ON p.run = r.run AND p.seq = r.seq + 1)
) SELECT run AS l_suppkey, loc AS l_returnflag, page AS l_linenumber, len(fresh) AS n, list_sum(fresh)::BIGINT AS keys FROM rec WHERE len(fresh) > 0""")
def paged_listings(spark, sf_dir):
    """Line items as result pages: a supplier's run through its locations, listings being quantities; pages after one without new listings, or after 45, aren't seen."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber", "l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("url"))
    kept = L.visited_pages(rows, ["l_suppkey"], "l_returnflag", "l_linenumber", ["l_orderkey", "l_partkey"], "url", cap=45)
    return kept.groupBy("l_suppkey", "l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("url").alias("keys"))


@register("""WITH o AS (SELECT *, 'u' || o_custkey AS url FROM orders),
old AS (SELECT url, arg_max(floor(o_totalprice)::INTEGER::VARCHAR, o_orderkey) AS price, min(o_custkey) % 3 = 0 AS starred FROM o WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY url),
f AS (SELECT url, floor(o_totalprice)::INTEGER::VARCHAR AS price FROM o WHERE o_orderdate >= TIMESTAMP '2001-07-01')
SELECT url, starred, status, price, count(*) AS n FROM (
  SELECT f.url, CASE WHEN old.starred THEN 'x' ELSE '' END AS starred, 'Active' AS status, f.price FROM f LEFT JOIN old USING (url)
  UNION ALL SELECT url, 'x', 'No Longer Listed', price FROM old WHERE starred AND url NOT IN (SELECT url FROM f)
) GROUP BY ALL""")
def sheet_resync(spark, sf_dir):
    """Orders as listings with their customer's url, repeated on both sides: a sheet is made and marked, then synced with later orders, and once more."""
    sheets = Sheets(spark, new_folder(spark, "sheets"))
    o = read(spark, sf_dir, "orders")
    none = {c: F.lit(None).cast("boolean") for c in ("elevator", "furnished", "balcony")}
    rows = o.select(
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"), F.lit("Junot").alias("source"), F.floor("o_totalprice").cast("int").alias("price"), F.lit(False).alias("priceOnRequest"),
        F.lit(1).alias("bedrooms"), F.lit(1).alias("bathrooms"), F.lit(20.5).alias("sqm"), F.struct(F.lit("Puteaux").alias("area")).alias("normalizedArea"), F.lit("Puteaux").alias("address"), F.col("o_orderkey").alias("pos"), "o_orderdate",
    ).withColumns(none)
    at = lambda day: F.lit(day).cast("timestamp")
    later = rows.filter(F.col("o_orderdate") >= at("2001-07-01"))
    sync_sheets(sheets, rows.filter(F.col("o_orderdate") < at("2000-01-01")))
    customer = F.substr("url", F.lit(2)).cast("long")
    sheets.write("sheet1", sheets.read("sheet1").withColumn("starred", F.when(customer % 3 == 0, "x").otherwise("")))
    for _ in range(2):
        sync_sheets(sheets, later)
    return sheets.read("sheet1").groupBy("url", "starred", "status", "price").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS n_locations, coalesce(sum(CASE WHEN event_id % 5 <> 0 THEN event_id % 4 END), 0)::BIGINT AS n_rows, count(*) FILTER (event_id % 5 <> 0 AND event_id % 4 = 0) AS zero_result_count,
  coalesce(string_agg(event_type || ' (timed out ' || event_id % 3 || ')', ', ' ORDER BY event_id) FILTER (event_id % 5 = 0), '') AS failed FROM events GROUP BY ALL""")
def triage_runs(spark, sf_dir):
    """A user's day as a run, its events as locations: which failed, in order, and how many found nothing."""
    n = F.col("event_id")
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", "event_type", (n % 4).alias("n"), F.when(n % 5 == 0, F.concat(F.lit("timed out "), (n % 3).cast("string"))).alias("error"))
    return L.triage(e, ["user_id", "day"], ["event_id"], "event_type", "n", "error").withColumn("failed", F.array_join("failed", ", "))


@register(BASE + """SELECT source AS "Source", CASE WHEN on_request THEN 'On request' ELSE price::VARCHAR END AS "Price (€)", rooms AS "Rooms", bathrooms AS "Bathrooms", sqm AS "m²",
  CASE WHEN price > 0 THEN price::DOUBLE / sqm END AS "€/m²", address AS "Address", 'https://example.org/' || k || '?src=x' AS "URL" FROM c""")
def plain_workbook(spark, sf_dir):
    """Listings whose amenities nobody knows: the columns are there, but the workbook leaves them out."""
    none = {c: F.lit(None).cast("boolean") for c in ("elevator", "balcony", "furnished")}
    return V.write_workbook(parsed(spark, sf_dir).withColumns(none))


@register(BASE + """SELECT k AS p_partkey, CASE WHEN elevator THEN 'Yes' ELSE 'No' END AS "Elevator", CASE WHEN furnished THEN 'Yes' WHEN NOT furnished THEN 'No' ELSE '' END AS "Furnished" FROM c""")
def older_workbook(spark, sf_dir):
    """The older layout leaves unknown amenities blank."""
    rows = X.settled(parsed(spark, sf_dir), f=X.detail_features(F.col("detailText"))).withColumns({c: F.col(f"f.{c}") for c in ("elevator", "balcony", "furnished")})
    out = V.write_workbook(rows, unknown="")
    return out.select(F.regexp_extract("URL", r"/(\d+)\?", 1).cast("long").alias("p_partkey"), "Elevator", "Furnished")


@register("SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def first_details(spark, sf_dir):
    """A listing's details, fetched again and again: the first by their ordinal count."""
    details = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", F.struct("l_suppkey", "l_orderkey").alias("detail"))
    return L.first_details(details, "l_partkey", "l_orderkey").select("l_partkey", "detail.l_suppkey", "detail.l_orderkey")


@register("SELECT doc_id, md5(strip_accents(coalesce(text, ''))) AS plain_md5 FROM documents")
def plain_texts(spark, sf_dir):
    """All documents without accents."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip_accents(F.coalesce("text", F.lit("")))).alias("plain_md5"))


#: Each profile's links by page, and what its cards say; a link's own text has a price where that is tried first.
LINKS = {
    "Barnes": "/en/ref-{n}/france/paris?x=1", "SeLoger rent": "/annonces/locations/{n}?x=1", "SeLoger sale": "/annonces/achat/{n}?x=1", "Junot": "/fr/biens/{n}?x=1", "ParisRental furnished": "/furnished-apartments/flat-{n}",
    "ParisRental unfurnished": "/empty-apartments/flat-{n}/", "ParisRental sale": "/apartments-for-sale/flat-{n}", "DanielFeau": "/annonce-immobiliere/{n}?x=1", "Book-a-Flat": "/apartment-paris-{n}?x=1", "Perenium": "/fiche-{n}?x=1",
    "Eiffel Housing": "/en/properties/{n}?x=1",
}


@register(f"""WITH p AS (SELECT page_id, page_id % 11 AS i, length(html) AS size, {list(LINKS)}[page_id % 11 + 1] AS profile, replace({list(LINKS.values())}[page_id % 11 + 1], '{{n}}', page_id::VARCHAR) AS href FROM pages)
SELECT page_id, profile, 0::INTEGER AS pos, CASE WHEN i = 0 THEN href ELSE split_part(href, '?', 1) END AS url,
  CASE WHEN i = 8 THEN 'only 7 €' ELSE left('9 €' || chr(10) || 'page of ' || size || chr(10) || repeat('long ', 119) || 'long' || chr(10) || 'See', CASE WHEN i = 0 THEN 400 ELSE 500 END) END AS "rawText" FROM p""")
def card_profiles(spark, sf_dir):
    """Whole pages with a card put into each, read by eleven profiles in turn: their link forms, climbs, text caps, and which tries the link's own text first. Links that climb too far, or name no price, are no cards."""
    n = F.col("page_id")
    i = n % len(LINKS)
    href = F.replace(pick(list(LINKS.values()), n), F.lit("{n}"), n.cast("string"))
    own = F.when(i == list(LINKS).index("Book-a-Flat"), "only 7 €").otherwise("See")
    link = F.concat(F.lit('<a href="'), href, F.lit('">'), own, F.lit("</a>"))
    card = F.concat(F.lit("<section><p>9 €</p><p>page of "), F.char_length("html").cast("string"), F.lit("</p><p>" + "long " * 120 + "</p><div><div>"), link, F.lit("</div></div></section>"))
    far = F.concat(F.lit("<div>5 €" + "<div>" * 9), F.replace(link, F.concat(n.cast("string"), F.lit("")), F.concat(n.cast("string"), F.lit("999"))), F.lit("</div>" * 10))
    far = F.when(i == list(LINKS).index("Book-a-Flat"), "").otherwise(far)  # its own text names a price
    html = F.concat(F.lit("<main>"), card, F.lit("</main><article>"), far, F.lit("</article><aside>"), F.coalesce("html", F.lit("")), F.lit("</aside>"))
    rows = read(spark, sf_dir, "pages").select("page_id", html.alias("html"), pick(list(LINKS), n).alias("profile"))
    return scan_cards(rows, PROFILES, "page_id").join(rows.select("page_id", "profile"), "page_id").select("page_id", "profile", "pos", "url", "rawText")


@register("""SELECT n_nationkey, s AS slug, upper(left(s, 1)) || substr(s, 2) AS name, 'https://www.barnes-international.com/en/' || CASE WHEN n_nationkey % 2 = 0 THEN 'for-sale' ELSE 'for-rent' END || '/france/' || s || '-' || (75000 + n_nationkey) || '/' AS suburb_url,
  'https://www.junot.fr/fr/biens-immobiliers/' || CASE WHEN n_nationkey % 2 = 0 THEN 'acheter' ELSE 'louer' END || '/ile-de-france/' AS region_url FROM (SELECT *, lower(replace(n_name, ' ', '')) AS s FROM nation)""")
def place_addresses(spark, sf_dir):
    """Nations as towns: names from their slugs, and the result pages' addresses by source and deal."""
    n, slug = F.col("n_nationkey"), F.lower(F.replace("n_name", F.lit(" "), F.lit("")))
    kind = F.when(n % 2 == 0, "sale").otherwise("rent")
    return read(spark, sf_dir, "nation").select(
        "n_nationkey", slug.alias("slug"), X.slug_to_display(slug).alias("name"), X.page_url("Barnes suburbs", kind, slug=slug, postal=(75000 + n).cast("string")).alias("suburb_url"), X.page_url("Junot", kind).alias("region_url"),
    )


@register("""SELECT p_partkey, 'https://www.seloger.com/classified-search?distributionTypes=' || CASE WHEN p_size % 2 = 0 THEN 'Buy' ELSE 'Rent' END || '&estateTypes=Apartment&locations=AD09FR' || (25 + p_partkey % 20 + 1) || '&page=' || p_size AS url,
  '750' || lpad((p_partkey % 20 + 1)::VARCHAR, 2, '0') AS postal, CASE WHEN p_partkey % 20 = 0 THEN 'Paris 1er' ELSE 'Paris ' || (p_partkey % 20 + 1) || 'ème' END AS "displayName" FROM part""")
def part_places(spark, sf_dir):
    """Parts placed in the generated arrondissements, an unknown place being an error, with the address of the page that lists them."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 20 + 1).cast("int").alias("arrondissement"))
    placed = dims.with_known(rows, dims.arrondissement_dim(spark), "arrondissement")
    kind = F.when(F.col("p_size") % 2 == 0, "sale").otherwise("rent")
    return placed.select("p_partkey", X.page_url("SeLoger", kind, geo=F.col("geoCode"), page=F.col("p_size")).alias("url"), "postal", "displayName")


@register(f"""SELECT c_custkey, {TOWNS}[c_custkey % 21 + 1] AS slug, {[t[1] for t in dims.TOWNS]}[c_custkey % 21 + 1] AS postal FROM customer""".replace('"', "'"))
def customer_towns(spark, sf_dir):
    """Customers dealt to the towns by slug; a slug that isn't known would fail."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", pick(TOWNS, F.col("c_custkey")).alias("slug"))
    return dims.with_known(rows, dims.town_dim(spark)).select("c_custkey", "slug", "postal")


@register("""SELECT page_id, CASE WHEN page_id % 3 < 2 THEN page_id * 1000 + 12 END::INTEGER AS anywhere, CASE WHEN page_id % 3 = 0 THEN page_id * 1000 + 12 END::INTEGER AS at_start, CASE WHEN page_id % 3 < 2 THEN 1 ELSE 0 END AS said FROM pages""")
def stated_counts(spark, sf_dir):
    """How many offers a page says it has: in title and heading, or at the heading's start."""
    n = F.col("page_id")
    number = F.regexp_replace((n * 1000 + 12).cast("string"), r"(\d)(?=(\d{3})+$)", "$1 ")
    heading = F.when(n % 3 == 0, F.concat(number, F.lit(" annonces à Paris"))).when(n % 3 == 1, F.concat(F.lit("Paris : "), number, F.lit(" annonces"))).otherwise("Paris")
    rows = read(spark, sf_dir, "pages").select("page_id", heading.alias("h"))
    any_, start = X.stated_count(F.lit("Achat"), F.col("h"), False), X.stated_count(F.lit("Achat"), F.col("h"), True)
    return rows.select("page_id", any_.alias("anywhere"), start.alias("at_start"), F.when(any_.isNotNull(), 1).otherwise(0).alias("said"))


@register("""WITH r AS (SELECT s_suppkey, s_name AS address, s_suppkey % 3 = 0 AS furnished, CASE WHEN s_suppkey % 4 > 0 THEN 'Paris ' || s_suppkey % 4 || 'e' END AS area FROM supplier)
SELECT s_suppkey, row_number() OVER (ORDER BY coalesce(area, ''), s_suppkey)::INTEGER AS by_area, row_number() OVER (ORDER BY furnished DESC NULLS LAST, s_suppkey)::INTEGER AS by_furnished,
  row_number() OVER (ORDER BY address NULLS LAST, s_suppkey)::INTEGER AS by_address FROM r""")
def supplier_orders(spark, sf_dir):
    """The places that the sorts by area (none counts as ''), by a flag and by a text give."""
    n = F.col("s_suppkey")
    area = F.struct(F.when(n % 4 > 0, F.concat(F.lit("Paris "), (n % 4).cast("string"), F.lit("e"))).alias("area"))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("address"), (n % 3 == 0).alias("furnished"), area.alias("normalizedArea"))
    q = ListingQuery()
    for name, query in (("by_area", q.sort_by("area")), ("by_furnished", q.sort_by("furnished").sort_by("furnished")), ("by_address", q.sort_by("address"))):
        rows = _ranked(rows, query.order(ordinal="s_suppkey"), name)
    return rows.select("s_suppkey", "by_area", "by_furnished", "by_address")


def _ranked(rows, order, name: str):
    """rows with their places in this order: numbers within range partitions, after as many as the partitions before hold."""
    placed = rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    placed, _ = written(placed.withColumn("__part", F.shiftright("__id", 33)), "ranked")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(L.Window.orderBy("__part").rowsBetween(L.Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return placed.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("__part", "__id", "__n", "__before")


@register("""SELECT f AS source, CASE WHEN f = 'N' THEN 0 ELSE (SELECT count(*) FROM lineitem WHERE l_returnflag = f) END AS found, CASE WHEN f = 'N' THEN 'blocked' END AS error,
  (SELECT count(*) FROM lineitem WHERE l_returnflag IN ('A', 'R')) AS rows FROM (VALUES ('A'), ('N'), ('R')) t(f)""")
def combined_sources(spark, sf_dir):
    """Three sources combined, of which one fails half-way: its error is a row of the report, and the others' rows are counted as they are written."""
    def source(flag):
        rows = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).select("l_orderkey", "l_partkey")
        return rows if flag != "N" else rows.withColumn("l_partkey", F.when(F.col("l_orderkey") >= 0, F.raise_error(F.lit("blocked")).cast("long")))

    rows, status = combine(spark, {f: (lambda f=f: source(f)) for f in "ANR"})
    error = F.when(F.col("error").contains("blocked"), "blocked").otherwise(F.col("error"))
    return status.withColumns({"error": error, "rows": F.lit(rows.count())})


@register("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS min_price FROM customer WHERE CASE WHEN c_custkey % 5 = 0 THEN false ELSE c_acctbal <> 0 AND c_acctbal >= 1000 END AND list_contains([0, 3], c_nationkey % 4)")
def asked_customers(spark, sf_dir):
    """A query as a page would send it: facets switched on and off again, and numbers as text, empty ones asking for nothing."""
    q = ListingQuery(min_price=ListingQuery.number("1000"), max_price=ListingQuery.number("")).toggle_area("0").toggle_area("1").toggle_area("3").toggle_area("1")
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("price"), F.struct((F.col("c_nationkey") % 4).cast("string").alias("area")).alias("normalizedArea"))
    return q.filter(rows).select("c_custkey", F.col("price").alias("min_price"))


@register("""SELECT s AS source, found, NULL AS error, (SELECT count(*) FROM lineitem WHERE l_returnflag IN ('A', 'N')) AS rows FROM (
  SELECT 'A' AS s, count(*) AS found FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'given before', count(*) FROM lineitem WHERE l_returnflag = 'N')""")
def selected_sources(spark, sf_dir):
    """Two sources, of which one is not asked for, and rows that another job gave with their own status: they come first."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    of = lambda flag: rows.filter(F.col("l_returnflag") == flag)
    told = of("N").agg(F.count(F.lit(1)).alias("found")).select(F.lit("given before").alias("source"), "found", F.lit(None).cast("string").alias("error"))
    every, status = combine(spark, {"A": lambda: of("A"), "R": lambda: of("R")}, skip=frozenset({"R"}), external=of("N"), external_status=told)
    return status.withColumn("rows", F.lit(every.filter("src_order in (-1, 0)").count()))


@register("""SELECT count(*) AS total, 'sale' AS search_type, count(*) AS n_listings, count(DISTINCT p_brand) AS n_status, sum(p_size)::BIGINT AS prices FROM part WHERE p_partkey % 9 <> 0""")
def published_set(spark, sf_dir):
    """A published set written and read back: its totals, listings and status."""
    part = read(spark, sf_dir, "part")
    listings = L.drop_room_shares(part.select(F.col("p_partkey").alias("url"), F.col("p_size").alias("price"), F.lit("Paris 5e").alias("address"), "p_brand", (F.col("p_partkey") % 9 == 0).alias("isRoomShare")))
    status = listings.groupBy(F.col("p_brand").alias("source")).agg(F.count(F.lit(1)).alias("found")).withColumn("error", F.lit(None).cast("string"))
    folder = new_folder(spark, "published")
    V.publish(X.with_area(listings), status, folder, "parquet", dataset_meta(listings, "sale"))
    back = lambda name: spark.read.parquet(f"{folder}/{name}")
    n = back("listings").agg(F.count(F.lit(1)).alias("n_listings"), F.sum("price").alias("prices"))
    n = n.withColumn("searchType", F.lit("sale")).join(back("status").agg(F.count(F.lit(1)).alias("n_status")).withColumn("searchType", F.lit("sale")), "searchType")
    return back("meta").join(n, "searchType").select(F.col("totalListings").alias("total"), F.col("searchType").alias("search_type"), "n_listings", "n_status", "prices")
