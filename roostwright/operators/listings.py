"""Dedup, merge, enrichment and run-to-run state of listings, as joins, windows and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import furnished_from_category, merge_feature
from ..session import written


def first_wins(df: DataFrame, key: str, order: list[str], keep_all: Column | None = None) -> DataFrame:
    """The first row of each key by `order`; a null key is a key. Rows that meet keep_all stay beside it."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keep = F.col("__rn") == 1
    return df.withColumn("__rn", rn).filter(keep if keep_all is None else keep | keep_all).drop("__rn")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_sources(rows: DataFrame, key: str = "url", order: tuple[str, ...] = ("src_rank", "artifact", "pos")) -> DataFrame:
    """First-wins over all sources by precedence; rows of the main source (src_rank 0) are not deduped among themselves."""
    return first_wins(rows, key, list(order), F.col("src_rank") == 0)


def source_status(artifacts: DataFrame, merged: DataFrame, on: str = "artifact") -> DataFrame:
    """A row for each artifact, with the number of its rows that the merge kept, or its error."""
    kept = merged.groupBy(on).agg(F.count(F.lit(1)).alias("__n"))
    bad = F.coalesce("error", F.lit("")) != ""
    return artifacts.join(kept, on, "left").select(on, F.when(bad, 0).otherwise(F.coalesce("__n", F.lit(0))).cast("long").alias("found"), F.when(bad, F.col("error")).alias("error"))


def drop_room_shares(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce("isRoomShare", F.lit(False)))


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows with a price, a price on request or an address."""
    return df.filter((F.coalesce("price", F.lit(0)) > 0) | F.coalesce("priceOnRequest", F.lit(False)) | (F.coalesce("address", F.lit("")) != ""))


def drop_sold(df: DataFrame, pattern: str, text: str = "rawText", kind: str = "searchType") -> DataFrame:
    """Sale listings that say they are sold go; rent listings stay."""
    return df.filter(~((F.col(kind) == "sale") & F.coalesce(F.col(text).rlike(pattern), F.lit(False))))


def stamp(df: DataFrame, source: str, search_type: str, known_address: Column | None = None, category: Column | None = None) -> DataFrame:
    """Parsed cards as listings of a source: every card is an exact listing; the address of the place searched, where one is known, replaces the card's;
    a category that says whether its flats are furnished decides that column, and one that doesn't leaves it null."""
    out = {"source": F.lit(source), "searchType": F.lit(search_type), "isExactListing": F.lit(True)}
    if known_address is not None:
        out["address"] = F.coalesce(F.nullif(known_address, F.lit("")), F.col("address"))
    if category is not None:
        out["furnished"] = furnished_from_category(category)
    return df.withColumns(out)


# Fixed values, one row per source: amenities of the detail page override (coalesce: if not null, always: even if null, furnished: that one
# only, never, category: furnished is the listing's own), whether the card's own amenities are read, and whether detail bedrooms above the rooms are dropped.
POLICIES = [
    ("Barnes", "coalesce", True, True, False),
    ("Barnes suburbs", "never", True, True, False),
    ("SeLoger", "always", False, False, True),
    ("SeLoger suburbs", "coalesce", True, True, True),
    ("SeLoger arrondissements", "coalesce", True, True, True),
    ("Junot", "furnished", True, True, False),
    ("DanielFeau", "coalesce", True, True, False),
    ("Book-a-Flat", "coalesce", True, True, False),
    ("Perenium", "coalesce", True, True, False),
    ("Eiffel Housing", "never", True, False, False),
    ("ParisRental", "category", False, False, False),
]


def policy_dim(spark) -> DataFrame:
    return spark.createDataFrame(POLICIES, "source string, amenities string, card_amenities boolean, card_bedrooms boolean, guard boolean")


def first_details(details: DataFrame, key: str = "url", ordinal: str | None = None) -> DataFrame:
    """One `detail` for each key: the first by ordinal, and of those with one ordinal (or without any) the least; the same however the rows are dealt out."""
    order = F.struct(*([ordinal] if ordinal else []), "detail")
    return details.groupBy(key).agg(F.min_by("detail", order).alias("detail"))


def enrich(cards: DataFrame, details: DataFrame, policies: DataFrame, key: str = "url", ordinal: str | None = None) -> DataFrame:
    """cards (with source, rooms, bedrooms, bathrooms and a struct `card` of features) with elevator, balcony, furnished, bathrooms, bedrooms
    merged with the struct `detail` of details by the source's policy. A key's first detail by ordinal counts; sources without a policy fail.
    """
    one = first_details(details, key, ordinal)
    j = cards.join(F.broadcast(policies), "source", "left").join(one, key, "left")
    rule = F.when(F.col("amenities").isNull(), F.raise_error(F.concat(F.lit("no policy for source "), "source")).cast("string")).otherwise(F.col("amenities"))
    j = j.withColumn("amenities", rule)

    def amenity(name: str) -> Column:
        card = F.when(F.col("card_amenities"), F.col(f"card.{name}"))
        d = F.col(f"detail.{name}")
        coalesced = (F.col("amenities") == "coalesce") | ((F.col("amenities") == "furnished") & F.lit(name == "furnished"))
        if name == "furnished" and name in cards.columns:
            card = F.when(F.col("amenities") == "category", F.col(name)).otherwise(card)
        return F.when((F.col("amenities") == "always") & F.col("detail").isNotNull(), d).when(coalesced, merge_feature(d, card)).otherwise(card)

    own_bath = merge_feature(F.col("bathrooms"), F.when(F.col("card_amenities"), F.col("card.bathroomsFromDetail")))
    own_bed = merge_feature(F.col("bedrooms"), F.when(F.col("card_bedrooms"), F.col("card.bedroomsFromDetail")))
    bed = F.col("detail.bedroomsFromDetail")
    bed = F.when(F.col("guard") & (bed > F.col("rooms")), F.lit(None)).otherwise(bed)
    out = {"elevator": amenity("elevator"), "balcony": amenity("balcony"), "furnished": amenity("furnished"), "bathrooms": merge_feature(own_bath, F.col("detail.bathroomsFromDetail")), "bedrooms": merge_feature(own_bed, bed)}
    return j.select(*[c for c in cards.columns if c not in out and c != "card"], *[v.alias(k) for k, v in out.items()])


def latest_rows(sheet: DataFrame, key: str = "url", row: str = "row_index") -> DataFrame:
    """The last row of each non-empty key."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(row)))
    return sheet.filter(F.coalesce(key, F.lit("")) != "").withColumn("__rn", rn).filter("__rn = 1").drop("__rn")


def keyed_state(sheet: DataFrame, key: str = "url", row: str = "row_index") -> DataFrame:
    """A sheet's state: one row for each non-empty key, with the values of its last row at the place (`row`) of its first. An aggregate, so a key's rows are combined before they are shuffled."""
    rest = [c for c in sheet.columns if c not in (key, row)]
    one = sheet.filter(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.max_by(F.struct(*rest), row).alias("__last"), F.min(row).alias(row))
    return one.select(*[key if c == key else row if c == row else F.col("__last").getField(c).alias(c) for c in sheet.columns])


def carry_forward(existing: DataFrame, fresh: DataFrame, key: str = "url") -> DataFrame:
    """Fresh rows with the star that their key had, and starred rows that are gone marked as no longer listed; the others are dropped.

    existing has one row a key (keyed_state); fresh keys may repeat, and each row keeps the star.
    """
    stars = existing.filter(F.coalesce("starred", F.lit("")) != "")
    active = fresh.join(existing.select(key, "starred"), key, "left").withColumns({"starred": F.coalesce("starred", F.lit("")), "status": F.lit("Active")})
    gone = stars.join(fresh.select(key), key, "left_anti").withColumn("status", F.lit("No Longer Listed"))
    return active.unionByName(gone, allowMissingColumns=True)


def shard_modulo(df: DataFrame, n: int, k: int, order: list[str], within: list[str]) -> DataFrame:
    """Every n-th row from the k-th on of each `within`."""
    rn = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return df.withColumn("__rn", rn).filter((F.col("__rn") - 1) % n == k).drop("__rn")


def stated_limit(df: DataFrame, stated: str, order: list[str], within: list[str]) -> DataFrame:
    """The first rows of each `within`, as many as its page states; all where it states nothing."""
    rn = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return df.withColumn("__rn", rn).filter(F.col(stated).isNull() | (F.col("__rn") <= F.col(stated))).drop("__rn")


def soft_cap(df: DataFrame, cap: int, page: str, within: list[str]) -> DataFrame:
    """Whole pages, up to and with the one in which the count reaches the cap."""
    pages = df.groupBy(*within, page).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*within).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keep = pages.withColumn("__before", before).filter(F.col("__before") < cap).select(*within, page)
    return df.join(keep, [*within, page], "left_semi")


def visited_pages(rows: DataFrame, run: list[str], location: str, page: str, pos: list[str], key: str, cap: int | None = None) -> DataFrame:
    """The rows that paging through the locations of a run, one after another, would have taken: each key once, where it is first met.

    A location ends at its first page without new rows, at a page number that is missing, or once the run has `cap` rows, which is asked after each page; its
    first page is always seen. Keys are shared by all locations of the run, so a page's new rows depend on which pages were seen before: every round takes
    the pages seen by the last one, and is right for one location more, until nothing changes. A null key is a key.
    """
    where = [*run, location]
    first = rows.groupBy(*where, key).agg(F.min_by(F.struct(*rows.columns), F.struct(page, *pos)).alias("__row"))
    first, _ = written(first.select(*where, key, "__row", F.col(f"__row.{page}").alias(page)), "paging-rows")
    pages, _ = written(rows.groupBy(*where, page).agg(F.lit(True).alias("__seen")), "paging-pages")
    in_location = Window.partitionBy(*where).orderBy(page)
    before = in_location.rowsBetween(Window.unboundedPreceding, -1)
    while True:
        met = F.coalesce(F.max("__seen").over(Window.partitionBy(*run, key).orderBy(location).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        fresh = first.join(pages, [*where, page]).withColumn("__new", ~met)
        new = fresh.filter("__new").groupBy(*where, page).agg(F.count(F.lit(1)).alias("__n"))
        p = pages.join(new, [*where, page], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
        totals = p.groupBy(*where).agg(F.sum(F.when(F.col("__seen"), F.col("__n")).otherwise(0)).alias("__total"))
        earlier = Window.partitionBy(*run).orderBy(location).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*where, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
        gap = F.col(page) - F.first(page).over(in_location) != F.row_number().over(in_location) - 1
        p = p.join(totals, where).withColumn("__gap", gap).withColumn("__end", F.col("__gap") | (F.col("__n") == 0))
        ended = F.coalesce(F.max("__end").over(before), F.lit(False)) | F.col("__gap")
        full = F.lit(False) if cap is None else (F.row_number().over(in_location) > 1) & (F.col("__before") + F.coalesce(F.sum("__n").over(before), F.lit(0)) >= cap)
        changed = F.count_if(F.col("__seen") != F.col("__next"))
        after, seen = written(p.withColumn("__next", ~ended & ~full).select(*where, page, "__seen", "__next"), "paging-pages", changed=changed)
        pages = after.select(*where, page, F.col("__next").alias("__seen"))
        if not seen["changed"]:
            return fresh.filter("__seen and __new").select("__row.*")


def first_pages(df: DataFrame, page: str, pos: str, key: str = "url") -> DataFrame:
    """Dedup within a source over its pages."""
    return first_wins(df, key, [page, pos])


def location_outcomes(df: DataFrame, location: str, n_rows: str, error: str) -> DataFrame:
    """One row a location: rows, attempts, errors, their different texts in binary order, and its outcome (failed, empty or ok)."""
    bad = F.coalesce(error, F.lit("")) != ""
    g = df.groupBy(location).agg(F.sum(F.when(~bad, F.col(n_rows)).otherwise(0)).alias("rows"), F.count(F.lit(1)).alias("attempts"), F.count_if(bad).alias("errors"), F.array_sort(F.collect_set(F.when(bad, F.col(error)))).alias("messages"))
    return g.withColumn("outcome", F.when(F.col("errors") == F.col("attempts"), "failed").when(F.col("rows") == 0, "empty").otherwise("ok"))


def triage(df: DataFrame, run: list[str], order: list[str], label: str, n_rows: str, error: str) -> DataFrame:
    """One row a run of its locations (a row each): rows of those that worked, how many of them found nothing, and the failed ones as "label (error)" in the order of the input.

    The list holds failed locations only; a run has a few dozen.
    """
    bad = F.coalesce(error, F.lit("")) != ""
    said = F.concat(F.coalesce(F.col(label).cast("string"), F.lit("")), F.lit(" ("), F.col(error), F.lit(")"))
    failed = F.sort_array(F.collect_list(F.when(bad, F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], said.alias("said")))))
    return df.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n_locations"), F.coalesce(F.sum(F.when(~bad, F.col(n_rows))), F.lit(0)).cast("long").alias("n_rows"),
        F.count_if(~bad & (F.coalesce(n_rows, F.lit(0)) == 0)).alias("zero_result_count"), F.transform(failed, lambda x: x["said"]).alias("failed"),
    )


def last_stated(df: DataFrame, within: list[str], stated: str, page: str) -> DataFrame:
    """The stated count of the last page that has one."""
    return df.groupBy(*within).agg(F.max_by(stated, F.when(F.col(stated).isNotNull(), F.col(page))).alias("stated"))


def short_last_page(df: DataFrame, within: list[str], n: str, page: str) -> DataFrame:
    """Whether the last page holds fewer than ten rows, but some."""
    return df.groupBy(*within).agg(F.coalesce(F.max_by(n, page).between(1, 9), F.lit(False)).alias("short_last_page"))


def blocked(status: Column, text: Column) -> Column:
    return F.coalesce(status.isin(403, 429), F.lit(False)) | (F.char_length(F.coalesce(text, F.lit(""))) < 2000)


def short_page(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit(""))) < 500


def coverage_percent(kept: Column, stated: Column) -> Column:
    """With one decimal; null if nothing is stated."""
    return F.round(100 * F.try_divide(kept.cast("double"), stated.cast("double")), 1)


def facet_options(df: DataFrame, column: str) -> DataFrame:
    """The distinct values in binary order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def distinct_hrefs(df: DataFrame, href: str = "href") -> DataFrame:
    """The exact number of different links."""
    return df.agg(F.count_distinct(href).alias("n_hrefs"))


def first_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)

