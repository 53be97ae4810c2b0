"""Layouts and published forms."""

from pyspark.sql import functions as F

from roostwright.operators import present as V
from roostwright.operators.combine import dataset_meta
from roostwright.sources.html import cards, suburb_profile

LISTINGS = "source string, price int, priceOnRequest boolean, rooms int, bathrooms int, sqm double, address string, elevator boolean, balcony boolean, furnished boolean, url string"


def rows(spark, *lifts):
    return spark.createDataFrame([("Junot", 900, False, 2, 1, 30.0, "Puteaux", lift, None, None, f"u{i}") for i, lift in enumerate(lifts)], LISTINGS)


def test_published_sets_are_read_back(spark, tmp_path):
    listings = rows(spark, True, None).withColumn("normalizedArea", F.struct(F.lit("Puteaux").alias("area"), F.lit("suburb").alias("kind"), F.lit(None).cast("int").alias("arrondissement")))
    status = spark.createDataFrame([("Junot", 2, None), ("DanielFeau", 0, "late")], "source string, found long, error string")
    for _ in range(2):
        V.publish(listings, status, str(tmp_path), meta=dataset_meta(listings, "sale"))
    meta = spark.read.json(f"{tmp_path}/meta").collect()
    assert [(m.totalListings, m.searchType) for m in meta] == [(2, "sale")] and meta[0].generatedAt.endswith("Z")
    back = spark.read.schema(listings.schema).json(f"{tmp_path}/listings").orderBy("url").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in listings.orderBy("url").collect()]
    assert {(r.source, r.found, r.error) for r in spark.read.json(f"{tmp_path}/status").collect()} == {("Junot", 2, None), ("DanielFeau", 0, "late")}


def test_the_workbook_has_the_columns_that_the_data_fill(spark):
    plain = ["Source", "Price (€)", "Rooms", "Bathrooms", "m²", "€/m²", "Address"]
    amenities = ["Elevator", "Balcony", "Furnished"]
    assert V.write_workbook(rows(spark, None, None)).columns == [*plain, "URL"] == V.workbook_rows(rows(spark, None)).columns
    filled = V.write_workbook(rows(spark, None, True, False))
    assert filled.columns == [*plain, *amenities, "URL"] and [r.Elevator for r in filled.orderBy("URL").collect()] == ["Not mentioned", "Yes", "No"]
    assert V.write_workbook(rows(spark, True).drop("elevator", "balcony", "furnished")).columns == [*plain, "URL"]
    assert V.write_workbook(rows(spark, True).limit(0)).columns == [*plain, "URL"]


def test_listings_of_a_workbook_are_evaluated_once(spark):
    scanned = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            scanned.add(len(b))
            yield b

    source = rows(spark, True, None, False)
    assert V.write_workbook(source.mapInPandas(run, source.schema)).count() == 3 and scanned.value == 3


def test_column_letters_and_suburb_profiles():
    assert [V.column_letter(n) for n in (1, 13, 26)] == ["A", "M", "Z"]
    html = '<div><p>1 200 €</p><a href="/en/ref-7/france/suresnes?x=1">a</a><a href="/en/ref-8/france/paris">b</a></div>'
    assert [u for u, _ in cards(html, suburb_profile("suresnes"))] == ["/en/ref-7/france/suresnes?x=1"]
