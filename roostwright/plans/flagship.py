"""The flagship query: cards in; parsed, merged, located, filtered and sorted listings out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_listing, strip_query, with_area
from ..operators import listings as L
from ..operators.query import ListingQuery
from .cards import cards


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_listing(cards(spark, sf_dir).withColumn("url", strip_query(F.col("url"))))
    rows = L.drop_room_shares(L.first_wins(rows, "url", ["p_partkey"]))
    return with_area(rows)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = ListingQuery(areas=frozenset({"Paris 16e", "Paris 8e", "Suresnes", "Le Vésinet"}), min_price=1000)
    return query.run(located(spark, sf_dir).withColumn("ordinal", F.col("p_partkey"))).select("ordinal", "url", "price", "rooms", "sqm", F.col("normalizedArea.area").alias("area"))
