"""Listing cards rendered from the driver's part table, so that the parser has text whose right reading is known in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suburbs by turns, in the alias table's spelling.
SUBURBS = ["Suresnes", "Puteaux", "Levallois-Perret", "Le Vésinet", "Nanterre"]

def pick(options: list[Column | str], n: Column) -> Column:
    return F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), (n % len(options) + 1).cast("int"))


def price_value() -> Column:
    return ((F.floor(F.col("p_retailprice") * 100).cast("long") * F.col("p_size")) % 9_000_000 + 500).cast("int")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores if its files make fewer splits than that: parsing is dear, and a small file would be one task. Larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, source, searchType, url, rawText, detailText."""
    key = F.col("p_partkey")
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    s = lambda c: c.cast("string")
    number = F.replace(F.format_number(price_value(), 0), F.lit(","), pick([" ", " ".replace(" ", chr(0xA0)), ",", "."], key))
    price = pick([F.concat(number, F.lit(" €/month")), F.concat(F.lit("€ "), number, F.lit(" / mois")), F.concat(number, F.lit(" €")), F.concat(F.lit("€"), number), F.lit("Prix sur demande")], key)
    rooms = key % 6 + 1
    room = pick([F.concat(F.lit("T"), s(rooms)), F.concat(s(rooms), F.lit(" pièces")), F.concat(s(rooms), F.lit(" rooms"))], key)
    bed = F.when(key % 4 < 2, F.concat(s(key % 5 + 1), pick([" chambres", " bedrooms"], key)))
    bath = pick([F.lit("une salle de bains"), F.lit("2 bathrooms"), F.lit(None).cast("string")], key)
    area = F.concat(s(F.col("p_size") + 20), pick([" m²", ",5 m²", " m2"], key))
    arr = s(key % 20 + 1)
    paris = pick(
        [F.concat(F.lit("Paris "), arr, F.lit("e")), F.concat(F.lit("Paris "), arr, F.lit("ème")), F.concat(F.lit("Paris "), arr, F.lit("th")), F.concat(F.lit("PARIS "), arr, F.lit("EME ARRONDISSEMENT")), F.concat(F.lit("Paris "), arr), F.concat(F.lit("Dans le (750"), F.lpad(arr, 2, "0"), F.lit(")"))],
        key % 8,
    )
    first = F.when(key % 8 == 6, pick(SUBURBS, key)).when(key % 8 == 7, "12 rue de la Paix")
    share = F.when(key % 9 == 0, "Colocation")
    sold = F.when(key % 11 == 0, "vendu")
    raw = F.concat_ws("\n", F.lit("Exclusivité"), first, room, bed, bath, area, price, share, sold, F.when(key % 8 < 6, paris))
    detail = F.concat_ws(
        ". ", pick(["Ascenseur", "sans ascenseur", "Lift", "no lift", "rien"], key), pick(["balcon", "balcons", "balcony"], key), pick(["meublé", "non meublé", "Unfurnished", "furnished", "vide"], key),
        F.concat(s(key % 3 + 1), F.lit(" salles de douche")), F.concat(s(key % 4 + 1), F.lit(" chambres")),
    )
    return part.select(
        "p_partkey", "p_size", pick(["Barnes", "SeLoger", "Junot", "DanielFeau"], key).alias("source"), pick(["rent", "sale"], key).alias("searchType"),
        F.concat(F.lit("https://example.org/"), s(key), F.lit("?src=x")).alias("url"), raw.alias("rawText"), detail.alias("detailText"),
    )
