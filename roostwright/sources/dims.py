"""Dimension tables that the listing queries look values up in; a few dozen rows each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical suburb names and how they are written, in the order in which they are tried.
SUBURB_ALIASES = [
    ("Neuilly-sur-Seine", ["neuilly-sur-seine", "neuilly sur seine", "neuilly"]),
    ("Boulogne-Billancourt", ["boulogne-billancourt", "boulogne billancourt", "boulogne"]),
    ("Levallois-Perret", ["levallois-perret", "levallois perret", "levallois"]),
    ("Rueil-Malmaison", ["rueil-malmaison", "rueil malmaison", "rueil"]),
    ("Suresnes", ["suresnes"]),
    ("Puteaux", ["puteaux"]),
    ("Saint-Cloud", ["saint-cloud", "saint cloud", "st-cloud", "st cloud"]),
    ("Saint-Germain-en-Laye", ["saint-germain-en-laye", "saint germain en laye", "st-germain-en-laye", "st germain en laye"]),
    ("Le Vésinet", ["le vésinet", "le vesinet"]),
    ("Vaucresson", ["vaucresson"]),
    ("Garches", ["garches"]),
    ("Marnes-la-Coquette", ["marnes-la-coquette", "marnes la coquette"]),
    ("Ville-d'Avray", ["ville-d'avray", "ville d avray", "ville-d avray"]),
    ("Versailles", ["versailles"]),
    ("Courbevoie", ["courbevoie"]),
    ("Issy-les-Moulineaux", ["issy-les-moulineaux", "issy les moulineaux", "issy"]),
    ("Colombes", ["colombes"]),
    ("Nanterre", ["nanterre"]),
    ("Chatou", ["chatou"]),
    ("Croissy-sur-Seine", ["croissy-sur-seine", "croissy sur seine"]),
    ("La Celle-Saint-Cloud", ["la celle-saint-cloud", "la celle saint cloud"]),
]

# Towns by slug, postal code, geo code and display name; the first thirteen are also the shorter list.
TOWNS = [
    ("neuilly-sur-seine", "92200", "ad08fr36623", "Neuilly-sur-Seine"),
    ("boulogne-billancourt", "92100", "ad08fr36603", "Boulogne-Billancourt"),
    ("suresnes", "92150", "ad08fr36630", "Suresnes"),
    ("levallois-perret", "92300", "ad08fr36617", "Levallois-Perret"),
    ("rueil-malmaison", "92500", "ad08fr36626", "Rueil-Malmaison"),
    ("puteaux", "92800", "ad08fr36625", "Puteaux"),
    ("saint-cloud", "92210", "ad08fr36627", "Saint-Cloud"),
    ("saint-germain-en-laye", "78100", "ad08fr37122", "Saint-Germain-en-Laye"),
    ("le-vesinet", "78110", "ad08fr32613", "Le Vésinet"),
    ("vaucresson", "92420", "ad08fr36632", "Vaucresson"),
    ("garches", "92380", "ad08fr36613", "Garches"),
    ("marnes-la-coquette", "92430", "ad08fr36619", "Marnes-la-Coquette"),
    ("ville-d-avray", "92410", "ad08fr36633", "Ville-d'Avray"),
    ("courbevoie", "92400", "ad08fr36611", "Courbevoie"),
    ("versailles", "78000", "ad08fr32611", "Versailles"),
    ("issy-les-moulineaux", "92130", "ad08fr36616", "Issy-les-Moulineaux"),
    ("colombes", "92700", "ad08fr36610", "Colombes"),
    ("nanterre", "92000", "ad08fr36622", "Nanterre"),
    ("chatou", "78400", "ad08fr32414", "Chatou"),
    ("croissy-sur-seine", "78290", "ad08fr32429", "Croissy-sur-Seine"),
    ("la-celle-saint-cloud", "78170", "ad08fr32408", "La Celle-Saint-Cloud"),
]

# Location slugs of the agency that lists by town.
HAUTS_DE_SEINE = [
    "asnieres-sur-seine", "bois-colombes", "boulogne-billancourt", "clamart", "clichy", "colombes", "courbevoie", "garches",
    "issy-les-moulineaux", "la-garenne-colombes", "levallois-perret", "marnes-la-coquette", "meudon", "nanterre", "neuilly-sur-seine",
    "puteaux", "rueil-malmaison", "saint-cloud", "sceaux", "sevres", "suresnes", "vanves", "vaucresson", "ville-d-avray",
]
YVELINES = [
    "aigremont", "bailly", "bougival", "chatou", "crespieres", "croissy-sur-seine", "feucherolles", "fourqueux", "la-celle-saint-cloud",
    "le-chesnay", "le-chesnay-rocquencourt", "le-mesnil-le-roi", "le-pecq", "le-vesinet", "louveciennes", "maisons-laffitte", "marly-le-roi",
    "maule", "montesson", "neauphle-le-chateau", "noisy-le-roi", "rambouillet", "saint-germain-en-laye", "saint-nom-la-breteche", "thoiry",
    "versailles", "viroflay",
]
LOCATION_SLUGS = ["paris", *HAUTS_DE_SEINE, *YVELINES]


def alias_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, a) for i, (c, a) in enumerate(SUBURB_ALIASES)], "ord int, canonical string, aliases array<string>")


def town_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOWNS, "slug string, postal string, geoCode string, displayName string")


def location_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in LOCATION_SLUGS], "slug string")


def arrondissement_dim(spark: SparkSession) -> DataFrame:
    """The twenty arrondissements, generated."""
    n = F.col("arrondissement")
    postal = F.concat(F.lit("750"), F.lpad(n.cast("string"), 2, "0"))
    ordinal = F.when(n == 1, F.lit("1er")).otherwise(F.concat(n.cast("string"), F.lit("eme")))
    name = F.when(n == 1, F.lit("Paris 1er")).otherwise(F.concat(F.lit("Paris "), n.cast("string"), F.lit("ème")))
    return spark.range(1, 21).select(F.col("id").cast("int").alias("arrondissement")).select(
        "arrondissement", F.concat(F.lit("paris-"), ordinal, F.lit("-arrondissement-"), postal).alias("slug"), postal.alias("postal"),
        F.concat(F.lit("ad09fr"), (n + 25).cast("string")).alias("geoCode"), name.alias("displayName"),
    )


def with_known(df: DataFrame, dim: DataFrame, on: str = "slug") -> DataFrame:
    """df with the dimension's columns; a slug that the dimension lacks fails the query. Dimensions here have at most a few dozen rows."""
    joined = df.join(F.broadcast(dim.withColumn("__known", F.lit(True))), on, "left")
    checked = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown location: "), F.coalesce(F.col(on).cast("string"), F.lit("null")))).cast(dict(df.dtypes)[on])).otherwise(F.col(on))
    return joined.withColumn(on, checked).drop("__known")
