"""Parsing: each input aims at one rule of the text functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roostwright.functions import text as X

NBSP, THIN = chr(0xA0), chr(0x202F)

PRICES = {
    "12 000 000 €": (12_000_000, False), "€ 17,000 / month": (17_000, False), "3 530 € / Mois (Charges comprises)": (3530, False), "50000 €/MONTH": (50_000, False),
    "825 € charges comprises par mois": (825, False), "Monthly rent €7,900": (7900, False), "10,000 €/month": (10_000, False), "Price upon request": (0, True),
    "Prix sur demande": (0, True), "150 000 000 €": (0, False), "1,500.50 €": (50, False), "€ 17,000 AED": (17, False), "Paris 16 900 €": (16_900, False),
    f"16{NBSP}900 €": (16_900, False), f"16{THIN}900 €": (16_900, False), "16.900 €": (16_900, False), "": (0, False), "no price": (0, False),
}
ROOMS = {
    "4 pièces2 chambres": (4, 2, None), "T3": (3, None, None), "T1": (1, 1, None), "2 bedrooms": (2, 2, None), "APPARTEMENT MEUBLE 4 PIECES": (4, None, None),
    "une salle de bains": (None, None, 1), "1 salle de douches": (None, None, None), "3 PIÈCES": (3, None, None),
}
SURFACES = {"85,5 m²": (85.5, 920), "1 234 m²": (1234.0, 13283), "T3 45 m²": (345.0, 3714), "70 m² + terrace 30 m2": (30.0, 323), "none": (None, None)}
AREAS = {
    "Paris 16ème": ("Paris 16e", "paris", 16), "Paris 16 (75016)": ("Paris 16e", "paris", 16), "PARIS 16EME ARRONDISSEMENT": ("Paris 16e", "paris", 16), "Paris 1er": ("Paris 1er", "paris", 1),
    "rue Newton Paris 16th": ("Paris 16e", "paris", 16), "rue Gutenberg 92": ("rue Gutenberg 92", "other", None), "Paris 16234": ("Paris 16234", "other", None),
    "Paris 2 200 €": ("Paris 2 200 €", "other", None), "LEVALLOIS-PERRET": ("Levallois-Perret", "suburb", None), "le vesinet": ("Le Vésinet", "suburb", None), "LE VÉSINET": ("Le Vésinet", "suburb", None),
    "La Celle-Saint-Cloud": ("Saint-Cloud", "suburb", None), "Ville-D-Avray": ("Ville-D-Avray", "other", None), "12 place 75012": ("Paris 12e", "paris", 12), "75116": ("75116", "other", None), "": ("Unknown", "unknown", None), "  ": ("Unknown", "other", None),
}
FLAGS = {
    "Unfurnished 1st floor with elevator": (True, False, False), "Ascenseur Balcon": (True, True, None), "appartement meublé": (False, False, True),
    "non meublé, sans ascenseur": (False, False, False), "balcons": (False, False, None), "": (False, False, None), "NON-MEUBLÉ no lift": (False, False, False),
}


def one_column(spark, texts, name="rawText"):
    return spark.createDataFrame([(t,) for t in texts], f"{name} string")


def test_prices(spark):
    got = {r.rawText: (r.price, r.priceOnRequest) for r in X.parse_listing(one_column(spark, PRICES)).collect()}
    assert got == PRICES


def test_rooms(spark):
    got = {r.rawText: (r.rooms, r.bedrooms, r.bathrooms) for r in X.parse_listing(one_column(spark, ROOMS)).collect()}
    assert got == ROOMS


def test_surfaces(spark):
    got = {r.rawText: (r.sqm, r.sqft) for r in X.parse_listing(one_column(spark, SURFACES)).collect()}
    assert got == SURFACES


def test_areas(spark):
    got = {r.a: tuple(r.n) for r in one_column(spark, AREAS, "a").select("a", X.normalize_area(F.col("a")).alias("n")).collect()}
    assert got == AREAS


def test_flags(spark):
    got = {r.t: (r.f.elevator, r.f.balcony, r.f.furnished) for r in one_column(spark, FLAGS, "t").select("t", X.detail_features(F.col("t")).alias("f")).collect()}
    assert got == FLAGS


def test_details(spark):
    f = one_column(spark, ["1 salle de douches, 3 chambres"], "t").select(X.detail_features(F.col("t")).alias("f")).collect()[0].f
    assert (f.bathroomsFromDetail, f.bedroomsFromDetail) == (1, 3)


@pytest.mark.parametrize(
    ("text", "address"),
    [
        ("PARIS 16EME ARRONDISSEMENT", "PARIS 16EME"), ("Paris 16ème (75016)", "Paris 16ème"), ("Appartement\n12 rue Cler, étage 2", "12 rue Cler"), ("vue\n75007 Paris|x", "75007 Paris"),
        ("Exclusivité\n3 / 14\n2 500 €\nref. 123456\nQuartier calme", "Quartier calme"), ("Appartement", "Appartement"), ("abc", ""), (None, ""),
    ],
)
def test_addresses(spark, text, address):
    assert X.parse_listing(one_column(spark, [text])).collect()[0].address == address


def test_whole_card(spark):
    r = X.parse_listing(one_column(spark, ["2 000 €\n50 m²\nT2\nColocation\nParis 5e"])).collect()[0]
    assert (r.price, r.sqm, r.pricePerSqm, r.matchScore, r.isExactListing, r.isRoomShare) == (2000, 50.0, 40, 100, True, True)


def test_parse_has_no_python_in_its_plan(spark):
    plan = X.parse_listing(one_column(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_scalars(spark):
    r = spark.range(1).select(
        X.strip_query(F.lit("a?b?c#d")).alias("u"), X.deglue(F.lit("aBcD")).alias("g"), X.slug_to_display(F.lit("ville-d-avray")).alias("v"), X.slug_to_display(F.lit("neuilly-sur-seine")).alias("n"),
        X.stated_count(F.lit("x 1 234 annonces"), F.lit(None), False).alias("s"), X.stated_count(F.lit(""), F.lit(" 12 appartements"), True).alias("h"), X.stated_count(F.lit(""), F.lit("plus de 12 maisons"), True).alias("m"),
    ).collect()[0]
    assert tuple(r) == ("a", "a Bc D", "Ville-D-Avray", "Neuilly-sur-Seine", 1234, 12, None)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 99_999_999), st.sampled_from([" ", NBSP, ",", "."])), min_size=1, max_size=20))
def test_rendered_prices_are_read_back(spark, rows):
    texts = [f"{p:,}".replace(",", sep) + " €" for p, sep in rows]
    got = [r.price for r in X.parse_listing(one_column(spark, texts)).collect()]
    assert got == [p for p, _ in rows]


def test_every_character_of_the_plane_loses_its_accents(spark):
    import unicodedata

    from roostwright.functions import text as X

    codes = [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1D15E, 0x1D1C0), 0x2F800, 0x1F600, 0x110AB]
    strip = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F)
    rows = [(i, "".join(f"x{chr(c)}" for c in codes[i : i + 64])) for i in range(0, len(codes), 64)] + [(-1, ""), (-2, None), (-3, "Ế Ǎ 각 가 é")]
    df = spark.createDataFrame(rows, "id int, t string").repartition(4)
    got = {r.id: r.p for r in df.select("id", X.strip_accents(F.col("t")).alias("p")).collect()}
    wrong = [(i, t, got[i]) for i, t in rows if got[i] != (None if t is None else strip(t))]
    assert not wrong, wrong[:2]
    assert got[-3] == "E A " + unicodedata.normalize("NFD", "각 가 é")[:-1]


def test_accents_take_a_few_passes(spark):
    """Texts without rare characters cost a few times what translating them does, whatever their script; each letter for each character of the class would be thirty times that. The class holds those characters and no others."""
    import time

    rare = {ord(c) for c in X._SEVERAL}
    near = sorted({n for c in rare for n in range(c - 2, c + 3) if not 0xD800 <= n < 0xE000})
    df = spark.createDataFrame([(c, chr(c)) for c in near], "c int, t string")
    assert {r.c for r in df.filter(F.col("t").rlike(X._RARE)).collect()} == rare
    script = "L'été où Noël arriva à Besançon, 漢字とひらかな, हिन्दी, кириллица, عربي. "
    texts = spark.range(0, 256, 1, 4).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit(script), 400)).alias("t")).localCheckpoint()

    def seconds(value):
        took = []
        for _ in range(4):  # the first ones are still being compiled
            start = time.perf_counter()
            texts.select(F.sum(F.hash(value))).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    t = F.col("t")
    assert seconds(X.strip_accents(t)) < 5 * seconds(F.translate(t, X._FROM, X._TO)) + 0.2
