"""Listing text to typed columns: native expressions only, so the whole parse stays in one JVM stage."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dims import SUBURB_ALIASES
from . import patterns as P


def once(value: Column, use) -> Column:
    """use(value), with value worked out once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, each worked out once a row, whatever reads them.

    They come out of a generator of one row, through which neither projections nor filters are inlined: a filter on a parsed
    column would otherwise repeat the whole parse in every predicate. Filters on other columns still go below it.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one (or with an empty one)."""
    return once(F.regexp_extract(text, pattern, group), lambda v: F.when(v != "", v))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{P.SPACE}+|{P.SPACE}+$", "")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def count_word(word: Column) -> Column:
    """`un` and `une` are 1."""
    return once(word, lambda w: F.when(F.lower(w).isin("un", "une"), F.lit(1)).otherwise(w.try_cast("int")))


def price(text: Column) -> Column:
    """Rent after or before the sign, then a sale price after or before it; 0 if there is none up to 100 million."""
    number = F.coalesce(*[found(text, p) for p in P.PRICES])
    value = F.regexp_replace(number, rf"[{P.THOUSANDS}]", "").try_cast("decimal(38,0)")
    return once(value, lambda v: F.when((v > 0) & (v <= 100_000_000), v.cast("int")).otherwise(F.lit(0)))


def surface(text: Column) -> Column:
    number = F.coalesce(*[found(text, p) for p in P.SURFACES])
    return F.replace(F.regexp_replace(number, rf"[{P.INLINE}]", ""), F.lit(","), F.lit(".")).try_cast("double")


def address(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), js_trim), lambda s: (F.char_length(s) > 5) & ~s.rlike(P.PHOTO_LINE))
    usable = lambda s: ~s.rlike(P.BADGE_LINE) & ~s.rlike(P.PRICE_LINE) & ~s.rlike(P.REFERENCE_LINE)
    by_line = once(lines, lambda x: F.coalesce(F.get(F.filter(x, usable), F.lit(0)), F.get(x, F.lit(0)), F.lit("")))
    by_pattern = F.coalesce(found(text, P.PARIS, 0), found(text, P.STREET), found(text, P.POSTAL))
    return F.coalesce(once(js_trim(by_pattern), lambda v: F.when(v != "", v)), by_line)


#: What each parsed column is made of; those in capitals are read from the text.
PARSED = {
    "price": ("PRICE", "ON_REQUEST"), "priceOnRequest": ("ON_REQUEST",), "pricePerSqm": ("PRICE", "ON_REQUEST", "SQM"), "rooms": ("ROOMS", "BEDROOMS"), "bedrooms": ("ROOMS", "BEDROOMS"),
    "bathrooms": ("BATHROOMS",), "sqm": ("SQM",), "sqft": ("SQM",), "address": ("ADDRESS",), "isRoomShare": ("ROOM_SHARE",),
    "matchScore": ("PRICE", "ON_REQUEST", "ROOMS", "BEDROOMS", "SQM", "ADDRESS"), "isExactListing": ("PRICE", "ON_REQUEST", "ROOMS", "BEDROOMS", "SQM", "ADDRESS"),
}


def parse_listing(df: DataFrame, raw: str = "rawText", columns: tuple[str, ...] = tuple(PARSED)) -> DataFrame:
    """df with the twelve parsed columns, or those asked for. Null and empty texts give the empty listing: price 0, address '', all else null or false."""
    text = F.col("__t")
    read = {
        "PRICE": price(text), "ON_REQUEST": text.rlike(P.ON_REQUEST), "ROOM_SHARE": text.rlike(P.ROOM_SHARE), "BEDROOMS": found(text, P.BEDROOMS).try_cast("int"),
        "ROOMS": F.coalesce(found(text, P.ROOMS, 1), found(text, P.ROOMS, 2)).try_cast("int"), "BATHROOMS": count_word(found(text, P.BATHROOMS)), "SQM": surface(text), "ADDRESS": address(text),
    }
    needed = {n for c in columns for n in PARSED[c]}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    t = settled(df.withColumn("__t", js_trim(F.coalesce(F.col(raw), F.lit("")))), **{f"__{n}": v for n, v in read.items() if n in needed})
    c = {n: F.col(f"__{n}") for n in read}
    asked, amount, sqm = c["ON_REQUEST"], F.when(c["ON_REQUEST"], F.lit(0)).otherwise(c["PRICE"]), c["SQM"]
    rooms = F.coalesce(c["ROOMS"], c["BEDROOMS"])
    score = sum((F.when(hit, 25).otherwise(0) for hit in ((amount > 0) | asked, rooms.isNotNull(), sqm.isNotNull(), F.char_length(c["ADDRESS"]) > 3)), F.lit(0))
    out = {
        "price": amount, "priceOnRequest": asked, "pricePerSqm": F.when((amount > 0) & (sqm > 0), round_half_up(F.try_divide(amount, sqm))), "rooms": rooms,
        "bedrooms": F.coalesce(c["BEDROOMS"], F.when(rooms == 1, F.lit(1))), "bathrooms": c["BATHROOMS"], "sqm": sqm, "sqft": F.when(sqm > 0, round_half_up(sqm * 10.764)),
        "address": F.substring(c["ADDRESS"], 1, 200), "isRoomShare": c["ROOM_SHARE"], "matchScore": score, "isExactListing": score >= 75,
    }
    return t.select(*kept, *[out[n].alias(n) for n in columns])


def with_area(df: DataFrame, address: str = "address") -> DataFrame:
    """df with the struct normalizedArea of its addresses."""
    return settled(df, normalizedArea=normalize_area(F.col(address)))


def detail_features(text: Column) -> Column:
    """Struct of elevator, balcony, furnished, bathroomsFromDetail, bedroomsFromDetail. Elevator and balcony are never null; furnished is null if not mentioned."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(
        (~t.rlike(P.NO_LIFT) & t.rlike(P.LIFT)).alias("elevator"),
        t.rlike(P.BALCONY).alias("balcony"),
        F.when(t.rlike(P.UNFURNISHED), F.lit(False)).when(t.rlike(P.FURNISHED), F.lit(True)).alias("furnished"),
        count_word(F.coalesce(*[found(t, p) for p in P.DETAIL_BATHROOMS])).alias("bathroomsFromDetail"),
        found(t, P.BEDROOMS).try_cast("int").alias("bedroomsFromDetail"),
    )


def merge_feature(preferred: Column, fallback: Column) -> Column:
    return F.coalesce(preferred, fallback)


_MARKS = r"[\u0300-\u036F]"


def plain(s: str) -> str:
    """s decomposed, without the marks U+0300 to U+036F."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F)


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """(characters that become one other, those others; characters that become several), but for Hangul syllables, which have a rule."""
    one, several = {}, {}
    for c in map(chr, (*range(0x80, 0x300), *range(0x370, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000), *range(0x10000, 0x20000), *range(0x2F800, 0x2FA20))):
        p = plain(c)
        if p != c:
            (one if len(p) == 1 else several)[c] = p
    return "".join(one), "".join(one.values()), several


def _one_of(codes: list[int]) -> str:
    """A character class of these ascending code points, halved again and again with each half behind its range: Java tries the members of a class one by one, for every character of a text."""
    if len(codes) <= 4:
        return "[" + "".join(f"\\x{{{c:X}}}" for c in codes) + "]"
    halves = codes[: len(codes) // 2], codes[len(codes) // 2 :]
    return "[" + "".join(f"[\\x{{{h[0]:X}}}-\\x{{{h[-1]:X}}}&&{_one_of(h)}]" for h in halves) + "]"


_FROM, _TO, _SEVERAL = _decomposed()
_SYLLABLE, _RARE = r"[\uAC00-\uD7A3]", _one_of(sorted(map(ord, _SEVERAL)))
_BY_LETTER = f"[{_SYLLABLE}{_RARE}]"


def _letter(code: Column) -> Column:
    """The character of a code point up to U+FFFF."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _jamo(syllable: Column) -> Column:
    """A Hangul syllable as its two or three letters, by the rule of their numbers."""
    n = F.conv(F.hex(F.encode(syllable, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    last = F.when(n % 28 > 0, _letter((n % 28 + 0x11A7).cast("long"))).otherwise("")
    return F.concat(_letter(F.floor(n / 588) + 0x1100), _letter(F.floor(n % 588 / 28) + 0x1161), last)


def strip_accents(text: Column) -> Column:
    """text decomposed, without the combining marks U+0300 to U+036F; other marks stay where they stand.

    ASCII stays as it is. What becomes one character is translated; syllables and characters that become several, which few texts have, are taken letter by letter.
    """
    rare = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    by_letter = lambda c: F.when(c.rlike(_SYLLABLE), _jamo(c)).when(c.rlike(_RARE), F.element_at(rare, c)).otherwise(c)
    spelt = F.when(text.rlike(_BY_LETTER), F.array_join(F.transform(F.split(text, ""), by_letter), "")).otherwise(text)
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.regexp_replace(F.translate(spelt, _FROM, _TO), _MARKS, ""))


def arrondissement_label(n: Column) -> Column:
    return F.when(n == 1, F.lit("Paris 1er")).otherwise(F.concat(F.lit("Paris "), n.cast("string"), F.lit("e")))


def suburb_of(low: Column) -> Column:
    """The first alias entry that the accent-free lower-case text contains."""
    out = None
    for canonical, aliases in SUBURB_ALIASES:
        hit = low.rlike("|".join(plain(a) for a in aliases))
        out = F.when(hit, F.lit(canonical)) if out is None else out.when(hit, F.lit(canonical))
    return out


def normalize_area(addr: Column) -> Column:
    """Struct of area, kind (unknown, paris, suburb, other) and arrondissement."""

    def number(text: Column) -> Column:
        got = [F.coalesce(found(text, p, 1), found(text, p, 2)) if i == 0 else found(text, p, 1) for i, p in enumerate(P.ARRONDISSEMENTS)]
        return F.coalesce(*[once(x.try_cast("int"), lambda n: F.when(n.between(1, 20), n)) for x in got])

    def area(text: Column, n: Column, suburb: Column) -> Column:
        unknown = F.coalesce(addr, F.lit("")) == ""
        return F.struct(
            F.when(unknown, "Unknown").when(n.isNotNull(), arrondissement_label(n)).when(suburb.isNotNull(), suburb).when(text == "", "Unknown").otherwise(text).alias("area"),
            F.when(unknown, "unknown").when(n.isNotNull(), "paris").when(suburb.isNotNull(), "suburb").otherwise("other").alias("kind"),
            n.alias("arrondissement"),
        )

    parts = lambda t: F.struct(t.alias("t"), number(t).alias("n"), once(strip_accents(F.lower(t)), suburb_of).alias("s"))
    return once(once(js_trim(F.coalesce(addr, F.lit(""))), parts), lambda x: area(x["t"], x["n"], x["s"]))


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def deglue(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")


def slug_to_display(slug: Column) -> Column:
    """Words of a slug capitalised, but for particles after the first word."""
    particles = ("sur", "en", "la", "le", "les", "de", "des", "du", "et", "d'")
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    return F.array_join(F.transform(F.split(slug, "-"), lambda w, i: F.when((i > 0) & w.isin(*particles), w).otherwise(cap(w))), "-")


def stated_count(title: Column, heading: Column, anchored: bool) -> Column:
    """The number of offers a page says it has: at the heading's start, or anywhere in title and heading."""
    got = found(F.coalesce(heading, F.lit("")), P.STATED_HEADING) if anchored else found(F.concat_ws(" ", title, heading), P.STATED_ANYWHERE)
    return F.regexp_replace(got, P.SPACE, "").try_cast("int")


def furnished_from_category(name: Column) -> Column:
    return F.when(name == "furnished", F.lit(True)).when(name == "unfurnished", F.lit(False))


# Result-page addresses by source; {deal} and {buy} depend on the search type.
PAGE_URLS = {
    "SeLoger": "https://www.seloger.com/classified-search?distributionTypes={buy}&estateTypes=Apartment&locations={geo}&page={page}",
    "Barnes suburbs": "https://www.barnes-international.com/en/{deal}/france/{slug}-{postal}/",
    "Junot": "https://www.junot.fr/fr/biens-immobiliers/{deal}/ile-de-france/",
}
DEALS = {"Barnes suburbs": ("for-sale", "for-rent"), "Junot": ("acheter", "louer"), "SeLoger": ("", "")}


def page_url(source: str, kind: Column, geo: Column | None = None, slug: Column | None = None, postal: Column | None = None, page: Column | None = None) -> Column:
    """The address of a location's result page."""
    sale, rent = DEALS[source]
    parts = {"buy": F.when(kind == "sale", "Buy").otherwise("Rent"), "deal": F.when(kind == "sale", sale).otherwise(rent), "geo": F.upper(geo) if geo is not None else None, "slug": slug, "postal": postal, "page": page.cast("string") if page is not None else None}
    out = F.lit(PAGE_URLS[source])
    for name, value in parts.items():
        if value is not None:
            out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def meta_line(total: Column, generated: Column) -> Column:
    return F.concat(total.cast("string"), F.lit(" listings · updated "), F.date_format(generated, "dd/MM/yyyy, HH:mm:ss"))
