"""Explicit schemas: listings are read with them, never inferred (an all-null column would become a string)."""

from __future__ import annotations

LISTING = (
    "url string, source string, searchType string, price int, priceOnRequest boolean, pricePerSqm bigint, rooms int, bedrooms int, bathrooms int, "
    "sqm double, sqft bigint, address string, matchScore int, isExactListing boolean, isRoomShare boolean, elevator boolean, balcony boolean, furnished boolean"
)
STATUS = "source string, found int, error string"
AREA = "area string, kind string, arrondissement int"


def as_struct(ddl: str) -> str:
    """A column list as a struct type."""
    return "struct<" + ", ".join("`{}`: {}".format(*c.split(" ", 1)) for c in ddl.split(", ")) + ">"


MAIN_ARTIFACT = f"searchType string, fetchDetails boolean, generatedAt string, totalListings int, sourceStatus array<{as_struct(STATUS)}>, listings array<{as_struct(LISTING)}>"
PART_ARTIFACT = (
    f"source string, searchType string, slug string, arrondissement int, category string, page int, listings array<{as_struct(LISTING)}>, error string, "
    "diagnostics struct<zeroResultCount: int, failedSlugs: array<string>>"
)
