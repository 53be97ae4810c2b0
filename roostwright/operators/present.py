"""Presentation: labels, layouts and published forms of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

SHEET = ["Starred", "Status", "Source", "Price (€)", "Bedrooms", "Bathrooms", "m²", "Area", "Address", "Elevator", "Furnished", "Balcony", "URL"]


def yes_no(c: Column, unknown: str = "Not mentioned") -> Column:
    return F.when(c, "Yes").when(~c, "No").otherwise(unknown)


def price_label(price: Column, on_request: Column) -> Column:
    return F.when(on_request, "On request").otherwise(price.cast("string"))


def sheet_price(price: Column, on_request: Column) -> Column:
    """An unknown price is blank."""
    return F.when(on_request, "On request").when(price != 0, price.cast("string")).otherwise("")


def ui_price(price: Column, on_request: Column) -> Column:
    return F.when(on_request, "On request").when(price != 0, F.format_number(price, 0)).otherwise("—")


def or_blank(c: Column, blank: str = "") -> Column:
    """Null only; 0 is shown."""
    return F.coalesce(c.cast("string"), F.lit(blank))


def price_per_sqm(price: Column, sqm: Column) -> Column:
    """Unrounded, where both are known."""
    return F.when((price > 0) & (sqm > 0), F.try_divide(price.cast("double"), sqm))


def status_line(source: Column, found: Column, error: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) != "", F.concat(source, F.lit(": FAILED — "), error)).otherwise(F.concat(source, F.lit(": "), found.cast("string"), F.lit(" listings")))


def count_text(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " listing").otherwise(" listings"))


def column_letter(width: int) -> str:
    return chr(64 + width)


def workbook_rows(df: DataFrame, details: bool | None = None, unknown: str = "Not mentioned") -> DataFrame:
    """The workbook's columns; amenities only if the data has them (details None: one pass asks it; write_workbook does without). Older workbooks leave unknown amenities blank."""
    details = has_details(df) if details is None else details
    cols = [F.col("source").alias("Source"), price_label(F.col("price"), F.col("priceOnRequest")).alias("Price (€)"), F.col("rooms").alias("Rooms"), F.col("bathrooms").alias("Bathrooms"), F.col("sqm").alias("m²"), price_per_sqm(F.col("price"), F.col("sqm")).alias("€/m²"), F.col("address").alias("Address")]
    if details:
        cols += [yes_no(F.col(c), unknown).alias(c.capitalize()) for c in ("elevator", "balcony", "furnished")]
    return df.select(*cols, F.col("url").alias("URL"))


def write_workbook(df: DataFrame, unknown: str = "Not mentioned") -> DataFrame:
    """The workbook's rows, of listings that are evaluated once: the pass that writes them into the shared folder also sees whether any says something of its amenities, and that decides the columns."""
    present = F.bool_or(F.col("elevator").isNotNull()) if "elevator" in df.columns else F.lit(False)
    rows, seen = written(df, "workbook", details=F.coalesce(F.max(present) if "elevator" not in df.columns else present, F.lit(False)))
    return workbook_rows(rows, bool(seen["details"]), unknown)


def sheet_rows(df: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The sheet's thirteen columns, all strings, and those in carry as they are."""
    c = F.col
    values = [
        or_blank(c("starred")), or_blank(c("status")), or_blank(c("source")), sheet_price(c("price"), c("priceOnRequest")), or_blank(c("bedrooms")), or_blank(c("bathrooms")),
        or_blank(c("sqm")), or_blank(c("normalizedArea.area")), or_blank(c("address")), yes_no(c("elevator"), ""), yes_no(c("furnished"), ""), yes_no(c("balcony"), ""), or_blank(c("url")),
    ]
    return df.select(*[v.alias(n) for v, n in zip(values, SHEET, strict=True)], *(carry or []))


def publish(listings: DataFrame, status: DataFrame, folder: str, fmt: str = "json", meta: DataFrame | None = None) -> None:
    """Listings (with normalizedArea) and status as two datasets, and as a third the one row of meta: generatedAt, searchType, totalListings."""
    if meta is not None:
        meta.write.mode("overwrite").format(fmt).save(f"{folder}/meta")
    listings.write.mode("overwrite").format(fmt).save(f"{folder}/listings")
    status.write.mode("overwrite").format(fmt).save(f"{folder}/status")


def sheet_table(df: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The sheet's columns under names that a table can have, and those in carry."""
    return sheet_rows(df, carry).toDF(*[c.lower().replace(" (€)", "").replace("²", "2") for c in SHEET], *(carry or []))


def has_details(df: DataFrame) -> bool:
    """Whether any row says anything of the amenities; what a data-dependent layout asks before it is planned."""
    if "elevator" not in df.columns:
        return False
    return bool(df.agg(F.bool_or(F.col("elevator").isNotNull())).collect()[0][0])
