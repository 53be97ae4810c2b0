"""The faceted query: a set of filters and one sort key, as Column predicates that Catalyst pushes down."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ListingQuery:
    """Unknown values (0 or null) fail a minimum and pass a maximum; amenities have to be true; empty sets and strings ask for nothing."""

    areas: frozenset[str] = field(default_factory=frozenset)
    source: str = ""
    text: str = ""
    min_price: float | None = None
    max_price: float | None = None
    bedrooms: float | None = None
    bathrooms: float | None = None
    min_sqm: float | None = None
    max_sqm: float | None = None
    amenities: frozenset[str] = field(default_factory=frozenset)
    sort: str = "price"
    ascending: bool = True

    def toggle_area(self, area: str) -> ListingQuery:
        return replace(self, areas=self.areas ^ {area})

    def clear_areas(self) -> ListingQuery:
        return replace(self, areas=frozenset())

    def sort_by(self, key: str) -> ListingQuery:
        """The same key again turns the direction round; another one starts ascending."""
        return replace(self, sort=key, ascending=not self.ascending if key == self.sort else True)

    @staticmethod
    def number(value: str | None) -> float | None:
        return None if value in (None, "") else float(value)

    def predicate(self, area: Column | None = None) -> Column:
        area = F.col("normalizedArea.area") if area is None else area
        p: list[Column] = []
        if self.areas:
            p.append(F.coalesce(area, F.lit("")).isin(*sorted(self.areas)))
        if self.source:
            p.append(F.col("source") == self.source)
        for name, least in (("price", self.min_price), ("bedrooms", self.bedrooms), ("bathrooms", self.bathrooms), ("sqm", self.min_sqm)):
            if least is not None:
                p.append((F.col(name) != 0) & (F.col(name) >= least))
        for name, most in (("price", self.max_price), ("sqm", self.max_sqm)):
            if most is not None:
                p.append(F.col(name).isNull() | (F.col(name) == 0) | (F.col(name) <= most))
        p += [F.col(a).eqNullSafe(True) for a in sorted(self.amenities)]
        if self.text:
            whole = F.concat(F.coalesce("address", F.lit("")), F.lit(" "), F.coalesce("url", F.lit("")))
            p.append(F.lower(whole).contains(self.text.lower()))
        return reduce(and_, p, F.lit(True))

    def filter(self, df: DataFrame) -> DataFrame:
        return df.filter(self.predicate())

    def order(self, strings: frozenset[str] = frozenset({"source", "address", "url"}), ordinal: str | None = "ordinal") -> list[Column]:
        """Nulls last in both directions; strings by the Unicode collation; an unknown area counts as ''; ties by the ordinal."""
        if self.sort == "area":
            key = F.collate(F.coalesce("normalizedArea.area", F.lit("")), "UNICODE")
        else:
            key = F.collate(F.col(self.sort), "UNICODE") if self.sort in strings else F.col(self.sort)
        first = key.asc_nulls_last() if self.ascending else key.desc_nulls_last()
        return [first] + ([F.col(ordinal)] if ordinal else [])

    def run(self, df: DataFrame) -> DataFrame:
        return self.filter(df).orderBy(*self.order(ordinal="ordinal" if "ordinal" in df.columns else None))
