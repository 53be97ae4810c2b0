"""Sheets: repeated urls stay as many as they are, and no failure loses a star."""

import pytest
from pyspark.sql import functions as F

from roostwright.operators import listings as L
from roostwright.operators.combine import sync_sheets
from roostwright.operators.sheets import Sheets

LISTINGS = "url string, source string, price int, priceOnRequest boolean, bedrooms int, bathrooms int, sqm double, normalizedArea struct<area: string>, address string, elevator boolean, furnished boolean, balcony boolean, pos int"


def listings(spark, *urls):
    return spark.createDataFrame([(u, "Junot", 900, False, 1, None, 20.5, ("Puteaux",), "Puteaux", None, True, False, i) for i, u in enumerate(urls)], LISTINGS).repartition(3)


def star(sheets, name, *urls):
    """Somebody marks every row of these urls."""
    now = sheets.read(name)
    sheets.write(name, now.withColumn("starred", F.when(F.col("url").isin(*urls), "x").otherwise(F.col("starred"))))


def rows(sheets, name="rent"):
    return [(r.url, r.starred, r.status) for r in sheets.read(name).orderBy("row_index").collect()]


def test_stars_are_kept_and_sheets_made(spark, tmp_path):
    sheets = Sheets(spark, str(tmp_path))
    assert sheets.read("rent") is None and sync_sheets(sheets, listings(spark, "a", "b"), None, ("rent", "sale")) == ["rent"] and sheets.read("sale") is None
    star(sheets, "rent", "a")
    assert sync_sheets(sheets, listings(spark, "b", "c"), listings(spark, "s"), ("rent", "sale")) == ["rent", "sale"]
    assert rows(sheets) == [("b", "", "Active"), ("c", "", "Active"), ("a", "x", "No Longer Listed")] and rows(sheets, "sale") == [("s", "", "Active")]
    last = sheets.read("rent").filter("url = 'a'").collect()[0]
    assert (last.price, last.furnished, last.elevator, last.area) == ("900", "Yes", "", "Puteaux")
    assert sync_sheets(sheets, listings(spark), None, ("rent", "sale")) == ["rent"] and rows(sheets) == [("a", "x", "No Longer Listed")]


def test_repeated_urls_do_not_multiply(spark, tmp_path):
    sheets, fresh = Sheets(spark, str(tmp_path)), listings(spark, "a", "b", "a", "c")
    sync_sheets(sheets, fresh, names=("rent", "sale"))
    star(sheets, "rent", "a", "c")
    for _ in range(4):
        sync_sheets(sheets, fresh, names=("rent", "sale"))
        assert rows(sheets) == [("a", "x", "Active"), ("b", "", "Active"), ("a", "x", "Active"), ("c", "x", "Active")]
    for _ in range(2):  # gone: one row for each url, at the place of its first
        sync_sheets(sheets, listings(spark, "d"), names=("rent", "sale"))
        assert rows(sheets) == [("d", "", "Active"), ("a", "x", "No Longer Listed"), ("c", "x", "No Longer Listed")]
    assert len(sheets.versions("rent")) == 2


def test_the_last_row_of_a_url_counts_at_the_place_of_the_first(spark):
    df = spark.createDataFrame([("A", "x", 0), ("B", "", 1), ("A", "", 2), ("", "x", 3), (None, "x", 4), ("B", "y", 5)], "url string, starred string, row_index long").repartition(4)
    assert sorted(tuple(r) for r in L.keyed_state(df).collect()) == [("A", "", 0), ("B", "y", 1)]


@pytest.mark.parametrize("when", ["before", "after"])
@pytest.mark.parametrize("step", ["_snapshot", "_point", "_swap", "_sweep"])
def test_no_star_is_lost_wherever_a_run_stops(spark, tmp_path, monkeypatch, step, when):
    sheets = Sheets(spark, str(tmp_path))
    sync_sheets(sheets, listings(spark, "a", "b"), names=("rent", "sale"))
    star(sheets, "rent", "a", "b")
    real = getattr(Sheets, step)

    def stop(self, *args):
        if when == "after":
            real(self, *args)
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(Sheets, step, stop)
        with pytest.raises(RuntimeError, match="killed"):
            sync_sheets(sheets, listings(spark, "b", "c"), names=("rent", "sale"))
    old, new = [("a", "x", "Active"), ("b", "x", "Active")], [("b", "x", "Active"), ("c", "", "Active"), ("a", "x", "No Longer Listed")]
    assert rows(sheets) == (new if step == "_sweep" or (step, when) == ("_swap", "after") else old)
    sync_sheets(sheets, listings(spark, "b", "c"), names=("rent", "sale"))
    assert rows(sheets) == new and len(sheets.versions("rent")) == 2
    left = {p.name for p in (tmp_path / "rent").iterdir() if not p.name.endswith(".crc")}
    assert left == {"CURRENT", *sheets.versions("rent")}
