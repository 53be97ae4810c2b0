"""Merging, filtering, enrichment, state sync and limits."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roostwright.functions import text as X
from roostwright.operators import listings as L
from roostwright.operators import present as V
from roostwright.operators.query import ListingQuery
from roostwright.plans import registry
from roostwright.sources import artifacts, dims
from roostwright.sources.html import PROFILES, cards


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_first_wins_and_status(spark):
    rows = frame(spark, [(0, "m", 0, "U"), (0, "m", 1, "U"), (1, "s", 0, "U"), (1, "s", 1, "V"), (6, "j", 0, "U"), (6, "j", 1, "V"), (6, "j", 2, None), (6, "j", 3, None)], "src_rank int, artifact string, pos int, url string")
    merged = L.merge_sources(rows)
    assert sorted((r.artifact, r.pos) for r in merged.collect()) == [("j", 2), ("m", 0), ("m", 1), ("s", 1)]
    again = L.merge_sources(merged)
    assert again.count() == merged.count()
    arts = frame(spark, [("m", None), ("s", None), ("j", None), ("d", "Isolated job artifact not found")], "artifact string, error string")
    assert {r.artifact: (r.found, r.error) for r in L.source_status(arts, merged).collect()} == {"m": (2, None), "s": (1, None), "j": (1, None), "d": (0, "Isolated job artifact not found")}


def test_room_share_goes_after_dedup(spark):
    rows = frame(spark, [("U", 0, True), ("U", 1, False)], "url string, pos int, isRoomShare boolean")
    assert L.drop_room_shares(L.first_wins(rows, "url", ["pos"])).count() == 0


def test_unknown_values_in_filters(spark):
    rows = frame(spark, [(0, None, None)], "price int, sqm double, elevator boolean")
    count = lambda **k: ListingQuery(**k).filter(rows).count()
    assert [count(min_price=1), count(max_price=1), count(min_sqm=1), count(max_sqm=1), count(amenities=frozenset({"elevator"})), count()] == [0, 1, 0, 1, 0, 1]


def test_text_filter_takes_wildcards_literally(spark):
    rows = frame(spark, [("10% off", "u"), ("100", "u")], "address string, url string")
    assert [r.address for r in ListingQuery(text="0%").filter(rows).collect()] == ["10% off"]


def test_sort_keeps_nulls_last_both_ways(spark):
    rows = frame(spark, [(0, 2), (1, None), (2, 1)], "ordinal int, bedrooms int")
    q = ListingQuery().sort_by("bedrooms")
    assert [r.bedrooms for r in q.run(rows).collect()] == [1, 2, None]
    assert [r.bedrooms for r in q.sort_by("bedrooms").run(rows).collect()] == [2, 1, None]


def test_strings_sort_by_collation(spark):
    rows = frame(spark, [(0, "B"), (1, "a")], "ordinal int, address string")
    assert [r.address for r in ListingQuery().sort_by("address").run(rows).collect()] == ["a", "B"]


def test_facets_toggle():
    q = ListingQuery().toggle_area("x").toggle_area("y").toggle_area("x")
    assert q.areas == {"y"} and not q.clear_areas().areas and ListingQuery.number("") is None and ListingQuery.number("3") == 3


def test_carry_forward(spark):
    old = frame(spark, [("A", "x"), ("B", "x"), ("C", "")], "url string, starred string")
    new = frame(spark, [("A",), ("D",)], "url string")
    got = {(r.url, r.starred, r.status) for r in L.carry_forward(old, new).collect()}
    assert got == {("A", "x", "Active"), ("D", "", "Active"), ("B", "x", "No Longer Listed")}
    state = L.carry_forward(old, new)
    twice = {(r.url, r.starred, r.status) for r in L.carry_forward(state.select("url", "starred"), new).collect()}
    assert twice == got


def test_last_sheet_row_wins(spark):
    sheet = frame(spark, [("A", "", 0), ("A", "x", 1), ("", "x", 2), (None, "x", 3)], "url string, starred string, row_index int")
    assert [(r.url, r.starred) for r in L.latest_rows(sheet).collect()] == [("A", "x")]


def test_limits(spark):
    rows = frame(spark, [("s", i) for i in range(5)], "g string, i int")
    assert sorted(r.i for r in L.shard_modulo(rows, 2, 0, ["i"], ["g"]).collect()) == [0, 2, 4]
    pages = frame(spark, [("s", p, i) for p in range(3) for i in range(60)], "g string, page int, i int")
    assert L.soft_cap(pages, 100, "page", ["g"]).count() == 120
    assert L.stated_limit(rows.withColumn("stated", F.lit(3)), "stated", ["i"], ["g"]).count() == 3


def test_enrichment_by_policy(spark):
    f = "struct<elevator:boolean,balcony:boolean,furnished:boolean,bathroomsFromDetail:int,bedroomsFromDetail:int>"
    card = (True, True, None, None, None)
    rows = frame(spark, [(s, s, 2, None, None, card) for s in ("SeLoger", "Junot", "DanielFeau", "Eiffel Housing")], f"url string, source string, rooms int, bedrooms int, bathrooms int, card {f}")
    details = frame(spark, [(s, (False, None, True, 1, 5)) for s in ("SeLoger", "Junot", "DanielFeau", "Eiffel Housing")], f"url string, detail {f}")
    got = {r.source: (r.elevator, r.balcony, r.furnished, r.bathrooms, r.bedrooms) for r in L.enrich(rows, details, L.policy_dim(spark)).collect()}
    assert got == {"SeLoger": (False, None, True, 1, None), "Junot": (True, True, True, 1, 5), "DanielFeau": (False, True, True, 1, 5), "Eiffel Housing": (True, True, None, 1, 5)}


def test_dimensions(spark):
    arr = {r.arrondissement: r for r in dims.arrondissement_dim(spark).collect()}
    assert arr[1].slug == "paris-1er-arrondissement-75001" and arr[20].displayName == "Paris 20ème" and len(arr) == 20
    assert dims.town_dim(spark).count() == 21 and dims.alias_dim(spark).count() == 21 and dims.location_dim(spark).count() == 52
    known = dims.with_known(frame(spark, [("suresnes",)], "slug string"), dims.town_dim(spark)).collect()[0]
    assert known.postal == "92150"


def test_labels(spark):
    r = spark.range(1).select(V.ui_price(F.lit(12345), F.lit(False)).alias("a"), V.ui_price(F.lit(0), F.lit(False)).alias("b"), V.sheet_price(F.lit(0), F.lit(False)).alias("c"), V.price_label(F.lit(0), F.lit(True)).alias("d"), V.yes_no(F.lit(None).cast("boolean")).alias("e")).collect()[0]
    assert tuple(r) == ("12,345", "—", "", "On request", "Not mentioned")


def test_anchor_scan_climbs_to_a_price():
    price = "1 200 €"
    html = f"""<div><section><p>{price}</p><a href="/annonce-immobiliere/1?x">one</a><br></section></div>
    <div id=far>{"<div>" * 9}<a href="/annonce-immobiliere/2">two</a>{"</div>" * 9}</div>
    <ul><li>{price} <a href="/annonce-immobiliere/3">a</a><a href="/annonce-immobiliere/3">b</a></li><li>{price}<a href="/annonce-immobiliere/3?y">c</a></li></ul>
    <div>{price} {"long " * 200}<a href="/annonce-immobiliere/4">d</a></div><div>{price}<a href="/other/5">e</a></div>"""
    got = cards(html, PROFILES["DanielFeau"])
    assert [u for u, _ in got] == [f"/annonce-immobiliere/{i}" for i in (1, 3, 3, 4)]
    assert max(len(t) for _, t in got) == 500 and all("€" in t for _, t in got) and cards(None, PROFILES["Junot"]) == []


def test_a_worker_holds_few_pages_as_strings():
    """A batch of 20 MB of pages is read a slice at a time, whatever its size; ids stay exact beside missing ones."""
    import tracemalloc

    import pyarrow as pa

    from roostwright.sources.html import scan_anchors, scan_cards

    class Table:  # what a worker runs
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run
        mapInPandas = lambda self, run, schema: lambda batches: (pa.RecordBatch.from_pandas(x) for x in run(b.to_pandas() for b in batches))

    text = "<p>9 €</p>" + "é" * 5000
    ids = [None, *range(2**60, 2**60 + 2000), -1]
    pages = [text * 200 + '<a href="/fiche-1?a">1</a><a href="/fiche-2">2</a>', *[f'{text}<a href="/fiche-{k}">x</a>' for k in range(2000)], None]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pages)], names=["page_id", "html"])
    small = pa.RecordBatch.from_arrays([pa.array(ids[1:], pa.int64()), pa.array(pages[1:])], names=["page_id", "html"])
    for scan in (lambda t: scan_cards(t, PROFILES["Perenium"]), scan_anchors):
        tracemalloc.start()
        assert sum(b.num_rows for b in scan(Table())(iter([small]))) == 2000
        assert tracemalloc.get_traced_memory()[1] < 8 * (1 << 20)
        tracemalloc.stop()
        got = [tuple(r.values())[:3] for b in scan(Table())(iter([batch, batch.slice(0, 0), batch.slice(2001)])) for r in b.to_pylist()]
        strip = lambda u: u if scan is scan_anchors else u.split("?")[0]
        assert got == [(None, 0, strip("/fiche-1?a")), (None, 1, "/fiche-2"), *[(2**60 + k, 0, f"/fiche-{k}") for k in range(2000)]]


def test_artifacts(spark, tmp_path):
    import json

    l = lambda u, share=False: {"url": u, "price": 1000, "isRoomShare": share, "address": "Paris 5e"}  # noqa: E731, E741
    files = {
        "output-main.json": {"sourceStatus": [], "listings": [l("a"), l("a")]}, "output-seloger-suresnes-shard-0.json": {"slug": "suresnes", "listings": [l("a"), l("b")]},
        "output-seloger-arr-5-shard-0.json": {"arrondissement": 5, "listings": [l("c", True)]}, "output-junot.json": {"listings": [], "error": "timed out"}, "output-junot-sale.json": {"listings": [l("z")]},
        "notes.json": {"listings": [l("y")]},
    }
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body))
    main, parts = artifacts.read_main(spark, str(tmp_path)), artifacts.read_parts(spark, str(tmp_path))
    every = main.drop("sourceStatus").unionByName(parts)
    merged = L.merge_sources(artifacts.rows_of(every))
    assert sorted(r.url for r in merged.collect()) == ["a", "a", "b", "c"]
    assert {r.artifact: r.found for r in L.source_status(every, merged).collect()} == {"output-main.json": 2, "output-seloger-suresnes-shard-0.json": 1, "output-seloger-arr-5-shard-0.json": 1, "output-junot.json": 0}
    area = L.drop_room_shares(merged).withColumn("a", X.normalize_area(F.col("address"))).select("a.area").distinct().collect()
    assert [r.area for r in area] == ["Paris 5e"]


def test_combine_isolates_failures(spark):
    from roostwright.operators.combine import combine, merge_folder  # noqa: F401

    def broken():
        raise RuntimeError("blocked")

    rows, status = combine(spark, {"a": lambda: frame(spark, [("u",)], "url string"), "b": broken, "c": lambda: frame(spark, [("v", 1)], "url string, price int"), "d": broken}, skip=frozenset({"d"}))
    assert {r.source: (r.found, r.error) for r in status.collect()} == {"a": (1, None), "b": (0, "blocked"), "c": (1, None)}
    assert [(r.url, r.price, r.src_order) for r in rows.orderBy("src_order").collect()] == [("u", None, 0), ("v", 1, 2)]


def test_merge_of_a_folder(spark, tmp_path):
    import json

    from roostwright.operators.combine import dataset_meta, merge_folder

    l = lambda u, share=False: {"url": u, "price": 1000, "isRoomShare": share, "address": "Paris 5e"}  # noqa: E731, E741
    told = [{"source": "Barnes", "found": 1, "error": None}, {"source": "SeLoger", "found": 0, "error": "blocked"}]
    bodies = {
        "output-main.json": {"listings": [l("a")], "sourceStatus": told}, "output-junot.json": {"listings": [l("a"), l("b"), l("c", True)]},
        "output-seloger-suresnes-shard-0.json": {"slug": "suresnes", "listings": [l("d")]}, "output-seloger-arr-5-shard-1.json": {"arrondissement": 5, "listings": [], "error": "late"},
        "output-parisrental-furnished-1.json": {"category": "furnished", "page": 1, "listings": [l("e")]},
    }
    for name, body in bodies.items():
        (tmp_path / name).write_text(json.dumps(body))
    published, status = merge_folder(spark, str(tmp_path))
    assert sorted((r.url, r.normalizedArea.area) for r in published.collect()) == [(u, "Paris 5e") for u in "abde"]
    assert {r.source: (r.found, r.error) for r in status.collect()} == {
        "Barnes": (1, None), "SeLoger": (0, "blocked"), "Junot": (2, None), "SeLoger-Suburb-suresnes": (1, None), "SeLoger-Paris-5e": (0, "late"),
        "ParisRental-furnished": (1, None), "DanielFeau": (0, artifacts.MISSING), "Eiffel Housing": (0, artifacts.MISSING),
    }
    assert [r.source for r in status.orderBy("src_rank").collect()[:2]] == ["Barnes", "SeLoger"]
    assert dataset_meta(published, "rent").collect()[0].totalListings == 4 and not V.has_details(frame(spark, [(None,)], "elevator boolean"))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="driver tables are not here")
def test_scan_cards_runs_over_all_cards(spark):
    rows = registry.queries()["card_scan"](spark, "/root/testdata/sf0.001").collect()
    keys = [r.p_partkey for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey").collect()]
    assert sorted(r.p_partkey for r in rows) == sorted(k for k in keys if k % 5 != 4) and all(r.price > 0 and r.rooms == r.p_partkey % 6 + 1 for r in rows)


def test_all_slugs_are_named(spark):
    rows = {r.slug: r.name for r in dims.location_dim(spark).select("slug", X.slug_to_display(F.col("slug")).alias("name")).collect()}
    assert sorted(rows) == sorted(dims.LOCATION_SLUGS) and all(n.lower() == s and n[0].isupper() for s, n in rows.items())


def test_filters_do_not_repeat_the_parse(spark):
    """A predicate on a parsed column must not inline the parse again: each pattern stands in the plan once."""
    import re

    from roostwright.functions import text as X
    from roostwright.operators.query import ListingQuery

    rows = spark.createDataFrame([("T3 60 m² 900 €/mois Paris 16e", "Junot")], "rawText string, source string")
    q = ListingQuery(areas=frozenset({"Paris 16e"}), source="Junot", max_price=4000, bathrooms=None, min_sqm=25)
    df = q.filter(X.with_area(X.parse_listing(rows))).select("price")
    assert len(re.findall(r"regexp_\w+\(|RLIKE", df._jdf.queryExecution().optimizedPlan().toString())) < 60
    assert [r.price for r in df.collect()] == [900]


def test_asked_columns_only_are_parsed(spark):
    from roostwright.functions import text as X

    rows = spark.createDataFrame([("T3, 60 m², 900 €/mois", 1)], "rawText string, price int")
    assert X.parse_listing(rows, columns=("price", "sqft")).collect() == [("T3, 60 m², 900 €/mois", 900, 646)]
