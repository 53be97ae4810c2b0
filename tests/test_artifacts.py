"""Artifacts: every kind of damage is seen, and what is written is read back."""

import json
import os

import pytest
from pyspark.sql import functions as F

from roostwright import schema
from roostwright.operators import listings as L
from roostwright.operators.combine import combine, merge_folder
from roostwright.sources import artifacts as A

GOOD = {"slug": "suresnes", "listings": [{"url": "b", "price": 1000, "address": "Paris 5e"}], "error": None}
MAIN = {"sourceStatus": [{"source": "Barnes", "found": 1, "error": None}], "listings": [{"url": "a", "price": 900, "address": "Paris 5e"}]}


def put(folder, **files):
    for name, body in files.items():
        (folder / f"output-{name.replace('_', '-')}.json").write_text(body if isinstance(body, str) else json.dumps(body, indent=2))


BROKEN = [
    (json.dumps(GOOD)[:-12], A.NO_JSON), ("", A.NO_TEXT), ("  \n", A.NO_TEXT), ("<html>Gateway Timeout</html>", A.NO_JSON), (json.dumps(GOOD) + "}", A.NO_JSON), (json.dumps([GOOD]), A.NO_ENVELOPE),
    ("[]", A.NO_ENVELOPE), ("null", A.NO_ENVELOPE), ('"x"', A.NO_ENVELOPE), ("{}", A.NO_LISTINGS), (json.dumps({"listings": {"url": "b"}}), A.NO_LISTINGS), (json.dumps({"listings": None, "error": ""}), A.NO_LISTINGS),
    (json.dumps({"error": "timed out"}), "timed out"),
]


def test_broken_parts_are_error_rows(spark, tmp_path):
    """Each kind of damage, in a file of its own that its name labels, and in an agency's."""
    put(tmp_path, main=MAIN, junot=BROKEN[0][0], eiffel_housing={"listings": []}, **{f"seloger_t{i}_shard_0": body for i, (body, _) in enumerate(BROKEN)})
    published, status = merge_folder(spark, str(tmp_path))
    assert [r.url for r in published.collect()] == ["a"]
    told = {r.source: (r.found, r.error) for r in status.collect()}
    agencies = {"Barnes": (1, None), "Junot": (0, A.NO_JSON), "Eiffel Housing": (0, None), "DanielFeau": (0, A.MISSING)}
    assert told == agencies | {f"SeLoger-Suburb-t{i}": (0, error) for i, (_, error) in enumerate(BROKEN)}


@pytest.mark.parametrize("body", [json.dumps(MAIN)[:-30], "", "[]", "<html>", "{}", json.dumps({"listings": []}), json.dumps({"sourceStatus": []})])
def test_a_broken_main_raises(spark, tmp_path, body):
    put(tmp_path, main=body, junot=GOOD)
    with pytest.raises(ValueError, match="output-main.json: artifact"):
        merge_folder(spark, str(tmp_path))
    with pytest.raises(ValueError, match="main artifact not found"):
        A.read_main(spark, str(tmp_path), "sale")


def test_values_of_another_type_are_null_and_told(spark, tmp_path):
    put(tmp_path, junot={"source": "Junot", "listings": [{"url": "u", "price": "12x", "rooms": 2}, {"url": "v", "price": 3}], "error": None}, danielfeau=GOOD)
    rows = {r.artifact: r for r in A.envelopes(spark, f"{tmp_path}/output-*.json", schema.PART_ARTIFACT).collect()}
    junot = rows["output-junot.json"]
    assert junot.error is None and junot.mistyped and [(x.url, x.price, x.rooms) for x in junot.e.listings] == [("u", None, 2), ("v", 3, None)] and not rows["output-danielfeau.json"].mistyped


def test_names_pick_files(spark, tmp_path):
    put(tmp_path, seloger_a_b_shard_1=GOOD, seloger_arr_5_shard_0={"arrondissement": 5, "listings": []}, parisrental_furnished_all={"category": "furnished", "listings": []}, parisrental_other_1=GOOD, junot_sale=GOOD)
    (tmp_path / "output-seloger-é +1-shard-0.json").write_text("{")
    (tmp_path / "deeper").mkdir()
    put(tmp_path / "deeper", danielfeau=GOOD)
    got = {r.artifact: (r.src_rank, r.label) for r in A.read_parts(spark, str(tmp_path)).collect()}
    assert got == {
        "output-seloger-a-b-shard-1.json": (1, "SeLoger-Suburb-suresnes"), "output-seloger-arr-5-shard-0.json": (2, "SeLoger-Paris-5e"), "output-parisrental-furnished-all.json": (3, "ParisRental-furnished"),
        "output-seloger-é +1-shard-0.json": (1, "SeLoger-Suburb-é +1"),
    }
    assert [r.artifact for r in A.read_parts(spark, str(tmp_path), "sale").collect()] == ["output-junot-sale.json"]
    assert A.read_parts(spark, str(tmp_path / "none")).count() == 0


JOBS = [
    (1, "main", None, None, None, None, None, None), (2, "suburb towns", "suresnes", None, None, None, 0, None), (3, "suburb towns", "suresnes", None, None, None, 1, "late"), (4, "arrondissements", None, 5, None, None, 2, None),
    (5, "categories", None, None, "furnished", 7, None, None), (6, "Eiffel Housing", None, None, None, None, None, None), (7, "Junot", None, None, None, None, None, "blocked"),
]
JOB = "job int, `group` string, slug string, arrondissement int, category string, page int, shard int, error string"


@pytest.mark.parametrize("kind", ["rent", "sale"])
def test_written_artifacts_are_read_back(spark, tmp_path, kind):
    jobs = spark.createDataFrame(JOBS, JOB).withColumn("sourceStatus", F.array(F.struct(F.lit("Barnes").alias("source"), F.lit(1).alias("found"), F.lit(None).cast("string").alias("error"))))
    rows = spark.createDataFrame([(j, p, f"u{j}-{p}", 100 * j + p, 1.5) for j in (1, 2, 4, 5, 6) for p in range(11)], "job int, pos int, url string, price int, sqm double")
    for _ in range(2):  # writing again replaces
        A.write_artifacts(rows, jobs, str(tmp_path), kind)
    suffix = "-sale" if kind == "sale" else ""
    category = "sale" if suffix else "furnished"
    assert sorted(os.listdir(tmp_path)) == sorted(f"output-{n}.json" for n in (f"main{suffix}", f"seloger-suresnes-shard-0{suffix}", f"seloger-suresnes-shard-1{suffix}", f"seloger-arr-5-shard-2{suffix}", f"parisrental-{category}-7", f"eiffel-housing{suffix}", f"junot{suffix}"))
    text = (tmp_path / f"output-main{suffix}.json").read_text()
    assert "\n" in text and json.loads(text)["totalListings"] == 11
    main, parts = A.read_main(spark, str(tmp_path), kind), A.read_parts(spark, str(tmp_path), kind)
    every = A.rows_of(main.drop("sourceStatus").unionByName(parts))
    assert sorted((r.url, r.price, r.sqm, r.pos) for r in every.collect()) == sorted((r.url, r.price, r.sqm, r.pos) for r in rows.collect())
    assert {r.label: r.error for r in parts.collect() if r.error} == {"SeLoger-Suburb-suresnes": "late", "Junot": "blocked"}


def test_a_failed_write_leaves_the_folder_as_it_was(spark, tmp_path):
    spark.dataSource.register(A.EnvelopeSink)
    rows = spark.createDataFrame([("output-junot.json", "new"), ("../up.json", "x")], "name string, body string").repartition(2)
    put(tmp_path, junot="old")
    with pytest.raises(Exception, match="not a file name"):
        rows.write.format("envelopes").mode("append").save(str(tmp_path))
    twice = spark.createDataFrame([("a.json", "1"), ("a.json", "2")], "name string, body string")
    with pytest.raises(Exception, match="one artifact name"):
        twice.write.format("envelopes").mode("append").save(str(tmp_path))
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".pending")] == ["output-junot.json"] and (tmp_path / "output-junot.json").read_text() == "old"


def test_each_source_is_evaluated_once(spark):
    scans = {n: spark.sparkContext.accumulator(0) for n in "abc"}

    def source(name, bad=False):
        def run(batches):
            for b in batches:
                scans[name].add(len(b))
                if bad:
                    raise RuntimeError("blocked")
                yield b

        return lambda: spark.range(0, 6, 1, 2).mapInPandas(run, "id long")

    rows, status = combine(spark, {"a": source("a"), "b": source("b", bad=True), "c": source("c")})
    assert sorted((r.src_order, r.id) for r in rows.collect()) == [(o, i) for o in (0, 2) for i in range(6)] and rows.count() == 12
    told = {r.source: (r.found, r.error) for r in status.collect()}
    assert told["a"] == told["c"] == (6, None) and told["b"] == (0, "RuntimeError: blocked")
    assert scans["a"].value == scans["c"].value == 6


def test_pages_end_at_the_first_without_new_rows(spark):
    schema_ = "run int, loc int, page int, pos int, url string"
    pages = [(1, 1, 1, "ab"), (1, 1, 2, "ba"), (1, 1, 3, "c"), (1, 2, 1, "c"), (1, 2, 2, "d"), (1, 3, 1, "bx"), (1, 3, 3, "y"), (2, 1, 1, "ab"), (2, 1, 2, "cd"), (2, 1, 3, "e"), (2, 2, 1, "f"), (2, 2, 2, "g")]
    rows = [(r, loc, p, i, u) for r, loc, p, text in pages for i, u in enumerate(text)]
    df = spark.createDataFrame(rows, schema_).repartition(3)
    got = lambda cap: sorted((r.run, r.loc, r.page, r.url) for r in L.visited_pages(df, ["run"], "loc", "page", ["pos"], "url", cap).collect())
    every = [(1, 1, 1, "a"), (1, 1, 1, "b"), (1, 2, 1, "c"), (1, 2, 2, "d"), (1, 3, 1, "x")]
    assert got(None) == every + [(2, 1, 1, "a"), (2, 1, 1, "b"), (2, 1, 2, "c"), (2, 1, 2, "d"), (2, 1, 3, "e"), (2, 2, 1, "f"), (2, 2, 2, "g")]
    assert got(4) == every + [(2, 1, 1, "a"), (2, 1, 1, "b"), (2, 1, 2, "c"), (2, 1, 2, "d"), (2, 2, 1, "f")]
    assert L.visited_pages(df.limit(0), ["run"], "loc", "page", ["pos"], "url").count() == 0


def test_triage(spark):
    rows = [(1, 3, "c", 0, "late"), (1, 1, "a", 4, None), (1, 2, "b", 0, ""), (1, 0, "z", 9, "blocked"), (2, 1, "a", None, None)]
    df = spark.createDataFrame(rows, "run int, ord int, slug string, n int, error string").repartition(3)
    got = {r.run: (r.n_locations, r.n_rows, r.zero_result_count, r.failed) for r in L.triage(df, ["run"], ["ord"], "slug", "n", "error").collect()}
    assert got == {1: (4, 4, 1, ["z (blocked)", "c (late)"]), 2: (1, 0, 1, [])}


def test_first_details_do_not_depend_on_the_partitions(spark):
    rows = [(f"u{i % 7}", i, (i % 3 == 0, i)) for i in range(200)]
    df = spark.createDataFrame(rows, "url string, ordinal int, detail struct<lift: boolean, n: int>")
    for parts in (1, 2, 3, 5, 8):
        dealt = df.repartition(parts, F.rand(parts))
        assert {r.url: r.detail.n for r in L.first_details(dealt, "url", "ordinal").collect()} == {f"u{i}": i for i in range(7)}
        assert {r.url: r.detail.n for r in L.first_details(dealt).collect()} == {f"u{i}": next(n for n in range(i, 200, 7) if n % 3) for i in range(7)}
