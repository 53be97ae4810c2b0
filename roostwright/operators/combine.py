"""Combining sources and publishing: the two batch entry points."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import with_area
from ..session import written
from ..sources import artifacts as A
from . import listings as L
from . import present as V
from .sheets import Sheets


def reason(e: Exception) -> str:
    """One line that says why; never an empty one, which would read as no error."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    raised = [x for x in lines if re.match(r"(\w+\.)*\w*(Error|Exception)\b", x)]  # the last line of a Python worker's trace
    return (raised or lines or [type(e).__name__])[-1 if raised else 0]


def combine(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], skip: frozenset[str] = frozenset(), external: DataFrame | None = None, external_status: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(union of the sources' rows in order, with ordinal src_order; status: source, found, error).

    Each source is evaluated once, into the shared folder, and counted as it is written; one that fails on the way becomes a status row and takes
    nothing else down. Those in skip are not run. `external` rows go first, and so does external_status (source, found, error).
    """
    frames, status = ([external.withColumn("src_order", F.lit(-1))] if external is not None else []), []
    for i, (name, make) in enumerate(sources.items()):
        if name in skip:
            continue
        try:
            df, seen = written(make().withColumn("src_order", F.lit(i)), "source", found=F.count(F.lit(1)))
        except Exception as e:  # noqa: BLE001  one source's failure is a row of the report
            status.append((name, 0, reason(e)))
            continue
        frames.append(df)
        status.append((name, seen["found"], None))
    report = spark.createDataFrame(status, "source string, found long, error string")
    return (L.union_sources(frames) if frames else None), (external_status.select("source", F.col("found").cast("long").alias("found"), "error").unionByName(report) if external_status is not None else report)


def merge_folder(spark: SparkSession, folder: str, kind: str = "rent") -> tuple[DataFrame, DataFrame]:
    """(published listings with normalizedArea; status: src_rank, artifact, source, found, error) of a folder of artifacts: first wins by precedence, then room shares go.

    The main file's own status comes first (src_rank 0); counts of the other files are of the rows that the merge kept, taken before room shares go. An optional agency without a file gets a status row that says so,
    a file that can't be read one that says how it is broken; a missing or broken main file raises.
    """
    main, parts = A.read_main(spark, folder, kind), A.read_parts(spark, folder, kind)
    every = main.drop("sourceStatus").unionByName(parts)
    merged = L.merge_sources(A.rows_of(every))
    labels = parts.select("label").distinct()
    ranks = [(i, n) for i, (n, _) in enumerate(A.GROUPS, 1) if n in A.OPTIONAL]
    missing = spark.createDataFrame(ranks, "src_rank int, label string").join(labels, "label", "left_anti")
    missing = missing.select("src_rank", F.col("label").alias("artifact"), "label", F.lit(A.MISSING).alias("error"))
    files = parts.drop("listings").unionByName(missing)
    told = main.select("src_rank", "artifact", F.explode("sourceStatus").alias("s")).select("src_rank", "artifact", "s.source", F.col("s.found").cast("long").alias("found"), "s.error")
    # a missing agency has no file, so its label stands for one
    counts = L.source_status(files.select("artifact", "error"), merged)
    status = told.unionByName(files.select("src_rank", "artifact", F.col("label").alias("source")).join(counts, "artifact").select("src_rank", "artifact", "source", "found", "error"))
    published = with_area(L.drop_room_shares(merged))
    return published, status


def dataset_meta(published: DataFrame, kind: str) -> DataFrame:
    """One row: generatedAt (ISO 8601), searchType, totalListings."""
    return published.agg(F.count(F.lit(1)).alias("totalListings")).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generatedAt"), F.lit(A.search_type(kind)).alias("searchType"), "totalListings"
    )


def sync_sheets(sheets: Sheets, rent: DataFrame, sale: DataFrame | None = None, names: tuple[str, str] = ("sheet1", "sale"), order: tuple[str, ...] = ("src_rank", "artifact", "pos")) -> list[str]:
    """The published listings into their sheets: rent always, sale only if it is given; returns the sheets written.

    Stars of listings still there are kept, starred ones that are gone stay as no longer listed, after the others. Listings keep their order (by those
    columns of `order` that they have), and a url listed twice has two rows, however often the sync is run. A failure at any point leaves the sheet as it was.
    """
    done = []
    for rows, name in zip((rent, sale), names, strict=True):
        if rows is None:
            continue
        by = [c for c in order if c in rows.columns]
        fresh = V.sheet_table(rows.withColumns({"starred": F.lit(""), "status": F.lit("")}), by).drop("starred", "status")
        old = sheets.read(name)
        if old is None:
            old = fresh.limit(0).drop(*by).withColumns({"starred": F.lit(""), "status": F.lit(""), "row_index": F.lit(0).cast("long")})
        now = L.carry_forward(L.keyed_state(old), fresh).withColumn("__gone", F.col("status") != "Active")
        sheets.write(name, now.orderBy("__gone", *by, "row_index").select("starred", "status", *[c for c in fresh.columns if c not in by], F.monotonically_increasing_id().alias("row_index")))
        done.append(name)
    return done
