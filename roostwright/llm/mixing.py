"""Mixing sources to target weights (op 7): weighted fair queueing over shuffled documents.

Targets: every source gets the budget's share of its weight, at most max_epochs times its own size; what it can't
take goes to the others by weight. Each source's documents are shuffled (by md5 of id and seed) and repeated in
that order up to max_epochs times; the virtual finish time of a copy is the words its source has sent up to and with
it, divided by the source's target. Copies are range-sorted by finish time and taken while their running total is
within the budget. Then accounts are settled: a source's copies that finish after time 1 go back, and what a source lacks
because its next document was too long is filled by the documents that fit best, a few of each source. So a source
ends less than its shortest spare document below its target, or as near as `fills` documents bring it. Columns and SQL functions only.

No source is summed in one task: running totals are made within md5 prefixes of a source and added up over the few
prefix sums; the global order is cut into ranges of finish time in the same way. All of that is done on slim rows; the
caller's columns cross the network once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Ranges of finish time for each unit, and the time beyond which all is one range.
RANGES, LAST = 4096, 4
#: Copies of a range that are ordered in one task.
ORDERED = 10_000


def n_words(text: Column | str) -> Column:
    return F.regexp_count(C.text_or_empty(text), F.lit(C.WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """One row per source of (source, size): source, source_rank, source_size, weight, target.

    Sources stand by code point, null last, and weigh weights[0], weights[1], ... in turn. Poured by weight, a source
    is full once max_epochs * size is reached; in the order of (full size / weight) all full sources come first,
    so one pass of running sums tells which are full and what is left for the rest. The table has a row per source; however many there are, they are ordered in ranges.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("decimal(38,0)").alias("source_size"))
    s = C.in_order(s, [F.col("source").asc_nulls_last()], {}, "mix-ranks").withColumnRenamed("__place", "source_rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")).cast("decimal(18,0)")
    s = s.withColumns({"source_rank": F.col("source_rank").cast("int"), "weight": w}).withColumn("__cap", F.col("source_size") * max_epochs)
    s = C.in_order(s, [F.col("__cap").cast("double") / F.col("weight").cast("double"), F.col("source_rank")], {"__full_before": "__cap", "__weight_before": "weight"}, "mix-fill")
    total, weights_sum = s.agg(F.sum("source_size"), F.sum("weight")).collect()[0]
    budget = float(int(float(total or 0) * share))
    left = F.lit(float(weights_sum or 0)) - F.col("__weight_before").cast("double")
    s = s.withColumn("__full", F.col("__cap").cast("double") * left <= (F.lit(budget) - F.col("__full_before").cast("double")) * F.col("weight").cast("double"))
    full, open_weight = s.agg(F.sum(F.when(F.col("__full"), F.col("__cap").cast("double"))), F.sum(F.when(~F.col("__full"), F.col("weight").cast("double")))).collect()[0]
    shared = F.lit(budget - (full or 0.0)) * F.col("weight").cast("double") / F.lit(open_weight or 1.0)
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(shared)
    return s.select("source", "source_rank", F.col("source_size").cast("long").alias("source_size"), F.col("weight").cast("int").alias("weight"), target.alias("target"))


def finish(cum: Column, epoch: Column, source_size: Column, target: Column) -> Column:
    """A copy's virtual finish time; 0 where the source has no words."""
    return F.when(target > 0, (epoch * source_size + cum).cast("double") / target).otherwise(F.lit(0.0))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0, seed: int = 7, fills: int = 3,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, per_bin: int = 4096, tie_cols: tuple[str, ...] | None = None,
) -> DataFrame:
    """docs with size, source_size, target and copies (int: how often the mix holds the row); columns of these names are replaced.

    Null texts have size 0; a null source is a source of its own; rows with the same id, size and text are alike and
    may stand for each other; rows without an id, or of one, are told apart by tie_cols (the text unless given). Rows without words are taken with those that stand before them and cost nothing. An empty
    table stays empty. No row gets more than max_epochs copies. The same rows give the same mix, however partitioned.
    Texts of any length are counted whole; one that is longer than its source's target is left out.
    """
    size = C.field(size_col).cast("long") if size_col else n_words(C.field(text_col))
    ties = [C.field(c) for c in ((text_col,) if tie_cols is None else tie_cols) if c in docs.columns]
    rows = C.hold(docs).select(
        "__row", C.field(source_col).alias("source"), F.coalesce(size, F.lit(0)).alias("size"), C.field(id_col).alias("__id"), C.spread_key(f"{seed}:", C.field(id_col), ties).alias("__k"),
    )
    slim, n = C.counted(rows.drop("__row"), "mix-sizes")
    bin_of = F.substring("__k", 1, C.hex_digits(n, per_bin))
    bins = slim.groupBy("source", bin_of.alias("__bin")).agg(F.sum("size").alias("__n"))
    starts = C.durable(C.running_before(bins, "__bin", "__n", "__start", ("source",)), "mix-bins")
    targets, n_sources = C.counted(source_targets(starts.select("source", F.col("__n").alias("size")), weights, max_epochs, share), "mix-targets")
    starts = starts.join(C.small(targets, n_sources), starts["source"].eqNullSafe(targets["source"])).select(
        starts["source"].alias("__of"), F.col("__bin").alias("__at"), "__start", "source_rank", "source_size", "target"
    )
    starts, n_starts = C.counted(starts, "mix-starts")

    def place(r: DataFrame) -> DataFrame:
        """r with its place (source_rank, __bin, __rn) and the words of its source up to and with it."""
        order = Window.partitionBy("source", "__bin").orderBy("__k", "__id", "size")
        r = r.withColumn("__bin", bin_of).withColumn("__rn", F.row_number().over(order)).withColumn("__cum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        r = r.join(C.small(starts, n_starts), (F.col("__bin") == F.col("__at")) & F.col("source").eqNullSafe(F.col("__of")))
        return r.withColumn("__cum", F.col("__cum") + F.col("__start")).drop("__k", "__id", "__of", "__at", "__start")

    placed = C.durable(place(slim).drop("source"), "mix-places")
    last_time, last_rank = cut(placed, max_epochs, share)

    def taken(epoch: int) -> Column:
        v = finish(F.col("__cum"), F.lit(epoch), F.col("source_size"), F.col("target"))
        return ((v <= 1) & (F.struct(v, F.col("source_rank")) <= F.struct(F.lit(last_time), F.lit(last_rank)))).cast("int")

    copies = sum((taken(e) for e in range(max_epochs)), F.lit(0))
    more, n_more = settle(placed.withColumn("copies", copies), n_sources, max_epochs, fills)
    names = ("size", "source_size", "target", "copies")
    out = place(rows).withColumn("copies", copies).join(C.small(more, n_more), ["source_rank", "__bin", "__rn"], "left")
    return C.unhold(out, names, "size", "source_size", "target", (F.col("copies") + F.coalesce("__more", F.lit(0))).cast("int").alias("copies"))


def settle(placed: DataFrame, n_sources: int, max_epochs: int, fills: int) -> tuple[DataFrame, int]:
    """(source_rank, __bin, __rn, __more: copies to add; number of rows): `fills` times, each source's longest document that its target has room for.

    A pass is one aggregate with a row a source; no source is gathered in a task.
    """
    key = ["source_rank", "__bin", "__rn"]
    room = placed.groupBy("source_rank").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("__room"))
    picked, n = C.counted(placed.select(*key).limit(0).withColumn("size", F.lit(0).cast("long")), "mix-fills")
    for _ in range(fills):
        used = picked.groupBy("source_rank").agg(F.sum("size").alias("__used"))
        left = room.join(C.small(used, n), "source_rank", "left").select("source_rank", (F.col("__room") - F.coalesce("__used", F.lit(0))).alias("__left"))
        more = picked.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("__more"))
        fits = placed.join(C.small(left, n_sources), "source_rank").filter((F.col("size") > 0) & (F.col("size") <= F.col("__left")))
        fits = fits.join(C.small(more, n), key, "left").filter(F.col("copies") + F.coalesce("__more", F.lit(0)) < max_epochs)
        best = fits.groupBy("source_rank").agg(F.max(F.struct("size", "__bin", "__rn")).alias("b")).select("source_rank", "b.__bin", "b.__rn", "b.size")
        picked, n = C.counted(picked.unionByName(best), "mix-fills")
    return picked.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("__more")), n


def cut(rows: DataFrame, max_epochs: int, share: float) -> tuple[float, int]:
    """The (finish time, source rank) of the last copy that the budget pays for.

    Copies are dealt to ranges of finish time, whose sums (at most RANGES * LAST + 1 rows) show in which of them the budget
    ends; that range is cut into RANGES again, by time, and once all times in it are one by source rank, until it holds a few copies, which are ordered.
    """
    slim = rows.select("size", "__cum", "source_rank", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("__epoch"))
    slim = slim.withColumn("__v", finish(F.col("__cum"), F.col("__epoch"), F.col("source_size"), F.col("target")))
    slim = C.durable(
        slim.withColumn("__range", F.floor(F.least("__v", F.lit(float(LAST))) * RANGES).cast("int")).groupBy("__range", "__v", "source_rank")
        .agg(F.sum("size").alias("size"), F.sum(F.when(F.col("__epoch") == 0, F.col("size")).otherwise(0)).alias("__once")),
        "mix-times",
    )
    budget = float(int(float(slim.agg(F.coalesce(F.sum("__once"), F.lit(0))).collect()[0][0]) * share))
    inside, before = slim.select("__v", "source_rank", "size", "__range"), 0
    while True:
        found = _range_of_end(inside, before, budget)
        if found is None:  # all copies fit
            return float("inf"), 0
        inside, before = inside.filter(F.col("__range") == found["__range"]), found["__before"]
        if found["__rows"] <= ORDERED or found["low"] == found["high"]:
            break
        by, low, high = ("__v", found["low"]["__v"], found["high"]["__v"]) if found["low"]["__v"] < found["high"]["__v"] else ("source_rank", found["low"]["source_rank"], found["high"]["source_rank"])
        part = F.floor((F.col(by).cast("double") - low) / F.lit(float(high - low) / RANGES))
        inside = inside.withColumn("__range", F.least(F.greatest(part, F.lit(0)), F.lit(RANGES)).cast("int"))
    running = F.sum("size").over(Window.orderBy("__v", "source_rank").rowsBetween(Window.unboundedPreceding, 0))
    latest = lambda df: df.agg(F.max(F.struct("__v", "source_rank")).alias("m")).collect()[0]["m"]
    last = latest(inside.withColumn("__total", running + before).filter(F.col("__total") <= budget))
    if last is None:  # the range's first copy is too long already: the copy before it is the last
        first = found["low"]
        last = latest(slim.filter(F.struct("__v", "source_rank") < F.struct(F.lit(first["__v"]), F.lit(first["source_rank"]))))
    return (last["__v"], last["source_rank"]) if last else (-1.0, 0)


def _range_of_end(rows: DataFrame, before: int, budget: float):
    """The range of rows in which the running total, `before` at its start, goes beyond the budget: __range, __before, __rows, its least and largest (__v, source_rank)."""
    at = F.struct("__v", "source_rank")
    sums = rows.groupBy("__range").agg(F.sum("size").alias("__n"), F.count(F.lit(1)).alias("__rows"), F.min(at).alias("low"), F.max(at).alias("high"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES * LAST + 1 rows at most
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)) + before)
    ends = sums.filter((F.col("__before") <= budget) & (F.col("__before") + F.col("__n") > budget)).limit(1).collect()
    return ends[0] if ends else None


def op7_weighted_mix(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size"), F.md5(C.text_or_empty("text")).alias("text_md5"))
    mixed = mix(C.durable(docs, "mix-documents"), size_col="size", tie_cols=("text_md5",))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
