"""What the training-data operators share: the shared folder, size-checked broadcasts, and prefix sums over hash bins."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word, in Java's and RE2's syntax alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a slim table (a few numbers or one digest a row) is broadcast: 500,000 x 64 bytes = 32 MB.
BROADCAST_ROWS = 500_000
#: A key is hot if it has more rows than HOT_ROWS and than one in HOT_KEYS of all, so there are less than HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it a temporary folder serves in local mode, where
    there is one machine only; elsewhere executors would write to disks that nobody else reads, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="roostwright-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: The folders made by each scratch that is open, innermost last; of this thread only, so that two pipelines of one driver don't take each other's.
_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def counted(df: DataFrame, tag: str, compression: str = "snappy") -> tuple[DataFrame, int]:
    """df, written once as Parquet to the shared folder and read back, and its number of rows, counted by the writing itself.

    Its lineage ends here, and a lost executor loses none of it. The folder goes by `delete`, with its `scratch`, or when the driver ends.
    """
    spark, rows = df.sparkSession, Observation()
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.option("compression", compression).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(nullable(df.schema)).parquet(path)
    _paths[out] = path
    if _made.get():
        _made.get()[-1].append(path)
    return out, rows.get["n"]


def durable(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    return counted(df, tag, compression)[0]


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def delete(*spent: DataFrame | None) -> None:
    """Removes the folders of tables that `durable` gave and nothing reads any more; other DataFrames are left alone."""
    for df in spent:
        if df is not None and (path := _paths.pop(df, None)):
            _remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `durable` writes inside are removed at the end, but for those passed through what it gives: with scratch(spark) as keep: out = keep(durable(...))."""
    mine: list[str] = []
    opened = _made.set((*_made.get(), mine))

    def keep(df: DataFrame) -> DataFrame:
        mine.remove(_paths[df])
        return df

    try:
        yield keep
    finally:
        _made.reset(opened)
        for path in mine:
            _remove(spark, path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def small(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; otherwise as it is, and Spark shuffles the join."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df


def hot_above(rows: int) -> int:
    """How many rows of one key are too many for one task; less than HOT_KEYS keys can have more."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def join_hot(rows: DataFrame, keyed: DataFrame, on: str, n_keyed: int, n_rows: int, how: str = "inner", times: str = "n") -> DataFrame:
    """rows joined (inner, left or left_semi) with keyed, which has a row a key and in `times` how often rows hold it.

    A small `keyed` is broadcast. Otherwise the keys of very many rows are, which are few by their very frequency, and only the other rows are
    shuffled: no key's rows meet in one task.
    """
    if n_keyed <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed), on, how)
    hot = F.broadcast(keyed.filter(F.col(times) > hot_above(n_rows)))
    rest = rows.join(hot.select(on), on, "left_anti").join(keyed.filter(F.col(times) <= hot_above(n_rows)), on, how)
    return rows.join(hot, on, "left_semi" if how == "left_semi" else "inner").unionByName(rest)


def join_salted(rows: DataFrame, other: DataFrame, on: str, by: str, n_rows: int) -> DataFrame:
    """rows joined with other, which has a row a key, wide ones maybe: a key of very many rows is parted by the hash of `by`, with a copy of its `other` row for each part."""
    if n_rows <= HOT_ROWS:  # no key can have more
        return rows.join(other, on)
    most = hot_above(n_rows)
    hot = rows.groupBy(on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    hot = F.broadcast(hot.select(on, F.ceil(F.col("__n") / most).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(hot, on, "left").withColumn("__salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    right = other.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [on, "__salt"]).drop("__salt")


def hex_digits(rows: int, per_bin: int = 4096, least: int = 1, most: int = 6) -> int:
    """How many leading hex digits of a digest make bins of about per_bin rows."""
    return min(most, max(least, math.ceil(math.log(max(1, rows / per_bin), 16))))


def running_before(bins: DataFrame, bin_col: str, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """bins with out = the sum of value over all earlier bins of the same `by`.

    bin_col holds hex prefixes. Two levels: sums over the first three digits (4,096 rows at most for each `by`), and
    within each of them over the rest; so no task gets more than 4,096 bins of one `by`.
    """
    head = F.substring(bin_col, 1, 3)
    b = bins.withColumn("__head", head)
    tops = b.groupBy(*by, "__head").agg(F.sum(value).alias("__top"))
    before = Window.partitionBy(*by).orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__above", F.coalesce(F.sum("__top").over(before), F.lit(0))).drop("__top")
    within = Window.partitionBy(*by, "__head").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    inner = b.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    keys = [*by, "__head"]
    cond = None
    t = tops.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__above")
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        cond = c if cond is None else cond & c
    return inner.join(t, cond).withColumn(out, F.col("__in") + F.col("__above")).drop("__in", "__above", "__head", *[f"__k{i}" for i in range(len(keys))])


def spread_key(seed: str, id_: Column, ties: list[Column]) -> Column:
    """An md5 that shuffles rows: of the id (null being one) and of what else tells rows apart, so that rows without an id, or of one id, are spread too."""
    parts = [F.lit(seed), F.coalesce(id_.cast("string"), F.lit("null"))]
    for t in ties:
        parts += [F.lit(":"), F.md5(F.coalesce(t.cast("string"), F.lit("")))]
    return F.md5(F.concat(*parts))


def in_order(df: DataFrame, order: list[Column], sums: dict[str, str], tag: str) -> DataFrame:
    """df with its place (`__place`, from 1) in this order, and for each out -> column of sums the sum over all rows before.

    A range sort deals the rows out, each part is summed by itself, and the parts' totals, a row a partition, are added up: no task gets all rows.
    """
    placed = durable(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)), tag)
    each = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__t_{o}") for o, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__b_{o}") for o, c in [("__place", "__n"), *((o, f"__t_{o}") for o in sums)]])
    inside = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(each), "__part").withColumn("__place", F.col("__b___place") + F.row_number().over(Window.partitionBy("__part").orderBy("__id")))
    out = out.withColumns({o: F.col(f"__b_{o}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in sums.items()})
    return out.drop("__part", "__id", "__b___place", *[f"__b_{o}" for o in sums])


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def hold(df: DataFrame, names: list[str] | None = None, *more: Column) -> DataFrame:
    """df (or those columns in names) packed into one struct column `__row`, so that working columns, `more`, can't clash with the user's."""
    names = df.columns if names is None else names
    packed = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).cast("int").alias("__none"))
    return df.select(packed.alias("__row"), *more)


def hold_text(df: DataFrame, names: tuple[str, ...] | None, text_col: str, *more: Column) -> tuple[DataFrame, str | tuple[str, str]]:
    """(df held, where its text is for textnum.slices): inside the row where names have it, so that it isn't sent twice."""
    names = df.columns if names is None else list(names)
    if text_col in names:
        return hold(df, names, *more), ("__row", text_col)
    return hold(df, names, F.col(f"`{text_col}`").alias("__text"), *more), "__text"


def field(name: str) -> Column:
    return F.col("__row").getField(name)


def unhold(df: DataFrame, drop: tuple[str, ...] = (), *more: Column) -> DataFrame:
    """The user's columns without `drop`, then `more`."""
    names = [f.name for f in df.schema["__row"].dataType.fields if f.name not in (*drop, "__none")]
    return df.select(*[F.col("__row").getField(n).alias(n) for n in names], *more)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
