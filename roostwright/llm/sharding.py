"""Sharding (op 8): a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number by the md5 of its id and ties, the permutation scatters the numbers, and
shard = permuted mod shards, slot = permuted div shards. So shard sizes differ by one at most (law `rows`), slots are
gapless from 0, and a row's place can be computed from its number alone. Columns and SQL functions only.

Row numbers need no global sort in one task: rows are counted by md5 prefix, the few counts are summed up,
and each prefix is ordered by itself. The text crosses the network once, if the caller's columns hold it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Fixed values of the round function: a prime below 2^31, and multipliers.
PRIME, MULT, ROUND_MULT = 2147483647, 48271, 69621


def sides(n: int) -> tuple[int, int, int]:
    """(a, b, outside): the sides of the square-like cell a * b that holds 0..n-1 with the fewest values to spare, a from the root of n to twice that."""
    root = max(1, math.isqrt(max(n, 1) - 1) + 1)
    a = np.arange(root, 2 * root + 1, dtype=np.int64)
    spare = -n % a
    i = int(spare.argmin())
    return int(a[i]), max(1, -(-n // int(a[i]))), int(spare[i]) if n else 1


def round_keys(seed: int, rounds: int = 6) -> list[int]:
    out, x = [], seed % PRIME
    for _ in range(rounds):
        x = (x * 16807 + 12345) % PRIME
        out.append(x)
    return out


def _round(x: Column, key: int) -> Column:
    t = (x % PRIME * MULT + key) % PRIME
    t = t * t % PRIME
    return (t * ROUND_MULT + x % PRIME) % PRIME


def _step(i: int, key: int, a: Column, b: Column):
    """Round i as a function of one (p, q); a second parameter would be taken for an array's index."""
    if i % 2 == 0:
        return lambda v: F.struct(((v["p"] + _round(v["q"], key)) % a).alias("p"), v["q"].alias("q"))
    return lambda v: F.struct(v["p"].alias("p"), ((v["q"] + _round(v["p"], key)) % b).alias("q"))


def permute_once(x: Column, a: Column, b: Column, keys: list[int]) -> Column:
    """One pass over 0 <= x < a*b: x is a pair of digits, and each round adds a function of one digit to the other."""
    s = F.struct((x - x % b).alias("p"), (x % b).alias("q"))
    cell = F.transform(F.array(s), lambda v: F.struct(F.floor(v["p"] / b).cast("long").alias("p"), v["q"].alias("q")))
    for i, key in enumerate(keys):
        cell = F.transform(cell, _step(i, key, a, b))
    return F.get(F.transform(cell, lambda v: v["p"] * b + v["q"]), F.lit(0))


def permute(x: Column, n: Column, a: Column, b: Column, seed: int, outside: int) -> Column:
    """The place of x among 0..n-1: passes are repeated until the value is below n again.

    Only `outside` = a * b - n values are not below n, and a walk meets none of them twice, so outside + 1 passes
    always end it; sides() makes them few (none or one as a rule, and less than a).
    """
    keys = round_keys(seed)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(outside + 1)),
        F.struct(x.cast("long").alias("v"), F.lit(False).alias("ok")),
        lambda s, _: F.when(s["ok"], s).otherwise(
            F.get(F.transform(F.array(permute_once(s["v"], a, b, keys)), lambda v: F.struct(v.alias("v"), (v < n).alias("ok"))), F.lit(0))
        ),
        lambda s: s["v"],
    )


def shard(docs: DataFrame, n_shards: int = 16, seed: int = 8, id_col: str = "doc_id", tie_cols: tuple[str, ...] = ("text",), per_bin: int = 4096) -> DataFrame:
    """docs with row_number, shard (int) and slot (long); columns of these names are replaced.

    A null id counts as a value of its own. Rows of one id are told apart, and spread, by tie_cols (those that docs has);
    rows that agree in these too are alike, and either order gives the same table. An empty table stays empty.
    The same rows give the same places, however they are partitioned.
    """
    n = docs.count()
    a, b, outside = sides(n)
    digits = C.hex_digits(n, per_bin)
    key = C.spread_key("", C.field(id_col), [C.field(c) for c in tie_cols if c in docs.columns])
    rows = C.hold(docs).withColumn("__k", key).withColumn("__bin", F.substring("__k", 1, digits))
    bins = rows.groupBy("__bin").agg(F.count(F.lit(1)).alias("__n"))
    bins = C.running_before(bins, "__bin", "__n", "__start")
    starts = bins.select(F.col("__bin").alias("__of"), "__start")
    order = Window.partitionBy("__bin").orderBy("__k", C.field(id_col))
    placed = rows.withColumn("__rn", F.row_number().over(order)).join(C.small(starts, 16**digits), F.col("__bin") == F.col("__of"))
    placed = placed.withColumn("__number", F.col("__start") + F.col("__rn") - 1)
    placed = placed.withColumn("__perm", permute(F.col("__number"), F.lit(n), F.lit(a), F.lit(b), seed, outside))
    return C.unhold(
        placed,
        ("row_number", "shard", "slot"),
        F.col("__number").alias("row_number"),
        (F.col("__perm") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("__perm") / F.lit(n_shards)).cast("long").alias("slot"),
    )


def op8_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(C.text_or_empty("text")).cast("long") + 1).alias("size"),
        F.crc32(C.text_or_empty("text")).alias("text_crc32"),
        F.md5(C.text_or_empty("text")).alias("text_md5"),
    )
    placed = shard(docs, tie_cols=("text_md5",))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
