"""Exact dedup (op 1): immutable snapshots with static binary-fuse filters, and batches screened against them.

A snapshot keeps the exact buckets (one row per distinct text: digest, the id that stays, group size) and one filter
per bucket. A new batch is first grouped by itself; its digests meet only their own bucket's filter, and only the
positives are joined with the exact bucket. Texts under one digest are compared byte for byte.

Only digests and ids are shuffled for the grouping, pre-aggregated, so a group of copies of any size is one row by then;
the texts of groups of two and more are gathered once for the byte check, again pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
#: The multipliers of a 64-bit finaliser.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(MIX[0])
    x = x ^ (x >> U(27))
    x = x * U(MIX[1])
    return x ^ (x >> U(31))


def fuse_slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray:
    """The three slots of each key, in three neighbouring segments."""
    h = mix64(keys + U(seed) * U(0x9E3779B97F4A7C15))
    first = ((h >> U(32)) * U(segments) >> U(32)).astype(np.int64)
    low = np.stack([h & U(0xFFFF_FFFF), mix64(h ^ U(1)), mix64(h ^ U(2))], axis=1) & U(segment - 1)
    return (first[:, None] + np.arange(3)) * segment + low.astype(np.int64)


def fingerprint(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mix64(keys ^ U(0xA5A5A5A5A5A5A5A5) ^ U(seed)) & U(0xFFFF)).astype(np.uint16)


def build_fuse(keys: np.ndarray) -> dict:
    """A filter over distinct 64-bit keys: xor of a key's three slots is its 16-bit fingerprint.

    Slots with one key left are peeled in rounds, and filled in the opposite order; keys peeled in one round never
    share the slot they are peeled by.
    """
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, int(np.ceil(n * room / segment)))
    for seed in range(1, 200):
        slots = fuse_slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        left = np.zeros(size, U)  # xor of (index + 1) of the keys still in a slot
        for j in range(3):
            np.bitwise_xor.at(left, slots[:, j], np.arange(1, n + 1).astype(U))
        rounds, todo = [], n
        ready = np.flatnonzero(count == 1)
        while todo and len(ready):
            key, at = np.unique(left[ready].astype(np.int64) - 1, return_index=True)
            by = ready[at]
            rounds.append((key, by))
            todo -= len(key)
            for j in range(3):
                np.bitwise_xor.at(left, slots[key, j], (key + 1).astype(U))
                np.subtract.at(count, slots[key, j], 1)
            touched = np.unique(slots[key].ravel())
            ready = touched[count[touched] == 1]
        if not todo:
            data, f = np.zeros(size, np.uint16), fingerprint(keys, seed)
            for key, by in reversed(rounds):
                data[by] = 0
                x = f[key] ^ data[slots[key, 0]] ^ data[slots[key, 1]] ^ data[slots[key, 2]]
                data[by] = x
            return {"seed": seed, "segment": segment, "segments": segments, "data": data.tobytes()}
        segments += max(1, segments // 50)
    raise ValueError("no filter could be built; are the keys distinct?")


def may_hold(filt: dict, keys: np.ndarray) -> np.ndarray:
    data = np.frombuffer(filt["data"], np.uint16)
    slots = fuse_slots(keys, int(filt["seed"]), int(filt["segment"]), int(filt["segments"]))
    return (data[slots[:, 0]] ^ data[slots[:, 1]] ^ data[slots[:, 2]]) == fingerprint(keys, int(filt["seed"]))


def digest_keys(digests: pd.Series) -> np.ndarray:
    """The last 64 bits of hex SHA-256 digests (buckets use the first)."""
    return np.array([int(x[-16:], 16) for x in digests], U)


def groups_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))


def build_snapshot(rows: DataFrame, n_rows: int, per_bucket: int = 100_000) -> tuple[DataFrame, DataFrame, int]:
    """(exact buckets, filters, hex digits of a bucket) of rows (digest, id). Buckets grow in number, not in size."""
    digits = C.hex_digits(n_rows, per_bucket)
    exact = C.durable(groups_of(rows).withColumn("bucket", F.substring("digest", 1, digits)), "snapshot-exact")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(digest_keys(pdf["digest"]))
        return pd.DataFrame([{"bucket": pdf["bucket"].iloc[0]} | build_fuse(keys)])

    filters = exact.select("bucket", "digest").groupBy("bucket").applyInPandas(one, "bucket string, seed int, segment int, segments int, data binary")
    return exact, C.durable(filters, "snapshot-filters"), digits


def screen(batch: DataFrame, filters: DataFrame, digits: int) -> DataFrame:
    """The digests of a grouped batch that the snapshot may hold: none that it holds is missing, about one other in 65,536 is let through."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[["digest"]].head(0)
        return left.loc[may_hold(right.iloc[0].to_dict(), digest_keys(left["digest"])), ["digest"]]

    batch = batch.select("digest", F.substring("digest", 1, digits).alias("bucket"))
    return batch.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(one, "digest string")


def exact_dedup(docs: DataFrame, in_snapshot, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 100_000) -> DataFrame:
    """docs with keep_id, group_size, kept, text_sha256; columns of these names are replaced.

    in_snapshot is a condition on docs' columns: rows that meet it make the immutable snapshot, the others come in as a new
    batch. Texts of any length are hashed whole. Null texts count as empty, and empty texts are equal. The largest id of a group stays (a null id only if
    all are null); rows that share this id as well as the text are all marked kept, for nothing tells them apart. An
    empty table stays empty. Should two different texts ever share a digest the query fails.
    """
    text = C.text_or_empty(C.field(text_col))
    held = C.hold(docs.withColumn("__old", F.coalesce(in_snapshot, F.lit(False)))).withColumn("__digest", F.sha2(text, 256))
    slim, n_rows = C.counted(held.select(F.col("__digest").alias("digest"), C.field(id_col).alias("id"), C.field("__old").alias("old")), "exact-digests")
    exact, filters, digits = build_snapshot(slim.filter("old"), n_rows, per_bucket)
    batch = C.durable(groups_of(slim.filter("not old")), "exact-batch")
    positive = screen(batch, filters, digits).join(exact.select("digest", F.col("keep").alias("__keep"), F.col("n").alias("__n")), "digest")
    merged = batch.join(positive, "digest", "left").select(
        "digest", F.greatest("keep", "__keep").alias("keep"), (F.col("n") + F.coalesce("__n", F.lit(0))).alias("n"), F.col("__n").isNotNull().alias("met")
    )
    merged = C.durable(merged, "exact-merged")
    groups = merged.drop("met").unionByName(exact.join(merged.filter("met").select("digest"), "digest", "left_anti").select("digest", "keep", "n"))
    groups, n_groups = C.counted(groups, "exact-groups")
    several, n_several = C.counted(groups.filter("n > 1").select("digest", "n"), "exact-several")
    # byte check: the texts of several rows under one digest, grouped by the text itself
    same = docs.select(F.sha2(C.text_or_empty(text_col), 256).alias("digest"), C.text_or_empty(text_col).alias("text"))
    same = C.join_hot(same, several, "digest", n_several, n_rows, "left_semi").groupBy("digest", "text").agg(F.count(F.lit(1)).alias("c"))
    clash = same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").limit(1).count()
    if clash:
        raise ValueError("two different texts share a SHA-256 digest")
    out = groups.select(F.col("digest").alias("__digest"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"))
    rows = C.join_hot(held, out, "__digest", n_groups, n_rows, times="group_size")
    kept = C.field(id_col).eqNullSafe(F.col("keep_id"))
    return C.unhold(rows, ("__old", "keep_id", "group_size", "kept", "text_sha256"), "keep_id", "group_size", kept.alias("kept"), F.col("__digest").alias("text_sha256"))


def op1_fuse_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The even ids stand for the snapshot of earlier days, the odd ones for today's batch."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, F.col("doc_id") % 2 == 0).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
