"""Substring dedup (op 2): words covered by a window that is repeated anywhere are removed, found with an FM-index per shard.

Shards are dealt by content: each window of `width` words belongs to its minimizer, the least hash of its runs of RUN words, and
consecutive windows of one minimizer form a segment. Equal windows have equal minimizers, so every repeat is found
inside one shard, and each word is searched a bounded number of times however large the corpus is. Segments whose minimizer occurs once in
the corpus (in no other segment, and once in this) hold no repeat and are neither indexed nor searched; equal segments are counted and indexed once.
Minimizers that would be too frequent (common lines) are put last in the order, so that their windows go by another run of words. Windows whose
minimizer has more than HOT segments all the same (one phrase repeated, templates) are dealt and counted one by one, each by a digest of its own words
(16 bytes of BLAKE2b, taken for the words), so no shard's size grows with the corpus, nor do such windows take 35 times their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import textnum as N
from .fm_index import FMIndex, repeated_windows

RUN = 8
#: At most so many minimizers are put last (4 MB in each task), and only those with more segments than HOT.
HOT_SET, HOT = 500_000, 20_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive items."""
    if len(x) < w:
        return x[:0]
    have, m = 1, x
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = w - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def segments_of(w: N.Words, width: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimizer, times the minimizer stands in it) of each segment; windows are counted within their text."""
    n = len(w.first) - 1
    g = N.gram_hashes(w.hash, RUN) >> np.uint64(1)
    if len(hot):
        at = np.searchsorted(hot, g).clip(0, len(hot) - 1)
        g = g | ((hot[at] == g).astype(np.uint64) << np.uint64(63))
    m = sliding_min(g, width - RUN + 1)
    counts = np.diff(w.first)
    per = np.maximum(0, counts - width + 1)
    text = np.repeat(np.arange(n), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    key = m[w.first[:-1][text] + nth]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(text)))
    runs = size + width - RUN  # of words, in each segment
    ends = np.cumsum(runs)
    place = np.arange(runs.sum()) + np.repeat(w.first[:-1][text[at]] + nth[at] - ends + runs, runs)
    times = np.add.reduceat((g[place] == np.repeat(key[at], runs)).astype(np.int32), ends - runs) if len(at) else np.zeros(0, np.int32)
    return text[at], nth[at], size, key[at], times


def find_segments(docs: DataFrame, width: int, hot: np.ndarray) -> DataFrame:
    """doc_id, th, starts, sizes, keys, times: a row per document with a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in N.slices(batches):
            text, start, size, key, times = segments_of(N.words(data, off), width, hot)
            n = np.bincount(text, minlength=len(off) - 1)
            lists = [N.list_array(v, n) for v in (start.astype(np.int32), size.astype(np.int32), key.view(np.int64), times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], ["doc_id", "th", "starts", "sizes", "keys", "times"])

    found = docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, starts array<int>, sizes array<int>, keys array<long>, times array<int>")
    return C.durable(found.filter("size(keys) > 0"), "substring-segments")


def numbered(segs: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers from 1 on, a 0 after each sequence; where each starts; its words) of segments whose words are parted by single spaces."""
    data, off = N.column_bytes(segs)
    w = N.words(data[off[0] : off[-1]], off - off[0])
    flat, at = N.spaced(w, data[off[0] : off[-1]])
    each = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(flat)])
    code = each.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    length = np.diff(w.first)
    base = np.cumsum(length + 1) - length - 1
    text = np.zeros(len(code) + len(length), np.int64)
    text[np.arange(len(code)) + np.repeat(np.arange(len(length)), length)] = code
    return text, base, length


def shard_repeats(width: int):
    """For one shard's distinct segments (seg, n): the word ranges within each that repeated windows cover, by the segment's MD5."""

    def run(shard: pa.Table) -> pa.Table:
        segs = shard["seg"].combine_chunks()
        text, base, length = numbered(segs.cast(pa.large_binary()), width)
        many = shard["n"].to_numpy() > 1
        # a segment that stands several times is repeated as a whole; the others are searched
        index = FMIndex(text, 1 << (2 * width - 1).bit_length())
        seq, a, b = repeated_windows(index, text, base, np.where(many, 0, length - width + 1), width)
        whole = np.flatnonzero(many)
        seq = np.concatenate([seq, whole])
        a, b = np.concatenate([a, np.zeros(len(whole), np.int64)]), np.concatenate([b, length[whole] - width])
        found, which = np.unique(seq, return_inverse=True)
        sid = pa.array([hashlib.md5(x, usedforsecurity=False).hexdigest() for x in segs.take(pa.array(found)).to_pylist()], pa.string())
        return pa.table({"sid": sid.take(pa.array(which)), "a": pa.array(a.astype(np.int32)), "b": pa.array((b + width).astype(np.int32))})

    return run


def _digest(window: bytes) -> bytes:
    """What stands for a window that is dealt by itself: 16 bytes in place of its words, about 200."""
    return hashlib.blake2b(window, digest_size=16).digest()


def repeated_spans(docs: DataFrame, width: int, per_shard: int = 15_000) -> DataFrame:
    """doc_id, th, spans (word ranges, end exclusive) of docs (doc_id, th, text): what repeated windows cover; documents without any are left out."""
    hot = np.zeros(0, np.uint64)
    for last in (False, False, False, True):
        found = find_segments(docs, width, hot)
        keys = found.select(F.explode(F.arrays_zip("keys", "times")).alias("k")).groupBy(F.col("k.keys").alias("keys")).agg(F.sum("k.times").alias("n"))
        repeated, n_keys = C.counted(keys.filter("n > 1"), "substring-keys")
        total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
        most = max(HOT, total // HOT_SET)
        if last:
            break
        # a key with its top bit set is hot already: all runs of its windows are
        more = repeated.filter((F.col("n") > most) & (F.col("keys") >= 0)).select("keys").toPandas()["keys"].to_numpy(np.int64)  # at most HOT_SET
        if not len(more):
            break
        hot = np.unique(np.concatenate([hot, more.view(np.uint64)]))
        C.delete(found, repeated)
    each = found.select("doc_id", "th", F.explode(F.arrays_zip("starts", "sizes", "keys")).alias("s")).select("doc_id", "th", "s.starts", "s.sizes", "s.keys")
    kept = C.join_hot(each, repeated, "keys", n_keys, total).withColumn("single", F.col("n") > HOT)
    of_doc = kept.groupBy("doc_id", "th").agg(F.collect_list(F.struct("starts", "sizes", "keys", "single")).alias("segs"))
    o = of_doc.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "segs")
    texts = docs.join(o, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select("doc_id", "th", "text", "segs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in N.slices(batches):
            w = N.words(data, off)
            flat, at = N.spaced(w, data)
            segs = rows.column(3)
            s = segs.flatten()
            text = np.repeat(np.arange(len(segs)), np.diff(np.asarray(segs.offsets)))
            start, size, key, single = (s.field(k).to_numpy(zero_copy_only=False) for k in ("starts", "sizes", "keys", "single"))
            # windows of a minimizer that stayed hot are dealt one by one, so that no shard holds all of its segments
            n = np.where(single, size, 1)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            text, start, size, key, single = (np.repeat(x, n) for x in (text, start, np.where(single, 1, size), key, single))
            start = start + nth
            a = w.first[:-1][text] + start
            x, y, raw = at[a].tolist(), (at[a + size + width - 1] - 1).tolist(), flat.tobytes()
            place = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(place), rows.column(1).take(place), pa.array(start.astype(np.int32)), pa.array(key), pa.array([_digest(raw[i:j]) if one else raw[i:j] for i, j, one in zip(x, y, single.tolist(), strict=True)], pa.binary()), pa.array(single)],
                ["doc_id", "th", "start", "key", "seg", "single"],
            )

    places = texts.mapInArrow(cut, "doc_id long, th long, start int, key long, seg binary, single boolean")
    places, n_places = C.counted(places, "substring-places", "zstd")
    C.delete(found, repeated)
    distinct = places.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), F.bool_or("single").alias("single"))
    shards = max(1, total // per_shard)
    sharded = distinct.filter("not single").select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "seg", F.least("n", F.lit(2)).cast("int").alias("n"))
    ranges = sharded.groupBy("shard").applyInArrow(shard_repeats(width), "sid string, a int, b int")
    alone = distinct.filter("single and n > 1").select(F.md5("seg").alias("sid"), F.lit(0).alias("a"), F.lit(width).alias("b"))
    ranges = ranges.unionByName(alone).groupBy("sid").agg(F.collect_list(F.struct("a", "b")).alias("r"))
    spans = C.join_salted(places.select("doc_id", "th", "start", F.md5("seg").alias("sid")), ranges, "sid", "doc_id", n_places).select(
        "doc_id", "th", F.explode(F.transform("r", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))).alias("s")
    )
    out = C.durable(spans.groupBy("doc_id", "th").agg(F.collect_list("s").alias("spans")), "substring-spans")
    C.delete(places)
    return out


def dedup_substrings(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of docs (or those in carry) with n_words, n_removed, kept_text and removed_spans (word ranges); columns of these names are replaced.

    A word is removed if it is covered by a window of `width` words that also starts anywhere else, in the same document or in another;
    all occurrences go, the first too. Windows are judged on the input. kept_text has the kept words, joined by
    one space. Texts of any length are read whole; null and empty ones have no words; texts shorter than a window lose none; rows alike in id and text are
    each other's repeats. The id has to be a long. An empty table stays empty.
    """
    if width < RUN:
        raise ValueError(f"a window needs {RUN} words at least")
    text = C.text_or_empty(F.col(f"`{text_col}`"))
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = repeated_spans(slim, width).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "spans")
    new = ("n_words", "n_removed", "kept_text", "removed_spans")
    names = [c for c in (docs.columns if carry is None else carry) if c not in new]
    held = C.hold(docs).withColumn("__text", C.text_or_empty(C.field(text_col))).withColumn("__h", F.xxhash64("__text")).withColumn("__doc", C.field(id_col))
    held = held.select(F.struct(*[C.field(c).alias(c) for c in names]).alias("__kept"), "__doc", "__h", "__text")
    joined = held.join(spans, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    joined = joined.select(F.col("__kept").alias("__row"), "__text", "spans")
    schema = C.nullable(joined.select("__row").schema).add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("removed_spans", T.ArrayType(T.StructType().add("a", "integer").add("b", "integer")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in N.slices(batches, "__text"):
            w = N.words(data, off)
            flat, at = N.spaced(w, data)
            spans = rows.column(2)
            s = spans.flatten()
            head = np.repeat(w.first[:-1], pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
            cover = np.zeros(len(w.start) + 1, np.int64)
            for name, step in (("a", 1), ("b", -1)):
                np.add.at(cover, head + s.field(name).to_numpy(), step)
            gone = np.cumsum(cover[:-1]) > 0
            # a run of removed words starts and ends where the flag changes, and at the edges of a text
            first, n = w.first, len(off) - 1
            edge = np.zeros(len(gone) + 1, bool)
            edge[first] = True
            before, after = np.append(False, gone), np.append(gone, False)
            begins, ends = np.flatnonzero(after & (edge | ~before)), np.flatnonzero(before & (edge | ~after))
            of = np.searchsorted(first, begins, "right") - 1
            ranges = N.list_array(np.arange(len(begins)), np.bincount(of, minlength=n))
            pairs = pa.StructArray.from_arrays([pa.array((x - first[of]).astype(np.int32)) for x in (begins, ends)], ["a", "b"])
            sums = np.concatenate([[0], np.cumsum(gone)])
            # kept words with the space after each, but for the last of a text
            stays = np.repeat(~gone, np.diff(at))
            kept = np.flatnonzero(~gone)
            last = np.searchsorted(kept, first[1:]) - 1
            last = kept[last[(last >= 0) & (np.diff(first) - np.diff(sums[first]) > 0)]]
            stays[at[last + 1] - 1] = False
            offsets = np.concatenate([[0], np.cumsum(stays)])[at[first]].astype(np.int32)
            text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat[stays])])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(first)), pa.array(np.diff(sums[first])), text, pa.ListArray.from_arrays(ranges.offsets, pairs)],
                ["__row", *new],
            )

    return C.unhold(joined.mapInArrow(run, schema), new, *new)


def op2_fm_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(C.table(spark, sf_dir, "documents").select("doc_id", "text"), carry=("doc_id",))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
