"""MinHash near-dedup (op 4): SuperMinHash signatures, banding, exact verification and union-find grouping.

Texts with equal shingle sets are one class from the start. A class's signature is made step by step: in step j every element sends j plus
a random fraction to the j-th place of its own permutation, and a text whose places are all taken below j + 1 needs no further step.
Bands of the signature make buckets. Within a bucket nobody is compared with everybody: all are compared with one
pivot, and found links join classes to components. Members of buckets that still hold several components are dealt anew by
their rarest shingles, of which two alike texts share one, and those buckets get further pivots, taken from outside the
bucket's largest component, until one component or nobody is left. So a family of n near copies costs about n
comparisons, and no pair that could still join two components goes unchecked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from . import textnum as N

U = np.uint64
#: 128 places in 32 bands of 4: two sets of similarity 0.8 share no band once in 20 million times.
PLACES, BANDS = 128, 32
#: Pivots that a bucket of rare shingles gets in one round.
PIVOTS = 1024


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n): the sorted distinct k-word shingles of each text, one after the other; a shorter text is one shingle, an empty one none."""
    w = N.words(N.LOWER[data], off)
    count = np.diff(w.first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out, at = np.zeros(n.sum(), U), np.cumsum(n) - n
    text = np.repeat(np.arange(len(n)), n)
    place = w.first[:-1][text] + np.arange(len(text)) - at[text]
    for size in range(1, k + 1):
        g = N.gram_hashes(w.hash, size)
        mine = (count[text] >= k) if size == k else (count[text] == size)
        out[mine] = N.mix(g[place[mine]] + U(size)) if mine.any() else 0
    for a, b in zip(at.tolist(), (at + n).tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], np.bincount(text[new], minlength=len(n))


def super_minhash(sets: np.ndarray, n: np.ndarray, places: int = PLACES) -> np.ndarray:
    """texts x places signature of the sets, each entry the step (top bits) and fraction of the least that reached the place."""
    sig = np.full(len(n) * places, ~U(0), U)
    text = np.repeat(np.arange(len(n)), n)
    x, perm = sets, None
    for j in range(places):
        if not len(x):
            break
        r = N.mix(x + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFF_FFFF_FFFF_FFFF))
        k = j + ((r & U(0xFFFF_FFFF)) * U(places - j) >> U(32)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            rows = np.arange(len(x))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, text * places + slot, (U(j) << U(56)) | (N.mix(r) >> U(8)))
        open_ = sig.reshape(-1, places).max(axis=1) >= U(j + 1) << U(56) if j + 1 < places else np.zeros(len(n), bool)
        go = open_[text]
        if j == 0:
            perm = np.tile(np.arange(places, dtype=np.uint8), (int(go.sum()), 1))
            perm[np.arange(len(perm)), k[go]] = 0
        else:
            perm = perm[go]
        x, text = x[go], text[go]
    return sig.reshape(-1, places)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, sig.shape[1] // bands)
    key = np.tile(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15), (len(sig), 1))
    for i in range(parts.shape[2]):
        key = N.mix(key ^ parts[:, :, i])
    return key


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th, n, d1, d2 (a 128-bit digest of the set), bands of docs (doc_id, th, text); bands are empty for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in N.slices(batches):
            sets, n = shingle_sets(data, off, k)
            full = n > 0
            keys = band_keys(super_minhash(sets, n)[full])
            digests = []
            for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                sums = np.concatenate([[U(0)], np.cumsum(N.mix(sets ^ U(seed)))])
                at = np.concatenate([[0], np.cumsum(n)])
                digests.append(pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)))
            bands = N.list_array(keys.reshape(-1).view(np.int64), np.where(full, BANDS, 0))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), *digests, bands], ["doc_id", "th", "n", "d1", "d2", "bands"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n long, d1 long, d2 long, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, n_ids: int, k: int) -> DataFrame:
    """id, set of the documents whose id is in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in N.slices(batches):
            sets, n = shingle_sets(data, off, k)
            yield pa.RecordBatch.from_arrays([rows.column(0), N.list_array(sets.view(np.int64), n)], ["id", "set"])

    few = docs.select("doc_id", "text").join(C.small(ids.select(F.col("id").alias("doc_id")), n_ids), "doc_id", "left_semi")
    return C.durable(few.mapInArrow(run, "id long, set array<long>"), "minhash-sets")


def verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """The (a, b) of n_pairs distinct pairs whose full sets are alike by percent or more, and their number. A pivot of very many pairs is parted by the other end."""
    if 2 * n_pairs <= C.BROADCAST_ROWS:  # only the sets in question move
        asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = sets.join(F.broadcast(asked), "id", "left_semi")
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = C.join_salted(C.join_salted(pairs.select("a", "b"), left, "a", "b", n_pairs), right, "b", "a", n_pairs)
    shared = F.size(F.array_intersect("sa", "sb"))
    return C.counted(both.filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "minhash-links")


def components(edges: DataFrame, n_edges: int | None = None) -> tuple[DataFrame, int]:
    """(node, comp: the least node reachable) of edges (a, b), and the number of rows: union-find by large and small stars until nothing moves."""

    def stars(e: DataFrame, n: int, small: bool) -> DataFrame:
        if small:  # each node and its lesser neighbours go to the least of them
            ends = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:  # a node's greater neighbours go to the least of all
            ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        joined = C.join_hot(ends, least, "u", 2 * n, 2 * n)
        if small:
            moved = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        else:
            moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.filter("a <> b")

    now, n, last = edges, edges.count() if n_edges is None else n_edges, None
    while True:
        new, rows = C.counted(stars(stars(now, n, small=False), 2 * n, small=True).distinct(), "minhash-stars")
        state = (rows, new.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0][0])
        if now is not edges:
            C.delete(now)
        now, n = new, rows
        if state == last:
            break
        last = state
    # all is stars now: each node but a centre has one edge, to its centre
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")))
    out = C.counted(ends.distinct(), "minhash-comps")
    C.delete(now)
    return out


def could_be_alike(percent: int):
    """A set can't be alike to one of less than percent of its size."""
    return 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")


def with_comp(rows: DataFrame, comp: DataFrame, n: int) -> DataFrame:
    """rows (id, ...) with each id's component so far, itself if it has no link."""
    c = C.small(comp.select(F.col("node").alias("id"), F.col("comp").alias("__c")), n)
    rows = rows.drop("comp")
    return rows.join(c, "id", "left").select(*rows.columns, F.coalesce("__c", "id").alias("comp"))


def several(rows: DataFrame, n: int) -> DataFrame:
    """The n rows' buckets (key) that hold more than one component, with `main`, the largest one."""
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("n"))
    return C.join_hot(rows, sizes.filter("comps > 1").select("key", "main", F.col("n").alias("__rows")), "key", n, n, times="__rows").drop("__rows")


def rare_buckets(docs: DataFrame, sets: DataFrame, n_shingles: int, percent: int) -> DataFrame:
    """key, id, n, rest: of n_shingles in all, the rarest shingles of docs (id, n, comp), enough of them that two sets alike by percent share one.

    Of n shingles a set has to share ceil(percent * n / 100), so among its rarest n - that + 1, by one order for
    all, is one that the other holds among its own. Shingles of a single document come first in that order and need no bucket:
    a text with a fifth of its own is out. So texts that share only a common passage, which meet in many bands, part here.
    """
    each = sets.join(docs.select("id", "n"), "id").select("id", "n", F.explode("set").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    each = C.join_hot(each, often, "key", n_shingles, n_shingles, times="c")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("c", "key"))
    each = each.withColumn("__rank", rank).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy("id")))
    # rest: shingles from this one on, in that order; no more can be shared by two texts whose first common one it is
    each = each.withColumn("rest", F.col("__all") - F.col("__rank") + 1)
    return each.filter(F.col("rest") >= F.ceil(F.col("n") * percent / 100)).select("key", "id", "n", "rest")


def group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, th, n_shingles, component_id of docs (doc_id, th, text)."""
    sig, n_sig = C.counted(signatures(docs, k), "minhash-signatures")
    # equal sets: digests held once need no class
    cls, n_cls = C.counted(sig.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "minhash-classes")
    whole = F.struct("d1", "d2").alias("d")
    joined = C.join_hot(sig.withColumn("d", whole), cls.select(whole, "rep", "c"), "d", n_cls, n_sig, "left", times="c") if n_cls else sig.withColumn("rep", F.lit(None).cast("long"))
    member = joined.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"), "bands")
    every = member.filter((F.col("n") > 0) & F.col("doc_id").eqNullSafe(F.col("rep"))).select(F.explode(F.array_distinct("bands")).alias("key"), F.col("rep").alias("id"), "n")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    bucket, n_bucket = C.counted(every.join(shared, "key", "left_semi").select("key", "id", "n"), "minhash-buckets")
    out = member.select("doc_id", "th", F.col("n").alias("n_shingles"), "rep")
    if not n_bucket:
        return out.withColumnRenamed("rep", "component_id")
    ids, n_ids = C.counted(bucket.groupBy("id").agg(F.min("n").alias("n")), "minhash-ids")
    sets = full_sets(docs, ids, n_ids, k)
    pivot = bucket.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count(F.lit(1)).alias("c")).select("key", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"), "c")
    pairs = C.join_hot(bucket, pivot, "key", n_bucket, n_bucket, times="c").filter((F.col("id") != F.col("pid")) & could_be_alike(percent))
    pairs, n_pairs = C.counted(pairs.select(F.col("pid").alias("a"), F.col("id").alias("b")).distinct(), "minhash-pairs")
    comp, n_comp = components(*verified(pairs, n_pairs, sets, percent))
    C.delete(pairs)
    unsure = several(with_comp(bucket.join(pivot.select("key", F.col("pid").alias("id")), ["key", "id"], "left_anti"), comp, n_comp), n_bucket)
    asked, n_asked = C.counted(unsure.groupBy("id").agg(F.min("n").alias("n")), "minhash-unsure")
    n_shingles = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    left, n_left = C.counted(rare_buckets(C.small(asked, n_asked), sets, n_shingles, percent), "minhash-rare")
    C.delete(bucket, ids, asked)
    done = None
    while n_left:
        rest = left if done is None else left.select("key", "id", "n", "rest").join(C.small(done.select("key", F.col("pid").alias("id")), n_done), ["key", "id"], "left_anti")
        now, n_left = C.counted(several(with_comp(rest, comp, n_comp), n_left), "minhash-left")
        C.delete(left, done)
        deal = F.pmod(F.xxhash64("id"), F.lit(PIVOTS))
        pivot = now.filter("comp <> main").groupBy("key", deal.alias("deal")).agg(F.min(F.struct("id", "n", "comp", "rest")).alias("p"))
        pivot = pivot.select("key", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"), F.col("p.comp").alias("pc"), F.col("p.rest").alias("pr"))
        left, (done, n_done) = now, C.counted(pivot, "minhash-pivots")
        if not n_done:
            break
        enough = (100 + percent) * F.least("rest", "pr") >= percent * (F.col("n") + F.col("pn"))
        near = now.join(F.broadcast(done), "key") if n_done <= C.BROADCAST_ROWS else C.join_salted(now, done, "key", "id", n_left)
        pairs = near.filter((F.col("comp") != F.col("pc")) & could_be_alike(percent) & enough)
        pairs, n_pairs = C.counted(pairs.select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct(), "minhash-pairs")
        if n_pairs:
            found, n_found = verified(pairs, n_pairs, sets, percent)
            if n_found:  # the components so far are stars already
                before = comp
                comp, n_comp = components(comp.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found), n_comp + n_found)
                C.delete(before)
            C.delete(found)
        C.delete(pairs)
    C.delete(left, done, sets)
    label = comp.select(F.col("node").alias("rep"), "comp").join(cls.select("rep", "c"), "rep", "left").select("rep", "comp", F.coalesce("c", F.lit(1)).alias("c"))
    return C.join_hot(out, label, "rep", n_comp, n_sig, "left", times="c").select("doc_id", "th", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_shingles, component_id and kept; columns of these names are replaced.

    Texts are lower-cased (A-Z) and cut at white space; their sets of k-word shingles are linked if alike by percent or more, and linked texts form
    components, named by their least id, whose row is kept. Null and empty texts have no shingle and are linked with nothing;
    texts shorter than k words are one shingle. Ids should be unique longs: rows alike in id and text get the same
    values, a null id is in a component with equal sets only. An empty table stays empty.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(C.text_or_empty(text_col)).alias("th"), C.text_or_empty(text_col).alias("text"))
    g = group(slim, k, percent).dropDuplicates(["doc_id", "th"])
    g = g.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "n_shingles", "component_id")
    held = C.hold(docs).withColumn("__h", F.xxhash64(C.text_or_empty(C.field(text_col)))).withColumn("__doc", C.field(id_col))
    rows = held.join(g, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")))
    return C.unhold(rows, ("n_shingles", "component_id", "kept"), "n_shingles", "component_id", F.col("__doc").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_superminhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.lit(0).cast("long").alias("th"), C.text_or_empty("text").alias("text"))
    return group(docs, k=4).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
