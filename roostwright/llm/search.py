"""Exact top-k search by inner product (op 13): a pivot table bounds every score, candidates are scored in the order of their bounds.

Pivots are far-apart vectors of a bounded sample. The table holds each vector's distance to every pivot, so by the triangle inequality
the distance of query and candidate is at least the largest difference of their rows, and with both norms that bounds their score from
above. A candidate's cell is its nearest pivot; cells are parted into blocks of bounded size, however many vectors one holds.

Each block first answers its own queries, which gives every query a score that its k best can't fall below. A query then visits
only the cells whose best possible bound (by the cell's least and largest distances) reaches that score. A tile is one block and
one part of the queries; the tile gives at most k candidates a query. Rows reach tiles by Spark's shuffle, nothing passes through the driver
but the pivots and the cells' ranges, a row a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .whitening import finite, matrix

#: Pivots (and cells) at most, and vectors of the sample that they are picked from.
PIVOTS, SAMPLE = 64, 2000
#: Vectors of a block and queries of a tile at most: about 8 MB of longs and distances each.
BLOCK_ROWS, TILE_QUERIES = 8192, 8192
#: Share of the squared lengths that bounds are raised by: what rounded distances can take off them.
SLACK = 1e-5

HIT = "query bigint, query_id bigint, vec_id bigint, score bigint"


@dataclass(frozen=True)
class Cells:
    """The least and largest distance of each cell's vectors to every pivot, and the largest of their squared lengths."""

    low: np.ndarray
    high: np.ndarray
    long: np.ndarray


def pick_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x: one, then again and again the one farthest from those picked; fewer if the rest are copies."""
    out, far = [], np.full(len(x), np.inf)
    at = 0
    while len(out) < min(most, len(x)) and far[at] > 0:
        out.append(at)
        far = np.minimum(far, ((x - x[at]) ** 2).sum(axis=1))
        at = int(far.argmax())
    return x[out]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row to each pivot."""
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def from_above(lengths: np.ndarray, more: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The largest score of vectors with these squared lengths that are at least so far apart; rounding is allowed for."""
    both = lengths + more
    return np.floor((both - apart * apart) / 2 + SLACK * (both + 1))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores; ties by the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    return (x @ q).astype(np.int64) if exact else (x.astype(np.int64) @ q.astype(np.int64))


@dataclass
class Block:
    """Vectors of one block with their rows of the pivot table."""

    row: np.ndarray
    ids: np.ndarray  # what stands for a null id is larger than all others
    x: np.ndarray
    table: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(t: pa.Table) -> Block:
        n = t.num_rows
        x = t["x"].combine_chunks().flatten().to_numpy().reshape(n, -1).astype(np.float64)
        table = t["table"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        ids = t["vec_id"].fill_null((1 << 63) - 1).to_numpy()
        return Block(t["row"].to_numpy(), ids, x, table, (x * x).sum(axis=1))

    def search(self, queries: Block, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, its k best places here, their scores), but for candidates below floor (the score that its k best reach anyway)."""
        # floats hold integers up to 2^53 exactly, and so every sum of such products that stays below
        top = np.abs(self.x).max(initial=0) * np.abs(queries.x).max(initial=0) * max(1, self.x.shape[1])
        if top >= 2.0**63:
            raise OverflowError("a score doesn't fit a long")
        exact, part = top < 2.0**53, max(1, (1 << 22) // max(1, len(self.x)))
        for lo in range(0, len(queries.x), part):
            q = slice(lo, lo + part)
            apart = np.zeros((len(queries.x[q]), len(self.x)))
            for p in range(self.table.shape[1]):
                np.maximum(apart, np.abs(queries.table[q, p, None] - self.table[None, :, p]), out=apart)
            bounds = from_above(queries.lengths[q, None], self.lengths, apart)
            for i in range(len(bounds)):
                yield lo + i, *self.one(queries.x[lo + i], queries.row[lo + i], bounds[i], floor[lo + i], k, exact)

    def one(self, q: np.ndarray, own: int, bounds: np.ndarray, floor: int, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        least = int(floor)
        left = np.flatnonzero((bounds >= least) & (self.row != own))
        left = left[np.argsort(-bounds[left], kind="stable")]
        at, scores, lo, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
        while lo < len(left):
            if len(at) >= k:
                least = max(least, int(scores[-1]))
            if bounds[left[lo]] < least:  # no later one can be better, or tie
                break
            new = left[lo : lo + step]
            at, scores = np.append(at, new), np.append(scores, products(self.x[new], q, exact))
            top = best(scores, self.ids[at], k)
            at, scores, lo, step = at[top], scores[top], lo + step, step * 4
        return at[scores >= floor], scores[scores >= floor]


def table_rows(vectors: DataFrame, scale: int, id_col: str, vec_col: str, pivots_of) -> tuple[DataFrame, np.ndarray]:
    """(row, vec_id, x, table, cell; the pivots). row is a number of its own for each vector, x holds floor(scale * entry)."""
    slim = vectors.filter(finite(F.col(f"`{vec_col}`"))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("vector"))
    sample = slim.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return slim.select(F.lit(0).cast("long").alias("row"), "vec_id"), np.zeros((0, 0))
    pivots = pivots_of(matrix(sample["vector"].combine_chunks(), scale).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2), scale)
            if x.shape[1] != pivots.shape[1]:
                raise ValueError(f"vectors of one length are needed, not of {pivots.shape[1]} and {x.shape[1]}")
            if x.size and np.abs(x).max() >= 1 << 53:
                raise OverflowError("an entry doesn't fit a double exactly")
            d = distances(x.astype(np.float64), pivots)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel())) for v in (x, d)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, pa.array(d.argmin(axis=1).astype(np.int32))], ["row", "vec_id", "x", "table", "cell"])

    numbered = slim.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector")
    return C.durable(numbered.mapInArrow(run, "row long, vec_id long, x array<long>, table array<double>, cell int"), "search-table"), pivots


def in_blocks(table: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(table with salt, the block of its cell; cells: cell, n, blocks, low, high, long): cells of any size fall into blocks of about block_rows."""
    d = F.posexplode("table").alias("p", "d")
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    per = table.select("cell", d).groupBy("cell", "p").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    ranges = per.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("p", "lo", "hi"))).alias("r"))
    sizes = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("long"))
    cells = C.durable(sizes.join(ranges, "cell").select("cell", "n", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), "long", F.col("r.lo").alias("low"), F.col("r.hi").alias("high")), "search-cells")
    blocks = F.broadcast(cells.select("cell", "blocks"))  # PIVOTS rows at most
    return table.join(blocks, "cell").withColumn("salt", F.pmod(F.xxhash64("row"), "blocks").cast("int")).drop("blocks"), cells


def tiles(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """HIT rows of each tile (cell, salt, part): its queries against its rows, at most k each."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            block, asked = Block.of(left), Block.of(right)
            ids, asked_ids = left["vec_id"].to_pylist(), right["vec_id"].to_pylist()
            for i, at, scores in block.search(asked, right["floor"].to_numpy(), k):
                out["query"] += [int(asked.row[i])] * len(at)
                out["query_id"] += [asked_ids[i]] * len(at)
                out["vec_id"] += [ids[j] for j in at]
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    keys = ("cell", "salt", "part")
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, HIT)


def reachable(queries: DataFrame, cells: Cells) -> DataFrame:
    """queries with visits: the cells that can hold a candidate of score `floor` or more."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema), "visits array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = Block.of(pa.Table.from_batches([b]))
            floor, ok = b.column(b.schema.get_field_index("floor")).to_numpy(), np.zeros((b.num_rows, len(cells.low)), bool)
            for c in range(len(cells.low)):
                apart = np.maximum(cells.low[c] - q.table, q.table - cells.high[c]).max(axis=1, initial=0)
                ok[:, c] = from_above(q.lengths, cells.long[c], apart) >= floor
            size, (_, at) = ok.sum(axis=1), np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(at.astype(np.int32)))], [*b.schema.names, "visits"])

    return queries.mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", most_pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """query (the query row's own number), query_id, rank (from 1), vec_id, score: the k highest inner products of floor(scale * entry) for each query row.

    is_query is a condition on `vec_id`. Candidates are all rows but the query's own; ties go to the smaller id, a null id last. Rows
    with equal ids are rows and queries of their own. Vectors that are null or hold null or non-finite entries take no part; vectors of
    different lengths, scaled entries of 2^53 and scores beyond a long are an error. An empty table, or one without queries, gives an empty result; a query alone has none.
    Other columns are ignored. Exact: bounds only decide what isn't scored.
    """
    table, pivots = table_rows(vectors, scale, id_col, vec_col, lambda x: pick_pivots(x, most_pivots))
    if not len(pivots):
        return table.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    rows, cells = in_blocks(table, block_rows)
    rows = C.durable(rows, "search-blocks")
    C.delete(table)
    known = cells.orderBy("cell").toArrow()
    shape = (known.num_rows, len(pivots))
    ranges = Cells(*(known[c].combine_chunks().flatten().to_numpy().reshape(shape) for c in ("low", "high")), known["long"].to_numpy())
    asked = rows.filter(F.coalesce(is_query, F.lit(False)))
    n_queries = asked.count()
    none = F.lit(-(1 << 63)).cast("long")
    first = C.durable(tiles(rows.withColumn("part", F.lit(0)), asked.withColumns({"floor": none, "part": F.lit(0)}), k), "search-own")
    reached = first.groupBy("query").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("got")).filter(F.col("got") >= k)
    asked = asked.withColumnRenamed("row", "query").join(reached.select("query", "floor"), "query", "left").withColumn("floor", F.coalesce("floor", none)).withColumnRenamed("query", "row")
    parts = max(1, -(-n_queries // tile_queries))
    visits = reachable(asked.select("row", "vec_id", "x", "table", "floor", F.col("cell").alias("own_cell"), F.col("salt").alias("own_salt")), ranges)
    number = F.element_at(F.array(*map(F.lit, known["cell"].to_pylist())), F.col("visit") + 1)
    blocks = cells.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    visits = visits.withColumn("visit", F.explode("visits")).withColumn("cell", number).drop("visits", "visit")
    visits = visits.join(blocks, "cell").filter((F.col("cell") != F.col("own_cell")) | (F.col("salt") != F.col("own_salt"))).drop("own_cell", "own_salt")
    visits = visits.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    second = tiles(rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), visits, k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query", "query_id", "rank", "vec_id", "score")


def op13_pivot_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")
