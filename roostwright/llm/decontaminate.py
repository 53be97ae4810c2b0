"""Benchmark decontamination (op 9): SimHash of item-sized windows, multi-index Hamming search, exact verification.

A window of as many words as a benchmark item is alike to it if the weighted similarity of their 5-word shingles (each
weighing as often as it stands there: shared weight over joint weight) is 0.8 or more. Windows in which fewer than
0.8 of the places hold shingles of items of their size can't be, and are passed over by one running count; the others get a
256-bit SimHash. Fingerprints of items within RADIUS bits share a 16-bit block up to RADIUS / 16 = 4 bits, so looking a
window's blocks and their neighbours up among the items' blocks and theirs, 4 bits away together, misses none within the radius; what is
found is verified on the words themselves.

One pass over the corpus, no shuffle, one Python worker for each task slot: it takes some MB of text at a time and goes through the
benchmark's blocks, which are of bounded size, one after another.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from . import textnum as N

U = np.uint64
#: 256 bits; similarity 0.8 means an angle of 27 degrees, 39 bits on average with a deviation of 5.7, so 72 is nearly six of these above.
BITS, BLOCK, RADIUS = 256, 16, 72
#: Items and words in one block of the benchmark. A worker holds 9 bytes a word of all blocks and about 75 a word of the one it is at: 36 and 306 MB were measured for 100,000 items of 40 words.
BLOCK_ITEMS, BLOCK_WORDS = 131_072, 4_000_000
#: Bytes of text that a worker takes through the blocks at once, where there are several.
CHUNK = 32 << 20
#: Entries for each of the 16 blocks that the items' neighbours may take in a worker's table, 4 bytes each: the more bits items come to meet a window by, the fewer it looks up.
ENTRIES = 1_200_000
#: By number of bits: all changes of a 16-bit value by so many or fewer.
FLIPS = [np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(BLOCK), n)], np.uint16) for most in range(RADIUS // (BITS // BLOCK) + 1)]


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text's word hashes; of all its words if they are fewer."""
    return N.mix(N.gram_hashes(h, min(k, len(h))) + U(min(k, len(h)))) if len(h) else np.zeros(0, U)


def simhash(s: np.ndarray) -> np.ndarray:
    """The fingerprint, as 16 blocks of 16 bits, of shingles that count as often as they stand.

    The second, third, ... time a shingle stands is a vote of its own, so the angle follows from the weighted similarity for repeated ones too.
    """
    t = np.sort(s)
    new = np.append(True, t[1:] != t[:-1])[: len(t)]
    if not new.all():
        place = np.arange(len(t))
        nth = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(U)
        s = np.where(nth > 0, N.mix(t ^ (nth * U(0x9E3779B97F4A7C15))), t)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, BITS, 64):
        bits = np.unpackbits(N.mix(s ^ U(0x632BE59BD9B4E019 * (i // 64 + 1) & 0xFFFF_FFFF_FFFF_FFFF)).view(np.uint8).reshape(-1, 8), axis=1)
        votes[i : i + 64] = 2 * bits.sum(axis=0, dtype=np.int64) - len(s)
    return np.packbits(votes > 0).view(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum(min(n, y[s]) for s, n in x.items() if s in y)
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


@dataclass
class Index:
    """Items of a benchmark block, ready for search."""

    ids: list[int]
    lengths: np.ndarray  # words
    sets: list[np.ndarray]  # shingles
    prints: np.ndarray  # items x 16
    k: int
    _near: list = field(default_factory=list)

    @classmethod
    def of(cls, ids: list[int], texts: list[str], k: int) -> Index:
        col = pa.array(texts, pa.string())
        w = N.words(*(lambda d, o: (N.LOWER[d], o))(*N.column_bytes(col)))
        sets = [shingles(w.hash[a:b], k) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        keep = [i for i, s in enumerate(sets) if len(s)]
        prints = np.array([simhash(sets[i]) for i in keep], np.uint16).reshape(-1, BITS // BLOCK)
        return cls([ids[i] for i in keep], np.diff(w.first)[keep], [sets[i] for i in keep], prints, k)

    def by_length(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By a shingle's number of words (k, and fewer for items shorter than that): sorted shingles, and for each the lengths of the items that hold it."""
        out = {}
        for k in {min(self.k, int(n)) for n in self.lengths}:
            mine = [(np.unique(s), n) for s, n in zip(self.sets, self.lengths, strict=True) if min(self.k, int(n)) == k]
            flat, size = np.concatenate([s for s, _ in mine]), np.concatenate([np.full(len(s), n) for s, n in mine])
            order = np.lexsort((size, flat))
            flat, size = flat[order], size[order]
            new = np.append(True, (flat[1:] != flat[:-1]) | (size[1:] != size[:-1]))
            flat, size = flat[new], size[new]
            s, first = np.unique(flat, return_index=True)
            out[k] = (s, np.append(first, len(flat)), size)
        return out

    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, items, the changes that a window has to look up): 65,537 starts into items for each block, by 16-bit value; the values are the items' own and their neighbours by half of the bits or fewer, as many as ENTRIES hold."""
        if not self._near:
            bits = next(b for b in (2, 1, 0) if not b or len(FLIPS[b]) * len(self.ids) <= ENTRIES)
            starts, parts = [], []
            for j in range(BITS // BLOCK):
                values = (self.prints[:, j, None] ^ FLIPS[bits][None]).ravel()
                parts.append(np.repeat(np.arange(len(self.ids), dtype=np.int32), len(FLIPS[bits]))[np.argsort(values, kind="stable")])
                starts.append(np.append(0, np.cumsum(np.bincount(values, minlength=65536))) + j * len(values))
            self._near += [np.concatenate(starts), np.concatenate(parts), FLIPS[len(FLIPS) - 1 - bits]]
        return tuple(self._near)

    def search(self, window: np.ndarray) -> np.ndarray:
        """The items whose fingerprints are within RADIUS bits of a window's: one of their blocks is RADIUS // 16 bits apart at most."""
        at, items, flips = self.near()
        values = ((window[:, None] ^ flips[None]).astype(np.int64) + 65537 * np.arange(BITS // BLOCK)[:, None]).ravel()
        first, n = at[values], at[values + 1] - at[values]
        met = np.zeros(len(self.ids), bool)
        met[items[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        cand = np.flatnonzero(met)
        return cand[np.bitwise_count(self.prints[cand] ^ window).sum(axis=1, dtype=np.int64) <= RADIUS]

    def leaks(self, h: np.ndarray, hits: dict[int, tuple[np.ndarray, np.ndarray]], known: dict, least: float) -> list[dict]:
        """The best window for each item in a text of word hashes h; hits[k]: the places that hold k-word shingles of the benchmark, and which."""
        best: dict[int, tuple[float, int, int]] = {}
        for k, (place, which) in hits.items():
            _, at, sizes = known[k]
            n_sizes = at[which + 1] - at[which]
            place = np.repeat(place, n_sizes)
            size_of = sizes[np.repeat(at[which] - np.cumsum(n_sizes) + n_sizes, n_sizes) + np.arange(len(place))]
            for size in np.unique(size_of).tolist():
                n = min(size, len(h))
                run = np.zeros(len(h) - k + 2, np.int64)
                run[place[size_of == size] + 1] = 1
                run = np.cumsum(run)
                count = run[n - k + 1 :] - run[: len(run) - (n - k + 1)]
                for start in np.flatnonzero(count >= least * (size - k + 1)).tolist():
                    s = shingles(h[start : start + n], k)
                    for i in self.search(simhash(s)).tolist():
                        sim = similarity(s, self.sets[i])
                        if sim >= least and (sim, -start) > (best.get(i, (0.0, 0, 0))[0], -best.get(i, (0.0, 0, 0))[1]):
                            best[i] = (sim, start, n)
        return [{"item_id": self.ids[i], "start": a, "n_words": n, "similarity": s} for i, (s, a, n) in sorted(best.items())]


LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
LEAK_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64())]))


class Search:
    """One block's index with the tables that find its shingles in texts."""

    def __init__(self, index: Index) -> None:
        self.index, self.known = index, index.by_length()
        self.tables = {k: np.zeros(1 << 20, bool) for k in self.known}
        for k, (s, _, _) in self.known.items():
            self.tables[k][(s & U(0xFFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray, first: np.ndarray, least: float) -> dict[int, list[dict]]:
        """The leaks of each text that has any; h holds the texts' word hashes, first where each begins and where the last ends."""
        hits, docs = {}, np.zeros(0, np.int64)
        for k, (s, _, _) in self.known.items():
            g = N.mix(N.gram_hashes(h, k) + U(k))
            maybe = np.flatnonzero(self.tables[k][(g & U(0xFFFFF)).astype(np.int64)])
            at = np.searchsorted(s, g[maybe]).clip(0, len(s) - 1)
            true = s[at] == g[maybe]
            hits[k] = (maybe[true], at[true])
            docs = np.append(docs, np.searchsorted(first, hits[k][0], "right") - 1)
        out = {}
        for d in np.unique(docs).tolist():
            a, b = int(first[d]), int(first[d + 1])
            mine = {}
            for k, (place, which) in hits.items():
                x, y = np.searchsorted(place, [a, max(a, b - k + 1)])
                if y > x:
                    mine[k] = (place[x:y] - a, which[x:y])
            if found := self.index.leaks(h[a:b], mine, self.known, least):
                out[d] = found
        return out


def benchmark_blocks(benchmark: DataFrame, k: int) -> Iterator[Index]:
    """The benchmark's items, dealt by id and text to as many blocks as their counted number and words ask for."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text is not null")
    n, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.regexp_count("text", F.lit(C.WORD))), F.lit(0))).collect()[0]
    blocks = max(1, -(-n * 5 // (BLOCK_ITEMS * 4)), -(-words * 5 // (BLOCK_WORDS * 4)))
    for b in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        yield Index.of(got.column("item_id").to_pylist(), got.column("text").to_pylist(), k)


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of docs (or those in carry) with leaks: for each benchmark item (item_id, text) found, its best window (word it starts at, words, similarity).

    A column named leaks is replaced. Letters A-Z are read as small, words end at white space. A document shorter
    than an item is one window. Items of fewer than k words are one shingle; null and empty items are found nowhere, null and empty
    documents hold nothing; an empty benchmark finds nothing. Items with the same id, or none, are searched each for itself.
    """
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(pickle.dumps(i)) for i in benchmark_blocks(benchmark, k) if i.ids]
    held, where = C.hold_text(docs, carry, text_col)
    if not blocks:
        return C.unhold(held, ("leaks",), F.array().cast(LEAK).alias("leaks"))
    schema = C.nullable(held.select("__row").schema).add("__leaks", LEAK)
    return C.unhold(held.mapInArrow(_pass(blocks, least, where), schema), ("leaks",), F.col("__leaks").alias("leaks"))


def _pass(blocks: list, least: float, where: str | tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [Search(pickle.loads(blocks[0].value))] if len(blocks) == 1 else None

        def through(part: list) -> Iterator[pa.RecordBatch]:
            found: list[dict[int, list[dict]]] = [{} for _ in part]
            for search in opened or (Search(pickle.loads(b.value)) for b in blocks):
                for mine, (_, h, first) in zip(found, part, strict=True):
                    for d, leaks in search.find(h, first, least).items():
                        mine.setdefault(d, []).extend(leaks)
            for mine, (rows, _, first) in zip(found, part, strict=True):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([mine.get(d, []) for d in range(len(first) - 1)], LEAK_ARROW)], ["__row", "__leaks"])

        part, size = [], 0
        for rows, data, off in N.slices(batches, where):
            w = N.words(N.LOWER[data], off)
            part, size = [*part, (rows, w.hash, w.first)], size + len(data)
            if opened or size >= CHUNK:
                yield from through(part)
                part, size = [], 0
        yield from through(part)

    return run


def op9_simhash_decontamination(spark, sf_dir: str) -> DataFrame:
    """The leaks found: a row for each document and benchmark item."""
    docs, items = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")
    found = find_leaks(docs.select("doc_id", "text"), items, carry=("doc_id",)).filter(F.size("leaks") > 0)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.start", "x.n_words", "x.similarity")
