"""Toxicity (op 10): a linear classifier learnt from confirmed toxic texts and unlabelled ones.

Features are runs of five and of seven bytes of the lower-cased text, punctuation and digits read as spaces. Runs that stand out in the positives are
kept, and weights are learnt by non-negative positive-unlabelled learning: the risk of calling unlabelled text toxic is
corrected by the class prior, and once the corrected part falls below zero its gradient is turned round.
Training sees a bounded sample on the driver; scoring is one pass over the corpus without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textnum as N

RUNS = (5, 7)
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTERS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTERS[0x80:] = np.arange(0x80, 0x100)


def runs(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(`size` bytes as one number, text) for each place; each text is read as if spaces stood around it. Numbers of different sizes differ."""
    n = len(off) - 1
    length = np.diff(off)
    at = off[:-1] + 2 * np.arange(n) + 1  # where each text starts between its two spaces
    wide = np.full(len(data) + 2 * n, 0x20, np.uint8)
    wide[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, length)] = LETTERS[data]
    text = np.repeat(np.arange(n), length + 2)
    m = len(wide) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = np.ones(m, np.int64) if size > RUNS[0] else np.zeros(m, np.int64)
    for j in range(size):
        v = (v << 8) | wide[j : j + m]
    ok = text[:m] == text[size - 1 :]
    return v[ok], text[:m][ok]


@dataclass
class Model:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """Which of 2^20 buckets hold a feature: most places need no search."""
        t = np.zeros(1 << 20, bool)
        t[self.bucket(self.features)] = True
        return t

    @staticmethod
    def bucket(v: np.ndarray) -> np.ndarray:
        return (v ^ (v >> 17) ^ (v >> 29)) & ((1 << 20) - 1)

    def counts(self, data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, times) of the features found."""
        found = []
        for size in RUNS:
            v, text = runs(data, off, size)
            near = table[self.bucket(v)]
            found.append((v[near], text[near]))
        v, text = (np.concatenate(x) for x in zip(*found, strict=True))
        f = np.searchsorted(self.features, v).clip(0, max(0, len(self.features) - 1))
        hit = self.features[f] == v if len(self.features) else np.zeros(len(v), bool)
        pair, times = np.unique(text[hit] * max(1, len(self.features)) + f[hit], return_counts=True)
        return pair // max(1, len(self.features)), pair % max(1, len(self.features)), times

    def score(self, data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
        text, f, times = self.counts(data, off, table)
        z = np.bincount(text, self.weights[f] * np.log1p(times), minlength=len(off) - 1) + self.bias
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


class Sparse:
    """A matrix of few entries, rows x features, for `@` from either side."""

    __array_ufunc__ = None

    def __init__(self, size: np.ndarray, feature: np.ndarray, value: np.ndarray, n_features: int) -> None:
        self.shape, self.feature, self.value = (len(size), n_features), feature, value
        self.row = np.repeat(np.arange(len(size)), size)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.feature], self.shape[0])

    def __rmatmul__(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature, self.value * g[self.row], self.shape[1])


def nn_pu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the non-negative PU risk with the logistic loss; returns weights and bias."""
    sig = lambda z: 1 / (1 + np.exp(-z.clip(-30, 30)))
    w, b = np.zeros(xp.shape[1], np.float32), np.float32(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        sp, su = sig(zp), sig(zu)
        negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        gp, gu = -prior * (1 - sp) / len(zp), np.zeros(len(zu))  # positives called clean
        np_, nu = -prior * sp / len(zp), su / len(zu)  # unlabelled called toxic, less the positives' share
        if negative >= 0:
            gp, gu = gp + np_, gu + nu
        else:
            gp, gu = -np_, -nu
        gp, gu = gp.astype(np.float32), gu.astype(np.float32)
        g = np.append(gp @ xp + gu @ xu + l2 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), np.float32(b - step[-1])
    return w.astype(float), float(b)


def sampled_runs(docs: DataFrame, labels: DataFrame, most_positive: int, most_unlabelled: int, id_col: str, text_col: str) -> DataFrame:
    """toxic, runs, times: the runs of each distinct text of the sample, written once. Only the drawn ids' texts leave the scan."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    ids = docs.select(id_.alias("id")).filter("id is not null").distinct()
    toxic = labels.filter("toxic = 1").select(F.col(id_col).alias("id")).distinct()
    draw = lambda of, most: of.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(most)
    drawn = draw(ids.join(toxic, "id", "left_semi"), most_positive).withColumn("toxic", F.lit(True)).unionByName(draw(ids, most_unlabelled).withColumn("toxic", F.lit(False)))
    rows = docs.select(id_.alias("id"), C.text_or_empty(text).alias("text"))
    rows = rows.join(F.broadcast(drawn), "id").select("toxic", "text").distinct()  # most_positive + most_unlabelled ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in N.slices(batches, most=1 << 18):  # a text has about two runs a byte, of 16 bytes with their times
            found = [runs(data, off, size) for size in RUNS]
            cuts = [np.searchsorted(text, np.arange(len(off))) for _, text in found]
            each = [np.unique(np.concatenate([v[c[i] : c[i + 1]] for (v, _), c in zip(found, cuts, strict=True)]), return_counts=True) for i in range(len(off) - 1)]
            size = np.array([len(x) for x, _ in each])
            lists = [N.list_array(np.concatenate(x).astype(kind), size) for x, kind in zip(zip(*each, strict=True), (np.int64, np.int32), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["toxic", "runs", "times"])

    return C.durable(rows.mapInArrow(count, "toxic boolean, runs array<long>, times array<int>"), "toxicity-sample")


def pick_features(sample: DataFrame, n_pos: int, n_unl: int, prior: float, most: int = 3000) -> np.ndarray:
    """Runs far more frequent, by texts, in the positives than in the unlabelled texts: at most `most`, those that stand out most.

    What stands out is told by the likelihood ratio of the positives that hold a run to those expected, which has to exceed what the best of so
    many runs would reach by chance, and by its share of clean texts (the unlabelled ones less their toxic part, by the prior), which is a fifth
    of its share of the positives at most. A normal approximation would let in rare runs that a few long positives share.
    """
    n = sample.select("toxic", F.explode("runs").alias("run")).groupBy("run").agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("u")).filter("p >= 3")
    n, tried = C.counted(n, "toxicity-runs")
    base = (F.col("u") + 0.5) / n_unl
    expected = base * n_pos
    ratio = 2 * (F.col("p") * F.log(F.col("p") / expected) - (F.col("p") - expected))
    share = F.col("p") / n_pos
    clean = (base - prior * share) / (1 - prior)
    good = n.select("run", ratio.alias("ratio"), ((share > 2.5 * base) & (share > 5 * clean)).alias("apart")).filter((F.col("ratio") > 2 * np.log(max(tried, 20))) & F.col("apart"))
    picked = np.sort(good.orderBy(F.desc("ratio"), "run").limit(most).select("run").toPandas()["run"].to_numpy(np.int64))
    C.delete(n)
    return picked


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, most_positive: int = 2000, most_unlabelled: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most most_positive and most_unlabelled distinct texts of docs, those with the least id hashes.

    Texts whose id has toxic = 1 in labels are the positives, all texts of docs are the unlabelled ones, and the share of ones in
    labels is the class prior unless one is given. Without positives or unlabelled text the model gives every text its
    prior. Features are counted by Spark; the driver gets the sample as a sparse matrix only, however long its texts are.
    """
    n, ones = labels.agg(F.count("toxic"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).collect()[0]
    prior = min(0.9, max(0.001, prior if prior is not None else (ones / n if n else 0.001)))
    none = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    sample = sampled_runs(docs, labels, most_positive, most_unlabelled, id_col, text_col)
    n_pos, n_unl = sample.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).collect()[0]
    features = pick_features(sample, n_pos, n_unl, prior) if n_pos and n_unl else none.features
    if not len(features):
        C.delete(sample)
        return none

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.asarray(b.column(1).offsets)
            v, times = (b.column(c).flatten().to_numpy() for c in (1, 2))
            f = np.searchsorted(features, v).clip(0, len(features) - 1)
            hit = features[f] == v
            size = np.diff(np.concatenate([[0], np.cumsum(hit)])[at - at[0]])
            yield pa.RecordBatch.from_arrays([b.column(0), N.list_array(f[hit].astype(np.int16), size), N.list_array(np.log1p(times[hit]).astype(np.float32), size)], ["toxic", "feature", "value"])

    sparse = sample.mapInArrow(entries, "toxic boolean, feature array<short>, value array<float>").toArrow().combine_chunks()
    C.delete(sample)

    def matrix(toxic: bool) -> Sparse:
        rows = sparse.filter(pc.equal(sparse["toxic"], toxic))
        size = pc.list_value_length(rows["feature"]).to_numpy()
        return Sparse(size, *(pc.list_flatten(rows[c]).to_numpy() for c in ("feature", "value")), len(features))

    w, b = nn_pu(matrix(True), matrix(False), prior)
    return Model(features, w, b)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of docs (or those in carry) with `out`: 0 to 1, higher where toxicity is likelier; a column of that name is replaced.

    Whole texts are read; a null one counts as empty, and empty texts get the score of a text without any feature.
    """
    held, where = C.hold_text(docs, carry, text_col)
    schema = C.nullable(held.select("__row").schema).add("__score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for rows, data, off in N.slices(batches, where):
            s = pa.array(model.score(data, off, table))
            yield pa.RecordBatch.from_arrays([rows.column(0), s], ["__row", "__score"])

    return C.unhold(held.mapInArrow(run, schema), (out,), F.col("__score").alias(out))


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def fitted(spark, docs: DataFrame, labels: DataFrame) -> Model:
    """From rows whose crc32(doc_id) mod 3 is not 1, labels joined by doc_id."""
    return train(docs.filter(~held_out("doc_id", 3, 1)), labels.filter(~held_out("doc_id", 3, 1)).filter("toxic is not null"))


def op10_nnpu_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(spark, docs, C.table(spark, sf_dir, "labels"))
    scored = score(docs, model, carry=("doc_id",))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
