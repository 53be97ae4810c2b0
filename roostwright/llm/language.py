"""Language ID (op 5): a byte convolutional network over fixed-length windows of whole texts.

Bytes are embedded, convolved with filters of several widths, max-pooled over the window and fed to a softmax. A text's
windows lie end to end, and their log-probabilities are averaged by the bytes they hold. Training is plain numpy on
the driver with a bounded sample of windows; prediction is one pass over the corpus, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from . import textnum as N

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 12, (2, 3, 4)


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    kernels: list[np.ndarray]  # for each width: width * EMBED x FILTERS
    out: np.ndarray  # 1 + filters x langs; the first row is the bias

    def features(self, x: np.ndarray, keep: bool = False):
        """Max-pooled filters of windows x (n x WINDOW bytes); with keep, also what training needs."""
        e = self.embed[x]
        pooled, saved = [], []
        for w, k in zip(WIDTHS, self.kernels, strict=True):
            m = x.shape[1] - w + 1
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)  # n x m x EMBED x w
            cols = cols.transpose(0, 1, 3, 2).reshape(len(x) * m, w * EMBED)
            z = (cols @ k).reshape(len(x), m, FILTERS)
            pooled.append(np.maximum(z.max(axis=1), 0))
            if keep:
                saved.append((cols.reshape(len(x), m, w * EMBED), z.argmax(axis=1)))
        return np.concatenate(pooled, axis=1), saved

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """The convolutions as sums of look-ups: for each width, (offset, table over byte pairs) that cover it."""
        out = []
        for w, k in zip(WIDTHS, self.kernels, strict=True):
            one = [self.embed @ k[j * EMBED : (j + 1) * EMBED] for j in range(w)]
            out.append([(j, (one[j][:, None] + (one[j + 1][None] if j + 1 < w else 0)).reshape(-1, FILTERS) if j + 1 < w else np.repeat(one[j], 256, axis=0)) for j in range(0, w, 2)])
        return out

    def log_probs(self, x: np.ndarray, tables: list) -> np.ndarray:
        """Of windows x; the same numbers as features() gives, but for rounding."""
        xt = np.pad(x.T.astype(np.int32), ((0, 1), (0, 0)))
        pair = xt[:-1] * 256 + xt[1:]  # place x window
        pooled = []
        for w, parts in zip(WIDTHS, tables, strict=True):
            m = x.shape[1] - w + 1
            z = parts[0][1][pair[:m]]
            for j, t in parts[1:]:
                z += t[pair[j : j + m]]
            pooled.append(np.maximum(z.max(axis=0), 0))
        z = np.concatenate(pooled, axis=1) @ self.out[1:] + self.out[0]
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(data: np.ndarray, off: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes in each): each text cut end to end, the last window filled up with zeros."""
    length = np.diff(off)
    n = -(-length // size)
    text = np.repeat(np.arange(len(length)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    held = np.minimum(size, length[text] - nth * size)
    at = (off[:-1][text] + nth * size)[:, None] + np.arange(size)
    x = np.where(np.arange(size) < held[:, None], data[at.clip(max=max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8)
    return x, text, held


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.003, seed: int = 5) -> Net:
    """Softmax cross-entropy, classes weighted alike, by Adam."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Net(
        langs, rng.normal(0, 0.5, (256, EMBED)).astype(f32), [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(f32) for w in WIDTHS],
        rng.normal(0, 0.1, (1 + FILTERS * len(WIDTHS), len(langs))).astype(f32),
    )
    params = [net.embed, *net.kernels, net.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    counts = np.bincount(y, minlength=len(langs)).clip(1)
    weight = (len(y) / len(langs) / counts)[y].astype(f32)
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            b = order[i : i + batch]
            f, saved = net.features(x[b], keep=True)
            z = f @ net.out[1:] + net.out[0]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            d = (p * weight[b, None] / len(b)).astype(f32)
            grads = [np.zeros_like(net.embed), *[None] * len(WIDTHS), np.vstack([d.sum(axis=0), f.T @ d])]
            df = (d @ net.out[1:].T) * (f > 0)
            rows = np.arange(len(b))[:, None]
            for j, (w, (cols, top)) in enumerate(zip(WIDTHS, saved, strict=True)):
                g = df[:, j * FILTERS : (j + 1) * FILTERS]
                at = cols[rows, top]  # n x FILTERS x w*EMBED: the place each filter's maximum comes from
                grads[1 + j] = np.einsum("nfk,nf->kf", at, g)
                back = g[:, :, None] * net.kernels[j].T[None]
                bytes_ = x[b][rows[:, :, None], top[:, :, None] + np.arange(w)]
                np.add.at(grads[0], bytes_.reshape(-1), back.reshape(len(b) * FILTERS * w, EMBED))
            t += 1
            for p_, g_, m_, v_ in zip(params, grads, m, v, strict=True):
                m_ += 0.1 * (g_ - m_)
                v_ += 0.001 * (g_ * g_ - v_)
                p_ -= rate * (m_ / (1 - 0.9**t)) / (np.sqrt(v_ / (1 - 0.999**t)) + 1e-8)
    return net


def train(docs: DataFrame, per_lang: int = 500, per_text: int = 3, most_texts: int = 50_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net | None:
    """Learns every language that labels a text, from at most per_lang different (id, text) of each, by hash, per_text windows each,
    spread over the text; where that would be more than most_texts in all, the languages share these alike, and each keeps one at least. None if there is no labelled text.

    About 1.2 times as many, and 20 more, are drawn by a share of the hashes, from a count of the different ones; each language is then cut for
    itself, so none uses up the place of another, and repeated rows or a shared id leave none without examples.
    """
    id_, text, lang = (F.col(f"`{c}`") for c in (id_col, text_col, lang_col))
    known = docs.filter(lang.isNotNull() & (F.length(C.text_or_empty(text)) > 0)).select(lang.alias("lang"), text.alias("text"), F.xxhash64(id_.cast("string"), text).alias("h"))
    tally = C.durable(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "langs")
    langs = sorted(r[0] for r in tally.select("lang").collect())
    if not langs:
        return None
    per_lang = max(1, min(per_lang, most_texts // len(langs)))
    share = tally.select("lang", (F.lit(1.2e6 * per_lang + 2e7) / F.col("n") + 1).cast("long").alias("share"))
    picked = known.join(C.small(share, len(langs)), "lang").filter(F.pmod("h", F.lit(1_000_000)) < F.col("share"))
    picked = picked.groupBy("lang", "h").agg(F.first("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "h"))
    picked = picked.withColumn("nth", nth).filter(F.col("nth") <= per_lang).select("h", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in N.slices(batches):
            x, text, _ = windows(data, off)
            n = np.bincount(text, minlength=len(off) - 1)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
            keep = np.flatnonzero((nth * per_text) // n[text] != ((nth - 1) * per_text) // n[text])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(text[keep])), rows.column(1).take(pa.array(text[keep])), pa.array([w.tobytes() for w in x[keep]], pa.binary())], ["h", "lang", "w"])

    sample = picked.mapInArrow(cut, "h long, lang string, w binary").orderBy("lang", "h", "w").toArrow()
    x = np.frombuffer(b"".join(sample.column("w").to_pylist()), np.uint8).reshape(-1, WINDOW)
    at = {v: i for i, v in enumerate(langs)}
    y = np.array([at[v] for v in sample.column("lang").to_pylist()])
    return fit(x, y, langs)


def predict(docs: DataFrame, net: Net | None, text_col: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of docs (or those in carry) with lang_pred and score (0 to 1); columns of these names are replaced.

    Null texts and those without a letter are `und` with score 0, as is all if there is no network. Only the text is looked at.
    """
    text = F.col(f"`{text_col}`")
    new = ("lang_pred", "score")
    held, where = C.hold_text(docs, carry, text_col, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    if net is None:
        return C.unhold(held, new, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = C.nullable(held.select("__row").schema).add("__lang", "string").add("__score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for rows, data, off in N.slices(batches, where, 1 << 20, max(1, (1 << 21) // len(net.langs))):
            n = len(off) - 1
            x, text, held = windows(data, off)
            total = np.zeros((n, len(net.langs)))
            for i in range(0, len(x), 128):
                np.add.at(total, text[i : i + 128], net.log_probs(x[i : i + 128], tables) * held[i : i + 128, None])
            # the mean of the windows' log-probabilities, as if up to four windows were independent
            z = total / np.maximum(1, np.diff(off))[:, None] * np.clip(np.diff(off) / WINDOW, 1, 4)[:, None]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            flag = np.asarray(rows.column(rows.num_columns - 1).to_numpy(zero_copy_only=False), bool)
            lang = pa.array([net.langs[b] if f else "und" for b, f in zip(best, flag, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), lang, pa.array(np.where(flag, p[np.arange(n), best], 0.0))], ["__row", "__lang", "__score"])

    return C.unhold(held.mapInArrow(run, schema), new, F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op5_byte_cnn_language(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs.filter(~held))
    return predict(docs, net, carry=("doc_id",)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
