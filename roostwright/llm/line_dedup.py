"""Line dedup (op 3): content-defined chunks of lines; repeated multi-line chunks go, after a comparison of their bytes.

A line's hash is read from its md5. A rolling sum of the hashes of the last lines ends a chunk wherever it is 0 modulo a
divisor, so an inserted or lost line moves only the boundaries near it. Where the last lines are all alike the sum
says nothing; there every RUN-th line of the text ends a chunk, so a long run of one line falls into equal chunks. Of the multi-line chunks
with equal text the first (least document, then place) stays and the others go. Columns and SQL functions only.

Only digests are shuffled to find repeats, pre-aggregated, so a chunk in a third of all documents is one row. Texts
are compared by grouping the repeated chunks by digest and text, pre-aggregated too; what is marked then are slim rows, and the
rows of very frequent digests are joined by broadcast, so they never meet in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed values of the rolling hash: weights of the last lines, the modulus of sums; a boundary about every DIVISOR lines.
WEIGHTS, MODULUS, DIVISOR = (1, 31, 961), 1_000_003, 4
#: Lines in a chunk within a run of one line.
RUN = 2


def line_hash(line: Column) -> Column:
    """A number of seven hex digits of the line's md5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def cut_lines(text: Column, divisor: int) -> Column:
    """The chunks of a text: an array of arrays of lines."""

    def ends(h: Column, i: Column) -> Column:
        total = sum((F.coalesce(F.get(h, i - j), F.lit(0)) * w for j, w in enumerate(WEIGHTS)), F.lit(0))
        alike = reduce(and_, [F.get(h, i - j) == F.get(h, i) for j in range(1, len(WEIGHTS))])
        return F.when(alike, i % RUN == RUN - 1).otherwise((total % MODULUS) % divisor == 0) | (i == F.size(h) - 1)

    def cuts(lines: Column) -> Column:
        return C.let(F.transform(lines, line_hash), lambda h: F.filter(F.transform(h, lambda _, i: F.when(ends(h, i), i + 1)), lambda x: x.isNotNull()))

    def chunks(lines: Column, c: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(c, k - 1)).otherwise(0)
        return F.transform(c, lambda e, k: F.slice(lines, before(k) + 1, e - before(k)))

    return C.let(F.split(text, "\n", -1), lambda lines: C.let(cuts(lines), lambda c: chunks(lines, c)))


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, n_chunks, kept_text of each document; one row per row of docs.

    Lines end at newlines and keep all else. Null and empty texts are one empty line; texts of any length are cut whole. Chunks of one
    line always stay. Ids should be unique longs; rows alike in id and text are one document twice and lose the same chunks; null ids
    come first. Should two different chunks ever share a digest, neither goes. An empty table stays empty. Other columns are left to the caller to join.
    """
    text = C.text_or_empty(text_col)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    cut = slim.select("id", "th", cut_lines(F.col("text"), divisor).alias("chunks"))
    multi = cut.select("id", "th", F.posexplode("chunks").alias("nth", "lines")).filter(F.size("lines") > 1)
    multi = multi.select("id", "th", "nth", F.array_join("lines", "\n").alias("chunk")).withColumn("digest", F.unhex(F.sha2("chunk", 256)))
    marks, n_marks = C.counted(multi.select("id", "th", "nth", "digest"), "lines-chunks")
    at = F.struct("id", "th", "nth")
    often, n_often = C.counted(marks.groupBy("digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "lines-repeated")
    texts = C.join_hot(multi.select("digest", "chunk"), often.select("digest", "n"), "digest", n_often, n_marks, "left_semi").groupBy("digest", "chunk").agg(F.lit(1).alias("one"))
    unlike, n_unlike = C.counted(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "lines-unlike")
    sure = often.join(unlike, "digest", "left_anti") if n_unlike else often
    gone = C.join_hot(marks, sure, "digest", n_often, n_marks).filter(~at.eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("nth").alias("gone"))
    rows = cut.join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    rows = rows.withColumn("left", F.transform(stay, lambda i: F.get("chunks", i)))
    count = lambda chunks: F.aggregate(chunks, F.lit(0).cast("long"), lambda s, x: s + F.size(x))
    return rows.select(
        F.col("id").alias(id_col), count(F.col("chunks")).alias("n_lines"), (count(F.col("chunks")) - count(F.col("left"))).alias("n_removed"),
        F.size("chunks").cast("long").alias("n_chunks"), F.array_join(F.flatten("left"), "\n").alias("kept_text"),
    )


def op3_chunked_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2("kept_text", 256).alias("kept_sha256"))
