"""Artifacts: the JSON files that acquisition jobs leave, one envelope a file, read with a fixed schema, picked by file name, and written again."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .. import schema

# File-name patterns of the artifact groups, in order of precedence after the main file.
GROUPS = [
    ("suburb towns", r"^output-seloger-(?!arr-)(.+)-shard-(\d+){suffix}\.json$"),
    ("arrondissements", r"^output-seloger-arr-(\d+)-shard-(\d+){suffix}\.json$"),
    ("categories", r"^output-parisrental-({kinds})-.+\.json$"),
    ("DanielFeau", r"^output-danielfeau{suffix}\.json$"),
    ("Eiffel Housing", r"^output-eiffel-housing{suffix}\.json$"),
    ("Junot", r"^output-junot{suffix}\.json$"),
]
LABELS = {"suburb towns": ("SeLoger-Suburb-", "slug", ""), "arrondissements": ("SeLoger-Paris-", "arrondissement", "e"), "categories": ("ParisRental-", "category", "")}
OPTIONAL = ("DanielFeau", "Eiffel Housing", "Junot")
MISSING = "Isolated job artifact not found"

#: What a file is that can't be merged.
NO_TEXT, NO_JSON, NO_ENVELOPE, NO_LISTINGS, NO_STATUS = "artifact is empty", "artifact is not valid JSON, cut off maybe", "artifact is not a JSON object", "artifact has no list of listings", "artifact has no list of source status"


def search_type(value: str) -> str:
    if value not in ("rent", "sale"):
        raise ValueError(f"search type must be rent or sale, not {value!r}")
    return value


def pattern(template: str, kind: str) -> str:
    return template.format(suffix="-sale" if kind == "sale" else "", kinds="sale" if kind == "sale" else "furnished|unfurnished")


def main_name(kind: str) -> str:
    return f"output-main{'-sale' if search_type(kind) == 'sale' else ''}.json"


def envelopes(spark: SparkSession, files: str, ddl: str) -> DataFrame:
    """A row for each file of this name or glob, whatever is in it: artifact (its name), e (the envelope, null where broken), error, mistyped.

    error says how a file is broken, or what its envelope says. A value of another type than the schema's is null, and `mistyped` tells that
    there is one. A file fits a task, as any JSON document that spans lines has to.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(files)
    there = [(s.getPath().getName(), s.getLen()) for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or () if s.isFile()]
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    found = spark.createDataFrame([(n,) for n, size in there if not size], "artifact string").withColumn("content", F.lit(b""))  # Spark's readers pass over files without bytes
    if any(size for _, size in there):
        found = spark.read.format("binaryFile").load(files).select(name.alias("artifact"), "content").unionByName(found)
    parsed = F.from_json("text", f"{ddl}, `__corrupt` string", {"columnNameOfCorruptRecord": "__corrupt"})
    t = found.select("artifact", F.decode("content", "UTF-8").alias("text")).withColumn("e", parsed)
    one = F.json_array_length(F.concat(F.lit("["), F.col("text"), F.lit("]"))) == 1  # null for what isn't JSON
    broken = (
        F.when(F.col("text").rlike(r"^\s*$"), NO_TEXT).when(~F.coalesce(one, F.lit(False)), NO_JSON).when(~F.col("text").rlike(r"^\s*\{"), NO_ENVELOPE)
        .when((_said(F.col("e.error")).isNull() if "error string" in ddl else F.lit(True)) & F.col("e.listings").isNull(), NO_LISTINGS)
    )
    if "sourceStatus" in ddl:
        broken = F.coalesce(broken, F.when(F.col("e.sourceStatus").isNull(), NO_STATUS))
    t = t.withColumn("broken", broken)
    said = _said(F.col("e.error")) if "error string" in ddl else F.lit(None).cast("string")
    return t.select("artifact", F.when(F.col("broken").isNull(), F.col("e")).alias("e"), F.coalesce("broken", said).alias("error"), (F.col("broken").isNull() & F.col("e.__corrupt").isNotNull()).alias("mistyped"))


def _said(error: Column) -> Column:
    return F.when(error != "", error)


def read_main(spark: SparkSession, folder: str, kind: str = "rent") -> DataFrame:
    """The main artifact's listings with src_rank 0. A missing or broken file raises before anything is planned."""
    name = main_name(kind)
    df = envelopes(spark, f"{folder}/{name}", schema.MAIN_ARTIFACT)
    state = df.select("error").collect()  # one row, and a short one
    if not state or state[0].error:
        raise ValueError(f"{folder}/{name}: {state[0].error if state else 'main artifact not found'}")
    return df.select(F.lit(0).alias("src_rank"), "artifact", F.lit("main").alias("label"), "error", F.col("e.sourceStatus").alias("sourceStatus"), F.col("e.listings").alias("listings"))


def read_parts(spark: SparkSession, folder: str, kind: str = "rent") -> DataFrame:
    """All other artifacts of this search type: src_rank, artifact (file name), label, error, listings.

    Every file whose name fits has its row: a broken one with its error and no listings, labelled by its name where its text can't tell. Files of other names are not opened for rows.
    """
    search_type(kind)
    df = envelopes(spark, f"{folder}/output-*.json", schema.PART_ARTIFACT)
    rank, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (name, template) in reversed(list(enumerate(GROUPS, 1))):
        form = pattern(template, kind)
        hit = F.col("artifact").rlike(form)
        rank = F.when(hit, F.lit(i)).otherwise(rank)
        if name in OPTIONAL:
            shown = F.lit(name)
        else:
            before, key, after = LABELS[name]
            shown = F.concat(F.lit(before), F.coalesce(F.col(f"e.{key}").cast("string"), F.regexp_extract("artifact", form, 1)), F.lit(after))
        label = F.when(hit, shown).otherwise(label)
    return df.select(rank.alias("src_rank"), "artifact", label.alias("label"), "error", F.col("e.listings").alias("listings")).filter("src_rank is not null")


def rows_of(artifacts: DataFrame) -> DataFrame:
    """A row for each listing of artifacts without an error, with its ordinals: src_rank, artifact, pos."""
    good = artifacts.filter(F.coalesce("error", F.lit("")) == "")
    return good.select("src_rank", "artifact", F.posexplode("listings").alias("pos", "l")).select("src_rank", "artifact", "pos", "l.*")


def artifact_name(group: Column, kind: str, slug: Column, arrondissement: Column, category: Column, page: Column, shard: Column) -> Column:
    """The file name of a job's artifact by its group: main, or a name of GROUPS. A group that isn't one fails the query."""
    s, suffix = lambda c: c.cast("string"), "-sale" if search_type(kind) == "sale" else ""
    end = F.lit(f"{suffix}.json")
    return (
        F.when(group == "main", F.lit(main_name(kind)))
        .when(group == "suburb towns", F.concat(F.lit("output-seloger-"), slug, F.lit("-shard-"), s(shard), end))
        .when(group == "arrondissements", F.concat(F.lit("output-seloger-arr-"), s(arrondissement), F.lit("-shard-"), s(shard), end))
        .when(group == "categories", F.concat(F.lit("output-parisrental-"), F.lit("sale") if suffix else category, F.lit("-"), s(page), F.lit(".json")))
        .when(group.isin(*OPTIONAL), F.concat(F.lit("output-"), F.replace(F.lower(group), F.lit(" "), F.lit("-")), end))
        .otherwise(F.raise_error(F.concat(F.lit("no artifact group "), F.coalesce(group, F.lit("null")))).cast("string"))
    )


def envelope_files(rows: DataFrame, jobs: DataFrame, kind: str, key: str = "job", pos: str = "pos") -> DataFrame:
    """name, body: the file of each of jobs (key, group, slug, arrondissement, category, page, shard, error, with diagnostics or sourceStatus maybe), with its listings in order.

    rows are listings (the listing schema's columns, those there are) with `key` and `pos`. A job without rows gets an empty list. One job's listings become one row, as they do one file.
    """
    fields = [f for f in (c.split(" ")[0] for c in schema.LISTING.split(", ")) if f in rows.columns]
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, F.struct(*fields).alias("l")))).alias("ls"))
    j = jobs.join(lists, key, "left")
    listings = F.coalesce(F.transform("ls", lambda x: x["l"]), F.array().cast(j.selectExpr("transform(ls, x -> x.l) as l").schema["l"].dataType))
    name = artifact_name(F.col("group"), kind, *(F.col(c) for c in ("slug", "arrondissement", "category", "page", "shard")))
    parts = {
        "main": [F.lit(kind).alias("searchType"), F.lit(False).alias("fetchDetails"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generatedAt"), F.size(listings).alias("totalListings"), *([F.col("sourceStatus")] if "sourceStatus" in jobs.columns else []), listings.alias("listings")],
        "suburb towns": [F.col("slug"), listings.alias("listings"), F.col("error")],
        "arrondissements": [F.col("arrondissement"), listings.alias("listings"), F.col("error")],
        "categories": [F.col("category"), F.col("page"), listings.alias("listings"), F.col("error")],
    }
    agency = [F.col("group").alias("source"), F.lit(kind).alias("searchType"), listings.alias("listings"), F.col("error"), *([F.col("diagnostics")] if "diagnostics" in jobs.columns else [])]
    as_json = lambda cols: F.to_json(F.struct(*cols), {"pretty": "true", "ignoreNullFields": "false"})
    body = as_json(agency)
    for group, cols in parts.items():
        body = F.when(F.col("group") == group, as_json(cols)).otherwise(body)
    return j.select(name.alias("name"), body.alias("body"))


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _EnvelopeWriter(DataSourceWriter):
    """Tasks write into a hidden folder of this job's own; when all are done, the files take their names one by one. A failed job leaves that folder at most."""

    def __init__(self, path: str) -> None:
        self.path, self.pending = path.rstrip("/"), f"{path.rstrip('/')}/.pending-{uuid.uuid4().hex}"

    @staticmethod
    def _open(uri: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)

    def write(self, iterator: Iterator) -> _Written:
        store, at = self._open(self.pending)
        names = []
        for row in iterator:
            if not row["name"] or posixpath.basename(row["name"]) != row["name"]:
                raise ValueError(f"not a file name: {row['name']!r}")
            own = f"{row['name']}.{uuid.uuid4().hex}"  # a second attempt at this task doesn't meet the first one's file
            store.create_dir(at)
            with store.open_output_stream(f"{at}/{own}") as out:
                out.write((row["body"] or "").encode())
            names.append(own)
        return _Written(names)

    def commit(self, messages: list) -> None:
        store, at = self._open(self.pending)
        names = [n for m in messages if m is not None for n in m.names]
        final = [n.rpartition(".")[0] for n in names]
        if len(set(final)) < len(final):
            self.abort(messages)
            raise ValueError("two jobs have one artifact name")
        for own, name in zip(names, final, strict=True):
            store.move(f"{at}/{own}", f"{posixpath.dirname(at)}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, at = self._open(self.pending)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class EnvelopeSink(DataSource):
    """spark.dataSource.register(EnvelopeSink); df.write.format("envelopes").mode("append").save(folder): a file for each row of (name, body)."""

    @classmethod
    def name(cls) -> str:
        return "envelopes"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _EnvelopeWriter(self.options["path"])


def write_artifacts(rows: DataFrame, jobs: DataFrame, folder: str, kind: str = "rent", key: str = "job", pos: str = "pos") -> None:
    """A JSON file for each job, named so that read_main and read_parts know it; a file of that name is replaced. All appear only once all could be written."""
    rows.sparkSession.dataSource.register(EnvelopeSink)
    envelope_files(rows, jobs, kind, key, pos).write.format("envelopes").mode("append").save(folder)
