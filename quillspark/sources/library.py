"""Readers of a library folder: landed result pages, cards, originals, chunk files and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillspark import fixed_values as fixed

MANIFEST = T.StructType([
    T.StructField("arxiv_id", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("fetched_at", T.StringType()),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("source_sha256", T.StringType()),
    T.StructField("chunks", T.ArrayType(T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("sections", T.ArrayType(T.StringType())),
        T.StructField("chars", T.IntegerType()),
        T.StructField("sha256", T.StringType()),
    ]))),
])


def _whole_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, value) of every file that matches; no rows when none does."""
    try:
        files = spark.read.text(pattern, wholetext=True)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "value string").withColumn("_f", F.lit(""))
        return files.select(F.col("_f").alias("file"), "value")
    return files.select(_file_path().alias("file"), "value")


def _file_path() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def raw_pages(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(offset, raw) of the result pages landed by one scan."""
    pages = _whole_files(spark, f"{folder}/*.xml").select(
        F.regexp_extract("file", r"(\d+)\.xml\z", 1).cast("int").alias("offset"),
        F.col("value").alias("raw"))
    return pages if before is None else pages.where(F.col("offset") < before)


def raw_page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same pages as a stream: each landed file is delivered once."""
    files = spark.readStream.text(folder, wholetext=True, pathGlobFilter="*.xml")
    return files.select(
        F.regexp_extract(_file_path(), r"(\d+)\.xml\z", 1).cast("int").alias("offset"),
        F.col("value").alias("raw"))


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """Cards back to columns. The card layout keeps every field on its own labelled line."""
    label = fixed.CARD_LABELS
    text = F.col("value")

    def line(name: str, pattern: str = r"([^\n]*)") -> Column:
        return F.regexp_extract(text, rf"(?m)^- {name}: {pattern}$", 1)

    body = rf"(?s)\n## {label['abstract']}\n\n(.*)\n\n## {label['read_on']}\n\n"
    shown_doi = line("DOI")
    return _whole_files(spark, f"{folder}/*.md").select(
        line("arXiv", r"\[([^\n]*?)v\d+\][^\n]*").alias("id"),
        line("arXiv", r"\[[^\n]*?v(\d+)\][^\n]*").try_cast("int").alias("version"),
        _unescape(F.regexp_extract(text, r"\A# ([^\n]*)\n", 1)).alias("title"),
        F.regexp_extract(text, body, 1).alias("abstract"),
        line(label["first"], rf"[^\n]*?；{label['submitted']}: ([^\n]*)").alias("published"),
        line(label["revised"]).alias("updated"),
        F.split(_unescape(line(label["authors"])), "; ").alias("authors"),
        F.split(line(label["categories"]), ", ").alias("categories"),
        F.when(shown_doi == label["no_doi"], "").otherwise(_unescape(shown_doi)).alias("doi"),
        line("arXiv", r"\[[^\n]*\]\(([^\n]*)\)").alias("abs_url"),
        line("PDF").alias("pdf_url"),
        line(label["first"], r"(\d{4}-\d\d)[^\n]*").alias("year_month"),
        (line(label["current"]) == "True").alias("in_latest_search"),
        F.split(line(label["topics"].replace("（", r"\（")), ", ").alias("topics"))


def _unescape(text: Column) -> Column:
    # The card escapes, undone in the opposite order.
    for new, old in (("]", "&#93;"), ("[", "&#91;"), ("|", "&#124;"), (">", "&gt;"), ("<", "&lt;"),
                     ("&", "&amp;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _owner(file: str) -> list[Column]:
    """id (file form), version and path inside the paper folder, from a file's address."""
    inside = r"/papers/[^/]+/(.+)v(\d+)/((?:chunks/)?[^/]+)\z"
    return [F.regexp_extract(file, inside, 1).alias("key"),
            F.regexp_extract(file, inside, 2).try_cast("int").alias("version"),
            F.regexp_extract(file, inside, 3).alias("path")]


def _paper_folders(root: str, keys: list[str] | None) -> str:
    """Glob of the folders of these papers (ids in file form), or of all papers."""
    return f"{root}/papers/{'*' if keys is None else '{' + ','.join(keys) + '}'}/*"


def cached_versions(spark: SparkSession, root: str) -> DataFrame:
    """(id, version) of every manifest, from the file names alone."""
    named = _whole_files(spark, f"{_paper_folders(root, None)}/manifest.json").select(*_owner("file")[:2])
    # In file form only the slash before an old identifier's seven digits became an underscore.
    return named.select(F.regexp_replace("key", r"_(\d{7})\z", "/$1").alias("id"), "version")


def manifests(spark: SparkSession, root: str, keys: list[str] | None = None) -> DataFrame:
    """(id, version, contents, manifest) of the cached full texts of some or all papers."""
    folders = _paper_folders(root, keys)
    stored = _whole_files(spark, f"{folders}/manifest.json").select(
        *_owner("file")[:2], F.from_json("value", MANIFEST).alias("manifest"))
    contents = _whole_files(spark, f"{folders}/CONTENTS.md").select(
        *_owner("file")[:2], F.col("value").alias("contents"))
    return stored.join(contents, ["key", "version"], "left").where("manifest IS NOT NULL").select(
        F.col("manifest.arxiv_id").alias("id"), F.col("manifest.version").alias("version"),
        "contents", "manifest")


def chunk_files(spark: SparkSession, root: str, keys: list[str] | None = None) -> DataFrame:
    """(key, version, path, body) of the chunk files of some or all papers; ``key`` is the file form."""
    return _whole_files(spark, f"{_paper_folders(root, keys)}/chunks/*.md").select(
        *_owner("file"), F.col("value").alias("body"))


def stored_files(spark: SparkSession, root: str, manifest_rows: DataFrame,
                 keys: list[str] | None = None) -> DataFrame:
    """(id, version, path, body) of the chunk files of known manifests."""
    owners = manifest_rows.select(
        "id", "version", F.replace("id", F.lit("/"), F.lit("_")).alias("key"))
    return chunk_files(spark, root, keys).join(owners, ["key", "version"]).select("id", "version", "path", "body")


def originals(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Add ``raw`` (binary) to rows that name a landed file of the shared folder in ``landed``.

    Each task reads the files of its own rows; the bytes never pass through the driver.
    """
    schema = T.StructType(paths.schema.fields + [T.StructField("raw", T.BinaryType())])

    def read(batches):
        for batch in batches:
            bodies = []
            for name in batch["landed"]:
                with open(name, "rb") as stream:
                    bodies.append(stream.read())
            yield batch.assign(raw=bodies)
    return paths.mapInPandas(read, schema)
