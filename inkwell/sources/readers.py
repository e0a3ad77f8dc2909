"""Where papers, vocabularies and texts come from."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.workers import ship

RAW_PAPER = "title string, abstract string, authors array<string>, year int, venue string, presentation_type string, pdf_url string, openreview_id string, s2_id string, arxiv_id string, doi string"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric column if its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


class PagedNotes(DataSource):
    """A paged JSON service as a batch source: one partition per page.

    Options: ``fetch`` names a function as "module:function", (offset, limit) -> list of
    dicts with the fields of RAW_PAPER; ``total`` and ``page`` set the offsets.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_notes"

    def schema(self) -> str:
        return RAW_PAPER

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options["fetch"], int(self.options["total"]), int(self.options.get("page", "1000")), [f.name for f in schema.fields])


class _Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: str, total: int, page: int, names: list[str]):
        self.fetch, self.total, self.page, self.names = fetch, total, page, names

    def partitions(self) -> list[_Page]:
        return [_Page(at) for at in range(0, self.total, self.page)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        module, _, name = self.fetch.partition(":")
        for row in getattr(importlib.import_module(module), name)(partition.offset, min(self.page, self.total - partition.offset)):
            yield tuple(row.get(n) for n in self.names)


def sample_notes(offset: int, limit: int) -> list[dict]:
    """A service that needs no network: its notes are their numbers."""
    return [{"title": f"Note {i}", "year": 2000 + i % 25, "venue": "oral" if i % 3 else "poster", "openreview_id": f"n{i}"} for i in range(offset, offset + limit)]


def notes(spark: SparkSession, landing: str) -> DataFrame:
    """Accepted papers of a landing zone of JSON notes, whose fields are {value: x} or x."""
    from ..operators.browse import accepted, presentation_type
    from ..operators.text import unwrap

    raw = spark.read.text(landing).select(F.col("value").alias("j"), F.get_json_object("value", "$.id").alias("openreview_id"))
    field = lambda n: unwrap(F.col("j"), f"content.{n}")
    rows = raw.select("openreview_id", field("title").alias("title"), field("abstract").alias("abstract"), field("venue").alias("venue"), field("pdf").alias("pdf_url"), F.from_json(field("authors"), "array<string>").alias("authors"))
    return rows.where(accepted(F.col("venue"))).withColumn("presentation_type", presentation_type(F.col("venue")))


def bulk_papers(papers: DataFrame) -> DataFrame:
    """A bulk service's nested papers as rows of papers."""
    return papers.select(
        F.col("paperId").alias("s2_id"), "title", "abstract", "year", "venue", F.col("externalIds.ArXiv").alias("arxiv_id"), F.col("externalIds.DOI").alias("doi"),
        F.coalesce("openAccessPdf.url", F.when(F.col("externalIds.ArXiv").isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), "externalIds.ArXiv"))).alias("pdf_url"),
        F.transform("authors", lambda a: a["name"]).alias("authors"), F.coalesce("citationCount", F.lit(0)).alias("citation_count"),
    )


def venue_catalogue(spark: SparkSession, venues: dict[str, list[int]]) -> DataFrame:
    """(conference, year) of a catalogue {short name: years}."""
    rows = spark.createDataFrame([(k, v) for k, v in venues.items()], "conference string, years array<int>")
    return rows.select("conference", F.explode("years").alias("year"))


def pdf_url(doi: Column, arxiv_id: Column, url: Column) -> tuple[Column, Column]:
    """(url, source): the anthology for its DOI prefix, else arXiv, else the given url."""
    prefix = "10.18653/v1/"
    acl = F.startswith(doi, F.lit(prefix))
    arxiv, other = F.nullif(arxiv_id, F.lit("")), F.nullif(url, F.lit(""))
    at = F.when(acl, F.concat(F.lit("https://aclanthology.org/"), F.substring(doi, F.lit(len(prefix) + 1), F.length(doi)), F.lit(".pdf"))).when(arxiv.isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv)).otherwise(other)
    return at, F.when(acl, "acl_anthology").when(arxiv.isNotNull(), "arxiv").when(other.isNotNull(), "pdf_url")


def pdf_files(spark: SparkSession, pattern: str, least: int = 10_000) -> DataFrame:
    """Downloaded files with whether they can be PDFs: the magic number and a least size."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.withColumn("valid", valid_pdf(F.col("content"), least))


def valid_pdf(content: Column, least: int = 10_000) -> Column:
    return (F.substring(content, 1, 4) == F.lit(b"%PDF")) & (F.octet_length(content) >= least)


def pdf_text(files: DataFrame, reader: Callable[[bytes], str]) -> DataFrame:
    """(path, text) by a reader that workers call."""
    ship(files.sparkSession)

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda b: reader(bytes(b)))

    return files.where("valid").select("path", run("content").alias("text"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(key, canonical) of a JSON object; keys that begin with === or _ and null values are comments."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return alias_map(spark, json.loads(text))


def alias_map(spark: SparkSession, spec: dict) -> DataFrame:
    return spark.createDataFrame([(k.lower(), v) for k, v in spec.items() if isinstance(v, str) and not k.startswith(("===", "_"))], "key string, canonical string")


def topic_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(slug, domain, keyword, weight) of {slug: {domain, primary, secondary}}."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return topics(spark, json.loads(text))


def topics(spark: SparkSession, spec: dict) -> DataFrame:
    rows = [(slug, t.get("domain"), k.lower(), w) for slug, t in spec.items() if not slug.startswith("_") for part, w in (("primary", 2), ("secondary", 1)) for k in t.get(part, [])]
    return spark.createDataFrame(rows, "slug string, domain string, keyword string, weight int")


def seed(table_: DataFrame, rows: list[tuple], keys: list[str]) -> DataFrame:
    """Inline rows put in where their key is not there yet."""
    from ..operators.upsert import get_or_create

    return get_or_create(table_, table_.sparkSession.createDataFrame(rows, table_.schema), keys)


def vector_index(spark: SparkSession, path: str, enabled: bool = True) -> DataFrame:
    """Chunk vectors, or an empty index if it is switched off or not there."""
    schema = "chunk_id long, paper_id long, embedding array<float>"
    if enabled:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def with_retries(call: Callable[[str], str], attempts: int = 3) -> Callable[[str], str]:
    """A service call that is tried again when it fails."""

    def run(x: str) -> str:
        for left in range(attempts - 1, -1, -1):
            try:
                return call(x)
            except Exception:  # noqa: BLE001  the last attempt's error is the caller's
                if not left:
                    raise
        raise AssertionError

    return run


def first_available(calls: list[Callable[[str], str]]) -> Callable[[str], str]:
    """The first of several models that answers."""

    def run(x: str) -> str:
        for k, call in enumerate(calls):
            try:
                return call(x)
            except Exception:  # noqa: BLE001
                if k + 1 == len(calls):
                    raise
        raise ValueError("no model is given")

    return run
