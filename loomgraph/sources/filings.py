"""Filings in <root>/<company>/<year>/<name>.pdf, with ids and output paths from their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slugify, strip

COLUMNS = ("path", "company_name", "year", "file_name")


def from_paths(paths: DataFrame, company: str | None = None) -> DataFrame:
    """(path, company_name, year, file_name) of paths(path) that end in company/yyyy/name.pdf.

    The year is four digits once white space is stripped, the suffix is read in either case. `company` keeps that
    one, whatever its case and the white space around it.
    """
    part = lambda n: F.element_at(F.split("path", "/"), -n)
    cut = paths.filter(F.size(F.split("path", "/")) >= 3).select("path", part(3).alias("company_name"), strip(part(2)).alias("year"), part(1).alias("file_name"))
    found = cut.filter(F.col("year").rlike("^[0-9]{4}$") & F.lower("file_name").endswith(".pdf"))
    return found if company is None else found.filter(F.lower(strip(F.col("company_name"))) == company.strip().lower())


def identified(filings: DataFrame, with_year: bool = False) -> DataFrame:
    """Adds filing_ord, document_id, document_name and the names of the outputs.

    The order is that of the names of company, year and file. Without the year in it, the id of one file name in two
    years is the same; `with_year` keeps them apart.
    """
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    slug = F.concat_ws("_", slugify(F.col("company_name")), *([F.col("year")] if with_year else []), slugify(stem))
    by_company = Window.partitionBy("company_name").orderBy("year", "file_name")
    # Names sort as company first, so positions within a company and the companies' sizes give the order without one task for all.
    sizes = filings.groupBy("company_name").count()
    before = sizes.select("company_name", (F.sum("count").over(Window.orderBy("company_name")) - F.col("count")).alias("before"))
    placed = filings.withColumn("own", F.row_number().over(by_company)).join(before, "company_name")
    return placed.withColumns(
        {
            "filing_ord": (F.col("before") + F.col("own")).cast("long"),
            "document_id": slug,
            "document_name": stem,
            "parsed_json": F.concat(F.lit("parsed_"), slug, F.lit(".json")),
            "extracted_json": F.concat(F.lit("extracted_"), slug, F.lit(".json")),
        }
    ).drop("own", "before")


def discover(spark: SparkSession, root: str, company: str | None = None) -> DataFrame:
    """Filings under a folder of any file system, from the listing alone: no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root).select("path")
    depth = len(root.rstrip("/").split("://")[-1].split(":")[-1].strip("/").split("/"))
    inside = F.size(F.split(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), "/"))
    return identified(from_paths(listed.filter(inside == depth + 3), company))


def pending(filings: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Filings without an output in done(document_id); all of them with `force`."""
    return filings if force else filings.join(done.select("document_id").distinct(), "document_id", "left_anti")


def missing(filings: DataFrame, parsed: DataFrame) -> DataFrame:
    """An error row for each filing without its parsed document."""
    gone = filings.join(parsed.select("document_id").distinct(), "document_id", "left_anti")
    return gone.select("document_id", F.lit(None).cast("string").alias("pages"), F.concat(F.lit("no parsed document: "), "parsed_json").alias("message"))


def file_stem(path: Column) -> Column:
    """File name without folder and suffix, and without the prefix of parsed files."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", ""), "^parsed_", "")
