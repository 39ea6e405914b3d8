"""Filing metadata and manifests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import slug, zero_padded
from siltstone.operators.html import document_text

#: Companies with the numbers that identify them in filings (fixed values).
COMPANIES = {
    "JPMorgan Chase": "0000019617",
    "PayPal": "0001633917",
    "Coinbase": "0001679788",
    "Lemonade": "0001691936",
    "Block (Square)": "0001512673",
    "Goldman Sachs": "0000886982",
    "Visa": "0001403161",
}
FORM = "10-K"
#: Where a filing's address in the manifest begins; nothing is fetched from it (fixed value).
DOC_URL = "https://www.sec.gov/Archives/edgar/full-indexdata"
MIN_DOCUMENT_CHARS = 10_000


def latest_filings(submissions: DataFrame, form: str = FORM) -> DataFrame:
    """First filing of a form in ``submissions(company, cik, form[], accessionNumber[], filingDate[], primaryDocument[])``.

    Arrays are newest first; amendments have other form names and do not match.
    """
    zipped = F.arrays_zip("form", "accessionNumber", "filingDate", "primaryDocument")
    hit = F.element_at(F.filter(zipped, lambda x: x["form"] == form), 1)
    found = submissions.where(F.array_contains("form", form)).select("company", zero_padded(F.col("cik")).alias("cik"), hit.alias("f"))
    number, document = F.col("f.accessionNumber"), F.col("f.primaryDocument")
    flat = F.replace(number, F.lit("-"), F.lit(""))
    url = F.concat_ws("/", F.lit(DOC_URL), F.ltrim("cik", F.lit("0")), flat, document)
    return found.select("company", "cik", number.alias("accession_number"), flat.alias("accession_flat"), F.col("f.filingDate").alias("filing_date"), document.alias("primary_doc"), url.alias("doc_url"))


def usable_document(status: Column, text: Column) -> Column:
    """A response that counts as a document: found, and longer than a stub."""
    return F.coalesce((status == 200) & (F.length(text) > MIN_DOCUMENT_CHARS), F.lit(False))


def with_local_file(manifest: DataFrame, folder: str) -> DataFrame:
    return manifest.withColumn("local_file", F.concat(F.lit(f"{folder}/"), slug(F.col("company")), F.lit(".html")))


def parse_manifest(manifest: DataFrame, raw: DataFrame) -> DataFrame:
    """Texts of the manifest's documents that exist: ``company, filing_date, source_file, text``."""
    joined = manifest.join(raw.select(F.col("path").alias("local_file"), "raw"), "local_file")
    return joined.select("company", "filing_date", F.col("local_file").alias("source_file"), document_text(F.col("raw")).alias("text"))
