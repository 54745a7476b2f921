"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.session import ensure_checkpoint_dir, sf_path

from .collocations import collocations
from .decontam import leaks
from .filter_audit import interactions
from .html_content import extracted
from .licenses import license_digest
from .line_quality import cleaned_texts
from .near_dedup import near_duplicates
from .packing import packed_documents
from .pii import pii_digest
from .repair_tokens import read_token_files, write_token_files
from .secrets import secret_digest
from .suffix_dedup import without_repeats
from .warc import derived_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def response_records(pages: DataFrame) -> DataFrame:
    """Stand-in input for the WARC job: each page as a response record, ``(page_id, record binary)``."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    block = F.concat(F.encode(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"), "UTF-8"), body)
    ident = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), "url"))
    urn = F.regexp_replace(ident, "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: "), urn,
                    F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
                    F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256),
                    F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
                    F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", F.concat(F.encode(head, "UTF-8"), block, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of documents: pattern, checksum, context."""
    return pii_digest(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 5-word shingles, similarity 0.75 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens by multiway differencing."""
    return packed_documents(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that an earlier document holds too."""
    return without_repeats(table(spark, sf_dir, "documents"))


def op5_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Re-Pair token files in the shared folder, read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/tokens"
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of documents: known shapes and tokens that pass as random."""
    return secret_digest(table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response record, with a digest of each whole record."""
    made = derived_records(response_records(table(spark, sf_dir, "pages")))
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op8_cross_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document (base counts, lines common to many documents of its source), and the kept texts without these lines."""
    return cleaned_texts(table(spark, sf_dir, "documents"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by smoothed text-to-tag ratios."""
    return extracted(table(spark, sf_dir, "pages"))


def op10_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, up to 3 substitutions in 13 tokens."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every text of documents: exact set-similarity join of blocks and templates."""
    return license_digest(table(spark, sf_dir, "documents"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from documents, by lang, in all 120 orders."""
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each lang of documents."""
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_minhash_near_dedup, op3_karmarkar_karp_packing, op4_suffix_array_dedup,
                            op5_repair_token_files, op6_secret_scan,
                            op7_warc_derivatives, op8_cross_document_lines, op9_html_main_text, op10_spaced_seed_leaks, op11_license_scan,
                            op12_filter_interactions, op13_phrase_collocations)}
