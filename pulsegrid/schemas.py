"""Schemas of the domain tables. Times are UTC without a zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERDICT = """significance_classification string, significance_sentiment string, significance_confidence double,
    matched_keywords array<string>, matched_categories array<string>, significance_notes string"""
CHANGE = f"""id bigint, company_id bigint, snapshot_id_old bigint, snapshot_id_new bigint, checksum_old string,
    checksum_new string, has_changed boolean, change_magnitude string, detected_at timestamp_ntz, {VERDICT},
    evidence_snippets array<string>"""

TABLES = {
    "companies": """id bigint, name string, homepage_url string, source_sheet string, flagged_for_review boolean,
        flag_reason string, notes string, created_at timestamp_ntz, updated_at timestamp_ntz""",
    "snapshots": """id bigint, company_id bigint, url string, content_markdown string, content_html string, status_code int,
        captured_at timestamp_ntz, has_paywall boolean, has_auth_required boolean, error_message string,
        content_checksum string, http_last_modified timestamp_ntz, capture_metadata string, baseline_classification string,
        baseline_sentiment string, baseline_confidence double, baseline_keywords array<string>,
        baseline_categories array<string>, baseline_notes string""",
    "change_records": CHANGE,
    "company_statuses": """id bigint, company_id bigint, status string, confidence double,
        indicators array<struct<type:string,value:string,signal:string>>, last_checked timestamp_ntz,
        http_last_modified timestamp_ntz, status_reason string, is_manual_override boolean""",
    "social_media_links": """id bigint, company_id bigint, platform string, profile_url string, discovery_method string,
        verification_status string, similarity_score double, discovered_at timestamp_ntz, last_verified_at timestamp_ntz,
        html_location string, account_type string, account_confidence double, rejection_reason string""",
    "blog_links": """id bigint, company_id bigint, blog_type string, blog_url string, discovery_method string,
        is_active boolean, discovered_at timestamp_ntz, last_checked_at timestamp_ntz""",
    "news_articles": f"""id bigint, company_id bigint, title string, content_url string, source string,
        published_at timestamp_ntz, discovered_at timestamp_ntz, match_confidence double, match_evidence array<string>,
        logo_similarity double, company_match_snippet string, keyword_match_snippet string, {VERDICT}""",
    "processing_errors": """id bigint, entity_type string, entity_id bigint, error_type string, error_message string,
        retry_count int, occurred_at timestamp_ntz""",
    "company_logos": """id bigint, company_id bigint, image_data binary, image_format string, perceptual_hash string,
        source_url string, extraction_location string, width int, height int, extracted_at timestamp_ntz""",
    "company_leadership": """id bigint, company_id bigint, person_name string, title string, linkedin_profile_url string,
        discovery_method string, confidence double, is_current boolean, discovered_at timestamp_ntz,
        last_verified_at timestamp_ntz, source_company_linkedin_url string""",
    "leadership_changes": """id bigint, company_id bigint, change_type string, person_name string, title string,
        linkedin_profile_url string, severity string, detected_at timestamp_ntz, confidence double,
        discovery_method string, context string""",
    "social_media_snapshots": """id bigint, company_id bigint, source_url string, source_type string,
        content_markdown string, content_html string, status_code int, captured_at timestamp_ntz, error_message string,
        content_checksum string, latest_post_date timestamp_ntz""",
    "social_media_change_records": f"{CHANGE}, source_url string, source_type string",
    "leadership_mentions": """id bigint, company_id bigint, person_name string, title_context string, source string,
        source_url string, confidence double, priority int, extracted_at timestamp_ntz, snapshot_id bigint""",
    "linkedin_snapshots": """id bigint, company_id bigint, linkedin_url string, url_type string, person_name string,
        content_html string, content_json string, vision_data_json string, screenshot_path string, content_checksum string,
        captured_at timestamp_ntz""",
}


def schema(table: str) -> StructType:
    """A table's columns, with who wrote the row."""
    return StructType.fromDDL(f"{TABLES[table]}, performed_by string")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def read(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A stored table; columns added later are NULL in older files."""
    return spark.read.schema(schema(table)).parquet(path)


def store(df: DataFrame, table: str, name: str, buckets: int = 200, path: str | None = None) -> None:
    """Write ``df`` as the catalog table ``name``, in the declared columns, bucketed by company.

    All rows of a company lie in one bucket, sorted, so windows and joins by company read the
    table where it lies: page texts aren't shuffled. Columns that ``df`` lacks are NULL; tables
    without a company are bucketed by id.
    """
    declared = schema(table)
    owner = "company_id" if "company_id" in declared.names else "id"
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared]
    writer = df.select(*columns).write.mode("overwrite").bucketBy(buckets, owner).sortBy(owner)
    (writer.option("path", path) if path else writer).saveAsTable(name)
