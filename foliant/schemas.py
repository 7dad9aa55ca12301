"""Table schemas by version. `evolve` brings a frame of an older version to a newer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

_DOCUMENTS = "document_id string, title string, doc_type string, owner_person_id string, current_version_id string, status string, connector string, created_at bigint, updated_at bigint"
# The archive's tables.
DDL: dict[str, list[str]] = {
    "categories": ["id string, parent_id string, name string, path string, sort_order int, is_ai_proposed boolean"],
    "people": ["person_id string, display_name string, department string"],
    "managed_documents": [_DOCUMENTS, f"{_DOCUMENTS}, category_id string, last_reviewed_at bigint, effective_date bigint, review_interval_days int, review_due_at bigint"],
    "document_versions": [
        "version_id string, document_id string, version_no int, original_sha256 string, original_filename string, original_mime string, original_bytes bigint, markdown string, content_hash string, simhash bigint, conversion_engine string, conversion_confidence double, converted_at bigint, created_at bigint"
    ],
    "chunks": ["chunk_id bigint, version_id string, document_id string, ordinal int, title string, heading_path string, page_from int, page_to int, text string, char_count int, created_at bigint, loaded_at timestamp"],
    "chunk_embeddings": ["chunk_id bigint, document_id string, model string, embedding array<float>"],
    "document_relations": ["relation_id string, a_version_id string, b_version_id string, kind string, score double, evidence string, status string, detected_at bigint, loaded_at timestamp"],
    "findings": ["id string, kind string, severity string, title string, summary string, document_ids array<string>, version_ids array<string>, detail string, citations array<struct<chunk_id:bigint,document_id:string,version_id:string,page:int,heading_path:string,quote:string>>, confidence double, status string, detected_at bigint, resolved_at bigint"],
    "pairs_checked": ["a_chunk_id bigint, b_chunk_id bigint, verdict string, checked_at bigint"],
    "review_events": ["id string, document_id string, person_id string, action string, note string, at bigint"],
    "jobs": ["id string, kind string, payload string, status string, attempts int, error string, created_at bigint"],
}


def schema(table: str, version: int | None = None) -> T.StructType:
    """The schema of a table, the newest unless a version (from 1) is named."""
    versions = DDL[table]
    fields = versions[(version or len(versions)) - 1]
    return T.StructType.fromDDL(fields)


def evolve(df: DataFrame, table: str) -> DataFrame:
    """The frame in the newest schema: columns it lacks are null, columns it has beyond stay out."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)))
