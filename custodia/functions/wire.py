"""Strings that records, catalogs and mail clients already use.

These are data formats, kept here as plain text because results must carry exactly these
values; nothing else in the library spells them.
"""

# Keys of an open classification record -> column, kind (fixed values).
HIT_FIELDS = [
    ("datasource_scan_id", "dxr#datasource_scan_id", "int"),
    ("file_name", "ds#file_name", "str"),
    ("parent_paths", "ds#parent_folder_paths", "list"),
    ("mime_type", "dxr#mime_type", "str"),
    ("indexed_at", "dxr#indexed_date", "str"),
    ("sha256", "dxr#sha_256_hash", "str"),
    ("sha256_file_meta", "dxr#sha_256_hash_file_meta", "str"),
    ("doc_language", "dxr#doc_lang", "str"),
    ("composite_type", "dxr#composite_type", "str"),
    ("is_processed", "dxr#is_processed", "bool"),
    ("document_status", "dxr#document_status", "str"),
    ("text_extraction_status", "dxr#text_extraction_status", "str"),
    ("metadata_extraction_status", "dxr#metadata_extraction_status", "str"),
    ("dxr_tags", "dxr#tags", "list"),
    ("removed_tags", "dxr#manually_removed_tags", "list"),
    ("ocr_used", "dxr#ocr_used", "bool"),
    ("categories", "ai#category", "list"),
    ("annotations", "annotations", "str"),
    ("folder_id", "folder_id", "str"),
    ("modified_at", "metadata#MODIFIED_DATE", "str"),
    ("binary_hash", "metadata#binary_hash", "str"),
]
# Keys that may name the file or the object, first non-empty one wins (fixed values).
FILE_KEYS = ["ds#file_path", "ds#file_name", "dxr#file_id"]
OBJECT_KEYS = ["object_id", "dxr#file_id"]
ANNOTATION_PREFIXES = ["annotation_stats#", "annotation."]
RAW_TEXT_KEY = "dxr#raw_text"
ACCESS_KEY = "computed.metadata#WHO_CAN_ACCESS"
EXTRACTED_PREFIX = "extracted_metadata#"

# Column contract of the metadata table (fixed values).
METADATA_DDL = """
    file_path STRING NOT NULL, relative_path STRING NOT NULL, catalog_name STRING NOT NULL,
    schema_name STRING NOT NULL, volume_name STRING NOT NULL, file_size BIGINT NOT NULL,
    modification_time BIGINT NOT NULL, datasource_id STRING NOT NULL, datasource_scan_id BIGINT,
    job_id STRING NOT NULL, file_name STRING, object_id STRING, parent_paths ARRAY<STRING> NOT NULL,
    mime_type STRING, indexed_at STRING, sha256 STRING, sha256_file_meta STRING, doc_language STRING,
    composite_type STRING, is_processed BOOLEAN, document_status STRING, text_extraction_status STRING,
    metadata_extraction_status STRING, dxr_tags ARRAY<STRING> NOT NULL, removed_tags ARRAY<STRING> NOT NULL,
    ocr_used BOOLEAN, categories ARRAY<STRING> NOT NULL, annotations STRING, folder_id STRING,
    modified_at STRING, binary_hash STRING, annotation_stats_json STRING, raw_metadata STRING NOT NULL,
    collected_at TIMESTAMP NOT NULL
"""

# Scalar and nested fields of one exported file record (fixed values).
FILE_SCALARS = [
    ("file_id", "fileId"),
    ("file_name", "fileName"),
    ("path", "path"),
    ("size", "size"),
    ("mime_type", "mimeType"),
    ("created_at", "createdAt"),
    ("last_modified_at", "lastModifiedAt"),
    ("content_sha256", "contentSha256"),
    ("scan_depth", "scanDepth"),
]
FILE_NESTED = [
    "datasource",
    "labels",
    "extractedMetadata",
    "entitlements",
    "dlpLabels",
    "annotators",
    "owner",
    "createdBy",
    "modifiedBy",
]

# Words for yes and no (fixed values).
TRUE_WORDS = ["true", "1", "yes"]
FALSE_WORDS = ["false", "0", "no"]

# Catalog naming and texts (fixed values).
TAG_SCHEME = "dxrtag"
DATASOURCE_SCHEME = "dxrds"
PROCESS_SCHEME = "dxrproc"
DATASET_TYPE = "unstructured_dataset"
DATASOURCE_TYPE = "unstructured_datasource"
PROCESS_TYPE = "dxr_process"
HAS_RELATION = "unstructured_datasource_has_unstructured_dataset"
REF_MAX, REF_MIN, SLUG_MAX, SHORT_HASH = 36, 3, 90, 8
LABEL_NAME_PREFIX = "dxr_label_"
GROUP_NAME = "Unstructured Datasets"
PROCESS_NAME = "DXR processing: %s -> %s"
PROCESS_TEXT = "DXR processing that derived label '%s' from datasource '%s' (id %s)."
PROCESS_LINES = ["Label type: ", "Label subtype: ", "Created at: ", "Updated at: ", "DXR Search: "]

# Access policy (fixed values).
REVIEW_CATEGORY = "Performance Review"
REVIEW_GROUP = "can_see_all_reviews"
PUBLIC_CATEGORIES = ["Code of Conduct", "Leave and Time-Off Policy"]

# Mail replies (fixed values).
MAIL_ACCEPTED = "250 Message accepted for delivery"
MAIL_SYNTAX = "501 Syntax: MAIL FROM: <address>"
MAIL_ERROR = "451 Internal server error - please try again later"
MAIL_BLOCKED = "550 Blocked - %s in %s"

# Retrieval texts and limits (fixed values).
CONTEXT_PART = "Document %d (from %s, category: %s) (relevance: %.3f):\n   Matched queries: %s\n%s\n"
CONTEXT_BREAK = "\n---\n"
INGEST_ERROR = "Failed to process document "
TITLE_MAX, CATEGORY_MAX, EMPLOYEE_MAX = 255, 100, 200
UNTITLED = "Untitled Document"
NO_CONTEXT = "No relevant documents found for this query."
CHUNK_TOKENS, CHUNK_OVERLAP = 500, 50
PREVIEW_CHARS = 300

# Text left where an archived duplicate was (fixed value).
STUB_TEXT = (
    "This file has been removed due to records and retention policy. Contact your administrator for access."
)
