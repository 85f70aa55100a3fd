"""Explicit schemas of raw payloads and canonical tables."""

RAW_PAGE = (
    "raw_response_id string, api_request_id string, ingestion_run_id string, source_system string, "
    "endpoint string, resource_scope_type string, resource_scope_id string, request_parameters string, "
    "http_status smallint, page_token_used string, next_page_token_returned string, "
    "retrieved_at timestamp_ntz, raw_json_payload string, payload_hash string, "
    "parser_version string, source_schema_version string"
)
RAW_PAGE_COLUMNS = [field.split()[0] for field in RAW_PAGE.split(", ")]

COMMENT_PAGE = (
    "items array<struct<id:string, snippet:struct<totalReplyCount:string, topLevelComment:struct<"
    "snippet:struct<publishedAt:string, authorChannelId:struct<value:string>, textOriginal:string, "
    "likeCount:string>>>>>, nextPageToken string, _corrupt_record string"
)

REQUEST_PARAMETERS = "part string, requested_video_ids array<string>, id_count bigint"

# Canonical tables, in the order they are filled. `?` is not needed: every column is nullable.
TABLES = {
    "raw_page": RAW_PAGE,
    "channel": "channel_key string, source_system string, source_id string, channel_name string",
    "video": (
        "video_key string, channel_key string, source_system string, source_id string, published_at timestamp_ntz, "
        "duration_seconds bigint, is_short boolean, short_classification_rule_version string, "
        "primary_language_code string, content_type string, first_observed_at timestamp_ntz"
    ),
    "author": "author_key string, author_hash string, salt_version_id string",
    "event_version": (
        "event_version_key string, event_key string, event_name string, occurred_at timestamp_ntz, "
        "inclusion_rationale string, event_terms array<string>, baseline_terms array<string>, "
        "valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"
    ),
    "event_window": (
        "window_key string, event_version_key string, window_type string, window_sequence bigint, "
        "relative_offset_start bigint, relative_offset_end bigint, absolute_start_at timestamp_ntz, "
        "absolute_end_at timestamp_ntz"
    ),
    "comment": (
        "comment_key string, source_system string, source_comment_id string, video_key string, "
        "parent_comment_key string, author_key string, published_at timestamp_ntz, "
        "first_observed_at timestamp_ntz, is_reply boolean"
    ),
    "comment_text_version": (
        "text_version_key string, comment_key string, text_hash string, text_content string, "
        "observed_at timestamp_ntz, is_latest_version boolean"
    ),
    "comment_engagement": "comment_key string, observed_at timestamp_ntz, likes bigint, reply_count bigint",
    "comment_availability": "comment_key string, observed_at timestamp_ntz, availability_status string",
    "video_snapshot": (
        "video_snapshot_key string, video_key string, observed_at timestamp_ntz, title string, description string, "
        "views bigint, likes bigint, ingestion_run_id string, api_request_id string, raw_response_id string"
    ),
    "comment_target": (
        "comment_target_key string, text_version_key string, target_entity_key string, "
        "target_resolution_model_version_key string, resolution_method string, confidence decimal(6,5), "
        "classification_status string, is_primary_target boolean"
    ),
    "inference": (
        "inference_run_id string, subject_type string, subject_key string, construct_key string, "
        "predicted_label string, score double, confidence double, classification_status string, "
        "processed_at timestamp_ntz"
    ),
}
