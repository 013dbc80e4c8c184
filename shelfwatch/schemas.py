"""Explicit schemas of the stored entities and the value domains of their columns."""

from __future__ import annotations

PRODUCT = """
url string not null, retailer string not null, title string, brand string, price double,
original_price double, description string, product_code string, image_urls array<string>,
sale_status string, stock_status string, shopify_id bigint, shopify_status string,
modesty_status string, clothing_type string, neckline string, sleeve_length string,
lifecycle_stage string, data_completeness string, source string, assessment_status string,
last_workflow string, images_uploaded boolean, images_failed_count int, last_image_error string,
images_uploaded_at timestamp_ntz, first_seen timestamp_ntz, last_updated timestamp_ntz,
last_checked timestamp_ntz, extracted_at timestamp_ntz, assessed_at timestamp_ntz
"""

SNAPSHOT = """
id bigint, seq bigint, catalog_url string, retailer string, category string, title string,
price double, product_code string, image_urls array<string>, discovered_date date,
review_status string, scan_type string, image_url_source string, linked_product_url string,
link_confidence double, link_method string
"""

QUEUE_ITEM = """
id bigint, product_url string, retailer string, category string, review_type string,
priority string, status string, product_data string, suspected_match_data string,
review_decision string, reviewer_notes string, reviewed_at timestamp_ntz, reviewed_by string,
added_at timestamp_ntz, source_workflow string
"""

UPDATE_ITEM = """
product_url string, retailer string, priority string, reason string, catalog_price double,
products_price double, price_difference double, detected_at timestamp_ntz
"""

RETAILER_PATTERN = """
retailer string, url_stability_score double, sample_size bigint, path_stable boolean,
image_urls_consistent boolean, best_dedup_method string, dedup_confidence_threshold double,
url_changes_detected bigint, notes string
"""

ATTEMPT = """
seq bigint, retailer string, page_type string, url string, method string, success boolean,
errors array<string>, confidence double, url_changed boolean, tokens_used bigint, cost double,
processing_time double, attempted_at timestamp_ntz
"""

PAGE = "page_id bigint, url string, html string"

BATCH_OBJECT = """
urls array<string>, modesty_level string, retailer string, product_type string
"""

CHECKPOINT = """
batch_id string, workflow_type string, total_urls int, all_urls array<string>,
processed_urls array<string>, successful_count int, failed_count int, created_at string,
last_checkpoint string
"""

FAILURE_REPORT = """
batch_id string, workflow string, retailer string, category string, modesty_level string,
product_type string, run_date string, total_failed int,
failures array<struct<url: string, reason: string, stage: string, action: string,
  method_used: string, method_attempted: string, product_type: string, product_title: string,
  processing_time: double, attempted_at: string, certainty: string, has_price: boolean,
  has_title: boolean, notes: string, suspected_match: string>>
"""

# The admitted values of each enumerated column.
DOMAINS = {
    "lifecycle_stage": ["baseline_only", "pending_assessment", "assessed_approved",
                        "assessed_rejected", "imported_direct", "unknown"],
    "data_completeness": ["lightweight", "full", "enriched", "partial"],
    "assessment_status": ["not_assessed", "queued", "assessed", "not_for_assessment"],
    "shopify_status": ["not_uploaded", "draft", "published"],
    "priority": ["high", "normal", "low"],
    "status": ["pending", "reviewed", "skipped"],
    "review_decision": ["modest", "moderately_modest", "not_modest", "duplicate", "not_duplicate"],
    "match_status": ["confirmed_new", "suspected_duplicate", "confirmed_existing"],
    "action": ["updated", "unchanged", "delisted", "failed", "not_found"],
}
