"""Schemas of the engine's tables, as DDL."""

BOX = "struct<x0:double,top:double,x1:double,bottom:double>"
WORD = "struct<text:string,x0:double,x1:double,top:double,bottom:double>"
SCHEMAS = {
    "raw_documents": "deal_id string, source_path string, file_hash string, file_size_bytes bigint, page_count int, ingested_at timestamp, source_metadata map<string,string>, raw_bytes binary",
    "pages": f"deal_id string, page_number int, raw_text string, tables array<array<array<string>>>, has_images boolean, extraction_warnings array<string>, words array<{WORD}>",
    "chunks": "chunk_id string, deal_id string, chunk_index int, source_pages array<int>, section_type string, content string, contains_table boolean, classification_confidence double",
    "facts": f"fact_id string, deal_id string, chunk_id string, entity_id string, entity_raw_name string, claim_type string, claim_subtype_raw string, claim_value string, normalized_value_numeric double, normalized_value_unit string, normalized_value_text string, normalization_status string, source_page int, source_excerpt string, source_char_start int, source_char_end int, span_verification string, source_bbox array<{BOX}>, extraction_method string, confidence_score double, document_version int, extracted_at timestamp, ord bigint",
    "canonical_entities": "entity_id string, deal_id string, canonical_name string, entity_type string, aliases array<string>, created_at timestamp, updated_at timestamp",
    "criteria": "mandate_id string, mandate_version int, fund_name string, pos int, criterion_id string, name string, description string, claim_type string, claim_subtype string, operator string, threshold_num double, threshold_text string, threshold_list array<string>, threshold_unit string, weight double, is_knockout boolean",
    "score_results": "score_id string, deal_id string, mandate_id string, mandate_version int, total_score double, knockout_triggered boolean, knockout_criterion_name string, criterion_scores array<struct<criterion_id:string,criterion_name:string,is_knockout:boolean,met:boolean,raw_score:double,weighted_score:double,facts_used:array<struct<fact_id:string,entity_canonical_name:string,claim_type:string,claim_value:string,source_page:int,source_excerpt:string,confidence_score:double,contribution_direction:string>>,explanation:string>>, facts_evaluated bigint, scored_at timestamp, scoring_notes string",
    "audit_log": "event_id string, event_type string, deal_id string, parent_event_id string, root_event_id string, actor string, model_id string, input_payload string, output_payload string, latency_ms bigint, token_count_input bigint, token_count_output bigint, estimated_cost_usd double, success boolean, error_message string, occurred_at timestamp",
}
