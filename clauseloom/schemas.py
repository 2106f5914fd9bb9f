"""Table schemas at the boundaries of the engine."""

from __future__ import annotations

BLOCKS = (
    "document_id string, pos long, block_type string, html string, caption string, "
    "rows array<array<string>>, images map<string,string>"
)
CONTENT = "array<struct<type:string,text:string>>"
TABLES = "array<struct<html:string,number:string,caption:string,rows:array<array<string>>>>"
FIGURES = "array<struct<number:string,path:string,format:string,original_key:string,size_bytes:int,caption:string>>"
REQUIREMENTS = "array<struct<type:string,keyword:string,text:string>>"
NESTED_CHUNKS = (
    "chunk_id string, document_id string, document_metadata struct<id:string>, title string, parent_id string, "
    "hierarchy struct<parent_id:string,children_ids:array<string>,level:int>, "
    f"content {CONTENT}, tables {TABLES}, figures {FIGURES}, requirements {REQUIREMENTS}, "
    f"children_ids array<string>, enrichment struct<requirements:{REQUIREMENTS},"
    "internal_refs:struct<clauses:array<string>>,external_refs:array<string>>"
)
SESSIONS = (
    "session_id string, user_id string, title string, created_at timestamp, updated_at timestamp, "
    "starred boolean, test_plan_files map<string,string>, "
    "messages array<struct<role:string,content:string,timestamp:string,message_id:string>>"
)
TEST_CASE = (
    "struct<id:string,source_requirement:string,requirement_type:string,procedure:string,pass_criteria:string,"
    "equipment_required:array<string>,source_chunks:array<string>>"
)
TEST_PLAN = (
    "struct<test_plan_summary:string,applicable_standard:string,"
    f"test_cases:array<{TEST_CASE}>,sources_used:array<string>,missing_context_warnings:array<string>>"
)
REQUIREMENT_TYPES = ("mandatory", "prohibition", "recommendation", "permission")
CONTENT_TYPES = ("paragraph", "list", "table", "figure")
DOCUMENT_STATES = (
    "PENDING", "PROCESSING", "PROCESSING_MARKER", "COMPLETED_MARKER", "PROCESSING_SCHEMA", "COMPLETED_SCHEMA",
    "PROCESSING_CHUNKING", "COMPLETED_CHUNKING", "PROCESSING_GRAPH", "COMPLETED_GRAPH", "COMPLETED", "FAILED",
)
