"""The relations of the engine."""

from __future__ import annotations

DOCUMENTS = "doc_id string, user_id string, filename string, storage string, size_bytes long, status string, total_pages int, created_at timestamp, updated_at timestamp"
STATUSES = "doc_id string, status string, updated_at timestamp"
CHUNKS = "chunk_id string, doc_id string, chunk_index int, start_offset long, end_offset long, text_preview string, storage_key string, stored_bytes long, created_at timestamp, token_count int"
EMBEDDINGS_MAP = "chunk_id string, vector_index int, model_name string, score double, created_at timestamp"
DOC_TEXT = "doc_id string, text string, stored_at timestamp, written long, row_id string, cleared boolean"
CHUNK_META = "chunks int, orig_bytes long, stored_bytes long, compressed boolean"
