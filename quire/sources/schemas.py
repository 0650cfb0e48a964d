"""Schemas of a library's tables: natural keys, no inferred types."""

from __future__ import annotations

from pyspark.sql.types import StructType

SCHEMAS = {
    name: StructType.fromDDL(ddl)
    for name, ddl in {
        "books": "id bigint, uuid string, title string, original_title string, author string, language_pair string, user_id bigint, status string, display_order bigint, share_token string, created_at timestamp, updated_at timestamp",
        "chapters": "id bigint, book_id bigint, chapter_number int, chapter_title string, raw_html string, order_index int, text_nodes_json string",
        "translations": "id bigint, chapter_id bigint, xpath string, original_text string, original_html string, translated_text string, order_index int",
        "translation_jobs": "job_id bigint, book_uuid string, source_language string, target_language string, total_chapters int, glossary_json string, status string, backend string, created_at timestamp, updated_at timestamp",
        "user_book_progress": "user_id bigint, book_uuid string, is_completed int, reading_progress int, completed_at timestamp, last_read_at timestamp, chapter_number int, paragraph_xpath string, show_original int",
        "book_shelves": "shelf_id string, book_id bigint, position bigint",
        "shelf_slots": "id bigint, shelf_id string, row bigint, col bigint, sort_order bigint, label string, is_public int",
        "book_shelf_slots": "book_id bigint, slot_id bigint, position bigint",
        "user_shelf_slot_labels": "user_id bigint, slot_id bigint, label string",
        "users": "user_id bigint, email string, name string, credits bigint",
        "sessions": "user_id bigint, session_token string, expires_at timestamp",
        "credit_transactions": "id bigint, user_id bigint, amount bigint, type string, payment string, balance_after bigint, created_at timestamp",
        "login_codes": "id bigint, email string, abuse_key string, code_hash string, ip string, expires_at timestamp, attempts int, consumed_at timestamp, created_at timestamp",
    }.items()
}


def language_pair(column: str):
    """(source, target) of a pair such as en-zh; the target ``none`` means that there is no translation."""
    from pyspark.sql import functions as F

    parts = F.split(column, "-")
    return parts[0], F.nullif(parts[1], F.lit("none"))
