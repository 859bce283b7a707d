"""Declared schemas; readers never infer."""

from __future__ import annotations


CANONICAL_DDL = (
    "source_name string, source_id string, source_url string, evidence_url string, title string, description string, start_at string, end_at string, timezone string, all_day boolean, "
    "occurrence_dates array<date>, venue string, building string, address string, modality string, organizer string, organizer_unit string, audience string, cost string, "
    "registration_url string, canonical_url string, categories array<string>, tags array<string>, last_seen_at string, confidence double, quality_flags array<string>, "
    "source_order int, ingest_seq long"
)
PUBLISHED_DDL = (
    "id string, title string, organizer string, date date, time string, location string, description string, tags array<string>, url string, source string, "
    "end_date date, dates array<date>"
)
STATUS_DDL = (
    "name string, ok boolean, count long, raw_count long, filtered_past long, invalid long, duration_ms long, fetched_at timestamp, error string"
)
POSTINGS_DDL = "field string, token string, pos long, id string"



def ddl_fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of a declaration without nested structs."""
    return [tuple(part.split(" ", 1)) for part in ddl.split(", ")]
