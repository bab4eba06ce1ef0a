"""Schemas of the tables the library keeps."""

TOPICS = (
    "slug string, title string, aliases array<string>, tags array<string>, projects array<string>, created timestamp, updated timestamp, "
    "extracted_at timestamp, source string, confidence string, source_context_id decimal(20,0), body string"
)
PROCESSED = "context_id decimal(20,0), head_turn_id decimal(20,0), pass long"
HASHES = "hash string"
RESPONSES = "context_id decimal(20,0), response string"
ERRORS = "context_id decimal(20,0), error string"
