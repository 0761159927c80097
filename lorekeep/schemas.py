"""Explicit schemas of all tables. Nothing is inferred."""

from __future__ import annotations

BULLETS = (
    "id string, scope string, section string, content string, distilled_rule string, code_content string, code_language string, instructivity_score double, knowledge_type string, source_type string,"
    " recall_count int, last_recall timestamp, decay_weight double, related_tools array<string>, related_files array<string>, key_entities array<string>, tags array<string>, embedding array<float>,"
    " created_at timestamp, updated_at timestamp"
)
ARCHIVE = "id string, scope string, section string, content string, distilled_rule string, knowledge_type string, recall_count int, decay_weight double, archived_at timestamp, created_at timestamp"
CONFLICTS = "id string, bullet_id_a string, bullet_id_b string, conflict_type string, description string, resolved int, resolved_at timestamp, created_at timestamp"
DISTILLED = (
    "scope string, section string, content string, distilled_rule string, code_content string, code_language string, knowledge_type string, instructivity_score double, source_type string,"
    " related_tools array<string>, related_files array<string>, key_entities array<string>, tags array<string>, embedding array<float>"
)
CONTEXT = "struct<file: string, language: string, error_message: string, command: string>"
QUEUE = f"timestamp string, tool_name string, pattern_type string, summary string, context {CONTEXT}, processed boolean"
EVENTS = "tool_name string, tool_input map<string, string>, tool_response string, session_id string"
#: Version of the stored layout.
VERSION = 2
# The kinds of knowledge, each with its section.
SECTION_OF = {"Pitfall": "pitfalls", "Method": "methods", "Trick": "techniques", "Preference": "preferences", "Knowledge": "knowledge"}
SOURCE_TYPES = ("auto", "manual", "imported")


def names(schema: str) -> list[str]:
    """Column names of one of the schemas above."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names
