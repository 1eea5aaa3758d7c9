"""Tables, enumerations and constants of the architecture graph."""

from __future__ import annotations

SCHEMA_VERSION = 2

#: Confidence tiers from weakest to strongest; the rank is the position.
CONFIDENCES = ("unresolved", "ambiguous", "heuristic", "resolved", "exact")
SYMBOL_KINDS = ("function", "class", "method", "interface", "type", "enum", "variable")
EDGE_KINDS = ("calls", "extends", "implements", "instantiates", "references")
SKIP_REASONS = ("vendored", "unreadable", "not-a-file", "too-large", "minified", "binary")

FILES = "id bigint, path string, lang string, content_hash string, loc int, last_commit string, error_count int, indexed_at bigint"
SYMBOLS = "id bigint, file_id bigint, name string, kind string, start_line int, end_line int, exported boolean, signature string, parent_name string"
IMPORTS = "id bigint, file_id bigint, raw_specifier string, resolved_file_id bigint, kind string, confidence string, line int"
EDGES = "id bigint, src_file_id bigint, src_symbol_id bigint, dst_file_id bigint, dst_symbol_id bigint, dst_name string, kind string, confidence string, line int"
SUMMARIES = "scope string, target string, content_hash string, summary string, created_at bigint"
META = "key string, value string"

PARSED_LISTS = {
    "symbols": "array<struct<name: string, kind: string, start_line: int, end_line: int, exported: boolean, signature: string, parent_name: string>>",
    "imports": "array<struct<specifier: string, kind: string, line: int>>",
    "call_sites": "array<struct<name: string, line: int, enclosing_symbol: string, kind: string>>",
    "errors": "array<struct<line: int, message: string>>",
}
PARSED_FILE = "path string, lang string, content_hash string, loc int, " + ", ".join(f"{k} {v}" for k, v in PARSED_LISTS.items())

#: Ranges and defaults of the public queries' arguments.
LIMIT = (1, 500, 50)
DEPTH = (1, 10)
MIN_SIZE = (1, 100, 2)
WINDOW_DAYS = (1, 3650, 180)


def within(name: str, value: int, bounds) -> int:
    low, high = bounds[0], bounds[1]
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return value
